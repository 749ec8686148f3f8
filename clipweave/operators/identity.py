"""Identities of a video across its clips: ordered folds of sightings into cards of people, vehicles, plates and objects.

Each sighting is matched against the cards so far, so a fold is sequential within a video by its meaning;
videos are folded side by side. The sightings of a video stream through their task in order, and only its
cards are held, so a video may have any number of sightings. Attributes are cleaned in columns before.
Whether two values of an attribute agree is looked up once per value against all values that the cards
have, and a sighting is scored against all cards at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SIGNATURE, clean, is_officer, normal_plate, strip

#: Points of the attributes that agree, attributes that mark a person, those whose longer text is kept, points that match.
POINTS = {"race": 1, "gender": 1, "hair": 2, "glasses": 2, "clothes": 2, "shoes": 1, "bag": 1, "distinctive": 2}
MARKS = ("glasses", "hair", "distinctive")
LONGER = ("clothes", "description", "distinctive", "hair")
ENOUGH, WITH_MARK = 3, 2
#: Attributes that keep their wording; the others are stored cleaned.
AS_TOLD = ("clothes", "distinctive", "description")
ATTRIBUTES = (*SIGNATURE, "description")
#: Values of an attribute whose agreement with all others is remembered.
REMEMBERED = 4096


class _Values:
    """The values of one attribute as numbers, and which of them agree: one text within the other."""

    def __init__(self):
        self.code: dict[str, int] = {"": 0}
        self.text = np.array([""], dtype=object)
        self._agree: dict[int, np.ndarray] = {}

    def number(self, text: str) -> int:
        n = self.code.get(text)
        if n is None:
            n = self.code[text] = len(self.code)
            self.text = np.append(self.text, text)
        return n

    def agree(self, n: int) -> np.ndarray:
        """A flag for each value so far; the unsaid value agrees with none."""
        known = self._agree.get(n)
        if known is None or len(known) < len(self.text):
            mine, start = self.text[n], 0 if known is None else len(known)
            more = np.array([bool(mine) and bool(t) and (mine in t or t in mine) for t in self.text[start:]], bool)
            if len(self._agree) >= REMEMBERED:
                self._agree.clear()
            known = self._agree[n] = more if known is None else np.concatenate([known, more])
        return known


class _People:
    """Cards of one video: a column of value numbers per attribute that is compared, and the stored texts."""

    def __init__(self):
        self.values = {k: _Values() for k in SIGNATURE}
        self.codes = {k: np.zeros(64, np.int64) for k in SIGNATURE}
        self.officer = np.zeros(64, np.int8)
        self.cards: list[dict] = []
        self.by_id: dict[str, int] = {}
        self.top = 0

    def best(self, said: dict[str, int], officer: int, worn: str) -> int | None:
        """The card that agrees most, the first of equal ones; none against what is known about officers."""
        n = len(self.cards)
        if not n or not any(said.values()):
            return None
        points = np.zeros(n, np.int64)
        for k, code in said.items():
            if code:
                points += POINTS[k] * self.values[k].agree(code)[self.codes[k][:n]]
        points[self.officer[:n] * officer < 0] = 0
        at = int(points.argmax())
        if points[at] >= ENOUGH:
            return at
        marked = points[at] >= WITH_MARK and any(said[k] and self.values[k].agree(said[k])[self.codes[k][at]] for k in MARKS)
        other = self.cards[at]["worn"]
        return at if marked and worn and other and (worn in other or other in worn) else None

    def see(self, row: dict) -> str:
        """Takes a sighting in and names its card."""
        said = {k: self.values[k].number(row[f"c_{k}"]) for k in SIGNATURE}
        officer = 0 if row["is_cop"] is None else 1 if row["is_cop"] else -1
        claimed = row["claimed_id"]
        at = self.by_id.get(claimed) if claimed else None
        if at is None and not row["is_new"]:
            at = self.best(said, officer, row["worn"])
        if at is None:
            return self._open(row, claimed, officer, said)
        self._fill(at, row, officer)
        return self.cards[at]["local_id"]

    def _open(self, row: dict, claimed: str | None, officer: int, said: dict[str, int]) -> str:
        at = len(self.cards)
        name = claimed if claimed and claimed.startswith("person_") else f"person_{self.top + 1}"
        self.top = max(self.top, _number(name, "person_"))
        self.by_id[name] = at
        if at == len(self.officer):
            self.officer = np.concatenate([self.officer, np.zeros(at, np.int8)])
            self.codes = {k: np.concatenate([c, np.zeros(at, np.int64)]) for k, c in self.codes.items()}
        self.officer[at] = officer
        for k, code in said.items():
            self.codes[k][at] = code
        self.cards.append({"local_id": name, "worn": row["worn"], **{k: row[k] for k in ATTRIBUTES}, "first_clip": row["clip_index"], "last_clip": row["clip_index"]})
        return name

    def _fill(self, at: int, row: dict, officer: int) -> None:
        """What a card lacks, and of some attributes the longer text; an officer once is one."""
        card = self.cards[at]
        if officer > 0 or not self.officer[at]:
            self.officer[at] = officer or self.officer[at]
        for k in ATTRIBUTES:
            new, old = row[k], card[k]
            if new in ("", "unknown") or not (old in ("", "unknown") or (k in LONGER and len(new) > len(old))):
                continue
            card[k] = new
            if k in POINTS:
                self.codes[k][at] = self.values[k].number(row[f"c_{k}"])
            if k == "clothes":
                card["worn"] = row["worn"]
        card["last_clip"] = row["clip_index"]

    def rows(self) -> Iterator[dict]:
        for at, card in enumerate(self.cards):
            yield {**card, "is_cop": None if not self.officer[at] else bool(self.officer[at] > 0)}


def _number(name: str, prefix: str) -> int:
    tail = name.removeprefix(prefix)
    return int(tail) if name.startswith(prefix) and tail.isdigit() else 0


class _Things:
    """Cards of the vehicles, plates and objects of one video, found by their names through tables.

    ``found`` has for each name the first card, in the order of the cards, that has it now.
    """

    def __init__(self):
        self.cards: list[dict] = []
        self.found: dict[tuple, dict] = {}
        self.bare: dict[str, list[int]] = {}
        self.top = {"vehicle": 0, "object": 0}

    def see(self, row: dict) -> str:
        card = {"vehicle": self._vehicle, "plate": self._plate, "object": self._object}[row["kind"]](row)
        card["last_clip"] = row["clip_index"]
        if card["kind"] == "vehicle" and card["plate"]:
            brought = self._plate({"plate": card["plate"], "vehicle_id": card["local_id"], "confidence": None, "clip_index": row["clip_index"]})
            brought["last_clip"] = row["clip_index"]
        return card["local_id"]

    def _new(self, kind: str, row: dict, name: str | None, **values) -> dict:
        if name is None:
            claimed = row["claimed_id"] or ""
            name = claimed if claimed.startswith(f"{kind}_") else f"{kind}_{self.top[kind] + 1}"
            self.top[kind] = max(self.top[kind], _number(name, f"{kind}_"))
        card = {"kind": kind, "local_id": name, "first_clip": row["clip_index"], "order": len(self.cards), **values}
        self.cards.append(card)
        self._name(card, kind, "id", name)
        return card

    def _name(self, card: dict, *name: str) -> None:
        known = self.found.get(name)
        if known is None or card["order"] < known["order"]:
            self.found[name] = card

    def _vehicle(self, row: dict) -> dict:
        """By plate, then by id, then by colour among those without a plate unless it is said to be new."""
        plate, color, claimed = row["plate"], row["color"], row["claimed_id"]
        card = self.found.get(("vehicle", "plate", plate)) if plate else None
        card = card or (self.found.get(("vehicle", "id", claimed)) if claimed else None)
        if card is None and color and not row["is_new"]:
            card = self._without_plate(color)
        if card is None:
            card = self._new("vehicle", row, None, color="", plate="", analysis="")
        if plate and plate != card["plate"]:
            self._replate(card, plate)
        if color and not card["color"]:
            card["color"] = color
            heapq.heappush(self.bare.setdefault(color, []), card["order"])
        if len(row["analysis"]) > len(card["analysis"]):
            card["analysis"] = row["analysis"]
        return card

    def _without_plate(self, color: str) -> dict | None:
        """The first card of a colour that has no plate; those that got one are dropped for good."""
        waiting = self.bare.get(color, [])
        while waiting and self.cards[waiting[0]]["plate"]:
            heapq.heappop(waiting)
        return self.cards[waiting[0]] if waiting else None

    def _replate(self, card: dict, plate: str) -> None:
        old, card["plate"] = card["plate"], plate
        self._name(card, "vehicle", "plate", plate)
        if old and self.found.get(("vehicle", "plate", old)) is card:
            del self.found["vehicle", "plate", old]
            for other in self.cards:
                if other["kind"] == "vehicle" and other["plate"] == old:
                    self._name(other, "vehicle", "plate", old)

    def _plate(self, row: dict) -> dict:
        card = self.found.get(("plate", "id", f"plate_{row['plate']}"))
        if card is None:
            card = self._new("plate", row, f"plate_{row['plate']}", plate=row["plate"], vehicle_id=row["vehicle_id"], confidence=row["confidence"] or 0.6)
        card["vehicle_id"] = row["vehicle_id"] or card["vehicle_id"]
        return card

    def _object(self, row: dict) -> dict:
        """By label and mark, then by id."""
        mark, claimed = row["distinctive"], row["claimed_id"] or ""
        card = self.found.get(("object", row["label"], mark)) if mark else None
        if card is None and claimed.startswith("object_"):
            card = self.found.get(("object", "id", claimed))
        if card is None:
            card = self._new("object", row, None, label=row["label"], distinctive="")
        if mark and not card["distinctive"]:
            card["distinctive"] = mark
            self._name(card, "object", card["label"], mark)
        return card

    def rows(self) -> Iterator[dict]:
        yield from self.cards


def _folding(make, columns: list[str], batch: int = 20_000):
    """Streams the sorted sightings of videos through their folds: a row per sighting at once, the cards at a video's end."""

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, fold, out = None, None, []
        for pdf in batches:
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if fold is None or row["video_id"] != video:
                    out += [{"video_id": video, **r} for r in fold.rows()] if fold else []
                    video, fold = row["video_id"], make()
                out.append({"video_id": video, "sighting_id": row["sighting_id"], "clip_index": row["clip_index"], "kind": row.get("kind"), "local_id": fold.see(row)})
                if len(out) >= batch:
                    yield frame(out)
                    out = []
        out += [{"video_id": video, **r} for r in fold.rows()] if fold else []
        yield frame(out)

    return run


def _fold(sightings: DataFrame, make, schema: str) -> DataFrame:
    ordered = sightings.where("video_id is not null").repartition("video_id").sortWithinPartitions("video_id", "clip_index", "position", "sighting_id")
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    return ordered.mapInPandas(_folding(make, columns), schema)


def _given(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(name), otherwise) if name in df.columns else otherwise


_PEOPLE = "video_id string, sighting_id string, clip_index int, local_id string, is_cop boolean, " + ", ".join(f"{k} string" for k in ATTRIBUTES) + ", first_clip int, last_clip int"
_THINGS = (
    "video_id string, sighting_id string, clip_index int, kind string, local_id string, color string, plate string, analysis string, label string, distinctive string, "
    "vehicle_id string, confidence double, first_clip int, last_clip int"
)


def fold_people(sightings: DataFrame) -> DataFrame:
    """A row for each sighting with the card it became part of, and a row for each card (``sighting_id`` null).

    ``sightings``: ``video_id, clip_index, position, sighting_id``, the attributes, ``is_cop`` and ``role``;
    ``claimed_id`` names a known card or a new one, ``is_new`` forbids matching. Three points match, officers
    never with civilians; the first of equal cards is taken. Attributes that state nothing are unknown; rows
    without a video are left out, repeated rows are sightings of their own.
    """
    unsaid = F.lit(None).cast("string")
    told = {k: F.coalesce(strip(_given(sightings, k, unsaid)), F.lit("")) for k in AS_TOLD} | {k: clean(_given(sightings, k, unsaid)) for k in SIGNATURE if k not in AS_TOLD}
    compared = {f"c_{k}": F.when(clean(told[k], "") == "unknown", "").otherwise(clean(told[k], "")) for k in SIGNATURE}
    rows = sightings.select(
        "video_id", F.col("clip_index").cast("int").alias("clip_index"), "position", F.col("sighting_id").cast("string").alias("sighting_id"),
        *[c.alias(n) for n, c in {**told, **compared, "worn": clean(told["clothes"], "")}.items()],
        is_officer(_given(sightings, "is_cop", F.lit(None)), _given(sightings, "role", unsaid)).alias("is_cop"),
        F.nullif(strip(_given(sightings, "claimed_id", unsaid)), F.lit("")).alias("claimed_id"), _given(sightings, "is_new", F.lit(False)).alias("is_new"),
    )
    return _fold(rows, _People, _PEOPLE)


def fold_things(sightings: DataFrame) -> DataFrame:
    """As ``fold_people`` for vehicles, objects and plates (``kind``), with the plates that vehicles bring.

    ``sightings``: ``video_id, clip_index, position, sighting_id, kind`` and what the kind has of ``color, plate,
    analysis, label, distinctive, vehicle_id, confidence``. Plates are normalised; a plate sighting that is none is left out.
    """
    unsaid = F.lit(None).cast("string")
    text = lambda name: F.coalesce(strip(_given(sightings, name, unsaid)), F.lit(""))
    rows = sightings.select(
        "video_id", F.col("clip_index").cast("int").alias("clip_index"), "position", F.col("sighting_id").cast("string").alias("sighting_id"), "kind",
        F.lower(text("color")).alias("color"), normal_plate(text("plate")).alias("plate"), text("analysis").alias("analysis"),
        F.lower(F.coalesce(F.nullif(text("label"), F.lit("")), F.lit("object"))).alias("label"), F.lower(text("distinctive")).alias("distinctive"),
        F.nullif(text("vehicle_id"), F.lit("")).alias("vehicle_id"), _given(sightings, "confidence", F.lit(None)).cast("double").alias("confidence"),
        F.nullif(text("claimed_id"), F.lit("")).alias("claimed_id"), _given(sightings, "is_new", F.lit(False)).alias("is_new"),
    ).where("kind in ('vehicle', 'object') or kind = 'plate' and plate <> ''")
    return _fold(rows, _Things, _THINGS)


def cards_of(folded: DataFrame) -> DataFrame:
    """The cards of a fold with their global ids."""
    return folded.where("sighting_id is null").withColumn("id", F.concat_ws(":", "video_id", "local_id")).drop("sighting_id", "clip_index")


def assignments_of(folded: DataFrame) -> DataFrame:
    """``video_id, sighting_id, clip_index, local_id``: the card of each sighting."""
    kind = ["kind"] if "kind" in folded.columns else []
    return folded.where("sighting_id is not null").select("video_id", "sighting_id", "clip_index", *kind, "local_id")


def clips_of(folded: DataFrame) -> DataFrame:
    """``video_id, local_id, clip_index``: the clips in which each card was seen, once each."""
    return assignments_of(folded).select("video_id", "local_id", "clip_index").distinct()
