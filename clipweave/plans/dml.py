"""Audited corrections: update, create, link and merge, each first as a preview and then as a new graph.

Tables are replaced by lazy snapshots; nothing is written before a caller writes the returned graph.
A correction states who asked for what; without ``confirmed`` only the preview is returned. A node is named
by its id or, with its video, by its local id; vehicles and plates also by the plate's text, objects by
their label. A name that means none or several is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import parse_ms
from ..functions.text import ROLES
from .blocks import PipelineError
from .graph import FootageGraph

#: What may be changed by kind.
CHANGEABLE = {
    "person": (
        "clothes", "race", "gender", "hair", "glasses", "shoes", "bag", "distinctive", "description", "signature",
        "is_cop", "role", "potential_suspect", "suspect_reason", "suspect_snapshot",
    ),
    "vehicle": ("color", "plate", "analysis"),
    "event": ("type", "title", "summary", "analysis", "start_timestamp", "end_timestamp", "cell"),
    "object": ("label", "distinctive"),
    "plate": ("text",),
    "clip": ("summary",),
}
#: Which kinds an edge may connect.
LINKS = {
    "involves": (("event", "person"), ("event", "vehicle"), ("event", "object")),
    "contains": (("clip", "person"), ("clip", "vehicle"), ("clip", "object"), ("clip", "plate"), ("clip", "event")),
    "has_person": (("video", "person"),),
    "has_vehicle": (("video", "vehicle"),),
    "has_object": (("video", "object"),),
    "has_plate": (("video", "plate"), ("vehicle", "plate")),
    "continues": (("event", "event"),),
    "instance_of": (("event", "event_type"),),
}
#: Kinds that are created and merged, and the least letters of a request.
CREATABLE, MERGEABLE = ("person", "vehicle", "event", "object", "plate"), ("person", "vehicle", "object", "plate")
LEAST_REQUEST = 8
#: Texts of a yes, a no and neither.
SAID = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False, "unknown": None, "none": None, "": None}


class CorrectionError(ValueError):
    """A correction that may not be made."""


@dataclass(frozen=True)
class Correction:
    """What a correction would change, and the graph after it (``None`` unless confirmed)."""

    preview: dict
    graph: FootageGraph | None


@dataclass(frozen=True)
class _Edge:
    name: str
    src_kind: str
    src: str
    dst_kind: str
    dst: str
    role: str | None = None


@dataclass(frozen=True)
class Also:
    """What a correction of a node links beside it: its clip, and of an event the participants and the event before it."""

    clip: str = ""
    person: str = ""
    role: str = ""
    vehicle: str = ""
    object: str = ""
    continues_from: str = ""


@dataclass
class _Work:
    """A graph under correction: edges and nodes are put in with the same note."""

    graph: FootageGraph
    note: str
    at: str
    edges: list[_Edge] = field(default_factory=list)

    def put(self, edge: _Edge) -> None:
        g = self.graph
        row = g.spark.createDataFrame(
            [(edge.src, edge.src_kind, edge.dst, edge.dst_kind, edge.role, self.note, self.at)],
            "src_id string, src_kind string, dst_id string, dst_kind string, role string, correction_note string, corrected_at string",
        )
        here = (F.col("src_id") == edge.src) & (F.col("dst_id") == edge.dst)
        old = g.edge(edge.name)
        # The same edge again is one edge, with the last note and role.
        kept = old.where(~here)
        fresh = row if edge.role else old.where(here).agg(F.max("role").alias("_r")).crossJoin(F.broadcast(row)).withColumn("role", F.coalesce("role", "_r")).drop("_r")
        self.graph = g.with_edge(edge.name, kept.unionByName(fresh, allowMissingColumns=True))

    def change(self, kind: str, node_id: str, values: dict[str, object], stamp: bool = True) -> None:
        df = self.graph.node(kind)
        mine, types = F.col("id") == node_id, dict(df.dtypes)
        told = values | ({"correction_note": self.note, "corrected_at": self.at} if stamp else {})
        cells = {k: F.when(mine, (v if isinstance(v, Column) else F.lit(v)).cast(types[k])).otherwise(F.col(k)) for k, v in told.items() if k in types}
        self.graph = self.graph.with_node(kind, df.withColumns(cells))

    def add(self, kind: str, values: dict) -> None:
        """A new node; a node of the same id is left alone."""
        df = self.graph.node(kind)
        told = values | {"correction_note": self.note, "corrected_at": self.at}
        row = self.graph.spark.range(1).select(*[F.lit(told.get(c)).cast(t).alias(c) for c, t in df.dtypes])
        self.graph = self.graph.with_node(kind, df.unionByName(row.join(df.where(F.col("id") == values["id"]).select("id"), "id", "left_anti")))


def _asked(request: str) -> str:
    if len((request or "").strip()) < LEAST_REQUEST:
        raise CorrectionError(f"state the request in at least {LEAST_REQUEST} letters")
    return request.strip()


def _meaning(kind: str, name: str, video_id: str) -> Column:
    """Which nodes of a kind a name means."""
    full = f"{video_id}:{name}" if video_id and not name.startswith(f"{video_id}:") else name
    out = F.col("id").isin(name, full)
    here = F.col("video_id") == video_id if video_id else F.lit(True)
    if kind in ("person", "object", "clip"):
        out = out | ((F.col("local_id") == name) & here)
    if kind == "object":
        out = out | ((F.lower("label") == name.lower()) & here)
    if kind in ("vehicle", "plate"):
        out = out | (F.upper("plate" if kind == "vehicle" else "text") == name.upper())
    return out


def locate(g: FootageGraph, kind: str, name: str, video_id: str = "") -> dict:
    """The one node that a name means."""
    if kind not in g.nodes:
        raise CorrectionError(f"unknown kind {kind!r}")
    name = (name or "").strip()
    if not name:
        raise CorrectionError(f"a {kind} needs a name")
    return _only(g.node(kind).where(_meaning(kind, name, video_id.strip())), f"{kind} {name!r}")


def locate_event(g: FootageGraph, event_type: str, start_timestamp: str = "", video_id: str = "") -> dict:
    """The one event of a type at a clock."""
    df, ms = g.node("event").where(F.col("type") == event_type), parse_ms(start_timestamp or None)
    if start_timestamp:
        at = F.col("start_timestamp") == (start_timestamp if ms is None else _clock(ms))
        df = df.where(at if ms is None else at | (F.col("seek_s") == ms / 1000))
    if video_id:
        df = df.where(F.col("video_id") == video_id)
    return _only(df, f"event of type {event_type!r} at {start_timestamp!r}")


def _only(df: DataFrame, what: str) -> dict:
    found = [r.asDict() for r in df.limit(2).collect()]
    if len(found) != 1:
        raise CorrectionError(f"{what} means {'no node' if not found else 'more than one node'}")
    return found[0]


def _clip_at(g: FootageGraph, video_id: str, clip: str, start_timestamp: str | None) -> dict | None:
    """The clip named, else the first one that covers a clock."""
    if clip:
        return locate(g, "clip", clip, video_id)
    ms = parse_ms(start_timestamp)
    if ms is None:
        return None
    start, end = (F.coalesce(f"{w}_ms", F.lit(None)) for w in ("start", "end"))
    covers = g.node("clip").where((F.col("video_id") == video_id) & F.lit(ms // 1000).between(F.floor(start / 1000), F.floor(end / 1000)))
    found = covers.orderBy("index", "id").limit(1).collect()
    if not found:
        raise CorrectionError(f"no clip of {video_id} covers {start_timestamp}")
    return found[0].asDict()


def _clock(ms: int) -> str:
    s = ms // 1000
    return f"{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60:02d}:{s % 60:02d}"


def _yes_or_no(name: str, value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text not in SAID:
        raise CorrectionError(f"{name} must be true, false or unknown")
    return SAID[text]


def clean_patch(kind: str, patch: dict) -> dict:
    """The changes in their stored form: allowed ones only, clocks and plates in their notation, role and officer in step."""
    given = {k: v for k, v in patch.items() if v is not None and v != ""}
    if unknown := sorted(set(given) - set(CHANGEABLE.get(kind, ()))):
        raise CorrectionError(f"{kind} has no changeable {', '.join(unknown)}")
    out = {k: _yes_or_no(k, v) if k in ("is_cop", "potential_suspect") else v for k, v in given.items()}
    if "cell" in out:
        if not re.fullmatch(r"\s*[+-]?\d+\s*", str(out["cell"])):
            raise CorrectionError("cell must be a number")
        out["cell"] = int(out["cell"])
    role = out.get("role")
    if role is not None and role not in ROLES:
        raise CorrectionError(f"role must be one of {', '.join(ROLES)}")
    implied = {"officer": ("is_cop", True), "civilian": ("is_cop", False), "potential_suspect": ("potential_suspect", True)}.get(role)
    if implied:
        out.setdefault(*implied)
    if out.get("is_cop") is True:
        out.setdefault("role", "officer")
    for end in ("start", "end"):
        if (c := f"{end}_timestamp") in out:
            ms = parse_ms(out[c])
            if ms is None:
                raise CorrectionError(f"{c} is no clock: {out[c]!r}")
            out |= {c: _clock(ms), f"{end}_ms": ms} | ({"seek_s": ms / 1000} if end == "start" else {})
    if "type" in out:
        out["type"] = str(out["type"]).strip().lower().replace(" ", "_")
        if not re.fullmatch(r"\w+", out["type"]):
            raise CorrectionError(f"no type id: {out['type']!r}")
    if "color" in out:
        out["color"] = str(out["color"]).strip().lower()
    for k in ("plate", "text"):
        if k in out:
            out[k] = str(out[k]).strip().upper()
    return out


def _links_beside(g: FootageGraph, kind: str, node_id: str, video_id: str, also: Also, clip: dict | None) -> list[_Edge]:
    """The edges that go with a node."""
    out = []
    if clip:
        out.append(_Edge("contains", "clip", clip["id"], kind, node_id))
    if kind in MERGEABLE and video_id:
        out.append(_Edge(f"has_{kind}", "video", video_id, kind, node_id))
    if kind != "event":
        return out
    if also.role and also.role not in ROLES:
        raise CorrectionError(f"role must be one of {', '.join(ROLES)}")
    for part in ("person", "vehicle", "object"):
        if name := getattr(also, part):
            role = (also.role or "unknown") if part == "person" else None
            out.append(_Edge("involves", "event", node_id, part, locate(g, part, name, video_id)["id"], role))
    if also.continues_from:
        out.append(_Edge("continues", "event", locate(g, "event", also.continues_from, video_id)["id"], "event", node_id))
    return out


def _type_edges(g: FootageGraph, event_id: str, event_type: str, clips: Iterable[str], video_id: str | None) -> list[_Edge]:
    out = [_Edge("instance_of", "event", event_id, "event_type", event_type)]
    out += [_Edge("has_type", "clip", c, "event_type", event_type) for c in clips]
    return out + ([_Edge("has_type", "video", video_id, "event_type", event_type)] if video_id else [])


def _apply(work: _Work, edges: list[_Edge]) -> None:
    """Puts edges in; who is linked as a potential suspect is flagged, unless an officer, and becomes the event's subject."""
    for e in edges:
        work.put(e)
        if e.name == "involves" and e.role == "potential_suspect":
            work.change("person", e.dst, {"potential_suspect": True, "role": F.when(F.col("role") == "officer", "officer").otherwise("potential_suspect")}, stamp=False)
            local = work.graph.node("person").where(F.col("id") == e.dst).first()["local_id"]
            named = F.array_union(F.coalesce("subject_ids", F.array().cast("array<string>")), F.array(F.lit(local)))
            work.change("event", e.src, {"subject_ids": named}, stamp=False)


def _ensure_type(work: _Work, event_type: str, title: str | None) -> None:
    work.add("event_type", {"id": event_type, "title": title or event_type.replace("_", " "), "name": title or event_type.replace("_", " ")})


def update(
    g: FootageGraph, kind: str, node_id: str, patch: dict, request: str, at: str, confirmed: bool = False, video_id: str = "", also: Also | dict | None = None
) -> Correction:
    """Changes fields of exactly one node and links what goes with it.

    A new event type replaces its ``instance_of`` and adds ``has_type`` of its clips; the old ``has_type`` stays.
    """
    also = Also(**also) if isinstance(also, dict) else also or Also()
    if kind not in CHANGEABLE:
        raise CorrectionError(f"a {kind} is not changed by hand")
    note, new = _asked(request), clean_patch(kind, patch)
    if not new and also == Also():
        raise CorrectionError("nothing to change")
    old = locate(g, kind, node_id, video_id)
    video = old.get("video_id") or ""
    clip = locate(g, "clip", also.clip, video) if also.clip else None
    edges = _links_beside(g, kind, old["id"], video if clip else "", replace(also, clip=""), clip) if kind != "event" else _links_beside(g, kind, old["id"], video, also, clip)
    preview = {"action": "update", "kind": kind, "id": old["id"], "request": note, "changes": {k: {"old": old.get(k), "new": v} for k, v in new.items()}, "edges": [vars(e) for e in edges]}
    if not confirmed:
        return Correction(preview, None)
    work = _Work(g, note, at)
    work.change(kind, old["id"], new)
    if kind == "event" and new.get("type", old.get("type")) != old.get("type"):
        _ensure_type(work, new["type"], new.get("title"))
        kept = work.graph.edge("instance_of").where(F.coalesce(F.col("src_id") != old["id"], F.lit(True)))
        work.graph = work.graph.with_edge("instance_of", kept)
        holders = g.edge("contains", "clip", "event", role=False).where(F.col("dst_id") == old["id"]).select("src_id").collect()
        clips = {r["src_id"] for r in holders} | ({old["clip_id"]} if old.get("clip_id") else set())
        edges = _type_edges(g, old["id"], new["type"], sorted(clips), None) + edges
    _apply(work, edges)
    return Correction(preview, work.graph)


def next_local_id(g: FootageGraph, kind: str, video_id: str) -> str:
    """``kind_n`` with the number after the largest one of the video, by local ids and the ends of ids."""
    number = lambda text: F.try_to_number(F.regexp_extract(text, rf"(?:^|:){kind}_([0-9]{{1,9}})$", 1), F.lit("9" * 9)).cast("int")
    df = g.node(kind, "id", "video_id", "local_id").where(F.col("video_id") == video_id)
    n = df.agg(F.max(F.greatest(number(F.coalesce("local_id", F.lit(""))), number(F.col("id"))))).first()[0]
    return f"{kind}_{(n or 0) + 1}"


def create(
    g: FootageGraph, kind: str, video_id: str, values: dict, request: str, at: str, clip_id: str | None = None, confirmed: bool = False, node_id: str = "", also: Also | dict | None = None
) -> Correction:
    """A new node of an existing video with its edges; an event needs a type, and a clip or a clock that a clip covers.

    What is not told has a default: people are civilians of unknown race and gender, events end with their clip.
    A vehicle with a plate comes with the plate.
    """
    note = _asked(request)
    also = Also(**also) if isinstance(also, dict) else also or Also()
    if kind not in CREATABLE:
        raise CorrectionError(f"a {kind} is not created by hand")
    locate(g, "video", video_id)
    new = clean_patch(kind, values)
    clip = _clip_at(g, video_id, clip_id or also.clip, new.get("start_timestamp") if kind == "event" else None)
    local = node_id.removeprefix(f"{video_id}:")
    if kind == "event":
        if not clip or not new.get("type"):
            raise CorrectionError("an event needs a clip and a type")
        made = {"id": f"{clip['id']}:{new['type']}:{new.get('start_ms', 0)}", "clip_id": clip["id"], "source_name": clip.get("source_name")}
        made |= {"title": new["type"].replace("_", " "), "end_timestamp": clip.get("end_timestamp"), "end_ms": clip.get("end_ms")}
    elif kind == "plate":
        text = new.get("text") or local.upper()
        if not text:
            raise CorrectionError("a plate needs its text")
        made = {"id": f"{video_id}:plate:{text}", "text": text}
    else:
        local = local or next_local_id(g, kind, video_id)
        made = {"id": f"{video_id}:{local}", "local_id": local}
    if kind == "person":
        made |= {"race": "unknown", "gender": "unknown", "role": "civilian", "potential_suspect": False}
    node = made | {"video_id": video_id, "source": "user"} | new
    edges = _links_beside(g, kind, node["id"], video_id, also, clip)
    extra: list[tuple[str, dict]] = []
    if kind == "event":
        edges = _type_edges(g, node["id"], new["type"], [clip["id"]], video_id) + edges
    elif kind == "vehicle" and new.get("plate"):
        plate = f"{video_id}:plate:{new['plate']}"
        extra.append(("plate", {"id": plate, "text": new["plate"], "video_id": video_id, "source": "user"}))
        edges += [_Edge("has_plate", "vehicle", node["id"], "plate", plate), *_links_beside(g, "plate", plate, video_id, Also(), clip)]
    preview = {"action": "create", "kind": kind, "request": note, "node": node, "edges": [vars(e) for e in edges]}
    if not confirmed:
        return Correction(preview, None)
    if g.node(kind).where(F.col("id") == node["id"]).limit(1).count():
        raise CorrectionError(f"{node['id']} exists")
    work = _Work(g, note, at)
    for label, told in [(kind, node), *extra]:
        work.add(label, told)
    if kind == "event":
        _ensure_type(work, new["type"], new.get("title"))
    _apply(work, edges)
    return Correction(preview, work.graph)


def link(
    g: FootageGraph, rel: str, src_kind: str, src_id: str, dst_kind: str, dst_id: str, request: str, at: str, role: str | None = None, confirmed: bool = False, video_id: str = ""
) -> Correction:
    """An edge between two existing nodes that may have it; the same edge twice is one. Roles are for people on events."""
    note, name = _asked(request), rel.strip().lower().replace("-", "_")
    if (src_kind, dst_kind) not in LINKS.get(name, ()):
        raise CorrectionError(f"no {rel} from {src_kind} to {dst_kind}")
    on_person = (name, dst_kind) == ("involves", "person")
    if role and role not in ROLES:
        raise CorrectionError(f"role must be one of {', '.join(ROLES)}")
    a, b = locate(g, src_kind, src_id, video_id), locate(g, dst_kind, dst_id, video_id)
    edge = _Edge(name, src_kind, a["id"], dst_kind, b["id"], (role or "unknown") if on_person else None)
    preview = {"action": "link", "request": note, "edge": name, "src": a["id"], "dst": b["id"], "role": edge.role}
    if not confirmed:
        return Correction(preview, None)
    work = _Work(g, note, at)
    work.put(edge)
    return Correction(preview, work.graph)


def involve(g: FootageGraph, event_id: str, request: str, at: str, also: Also | dict, confirmed: bool = False) -> Correction:
    """Participants of an event: links them, and flags who is linked as a potential suspect."""
    return update(g, "event", event_id, {}, request, at, confirmed, also=also)


def _empty(value: object) -> bool:
    return value is None or (isinstance(value, str) and value.strip().lower() in ("", "unknown"))


def _role_order(role: object) -> int:
    return ROLES.index(role) if role in ROLES else len(ROLES)


def _merged_values(kind: str, keep: dict, drop: dict, told: dict) -> dict:
    """What the kept node has after a merge: what was told, its own, and what it lacks from the other."""
    out = {k: drop[k] for k in CHANGEABLE[kind] if k in keep and _empty(keep[k]) and not _empty(drop.get(k))}
    if kind == "person":
        out["potential_suspect"] = bool(keep.get("potential_suspect")) or bool(drop.get("potential_suspect"))
        out["role"] = min((keep.get("role") or "unknown", drop.get("role") or "unknown"), key=_role_order)
    own = [x for x in (keep.get("local_id"),) if x]
    aliases = [*(keep.get("also_known_as") or []), *(drop.get("also_known_as") or []), drop.get("local_id") or drop["id"]]
    out["also_known_as"] = [x for x in dict.fromkeys(aliases) if x and x not in own]
    out["merged_ids"] = list(dict.fromkeys([*(keep.get("merged_ids") or []), drop["id"]]))
    return out | told


def _rewired(edges: DataFrame, keep_id: str, drop_id: str) -> DataFrame:
    """Edges of the dropped node at the kept one; of two that become one the stronger role stays."""
    touched = F.coalesce(F.col("src_id").isin(keep_id, drop_id) | F.col("dst_id").isin(keep_id, drop_id), F.lit(False))
    moved = edges.where(touched).withColumns({c: F.when(F.col(c) == drop_id, keep_id).otherwise(F.col(c)) for c in ("src_id", "dst_id")})
    rank = reduce(lambda out, i: F.when(F.col("role") == ROLES[i], i).otherwise(out), reversed(range(len(ROLES))), F.lit(len(ROLES)))
    rest = [c for c in moved.columns if c not in ("src_id", "dst_id")]
    one = moved.groupBy("src_id", "dst_id").agg(F.min_by(F.struct(*rest), F.struct(rank.alias("rank"), *rest)).alias("r")).select("src_id", "dst_id", "r.*")
    return edges.where(~touched).unionByName(one.where("src_id <> dst_id"))


def merge(
    g: FootageGraph, kind: str, keep_id: str, drop_id: str, request: str, at: str, confirmed: bool = False, changes: dict | None = None, video_id: str = ""
) -> Correction:
    """Two nodes of one kind and video become one: blanks are filled, edges moved, the stronger role kept."""
    note = _asked(request)
    if kind not in MERGEABLE:
        raise CorrectionError(f"{kind} nodes are not merged")
    keep, drop = locate(g, kind, keep_id, video_id), locate(g, kind, drop_id, video_id)
    if keep["id"] == drop["id"]:
        raise CorrectionError("a node is not merged with itself")
    if keep["video_id"] and drop["video_id"] and keep["video_id"] != drop["video_id"]:
        raise CorrectionError("identities are not merged across videos")
    values = _merged_values(kind, keep, drop, clean_patch(kind, changes or {}))
    preview = {"action": "merge", "kind": kind, "request": note, "keep": keep["id"], "drop": drop["id"], "filled": values, "moved": footprint(g, kind, drop["id"])}
    if not confirmed:
        return Correction(preview, None)
    work = _Work(g.with_node(kind, g.node(kind).where(F.coalesce(F.col("id") != drop["id"], F.lit(True)))), note, at)
    listed = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else v for k, v in values.items()}
    work.change(kind, keep["id"], listed)
    for rel in ("involves", "contains", f"has_{kind}", *(["has_plate"] if kind == "vehicle" else [])):
        work.graph = work.graph.with_edge(rel, _rewired(work.graph.edge(rel), keep["id"], drop["id"]))
    if kind == "person" and drop.get("local_id") and keep.get("local_id"):
        swapped = F.array_distinct(F.transform("subject_ids", lambda x: F.when(x == drop["local_id"], F.lit(keep["local_id"])).otherwise(x)))
        e = work.graph.node("event")
        work.graph = work.graph.with_node("event", e.withColumn("subject_ids", F.when(F.col("video_id") == keep["video_id"], swapped).otherwise(F.col("subject_ids"))))
    return Correction(preview, work.graph)


def footprint(g: FootageGraph, kind: str, node_id: str) -> dict[str, list[str]]:
    """The ends of all edges of one node by relationship."""
    node = locate(g, kind, node_id)["id"]
    ends = [
        e.where((F.col("src_id") == node) | (F.col("dst_id") == node)).select(
            F.lit(rel).alias("rel"), F.when(F.col("src_id") == node, F.col("dst_id")).otherwise(F.col("src_id")).alias("x")
        )
        for rel, e in ((rel, g.edge(rel, role=False)) for rel in g.edges)
    ]
    found = reduce(DataFrame.unionAll, ends).groupBy("rel").agg(F.array_sort(F.collect_set("x")).alias("ends")).collect()
    return {r["rel"]: r["ends"] for r in sorted(found, key=lambda r: list(g.edges).index(r["rel"]))}


def write_counters(before: FootageGraph, after: FootageGraph) -> DataFrame:
    """``name, created, deleted, changed`` of every table that differs between two graphs, by id or by the ends of edges."""
    out = []
    for prefix, old, new, key in (("", before.nodes, after.nodes, ["id"]), ("edge_", before.edges, after.edges, ["src_id", "dst_id"])):
        for name in old:
            if old._makers[name] is new._makers[name]:
                continue
            a, b = old[name], new[name]
            shared = sorted(set(a.columns) & set(b.columns) - set(key))
            marked = lambda df, c, shared=shared, key=key: df.select(*key, F.xxhash64(*shared).alias(c))
            both = marked(a, "_old").join(marked(b, "_new"), key, "full")
            counts = {"created": F.col("_old").isNull(), "deleted": F.col("_new").isNull(), "changed": F.coalesce(F.col("_old") != F.col("_new"), F.lit(False))}
            out.append(both.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).select(F.lit(f"{prefix}{name}").alias("name"), *counts))
    none = before.spark.createDataFrame([], "name string, created bigint, deleted bigint, changed bigint")
    return reduce(DataFrame.unionByName, out, none).where("created + deleted + changed > 0")


__all__ = ["Also", "Correction", "CorrectionError", "PipelineError", "clean_patch", "create", "footprint", "involve", "link", "locate", "merge", "update", "write_counters"]
