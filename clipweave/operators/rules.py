"""Rule-based scoring of clips: keywords, signals, tags and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ordered_distinct
from ..functions.clock import format_clock, padded_clock
from ..functions.text import phrase_count
from ..session import BROADCAST_ROWS

#: Event types whose clips are looked at closely; labels of land, of water and those that are rare on a road.
KEY_EVENTS = (
    "arrest", "handcuffing", "physical_restraint", "loud_impact", "foot_pursuit", "vehicle_pursuit", "search_person", "search_vehicle",
    "miranda_warning", "verbal_escalation",
)
LAND = ("car", "truck", "bus", "motorcycle", "bicycle", "traffic light", "stop sign")
WATER = ("boat", "surfboard")
RARE_ON_ROAD = ("boat", "train", "airplane", "bird", "bench", "skis", "snowboard")
LOOKED_AT = ("knife", "cell phone", "backpack", "suitcase")
SIGNALS = ("loudness", "loud_impact", "loud_speech", "yelling", "repeated_commands")


def _listed(df: DataFrame) -> DataFrame:
    """A list that people keep (phrases, rules), checked to be one."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"a catalog of more than {BROADCAST_ROWS} rows")
    return df


def keyword_hits(clips: DataFrame, phrases: DataFrame, key: str = "id") -> DataFrame:
    """``key, definition, rank, phrase, count, start_ms`` of every phrase in a transcript, case aside.

    The phrase list is the small side of a nested loop join and is broadcast; a catalog of more phrases than
    ``BROADCAST_ROWS`` raises an error, as it would be a product of two large sides. The start is that of the first segment with the phrase, else of the clip.
    """
    have = clips.where(F.col("transcript").isNotNull() & (F.col("transcript") != ""))
    hit = have.join(F.broadcast(_listed(phrases)), F.contains(F.lower("transcript"), F.lower("phrase")))
    at = F.col("start_ms")
    if "transcript_segments" in clips.columns:
        said = F.filter("transcript_segments", lambda s: F.contains(F.lower(s["text"]), F.lower("phrase")))
        at = F.when(F.size(said) > 0, F.col("start_ms") + said[0]["start_ms"]).otherwise(at)
    return hit.select(key, "definition", "rank", "phrase", phrase_count(F.col("transcript"), F.col("phrase")).alias("count"), at.alias("start_ms"))


def candidates(signals: DataFrame, rules: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """``key, definition, rank, by`` of the definitions that a clip's keywords or signals support.

    A keyword is enough; signals count from 0.5 on, as many as the rule needs, unless an excluded one holds.
    """
    holds = F.map_from_arrays(F.array(*[F.lit(s) for s in SIGNALS]), F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) >= 0.5 for s in SIGNALS]))
    on = lambda name: F.coalesce(F.try_element_at("holds", name), F.lit(False))
    by_signal = (
        signals.select(key, holds.alias("holds"))
        .join(F.broadcast(_listed(rules.where("size(signals) > 0"))), how="cross")
        .where(F.size(F.filter("signals", on)) >= F.col("need"))
        .where(~F.exists("exclude", on))
        .select(key, "definition", "rank", F.lit("signal").alias("by"))
    )
    by_word = hits.groupBy(key, "definition").agg(F.min("rank").alias("rank")).withColumn("by", F.lit("keyword"))
    return by_word.unionByName(by_signal).groupBy(key, "definition").agg(F.min("rank").alias("rank"), F.min("by").alias("by"))


def local_events(clips: DataFrame, found: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """One event for each clip and supported definition, until the clip's end.

    By a keyword it starts with its first phrase in catalog order, by signals with the clip; only a loud
    impact starts where it was heard.
    """
    first = hits.groupBy(key, "definition").agg(F.min_by(F.struct("start_ms", "phrase"), "rank").alias("w"))
    heard = F.when(F.col("definition") == "loud_impact", F.col("impact_at_ms")) if "impact_at_ms" in clips.columns else F.lit(None).cast("int")
    at = clips.select(key, "video_id", "start_ms", "end_ms", *(["impact_at_ms"] if "impact_at_ms" in clips.columns else []))
    # Confidences, sources and modalities of the two kinds.
    word = F.col("by") == "keyword"
    evidence = F.struct(F.when(word, "transcript").otherwise("signal").alias("modality"), F.when(word, F.col("w.phrase")).otherwise(F.col("definition")).alias("value"))
    start = F.when(word, F.coalesce("w.start_ms", "start_ms")).otherwise(F.col("start_ms") + F.coalesce(heard, F.lit(0)))
    return (
        found.join(first, [key, "definition"], "left")
        .join(at, key)
        .select(
            key, "video_id", F.col("definition").alias("type"), "rank", start.alias("start_ms"), "end_ms", F.array(evidence).alias("evidence"),
            F.when(word, 0.7).otherwise(0.6).alias("confidence"), F.when(word, "keyword").otherwise("local_signals").alias("source"),
        )
        .withColumn("clock", format_clock(F.col("start_ms")))
        .withColumn("event_id", F.concat_ws(":", key, "type", "start_ms"))
    )


def evidence_lines(definition: Column, evidence: Column) -> Column:
    """``definition | modality | value`` of every piece of evidence that has a value."""
    told = F.filter(evidence, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return F.transform(told, lambda x: F.concat_ws(" | ", definition, F.coalesce(F.nullif(x["modality"], F.lit("")), F.lit("note")), x["value"]))


def is_key_clip(*names: Column) -> Column:
    """Whether a clip is looked at closely: by its sounds, its commands or the names of its events, keywords and candidates.

    ``loud_speech`` counts where there is no yelling.
    """
    holds = lambda cond: F.coalesce(cond, F.lit(False))
    key = F.array(*map(F.lit, KEY_EVENTS))
    out = (
        holds(F.col("loud_impact") >= 0.7)
        | holds(F.coalesce(F.nullif("yelling", F.lit(0.0)), "loud_speech") >= 0.7)
        | holds(F.col("repeated_commands") >= 2)
    )
    for told in names:
        out = out | holds(F.arrays_overlap(told, key))
    return out


def asks_model(key_clip: Column, events: Column, hits: Column) -> Column:
    """Whether a clip is worth a model's look: a key clip, or one with events, keywords, people or vehicles."""
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return key_clip | F.coalesce(F.size(events) > 0, F.lit(False)) | F.coalesce(F.size(hits) > 0, F.lit(False)) | some("person_count") | some("vehicle_count")


def scene_prior(entities: DataFrame) -> DataFrame:
    """``video_id, land, water, scene``: what was seen of each; ``land`` if there is some of it and not less than of water."""
    label = F.lower("label")
    return (
        entities.groupBy("video_id")
        .agg(F.count_if(label.isin(*LAND)).alias("land"), F.count_if(label.isin(*WATER)).alias("water"))
        .withColumn("scene", F.when((F.col("land") >= F.col("water")) & (F.col("land") > 0), "land").otherwise("other"))
    )


def denoise(entities: DataFrame, scenes: DataFrame) -> DataFrame:
    """Entities without what belongs to water or is rare on a road, in scenes on land, and without unsure objects."""
    odd = F.coalesce(F.lower("label").isin(*RARE_ON_ROAD, *WATER), F.lit(False)) & (F.coalesce("scene", F.lit("other")) == "land")
    unsure = F.coalesce((F.col("type") == "object") & (F.coalesce("confidence", F.lit(0.0)) < 0.45), F.lit(False))
    return entities.join(scenes.select("video_id", "scene"), "video_id", "left").where(~odd & ~unsure).drop("scene")


def inventory(entities: DataFrame, key: str = "clip_id") -> DataFrame:
    """The surest sighting of each type and label of a clip, named ``type_n`` by confidence."""
    best = entities.groupBy(key, "type", "label").agg(F.max_by(F.struct("confidence", "cell_index", "box"), F.struct("confidence", -F.col("cell_index"))).alias("b")).select(key, "type", "label", "b.*")
    place = F.row_number().over(Window.partitionBy(key, "type").orderBy(F.desc("confidence"), "cell_index", "label"))
    return best.withColumn("local_id", F.concat_ws("_", "type", place.cast("string")))


def best_cell(entities: DataFrame, key: str = "clip_id") -> DataFrame:
    """The picture cell with the most people, then the most confidence; the first of equal ones."""
    cells = entities.groupBy(key, "cell_index").agg((F.count_if(F.col("type") == "person") + F.sum("confidence") / 10).alias("score"))
    return cells.groupBy(key).agg(F.max_by("cell_index", F.struct("score", -F.col("cell_index"))).alias("best_cell"))


def clip_counts(entities: DataFrame, key: str = "clip_id") -> DataFrame:
    """Counts by type, sorted labels and clothes, and whether a closer look is needed."""
    return entities.groupBy(key).agg(
        *[F.count_if(F.col("type") == t).alias(f"{t}_count") for t in ("person", "vehicle", "object")],
        F.array_sort(F.collect_set(F.when(F.col("type").isin("vehicle", "object"), F.col("label")))).alias("object_labels"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "person", F.nullif("clothes", F.lit(""))))).alias("clothing_colors"),
        F.coalesce(
            F.bool_or(
                F.col("type").isin("person", "vehicle")
                | ((F.col("type") == "object") & (F.coalesce("confidence", F.lit(0.0)) < 0.5))
                | ((F.col("type") == "object") & F.col("label").isin(*LOOKED_AT))
            ),
            F.lit(False),
        ).alias("needs_vision"),
    )


def local_tags(labels: Column, definitions: Column, event_types: Column) -> Column:
    """Tags of a clip in order: speech, what is there, labels, sounds, definitions, event types; each once."""
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    speech = F.when(F.trim(F.coalesce("transcript", F.lit(""))) != "", "speech").otherwise("no_speech")
    return ordered_distinct(
        F.array(speech),
        *[flag(F.col(f"{t}_count") > 0, t) for t in ("person", "vehicle", "object")],
        flag(F.col("needs_vision"), "needs_vision"),
        labels,
        flag(F.col("loud_impact") >= 0.5, "loud_impact"),
        flag(F.col("yelling") >= 0.5, "yelling"),
        flag(F.col("repeated_commands") >= 2, "repeated_commands"),
        definitions,
        event_types,
    )


def local_summary(labels: Column, people: Column, tags: Column) -> Column:
    """A clip in one line: its clocks, what is visible, who, what is said (400 letters at most) and its tags."""
    said = F.trim(F.coalesce("transcript", F.lit("")))
    speech = F.when(said != "", F.concat(F.lit("Speech: "), F.substring(said, 1, 400), F.when(F.length(said) > 400, "…").otherwise(""))).otherwise("No speech transcribed.")
    listed = lambda head, arr, sep, tail: F.when(F.size(arr) > 0, F.concat(F.lit(head), F.array_join(arr, sep), F.lit(tail))).otherwise("")
    return F.concat(
        F.lit("Clip "), F.col("id"), F.lit(" ("), padded_clock(F.col("start_ms")), F.lit("–"), padded_clock(F.col("end_ms")), F.lit("). Visible: "),
        F.col("person_count").cast("string"), F.lit(" person(s), "), F.col("vehicle_count").cast("string"), F.lit(" vehicle(s), "),
        F.col("object_count").cast("string"), F.lit(" object(s)"), listed(" (", labels, ", ", ")"), F.lit("."),
        listed(" People: ", F.slice(people, 1, 4), " ", "."), F.lit(" "), speech, listed(" Tags: ", tags, ", ", "."),
    )


def person_line(person: Column) -> Column:
    """A person of a clip in one line: the signature, else the clothes, else the description."""
    told = [F.nullif(F.trim(F.coalesce(person[k], F.lit(""))), F.lit("")) for k in ("signature", "clothes", "description")]
    return F.concat(person["id"], F.lit(": "), F.coalesce(*told, F.lit("person")))
