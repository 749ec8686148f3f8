"""The ready-made questions over the footage graph; each returns a lazy DataFrame in a fixed order.

The columns and their names are those of the question; ``event_id``, ``id`` and the like are added where
rows would have no key without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import parse_seconds
from ..operators.windows import event_chains
from .blocks import Assembly, contains, count_of, one_of
from .graph import FootageGraph

#: Events that ``event_at_time`` gives.
NEAREST = 8


def _events(g: FootageGraph, event_type: str = "", video_id: str = "") -> Assembly:
    s = Assembly(g)
    s.source("e", "event")
    for column, wanted in (("type", event_type), ("video_id", video_id)):
        if wanted.strip():
            s.where(s.col("e", column) == wanted.strip())
    return s


def _event_rows(s: Assembly, *more: Column, topics: bool = False) -> DataFrame:
    """Events with their clip and people, by video and time."""
    s.with_clip()
    s.with_people()
    keys, sets = [*s.event_columns(), *more, *s.clip_columns()], [s.people()]
    if topics:
        s.with_topics()
        sets.append(F.array_sort(F.collect_set("t_id")).alias("topics"))
    s.then(lambda df: df.groupBy(*keys).agg(*sets).orderBy(F.asc_nulls_last("video_id"), F.asc_nulls_last("seek_s"), "event_id"))
    return s.run()


def count_events(g: FootageGraph, event_type: str = "", video_id: str = "") -> DataFrame:
    s = _events(g, event_type, video_id)
    keys = s.named("e", event_type="type")
    s.then(lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type"))
    return s.run()


def events_in_timeframe(g: FootageGraph, start_s: float, end_s: float, event_type: str = "", video_id: str = "") -> DataFrame:
    s = _events(g, event_type, video_id)
    s.where(s.col("e", "seek_s").between(start_s, end_s))
    return _event_rows(s, *s.plain("e", "subject_ids"))


def events_by_type(g: FootageGraph, event_type: str, video_id: str = "") -> DataFrame:
    return _event_rows(_events(g, event_type, video_id))


def events_by_types(g: FootageGraph, types: list[str], video_id: str = "") -> DataFrame:
    s = _events(g, video_id=video_id)
    s.where(s.col("e", "type").isin(list(types)))
    return _event_rows(s, topics=True)


def event_at_time(g: FootageGraph, seek_s: float, event_type: str = "") -> DataFrame:
    """The nearest events; the limit comes before the join, so only they are joined."""
    s = _events(g, event_type)
    at, event_id = s.col("e", "seek_s"), s.col("e", "id")
    delta = F.abs(at - seek_s)
    s.then(lambda df: df.where(at.isNotNull()).withColumn("seconds_from_query", delta).orderBy("seconds_from_query", event_id).limit(NEAREST))
    s.with_people()
    keys, people = [*s.event_columns(), F.col("seconds_from_query")], s.people()
    s.then(lambda df: df.groupBy(*keys).agg(people).drop("source_name").orderBy("seconds_from_query", "event_id"))
    return s.run()


def event_participants(g: FootageGraph, event_type: str, start_timestamp: str) -> DataFrame:
    """People, vehicles and objects of an event; an event without any keeps one row of nulls."""
    of = {
        "person": {"local_id": "name", "clothes": "clothes", "description": "description", "distinctive": "distinctive"},
        "vehicle": {"local_id": "name", "color": "color", "plate": "plate"},
        "object": {"local_id": "name", "label": "label", "distinctive": "distinctive"},
    }
    told = ("clothes", "description", "plate", "distinctive")
    nodes = None
    for kind, columns in of.items():
        n = g.node(kind, "id", *columns)
        name = F.coalesce("local_id", *[c for c in ("label", "color") if c in n.columns])
        more = [F.col(c) if c in n.columns else F.lit(None).cast("string").alias(c) for c in told]
        part = n.select(F.col("id").alias("participant_id"), F.lit(kind).alias("kind"), name.alias("name"), *more)
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = g.edge("involves").select(F.col("src_id").alias("_e"), F.col("dst_id").alias("participant_id"), "role").distinct().join(nodes, "participant_id")
    s = _events(g, event_type)
    s.where(s.col("e", "start_timestamp") == start_timestamp.strip())
    s.join(lambda: edges, s.col("e", "id"), "_e")
    keys = [*s.named("e", event_id="id", video_id="video_id", event_type="type"), *s.clocks("e"), *s.plain("e", "summary")]
    s.then(lambda df: df.select(*keys, "kind", "participant_id", "name", "role", *told).orderBy("event_id", "kind", "participant_id"))
    return s.run()


def find_people(g: FootageGraph, clothes: str = "", role: str = "", is_cop: bool | None = None, potential_suspect: bool | None = None) -> DataFrame:
    told = ("role", "is_cop", "potential_suspect", "clothes", "race", "gender", "description", "suspect_snapshot", "suspect_at", "suspect_event")
    p = g.node("person", "id", "video_id", "local_id", *told)
    if clothes:
        p = p.where(contains(F.col("clothes"), clothes))
    if role:
        p = p.where(F.col("role") == role)
    for name, said in (("is_cop", is_cop), ("potential_suspect", potential_suspect)):
        if said is not None:
            p = p.where(F.col(name) == said)
    return p.select("id", "video_id", F.col("local_id").alias("person_id"), *told).orderBy("person_id", "id")


def find_potential_suspects(g: FootageGraph) -> DataFrame:
    """Flagged people with the events that list them in that role; the role is part of the join."""
    told = {"clothes": "clothes", "description": "description", "suspect_snapshot": "snapshot", "suspect_reason": "reason", "suspect_at": "first_tagged_at", "suspect_event": "first_tagged_event"}
    p = g.node("person", "id", "video_id", "local_id", "potential_suspect", *told).where("potential_suspect")
    roles = g.edge("involves", "event", "person").where("role = 'potential_suspect'").select(F.col("src_id").alias("_e"), "dst_id").distinct()
    e = Assembly(g)
    e.source("e", "event")
    of_event = [*e.named("e", _e="id", type="type"), e.clock("e", "start").alias("start_timestamp")]
    e.then(lambda df: df.select(*of_event))
    events = roles.join(e.run(), "_e").groupBy("dst_id").agg(F.collect_set(F.struct("type", "start_timestamp")).alias("events"))
    return (
        p.join(events, p["id"] == F.col("dst_id"), "left")
        .select("id", "video_id", F.col("local_id").alias("person_id"), *[F.col(c).alias(n) for c, n in told.items()], "events")
        .orderBy("video_id", "id")
    )


def person_timeline(g: FootageGraph, person_id: str) -> DataFrame:
    s = _events(g)
    s.with_people("inner")
    s.where(one_of(s, person_id.strip()))
    out = [
        *s.named("p", person="id", person_id="local_id", person_role="role"), *s.named("e", event_id="id", video_id="video_id", event_type="type"),
        *s.clocks("e"), *s.plain("e", "seek_s", "summary"), *s.named("p", involves_role="edge_role"),
    ]
    s.then(lambda df: df.select(*out).orderBy(F.asc_nulls_last("seek_s"), "event_id", "person"))
    return s.run()


def find_vehicles(g: FootageGraph, color: str = "", plate: str = "") -> DataFrame:
    v = g.node("vehicle", "id", "video_id", "color", "plate", "analysis")
    if color:
        v = v.where(contains(F.col("color"), color))
    if plate:
        v = v.where(F.contains(F.col("plate"), F.lit(plate.upper())))
    texts = g.edge("has_plate", "vehicle", "plate", role=False).join(g.node("plate", "id", "text").select(F.col("id").alias("dst_id"), "text"), "dst_id")
    texts = texts.groupBy("src_id").agg(F.array_sort(F.collect_list("text")).alias("plates"))
    return (
        v.join(texts, v["id"] == F.col("src_id"), "left")
        .select(F.col("id").alias("vehicle_id"), "video_id", "color", "plate", "analysis", F.coalesce("plates", F.array().cast("array<string>")).alias("plates"))
        .orderBy("video_id", "vehicle_id")
    )


def find_plates(g: FootageGraph, text: str = "") -> DataFrame:
    pl = g.node("plate", "id", "text", "confidence", "video_id")
    if text:
        pl = pl.where(F.contains("text", F.lit(text.upper())))
    owners = g.edge("has_plate", "vehicle", "plate", role=False)
    v = g.node("vehicle", "id", "color").select(F.col("id").alias("src_id"), F.col("color").alias("vehicle_color"))
    owned = owners.join(v, "src_id").withColumnRenamed("dst_id", "id")
    return pl.join(owned, "id", "left").select(F.col("text").alias("plate"), "confidence", "video_id", "vehicle_color", F.col("src_id").alias("vehicle_id")).orderBy("video_id", "plate", "vehicle_id")


def find_objects(g: FootageGraph, label: str = "") -> DataFrame:
    o = g.node("object", "id", "video_id", "local_id", "label", "distinctive")
    o = o.where(contains(F.col("label"), label)) if label else o
    return o.select("id", "video_id", F.col("local_id").alias("object_id"), "label", "distinctive").orderBy("video_id", "id")


def object_appearances(g: FootageGraph, label: str) -> DataFrame:
    """Clips and events of each object; each branch is aggregated before the join, so they do not multiply."""
    wanted = label.strip()
    o = g.node("object", "id", "video_id", "local_id", "label", "distinctive").where(contains(F.col("label"), wanted) | (F.col("local_id") == wanted))
    names = g.node("clip", "id", "local_id").select(F.col("id").alias("src_id"), "local_id")
    clips = g.edge("contains", "clip", "object", role=False).join(names, "src_id").groupBy(F.col("dst_id").alias("_c")).agg(F.array_sort(F.collect_set("local_id")).alias("clips"))
    e = Assembly(g)
    e.source("e", "event")
    of_event = [*e.named("e", src_id="id", type="type"), e.clock("e", "start").alias("start_timestamp")]
    e.then(lambda df: df.select(*of_event))
    events = g.edge("involves", "event", "object", role=False).join(e.run(), "src_id")
    events = events.groupBy(F.col("dst_id").alias("_e")).agg(F.collect_set(F.struct("type", "start_timestamp")).alias("events"))
    return (
        o.join(clips, F.col("id") == F.col("_c"), "left")
        .join(events, F.col("id") == F.col("_e"), "left")
        .select("id", "video_id", F.col("local_id").alias("object_id"), "label", "distinctive", "clips", "events")
        .orderBy("video_id", "id")
    )


def _clips(g: FootageGraph) -> Assembly:
    s = Assembly(g)
    s.source("c", "clip")
    return s


def _clip_rows(s: Assembly, *order: str, more: tuple[str, ...] = ("summary",)) -> DataFrame:
    out = [*s.plain("c", "id", "video_id"), *s.named("c", clip="local_id", index="index"), *s.clocks("c"), *s.plain("c", *more, "clip_uri", "splice_uri", "tagged_splice_uri")]
    s.then(lambda df: df.select(*out).orderBy(*[F.asc_nulls_last(c) for c in order], "id"))
    return s.run()


def search_transcript(g: FootageGraph, phrase: str) -> DataFrame:
    s = _clips(g)
    s.where(contains(s.col("c", "transcript"), phrase.strip()))
    return _clip_rows(s, "index")


def clip_at_timestamp(g: FootageGraph, timestamp: str, video_id: str = "") -> DataFrame:
    """Clips that cover a clock, both ends included, so an overlap gives two per video."""
    ms = int((parse_seconds(timestamp) or 0) * 1000)
    s = _clips(g)
    s.where(F.lit(ms).between(s.col("c", "start_ms"), s.col("c", "end_ms")))
    if video_id:
        s.where(s.col("c", "video_id") == video_id)
    return _clip_rows(s, "video_id", "index")


def clip_attachments(g: FootageGraph, video_id: str = "", clip: str = "") -> DataFrame:
    s = _clips(g)
    if video_id.strip():
        s.where(s.col("c", "video_id") == video_id.strip())
    if clip.strip():
        s.where((s.col("c", "local_id") == clip.strip()) | F.endswith(s.col("c", "id"), F.lit(clip.strip())))
    return _clip_rows(s, "video_id", "index", more=("audio_uri",))


def event_chain(g: FootageGraph, event_type: str = "") -> DataFrame:
    """Every pair of an event and one that continues it over one or more steps, with the number of steps.

    Only the wanted starts are followed; the pairs of other events are never made.
    """
    s = _events(g, event_type)
    start = [*s.named("e", start_id="id", video_id="video_id", event_type="type"), s.clock("e", "start").alias("chain_start"), *s.plain("e", "seek_s")]
    s.then(lambda df: df.select(*start))
    starts = s.run()
    ends = Assembly(g)
    ends.source("e", "event")
    end = [*ends.named("e", end_id="id"), ends.clock("e", "start").alias("chain_end")]
    ends.then(lambda df: df.select(*end))
    pairs = event_chains(g.edge("continues", role=False), starts.select("start_id") if event_type else None)
    out = pairs.join(starts, "start_id").join(ends.run(), "end_id")
    return out.select("video_id", "event_type", "start_id", "end_id", "chain_start", "chain_end", "hops", "seek_s").orderBy(F.asc_nulls_last("seek_s"), "start_id", "hops", "end_id").drop("seek_s")


def list_videos(g: FootageGraph) -> DataFrame:
    v = g.node("video", "id", "source_name", "duration_s", "clip_count", "status").withColumnRenamed("id", "video_id")
    for edge, kind, name in (("has_person", "person", "people"), ("has_vehicle", "vehicle", "vehicles")):
        v = v.join(count_of(g, edge, kind, name), "video_id", "left").fillna({name: 0})
    return v.orderBy("video_id")


def inventory(g: FootageGraph) -> DataFrame:
    return g.inventory().orderBy(F.desc("n"), "label")
