"""The footage graph: a node table per label and an edge table per relationship.

A table is a DataFrame or a function of the columns asked for. Tables that are derived from rows with
repetitions are such functions, so only the columns of a question are read, grouped and shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import format_clock, moment
from ..functions.text import normal_plate, slug, strip
from ..operators.links import link_names
from ..operators.roles import SUBJECT_EVENTS, event_role, first_subjects, tag_people
from ..sources.tables import table

#: Columns that each label has at least; missing ones are added as nulls.
NODES: dict[str, str] = {
    "video": "id string, source_name string, source_path string, original_uri string, duration_s double, fps double, width int, height int, size_bytes bigint, ingested_at string, clip_count int, status string",
    "clip": "id string, video_id string, local_id string, index int, start_ms bigint, end_ms bigint, start_timestamp string, end_timestamp string, transcript string, summary string, summary_source string, clip_uri string, splice_uri string, tagged_splice_uri string, audio_uri string",
    "event": "id string, video_id string, source_name string, clip_id string, type string, title string, summary string, analysis string, start_ms bigint, end_ms bigint, start_timestamp string, end_timestamp string, seek_s double, cell int, confidence double, source string, evidence string, subject_ids array<string>",
    "person": "id string, video_id string, local_id string, race string, gender string, hair string, glasses string, clothes string, shoes string, bag string, distinctive string, signature string, description string, role string, is_cop boolean, potential_suspect boolean, suspect_reason string, suspect_at string, suspect_event string, suspect_snapshot string, also_known_as array<string>, merged_ids array<string>",
    "vehicle": "id string, video_id string, local_id string, color string, plate string, analysis string, also_known_as array<string>, merged_ids array<string>",
    "object": "id string, video_id string, local_id string, label string, distinctive string, also_known_as array<string>, merged_ids array<string>",
    "plate": "id string, text string, video_id string, source string, confidence double",
    "event_type": "id string, title string, name string, description string, aliases array<string>, topics array<string>",
    "topic": "id string, title string, description string, aliases array<string>",
}
_EDGE = "src_id string, src_kind string, dst_id string, dst_kind string, role string"
EDGES: tuple[str, ...] = (
    "contains", "starts_at", "next", "has_person", "has_vehicle", "has_object", "has_plate", "has_type", "instance_of", "in_topic", "bundles", "continues", "involves",
)
AUDIT = "correction_note string, corrected_at string"


Maker = Callable[[tuple[str, ...] | None], DataFrame]


def conform(df: DataFrame, schema: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with at least the columns of ``schema``, in their types, and its further ones; or with those of ``only``."""
    wanted = dict(c.strip().split(" ", 1) for c in schema.split(", ") if c)
    have = set(df.columns)
    names = [*wanted, *(c for c in df.columns if c not in wanted)] if only is None else only
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(wanted[n]).alias(n) if n in wanted else F.col(n) for n in names])


class Tables(Mapping):
    """Tables by name, each built when asked for, so a question plans only what it reads."""

    def __init__(self, makers: Mapping[str, DataFrame | Maker]):
        self._makers = dict(makers._makers if isinstance(makers, Tables) else makers)

    def pick(self, name: str, columns: tuple[str, ...] | None) -> DataFrame:
        made = self._makers[name]
        if isinstance(made, DataFrame):
            return made if columns is None else made.select(*columns)
        return made(columns)

    def __getitem__(self, name: str) -> DataFrame:
        return self.pick(name, None)

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def plus(self, name: str, df: DataFrame) -> Tables:
        return Tables(self._makers | {name: df})


@dataclass(frozen=True)
class FootageGraph:
    """Node and edge tables; every operator returns a new graph and leaves this one as it is."""

    nodes: Tables
    edges: Tables
    spark: SparkSession

    @staticmethod
    def of(spark: SparkSession, nodes: Mapping, edges: Mapping) -> FootageGraph:
        """A graph of the given tables (DataFrames, or functions of the columns asked for); missing ones are empty."""

        def table_of(made, schema: str) -> Maker:
            full = f"{schema}, {AUDIT}"

            def make(columns: tuple[str, ...] | None) -> DataFrame:
                df = spark.range(0).drop("id") if made is None else made if isinstance(made, DataFrame) else made(columns)
                return conform(df, full, columns)

            return make

        get = lambda tables, k: (tables._makers if isinstance(tables, Tables) else tables).get(k)
        return FootageGraph(
            Tables({k: table_of(get(nodes, k), s) for k, s in NODES.items()}), Tables({k: table_of(get(edges, k), _EDGE) for k in EDGES}), spark
        )

    def node(self, label: str, *columns: str) -> DataFrame:
        """The nodes of a label, with all columns or those named, each once."""
        return self.nodes.pick(label, tuple(dict.fromkeys(columns)) or None)

    def edge(self, name: str, src_kind: str | None = None, dst_kind: str | None = None, role: bool = True) -> DataFrame:
        """The edges of a name between two kinds; without ``role`` only ``src_id, dst_id``, each pair once."""
        kinds = [(c, k) for c, k in (("src_kind", src_kind), ("dst_kind", dst_kind)) if k]
        df = self.edges[name] if role else self.edges.pick(name, ("src_id", "dst_id", *(c for c, _ in kinds)))
        for c, k in kinds:
            df = df.where((F.col(c) == k) | F.col(c).isNull())
        return df if role else df.select("src_id", "dst_id").distinct()

    def with_node(self, label: str, df: DataFrame) -> FootageGraph:
        return replace(self, nodes=self.nodes.plus(label, conform(df, f"{NODES[label]}, {AUDIT}")))

    def with_edge(self, name: str, df: DataFrame) -> FootageGraph:
        return replace(self, edges=self.edges.plus(name, conform(df, f"{_EDGE}, {AUDIT}")))

    def inventory(self) -> DataFrame:
        """``label, n`` of every label that has nodes."""
        counts = [self.node(k, "id").agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k in self.nodes]
        return reduce(DataFrame.unionAll, counts).where("n > 0")

    def duplicate_ids(self) -> DataFrame:
        """``label, id, n`` of ids that more than one node of a label has; empty in a sound graph."""
        found = [df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(k).alias("label"), "id", "n") for k, df in self.nodes.items()]
        return reduce(DataFrame.unionAll, found)

    def replace_videos(self, other: FootageGraph, video_ids: list[str]) -> FootageGraph:
        """This graph with everything of some videos replaced by what ``other`` holds of them; idempotent."""
        nodes = {}
        for k, df in self.nodes.items():
            if k in ("event_type", "topic"):
                fresh = other.nodes[k]
                nodes[k] = fresh.unionByName(df.join(fresh.select("id"), "id", "left_anti"), allowMissingColumns=True)
            else:
                key = "id" if k == "video" else "video_id"
                kept = df.where(~F.col(key).isin(video_ids) | F.col(key).isNull())
                nodes[k] = kept.unionByName(other.nodes[k].where(F.col(key).isin(video_ids)), allowMissingColumns=True)
        edges = {}
        for k, df in self.edges.items():
            if k in ("in_topic", "bundles"):
                edges[k] = df.unionByName(other.edges[k], allowMissingColumns=True).dropDuplicates(["src_id", "dst_id"])
                continue
            # The ids of a video's nodes begin with its id.
            owner = F.regexp_extract("src_id", "^[^:]*", 0)
            edges[k] = df.where(~owner.isin(video_ids)).unionByName(other.edges[k].where(owner.isin(video_ids)), allowMissingColumns=True)
        return FootageGraph(Tables(nodes), Tables(edges), self.spark)


def last_write(rows: DataFrame, key: str, *order: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The last row of each key by ``order``: what remains of repeated upserts.

    Each column is an aggregate of its own, so those that are not used are neither read nor shuffled. Rows
    that share the last order should be equal; where they differ, the greater value of a column stays.
    """
    wanted = [c for c in (columns or rows.columns) if c != key]
    last = [F.max_by(c, F.struct(*order, c)).alias(c) for c in wanted]
    kept = rows.where(F.col(key).isNotNull())
    return kept.groupBy(key).agg(*last) if last else kept.select(key).distinct()


def one_of_copies(rows: DataFrame, key: str, varying: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row of each key, whose rows are equal in everything but ``varying``, of which the greatest stays.

    The equal columns are grouping columns, so filters on them reach the scan. ``duplicate_ids`` of the graph
    shows keys whose rows differ elsewhere.
    """
    wanted = [c for c in (columns or rows.columns) if c != key]
    same, most = [c for c in wanted if c not in varying], [c for c in wanted if c in varying]
    kept = rows.where(F.col(key).isNotNull())
    if not most:
        return kept.select(key, *same).distinct()
    return kept.groupBy(key, *same).agg(*[F.max(c).alias(c) for c in most])


#: Clips of a video that one window orders.
STRETCH = 1024


def clip_chain(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``starts_at`` (video to first clip) and ``next`` (clip to clip) edges in playback order.

    A video is ordered by stretches of its clip numbers, so a long one is spread over tasks; the last clip of a stretch
    is followed by the first of the next. Clips without a number come first.
    """
    order = ("index", "start_ms", "id")
    rows = clips.select("id", "video_id", *[c for c in order if c != "id"]).withColumn("stretch", F.floor(F.coalesce("index", F.lit(-1)) / STRETCH))
    within = Window.partitionBy("video_id", "stretch").orderBy(*order)
    placed = rows.select("id", "video_id", "stretch", F.lead("id").over(within).alias("following"))
    heads = rows.groupBy("video_id", "stretch").agg(F.min_by("id", F.struct(*order)).alias("head"))
    along = Window.partitionBy("video_id").orderBy("stretch")
    heads = heads.select("video_id", "stretch", "head", F.lead("head").over(along).alias("after"), F.row_number().over(along).alias("place"))
    inner = placed.where("following is not null").select(F.col("id").alias("src_id"), F.col("following").alias("dst_id"))
    last = placed.where("following is null").join(heads.where("after is not null"), ["video_id", "stretch"]).select(F.col("id").alias("src_id"), F.col("after").alias("dst_id"))
    first = heads.where("place = 1").select(F.col("video_id").alias("src_id"), F.col("head").alias("dst_id"))
    return first, inner.unionAll(last)


def _edge(df: DataFrame, src: Column, src_kind: str, dst: Column, dst_kind: str, *more: str) -> DataFrame:
    return df.select(
        src.alias("src_id"), F.lit(src_kind).alias("src_kind"), dst.alias("dst_id"), F.lit(dst_kind).alias("dst_kind"), F.lit(None).cast("string").alias("role"), *more
    ).where("src_id is not null and dst_id is not null").distinct()


def _name(said: Column) -> Column:
    """A name regardless of case and surrounding blanks."""
    return strip(F.lower(said))


def continues(events: DataFrame, links: DataFrame) -> DataFrame:
    """``continues`` edges from an event to one that continues it: as ``continues_from`` states and as users linked them.

    Names are read regardless of case and surrounding blanks, in ``continues_from`` also without the leading
    ``video_id:``; a name of no event links nothing, one of several ids that differ only by case all of them.
    An edge that users made has their last note.
    """
    rows = events.where("id is not null")
    known = rows.select(_name(F.col("id")).alias("name"), "id").distinct()
    said, own = _name(F.col("continues_from")), F.concat(F.lower("video_id"), F.lit(":"))
    stated = (
        rows.where(said != "")
        .select(F.col("id").alias("dst_id"), F.explode(F.array_distinct(F.array_compact(F.array(said, F.concat(own, said))))).alias("name"))
        .distinct()
        .join(known, "name")
        .select(F.col("id").alias("src_id"), "dst_id", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("note"))
    )
    made = links.select(_name(F.col("src_id")).alias("a"), _name(F.col("dst_id")).alias("b"), F.col("corrected_at").cast("timestamp").alias("at"), F.col("correction_note").alias("note"))
    by_user = (
        made.join(known.select(F.col("name").alias("a"), F.col("id").alias("src_id")), "a")
        .join(known.select(F.col("name").alias("b"), F.col("id").alias("dst_id")), "b")
        .select("src_id", "dst_id", "at", "note")
    )
    last = stated.unionByName(by_user).groupBy("src_id", "dst_id").agg(F.max(F.struct("at", "note")).alias("last"))
    event = F.lit("event")
    return last.select("src_id", event.alias("src_kind"), "dst_id", event.alias("dst_kind"), F.col("last.note").alias("correction_note"), F.col("last.at").alias("corrected_at"))


def seen_in(evidence: Column) -> Column:
    """The distinct labels that the visual evidence of an event names."""
    parsed = F.from_json(evidence, "array<struct<modality:string,value:string>>")
    return F.array_distinct(F.transform(F.filter(parsed, lambda x: (x["modality"] == "visual") & (F.trim(x["value"]) != "")), lambda x: x["value"]))


def object_name(label: Column) -> Column:
    return F.concat(F.lit("object_"), slug(label))


def _in_video(video: str, local: Column | str) -> Column:
    return F.concat(video, F.lit(":"), local)


def graph_of_tables(spark: SparkSession, folder: str, subject_types: tuple[str, ...] = SUBJECT_EVENTS) -> FootageGraph:
    """The graph of a data folder's ``videos, clips, clip_events, continues_links, people_cards, vehicle_cards, event_catalog``.

    The rows of an event are equal but for ``written_at`` and ``confidence``; clips and cards are taken as last
    written. Objects are what the visual evidence of a video's events names, plates those of its vehicles. People
    are tagged by the events of ``subject_types``; a topic is the first word of an event type.
    """
    t = lambda name: table(spark, folder, name)

    def videos(columns) -> DataFrame:
        rows = one_of_copies(t("videos").withColumn("id", F.col("video_id")), "id", columns=_known(columns, t("videos")))
        if columns is not None and "clip_count" not in columns:
            return rows
        counts = clips(("id", "video_id")).groupBy(F.col("video_id").alias("id")).agg(F.count("*").cast("int").alias("clip_count"))
        return rows.join(counts, "id", "left").fillna({"clip_count": 0})

    def clips(columns) -> DataFrame:
        rows = t("clips").withColumnRenamed("clip_index", "index")
        return last_write(rows, "id", "written_at", columns=_known(columns, rows))

    def events(columns) -> DataFrame:
        rows = t("clip_events").withColumns(
            {"start_ms": moment(F.col("start_ms"), F.col("start_timestamp")), "end_ms": moment(F.col("end_ms"), F.col("end_timestamp"))}
        )
        return one_of_copies(rows, "id", ("confidence", "written_at"), _known(columns, rows))

    def cards(*columns: str) -> DataFrame:
        return last_write(t("people_cards").withColumn("potential_suspect", F.lit(False)), "id", "updated_at", "card_id", columns=columns)

    def people(columns) -> DataFrame:
        """Roles and what explains them need the events; they are joined only where they are asked for."""
        told = ("role", "potential_suspect", "suspect_reason", "suspect_at", "suspect_event", "suspect_snapshot")
        if columns is not None and not set(columns) & set(told):
            return cards(*_known(columns, t("people_cards")))
        rows = t("people_cards")
        wanted = rows.columns if columns is None else (*_known(columns, rows), "is_cop", "clothes", "description", "distinctive")
        return tag_people(cards(*dict.fromkeys(wanted)), subjects())

    def subjects() -> DataFrame:
        who = events(("id", "video_id", "clip_id", "type", "start_ms", "start_timestamp", "people_ids")).where(F.col("type").isin(*subject_types))
        listed = who.select("*", F.explode("people_ids").alias("x")).where("x is not null").withColumn("person_id", _in_video("video_id", "x"))
        about = cards("is_cop", "clothes", "description").withColumnRenamed("id", "person_id")
        words = clips(("id", "transcript", "start_ms")).select(F.col("id").alias("clip_id"), "transcript", F.col("start_ms").alias("clip_start"))
        clock = F.coalesce("start_timestamp", format_clock(F.col("start_ms")))
        return first_subjects(listed.join(about, "person_id").join(words, "clip_id", "left").withColumn("clock", clock), subject_types, ["start_ms", "id"])

    def vehicles(columns) -> DataFrame:
        rows = t("vehicle_cards").withColumns({"color": F.lower(strip(F.col("color"))), "plate": normal_plate(F.col("plate"))})
        return one_of_copies(rows, "id", columns=_known(columns, rows))

    def seen() -> DataFrame:
        """``event_id, clip_id, video_id, label`` of the objects that events name."""
        rows = events(("id", "clip_id", "video_id", "evidence")).where("video_id is not null")
        return rows.select(F.col("id").alias("event_id"), "clip_id", "video_id", F.explode(seen_in(F.col("evidence"))).alias("label"))

    def objects(columns) -> DataFrame:
        rows = seen().groupBy("video_id", object_name(F.col("label")).alias("local_id")).agg(F.min("label").alias("label"))
        return rows.withColumn("id", _in_video("video_id", "local_id"))

    def plates(columns) -> DataFrame:
        rows = vehicles(("id", "video_id", "plate")).where("plate <> ''").select("video_id", F.col("plate").alias("text")).distinct()
        return rows.select(_in_video("video_id", F.concat(F.lit("plate:"), "text")).alias("id"), "text", "video_id", F.lit("vehicle").alias("source"), F.lit(0.6).alias("confidence"))

    def topic(c: str) -> Column:
        return F.split_part(c, F.lit("_"), F.lit(1))

    def listed(name: str, *columns: str) -> DataFrame:
        rows = events(("id", "video_id", name, *columns)).where("video_id is not null")
        return rows.select("id", "video_id", *columns, F.explode(name).alias("x")).where("x is not null").distinct()

    def cars() -> DataFrame:
        return link_names(listed("vehicle_ids", "clip_id"), vehicles(("id", "video_id", "local_id", "plate")), "plate").select("id", "clip_id", "thing_id")

    def involves(columns) -> DataFrame:
        roles = columns is None or "role" in columns
        more = ["type"] if roles else []
        who = _edge(listed("people_ids", *more), F.col("id"), "event", _in_video("video_id", "x"), "person", *more)
        if roles:
            about = people(("id", "is_cop", "potential_suspect")).withColumnRenamed("id", "dst_id")
            role = event_role(F.col("is_cop"), F.col("potential_suspect"), F.col("type"), subject_types)
            who = who.drop("role").join(about, "dst_id", "left").withColumn("role", role).select("src_id", "src_kind", "dst_id", "dst_kind", "role")
        things = seen().select("event_id", _in_video("video_id", object_name(F.col("label"))).alias("x"))
        return (
            who.unionByName(_edge(cars(), F.col("id"), "event", F.col("thing_id"), "vehicle"))
            .unionByName(_edge(things, F.col("event_id"), "event", F.col("x"), "object"))
        )

    def contains(columns) -> DataFrame:
        clip, x = F.col("clip_id"), _in_video("video_id", "x")
        return reduce(
            DataFrame.unionByName,
            (
                _edge(events(("id", "clip_id")), clip, "clip", F.col("id"), "event"),
                _edge(listed("people_ids", "clip_id"), clip, "clip", x, "person"),
                _edge(cars(), clip, "clip", F.col("thing_id"), "vehicle"),
                _edge(seen(), clip, "clip", _in_video("video_id", object_name(F.col("label"))), "object"),
            ),
        )

    def of_video(kind: str, nodes: Callable[[tuple], DataFrame]) -> Maker:
        return lambda columns: _edge(nodes(("id", "video_id")), F.col("video_id"), "video", F.col("id"), kind)

    def has_plate(columns) -> DataFrame:
        plate = vehicles(("id", "video_id", "plate")).where("plate <> ''").withColumn("p", _in_video("video_id", F.concat(F.lit("plate:"), "plate")))
        return _edge(plate, F.col("video_id"), "video", F.col("p"), "plate").unionByName(_edge(plate, F.col("id"), "vehicle", F.col("p"), "plate"))

    def typed(*columns: str) -> DataFrame:
        return events((*columns, "type")).join(t("event_catalog").select(F.col("id").alias("type")), "type")

    def has_type(columns) -> DataFrame:
        rows = typed("id", "clip_id", "video_id")
        return _edge(rows, F.col("clip_id"), "clip", F.col("type"), "event_type").unionByName(_edge(rows, F.col("video_id"), "video", F.col("type"), "event_type"))

    def chain(columns) -> tuple[DataFrame, DataFrame]:
        return clip_chain(clips(("id", "video_id", "index", "start_ms")))

    return FootageGraph.of(
        spark,
        {
            "video": videos,
            "clip": clips,
            "event": events,
            "person": people,
            "vehicle": vehicles,
            "object": objects,
            "plate": plates,
            "event_type": lambda columns: t("event_catalog"),
            "topic": lambda columns: t("event_catalog").select(topic("id").alias("id")).distinct().withColumn("title", F.col("id")),
        },
        {
            "contains": contains,
            "involves": involves,
            "has_person": of_video("person", people),
            "has_vehicle": of_video("vehicle", vehicles),
            "has_object": of_video("object", objects),
            "has_plate": has_plate,
            "has_type": has_type,
            "instance_of": lambda columns: _edge(typed("id"), F.col("id"), "event", F.col("type"), "event_type"),
            "in_topic": lambda columns: t("event_catalog").select(F.col("id").alias("src_id"), topic("id").alias("dst_id")),
            "bundles": lambda columns: t("event_catalog").select(topic("id").alias("src_id"), F.col("id").alias("dst_id")),
            "continues": lambda columns: continues(t("clip_events"), t("continues_links")),
            "starts_at": lambda columns: chain(columns)[0],
            "next": lambda columns: chain(columns)[1],
        },
    )


def _known(columns: tuple[str, ...] | None, rows: DataFrame) -> tuple[str, ...] | None:
    """Those of the columns asked for that the rows have."""
    return None if columns is None else tuple(c for c in columns if c in rows.columns)
