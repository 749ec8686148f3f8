"""Registered queries of the functions and operators on records: clocks, texts, rules, windows, identities, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, clock, text
from .operators import detect, identity, roles, rules, vision, windows
from .plans.graph import last_write
from .queries import query, sql_clock
from .questions import graph
from .sources import media
from .sources.sinks import upsert, video_transcripts
from .sources.tables import table
from .streaming.folder import hop_counts
from .twins import SUBJECTS, flat, shown, sql_format, with_graph


@query("src_filter_project", "select event_id, user_id, value from events where event_type = 'click' and value > 50")
def src_filter_project(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("event_type = 'click' and value > 50").select("event_id", "user_id", "value")


@query(
    "nearest_cell",
    with_graph(
        """, sized as (select id, start_ms, end_ms, greatest(4, least(6, (end_ms - start_ms) // 30000)) as n from clip where end_ms is not null),
        cells as (select id, i, cast(floor(start_ms + (i + 0.5) * (end_ms - start_ms) / n) as bigint) as mid, start_ms from sized, range(0, 6) t(i) where i < n)
        select id, cast(arg_min(i, {'gap': abs(mid - (start_ms + 61000)), 'i': i}) as int) as cell from cells group by id"""
    ),
)
def nearest_cell(spark: SparkSession, folder: str) -> DataFrame:
    c = graph(spark, folder).node("clip", "id", "start_ms", "end_ms").where("end_ms is not null")
    return c.select("id", windows.nearest_cell(windows.splice_cells(F.col("start_ms"), F.col("end_ms")), F.col("start_ms") + 61_000).alias("cell"))


_TYPED = "typed as (select id, video_id, type, cast(nullif(regexp_extract(clip_id, 'clip_([0-9]+)$', 1), '') as int) as idx, start_ms, people_ids from event where type is not null)"


def _typed(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    rows = graph(spark, folder).node("event", "id", "video_id", "clip_id", "type", "start_ms", *more).where("type is not null")
    return rows.withColumn("idx", F.nullif(F.regexp_extract("clip_id", "clip_([0-9]+)$", 1), F.lit("")).cast("int"))


@query(
    "stitch_lag",
    with_graph(
        f""", {_TYPED}, lagged as (select id, idx, lag(idx) over w as i, lag(id) over w as b from typed window w as (partition by video_id, type order by idx nulls first, start_ms nulls first, id))
        select id, b as continues_from from lagged where idx - i = 1"""
    ),
)
def stitch_lag(spark: SparkSession, folder: str) -> DataFrame:
    return windows.stitch(_typed(spark, folder), ["video_id", "type"], "idx", ["start_ms", "id"], "id").where("continues_from is not null").select("id", "continues_from")


@query(
    "event_chain_islands",
    with_graph(
        f""", {_TYPED}, d as (select distinct video_id, type, idx from typed where idx is not null),
        s as (select *, idx - row_number() over (partition by video_id, type order by idx) as island from d)
        select a.video_id, a.type, a.idx as first_idx, b.idx as last_idx from s a join s b on a.video_id = b.video_id and a.type = b.type and a.island = b.island and b.idx > a.idx"""
    ),
)
def event_chain_islands(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.keyed_chain(_typed(spark, folder).where("idx is not null"), ["video_id", "type"], "idx")
    return out.select("video_id", "type", F.col("start").alias("first_idx"), F.col("end").alias("last_idx"))


@query(
    "share_participants_ffill",
    with_graph(
        f""", {_TYPED} select id, coalesce(array_to_string(last_value(case when len(people_ids) > 0 then people_ids end ignore nulls) over (partition by video_id, type
        order by idx nulls first, start_ms nulls first, id rows between unbounded preceding and current row), ','), '') as people from typed"""
    ),
)
def share_participants_ffill(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.share_participants(_typed(spark, folder, "people_ids"), ["video_id", "type"], ["idx", "start_ms", "id"], ["people_ids"])
    return out.select("id", F.coalesce(F.array_join("people_ids", ","), F.lit("")).alias("people"))


@query(
    "first_event_per_person",
    with_graph("select dst_id as person, arg_min(src_id, {'s': start_ms, 'i': src_id}) as first_event from listed where start_ms is not null group by 1"),
)
def first_event_per_person(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    timed = g.node("event", "id", "start_ms").where("start_ms is not null").withColumnRenamed("id", "src_id")
    rows = g.edge("involves", "event", "person", role=False).withColumnRenamed("dst_id", "person").join(timed, "src_id")
    return windows.first_of(rows, ["person"], ["start_ms", "src_id"]).select("person", F.col("src_id").alias("first_event"))


@query(
    "dedup_first_per_type",
    with_graph("select id from (select id, row_number() over (partition by clip_id, type order by start_ms nulls first, id) as place from event where type is not null and clip_id is not null) where place = 1"),
)
def dedup_first_per_type(spark: SparkSession, folder: str) -> DataFrame:
    rows = graph(spark, folder).node("event", "id", "clip_id", "type", "start_ms").where("type is not null and clip_id is not null")
    return windows.first_of(rows, ["clip_id", "type"], ["start_ms", "id"]).select("id")


_PHRASES = [("step", 0, "watch the step"), ("copy", 1, "copy"), ("distance", 2, "keep your distance"), ("clear", 3, "show me clear")]
_PHRASES_SQL = "phrases as (select * from (values " + ", ".join(f"('{d}', {r}, '{p}')" for d, r, p in _PHRASES) + ") v(definition, rank, phrase))"
_HITS_SQL = f"""{_PHRASES_SQL}, hits as (select c.id, definition, rank, phrase,
  cast((length(transcript) - length(replace(lower(transcript), phrase, ''))) / length(phrase) as int) as count from clip c join phrases on contains(lower(transcript), phrase))"""


def _hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    clips = graph(spark, folder).node("clip", "id", "video_id", "start_ms", "end_ms", "transcript", "summary", "loudness")
    return clips, rules.keyword_hits(clips, spark.createDataFrame(_PHRASES, "definition string, rank int, phrase string"))


@query("keyword_hits_join", with_graph(f", {_HITS_SQL} select id, definition, phrase, count, start_ms from (select h.*, c.start_ms from hits h join clip c using (id))"))
def keyword_hits_join(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder)[1].select("id", "definition", "phrase", "count", "start_ms")


_COMMANDS = "|".join(text.COMMANDS).replace("'", "''")


@query("repeated_commands_regex", f"select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '(?i)\\b({_COMMANDS})\\b')) as int) as commands from documents")
def repeated_commands_regex(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.repeated_commands(F.col("text")).alias("commands"))


#: Signals of a clip from what the tables hold: loudness, commands, and a loud impact and loud speech from the loudness.
_SIGNALS_SQL = f"""loud as (select id, loudness from (select *, row_number() over (partition by id order by written_at desc, loudness desc nulls last) as place from clips where id is not null) where place = 1),
  signal as (select c.*, l.loudness, case when l.loudness >= 0.6 then l.loudness end as loud_impact, case when l.loudness < 0.4 then 1 - l.loudness end as loud_speech,
    case when c.transcript is null then 0.9 when c.idx % 3 = 0 then 0.0 end as yelling, case when l.loudness >= 0.6 then cast(floor(l.loudness * 1000) as int) end as impact_at_ms,
    len(regexp_extract_all(coalesce(transcript, ''), '(?i)\\b({_COMMANDS})\\b')) as repeated_commands from clip c join loud l using (id))"""


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    c = graph(spark, folder).node("clip", "id", "video_id", "local_id", "index", "start_ms", "end_ms", "transcript", "loudness")
    loud = F.col("loudness")
    return c.withColumns(
        {
            "loud_impact": F.when(loud >= 0.6, loud),
            "loud_speech": F.when(loud < 0.4, 1 - loud),
            "yelling": F.when(F.col("transcript").isNull(), 0.9).when(F.col("index") % 3 == 0, 0.0),
            "impact_at_ms": F.when(loud >= 0.6, F.floor(loud * 1000).cast("int")),
            "repeated_commands": text.repeated_commands(F.col("transcript")),
        }
    )


_RULES = [("noisy", 9, ["loudness", "yelling"], 1, ["repeated_commands"]), ("loud_impact", 10, ["loud_impact"], 1, []), ("uproar", 11, ["loudness", "loud_speech", "yelling"], 2, [])]
_HOLDS = "coalesce({0}, 0) >= 0.5"
_CANDIDATES_SQL = f"""found as (select id, definition, min(rank) as rank, 'keyword' as way from hits group by 1, 2
  union all select id, 'noisy', 9, 'signal' from signal where ({_HOLDS.format("loudness")} or {_HOLDS.format("yelling")}) and not {_HOLDS.format("repeated_commands")}
  union all select id, 'loud_impact', 10, 'signal' from signal where {_HOLDS.format("loud_impact")}
  union all select id, 'uproar', 11, 'signal' from signal where cast({_HOLDS.format("loudness")} as int) + cast({_HOLDS.format("loud_speech")} as int) + cast({_HOLDS.format("yelling")} as int) >= 2)"""


def _candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits = _hits(spark, folder)[1]
    rule = spark.createDataFrame(_RULES, "definition string, rank int, signals array<string>, need int, exclude array<string>")
    signals = _signals(spark, folder)
    return signals, rules.candidates(signals, rule, hits), hits


@query("rule_candidates", with_graph(f", {_HITS_SQL}, {_SIGNALS_SQL}, {_CANDIDATES_SQL} select id, definition, rank, way as \"by\" from found"))
def rule_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder)[1]


@query(
    "local_events",
    with_graph(
        f""", {_HITS_SQL}, {_SIGNALS_SQL}, {_CANDIDATES_SQL}, phrased as (select id, definition, arg_min(phrase, rank) as phrase from hits group by 1, 2),
        made as (select f.id, s.video_id, f.definition as type, case when way = 'keyword' then s.start_ms when f.definition = 'loud_impact' then s.start_ms + coalesce(s.impact_at_ms, 0) else s.start_ms end as start_ms,
          s.end_ms, case when way = 'keyword' then 'transcript:' || phrase else 'signal:' || f.definition end as evidence, case when way = 'keyword' then cast(0.7 as double) else cast(0.6 as double) end as confidence,
          case when way = 'keyword' then 'keyword' else 'local_signals' end as source from found f join signal s using (id) left join phrased using (id, definition))
        select *, {sql_format("start_ms")} as clock, id || ':' || type || ':' || start_ms as event_id, type || ' | ' || replace(evidence, ':', ' | ') as line from made"""
    ),
)
def local_events(spark: SparkSession, folder: str) -> DataFrame:
    signals, found, hits = _candidates(spark, folder)
    made = rules.local_events(signals, found, hits).drop("rank")
    return flat(made.withColumn("line", F.array_join(rules.evidence_lines(F.col("type"), F.col("evidence")), ",")))


_KEYS = ", ".join(f"'{k}'" for k in rules.KEY_EVENTS)


@query(
    "key_clips",
    with_graph(
        f""", {_SIGNALS_SQL}, named as (select clip_id as id, list(type) as types from event where type is not null group by 1)
        select s.id, coalesce(loud_impact >= 0.7, false) or coalesce(coalesce(nullif(yelling, 0), loud_speech) >= 0.7, false) or repeated_commands >= 2
          or coalesce(len(list_filter(types, lambda t: t in ({_KEYS}))) > 0, false) as key_clip, key_clip or types is not null as asked from signal s left join named using (id)"""
    ),
)
def key_clips(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    types = g.node("event", "id", "clip_id", "type").where("type is not null").groupBy(F.col("clip_id").alias("id")).agg(F.collect_list("type").alias("types"))
    rows = _signals(spark, folder).join(types, "id", "left").withColumns({"person_count": F.lit(0), "vehicle_count": F.lit(None).cast("int")})
    key = rules.is_key_clip(F.col("types"))
    return rows.select("id", key.alias("key_clip"), rules.asks_model(key, F.col("types"), F.array().cast("array<string>")).alias("asked"))


_COUNTS_SQL = """counted as (select c.id, cast((select count(distinct k.dst_id) from contains k where k.src_id = c.id and k.kind = 'person') as int) as person_count,
  cast((select count(distinct k.dst_id) from contains k where k.src_id = c.id and k.kind = 'vehicle') as int) as vehicle_count,
  cast((select count(distinct k.dst_id) from contains k where k.src_id = c.id and k.kind = 'object') as int) as object_count,
  coalesce((select list(distinct o.label order by o.label) from contains k join object o on o.id = k.dst_id where k.src_id = c.id), []) as labels,
  coalesce((select list(distinct type order by type) from event e where e.clip_id = c.id and type is not null), []) as types,
  coalesce((select list(definition order by rank) from hits h where h.id = c.id), []) as names from clip c)"""
_TAGS_SQL = f"""{_HITS_SQL}, {_SIGNALS_SQL}, {_COUNTS_SQL}, tags as (select id, list_concat(case when trim(coalesce(transcript, '')) <> '' then ['speech'] else ['no_speech'] end,
    case when person_count > 0 then ['person'] else [] end, case when vehicle_count > 0 then ['vehicle'] else [] end, case when object_count > 0 then ['object'] else [] end,
    case when person_count > 0 or vehicle_count > 0 then ['needs_vision'] else [] end, labels, case when loud_impact >= 0.5 then ['loud_impact'] else [] end,
    case when yelling >= 0.5 then ['yelling'] else [] end, case when repeated_commands >= 2 then ['repeated_commands'] else [] end, names, types) as t from signal join counted using (id)),
  placed as (select id, tag, min(i) as i from (select id, unnest(t) as tag, generate_subscripts(t, 1) as i from tags) group by 1, 2),
  tagged as (select id, string_agg(tag, ',' order by i) as tags, string_agg(tag, ', ' order by i) as spaced from placed group by 1)"""


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Clips with the counts, labels, names and types that the graph has of them."""
    g, empty = graph(spark, folder), F.array().cast("array<string>")
    kinds = ("person", "vehicle", "object")
    held = g.edge("contains").where(F.col("dst_kind").isin(*kinds)).select("src_id", "dst_kind", "dst_id")
    counts = held.groupBy(F.col("src_id").alias("id")).agg(*[F.countDistinct(F.when(F.col("dst_kind") == k, F.col("dst_id"))).cast("int").alias(f"{k}_count") for k in kinds])
    named = held.where("dst_kind = 'object'").join(g.node("object", "id", "label").withColumnRenamed("id", "dst_id"), "dst_id")
    labels = named.groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    types = g.node("event", "id", "clip_id", "type").groupBy(F.col("clip_id").alias("id")).agg(F.array_sort(F.collect_set("type")).alias("types"))
    hits = _hits(spark, folder)[1]
    names = hits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "definition"))), lambda x: x["definition"]).alias("names"))
    rows = _signals(spark, folder)
    for part in (counts, labels, types, names):
        rows = rows.join(part, "id", "left")
    rows = rows.fillna({f"{k}_count": 0 for k in kinds}).withColumns({c: F.coalesce(c, empty) for c in ("labels", "types", "names")})
    rows = rows.withColumn("needs_vision", (F.col("person_count") > 0) | (F.col("vehicle_count") > 0))
    return rows.withColumn("tags", rules.local_tags(F.col("labels"), F.col("names"), F.col("types")))


@query("local_tags", with_graph(f", {_TAGS_SQL} select id, tags from tagged"))
def local_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("id", F.array_join("tags", ",").alias("tags"))


_PADDED = "case when length({0}) = 7 then '0' || {0} else {0} end"


@query(
    "local_summary",
    with_graph(
        f""", {_TAGS_SQL}, clocked as (select *, {sql_format("coalesce(start_ms, 0)")} as a, {sql_format("coalesce(end_ms, 0)")} as b from signal)
        select s.id, 'Clip ' || s.local_id || ' (' || {_PADDED.format("a")} || '–' || {_PADDED.format("b")} || '). Visible: ' || person_count || ' person(s), ' || vehicle_count || ' vehicle(s), '
          || object_count || ' object(s)' || case when len(labels) > 0 then ' (' || array_to_string(labels, ', ') || ')' else '' end || '. '
          || case when trim(coalesce(transcript, '')) <> '' then 'Speech: ' || substring(trim(transcript), 1, 400) || case when length(trim(transcript)) > 400 then '…' else '' end else 'No speech transcribed.' end
          || ' Tags: ' || spaced || '.' as summary from clocked s join counted using (id) join tagged using (id)"""
    ),
)
def local_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tagged(spark, folder).withColumns({"clip": F.col("id"), "id": F.col("local_id")})
    nobody = F.array().cast("array<string>")
    return rows.select(F.col("clip").alias("id"), rules.local_summary(F.col("labels"), nobody, F.col("tags")).alias("summary"))


@query(
    "clip_windows",
    """with v as (select video_id, max(duration_s) as d from videos group by 1 having max(duration_s) > 0)
    select video_id, cast(i as int) as idx, i * 170.0 as start_s, least(d, i * 170.0 + 180) as end_s from v, range(0, 100000) t(i) where i <= greatest(0, ceil((d - 180) / 170))""",
)
def clip_windows(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").groupBy("video_id").agg(F.max("duration_s").alias("d"))
    return v.select("video_id", F.explode(windows.clip_windows(F.col("d"))).alias("w")).select("video_id", F.col("w.index").alias("idx"), "w.start_s", "w.end_s")


@query(
    "format_clock",
    with_graph("select id, case when start_ms >= 3600000 then printf('%d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) else printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) end as clock from event where start_ms is not null"),
)
def format_clock(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).node("event", "id", "start_ms").where("start_ms is not null").select("id", clock.format_clock(F.col("start_ms")).alias("clock"))


@query("parse_clock", f"select distinct start_timestamp as said, {sql_clock('start_timestamp')} as ms from clip_events where start_timestamp is not null")
def parse_clock(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "clip_events").where("start_timestamp is not null").select(F.col("start_timestamp").alias("said")).distinct()
    return said.select("said", clock.parse_clock(F.col("said")).alias("ms"))


@query(
    "clock_seconds",
    f"""select distinct start_timestamp as said, case when regexp_matches(start_timestamp, '^\\s*[0-9]+\\s*$') and cast(trim(start_timestamp) as bigint) < 1000 then cast(trim(start_timestamp) as double)
    else ({sql_clock("start_timestamp")}) / 1000.0 end as seconds from clip_events where start_timestamp is not null""",
)
def clock_seconds(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "clip_events").where("start_timestamp is not null").select(F.col("start_timestamp").alias("said")).distinct()
    return said.select("said", clock.clock_seconds(F.col("said")).alias("seconds"))


_STATED = "greatest(c.start_ms, least(greatest(c.start_ms, coalesce(c.end_ms, c.start_ms)), {0}))"


@query(
    "event_window",
    with_graph(
        f""", raw as (select distinct id, clip_id, cell, start_ms, end_ms, start_timestamp, end_timestamp from clip_events where id is not null),
        x as (select r.id, r.cell, c.start_ms as lo, greatest(c.start_ms, coalesce(c.end_ms, c.start_ms)) as hi, {_STATED.format(f"coalesce(r.start_ms, {sql_clock('r.start_timestamp')})")} as s0,
            {_STATED.format(f"coalesce(r.end_ms, {sql_clock('r.end_timestamp')})")} as e0, coalesce(r.start_ms, {sql_clock("r.start_timestamp")}) is null as no_s, coalesce(r.end_ms, {sql_clock("r.end_timestamp")}) is null as no_e,
            greatest(4, least(6, (c.end_ms - c.start_ms) // 30000)) as n from raw r join clip c on c.id = r.clip_id where c.end_ms is not null and c.start_ms is not null),
        y as (select *, case when no_s then coalesce(case when cell between 0 and n - 1 then cast(floor(lo + (cell + 0.5) * (hi - lo) / n) as bigint) end, lo) else s0 end as s from x),
        z as (select *, case when no_e then least(hi, s + 30000) else e0 end as e from y)
        select id, s as start_ms, case when e < s then least(hi, s + 1000) else e end as end_ms, {sql_format("s")} as clock, {sql_format("case when e < s then least(hi, s + 1000) else e end")} as end_clock,
          s / 1000.0 as seek_s from z"""
    ),
)
def event_window(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    raw = table(spark, folder, "clip_events").where("id is not null").select("id", "clip_id", "cell", "start_ms", "end_ms", "start_timestamp", "end_timestamp").distinct()
    c = g.node("clip", "id", "start_ms", "end_ms").where("start_ms is not null and end_ms is not null")
    c = c.select(F.col("id").alias("clip_id"), F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), windows.splice_cells(F.col("start_ms"), F.col("end_ms")).alias("cells"))
    cell_ms = F.when(F.col("cell") >= 0, F.try_element_at("cells", F.col("cell") + 1))
    w = clock.event_window(F.col("start_ms"), F.col("start_timestamp"), F.col("end_ms"), F.col("end_timestamp"), cell_ms, F.lit(None).cast("bigint"), F.col("lo"), F.col("hi"))
    return raw.join(c, "clip_id").select("id", w.alias("w")).select("id", "w.*")


@query(
    "timelines",
    with_graph(
        f""", sized as (select *, greatest(4, least(6, (end_ms - start_ms) // 30000)) as n from clip where end_ms is not null and start_ms is not null),
        cells as (select id, string_agg(printf('cell_%02d at ', i) || {sql_format("mid")} || ' (' || mid || 'ms)', chr(10) order by i) as cells
          from (select id, i, cast(floor(start_ms + (i + 0.5) * (end_ms - start_ms) / n) as bigint) as mid from sized, range(0, 6) t(i) where i < n) group by 1)
        select s.id, cells, case when trim(coalesce(transcript, '')) = '' then '(no speech)' else '[' || {sql_format("start_ms")} || '] ' || trim(transcript) end as words from sized s join cells using (id)"""
    ),
)
def timelines(spark: SparkSession, folder: str) -> DataFrame:
    c = graph(spark, folder).node("clip", "id", "start_ms", "end_ms", "transcript").where("end_ms is not null and start_ms is not null")
    segments = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,text:string>>")
    cells = clock.cell_timeline(windows.splice_cells(F.col("start_ms"), F.col("end_ms")))
    return c.select("id", cells.alias("cells"), clock.transcript_timeline(F.col("start_ms"), segments, F.col("transcript")).alias("words"))


#: Segments of a transcript, one for each sentence, a second apart for each letter before it.
_SEGMENTS_SQL = """parts as (select id, start_ms, transcript, unnest(string_split(transcript, '. ')) as piece, generate_subscripts(string_split(transcript, '. '), 1) as i from clip where transcript <> '' and start_ms is not null),
  segments as (select id, i, piece, (i - 1) * 7000 as t from parts)"""


def _segments(words: Column) -> Column:
    return F.transform(F.split(words, r"\. "), lambda w, i: F.struct((i * 7000).cast("bigint").alias("start_ms"), (i * 7000 + 7000).cast("bigint").alias("end_ms"), w.alias("text")))


@query(
    "words_around_events",
    with_graph(
        f""", {_SEGMENTS_SQL}, placed as (select e.id, e.clip_id, greatest(e.start_ms - c.start_ms, 0) as rel, c.transcript from event e join clip c on c.id = e.clip_id
          where e.start_ms is not null and c.start_ms is not null),
        near as (select a.id, trim(piece) as piece, row_number() over (partition by a.id order by i) as n from placed a join segments s on s.id = a.clip_id and abs(s.t - a.rel) <= 20000 and trim(piece) <> '')
        select a.id, coalesce((select string_agg(piece, ' ' order by n) from near where near.id = a.id and n <= 4), substring(trim(coalesce(a.transcript, '')), 1, 240)) as words from placed a"""
    ),
)
def words_around_events(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    c = g.node("clip", "id", "start_ms", "transcript").where("start_ms is not null").select(F.col("id").alias("clip_id"), F.col("start_ms").alias("lo"), "transcript")
    e = g.node("event", "id", "clip_id", "start_ms").where("start_ms is not null").join(c, "clip_id")
    words = F.when(F.col("transcript") != "", _segments(F.col("transcript")))
    return e.select("id", roles.words_around(F.col("start_ms"), F.col("lo"), words, F.col("transcript")).alias("words"))


@query("slugify", "select distinct type, substring(regexp_replace(regexp_replace(lower(type), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) as slug from clip_events where type is not null")
def slugify(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "clip_events").where("type is not null").select("type").distinct()
    return t.select("type", text.slug(F.col("type")).alias("slug"))


@query(
    "normalize_plate",
    """with p as (select distinct plate, regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') as bare from vehicle_cards where plate is not null)
    select plate, case when length(bare) between 4 and 10 and regexp_matches(bare, '[0-9]') then bare else '' end as normal from p""",
)
def normalize_plate(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "vehicle_cards").where("plate is not null").select("plate").distinct()
    return p.select("plate", text.normal_plate(F.col("plate")).alias("normal"))


_STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _clean_sql(column: str, default: str = "") -> str:
    low = f"lower({_STRIP.format(f'coalesce({column}, {chr(39) * 2})')})"
    return f"case when {low} in ('', 'null', 'n/a', 'unreadable') then '{default}' when {low} in ('none', 'no', 'no glasses') then 'none' else {low} end"


@query(
    "clean_attributes",
    f"select distinct description, {_clean_sql('description', 'unknown')} as cleaned, regexp_replace({_STRIP.format('description')}, '[\\s\\x{{a0}}]+', ' ', 'g') as line from people_cards where description is not null",
)
def clean_attributes(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "people_cards").where("description is not null").select("description").distinct()
    return d.select("description", text.clean(F.col("description")).alias("cleaned"), text.one_line(F.col("description")).alias("line"))


@query(
    "officer_or_not",
    """select distinct gender, is_cop, case when is_cop or lower(trim(gender)) in ('officer', 'cop', 'police') then true when not is_cop or lower(trim(gender)) = 'civilian' then false end as officer,
    case when lower(trim(gender)) in ('true', 'yes', 'officer', 'cop', 'police') then true when lower(trim(gender)) in ('false', 'no', 'civilian') then false end as by_text from people_cards""",
)
def officer_or_not(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "people_cards").select("gender", "is_cop").distinct()
    return p.select("gender", "is_cop", text.is_officer(F.col("is_cop"), F.col("gender")).alias("officer"), text.is_officer(F.col("gender"), F.lit(None).cast("string")).alias("by_text"))


@query(
    "event_names",
    """with x as (select distinct type, source, substring(regexp_replace(regexp_replace(lower(type), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) as a from clip_events)
    select type, source, case when a not in ('', 'event') then a when source not in ('', 'event') then source end as name from x""",
)
def event_names(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "clip_events").select("type", "source").distinct()
    return x.select("type", "source", text.event_name(F.col("type"), F.col("source")).alias("name"))


@query(
    "person_texts",
    with_graph(
        """select id, not regexp_matches(lower(coalesce(clothes, '')), 'police|uniform|badge') and (coalesce(clothes, '') <> '' or coalesce(description, '') <> '') as civilian,
        local_id || ': ' || coalesce(nullif(trim(signature), ''), nullif(trim(clothes), ''), nullif(trim(description), ''), 'person') as line,
        trim(concat_ws(' | ', nullif(d, ''), nullif(w, ''), nullif(m, ''))) as snapshot from (select *, coalesce(description, '') as d, case when clothes <> '' and not contains(coalesce(description, ''), clothes) then clothes else '' end as w,
          case when distinctive <> '' and not contains(coalesce(description, '') || case when clothes <> '' and not contains(coalesce(description, ''), clothes) then ' ' || clothes else '' end, distinctive) then distinctive else '' end as m from card)"""
    ),
)
def person_texts(spark: SparkSession, folder: str) -> DataFrame:
    p = graph(spark, folder).node("person", "id", "local_id", "clothes", "description", "distinctive", "signature")
    person = F.struct(F.col("local_id").alias("id"), "signature", "clothes", "description")
    return p.select(
        "id", roles.looks_civilian(F.col("clothes"), F.col("description")).alias("civilian"), rules.person_line(person).alias("line"),
        roles.snapshot(F.col("description"), F.col("clothes"), F.col("distinctive")).alias("snapshot"),
    )


_TAGGED = "id, role, potential_suspect, suspect_reason, suspect_at, suspect_event, suspect_snapshot"


@query("first_subjects", with_graph(f"select {_TAGGED} from person"))
def first_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).node("person", *_TAGGED.split(", "))


@query("evidence_json_extract", with_graph("select id, x.modality, x.value from (select id, unnest(from_json(evidence, '[{\"modality\":\"VARCHAR\",\"value\":\"VARCHAR\"}]')) as x from event)"))
def evidence_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    e = graph(spark, folder).node("event", "id", "evidence")
    return e.select("id", F.explode(F.from_json("evidence", "array<struct<modality:string,value:string>>")).alias("x")).select("id", "x.modality", "x.value")


@query(
    "role_precedence_merge",
    with_graph("select video_id, arg_min(role, case role when 'potential_suspect' then 0 when 'officer' then 1 when 'civilian' then 2 else 3 end) as role from person group by 1"),
)
def role_precedence_merge(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).node("person", "id", "video_id", "role").groupBy("video_id").agg(F.min_by("role", text.role_rank(F.col("role"))).alias("role"))


_SIGNATURE_SQL = ", ".join(f"nullif(nullif({_clean_sql(k)}, ''), 'unknown')" for k in text.SIGNATURE if k != "race")


@query("signature_text", with_graph(f"select id, concat_ws(' | ', {_SIGNATURE_SQL}) as signature from card"))
def signature_text(spark: SparkSession, folder: str) -> DataFrame:
    """The signature of every person over all attributes; the cards have no race."""
    keys = [k for k in text.SIGNATURE if k != "race"]
    return graph(spark, folder).node("person", "id", "race", *keys).select("id", text.signature().alias("signature"))


@query("upsert_last_writer_wins", with_graph("select id, local_id, clothes, hair from card"))
def upsert_last_writer_wins(spark: SparkSession, folder: str) -> DataFrame:
    return last_write(table(spark, folder, "people_cards"), "id", "updated_at", "card_id", columns=("local_id", "clothes", "hair"))


@query("upsert_registry", "select video_id, coalesce(min(case when status = 'ready' then 'graphed' end), min(status)) as status from videos where video_id is not null group by 1")
def upsert_registry(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").where("video_id is not null").groupBy("video_id").agg(F.min("status").alias("status"), F.max("status").alias("most"))
    new = table(spark, folder, "videos").where("status = 'ready' and video_id is not null").select("video_id", F.lit("graphed").alias("status")).distinct()
    return upsert(v.select("video_id", "status"), new, ["video_id"])


@query(
    "upsert_registry_keep",
    """with v as (select distinct source_name, video_id, size_bytes, status from videos)
    select source_name, video_id, case when status = 'failed' then size_bytes when status = 'ready' then size_bytes + 1 else size_bytes end as size_bytes, case when status in ('failed', 'ready') then 'graphed' else status end as status from v""",
)
def upsert_registry_keep(spark: SparkSession, folder: str) -> DataFrame:
    """New entries replace those of their name; one without a size keeps the known one."""
    v = table(spark, folder, "videos").select("source_name", "video_id", "size_bytes", "status").distinct()
    size = F.when(F.col("status") == "ready", F.col("size_bytes") + 1)
    new = v.where("status in ('failed', 'ready')").select("source_name", "video_id", size.alias("size_bytes"), F.lit("graphed").alias("status"))
    return upsert(v, new, ["source_name"], keep=["size_bytes"])


@query("video_status_rows", "select video_id, 'graphed' as status, 2 as step from (select distinct video_id from videos) union all select video_id, status, 1 from (select distinct video_id, status from videos)")
def video_status_rows(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").select("video_id", "status").distinct()
    log = media.status_rows(v, None, F.lit(1))
    return media.status_rows(v, "graphed", F.lit(2), log).select("video_id", "status", "step")


@query("video_status_last", "select distinct video_id, 'graphed' as status from videos")
def video_status_last(spark: SparkSession, folder: str) -> DataFrame:
    return media.last_status(video_status_rows(spark, folder))


@query(
    "finished_videos",
    with_graph("select count(*) as graphed, string_agg(id, ',' order by id) as video_ids, string_agg(cast(clip_count as varchar), ',' order by id) as clip_counts from video"),
)
def finished_videos(spark: SparkSession, folder: str) -> DataFrame:
    """What a run reports at its end; its lists are the videos of that run."""
    v = graph(spark, folder).node("video", "id", "clip_count")
    return media.run_report(v).select("graphed", F.array_join("video_ids", ",").alias("video_ids"), F.array_join("clip_counts", ",").alias("clip_counts"))


@query("left_anti_resume", "select distinct id from clips where id not in (select id from clips where summary is not null and id is not null)")
def left_anti_resume(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "clips").select("id", "summary")
    return media.unfinished(c.select("id").where("id is not null").distinct(), c.where("summary is not null"))


@query("video_ids_of_files", """select distinct source_name, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(source_name, '\\.[^.]*$', ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'video') as made from videos""")
def video_ids_of_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "videos").select("source_name").distinct().select("source_name", media.video_id(F.col("source_name")).alias("made"))


@query(
    "resolve_video_ids",
    """with v as (select distinct video_id, status from videos), f as (select video_id as stem from v union select regexp_replace(video_id, '_[^_]*$', '') from v)
    select stem || '.mp4' as source_name, coalesce((select min(video_id) from v where v.video_id = stem), (select min(video_id) from v where v.status = 'ready' and starts_with(v.video_id, stem || '_')), stem) as video_id from f""",
)
def resolve_video_ids(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").select("video_id", "status").distinct()
    stems = v.select(F.explode(F.array("video_id", F.regexp_replace("video_id", "_[^_]*$", ""))).alias("stem")).distinct()
    return media.resolve_video_ids(stems.select(F.concat("stem", F.lit(".mp4")).alias("source_name")), v, done="ready")


@query(
    "cached_videos",
    """with f as (select distinct source_name, size_bytes, sha256(source_name) as fingerprint from videos), r as (select distinct source_name, case when status = 'ready' then size_bytes end as size_bytes,
      case when status = 'failed' then sha256(source_name) end as fingerprint, video_id from videos)
    select distinct f.source_name, r.video_id as known_id from f join r on f.fingerprint = r.fingerprint or (f.source_name = r.source_name and f.size_bytes = r.size_bytes)""",
)
def cached_videos(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").select("source_name", "size_bytes", "status", "video_id").distinct()
    files = v.select("source_name", "size_bytes", F.sha2("source_name", 256).alias("fingerprint")).distinct()
    known = v.select(
        "source_name", F.when(F.col("status") == "ready", F.col("size_bytes")).alias("size_bytes"), F.when(F.col("status") == "failed", F.sha2("source_name", 256)).alias("fingerprint"), "video_id"
    )
    return media.cached(files, known).select("source_name", "known_id").distinct()


@query(
    "longest_run",
    """with x as (select vec_id, i, embedding[i] > 0 as f from embeddings, range(1, 65) t(i)),
    y as (select *, i - row_number() over (partition by vec_id, f order by i) as g from x)
    select vec_id, cast(coalesce(max(n), 0) as int) as run from (select vec_id, count(*) filter (f) as n from y group by vec_id, f, g) group by 1""",
)
def longest_run(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", arrays.longest_run(F.transform("embedding", lambda x: x > 0)).alias("run"))


@query("upper_median_rms", "select vec_id, list_sort(embedding)[len(embedding) // 2 + 1] as median, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) / len(embedding)), 5) as rms from embeddings")
def upper_median_rms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", arrays.upper_median(F.col("embedding")).alias("median"), F.round(arrays.root_mean_square(F.col("embedding")), 5).alias("rms"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A box per vector, from its first four numbers in thousandths."""
    at = lambda i: F.floor(F.abs(F.element_at("embedding", i)) * 1000).cast("int")
    box = F.array(at(1), at(2), at(1) + at(3) + 1, at(2) + at(4) + 1)
    return table(spark, folder, "embeddings").select("vec_id", "label", box.alias("box"), F.abs(F.element_at("embedding", 5)).cast("double").alias("confidence"))


@query(
    "iou_pairs",
    """with b as (select vec_id, cast(floor(abs(embedding[1]) * 1000) as int) as x1, cast(floor(abs(embedding[2]) * 1000) as int) as y1,
      cast(floor(abs(embedding[3]) * 1000) as int) + 1 as w, cast(floor(abs(embedding[4]) * 1000) as int) + 1 as h from embeddings),
    p as (select a.vec_id, greatest(0, least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1)) * greatest(0, least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1)) as shared,
      a.w * a.h + b.w * b.h as total from b a join b on b.vec_id = a.vec_id + 1)
    select vec_id, round(cast(shared as double) / (total - shared), 5) as iou from p""",
)
def iou_pairs(spark: SparkSession, folder: str) -> DataFrame:
    a = _boxes(spark, folder).select("vec_id", "box")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("box").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(arrays.iou(F.col("box"), F.col("other")), 5).alias("iou"))


_BYTES = "encode(text)"


@query(
    "content_sha256",
    f"""select doc_id, sha256(encode(cast(octet_length({_BYTES}) as varchar)) || {_BYTES}[1:1048576]
      || case when octet_length({_BYTES}) > 2097152 then {_BYTES}[octet_length({_BYTES}) - 1048575:octet_length({_BYTES})] else ''::blob end) as print from documents""",
)
def content_sha256(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of every document, null where there is no text."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", media.fingerprint(F.col("text").cast("binary"), F.octet_length("text")).alias("print"))


@query(
    "video_transcripts",
    with_graph(
        """select video_id, string_agg('## ' || coalesce(local_id, id) || '  ' || printf('%02d:%02d', coalesce(start_ms, 0) // 60000, coalesce(start_ms, 0) // 1000 % 60) || '–' || printf('%02d:%02d', coalesce(end_ms, 0) // 60000, coalesce(end_ms, 0) // 1000 % 60)
          || chr(10) || chr(10) || coalesce(nullif(regexp_replace(transcript, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g'), ''), '(no speech)'), chr(10) || chr(10) order by idx nulls first, id) || chr(10) as value from clip group by 1"""
    ),
)
def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return video_transcripts(graph(spark, folder).node("clip", "id", "video_id", "local_id", "index", "start_ms", "end_ms", "transcript"))


@query(
    "hop_windows",
    """with e as (select epoch(ts) as s, event_type from events), w as (select s, event_type, cast(floor(s / 170) as bigint) - i as k from e, range(0, 2) t(i))
    select k * 170 as from_s, event_type as kind, count(*) as n from w where s >= k * 170 and s < k * 170 + 180 group by 1, 2""",
)
def hop_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return hop_counts(e, "ts", "event_type").select(F.unix_timestamp("window_start").alias("from_s"), "kind", "n")


@query(
    "audio_signals",
    """with s as (select vec_id, list_transform(embedding, lambda x: pow(cast(trunc(x * 8000::float) as double), 2)) as q from embeddings),
    f as (select vec_id, i, sqrt(list_sum(list_transform(range(i * 800, i * 800 + 800), lambda k: q[k % 64 + 1])) / 800) / 32768 as r from s, range(0, 7) t(i)),
    m as (select vec_id, list_sort(list(r))[4] as median, max(r) as peak, list_position(list(r order by i), max(r)) as place from f group by 1),
    g as (select f.vec_id, i, i - row_number() over (partition by f.vec_id order by i) as island from f join m using (vec_id) where r >= greatest(median * 4, 0.08::double)),
    l as (select vec_id, max(n) as run from (select vec_id, count(*) as n from g group by vec_id, island) group by 1)
    select vec_id, round(least(sqrt(list_sum(q) / 64) / 32768 * 8, 1), 3) as loudness, round(greatest(0, least(1, (peak / greatest(median, 1e-4::double) - 4) / 8)), 3) as loud_impact,
      round(least(coalesce(run, 0) * 0.05::double / 2, 1), 3) as loud_speech, cast(floor((place - 1) * 50) as int) as impact_at_ms from s join m using (vec_id) left join l using (vec_id)""",
)
def audio_signals(spark: SparkSession, folder: str) -> DataFrame:
    samples = F.flatten(F.array_repeat(F.transform("embedding", lambda x: (x * 8000).cast("smallint")), 100))
    return table(spark, folder, "embeddings").select("vec_id", arrays.audio_signals(samples).alias("a")).select("vec_id", "a.*")


@query("nms_pandas")
def nms_pandas(spark: SparkSession, folder: str) -> DataFrame:
    return detect.suppress_boxes(_boxes(spark, folder).withColumnRenamed("label", "cell_id")).select("cell_id", "vec_id", "confidence")


_ENTITY_SQL = """e as (select cast(label as varchar) as clip_id, 'v' || (label % 3) as video_id, case vec_id % 3 when 0 then 'person' when 1 then 'vehicle' else 'object' end as type,
  case vec_id % 5 when 0 then 'Car' when 1 then 'boat' when 2 then 'bench' when 3 then 'person' else 'surfboard' end as label, cast(abs(embedding[5]) as double) as confidence, cast(vec_id % 6 as int) as cell_index, vec_id from embeddings),
  scene as (select video_id, count(*) filter (lower(label) in ('car', 'truck', 'bus', 'motorcycle', 'bicycle', 'traffic light', 'stop sign')) as land, count(*) filter (lower(label) in ('boat', 'surfboard')) as water from e group by 1),
  kept as (select e.* from e join scene using (video_id) where not (land >= water and land > 0 and lower(label) in ('boat', 'train', 'airplane', 'bird', 'bench', 'skis', 'snowboard', 'surfboard'))
    and not (type = 'object' and coalesce(confidence, 0) < 0.45))"""


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of five labels over three videos, from the vectors."""
    n = lambda k: (F.col("vec_id") % k + 1).cast("int")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), n(len(names)))
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("clip_id"), F.concat(F.lit("v"), (F.col("label") % 3).cast("string")).alias("video_id"), pick("person", "vehicle", "object").alias("type"),
        pick("Car", "boat", "bench", "person", "surfboard").alias("label"), F.abs(F.element_at("embedding", 5)).cast("double").alias("confidence"), (F.col("vec_id") % 6).cast("int").alias("cell_index"), "vec_id",
    )


@query("scene_prior", f"with {_ENTITY_SQL} select video_id, land, water, case when land >= water and land > 0 then 'land' else 'other' end as scene from scene")
def scene_prior(spark: SparkSession, folder: str) -> DataFrame:
    return rules.scene_prior(_entities(spark, folder))


@query("denoise", f"with {_ENTITY_SQL} select vec_id, label from kept")
def denoise(spark: SparkSession, folder: str) -> DataFrame:
    e = _entities(spark, folder)
    return rules.denoise(e, rules.scene_prior(e)).select("vec_id", "label")


@query(
    "entity_inventory",
    f"""with {_ENTITY_SQL}, cell as (select clip_id, cell_index, count(*) filter (type = 'person') + sum(confidence) / 10 as score from e group by 1, 2),
    best as (select clip_id, cell_index as best_cell from (select *, row_number() over (partition by clip_id order by score desc, cell_index) as n from cell) where n = 1),
    one as (select *, row_number() over (partition by clip_id, type, label order by confidence desc, cell_index) as n from e),
    placed as (select clip_id, type, label, confidence, cell_index, type || '_' || row_number() over (partition by clip_id, type order by confidence desc, cell_index, label) as local_id from one where n = 1)
    select p.*, best_cell from placed p join best using (clip_id)""",
)
def entity_inventory(spark: SparkSession, folder: str) -> DataFrame:
    e = _entities(spark, folder)
    return rules.inventory(e.withColumn("box", F.lit(None).cast("array<int>"))).drop("box").join(rules.best_cell(e), "clip_id")


@query(
    "clip_counts",
    f"""with {_ENTITY_SQL} select clip_id, count(*) filter (type = 'person') as person_count, count(*) filter (type = 'vehicle') as vehicle_count, count(*) filter (type = 'object') as object_count,
    coalesce(array_to_string(list_sort(list_distinct(list(label) filter (type in ('vehicle', 'object')))), ','), '') as object_labels,
    coalesce(array_to_string(list_sort(list_distinct(list(label) filter (type = 'person' and label <> ''))), ','), '') as clothing_colors,
    bool_or(type in ('person', 'vehicle') or coalesce(confidence, 0) < 0.5 or label in ('knife', 'cell phone', 'backpack', 'suitcase')) as needs_vision from e where type <> 'person' or vec_id % 2 = 0 group by 1""",
)
def clip_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = _entities(spark, folder).where("type <> 'person' or vec_id % 2 = 0")
    return flat(rules.clip_counts(e.withColumn("clothes", F.when(F.col("type") == "person", F.col("label")))))


@query(
    "roster_search",
    with_graph(
        """select id, local_id as person_id, case when is_cop then 'officer' when potential_suspect then 'potential_suspect' else 'civilian' end as role from person where is_cop is distinct from true
        and (contains(lower(coalesce(clothes, '')), 'red') or contains('red', lower(coalesce(clothes, '')))) and (contains(lower(coalesce(hair, '')), 'brown') or contains('brown', lower(coalesce(hair, ''))))"""
    ),
)
def roster_search(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.roster import public_people, search_people

    p = graph(spark, folder).node("person", "id", "local_id", "role", "is_cop", "clothes", "hair")
    return public_people(search_people(p, is_cop=False, clothes="Red", hair="brown", glasses="unknown")).select("id", "person_id", "role")


@query(
    "roster_search_things",
    with_graph(
        """select 'vehicle' as kind, id, color as what from vehicle where contains(lower(coalesce(color, '')), 'blue') union all select 'plate', id, text from plate where contains(text, 'K7')
        union all select 'object', id, label from object where contains(lower(label), 'kit') union all
        select 'event', id, type from (select * from event where type = 'door_knock' order by start_ms desc nulls last, id desc limit 20)"""
    ),
)
def roster_search_things(spark: SparkSession, folder: str) -> DataFrame:
    from .plans import roster

    g = graph(spark, folder)
    named = lambda kind, df, what: df.select(F.lit(kind).alias("kind"), "id", F.col(what).alias("what"))
    cars = roster.search_vehicles(g.node("vehicle", "id", "color", "plate"), color="Blue")
    plates = roster.search_plates(g.node("plate", "id", "text"), "k7")
    objects = roster.search_objects(g.node("object", "id", "label", "distinctive"), label="KIT")
    events = roster.last_events(g.node("event", "id", "type", "start_ms"), "door_knock")
    return named("vehicle", cars, "color").unionAll(named("plate", plates, "text")).unionAll(named("object", objects, "label")).unionAll(named("event", events, "type"))


@query(
    "media_paths_moved",
    "select distinct video_id, case when starts_with(original_uri, '/data/in/') then '/mnt/media/' || substring(original_uri, 10) else original_uri end as original_uri from videos",
)
def media_paths_moved(spark: SparkSession, folder: str) -> DataFrame:
    from .sources.sinks import move_uris

    return move_uris(table(spark, folder, "videos").select("video_id", "original_uri").distinct(), "/data/in/", "/mnt/media/")


@query("remapped_ids", with_graph("select distinct src_id, case when x = 'person_1' then 'person_01' else x end as person from (select id as src_id, unnest(people_ids) as x from event) where x is not null"))
def remapped_ids(spark: SparkSession, folder: str) -> DataFrame:
    e = graph(spark, folder).node("event", "id", "people_ids").select(F.col("id").alias("src_id"), F.explode("people_ids").alias("x")).where("x is not null")
    mapping = F.create_map(F.lit("person_1"), F.lit("person_01"))
    return e.select("src_id", text.remap(F.col("x"), mapping).alias("person")).distinct()


@query(
    "vlm_merge_canned",
    """with c as (select id, summary, summary_source from (select *, row_number() over (partition by id order by written_at desc, summary desc nulls last) as place from clips where id is not null) where place = 1)
    select id, 'seen ' || id as summary, 'model' as summary_source, 'speech,car' as tags, 'KL8421' as plates from c""",
)
def vlm_merge_canned(spark: SparkSession, folder: str) -> DataFrame:
    c = graph(spark, folder).node("clip", "id", "summary", "summary_source")
    c = c.withColumn("tags", F.array(F.lit("speech"))).withColumn("plates", F.array().cast("array<string>"))
    told = F.concat(F.lit('Sure: {"summary": "seen '), F.col("id"), F.lit('", "tags": ["speech", "car"], "plates": ["kl-8421"], "vehicles": []} done'))
    out = vision.merge_answers(c, c.select("id", told.alias("answer"))).drop("answered_events")
    return out.withColumns({k: F.array_join(k, ",") for k in ("tags", "plates")})


def _sightings(spark: SparkSession, folder: str) -> DataFrame:
    cards = table(spark, folder, "people_cards").dropDuplicates(["card_id"])
    index = F.coalesce(F.nullif(F.regexp_extract("first_clip", "([0-9]+)$", 1), F.lit("")), F.lit("0")).cast("int")
    return cards.withColumn("clip_index", index).withColumn("position", F.col("card_id")).withColumn("sighting_id", F.col("card_id").cast("string"))


_KNOWN = [k for k in text.SIGNATURE]
_SAME = "{0} <> '' and {1} <> '' and (contains({0}, {1}) or contains({1}, {0}))"


def _identity_sql() -> str:
    """The fold as a recursive statement: the state of a video is the list of its cards."""
    told = {k: (f"coalesce({_STRIP.format(k)}, '')" if k in identity.AS_TOLD else _clean_sql(k, "unknown")) for k in identity.ATTRIBUTES if k != "race"} | {"race": "'unknown'"}
    compared = {k: f"case when {_clean_sql(f't_{k}')} = 'unknown' then '' else {_clean_sql(f't_{k}')} end" for k in _KNOWN}
    rows = f"""read as (select video_id, card_id, coalesce(cast(nullif(regexp_extract(first_clip, '([0-9]+)$', 1), '') as int), 0) as ci, case when is_cop then 1 when not is_cop then -1 else 0 end as cop,
      {", ".join(f"{e} as t_{k}" for k, e in told.items())} from (select distinct on (card_id) * from people_cards) where video_id is not null),
    seen as (select *, row_number() over (partition by video_id order by ci, card_id) as n, {_clean_sql("t_clothes")} as worn, {", ".join(f"{e} as c_{k}" for k, e in compared.items())} from read)"""
    fields = [*(f"t_{k}" for k in identity.ATTRIBUTES), *(f"c_{k}" for k in _KNOWN), "worn"]
    first = "{" + ", ".join(f"'{f}': {f}" for f in fields) + ", 'cop': cop, 'first': ci, 'last': ci}"
    points = " + ".join(f"{identity.POINTS[k]} * cast({_SAME.format(f'c.c_{k}', f'c_{k}')} as int)" for k in _KNOWN)
    takes = {k: f"t_{k} not in ('', 'unknown') and (c.t_{k} in ('', 'unknown') {f'or length(t_{k}) > length(c.t_{k})' if k in identity.LONGER else ''})" for k in identity.ATTRIBUTES}
    of = {f"t_{k}": k for k in identity.ATTRIBUTES} | {f"c_{k}": k for k in _KNOWN} | {"worn": "clothes"}
    filled = "{" + ", ".join(f"'{f}': case when {takes[of[f]]} then {f} else c.{f} end" for f in fields) + ", 'cop': case when cop > 0 or c.cop = 0 then cop else c.cop end, 'first': c.first, 'last': ci}"
    filled = filled.replace("cop > 0 or c.cop = 0 then cop", "cop > 0 or c.cop = 0 and cop <> 0 then cop")
    marked = " or ".join(f"({_SAME.format(f'cards[best].c_{k}', f'c_{k}')})" for k in identity.MARKS)
    said = " or ".join(f"c_{k} <> ''" for k in _KNOWN)
    return f"""with recursive {rows},
    fold as (select distinct video_id, cast(0 as bigint) as n, list_filter([{first.replace(": c_", ": '' || c_")}], lambda c: false) as cards from (select distinct on (video_id) * from seen)
      union all select video_id, n, case when hit is null then list_append(cards, {first}) else list_transform(cards, lambda c, i: case when i = hit then {filled} else c end) end from (
        select *, case when not ({said}) then null when most >= 3 then best when most = 2 and ({marked}) and ({_SAME.format("cards[best].worn", "worn")}) then best end as hit from (
          select *, list_max(points) as most, list_position(points, list_max(points)) as best from (
            select f.cards, s.*, list_transform(f.cards, lambda c: case when c.cop * s.cop < 0 then 0 else {points} end) as points from fold f join seen s on s.video_id = f.video_id and s.n = f.n + 1)))),
    last as (select video_id, max_by(cards, n) as cards from fold group by 1),
    one as (select video_id, unnest(cards) as c, generate_subscripts(cards, 1) as i from last)
    select video_id, 'person_' || i as local_id, case when c.cop <> 0 then c.cop > 0 end as is_cop, {", ".join(f"c.t_{k} as {k}" for k in identity.ATTRIBUTES)}, c.first as first_clip, c.last as last_clip from one"""


IDENTITY = _identity_sql()


@query("identity_fold", IDENTITY)
def identity_fold(spark: SparkSession, folder: str) -> DataFrame:
    """People of every video, matched over all their cards in order."""
    cards = identity.cards_of(identity.fold_people(_sightings(spark, folder)))
    return cards.select("video_id", "local_id", "is_cop", *identity.ATTRIBUTES, "first_clip", "last_clip")


@query("identity_assignments")
def identity_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return identity.assignments_of(identity.fold_people(_sightings(spark, folder)))


THINGS = with_graph(
    f""", sighted as (select e.video_id, cast(nullif(regexp_extract(e.clip_id, '([0-9]+)$', 1), '') as int) as ci, coalesce(v.color, '') as color, v.plate, coalesce({_STRIP.format("v.analysis")}, '') as analysis,
      row_number() over (partition by e.video_id order by cast(nullif(regexp_extract(e.clip_id, '([0-9]+)$', 1), '') as int) nulls first, e.id, e.id || '#' || v.id) as n
      from (select distinct src_id, dst_id from involves where kind = 'vehicle') i join event e on e.id = i.src_id join vehicle v on v.id = i.dst_id where e.video_id is not null),
    fold as (select distinct video_id, cast(0 as bigint) as n, list_filter([{{'color': '', 'plate': '', 'analysis': '', 'first': cast(0 as int), 'last': cast(0 as int)}}], lambda c: false) as cards from sighted
      union all select video_id, n, case when hit is null then list_append(cards, {{'color': color, 'plate': plate, 'analysis': analysis, 'first': ci, 'last': ci}})
        else list_transform(cards, lambda c, i: case when i = hit then {{'color': case when c.color = '' then color else c.color end, 'plate': case when plate <> '' then plate else c.plate end,
          'analysis': case when length(analysis) > length(c.analysis) then analysis else c.analysis end, 'first': c.first, 'last': ci}} else c end) end from (
        select *, coalesce(case when plate <> '' then list_position(list_transform(cards, lambda c: c.plate), plate) end,
          case when color <> '' then list_position(list_transform(cards, lambda c: c.color || '|' || c.plate), color || '|') end) as hit
        from (select f.cards, s.* from fold f join sighted s on s.video_id = f.video_id and s.n = f.n + 1))),
    last as (select video_id, max_by(cards, n) as cards from fold group by 1),
    one as (select video_id, unnest(cards) as c, generate_subscripts(cards, 1) as i from last)
    select video_id, 'vehicle' as kind, 'vehicle_' || i as local_id, c.color, c.plate, c.analysis, cast(null as varchar) as vehicle_id, c.first as first_clip, c.last as last_clip from one
    union all select video_id, 'plate', 'plate_' || c.plate, null, c.plate, null, 'vehicle_' || i, null, c.last from one where c.plate <> ''""",
    recursive=True,
)


@query("identity_things", THINGS)
def identity_things(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicles as events mention them, in order, with the colour and plate of their card; and the plates they bring."""
    g = graph(spark, folder)
    cars = g.node("vehicle", "id", "local_id", "color", "plate", "analysis").withColumnRenamed("id", "dst_id")
    seen = g.edge("involves", "event", "vehicle", role=False).withColumnRenamed("src_id", "id").join(g.node("event", "id", "video_id", "clip_id"), "id").join(cars, "dst_id")
    index = F.nullif(F.regexp_extract("clip_id", "([0-9]+)$", 1), F.lit("")).cast("int")
    rows = seen.withColumns({"clip_index": index, "position": F.col("id"), "sighting_id": F.concat_ws("#", "id", "dst_id"), "kind": F.lit("vehicle"), "claimed_id": F.lit(None).cast("string")})
    return identity.cards_of(identity.fold_things(rows)).select("video_id", "kind", "local_id", "color", "plate", "analysis", "vehicle_id", F.when(F.col("kind") == "vehicle", F.col("first_clip")).alias("first_clip"), "last_clip")
