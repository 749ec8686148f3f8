"""Registered queries over the footage graph: every block, output and ready-made question, with their SQL twins.

The twins are written from what a block or question means, over tables that are derived from the raw ones in
SQL; nested results are compared as sorted texts (``twins.flat``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import windows
from .plans import dml, fixed
from .plans.blocks import assemble
from .plans.catalog import Catalog
from .plans.graph import FootageGraph, clip_chain, graph_of_tables
from .queries import query
from .sources.tables import table
from .twins import EVENTS, PEOPLE, SUBJECTS, TOPICS, flat, listing, shown, with_graph


def graph(spark: SparkSession, folder: str) -> FootageGraph:
    return graph_of_tables(spark, folder, SUBJECTS)


def blocks(name: str, spec: str, sql: str, catalog: bool = False) -> None:
    """Registers a pipeline as a query."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        known = Catalog.of_table(table(spark, folder, "event_catalog")) if catalog else None
        return flat(assemble(graph(spark, folder), spec, known))

    query(name, with_graph(sql))(run)


_EVENT = f"e.id as event_id, e.video_id, e.source_name, e.type as event_type, {shown('e', 'start')} as start_timestamp, {shown('e', 'end')} as end_timestamp, e.seek_s, e.summary"
_NO_URI = "cast(null as varchar) as clip_uri, cast(null as varchar) as splice_uri, cast(null as varchar) as tagged_splice_uri"
_CLIP = f"c.local_id as clip, {_NO_URI}"
_OF_CLIP = "left join contains k on k.kind = 'event' and k.dst_id = e.id left join clip c on c.id = k.src_id"
_OF_PEOPLE = "left join on_event p on p.src_id = e.id"
_OF_TOPIC = "left join topic_of t on t.type = e.type"


def _involved(kind: str, alias: str) -> str:
    return f"left join involves i{alias} on i{alias}.kind = '{kind}' and i{alias}.src_id = e.id left join {kind} {alias} on {alias}.id = i{alias}.dst_id"


# Sources and filters
blocks("block_events", "events", f"select {_EVENT} from event e")
blocks("block_event_type", "events | event_type door_knock", f"select {_EVENT} from event e where e.type = 'door_knock'")
blocks("block_video", "events | video v_harbor_gate_fixed", f"select {_EVENT} from event e where e.video_id = 'v_harbor_gate_fixed'")
blocks("block_timeframe", "events | timeframe start=01:00 end=15:00 | return_events", f"select {_EVENT} from event e where e.seek_s between 60 and 900")
blocks("events_at_time_30s", "events | at_time 10:00", f"select {_EVENT} from event e where abs(e.seek_s - 600) <= 30")
blocks(
    "block_topic",
    "events | topic query='find all interview events' | with_topic | return_events",
    f"""select {_EVENT}, {TOPICS} as topics from event e {_OF_TOPIC} where e.type in (select id from event_catalog where contains(lower(id), 'interview') or contains(lower(title), 'interview')
    or len(list_filter(aliases, lambda a: contains(lower(a), 'interview') or contains('interview', lower(a)))) > 0 or contains('interview', lower(title)) or contains('interview', split_part(id, '_', 1))
    or split_part(id, '_', 1) in (select split_part(id, '_', 1) from event_catalog where contains('interview', split_part(id, '_', 1)) or contains(split_part(id, '_', 1), 'interview'))) group by all""",
    catalog=True,
)
_PERSON = "p.local_id as person_id, p.video_id, p.role, p.is_cop, p.potential_suspect, p.clothes, p.description, p.suspect_snapshot as snapshot, p.suspect_at, p.suspect_event"
blocks("block_people", "people", f"select {_PERSON} from person p")
blocks("block_role", "people | role officer", f"select {_PERSON} from person p where role = 'officer'")
blocks("block_potential_suspect", "people | potential_suspect", f"select {_PERSON} from person p where potential_suspect")
blocks("block_is_cop", "people | is_cop", f"select {_PERSON} from person p where is_cop")
blocks("block_clothes", "people | clothes RED", f"select {_PERSON} from person p where contains(lower(clothes), 'red')")
blocks("block_person_id", "people | person_id person_1", f"select {_PERSON} from person p where local_id = 'person_1' or suffix(id, 'person_1')")
_VEHICLE = "v.id as vehicle_id, v.video_id, v.color, v.plate, v.analysis"
blocks("block_vehicles", "vehicles", f"select {_VEHICLE} from vehicle v")
blocks("vehicles_by_color", "vehicles | vehicle_color red", f"select {_VEHICLE} from vehicle v where contains(color, 'red')")
blocks("block_plate_of_vehicles", "vehicles | plate k7", f"select {_VEHICLE} from vehicle v where contains(plate, 'K7')")
_PLATE = "pl.text as plate, pl.confidence, pl.video_id, v.color as vehicle_color, v.id as vehicle_id from plate pl left join vehicle v on v.video_id = pl.video_id and v.plate = pl.text"
blocks("block_plates", "plates", f"select {_PLATE}")
blocks("block_plate", "plates | plate k7 | video v_harbor_gate_fixed", f"select {_PLATE} where contains(pl.text, 'K7') and pl.video_id = 'v_harbor_gate_fixed'")
_OBJECT = "o.local_id as object_id, o.video_id, o.label, o.distinctive"
blocks("block_objects", "objects", f"select {_OBJECT} from object o")
blocks("block_object_label", "objects | object_label KIT", f"select {_OBJECT} from object o where contains(lower(label), 'kit')")
_CLIP_ROW = f"c.video_id, c.local_id as clip, {shown('c', 'start')} as start_timestamp, {shown('c', 'end')} as end_timestamp, c.summary, {_NO_URI}"
blocks("block_clips", "clips", f"select {_CLIP_ROW}, cast(null as varchar) as audio_uri from clip c")
blocks("block_transcript", "clips | transcript 'Watch the STEP'", f"select {_CLIP_ROW}, cast(null as varchar) as audio_uri from clip c where contains(lower(transcript), 'watch the step')")
_PEOPLE_OF = "(select count(*) from person p where p.video_id = v.id) as people"
blocks("block_videos", "videos", f"select v.id as video_id, v.source_name, v.duration_s, v.clip_count, v.status, {_PEOPLE_OF} from video v")

# Joins
blocks("block_with_clip", "events | with_clip", f"select {_EVENT}, {_CLIP} from event e {_OF_CLIP}")
blocks("with_people_collect", "events | with_people | return_events", f"select {_EVENT}, {PEOPLE} as people from event e {_OF_PEOPLE} group by all")
blocks("block_with_vehicles", "events | with_vehicles", f"select {_EVENT}, {listing('v.id', 'v.color', 'v.plate')} as vehicles from event e {_involved('vehicle', 'v')} group by all")
blocks("block_with_objects", "events | with_objects", f"select {_EVENT}, {listing('o.local_id', 'o.label')} as objects from event e {_involved('object', 'o')} group by all")
blocks("with_topic_two_hop", "events | with_topic", f"select {_EVENT}, {TOPICS} as topics from event e {_OF_TOPIC} group by all")
blocks(
    "block_continues",
    "events | continues",
    f"""select {_EVENT}, coalesce(array_to_string(list_sort(list_distinct(list({shown('n', 'start')}) filter (n.id is not null))), ','), '') as continues_to
    from event e left join continues k on k.src_id = e.id left join event n on n.id = k.dst_id group by all""",
)
blocks(
    "block_all_joins",
    "events | event_type door_knock | with_clip | with_people | with_vehicles | with_objects | with_topic | return_events",
    f"""select {_EVENT}, {_CLIP}, {PEOPLE} as people, {listing('v.id', 'v.color', 'v.plate')} as vehicles, {listing('o.local_id', 'o.label')} as objects, {TOPICS} as topics
    from event e {_OF_CLIP} {_OF_PEOPLE} {_involved('vehicle', 'v')} {_involved('object', 'o')} {_OF_TOPIC} where e.type = 'door_knock' group by all""",
)
blocks("involving_person_inner", "events | involving_person person_1", f"select {_EVENT}, {PEOPLE} as people from event e join on_event p on p.src_id = e.id where p.local_id = 'person_1' or suffix(p.id, 'person_1') group by all")
blocks(
    "involving_object_inner",
    "events | involving_object kit",
    f"select {_EVENT}, {listing('o.local_id', 'o.label')} as objects from event e join involves i on i.kind = 'object' and i.src_id = e.id join object o on o.id = i.dst_id where contains(lower(o.label), 'kit') group by all",
)
_ALSO = "left join involves i on i.dst_id = {0}.id left join event e on e.id = i.src_id"
blocks("reverse_with_events", "people | with_events", f"select * exclude (id) from (select p.id, {_PERSON}, {EVENTS} as events from person p {_ALSO.format('p')} group by all)")
blocks("reverse_with_events_objects", "objects | with_events", f"select {_OBJECT}, {EVENTS} as events from object o {_ALSO.format('o')} group by all")
blocks("reverse_with_events_vehicles", "vehicles | with_events", f"select {_VEHICLE} from vehicle v {_ALSO.format('v')}")

# Outputs that count
blocks("count_events_by_type", "events | count_by_type", "select type as event_type, count(*) as n from event group by 1")
blocks("count_events_by_video", "events | count_by_video", "select video_id, source_name, type as event_type, count(*) as n from event group by 1, 2, 3")
blocks("count_after_fanout", "events | with_people | count", "select count(*) as n from event e left join on_event p on p.src_id = e.id")
blocks("officers_by_video", "events | with_people | role officer | count_by_video", "select e.video_id, e.source_name, e.type as event_type, count(*) as n from event e join on_event p on p.src_id = e.id where p.role = 'officer' group by 1, 2, 3")

# Recipes
blocks("recipe_count_events", "count_events", "select type as event_type, count(*) as n from event group by 1")
blocks(
    "recipe_events_in_timeframe",
    "events_in_timeframe start=02:00 end=08:00 video_id=v_harbor_gate_fixed",
    f"select {_EVENT}, {_CLIP}, {PEOPLE} as people from event e {_OF_CLIP} {_OF_PEOPLE} where e.seek_s between 120 and 480 and e.video_id = 'v_harbor_gate_fixed' group by all",
)
blocks("recipe_suspects", "suspects", f"select * exclude (id) from (select p.id, {_PERSON}, {EVENTS} as events from person p {_ALSO.format('p')} where p.potential_suspect group by all)")
blocks("recipe_person_timeline", "person_timeline person_id=person_3", f"select * exclude (id) from (select p.id, {_PERSON}, {EVENTS} as events from person p {_ALSO.format('p')} where p.local_id = 'person_3' or suffix(p.id, 'person_3') group by all)")
blocks("recipe_objects", "objects label=kit", f"select {_OBJECT}, {EVENTS} as events from object o {_ALSO.format('o')} where contains(lower(o.label), 'kit') group by all")
blocks("recipe_list_videos", "list_videos", f"select v.id as video_id, v.source_name, v.duration_s, v.clip_count, v.status, {_PEOPLE_OF} from video v")


def question(name: str, sql: str, ask) -> None:
    """Registers a ready-made question as a query."""
    query(name, sql)(lambda spark, folder: flat(ask(graph(spark, folder))))


_ROWS = f"select {_EVENT}, {_CLIP}, {PEOPLE} as people from event e {_OF_CLIP} {_OF_PEOPLE}"
question("count_events", with_graph("select type as event_type, count(*) as n from event where video_id = 'v_harbor_gate_fixed' group by 1"), lambda g: fixed.count_events(g, "", "v_harbor_gate_fixed"))
question(
    "events_in_timeframe",
    with_graph(f"select {_EVENT}, '' as subject_ids, {_CLIP}, {PEOPLE} as people from event e {_OF_CLIP} {_OF_PEOPLE} where e.seek_s between 60 and 900 group by all"),
    lambda g: fixed.events_in_timeframe(g, 60, 900),
)
question("events_by_type", with_graph(f"{_ROWS} where e.type = 'door_knock' group by all"), lambda g: fixed.events_by_type(g, "door_knock"))
question(
    "events_by_types_topic",
    with_graph(f"select {_EVENT}, {_CLIP}, {PEOPLE} as people, {TOPICS} as topics from event e {_OF_CLIP} {_OF_PEOPLE} {_OF_TOPIC} where e.type in ('door_knock', 'gate_entry') group by all"),
    lambda g: fixed.events_by_types(g, ["door_knock", "gate_entry"]),
)
question(
    "event_at_time_top8",
    with_graph(
        f"""select * exclude (source_name) from (select {_EVENT}, abs(e.seek_s - 600) as seconds_from_query, {PEOPLE} as people
        from (select * from event where seek_s is not null order by abs(seek_s - 600), id limit 8) e {_OF_PEOPLE} group by all)"""
    ),
    lambda g: fixed.event_at_time(g, 600),
)
question(
    "participants_heterogeneous",
    with_graph(
        f""", parts as (select src_id, 'person' as kind, id as participant_id, local_id as name, edge_role as role, clothes, description, null as plate, distinctive from on_event
           union all select i.src_id, 'vehicle', v.id, coalesce(v.local_id, v.color), null, null, null, v.plate, null from involves i join vehicle v on i.kind = 'vehicle' and v.id = i.dst_id
           union all select i.src_id, 'object', o.id, o.local_id, null, null, null, null, o.distinctive from involves i join object o on i.kind = 'object' and o.id = i.dst_id)
        select e.id as event_id, e.video_id, e.type as event_type, {shown("e", "start")} as start_timestamp, {shown("e", "end")} as end_timestamp, e.summary,
          kind, participant_id, name, role, clothes, description, plate, distinctive from event e left join parts on parts.src_id = e.id where e.type = 'door_knock' and e.start_timestamp = '10:27'"""
    ),
    lambda g: fixed.event_participants(g, "door_knock", "10:27"),
)
_FOUND = "id, video_id, local_id as person_id, role, is_cop, potential_suspect, clothes, cast(null as varchar) as race, gender, description, suspect_snapshot, suspect_at, suspect_event"
question("find_people_optional_filters", with_graph(f"select {_FOUND} from person where contains(lower(clothes), 'red') and is_cop = false"), lambda g: fixed.find_people(g, clothes="RED", is_cop=False))
question("find_people_suspects", with_graph(f"select {_FOUND} from person where role = 'potential_suspect' and potential_suspect"), lambda g: fixed.find_people(g, role="potential_suspect", potential_suspect=True))
question(
    "optional_predicate_in_on",
    with_graph(
        f"""select p.id, p.video_id, p.local_id as person_id, p.clothes, p.description, p.suspect_snapshot as snapshot, p.suspect_reason as reason, p.suspect_at as first_tagged_at,
        p.suspect_event as first_tagged_event, {listing("e.type", shown("e", "start"))} as events from person p left join involves i on i.dst_id = p.id and i.role = 'potential_suspect'
        left join event e on e.id = i.src_id where p.potential_suspect group by all"""
    ),
    fixed.find_potential_suspects,
)
question(
    "person_timeline_inner",
    with_graph(
        f"""select p.id as person, p.local_id as person_id, p.role as person_role, e.id as event_id, e.video_id, e.type as event_type, {shown("e", "start")} as start_timestamp,
        {shown("e", "end")} as end_timestamp, e.seek_s, e.summary, p.edge_role as involves_role from event e join on_event p on p.src_id = e.id where p.local_id = 'person_3' or suffix(p.id, 'person_3')"""
    ),
    lambda g: fixed.person_timeline(g, "person_3"),
)
question(
    "find_vehicles_ci_contains",
    with_graph("select id as vehicle_id, video_id, color, plate, analysis, plate as plates from vehicle where contains(lower(color), 'black') and contains(plate, 'K')"),
    lambda g: fixed.find_vehicles(g, "Black", "k"),
)
question("find_plates", with_graph(f"select {_PLATE} where contains(pl.text, 'K')"), lambda g: fixed.find_plates(g, "k"))
question("find_objects", with_graph("select id, video_id, local_id as object_id, label, distinctive from object where contains(lower(label), 'kit')"), lambda g: fixed.find_objects(g, "Kit"))
question(
    "object_appearances_multi_branch",
    with_graph(
        f"""select o.id, o.video_id, o.local_id as object_id, o.label, o.distinctive,
        coalesce((select array_to_string(list_sort(list_distinct(list(c.local_id))), ',') from contains k join clip c on c.id = k.src_id where k.dst_id = o.id), '') as clips,
        (select {listing("e.type", shown("e", "start"))} from involves i join event e on e.id = i.src_id where i.dst_id = o.id) as events from object o where contains(lower(o.label), 'kit')"""
    ),
    lambda g: fixed.object_appearances(g, "kit"),
)
_CLIP_Q = f"select c.id, c.video_id, c.local_id as clip, c.idx as index, {shown('c', 'start')} as start_timestamp, {shown('c', 'end')} as end_timestamp, @, {_NO_URI} from clip c"
question("search_transcript", with_graph(_CLIP_Q.replace("@", "c.summary") + " where contains(lower(transcript), 'watch the step')"), lambda g: fixed.search_transcript(g, "Watch the STEP"))
question("clip_at_timestamp_range", with_graph(_CLIP_Q.replace("@", "c.summary") + " where 300000 between start_ms and end_ms"), lambda g: fixed.clip_at_timestamp(g, "05:00"))
question("clip_attachments", with_graph(_CLIP_Q.replace("@", "cast(null as varchar) as audio_uri") + " where local_id = 'clip_0003' or suffix(id, 'clip_0003')"), lambda g: fixed.clip_attachments(g, "", "clip_0003"))
_CHAIN = f""", step as (select distinct src_id as a, dst_id as b from continues where src_id <> dst_id),
    reach as (select a, b, [a, b] as path from step {{0}} union all select r.a, s.b, list_append(r.path, s.b) from reach r join step s on s.a = r.b where not list_contains(r.path, s.b)),
    pairs as (select a, b, cast(min(len(path) - 1) as int) as hops from reach group by 1, 2)
    select x.video_id, x.type as event_type, a as start_id, b as end_id, {shown("x", "start")} as chain_start, {shown("y", "start")} as chain_end, hops from pairs join event x on x.id = a join event y on y.id = b"""
question("event_chain_paths", with_graph(_CHAIN.format(""), recursive=True), fixed.event_chain)
question("event_chain_of_type", with_graph(_CHAIN.format("where a in (select id from event where type = 'door_knock')"), recursive=True), lambda g: fixed.event_chain(g, "door_knock"))
question(
    "list_videos_count_distinct",
    with_graph(f"select v.id as video_id, v.source_name, v.duration_s, v.clip_count, v.status, {_PEOPLE_OF}, (select count(*) from vehicle x where x.video_id = v.id) as vehicles from video v"),
    fixed.list_videos,
)
question(
    "label_inventory_union",
    with_graph(
        " union all ".join(f"select '{k}' as label, count(*) as n from {k}" for k in ("video", "clip", "event", "person", "vehicle", "plate", "object"))
        + " union all select 'event_type', count(*) from event_catalog union all select 'topic', count(distinct split_part(id, '_', 1)) from event_catalog"
    ),
    fixed.inventory,
)
question("constraint_duplicate_ids", with_graph("select 'event' as label, id, count(*) as n from event group by 2 having count(*) > 1"), FootageGraph.duplicate_ids)

# Edges
question(
    "edges_of_videos",
    with_graph(
        """select 'has_person' as edge, video_id as src_id, id as dst_id from person union all select 'has_vehicle', video_id, id from vehicle union all select 'has_object', video_id, id from object
        union all select 'has_plate', video_id, id from plate union all select 'vehicle_plate', id, video_id || ':plate:' || plate from vehicle where plate <> ''"""
    ),
    lambda g: (
        g.edge("has_person", role=False).select(F.lit("has_person").alias("edge"), "src_id", "dst_id")
        .unionAll(g.edge("has_vehicle", role=False).select(F.lit("has_vehicle"), "src_id", "dst_id"))
        .unionAll(g.edge("has_object", role=False).select(F.lit("has_object"), "src_id", "dst_id"))
        .unionAll(g.edge("has_plate", "video", role=False).select(F.lit("has_plate"), "src_id", "dst_id"))
        .unionAll(g.edge("has_plate", "vehicle", role=False).select(F.lit("vehicle_plate"), "src_id", "dst_id"))
    ),
)
question("edges_contains", with_graph("select src_id, kind as dst_kind, dst_id from contains"), lambda g: g.edge("contains").select("src_id", "dst_kind", "dst_id"))
question("edges_involves_things", with_graph("select src_id, kind as dst_kind, dst_id, role from involves"), lambda g: g.edge("involves").select("src_id", "dst_kind", "dst_id", "role"))
question(
    "edges_of_types",
    with_graph(
        """select 'has_type' as edge, 'clip' as src_kind, clip_id as src_id, type as dst_id from event where type in (select id from event_catalog) and clip_id is not null
        union select 'has_type', 'video', video_id, type from event where type in (select id from event_catalog) and video_id is not null
        union select 'instance_of', 'event', id, type from event where type in (select id from event_catalog)
        union select 'bundles', null, topic, type from topic_of union select 'in_topic', null, type, topic from topic_of"""
    ),
    lambda g: (
        g.edge("has_type").select(F.lit("has_type").alias("edge"), "src_kind", "src_id", "dst_id")
        .unionAll(g.edge("instance_of").select(F.lit("instance_of"), "src_kind", "src_id", "dst_id"))
        .unionAll(g.edge("bundles").select(F.lit("bundles"), "src_kind", "src_id", "dst_id"))
        .unionAll(g.edge("in_topic").select(F.lit("in_topic"), "src_kind", "src_id", "dst_id"))
    ),
)
question(
    "next_chain",
    with_graph("select * from (select id as src_id, lead(id) over (partition by video_id order by idx nulls first, start_ms nulls first, id) as dst_id from clip) where dst_id is not null"),
    lambda g: clip_chain(g.node("clip", "id", "video_id", "index", "start_ms"))[1],
)
question(
    "starts_at",
    with_graph("select video_id as src_id, id as dst_id from (select *, row_number() over (partition by video_id order by idx nulls first, start_ms nulls first, id) as place from clip) where place = 1"),
    lambda g: g.edge("starts_at").select("src_id", "dst_id"),
)

# Corrections
NOTE, AT = "the user asked for this correction", "2024-06-01T00:00:00Z"
_KNOCK = "(select min(id) from event where type = 'door_knock')"


def _first(g: FootageGraph, kind: str, *where: tuple[str, str]) -> str:
    df = g.node(kind, "id", *[c for c, _ in where])
    for c, v in where:
        df = df.where(F.col(c) == v)
    return df.agg(F.min("id")).first()[0]


def _retyped(g: FootageGraph) -> DataFrame:
    event = _first(g, "event", ("type", "door_knock"))
    after = dml.update(g, "event", event, {"type": "gate entry", "start_timestamp": "1:30", "summary": "corrected"}, NOTE, AT, True).graph
    return after.node("event").join(after.edge("instance_of").select(F.col("src_id").alias("id"), F.col("dst_id").alias("instance")), "id", "left").select(
        "id", "type", "instance", "start_timestamp", "seek_s", "summary", "correction_note", "corrected_at"
    )


question(
    "correct_update",
    with_graph(
        f"""select id, type, (select id from event_catalog c where c.id = e.type) as instance, start_timestamp, seek_s, summary, correction_note, corrected_at from
        (select id, case when mine then 'gate_entry' else type end as type, case when mine then '01:30' else start_timestamp end as start_timestamp, case when mine then 90.0 else seek_s end as seek_s,
        case when mine then 'corrected' else summary end as summary, case when mine then '{NOTE}' end as correction_note, case when mine then '{AT}' end as corrected_at
        from (select *, id = {_KNOCK} as mine from event)) e"""
    ),
    _retyped,
)


def _created(g: FootageGraph) -> DataFrame:
    after = dml.create(g, "person", "v_harbor_gate_fixed", {"clothes": "blue coat", "role": "officer"}, NOTE, AT, "clip_0003", True).graph
    return after.node("person", "id", "local_id", "race", "role", "is_cop", "clothes").join(
        after.edge("contains", "clip", "person").where(F.col("corrected_at").isNotNull()).select(F.col("dst_id").alias("id"), F.col("src_id").alias("clip")), "id", "left"
    )


question(
    "correct_create",
    with_graph(
        """, top as (select max(cast(regexp_extract(local_id, '^person_([0-9]+)$', 1) as int)) + 1 as n from person where video_id = 'v_harbor_gate_fixed' and regexp_matches(local_id, '^person_[0-9]+$'))
        select id, local_id, cast(null as varchar) as race, role, is_cop, clothes, cast(null as varchar) as clip from person
        union all select 'v_harbor_gate_fixed:person_' || n, 'person_' || n, 'unknown', 'officer', true, 'blue coat', 'v_harbor_gate_fixed:clip_0003' from top"""
    ),
    _created,
)


def _linked(g: FootageGraph) -> DataFrame:
    event, person = _first(g, "event", ("type", "door_knock")), _first(g, "person", ("video_id", "v_harbor_gate_fixed"))
    for role in ("civilian", "officer"):
        g = dml.link(g, "INVOLVES", "event", event, "person", person, NOTE, AT, role, True).graph
    return g.edge("involves", "event", "person").select("src_id", "dst_id", "role", "correction_note")


_HARBOR = "(select min(id) from person where video_id = 'v_harbor_gate_fixed')"
question(
    "correct_link",
    with_graph(
        f"""select src_id, dst_id, role, cast(null as varchar) as correction_note from involves where kind = 'person' and not (src_id = {_KNOCK} and dst_id = {_HARBOR})
        union all select {_KNOCK}, {_HARBOR}, 'officer', '{NOTE}'"""
    ),
    _linked,
)


def _pair(g: FootageGraph) -> list[str]:
    rows = g.node("person", "id", "video_id").where("video_id = 'v_harbor_gate_fixed'").orderBy("id").limit(2).collect()
    return [r["id"] for r in rows]


def _merged(g: FootageGraph) -> FootageGraph:
    keep, drop = _pair(g)
    return dml.merge(g, "person", keep, drop, NOTE, AT, True).graph


_MERGED = """, two as (select id, row_number() over (order by id) as n from person where video_id = 'v_harbor_gate_fixed' qualify n <= 2),
  k as (select * from person where id = (select id from two where n = 1)), d as (select * from person where id = (select id from two where n = 2))"""
_RANK = "case role when 'potential_suspect' then 0 when 'officer' then 1 when 'civilian' then 2 else 3 end"
question(
    "correct_merge_edges",
    with_graph(
        f"""{_MERGED} select src_id, dst_id, arg_min(role, {_RANK}) as role from (select src_id, case when dst_id = (select id from d) then (select id from k) else dst_id end as dst_id, role
        from involves where kind = 'person') group by 1, 2"""
    ),
    lambda g: _merged(g).edge("involves", "event", "person").select("src_id", "dst_id", "role"),
)
_BLANK = "lower(trim(coalesce(cast({0} as varchar), ''))) in ('', 'unknown')"
question(
    "correct_merge_node",
    with_graph(
        f"""{_MERGED} select p.id, {", ".join(f"case when p.id = k.id and {_BLANK.format('p.' + c)} and not {_BLANK.format('d.' + c)} then d.{c} else p.{c} end as {c}" for c in ("clothes", "hair", "glasses", "is_cop"))},
        case when p.id <> k.id then p.role else (select arg_min(role, {_RANK}) from (select role from k union all select role from d)) end as role,
        case when p.id = k.id then d.local_id else '' end as also_known_as, case when p.id = k.id then d.id else '' end as merged_ids from person p, k, d where p.id <> d.id"""
    ),
    lambda g: _merged(g).node("person").select("id", "clothes", "hair", "glasses", "is_cop", "role", "also_known_as", "merged_ids"),
)


def _counters(g: FootageGraph) -> DataFrame:
    person = _first(g, "person", ("video_id", "v_harbor_gate_fixed"))
    return dml.write_counters(g, dml.update(g, "person", person, {"hair": "shaved by request"}, NOTE, AT, True).graph)


question("correct_counters", "select 'person' as name, 0 as created, 0 as deleted, 1 as changed", _counters)
question(
    "correct_footprint",
    with_graph(
        f"""select rel, array_to_string(list_sort(list_distinct(list(x))), ',') as ends from (select 'involves' as rel, src_id as x from involves where dst_id = {_HARBOR}
        union all select 'contains', src_id from contains where dst_id = {_HARBOR} union all select 'has_person', 'v_harbor_gate_fixed') group by 1"""
    ),
    lambda g: g.spark.createDataFrame([(k, ",".join(sorted(v))) for k, v in dml.footprint(g, "person", _first(g, "person", ("video_id", "v_harbor_gate_fixed"))).items()], "rel string, ends string"),
)


def _replaced(g: FootageGraph) -> DataFrame:
    """The graph with one video put in anew: nothing doubles, nothing is lost."""
    again = g.replace_videos(g, ["v_harbor_gate_fixed"])
    counts = [again.node(k).groupBy("video_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "video_id", "n") for k in ("clip", "event", "person")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


question("graph_upsert_of_video", with_graph(" union all ".join(f"select '{k}' as label, video_id, count(*) as n from {k} group by 2" for k in ("clip", "event", "person"))), _replaced)


# The catalog
def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "clip_events").where("type is not null").select("type").distinct()


_SLUG = "substring(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48)"
_SKIP = "['find', 'all', 'show', 'list', 'the', 'every', 'events', 'event', 'of', 'for', 'videos']"


@query(
    "resolve_questions",
    f"""with said as (select distinct type, lower(trim(type)) as low from clip_events where type is not null),
    asked as (select type, coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '' and not list_contains({_SKIP}, w)), ' '), ''), low) as needle from said),
    own as (select id, lower(unnest(list_concat([id, title, split_part(id, '_', 1)], aliases))) as text from event_catalog),
    named as (select text, id from own union select split_part(id, '_', 1), id from event_catalog)
    select type, coalesce(array_to_string(list_sort(list_distinct(list(id) filter (id is not null))), ','), '') as event_types from asked left join named
      on needle <> '' and (contains(text, needle) or contains(needle, text) or {_SLUG.format("text")} = {_SLUG.format("needle")}) group by 1""",
)
def resolve_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every type that people typed, asked as a question."""
    return flat(Catalog.of_table(table(spark, folder, "event_catalog")).resolve_all(_asked(spark, folder), "type"))


@query(
    "canonical_types",
    f"""with named as (select id, {_SLUG.format("trim(n)")} as slug from (select id, unnest(list_concat([id, title], aliases)) as n from event_catalog))
    select type, min(id) as canonical from (select distinct type from clip_events where type is not null) left join named on slug = {_SLUG.format("type")} group by 1""",
)
def canonical_types(spark: SparkSession, folder: str) -> DataFrame:
    return Catalog.of_table(table(spark, folder, "event_catalog")).canonicalise(_asked(spark, folder), "type")


@query("event_in_clip_range_join", with_graph("select e.id as event_id, c.id as covering from event e join clip c on c.video_id = e.video_id and e.start_ms between c.start_ms and c.end_ms"))
def event_in_clip_range_join(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    points = g.node("event", "id", "video_id", "start_ms").select(F.col("id").alias("event_id"), "video_id", F.col("start_ms").alias("at"))
    spans = g.node("clip", "id", "video_id", "start_ms", "end_ms").withColumnRenamed("id", "covering")
    return windows.point_in_interval(points, spans, ["video_id"], "at", "start_ms", "end_ms").select("event_id", "covering")
