"""Pieces of the SQL twins: the graph's tables as the questions define them, and flat forms of nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .queries import sql_clock

#: Types of the tables' events that have a subject, as a setting of the questions.
SUBJECTS = ("sidewalk_interview", "balance_check", "bag_inspection")
_IN = ", ".join(f"'{t}'" for t in SUBJECTS)


def sql_format(ms: str) -> str:
    """DuckDB's form of a clock of milliseconds."""
    s = f"greatest(cast({ms} as bigint), 0) // 1000"
    return f"case when {s} >= 3600 then printf('%d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) else printf('%02d:%02d', {s} // 60, {s} % 60) end"


def shown(node: str, which: str) -> str:
    """A clock of a node: its text, else its milliseconds."""
    return f"coalesce({node}.{which}_timestamp, case when {node}.{which}_ms is not null then {sql_format(f'{node}.{which}_ms')} end)"


#: The graph's tables in SQL, from the raw tables.
GRAPH = rf"""
video as (select v.*, coalesce(c.n, 0) as clip_count from (select distinct video_id as id, source_name, duration_s, status from videos) v
  left join (select video_id, cast(count(distinct id) as int) as n from clips group by 1) c on c.video_id = v.id),
clip as (select id, video_id, local_id, clip_index as idx, start_ms, end_ms, transcript, summary, cast(null as varchar) as start_timestamp, cast(null as varchar) as end_timestamp
  from (select *, row_number() over (partition by id order by written_at desc) as place from clips where id is not null) where place = 1),
event as (select distinct id, video_id, source_name, clip_id, type, coalesce(start_ms, {sql_clock("start_timestamp")}) as start_ms,
  coalesce(end_ms, {sql_clock("end_timestamp")}) as end_ms, start_timestamp, end_timestamp, seek_s, summary, evidence, people_ids, vehicle_ids, continues_from
  from clip_events where id is not null),
card as (select * from (select *, row_number() over (partition by id order by updated_at desc nulls last, card_id desc) as place from people_cards where id is not null) where place = 1),
listed as (select distinct id as src_id, video_id || ':' || x as dst_id, clip_id, type, start_ms, {shown("event", "start")} as clock
  from (select *, unnest(people_ids) as x from event) event where x is not null and video_id is not null),
gated as (select l.*, substring(trim(coalesce(c.transcript, '')), 1, 240) as said from listed l join card p on p.id = l.dst_id left join clip c on c.id = l.clip_id
  where l.type in ({_IN}) and coalesce(not p.is_cop, not regexp_matches(lower(coalesce(p.clothes, '')), 'police|uniform|badge')
    and (coalesce(p.clothes, '') <> '' or coalesce(p.description, '') <> ''))),
subject as (select dst_id as id, type as event_type, clock as at, replace(type, '_', ' ') || ' at ' || clock || ': ' ||
    case when said <> '' then 'officer is addressing this civilian. Transcript: "' || substring(said, 1, 180) || '"' else 'only civilian on this event.' end as reason
  from (select *, row_number() over (partition by dst_id order by start_ms nulls first, src_id) as place from gated) where place = 1),
person as (select p.*, s.id is not null as potential_suspect, case when s.id is not null then 'potential_suspect' when is_cop then 'officer' else 'civilian' end as role,
    case when s.id is not null then trim(coalesce(s.reason, '')) end as suspect_reason, case when s.id is not null then coalesce(s.at, '') end as suspect_at,
    case when s.id is not null then s.event_type end as suspect_event,
    case when s.id is not null then trim(concat_ws(' | ', nullif(d, ''), nullif(w, ''), nullif(m, ''))) end as suspect_snapshot
  from (select *, coalesce(description, '') as d, case when clothes <> '' and not contains(coalesce(description, ''), clothes) then clothes else '' end as w,
      case when distinctive <> '' and not contains(coalesce(description, '') || case when clothes <> '' and not contains(coalesce(description, ''), clothes) then ' ' || clothes else '' end, distinctive)
        then distinctive else '' end as m from card) p left join subject s on s.id = p.id),
vehicle as (select id, video_id, local_id, color, analysis, case when length(bare) between 4 and 10 and regexp_matches(bare, '[0-9]') then bare else '' end as plate
  from (select distinct id, video_id, local_id, regexp_replace(lower(color), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') as color, analysis, regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') as bare from vehicle_cards where id is not null)),
plate as (select distinct video_id || ':plate:' || plate as id, plate as text, video_id, cast(0.6 as double) as confidence from vehicle where plate <> ''),
seen as (select distinct id as event_id, clip_id, video_id, x.value as label from (select *, unnest(from_json(evidence, '[{{"modality":"VARCHAR","value":"VARCHAR"}}]')) as x from event)
  where x.modality = 'visual' and trim(x.value) <> '' and video_id is not null),
thing as (select *, 'object_' || substring(regexp_replace(regexp_replace(lower(label), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) as local_id from seen),
object as (select video_id || ':' || local_id as id, video_id, local_id, min(label) as label, cast(null as varchar) as distinctive from thing group by 1, 2, 3),
mention as (select distinct id as src_id, clip_id, video_id, x from (select *, unnest(vehicle_ids) as x from event) where x is not null),
car as (select distinct m.src_id, m.clip_id, v.id as dst_id from mention m join vehicle v on v.video_id = m.video_id and (v.local_id = m.x or v.id = m.x or v.plate = upper(m.x) and v.plate <> '')),
involves as (
  select l.src_id, 'person' as kind, l.dst_id, case when p.is_cop then 'officer' when p.potential_suspect and l.type in ({_IN}) then 'potential_suspect' when not p.is_cop then 'civilian' else 'unknown' end as role
    from (select distinct src_id, dst_id, type from listed) l left join person p on p.id = l.dst_id
  union all select distinct src_id, 'vehicle', dst_id, null from car
  union all select distinct event_id, 'object', video_id || ':' || local_id, null from thing),
contains as (
  select distinct clip_id as src_id, 'event' as kind, id as dst_id from event where clip_id is not null
  union all select distinct clip_id, 'person', dst_id from listed where clip_id is not null
  union all select distinct clip_id, 'vehicle', dst_id from car where clip_id is not null
  union all select distinct clip_id, 'object', video_id || ':' || local_id from thing where clip_id is not null),
names as (select distinct id, regexp_replace(lower(id), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') as name from event),
said as (select distinct id, regexp_replace(lower(continues_from), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') as name, video_id from event where continues_from is not null),
continues as (
  select i.id as src_id, s.id as dst_id from said s join names i on s.name <> '' and (i.name = s.name or i.name = lower(s.video_id) || ':' || s.name)
  union select x.id, y.id from continues_links l join names x on x.name = lower(trim(l.src_id)) join names y on y.name = lower(trim(l.dst_id))),
topic_of as (select id as type, split_part(id, '_', 1) as topic from event_catalog),
on_event as (select i.src_id, i.role as edge_role, p.* from involves i join person p on i.kind = 'person' and p.id = i.dst_id)
"""


def with_graph(select: str, recursive: bool = False) -> str:
    """A statement over the graph's tables; one that begins with a comma goes on with tables of its own."""
    return f"with {'recursive ' if recursive else ''}{GRAPH.strip()} {select.strip()}"


def listing(*values: str) -> str:
    """The distinct rows of a group as one text: values joined by colons, rows sorted and joined by commas."""
    return f"array_to_string(list_sort(list_distinct(list({joined(*values)}))), ',')"


def joined(*values: str) -> str:
    return " || ':' || ".join(f"coalesce(cast({v} as varchar), '')" for v in values)


PEOPLE = listing("p.local_id", "p.edge_role", "p.clothes", "p.potential_suspect")
EVENTS = listing("e.type", shown("e", "start"), "e.video_id")
TOPICS = "coalesce(array_to_string(list_sort(list_distinct(list(t.topic) filter (t.topic is not null))), ','), '')"


def _textual(kind: T.DataType):
    """A member of an array as text."""

    def text(x: Column) -> Column:
        if not isinstance(kind, T.StructType):
            return x.cast("string")
        parts = [F.coalesce(x[f.name].cast("string"), F.lit("")) for f in kind.fields]
        return F.concat(*[c for p in parts for c in (F.lit(":"), p)][1:])

    return text


def flat(df: DataFrame) -> DataFrame:
    """Arrays as sorted texts, their structs' values joined by colons."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            kind = f.dataType.elementType
            rows = F.transform(F.coalesce(f.name, F.array().cast(f.dataType)), _textual(kind))
            out.append(F.array_join(F.array_sort(rows), ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
