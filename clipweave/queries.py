"""Registered queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.presence import presence
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, folder); ``sql`` is the statement that gives the same rows in DuckDB."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


_CLOCK = r"(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{2})(?:\.([0-9]{1,3}))?"


def sql_clock(text: str) -> str:
    """DuckDB's reading of a clock text in milliseconds."""

    def part(i: int) -> str:
        return f"coalesce(nullif(regexp_extract({text}, '{_CLOCK}', {i}), ''), '0')"

    return rf"""case when regexp_matches({text}, '^\s*[0-9]+\s*$') then cast(regexp_extract({text}, '[0-9]+') as bigint)
      when regexp_matches({text}, '{_CLOCK}') then
        (cast({part(1)} as bigint) * 3600 + cast({part(2)} as bigint) * 60 + cast({part(3)} as bigint)) * 1000
        + cast(rpad({part(4)}, 3, '0') as bigint) end"""


P2_SQL = f"""
with timed as (
  select distinct id, video_id, people_ids, coalesce(start_ms, {sql_clock("start_timestamp")}) as s,
    coalesce(end_ms, {sql_clock("end_timestamp")}) as e
  from clip_events),
listed as (
  select distinct video_id, person_id, id, s, e from (select *, unnest(people_ids) as person_id from timed)
  where person_id is not null and video_id is not null and s < e),
marked as (
  select *, max(e) over (partition by video_id, person_id order by s, e, id
    rows between unbounded preceding and 1 preceding) as before from listed),
grouped as (
  select *, sum(case when before >= s then 0 else 1 end) over (partition by video_id, person_id order by s, e, id
    rows unbounded preceding) as run from marked),
periods as (
  select video_id, person_id, run, min(s) as s, max(e) as e, count(*) as n from grouped group by 1, 2, 3),
followed as (
  select *, lead(s) over (partition by video_id, person_id order by s) as next_s from periods)
select video_id, person_id, 'merged' as kind, s as from_ms, e as to_ms from followed where n >= 2
union all
select video_id, person_id, 'gap', e, next_s from followed where next_s is not null
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return presence(table(spark, folder, "clip_events"))
