"""Registered queries of the training-data operators and their SQL twins, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, canonical, fusion, groups, leaks, pii, runs, truncation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _typed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = (
        table(spark, folder, "clip_events")
        .select(F.lit("event_type").alias("kind"), F.col("id").alias("record_id"), F.col("type").alias("value"))
        .unionByName(
            table(spark, folder, "vehicle_cards").select(
                F.lit("vehicle_color").alias("kind"), F.col("id").alias("record_id"), F.col("color").alias("value")
            )
        )
    )
    reference = canonical.catalog_names(table(spark, folder, "event_catalog")).unionByName(
        canonical.color_names(table(spark, folder, "color_list"))
    )
    return records, reference


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_records(*_typed(spark, folder))


@query("p3_unmatched")
def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.unmatched_report(p3_found(spark, folder))


P4_SQL = r"""
with recursive ids as (select distinct id, lower(trim(id)) as k, video_id from clip_events where id is not null),
said as (
  select distinct id as a, lower(trim(continues_from)) as name, lower(video_id) || ':' || lower(trim(continues_from)) as full_name
  from clip_events where trim(continues_from) <> ''),
pairs as (
  select a, ids.id as b from said join ids on ids.k = said.name
  union select a, ids.id from said join ids on ids.k = said.full_name
  union select x.id, y.id from continues_links l join ids x on x.k = lower(trim(l.src_id)) join ids y on y.k = lower(trim(l.dst_id))),
both_ways as (select a, b from pairs where a <> b union select b, a from pairs where a <> b),
reach as (select a as n, a as m from both_ways union select r.n, b.b from reach r join both_ways b on b.a = r.m)
select n as event_id, min(m) as group_id from reach group by n
"""


@query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.linked_events(table(spark, folder, "clip_events"), table(spark, folder, "continues_links"))


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.repeated_events(table(spark, folder, "clip_events"), table(spark, folder, "event_catalog"), singles=False)
    return found.where("n >= 2").select("video_id", "first_id", "last_id")


@query("p6_collapsed")
def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return runs.repeated_events(table(spark, folder, "clip_events"), table(spark, folder, "event_catalog"))


_SAYS = """(regexp_matches({0}, '[\\p{{L}}\\p{{N}}]') and lower(trim(replace({0}, chr(160), ' '))) not in ({1}))"""
P1_SQL = f"""
with long as (
  {" union all ".join(f"select id, card_id, source, updated_at, '{f}' as field, {f} as value from people_cards" for f in fusion.FIELDS)}),
many as (select id from people_cards group by id having count(distinct card_id) > 1),
ranked as (
  select id, field, value, card_id, row_number() over (partition by id, field order by
    case source when 'user' then 0 when 'gemini' then 1 when 'local' then 2 else 3 end,
    updated_at desc nulls last, card_id desc) as place
  from long where id in (select id from many) and value is not null
    and {_SAYS.format("value", ", ".join(f"'{x}'" for x in fusion.STAND_INS))})
"""
P1_FOUND = P1_SQL + "select distinct id as person_id, field, card_id from ranked where place = 1"
P1_BEST = P1_SQL + f"""select id, {", ".join(f"max(case when field = '{f}' then value end) as {f}, max(case when field = '{f}' then card_id end) as {f}_card" for f in fusion.FIELDS)}
from ranked where place = 1 group by id"""


@query("p1_found", P1_FOUND)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The stated order (source, then time, then card) leaves nothing to votes, so no source is estimated here; ``p1_voted`` does that."""
    return fusion.by_order(table(spark, folder, "people_cards")).select(F.col("id").alias("person_id"), "field", "card_id")


@query("p1_best_cards", P1_BEST)
def p1_best_cards(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.best_cards(table(spark, folder, "people_cards"))


@query("p1_voted")
def p1_voted(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = fusion.fuse(table(spark, folder, "people_cards"))
    return found


@query("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


@query("p7_round_trip", "select doc_id, coalesce(text, '') as text from documents")
def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.decode_ids(p7_ids(spark, folder), "doc_id")


P8_SQL = r"""
with words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
grams as (select doc_id, array_to_string(w[i:i + 11], ' ') as gram from words, range(1, 100000) t(i) where i <= len(w) - 11),
asked as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
item_grams as (select item_id, array_to_string(w[i:i + 11], ' ') as gram from asked, range(1, 100000) t(i) where i <= len(w) - 11)
select distinct doc_id, item_id from grams join item_grams using (gram)
"""


@query("p8_found", P8_SQL)
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


@query("p8_clean")
def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with all leaked passages cut out."""
    return leaks.remove_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    told = pii.sanitise(table(spark, folder, "clips"), "id", ["transcript", "summary"])
    return pii.found_pieces(told, "id", ["transcript", "summary"]).withColumnRenamed("id", "clip_id")


@query("p5_texts")
def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    told = pii.sanitise(table(spark, folder, "clips"), "id", ["transcript", "summary"])
    return told.select("id", "transcript", "summary").distinct()


@query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents"))


@query("p9_rates")
def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"))
