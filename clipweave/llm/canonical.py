"""Freely typed values mapped to the entries of a reference list, in SQL expressions only.

A partition join by the pigeonhole principle: a name within ``k`` edits of a value shares at least one
of its ``k + 1`` segments with it, at a position shifted by at most ``k``. Names are cut into segments,
the distinct values into substrings of the segments' lengths; an equality join on the text finds the
candidates, the built-in ``levenshtein`` with its threshold verifies them. Only distinct values enter
the join. The reference list is broadcast if its checked size allows it. What no name is near to comes from
an anti-join and is reported as unmatched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_hint, broadcast_if_small, cut, join_unique

#: Words that people put around a value of each kind without changing what it means.
FILLERS: Mapping[str, Sequence[str]] = {
    "event_type": ("the", "poss", "possible", "event", "type", "again", "scene", "cont", "contd", "d"),
    "vehicle_color": ("color", "colour", "looks", "mostly", "solid", "metallic", "paint", "car", "faded", "ish"),
}
UNMATCHED = "unmatched"

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94))
#: Latin letters with a mark and their base letters, from Unicode's decompositions.
_MARKED = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
_MARKED = [(m, b) for m, b in _MARKED if m == m.lower() and m != b and b.isascii() and b.isalpha()]
#: Digits written for letters, in the order in which they are read back.
_LEET = (("1", "i"), ("3", "e"), ("0", "o"), ("4", "a"), ("5", "s"), ("7", "t"))


def tidy(text: Column) -> Column:
    """Lower case, half width, without marks and invisible characters, digits inside words as letters."""
    out = F.translate(text, _WIDE, _NARROW)
    out = F.regexp_replace(out, "[­​-‏⁠﻿̀-ͯ]", "")
    out = F.translate(F.lower(out), "".join(m for m, _ in _MARKED), "".join(b for _, b in _MARKED))
    for digit, letter in _LEET:
        out = F.regexp_replace(out, f"(?<=[a-z]){digit}|{digit}(?=[a-wyz])", letter)
    return out


def words(text: Column, fillers: Column | None = None) -> Column:
    """The distinct words of a tidied text without numbers, counts such as ``2x`` and fillers."""
    found = F.array_distinct(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "))
    said = F.filter(found, lambda w: (w != "") & ~w.rlike("^[0-9]+x?$"))
    if fillers is None:
        return said
    told = F.filter(said, lambda w: ~F.array_contains(fillers, w))
    return F.when(F.size(told) > 0, told).otherwise(said)


def _fillers(kind: Column, fillers: Mapping[str, Sequence[str]]) -> Column:
    out = F.array().cast("array<string>")
    for name, said in fillers.items():
        out = F.when(kind == name, F.array(*map(F.lit, said))).otherwise(out)
    return out


def _joined(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, ""), "[^a-z]", "")


def _edits(length: Column) -> Column:
    """Edits allowed against a name of so many letters."""
    return F.when(length <= 4, 1).when(length <= 7, 2).otherwise(3)


def name_forms(reference: DataFrame) -> DataFrame:
    """``kind, entry, form, how, rank`` of a reference table ``kind, entry, name``.

    Forms are the letters of a name, its words in alphabetical order, and for names of one word also
    the name without its vowels and its beginnings of three letters or more that only one entry has.
    """
    tokens = words(tidy(F.col("name")))
    named = (
        reference.where("kind is not null and entry is not null and name is not null")
        .select("kind", "entry", tokens.alias("tokens"))
        .withColumn("form", _joined(F.col("tokens")))
        .where("form <> ''")
    )
    one = named.where("size(tokens) = 1")
    skeleton = F.concat(
        F.substring("form", 1, 1), F.regexp_replace(F.regexp_replace(F.expr("substring(form, 2)"), "[aeiou]", ""), "ck", "k")
    )
    starts = one.where("length(form) > 3").select(
        "kind", "entry", F.explode(F.expr("transform(sequence(3, length(form) - 1), n -> substring(form, 1, n))")).alias("form")
    )
    single = starts.groupBy("kind", "form").agg(F.min("entry").alias("entry"), F.max("entry").alias("other")).where("entry = other")

    def form(df: DataFrame, text: Column, how: str, rank: int) -> DataFrame:
        return df.select("kind", "entry", text.alias("form"), F.lit(how).alias("how"), F.lit(rank).alias("rank"))

    return (
        form(named, F.col("form"), "letters", 0)
        .unionByName(form(named, _joined(F.array_sort("tokens")), "sorted", 1))
        .unionByName(form(one, skeleton, "letters", 2))
        .unionByName(form(single, F.col("form"), "letters", 3))
        .distinct()
    )


def map_values(values: DataFrame, reference: DataFrame, fillers: Mapping[str, Sequence[str]] = FILLERS) -> DataFrame:
    """The entry of a reference list that each distinct value means.

    ``values``: ``kind, value``, in any number of rows; further columns are ignored. ``reference``:
    ``kind, entry, name`` with a row for each name of an entry. Returns ``kind, value, canonical``
    once for each distinct value that is not null; ``canonical`` is ``unmatched`` where no name is near
    enough, and for empty texts. Of several entries the one with the fewest edits is taken, then the
    smallest. Texts longer than any name and its edits are unmatched without being cut to pieces.
    """
    forms = name_forms(reference)
    # All that is joined here has a few rows for each name.
    small = broadcast_hint(reference)

    def equal(how: str) -> DataFrame:
        best = forms.where(F.col("how") == how).groupBy("kind", "form").agg(F.min(F.struct("rank", "entry")).alias(f"as_{how}"))
        return small(best.withColumnRenamed("form", how))

    names = (
        forms.where("rank = 0")
        .select("kind", "entry", F.col("form").alias("name"), F.length("form").alias("len"))
        .withColumn("k", F.least(_edits(F.col("len")), F.col("len") - 1))
        .withColumn("i", F.explode(F.expr("sequence(0, k)")))
        .withColumn("at", F.expr("cast(floor(i * len / (k + 1)) as int)"))
        .withColumn("n", F.expr("cast(floor((i + 1) * len / (k + 1)) as int) - at"))
        .withColumn("piece", F.expr("substring(name, at + 1, n)"))
        .drop("i")
    )
    sizes = names.groupBy("kind").agg(F.max(F.col("len") + F.col("k")).alias("most"), F.sort_array(F.collect_set("n")).alias("sizes"))
    # Distinct values only; candidates and the unmatched are both taken from here.
    asked = cut(
        values.where("kind is not null and value is not null")
        .select("kind", "value")
        .distinct()
        .withColumn("tokens", words(tidy(F.col("value")), _fillers(F.col("kind"), fillers)))
        .select("kind", "value", _joined(F.col("tokens")).alias("letters"), _joined(F.array_sort("tokens")).alias("sorted"))
        .join(equal("letters"), ["kind", "letters"], "left")
        .join(equal("sorted"), ["kind", "sorted"], "left")
        .select("kind", "value", "letters", F.least("as_letters", "as_sorted")["entry"].alias("same"))
    )
    # Sizes have a row for each kind, of which there are as many as lists.
    pieces = (
        asked.where("same is null and letters <> ''")
        .join(broadcast_if_small(sizes), "kind")
        .where(F.length("letters") <= F.col("most"))
        .select(
            "kind",
            "value",
            "letters",
            F.explode(
                F.expr(
                    """flatten(transform(filter(sizes, m -> m <= length(letters)), m ->
                       transform(sequence(0, length(letters) - m), s -> struct(s as start, substring(letters, s + 1, m) as piece))))"""
                )
            ).alias("p"),
        )
        .select("kind", "value", "letters", "p.*")
    )
    p, n = pieces.alias("p"), small(names).alias("n")
    shares = F.expr(
        "p.kind = n.kind and p.piece = n.piece and abs(p.start - n.at) <= n.k and abs(length(p.letters) - n.len) <= n.k"
    )
    near = (
        p.join(n, shares)
        .select("p.kind", "p.value", "n.entry", F.expr("levenshtein(p.letters, n.name, n.k)").alias("edits"))
        .where("edits >= 0")
        .groupBy("kind", "value")
        .agg(F.min(F.struct("edits", "entry")).alias("near"))
        .select("kind", "value", F.col("near.entry").alias("canonical"))
    )
    matched = asked.where("same is not null").select("kind", "value", F.col("same").alias("canonical")).unionByName(near)
    unmatched = asked.select("kind", "value").join(matched, ["kind", "value"], "left_anti").withColumn("canonical", F.lit(UNMATCHED))
    return matched.unionByName(unmatched)


def catalog_names(event_catalog: DataFrame) -> DataFrame:
    """``kind, entry, name`` of the event catalog: ids, titles and aliases."""
    names = F.concat(F.array("id", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return event_catalog.select(F.lit("event_type").alias("kind"), F.col("id").alias("entry"), F.explode(names).alias("name"))


def color_names(color_list: DataFrame) -> DataFrame:
    """``kind, entry, name`` of the color list: colors and aliases."""
    names = F.concat(F.array("color"), F.coalesce("aliases", F.array().cast("array<string>")))
    return color_list.select(F.lit("vehicle_color").alias("kind"), F.col("color").alias("entry"), F.explode(names).alias("name"))


def map_records(records: DataFrame, reference: DataFrame) -> DataFrame:
    """``kind, record_id, canonical`` of ``kind, record_id, value`` whose value isn't an entry byte for byte.

    One row for each record; records without id or value have none, repeated rows count once. A record
    whose rows disagree takes the entry of its smallest value.
    """
    entries = broadcast_if_small(reference.select("kind", F.col("entry").alias("value")).distinct())
    typed = cut(
        records.where("kind is not null and record_id is not null and value is not null")
        .join(entries, ["kind", "value"], "left_anti")
        .groupBy("kind", "record_id")
        .agg(F.min("value").alias("value"))
    )
    return join_unique(typed, map_values(typed, reference), ["kind", "value"]).select("kind", "record_id", "canonical")


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """How many records of each kind mean no entry: ``kind, records, unmatched``."""
    return mapped.groupBy("kind").agg(
        F.count("*").alias("records"), F.count_if(F.col("canonical") == UNMATCHED).alias("unmatched")
    )
