"""Connected groups of pairwise links by reduction to a core.

Each round takes out, all at once, an independent set of the vertices with at most two links: those
whose rank of the round is above both neighbours'. A vertex of degree one is stripped, one of degree
two is spliced out of its chain, its neighbours being linked instead; that is list ranking by removal
of independent sets, so a chain of any length shrinks by a constant factor in each round. The vertex
remembers a surviving neighbour. The rounds go on until an eighth of the links is left, at every size, and
until that fits one task or no longer shrinks; this core is solved in one task if its checked size
allows it, else by star contraction over the cluster. The rounds are then undone in reverse: each removed
vertex takes the label of its neighbour. Joins on a hub or on the root of a giant group keep the rows of
such keys in place (``join_unique``); no table is broadcast but for those keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_unique

#: Links up to which the core is solved in one task (two longs each, so about 1 MB).
CORE_LINKS = 65_536
#: The reduced core has at most this part of the links.
REDUCED = 8
#: A round that keeps more than this share of the links ends the reduction.
WORTHWHILE = 0.9


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def _rank(vertex: Column, turn: int) -> Column:
    """A rank that differs from round to round; ties are broken by the vertex itself."""
    return F.struct(F.xxhash64(vertex, F.lit(turn)), vertex)


def _removable(links: DataFrame, turn: int) -> DataFrame:
    """An independent set of vertices with one or two neighbours: ``v, n1, n2`` (equal for one)."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(
        links.select(F.col("b").alias("v"), F.col("a").alias("n"))
    )
    return (
        both.groupBy("v")
        .agg(F.count("*").alias("degree"), F.min("n").alias("n1"), F.max("n").alias("n2"))
        .where("degree <= 2")
        .where((_rank(F.col("v"), turn) > _rank(F.col("n1"), turn)) & (_rank(F.col("v"), turn) > _rank(F.col("n2"), turn)))
        .select("v", "n1", "n2")
    )


def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The links without those of the removed vertices, with the links that bridge spliced ones."""
    ends = gone.select(
        F.explode(F.array(F.struct("v", F.col("n1").alias("n")), F.struct("v", F.col("n2").alias("n")))).alias("x")
    ).select(F.least("x.v", "x.n").alias("a"), F.greatest("x.v", "x.n").alias("b"), F.lit(False).alias("keep"))
    bridges = gone.where("n1 <> n2").select(F.col("n1").alias("a"), F.col("n2").alias("b"), F.lit(True).alias("keep"))
    return (
        links.withColumn("keep", F.lit(True))
        .unionByName(ends)
        .unionByName(bridges)
        .groupBy("a", "b")
        .agg(F.min("keep").alias("keep"))
        .where("keep")
        .select("a", "b")
    )


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links of a bounded core to ``v, root`` with the smallest vertex as root."""
    held = list(batches)
    pdf = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if pdf.empty:
        return
    names, code = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    a, b = code[: len(pdf)], code[len(pdf) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    yield pd.DataFrame({"v": names, "root": names[root]})


def _stars(links: DataFrame) -> DataFrame:
    """Labels of a core of any size: alternating large and small stars until every group is one star."""
    def both(df: DataFrame) -> DataFrame:
        return df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def toward(df: DataFrame, larger: bool) -> DataFrame:
        """Links of each vertex to the least vertex of its neighbourhood; ``larger`` moves the greater neighbours only."""
        near = both(df) if larger else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = join_unique(near, least, ["a"]).select(F.col("b").alias("x"), "m", "a")
        out = moved.where("x > a").select(F.col("m").alias("a"), F.col("x").alias("b")) if larger else moved.select(
            F.col("m").alias("a"), F.col("x").alias("b")
        ).unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return out.where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first())

    now = cut(_ordered(links).distinct())
    was = state(now)
    while True:
        now = cut(toward(toward(now, True), False))
        is_ = state(now)
        if is_ == was:
            return now.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).unionByName(
                now.select(F.least("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct()
            )
        was = is_


def group_labels(links: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """``v, root`` for every vertex of ``links`` (``a, b`` bigint), one root for each connected group.

    Links with a null end and self links join nothing; repeated links, either way round, count once; an
    empty table gives an empty result. No group is ever gathered: a hub's links are counted, its leaves
    leave on their own.
    """
    now = cut(_ordered(links.where("a is not null and b is not null")).distinct())
    left = at_first = now.count()
    rounds: list[DataFrame] = []
    while left and (left > core_links or left * REDUCED > at_first):
        gone = cut(_removable(now, len(rounds)))
        rounds.append(gone)
        now = cut(_without(now, gone))
        was, left = left, now.count()
        if left > WORTHWHILE * was:
            break
    if left <= core_links:
        labels = now.coalesce(1).mapInPandas(_union_find, "v bigint, root bigint")
    else:
        labels = _stars(now)
    for gone in reversed(rounds):
        # The neighbour may have lost its last link with this vertex; it then stands for itself.
        told = gone.select("v", F.col("n1").alias("n"))
        known = labels.withColumnRenamed("v", "n").hint("merge")
        near = cut(
            join_unique(told, known, ["n"], "left").select(
                "v", F.coalesce("root", "n").alias("root"), "n", F.col("root").isNull().alias("alone")
            )
        )
        labels = (
            labels.unionByName(near.select("v", "root"))
            .unionByName(near.where("alone").select(F.col("n").alias("v"), F.col("n").alias("root")).distinct())
        )
    return labels


def _key(name: Column) -> Column:
    """A name regardless of case and surrounding blanks."""
    return F.regexp_replace(F.lower(name), r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def name_links(events: DataFrame, continues_links: DataFrame) -> DataFrame:
    """Links ``a, b`` between existing events, as 64-bit hashes of their ids.

    A name in continues_from may leave out the leading ``video_id:``; names of no existing event link
    nothing. Where two ids differ only by case, a name means both.
    """
    known = events.where("id is not null").select(F.xxhash64("id").alias("h"), F.xxhash64(_key(F.col("id"))).alias("k")).distinct()
    said, own = _key(F.col("continues_from")), F.concat(F.lower("video_id"), F.lit(":"))
    names = F.when(own.isNull() | F.startswith(said, own), F.array(F.xxhash64(said))).otherwise(
        F.array(F.xxhash64(said), F.xxhash64(F.concat(own, said)))
    )
    stated = (
        events.where(F.col("id").isNotNull() & (said != ""))
        .select(F.xxhash64("id").alias("a"), F.explode(names).alias("k"))
        .distinct()
    )
    by_event = stated.join(known.hint("merge"), "k").select("a", F.col("h").alias("b"))
    given = (
        continues_links.where("src_id is not null and dst_id is not null")
        .select(F.xxhash64(_key(F.col("src_id"))).alias("ka"), F.xxhash64(_key(F.col("dst_id"))).alias("kb"))
        .distinct()
    )
    by_user = (
        given.hint("merge")
        .join(known.select(F.col("k").alias("ka"), F.col("h").alias("a")), "ka")
        .hint("merge")
        .join(known.select(F.col("k").alias("kb"), F.col("h").alias("b")), "kb")
        .select("a", "b")
    )
    return by_event.unionByName(by_user)


def linked_events(events: DataFrame, continues_links: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """``event_id, group_id`` of every event in a group of two or more, from ``clip_events`` and ``continues_links``.

    ``group_id`` is the smallest id of the group in byte order. Repeated rows are one event; rows without
    an id are none. Two ids with one hash would raise an error instead of joining their groups.
    """
    labels = group_labels(name_links(events, continues_links), core_links)
    members = cut(
        events.where("id is not null")
        .select(F.xxhash64("id").alias("v"), "id")
        .join(labels.hint("merge"), "v")
        .groupBy("v", "root")
        .agg(F.min("id").alias("event_id"), F.max("id").alias("other"))
        .select(
            "root",
            F.when(F.col("event_id") == F.col("other"), F.col("event_id"))
            .otherwise(F.raise_error(F.lit("two event ids have the same hash")))
            .alias("event_id"),
        )
    )
    first = members.groupBy("root").agg(F.min("event_id").alias("group_id"))
    return join_unique(members, first.hint("merge"), ["root"]).select("event_id", "group_id")
