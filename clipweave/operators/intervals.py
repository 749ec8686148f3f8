"""Overlapping, nested and gapped intervals of an entity, merged by dyadic decomposition.

An interval ``[start, end)`` of integers is the disjoint union of at most two canonical dyadic
blocks per level. The operator cuts the time line of an entity into top blocks of ``2**LEVELS``
milliseconds, decomposes the intervals in each, removes blocks that lie in a larger one, merges
sibling pairs upward and coalesces neighbours. All of it is vectorised over the groups of an Arrow
batch; the same step runs before the shuffle, where it reduces a hot entity to its local periods,
and after it. Periods that reach an edge of their top block are stitched by a window over at most
two rows per entity and top block, a number that the length of the time line bounds.

An interval of more than ``SPAN_BLOCKS`` top blocks, as a mistyped clock may give, is not cut into all of
them: its ends are, its middle is decomposed into dyadic blocks of higher levels. Those cover the top blocks
under them in which the entity has anything, and go to the stitch as they are; nobody else's plan changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Levels under a top block; 2**22 ms are about 70 minutes.
LEVELS = 22
#: Top blocks that one interval may meet before its middle goes by larger blocks.
SPAN_BLOCKS = 4096
#: Levels above a top block that the middle of a long interval may have.
HIGHER = 41
#: Rows gathered before a vectorised pass.
BATCH_ROWS = 200_000

_PIECE = "k0 string, k1 string, chunk bigint, s bigint, e bigint, lo bigint, hi bigint"
_DONE = _PIECE + ", kind string"


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def dyadic_union(start: np.ndarray, end: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open integer intervals, each inside one top block, as sorted disjoint intervals.

    Intervals that touch inside a top block become one; those of two top blocks stay apart.
    """
    blocks: list[np.ndarray] = []
    lo, hi = start.astype(np.int64), end.astype(np.int64)
    for _ in range(levels):
        out = [lo[(lo & 1) == 1], hi[(hi & 1) == 1] - 1]
        blocks.append(_distinct(np.concatenate(out)))
        lo, hi = (lo + 1) >> 1, hi >> 1
        keep = lo < hi
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            break
    else:
        blocks.append(_distinct(lo))
    covered_s = covered_e = np.empty(0, np.int64)
    kept: list[np.ndarray] = [np.empty(0, np.int64)] * len(blocks)
    for level in range(len(blocks) - 1, -1, -1):
        block = blocks[level]
        if len(covered_s) and len(block):
            at = np.searchsorted(covered_s, block << level, "right") - 1
            block = block[(at < 0) | ((block << level) >= covered_e[at])]
        kept[level] = block
        if len(block):
            s = np.concatenate([covered_s, block << level])
            e = np.concatenate([covered_e, (block + 1) << level])
            order = np.argsort(s, kind="stable")
            covered_s, covered_e = s[order], e[order]
    for level in range(min(len(kept), levels)):
        block = kept[level]
        if len(block) < 2:
            continue
        left = (block[:-1] & 1 == 0) & (block[1:] == block[:-1] + 1)
        parents = block[:-1][left] >> 1
        if len(parents):
            gone = np.zeros(len(block), bool)
            gone[:-1] |= left
            gone[1:] |= left
            kept[level] = block[~gone]
            if level + 1 == len(kept):
                kept.append(parents)
            else:
                kept[level + 1] = _distinct(np.concatenate([kept[level + 1], parents]))
    s = np.concatenate([b << level for level, b in enumerate(kept)])
    e = np.concatenate([(b + 1) << level for level, b in enumerate(kept)])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    if not len(s):
        return s, e
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != e[:-1]) | (s[1:] >> levels != s[:-1] >> levels)
    at = np.flatnonzero(first)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def _reduce(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Rows of one or many groups to the periods of each, with the least and greatest event in it."""
    if pdf.empty:
        return pdf
    keys = pdf.groupby(["k0", "k1", "chunk"], sort=True)
    group = keys.ngroup().to_numpy().astype(np.int64)
    base = pdf["chunk"].to_numpy() << levels
    start, end = pdf["s"].to_numpy() - base + (group << levels), pdf["e"].to_numpy() - base + (group << levels)
    s, e = dyadic_union(start, end, levels)
    at = np.searchsorted(s, start, "right") - 1
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.diff(at[order], prepend=-1))
    first_row = np.full(int(group.max()) + 1, len(pdf))
    np.minimum.at(first_row, group, np.arange(len(pdf)))
    rows = pdf.take(first_row[s >> levels])
    shift = rows["chunk"].to_numpy() - (s >> levels)
    return pd.DataFrame(
        {
            "k0": rows["k0"].to_numpy(),
            "k1": rows["k1"].to_numpy(),
            "chunk": rows["chunk"].to_numpy(),
            "s": s + (shift << levels),
            "e": e + (shift << levels),
            "lo": np.minimum.reduceat(pdf["lo"].to_numpy()[order], edges),
            "hi": np.maximum.reduceat(pdf["hi"].to_numpy()[order], edges),
        }
    )


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= BATCH_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _local(levels: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _gather(batches):
            yield _reduce(pdf, levels)

    return run


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorted periods of whole groups: inner periods and gaps are final, first and last go to the stitch."""
    same = (
        (pdf["k0"].to_numpy()[1:] == pdf["k0"].to_numpy()[:-1])
        & (pdf["k1"].to_numpy()[1:] == pdf["k1"].to_numpy()[:-1])
        & (pdf["chunk"].to_numpy()[1:] == pdf["chunk"].to_numpy()[:-1])
    )
    first, last = np.append(True, ~same), np.append(~same, True)
    edge, inner = pdf[first | last].assign(kind="edge"), pdf[~(first | last)].assign(kind="period")
    at = np.flatnonzero(same)
    gap = pdf.iloc[at].assign(kind="gap")
    gap["s"], gap["e"] = pdf["e"].to_numpy()[at], pdf["s"].to_numpy()[at + 1]
    return pd.concat([edge, inner, gap], ignore_index=True)


def _whole(levels: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in _gather(batches):
            pdf = _reduce(pdf if rest is None else pd.concat([rest, pdf], ignore_index=True), levels)
            tail = pdf.iloc[-1]
            open_ = ((pdf["k0"] == tail["k0"]) & (pdf["k1"] == tail["k1"]) & (pdf["chunk"] == tail["chunk"])).to_numpy()
            rest = pdf[open_]
            if not open_.all():
                yield _finish(pdf[~open_])
        if rest is not None and len(rest):
            yield _finish(rest)

    return run


def _pieces_of(rows: DataFrame, levels: int) -> DataFrame:
    """Intervals cut at the edges of their top blocks."""
    top = 1 << levels
    return rows.withColumn("chunk", F.explode(F.sequence(F.shiftright("s", levels), F.shiftright(F.col("e") - 1, levels)))).select(
        "k0", "k1", "chunk", F.greatest("s", F.col("chunk") * top).alias("s"), F.least("e", (F.col("chunk") + 1) * top).alias("e"), F.col("event").alias("lo"), F.col("event").alias("hi")
    )


def _higher_blocks(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The canonical dyadic blocks ``row, level, block`` of ranges ``[first, last)`` of top blocks."""
    row, out = np.arange(len(first)), []
    lo, hi = first.copy(), last.copy()
    for level in range(HIGHER + 1):
        for odd, block in (((lo < hi) & (lo & 1 == 1), lo), ((lo < hi) & (hi & 1 == 1), hi - 1)):
            out.append((row[odd], level, block[odd]))
        lo, hi = (lo + 1) >> 1, hi >> 1
    rows = np.concatenate([r for r, _, _ in out])
    return rows, np.concatenate([np.full(len(r), level) for r, level, _ in out]), np.concatenate([b for _, _, b in out])


def _raised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, level, block = _higher_blocks(pdf["first"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64))
        at = pdf.iloc[rows]
        yield pd.DataFrame({"k0": at["k0"].to_numpy(), "k1": at["k1"].to_numpy(), "level": level, "block": block, "lo": at["event"].to_numpy(), "hi": at["event"].to_numpy()})


def _long_parts(whole: DataFrame, long: Column, levels: int) -> tuple[DataFrame, DataFrame]:
    """The pieces that long intervals add, and their middles as blocks ``k0, k1, s, e, lo, hi``.

    A middle is taken by its dyadic blocks. An entity's top block that lies under one of them, found among its
    ancestors by an equality join, gets a piece of full length.
    """
    top = 1 << levels
    ranged = whole.where(long).withColumns({"first": F.shiftright("s", levels) + 1, "last": F.shiftright(F.col("e") - 1, levels)})
    ends = ranged.withColumn("x", F.explode(F.array(F.struct("s", (F.col("first") * top).alias("e")), F.struct((F.col("last") * top).alias("s"), "e"))))
    blocks = cut(
        ranged.select("k0", "k1", "first", "last", "event").mapInPandas(_raised, "k0 string, k1 string, level int, block bigint, lo bigint, hi bigint")
        .groupBy("k0", "k1", "level", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    at_ends = _pieces_of(ends.select("k0", "k1", F.col("x.s").alias("s"), F.col("x.e").alias("e"), "event"), levels)
    here = whole.where(~long).join(blocks.select("k0", "k1").distinct(), ["k0", "k1"], "left_semi")
    chunks = _pieces_of(here, levels).unionByName(at_ends).select("k0", "k1", "chunk").distinct()
    ancestors = chunks.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(HIGHER)))).withColumn("block", F.expr("shiftright(chunk, up)"))
    under = ancestors.withColumnRenamed("up", "level").join(blocks, ["k0", "k1", "level", "block"])
    covered = under.select("k0", "k1", "chunk", (F.col("chunk") * top).alias("s"), ((F.col("chunk") + 1) * top).alias("e"), "lo", "hi")
    size = F.expr("shiftleft(1L, level)") * top
    return at_ends.unionByName(covered), blocks.select("k0", "k1", (F.col("block") * size).alias("s"), ((F.col("block") + 1) * size).alias("e"), "lo", "hi")


def merge_intervals(intervals: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    ``intervals``: columns ``k0, k1`` (the entity; strings, not null), ``s, e`` (bigint) and ``event``
    (bigint that stands for the record); further columns are ignored. Rows with a null, and rows
    whose end is not after their start, have no extent and are left out; repeated rows and ties change
    nothing; an empty table gives an empty result; times of any size up to 2^62 are whole. Returns ``k0, k1, kind, s, e, events_many`` with
    kind ``period`` or ``gap``; ``events_many`` tells whether a period holds two or more records.
    """
    whole = intervals.select("k0", "k1", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), "event").where(
        "k0 is not null and k1 is not null and event is not null and s < e"
    )
    long = F.shiftright("e", levels) - F.shiftright("s", levels) > SPAN_BLOCKS
    cut_up, middles = _pieces_of(whole.where(~long), levels), None
    if whole.where(long).limit(1).count():
        added, middles = _long_parts(whole, long, levels)
        cut_up = cut_up.unionByName(added)
    local = cut_up.mapInPandas(_local(levels), _PIECE)
    pieces = (
        local.repartition("k0", "k1", "chunk")
        .sortWithinPartitions("k0", "k1", "chunk", "s")
        .mapInPandas(_whole(levels), _DONE)
    )
    if middles is not None:
        pieces = pieces.unionByName(middles.withColumns({"kind": F.lit("edge"), "chunk": F.lit(None).cast("bigint")}))
    # Inner rows pass the window in partitions of their own top block, so that the pieces are made once.
    edge = F.col("kind") == "edge"
    part = F.when(edge, F.lit(-1)).otherwise(F.col("chunk"))
    ordered = Window.partitionBy("k0", "k1", "part").orderBy("s", "e")
    run = Window.partitionBy("k0", "k1", "part", "run")
    stitched = (
        pieces.withColumn("part", part)
        .withColumn("before", F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("other", F.coalesce(F.lag("chunk").over(ordered) != F.col("chunk"), F.lit(True)))
        .withColumn("run", F.sum(F.when(edge & (F.col("before") >= F.col("s")), 0).otherwise(1)).over(ordered))
        .withColumn("at", F.row_number().over(ordered))
        .withColumn("closes", edge & (F.max("at").over(run) == F.col("at")))
        .withColumn("from", F.min("s").over(run))
        .withColumn("to", F.max("e").over(run))
        .withColumn("least", F.min("lo").over(run))
        .withColumn("most", F.max("hi").over(run))
    )

    def row(kind: str, s: Column, e: Column, many: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), many.alias("events_many"))

    none = F.lit(None).cast("boolean")
    found = F.array(
        F.when(F.col("closes"), row("period", F.col("from"), F.col("to"), F.col("least") != F.col("most"))),
        F.when(edge & F.col("other") & (F.col("before") < F.col("s")), row("gap", F.col("before"), F.col("s"), none)),
        F.when(F.col("kind") == "period", row("period", F.col("s"), F.col("e"), F.col("lo") != F.col("hi"))),
        F.when(F.col("kind") == "gap", row("gap", F.col("s"), F.col("e"), none)),
    )
    return stitched.select("k0", "k1", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select("k0", "k1", "r.*")
