"""Window operators over clips and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def clip_windows(duration_s: Column, size_s: int = 180, overlap_s: int = 10) -> Column:
    """Overlapping windows of a video, ``array<struct<index, start_s, end_s>>``; the last one is shorter."""
    step = size_s - overlap_s
    last = F.greatest(F.lit(0), F.ceil((duration_s - size_s) / step)).cast("int")
    return F.when(
        duration_s > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(i.alias("index"), (i * step).cast("double").alias("start_s"), F.least(duration_s.cast("double"), (i * step + size_s).cast("double")).alias("end_s")),
        ),
    )


def splice_cells(start_ms: Column, end_ms: Column) -> Column:
    """Midpoints of the 4 to 6 picture cells of a clip, in video milliseconds."""
    d = end_ms - start_ms
    n = F.greatest(F.lit(4), F.least(F.lit(6), F.floor(d / 30_000).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (start_ms + (i + 0.5) * d / n).cast("bigint"))


def nearest_cell(cells: Column, at: Column) -> Column:
    """The index (from 0) of the cell nearest to a time; the first of equally near ones."""
    gaps = F.transform(cells, lambda c: F.abs(c - at))
    return F.when(F.size(cells) > 0, F.array_position(gaps, F.array_min(gaps)).cast("int") - 1)


def stitch(events: DataFrame, group: list[str], index: str, order: list[str], event_id: str) -> DataFrame:
    """``continues_from``: the event before it in its group, if that stands in the index just before."""
    w = Window.partitionBy(*group).orderBy(index, *order)
    before = F.lag(F.struct(F.col(index).alias("i"), F.col(event_id).alias("id"))).over(w)
    return events.withColumn("continues_from", F.when(F.col(index) - before["i"] == 1, before["id"]))


def share_participants(events: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Empty participant lists filled with the last list of the group that has members."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({c: F.last(F.when(F.size(c) > 0, F.col(c)), ignorenulls=True).over(w) for c in columns})


def first_of(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; reduced before the shuffle, so a hot group costs nothing extra."""
    return rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def event_chains(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``start_id, end_id, hops`` of all pairs that a path of edges ``src_id, dst_id`` connects, by the fewest steps.

    ``starts`` (``start_id``) limits the pairs to those that begin there. Events are numbered first, so the rounds
    move numbers. In each round what is reached within ``2^k`` steps goes on by the steps of that length, so a chain of n
    events takes log2(n) rounds. Without ``starts`` those steps are the pairs whose fewest steps are that many,
    already known; else they are made from those of half the length, and only pairs that begin at a start are
    kept beside them. A round without a new pair is the last one, also in circles.
    """
    named = edges.where("src_id <> dst_id and src_id is not null and dst_id is not null").select("src_id", "dst_id").distinct()
    names = cut(named.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct().withColumn("n", F.monotonically_increasing_id()))
    number = lambda c, n: names.select(F.col("id").alias(c), F.col("n").alias(n))
    step = cut(named.join(number("src_id", "at"), "src_id").join(number("dst_id", "to"), "dst_id").select("at", "to"))
    reached = step.select(F.col("at").alias("a"), F.col("to").alias("b"), F.lit(1).alias("hops"))
    if starts is not None:
        wanted = starts.select(F.col("start_id").alias("id")).distinct().join(names, "id").select(F.col("n").alias("a"))
        reached = cut(reached.join(wanted, "a", "left_semi"))
    n, length = reached.count(), 1
    while n:
        further = reached.join(step, F.col("b") == F.col("at")).where("a <> to").select("a", F.col("to").alias("b"), (F.col("hops") + length).alias("hops"))
        more = cut(reached.unionByName(further).groupBy("a", "b").agg(F.min("hops").alias("hops")))
        was, n, reached, length = n, more.count(), more, 2 * length
        if n == was:
            break
        if starts is None:
            step = reached.where(F.col("hops") == length).select(F.col("a").alias("at"), F.col("b").alias("to"))
        else:
            step = cut(step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.at")).select("x.at", "y.to").distinct())
    return reached.join(number("start_id", "a"), "a").join(number("end_id", "b"), "b").select("start_id", "end_id", "hops")


def keyed_chain(rows: DataFrame, group: list[str], index: str) -> DataFrame:
    """``start, end, hops`` of all pairs within runs of consecutive indices: gaps and islands instead of recursion."""
    w = Window.partitionBy(*group).orderBy(index)
    island = rows.select(*group, index).distinct().withColumn("_i", F.col(index) - F.row_number().over(w))
    a, b = island.alias("a"), island.alias("b")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [F.col("a._i") == F.col("b._i"), F.col("b." + index) > F.col("a." + index)]
    cond = same[0]
    for c in same[1:]:
        cond &= c
    return a.join(b, cond).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col(f"a.{index}").alias("start"), F.col(f"b.{index}").alias("end"), (F.col(f"b.{index}") - F.col(f"a.{index}")).alias("hops"))


def point_in_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, bits: int = 18) -> DataFrame:
    """Rows of ``points`` with each interval of the same key that covers ``at``, both ends included.

    A range join as an equality join: intervals are listed under every bucket of ``2**bits`` that they
    meet, points under their own.
    """
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(F.shiftright(start, bits), F.shiftright(end, bits))))
    placed = points.withColumn("_b", F.shiftright(at, bits))
    return placed.join(spread, [*key, "_b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_b")
