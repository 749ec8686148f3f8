"""Stretches of events that repeat one event, collapsed to one event with its count and duration.

The events of a video are cut into chunks of time, each of them sorted in one task. Per chunk the
positions at which a run starts form a sorted array; each event finds its run in it by binary search,
and the runs are reduced from there. Runs at the edges of a chunk are stitched by a window over at
most two rows per video and chunk, a number that the length of the video bounds, so a video with any
share of the rows is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import moment
from ..session import broadcast_if_small, cut, join_unique
from .canonical import UNMATCHED, catalog_names, map_values

#: Milliseconds of a chunk, as a power of two; about 70 minutes.
CHUNK_BITS = 22
#: Milliseconds after the start of the event before within which an event repeats it.
NEAR_MS = 30_000
BATCH_ROWS = 200_000

_IN = ["video_id", "chunk", "first_ms", "first_id", "what", "says", "says_full", "last_ms", "last_id", "last_key", "to_ms", "n"]
_PIECE = (
    "video_id string, chunk bigint, first_ms bigint, first_id string, what bigint, says bigint, says_full bigint, "
    "last_ms bigint, last_id string, last_key bigint, to_ms bigint, n bigint, edge boolean"
)


def _runs(pdf: pd.DataFrame, near: int) -> pd.DataFrame:
    """Sorted pieces of runs (single events at first) to longest runs within their chunk."""
    video, chunk = pdf["video_id"].to_numpy(), pdf["chunk"].to_numpy()
    same = (video[1:] == video[:-1]) & (chunk[1:] == chunk[:-1])
    again = same & (pdf["first_id"].to_numpy()[1:] == pdf["last_id"].to_numpy()[:-1])
    if again.any():
        return _runs(pdf[np.append(True, ~again)].reset_index(drop=True), near)
    what, key = pdf["what"].to_numpy(), pdf["last_key"].to_numpy()[:-1]
    close = pdf["first_ms"].to_numpy()[1:] - pdf["last_ms"].to_numpy()[:-1] <= near
    named = (pdf["says"].to_numpy()[1:] == key) | (pdf["says_full"].to_numpy()[1:] == key)
    repeats = same & (what[1:] == what[:-1]) & (what[1:] != 0) & (close | named)
    starts = np.flatnonzero(np.append(True, ~repeats))
    run = np.searchsorted(starts, np.arange(len(pdf)), "right") - 1
    ends = np.append(starts[1:], len(pdf)) - 1
    out = pdf.iloc[starts].reset_index(drop=True)
    for c in ("last_ms", "last_id", "last_key"):
        out[c] = pdf[c].to_numpy()[ends]
    out["to_ms"] = np.maximum.reduceat(pdf["to_ms"].to_numpy(), starts)
    out["n"] = np.bincount(run, weights=pdf["n"].to_numpy()).astype(np.int64)
    return out


def _chunks(near: int, singles: bool):
    def emit(pdf: pd.DataFrame, before: tuple | None, after: tuple | None) -> pd.DataFrame:
        video, chunk = pdf["video_id"].to_numpy(), pdf["chunk"].to_numpy()
        new = (video[1:] != video[:-1]) | (chunk[1:] != chunk[:-1])
        ends = [(video[i], chunk[i]) for i in (0, -1)]
        edge = np.append(before != ends[0], new) | np.append(new, after != ends[1])
        pdf = pdf.assign(edge=edge)
        return pdf if singles else pdf[pdf["edge"] | (pdf["n"] > 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        before, n = None, 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n < BATCH_ROWS:
                continue
            done = _runs(pd.concat(held, ignore_index=True), near)
            tail = done.iloc[-1:]
            if len(done) > 1:
                yield emit(done.iloc[:-1], before, (tail["video_id"].iloc[0], tail["chunk"].iloc[0]))
                before = (done["video_id"].iloc[-2], done["chunk"].iloc[-2])
            held, n = [tail], 1
        if held:
            yield emit(_runs(pd.concat(held, ignore_index=True), near), before, None)

    return run


def collapse_runs(events: DataFrame, near_ms: int = NEAR_MS, singles: bool = True) -> DataFrame:
    """Longest runs of events that repeat one another.

    ``events``: ``video_id, id`` (strings), ``ms`` (bigint, the start), ``to_ms``, ``what`` (bigint that
    stands for the meaning, null if none) and ``says`` (the name in continues_from); further columns are
    ignored. Events without a video, an id or a start are in no order and are left out. Repeated rows are
    one event; ties of the start are ordered by id. Returns ``video_id, first_id, last_id, n, from_ms,
    to_ms``; with ``singles`` also the events that repeat nothing, each as a run of one.
    """
    said = F.regexp_replace(F.lower("says"), r"^[\s ]+|[\s ]+$", "")
    none = F.lit(0).cast("bigint")
    rows = events.where("video_id is not null and id is not null and ms is not null").select(
        "video_id",
        F.shiftright("ms", CHUNK_BITS).alias("chunk"),
        F.col("ms").alias("first_ms"),
        F.col("id").alias("first_id"),
        F.coalesce("what", none).alias("what"),
        F.when(said != "", F.xxhash64(said)).otherwise(none).alias("says"),
        F.when(said != "", F.xxhash64(F.concat(F.lower("video_id"), F.lit(":"), said))).otherwise(none).alias("says_full"),
        F.col("ms").alias("last_ms"),
        F.col("id").alias("last_id"),
        F.xxhash64(F.regexp_replace(F.lower("id"), r"^[\s ]+|[\s ]+$", "")).alias("last_key"),
        F.greatest("ms", "to_ms").alias("to_ms"),
        F.lit(1).cast("bigint").alias("n"),
    )
    pieces = (
        rows.repartition("video_id", "chunk")
        .sortWithinPartitions("video_id", "chunk", "first_ms", "first_id")
        .mapInPandas(_chunks(near_ms, singles), _PIECE)
    )
    # Inner runs pass the window in partitions of their own chunk.
    part = F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("chunk"))
    ordered = Window.partitionBy("video_id", "part").orderBy("first_ms", "first_id")
    whole = Window.partitionBy("video_id", "part", "run")

    def before(c: str) -> Column:
        return F.lag(c).over(ordered)

    follows = (
        F.col("edge")
        & (before("chunk") != F.col("chunk"))
        & (before("what") == F.col("what"))
        & (F.col("what") != 0)
        & (
            (F.col("first_ms") - before("last_ms") <= near_ms)
            | (before("last_key") == F.col("says"))
            | (before("last_key") == F.col("says_full"))
        )
    )
    return (
        pieces.withColumn("part", part)
        .withColumn("follows", F.coalesce(follows, F.lit(False)))
        .withColumn("run", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(ordered))
        .groupBy("video_id", "part", "run")
        .agg(
            F.min_by("first_id", F.struct("first_ms", "first_id")).alias("first_id"),
            F.max_by("last_id", F.struct("last_ms", "last_id")).alias("last_id"),
            F.sum("n").alias("n"),
            F.min("first_ms").alias("from_ms"),
            F.max("to_ms").alias("to_ms"),
        )
        .drop("part", "run")
    )


def repeated_events(clip_events: DataFrame, event_catalog: DataFrame, singles: bool = True) -> DataFrame:
    """``collapse_runs`` of ``clip_events``, whose types mean entries of the catalog as ``map_values`` reads them."""
    reference = catalog_names(event_catalog)
    entries = broadcast_if_small(reference.select(F.col("entry").alias("type"), F.col("entry").alias("exact")).distinct())
    timed = clip_events.select(
        "video_id",
        "id",
        "type",
        moment(F.col("start_ms"), F.col("start_timestamp")).alias("ms"),
        moment(F.col("end_ms"), F.col("end_timestamp")).alias("to_ms"),
        F.col("continues_from").alias("says"),
    ).join(entries, "type", "left")
    loose = timed.where("exact is null and type is not null")
    mapped = cut(map_values(loose.select(F.lit("event_type").alias("kind"), F.col("type").alias("value")), reference).select(
        F.col("value").alias("type"), F.when(F.col("canonical") != UNMATCHED, F.col("canonical")).alias("meant")
    ))
    clear = timed.where("exact is not null or type is null").withColumn("meant", F.col("exact"))
    read = clear.unionByName(join_unique(loose, mapped, ["type"], "left"))
    return collapse_runs(read.withColumn("what", F.when(F.col("meant").isNotNull(), F.xxhash64("meant"))), singles=singles)
