"""Periods on screen of the people in a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import moment
from .intervals import merge_intervals


def presence(events: DataFrame) -> DataFrame:
    """Merged periods and gaps of each person of a video, from ``clip_events``.

    Columns ``video_id, person_id, kind, from_ms, to_ms``; kind ``merged`` for a period made of two or
    more events, ``gap`` for the time between neighbouring periods. Events without a start, an end or
    an end after the start have no interval; null members and null lists name nobody.
    """
    intervals = events.select(
        F.col("video_id").alias("k0"),
        F.explode(F.array_distinct("people_ids")).alias("k1"),
        moment(F.col("start_ms"), F.col("start_timestamp")).alias("s"),
        moment(F.col("end_ms"), F.col("end_timestamp")).alias("e"),
        F.xxhash64("id").alias("event"),
    )
    return (
        merge_intervals(intervals)
        .where("kind = 'gap' or events_many")
        .select(
            F.col("k0").alias("video_id"),
            F.col("k1").alias("person_id"),
            F.when(F.col("kind") == "period", "merged").otherwise("gap").alias("kind"),
            F.col("s").alias("from_ms"),
            F.col("e").alias("to_ms"),
        )
    )
