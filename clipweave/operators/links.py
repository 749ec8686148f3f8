"""Joins of the things that an event mentions by name to the things of its video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_names(mentions: DataFrame, things: DataFrame, text: str | None = None) -> DataFrame:
    """``mentions`` (``video_id, x, ...``) with the ``thing_id`` of every thing of the same video that ``x`` names.

    A thing (``id, video_id, local_id``) is named by its id, its local id or, case aside, by the column
    ``text``. Three alternatives are one equality join: a thing is listed under each of its names, a mention
    under each of its readings. A mention that names nothing has no row; names never reach another video.
    """
    names = F.array(F.col("id"), F.col("local_id"), *([F.concat(F.lit("="), F.nullif(F.upper(text), F.lit("")))] if text else []))
    named = things.select(F.col("id").alias("thing_id"), "video_id", F.explode(F.array_distinct(F.array_compact(names))).alias("_name"))
    readings = F.array(F.col("x"), *([F.concat(F.lit("="), F.upper("x"))] if text else []))
    read = mentions.withColumn("_name", F.explode(F.array_compact(readings)))
    return read.join(named, ["video_id", "_name"]).drop("_name").distinct()
