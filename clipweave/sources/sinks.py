"""Sinks: registry and status rows, transcripts, graph tables and rewritten media paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import minute_clock
from ..functions.text import strip
from ..plans.graph import EDGES, NODES, FootageGraph
from ..session import cut


#: The fields of a clip record that come first.
CLIP_FIELDS = (
    "id", "video_id", "index", "start_ms", "end_ms", "transcript", "transcript_segments", "asr_error", "summary", "important", "clip_uri", "audio_uri", "folder_uri",
    "splice_uri", "tagged_splice_uri",
)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of the same key; columns ``keep`` survive a null in ``new``."""
    if keep:
        old = existing.select(*key, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(old, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in keep}).drop(*[f"_{c}" for c in keep])
    return existing.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def video_transcripts(clips: DataFrame) -> DataFrame:
    """``video_id, value``: a video's clips in order, each with its clocks and its words or ``(no speech)``.

    One text per video is what this sink writes, so a video's transcripts meet in one row; ``transcript_parts``
    has them as lines that can be written part by part.
    """
    ordered = F.array_sort(F.collect_list(F.struct("index", "id", "part")))
    parts = F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n")
    return transcript_parts(clips).groupBy("video_id").agg(F.concat(parts, F.lit("\n")).alias("value"))


def transcript_parts(clips: DataFrame) -> DataFrame:
    """``video_id, index, id, part``: the heading and the words of each clip."""
    words = F.coalesce(F.nullif(strip(F.col("transcript")), F.lit("")), F.lit("(no speech)"))
    head = F.concat(F.lit("## "), F.coalesce("local_id", "id"), F.lit("  "), minute_clock(F.col("start_ms")), F.lit("–"), minute_clock(F.col("end_ms")))
    return clips.select("video_id", "index", "id", F.concat(head, F.lit("\n\n"), words).alias("part"))


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """An overwrite whose commit makes all files visible at once, or of the partitions that ``df`` holds."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    writer.parquet(path)


def write_clip_records(clips: DataFrame, path: str) -> None:
    """A JSON file set of clip records by video, in the order of the record's fields; a commit makes all visible at once."""
    first = [c for c in CLIP_FIELDS if c in clips.columns]
    write = clips.select(*first, *[c for c in clips.columns if c not in first])
    write.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").json(path)


def write_identities(cards: DataFrame, path: str) -> None:
    """Cards of people, vehicles, plates and objects by video and kind; the videos that ``cards`` holds are replaced."""
    cards.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "kind").json(path)


def write_graph(graph: FootageGraph, path: str) -> None:
    """Every table of a graph under ``path``; the tables are cut off first, so a graph may be written where it came from."""
    tables = {f"node_{k}": cut(df) for k, df in graph.nodes.items()} | {f"edge_{k}": cut(df) for k, df in graph.edges.items()}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark, path: str) -> FootageGraph:
    return FootageGraph.of(spark, {k: spark.read.parquet(f"{path}/node_{k}") for k in NODES}, {k: spark.read.parquet(f"{path}/edge_{k}") for k in EDGES})


def move_uris(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with the prefix ``old`` of every ``*_uri`` and ``source_path`` column replaced by ``new``."""
    cols = [c for c in df.columns if c.endswith("_uri") or c == "source_path"]
    return df.withColumns({c: F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.expr(f"substring(`{c}`, {len(old) + 1})"))).otherwise(F.col(c)) for c in cols})


def move_graph_uris(graph: FootageGraph, old: str, new: str) -> FootageGraph:
    for k, df in graph.nodes.items():
        graph = graph.with_node(k, move_uris(df, old, new))
    return graph
