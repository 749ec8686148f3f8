"""Sources of footage: the drop folder, clip records, audio and the registry of what was taken in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings of videos, seconds that a file must have been left alone, bytes of a fingerprint's ends.
ENDINGS = ("mp4", "mov", "avi", "mkv", "m4v", "webm")
SETTLED_S, END_BYTES = 15, 1 << 20

REGISTRY = "source_name string, video_id string, fingerprint string, status string, size_bytes bigint, updated_at string"
CLIP = (
    "id string, video_id string, index int, start_ms bigint, end_ms bigint, clip_uri string, audio_uri string, folder_uri string, transcript string, "
    "transcript_segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, cells array<struct<index:int,at_s:double,start_ms:bigint,clock:string,uri:string>>, "
    "signals struct<loudness:double,loud_impact:double,loud_speech:double,yelling:double,impact_at_ms:int,repeated_commands:int>, "
    "keyword_hits array<struct<definition:string,phrase:string,count:int,start_ms:bigint,clock:string>>, "
    "entities array<struct<id:string,type:string,label:string,confidence:double,box:array<int>,frame_uri:string,at_s:double>>, summary string, summary_source string, "
    "tags array<string>, model map<string,string>"
)


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def drop_folder(spark: SparkSession, folder: str, known: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """``path, source_name, size_bytes, modified`` of new videos in a folder, by name.

    Only the files' metadata are read. Dot files, other endings, files changed in the last seconds and
    those that the registry ``known`` has by name and size are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.*").load(folder).select("path", "modificationTime", "length")
    found = files.select("path", _name(F.col("path")).alias("source_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")).where(
        F.lower(F.regexp_extract("source_name", r"\.([^.]*)$", 1)).isin(*ENDINGS)
        & ~F.startswith("source_name", F.lit("."))
        & (F.col("modified") <= (now if now is not None else F.current_timestamp()) - F.expr(f"interval {SETTLED_S} seconds"))
    )
    if known is not None:
        found = found.join(known.select("source_name", "size_bytes").distinct(), ["source_name", "size_bytes"], "left_anti")
    return found.orderBy("source_name")


def next_video(found: DataFrame) -> DataFrame:
    return found.orderBy("source_name").limit(1)


def video_id(source_name: Column) -> Column:
    """A file name's stem as an id; ``video`` if nothing is left."""
    stem = F.regexp_replace(source_name, r"\.[^.]*$", "")
    made = F.lower(F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("video"))


def resolve_video_ids(files: DataFrame, ingested: DataFrame, done: str = "graphed") -> DataFrame:
    """``source_name, video_id`` of files: the id of an ingested video of their stem, else the first finished one whose id goes on after it, else the stem.

    Ids are listed under each of their beginnings before an underscore, so this is an equality join.
    """
    stems = files.select("source_name", video_id(F.col("source_name")).alias("stem")).distinct()
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("video_id")), lambda i: F.when(F.substr("video_id", i, F.lit(1)) == "_", F.substr("video_id", F.lit(1), i - 1))), lambda x: x.isNotNull())
    known = ingested.where("video_id is not null").select("video_id", "status").distinct()
    exact = known.select(F.col("video_id").alias("stem"), "video_id", F.lit(0).alias("order"))
    longer = known.where(F.col("status") == done).select(F.explode(cuts).alias("stem"), "video_id", F.lit(1).alias("order"))
    best = exact.unionByName(longer).groupBy("stem").agg(F.min(F.struct("order", "video_id")).alias("b"))
    return stems.join(best, "stem", "left").select("source_name", F.coalesce("b.video_id", "stem").alias("video_id"))


def ingest_records(files: DataFrame, ingested: DataFrame, probed: DataFrame | None = None, at: Column | None = None, root: str = "") -> DataFrame:
    """A record for each new file (``path, source_name, size_bytes``): its id, the places of its media, what was probed, and its status."""
    named = files.join(resolve_video_ids(files, ingested), "source_name")
    place = lambda name: F.concat(F.lit(root), F.lit("/videos/"), "video_id", F.lit("/"), name)
    ending = F.lower(F.regexp_extract("source_name", r"\.([^.]*)$", 1))
    probe = "duration_s double, fps double, width int, height int"
    cells = [p.split(" ") for p in probe.split(", ")]
    rows = named.join(probed.select("path", *[n for n, _ in cells]), "path", "left") if probed is not None else named.withColumns({n: F.lit(None).cast(t) for n, t in cells})
    return rows.select(
        "video_id", "source_name", F.col("path").alias("source_path"), place(F.concat(F.lit("original."), ending)).alias("original_uri"), place(F.lit("audio_16k.wav")).alias("audio_uri"),
        place(F.lit("processing.mp4")).alias("processing_uri"), *[n for n, _ in cells], "size_bytes",
        (at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("ingested_at"), F.lit("copied").alias("status"), F.lit(False).alias("cached"),
    )


PROBE = "streams array<struct<width:int,height:int,r_frame_rate:string>>, format struct<duration:string>"


def probe_fields(answer: Column) -> Column:
    """``width, height, fps, duration_s`` of a probe's JSON answer; a rate ``n/0`` and what is missing are null."""
    a = F.from_json(answer, PROBE)
    first = F.try_element_at(a["streams"], F.lit(1))
    rate = F.split(first["r_frame_rate"], "/")
    fps = F.when(F.size(rate) == 2, F.round(F.try_divide(F.try_element_at(rate, F.lit(1)).try_cast("double"), F.try_element_at(rate, F.lit(2)).try_cast("double")), 3))
    return F.struct(first["width"].alias("width"), first["height"].alias("height"), fps.alias("fps"), a["format"]["duration"].try_cast("double").alias("duration_s"))


def probe(files: DataFrame, tool=None) -> DataFrame:
    """``path`` with the probe's fields, by an injected tool ``tool() -> callable(path) -> JSON text``; nulls without one or where it fails."""
    if tool is None:
        return files.select("path", probe_fields(F.lit(None).cast("string")).alias("p")).select("path", "p.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = tool()
        for pdf in batches:
            told = []
            for p in pdf["path"]:
                try:
                    told.append(ask(p))
                except Exception:  # a file that cannot be probed has no fields
                    told.append(None)
            yield pd.DataFrame({"path": pdf["path"], "answer": told})

    return files.select("path").mapInPandas(run, "path string, answer string").select("path", probe_fields(F.col("answer")).alias("p")).select("path", "p.*")


def status_rows(videos: DataFrame, status: str | None, step: Column, log: DataFrame | None = None) -> DataFrame:
    """The log of states with a row for each of ``videos``: a status, or its own."""
    rows = videos.select("video_id", (F.lit(status) if status else F.col("status")).alias("status"), step.alias("step")).distinct()
    return rows if log is None else log.unionByName(rows)


def last_status(log: DataFrame) -> DataFrame:
    """The last state of each video."""
    return log.groupBy("video_id").agg(F.max_by("status", F.struct("step", "status")).alias("status"))


def run_report(done: DataFrame) -> DataFrame:
    """One row of a run: how many videos it finished, which, and how many clips each has. A run takes the few videos of one drop."""
    listed = F.array_sort(F.collect_list(F.struct("id", "clip_count")))
    of = lambda name: F.transform("l", lambda x: x[name]).alias(f"{'video_ids' if name == 'id' else 'clip_counts'}")
    return done.agg(F.count("*").alias("graphed"), listed.alias("l")).select("graphed", of("id"), of("clip_count"))


def fingerprint(content: Column, size: Column) -> Column:
    """SHA-256 of the size with the first and, of files over two, the last MiB."""
    head, tail = F.substring(content, 1, END_BYTES), F.substring(content, -END_BYTES, END_BYTES)
    whole = F.concat(size.cast("string").cast("binary"), head, F.when(size > 2 * END_BYTES, tail).otherwise(F.lit(b"")))
    return F.sha2(whole, 256)


def file_prints(files: DataFrame) -> DataFrame:
    """``path, fingerprint`` of files on a mounted path, as ``fingerprint`` of their contents: only both ends are read, whatever their size.

    Files that cannot be read have none.
    """

    def print_of(path: str) -> str | None:
        try:
            with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
                size = f.seek(0, 2)
                f.seek(0)
                digest = hashlib.sha256(str(size).encode() + f.read(END_BYTES))
                if size > 2 * END_BYTES:
                    f.seek(size - END_BYTES)
                    digest.update(f.read(END_BYTES))
                return digest.hexdigest()
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "fingerprint": [print_of(p) for p in pdf["path"]]})

    return files.select("path").mapInPandas(run, "path string, fingerprint string")


def cached(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files that the registry knows by fingerprint, or by name and size: two equality joins."""
    by_print = files.join(registry.where("fingerprint is not null").select("fingerprint", F.col("video_id").alias("known_id")).distinct(), "fingerprint")
    by_name = files.join(registry.select("source_name", "size_bytes", F.col("video_id").alias("known_id")).distinct(), ["source_name", "size_bytes"])
    return by_print.select(*files.columns, "known_id").unionByName(by_name.select(*files.columns, "known_id")).distinct()


def clip_records(spark: SparkSession, path: str) -> DataFrame:
    """Clip records from JSON files under a fixed schema, in order; broken ones are kept in ``_broken``.

    ``path`` is a video's folder of clips: one folder per clip, or where there are none, one file per clip.
    """
    read = lambda glob: spark.read.schema(CLIP + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(f"{path}/{glob}")
    try:
        found = read("clip_*/clip.json")
    except AnalysisException:
        found = read("clip_*.json")
    return found.orderBy("video_id", "index", "id")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries from a JSON file that maps source names to them; without a file there are none."""
    return _mapped(spark, path, REGISTRY.split(", ", 1)[1]).withColumnRenamed("name", "source_name").where("not startswith(source_name, '_')")


def _mapped(spark: SparkSession, path: str, entry: str) -> DataFrame:
    schema = f"map<string,struct<{entry.replace(' ', ':')}>>".replace(",:", ",")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    return text.select(F.explode(F.from_json("value", schema)).alias("name", "e")).select("name", "e.*")


def identities(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """Cards of one kind (``people, vehicles, plates, objects``) from a video's identities file, or of a list or ``{"people": [...]}`` of people.

    A broken or missing file has none; people without an id are left out.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    card = f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in schema.split(', '))}>>"
    cards = F.coalesce(F.from_json("value", f"struct<{kind}:{card}>")[kind], F.from_json("value", card))
    rows = text.select(F.explode(cards).alias("c")).select("c.*")
    return rows.where("coalesce(id, '') <> ''") if kind == "people" else rows


def unfinished(clips: DataFrame, done: DataFrame) -> DataFrame:
    """Clips without a finished analysis."""
    return clips.join(done.select("id").distinct(), "id", "left_anti")


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, samples`` of 16-bit WAV files; files without audio give an empty array."""
    import io
    import wave

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content), "rb") as w:
                        rows.append((p, w.getframerate() or 16_000, np.frombuffer(w.readframes(w.getnframes()), "<i2").tolist()))
                except (wave.Error, EOFError):
                    rows.append((p, 16_000, []))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, samples array<smallint>")


def transcribe(audio: DataFrame, model=None) -> DataFrame:
    """``path, transcript, error`` by an injected speech model, made once per task; without one all are unavailable."""
    if model is None:
        return audio.select("path", F.lit("").alias("transcript"), F.lit("model_unavailable").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hear = model()
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "transcript": [hear(s) for s in pdf["samples"]], "error": None})

    return audio.select("path", "samples").mapInPandas(run, "path string, transcript string, error string")
