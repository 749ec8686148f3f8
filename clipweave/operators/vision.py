"""Model calls as injected functions, and the merging of their answers; without a model the local values stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import braces, normal_plate

ANSWER = (
    "summary string, important array<string>, tags array<string>, people array<struct<id:string,clothes:string,hair:string,description:string,is_cop:boolean,role:string>>, "
    "vehicles array<struct<id:string,color:string,plate:string>>, plates array<string>, events array<struct<type:string,start_ms:bigint,end_ms:bigint,summary:string,confidence:double>>"
)


def call_model(rows: DataFrame, key: str, columns: list[str], model: Callable[[], Callable] | None, answer: str = "answer") -> DataFrame:
    """``key, answer``: the text of a model made once per task; null where there is no model or it fails."""
    if model is None:
        return rows.select(key, F.lit(None).cast("string").alias(answer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for pdf in batches:
            told = []
            for row in pdf.to_dict("records"):
                try:
                    told.append(ask(row))
                except Exception:  # a failed call is answered by the local values
                    told.append(None)
            yield pd.DataFrame({key: pdf[key], answer: told})

    return rows.select(key, *columns).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{answer}` string")


def parsed(answer: Column) -> Column:
    """An answer's object, also with words around it; null if it is none."""
    return F.from_json(braces(answer), ANSWER)


def merge_answers(clips: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Clips with what was answered: summary, tags after the local ones, normal plates; local values elsewhere."""
    told = answers.select(key, parsed(F.col("answer")).alias("a"))
    none = F.array().cast("array<string>")
    plates = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("a.plates", none), F.coalesce(F.transform("a.vehicles", lambda v: v["plate"]), none)), normal_plate), lambda p: F.coalesce(p, F.lit("")) != ""))
    return (
        clips.join(told, key, "left")
        .withColumn("summary", F.coalesce(F.nullif(F.trim("a.summary"), F.lit("")), "summary"))
        .withColumn("summary_source", F.when(F.nullif(F.trim("a.summary"), F.lit("")).isNotNull(), "model").otherwise(F.col("summary_source")))
        .withColumn("tags", F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("a.tags", none))))
        .withColumn("plates", plates)
        .withColumn("answered_events", F.col("a.events"))
        .drop("a")
    )


_PERSON = "id:string,local_id:string,match:string,race:string,gender:string,hair:string,glasses:string,clothes:string,shoes:string,bag:string,distinctive:string,description:string,is_cop:string,role:string"
COMMIT = (
    f"people array<struct<{_PERSON}>>, vehicles array<struct<id:string,local_id:string,match:string,color:string,plate:string,analysis:string>>, "
    "plates array<struct<text:string,vehicle_id:string,confidence:double>>, objects array<struct<id:string,local_id:string,match:string,label:string,distinctive:string>>"
)


def committed(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a model says about the identities of clips, as sightings of people and of things for their folds.

    ``answers``: ``video_id, clip_index, answer`` (JSON, also with words around it). A sighting that matches an
    existing card names it; any other person is new, any other vehicle only if it is said to be. Answers that
    are no object say nothing. ``sighting_id`` is the name that the clip gave it, for rewriting its events.
    """
    told = answers.select("video_id", "clip_index", F.from_json(braces(F.col("answer")), COMMIT).alias("a"))

    def rows(kind: str) -> DataFrame:
        return told.select("video_id", "clip_index", F.posexplode(f"a.{kind}").alias("position", "x")).select("video_id", "clip_index", "position", "x.*")

    existing = F.col("match") == "existing"
    named = F.coalesce(F.nullif("local_id", F.lit("")), F.nullif("id", F.lit("")))
    people = rows("people").withColumns({"sighting_id": named, "claimed_id": F.when(existing, F.col("id")), "is_new": ~F.coalesce(existing, F.lit(False))})
    own = F.when(F.coalesce(existing, F.lit(False)) | F.startswith("id", F.lit("vehicle_")), F.col("id"))
    vehicles = rows("vehicles").withColumns({"kind": F.lit("vehicle"), "sighting_id": named, "claimed_id": own, "is_new": F.coalesce(F.lower(F.trim("match")) == "new", F.lit(False))})
    objects = rows("objects").withColumns({"kind": F.lit("object"), "sighting_id": named, "claimed_id": F.when(existing, F.col("id")), "is_new": F.lit(False)})
    plates = rows("plates").select("video_id", "clip_index", "position", F.lit("plate").alias("kind"), F.col("text").alias("sighting_id"), F.col("text").alias("plate"), "vehicle_id", "confidence")
    # Vehicles come before the plates that name them, and objects last.
    ordered = [d.withColumn("position", F.col("position") + k * 1_000_000) for k, d in enumerate((vehicles, plates, objects))]
    things = ordered[0].unionByName(ordered[1], allowMissingColumns=True).unionByName(ordered[2], allowMissingColumns=True)
    return people, things
