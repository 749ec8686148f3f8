"""Searches in the cards of a video, and what a caller sees of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import signature

#: Attributes by which people are searched, and how many of the last events are shown.
SEARCHED = ("clothes", "race", "gender", "hair", "glasses")
LAST = 20


def _either(column: str, wanted: str) -> Column:
    """Whether one text is within the other, case aside; an unsaid text is within any."""
    text = F.lower(F.coalesce(column, F.lit("")))
    return F.contains(text, F.lit(wanted)) | F.contains(F.lit(wanted), text)


def search_people(people: DataFrame, is_cop: bool | None = None, **attributes: str) -> DataFrame:
    """People that agree with all attributes told; an officer must be known as one, a civilian only not as an officer."""
    if unknown := set(attributes) - set(SEARCHED):
        raise ValueError(f"people are not searched by {', '.join(sorted(unknown))}")
    if is_cop is not None:
        people = people.where(F.coalesce("is_cop", F.lit(False)) if is_cop else ~F.coalesce("is_cop", F.lit(False)))
    for name, told in attributes.items():
        wanted = (told or "").strip().lower()
        if wanted and wanted != "unknown":
            people = people.where(_either(name, wanted))
    return people


def search_vehicles(vehicles: DataFrame, color: str = "", plate: str = "") -> DataFrame:
    text = "".join(c for c in plate.upper() if c.isalnum())
    if text:
        vehicles = vehicles.where(F.col("plate") == text)
    wanted = color.strip().lower()
    return vehicles.where(F.contains(F.lower("color"), F.lit(wanted))) if wanted else vehicles


def search_plates(plates: DataFrame, text: str) -> DataFrame:
    """Plates with a text in them; an empty text finds none."""
    return plates.where(F.contains("text", F.lit(text.upper())) if text else F.lit(False))


def search_objects(objects: DataFrame, label: str = "", distinctive: str = "") -> DataFrame:
    for column, told in (("label", label), ("distinctive", distinctive)):
        if told:
            objects = objects.where(F.contains(F.lower(column), F.lit(told.lower())))
    return objects


def last_events(events: DataFrame, event_type: str = "", n: int = LAST) -> DataFrame:
    """The last events by time, of one type or of all."""
    rows = events.where(F.col("type") == event_type.strip()) if event_type.strip() else events
    return rows.orderBy(F.desc_nulls_last("start_ms"), F.desc("id")).limit(n)


def _told(df: DataFrame, name: str, otherwise: str) -> Column:
    return (F.coalesce(F.nullif(name, F.lit("")), F.lit(otherwise)) if name in df.columns else F.lit(otherwise)).alias(name)


def public_people(people: DataFrame) -> DataFrame:
    """What is shown of people: unknown attributes as ``unknown``, a role also where none is stored, the signature made if there is none."""
    have = set(people.columns)
    made = people
    for k in ("race", "gender", "hair", "glasses", "clothes", "shoes", "bag", "distinctive", "signature", "role"):
        if k not in have:
            made = made.withColumn(k, F.lit(None).cast("string"))
    role = F.coalesce(F.nullif("role", F.lit("")), F.when(F.col("is_cop"), "officer").otherwise("civilian"))
    return made.select(
        "id", F.col("local_id").alias("person_id"), F.coalesce(F.nullif("signature", F.lit("")), signature()).alias("signature"),
        *[_told(made, k, "unknown") for k in ("race", "gender", "hair", "glasses")], _told(made, "clothes", ""), "is_cop", role.alias("role"),
        F.coalesce("potential_suspect" if "potential_suspect" in have else F.lit(None), F.lit(False)).alias("potential_suspect"), _told(made, "description", ""),
        (F.col("last_clip") if "last_clip" in have else F.lit(None).cast("int")).alias("last_clip"),
    )


def public_vehicles(vehicles: DataFrame) -> DataFrame:
    return vehicles.select("id", *[_told(vehicles, k, "") for k in ("color", "plate", "analysis")])


def public_objects(objects: DataFrame) -> DataFrame:
    return objects.select("id", *[_told(objects, k, "") for k in ("label", "distinctive")])
