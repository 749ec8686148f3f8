"""Scene roles: who an event is about, first by the events that list a person, then for each event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types that have a subject.
SUBJECT_EVENTS = (
    "traffic_stop",
    "arrest",
    "handcuffing",
    "physical_restraint",
    "miranda_warning",
    "interrogation",
    "field_sobriety_test",
    "search_person",
    "verbal_escalation",
    "foot_pursuit",
)
#: Words of an officer's clothes; milliseconds around an event in which words belong to it, the segments and letters taken.
OFFICER_CLOTHES = ("police", "uniform", "badge")
AROUND_MS, SEGMENTS, LETTERS, QUOTED = 20_000, 4, 240, 180


def words_around(start_ms: Column, clip_start: Column, segments: Column | None, transcript: Column) -> Column:
    """What is said around a time: the first segments within 20 s of it, else the beginning of the transcript."""
    said = F.substring(F.trim(F.coalesce(transcript, F.lit(""))), 1, LETTERS)
    if segments is None:
        return said
    at = F.greatest(start_ms - clip_start, F.lit(0))
    near = F.filter(segments, lambda s: (F.abs(F.coalesce(s["start_ms"], F.lit(0)) - at) <= AROUND_MS) & (F.trim(s["text"]) != ""))
    told = F.array_join(F.transform(F.slice(near, 1, SEGMENTS), lambda s: F.trim(s["text"])), " ")
    return F.coalesce(F.nullif(told, F.lit("")), said)


def looks_civilian(clothes: Column, description: Column) -> Column:
    """Whether something is known of a person, and not an officer's clothes."""
    worn = F.lower(F.coalesce(clothes, F.lit("")))
    officer = F.lit(False)
    for word in OFFICER_CLOTHES:
        officer = officer | F.contains(worn, F.lit(word))
    return ~officer & ((worn != "") | (F.coalesce(description, F.lit("")) != ""))


def event_role(is_cop: Column, suspect: Column, event_type: Column, subject_types: Sequence[str] = SUBJECT_EVENTS) -> Column:
    """The role of a person on an event."""
    subject = F.coalesce(suspect, F.lit(False)) & F.coalesce(event_type.isin(*subject_types), F.lit(False))
    return F.when(is_cop, "officer").when(subject, "potential_suspect").when(~is_cop, "civilian").otherwise("unknown")


def snapshot(description: Column, clothes: Column, distinctive: Column) -> Column:
    """A person in one line: the description, then clothes and mark where it leaves them out."""
    text, worn, mark = (F.coalesce(c, F.lit("")) for c in (description, clothes, distinctive))
    first = F.when((worn != "") & ~F.contains(text, worn), worn)
    so_far = F.concat_ws(" ", text, first)
    parts = (F.nullif(text, F.lit("")), first, F.when((mark != "") & ~F.contains(so_far, mark), mark))
    return F.trim(F.concat_ws(" | ", *parts))


def first_subjects(involved: DataFrame, subject_types: Sequence[str], order: list[str]) -> DataFrame:
    """The first event that makes each person its subject: ``person_id, event_type, at, reason``.

    ``involved``: a row for each person on an event, ``person_id, type, clock, start_ms, clip_start, transcript,
    is_cop, clothes, description`` (``transcript_segments`` if there are any). Officers are no subjects; who is
    neither known as a civilian nor looks like one isn't either. Reduced before the shuffle.
    """
    gate = F.coalesce(~F.col("is_cop"), looks_civilian(F.col("clothes"), F.col("description")))
    segments = F.col("transcript_segments") if "transcript_segments" in involved.columns else None
    said = words_around(F.col("start_ms"), F.col("clip_start"), segments, F.col("transcript"))
    rows = involved.where(F.col("type").isin(*subject_types) & gate).select("person_id", "type", "clock", *order, said.alias("said"))
    first = rows.groupBy("person_id").agg(F.min_by(F.struct("type", "clock", "said"), F.struct(*order)).alias("f"))
    # The sentence of a reason.
    head = F.concat(F.replace("f.type", F.lit("_"), F.lit(" ")), F.lit(" at "), F.col("f.clock"), F.lit(": "))
    quote = F.concat(F.lit('officer is addressing this civilian. Transcript: "'), F.substring("f.said", 1, QUOTED), F.lit('"'))
    reason = F.concat(head, F.when(F.col("f.said") != "", quote).otherwise("only civilian on this event."))
    return first.select("person_id", F.col("f.type").alias("event_type"), F.col("f.clock").alias("at"), reason.alias("reason"))


def tag_people(people: DataFrame, found: DataFrame) -> DataFrame:
    """``people`` with ``role, potential_suspect`` and what explains them, from ``first_subjects`` or a model's answer.

    An officer is never tagged; who is untagged and no officer is a civilian, also if nothing is known.
    """
    told = found.select(F.col("person_id").alias("id"), F.struct("event_type", "at", "reason").alias("_f"))
    tagged = F.col("_f").isNotNull() & ~F.coalesce("is_cop", F.lit(False))
    on = lambda value: F.when(tagged, value)
    role = on(F.lit("potential_suspect")).when(F.col("is_cop"), "officer").otherwise("civilian")
    return people.join(told, "id", "left").withColumns(
        {
            "role": role,
            "potential_suspect": tagged,
            "suspect_reason": on(F.trim(F.coalesce("_f.reason", F.lit("")))),
            "suspect_at": on(F.coalesce("_f.at", F.lit(""))),
            "suspect_event": on(F.coalesce("_f.event_type", F.lit(""))),
            "suspect_snapshot": on(snapshot(F.col("description"), F.col("clothes"), F.col("distinctive"))),
        }
    ).drop("_f")
