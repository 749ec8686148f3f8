"""Media clocks as Column expressions; every function stays in whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A clock anywhere in a text: optional hours, minutes, seconds, optional fraction.
CLOCK = r"(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{2})(?:\.([0-9]{1,3}))?"
_DIGITS = r"^\s*([0-9]+)\s*$"


def format_clock(ms: Column) -> Column:
    """Milliseconds as ``MM:SS`` or ``H:MM:SS``; null and negative read ``00:00``."""
    total = F.greatest(F.coalesce(ms.cast("bigint"), F.lit(0)), F.lit(0))
    seconds = F.floor(total / 1000).cast("bigint")
    hours, minutes, rest = F.floor(seconds / 3600).cast("bigint"), F.floor(seconds % 3600 / 60).cast("bigint"), seconds % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%02d:%02d", minutes, rest)
    )


def parse_clock(text: Column) -> Column:
    """A clock text in milliseconds: all digits are milliseconds, else the first clock in it; else null."""
    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, CLOCK, i), F.lit("")), F.lit("0"))

    clock = (part(1).cast("bigint") * 3600 + part(2).cast("bigint") * 60 + part(3).cast("bigint")) * 1000 + F.rpad(
        part(4), 3, "0"
    ).cast("bigint")
    return F.when(text.rlike(_DIGITS), F.try_to_number(F.regexp_extract(text, _DIGITS, 1), F.lit("9" * 18)).cast("bigint")).when(
        text.rlike(CLOCK), clock
    )


def clock_seconds(text: Column) -> Column:
    """A clock in seconds: digits under 1000 are seconds already, all else as ``parse_clock``."""
    digits = F.regexp_extract(text, _DIGITS, 1)
    number = F.when(digits != "", digits.cast("double"))
    return F.when(number < 1000, number).otherwise(parse_clock(text) / 1000.0)


def moment(ms: Column, clock: Column) -> Column:
    """A time in milliseconds, read from the clock where the number is missing."""
    return F.coalesce(ms.cast("bigint"), parse_clock(clock))


def parse_ms(value: str | int | float | None) -> int | None:
    """``parse_clock`` of one value on the driver; numbers are milliseconds."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        return int(value)
    if m := re.match(_DIGITS, value):
        return int(m[1])
    if not (m := re.search(CLOCK, value)):
        return None
    h, minute, s, frac = (x or "0" for x in m.groups())
    return (int(h) * 3600 + int(minute) * 60 + int(s)) * 1000 + int(frac.ljust(3, "0"))


def parse_seconds(value: str | int | float | None) -> float | None:
    """``clock_seconds`` of one value on the driver."""
    if isinstance(value, str) and (m := re.match(_DIGITS, value)) and int(m[1]) < 1000:
        return float(m[1])
    ms = parse_ms(value)
    return None if ms is None else ms / 1000


def clip_time(value: Column, start: Column, end: Column, relative: Column | bool = False) -> Column:
    """A time of a clip as video milliseconds within its bounds, null for none; ``relative`` times count from its start."""
    last = F.greatest(start, F.coalesce(end, start))
    told = F.when(F.lit(relative) if isinstance(relative, bool) else relative, start + value).otherwise(value)
    return F.when(told.isNotNull(), F.greatest(start, F.least(last, told)))


def event_window(
    start_ms: Column, start_clock: Column, end_ms: Column, end_clock: Column, cell_ms: Column, hint_ms: Column, clip_start: Column, clip_end: Column
) -> Column:
    """``start_ms, end_ms, clock, end_clock, seek_s`` of an event of a clip.

    The start is what the event states, else its cell, a hint, the clip's start; the end what it states, else
    30 s on; an end before the start is put a second after it. No end lies beyond the clip's.
    """
    last = F.greatest(clip_start, F.coalesce(clip_end, clip_start))
    stated = lambda ms, text: clip_time(F.coalesce(ms, parse_clock(text)), clip_start, last)
    start = F.coalesce(stated(start_ms, start_clock), cell_ms, hint_ms, clip_start)
    told = F.coalesce(stated(end_ms, end_clock), F.least(last, start + 30_000))
    end = F.when(told < start, F.least(last, start + 1000)).otherwise(told)
    return F.struct(
        start.alias("start_ms"), end.alias("end_ms"), format_clock(start).alias("clock"), format_clock(end).alias("end_clock"), (start / 1000.0).alias("seek_s")
    )


def minute_clock(ms: Column) -> Column:
    """Milliseconds as ``MM:SS`` with minutes beyond 59; null and negative read ``00:00``."""
    total = F.floor(F.greatest(F.coalesce(ms.cast("bigint"), F.lit(0)), F.lit(0)) / 1000).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("bigint"), total % 60)


def padded_clock(ms: Column) -> Column:
    """Milliseconds as ``MM:SS``, or ``HH:MM:SS`` from an hour on; null and negative read ``00:00``."""
    text = format_clock(ms)
    return F.when(F.length(text) == 7, F.concat(F.lit("0"), text)).otherwise(text)


def transcript_timeline(start_ms: Column, segments: Column, transcript: Column, limit: int = 40) -> Column:
    """The first segments of a clip with their clocks, a line each; else its transcript; else ``(no speech)``."""
    start = F.coalesce(start_ms, F.lit(0))
    line = lambda at, text: F.concat(F.lit("["), format_clock(at), F.lit("] "), F.trim(text))
    said = F.filter(F.slice(segments, 1, limit), lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    lines = F.transform(said, lambda s: line(start + F.coalesce(s["start_ms"], F.lit(0)), s["text"]))
    whole = F.when(F.trim(F.coalesce(transcript, F.lit(""))) != "", line(start, transcript)).otherwise("(no speech)")
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), whole)


def cell_timeline(cells: Column) -> Column:
    """The picture cells of a clip (their video milliseconds) with index and clock, a line each."""
    lines = F.transform(cells, lambda ms, i: F.concat(F.format_string("cell_%02d at ", i), format_clock(ms), F.lit(" ("), ms.cast("string"), F.lit("ms)")))
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(no splice cells)"))
