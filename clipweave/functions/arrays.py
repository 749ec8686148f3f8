"""Numeric arrays, boxes and audio as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true members."""
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))

    def step(acc: Column, flag: Column) -> Column:
        now = F.when(flag, acc["now"] + 1).otherwise(0)
        return F.struct(F.greatest(acc["best"], now).alias("best"), now.alias("now"))

    return F.aggregate(flags, zero, step, lambda acc: acc["best"])


def upper_median(values: Column) -> Column:
    """The middle member, of two middle ones the larger; null for an empty array."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int")))


def frames(values: Column, size: int) -> Column:
    """Whole frames of ``size`` members; the last member opens no frame."""
    last = F.floor((F.size(values) - size - 1) / size).cast("int")
    return F.when(F.size(values) > size, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * size + 1, size))).otherwise(F.array())


def root_mean_square(values: Column, scale: float = 1.0) -> Column:
    """The root of the mean square over ``scale``; null for an empty array."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(values) > 0, F.sqrt(total / F.size(values)) / scale)


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def audio_signals(samples: Column, rate: int = 16_000) -> Column:
    """``loudness, loud_impact, loud_speech, impact_at_ms`` of 16-bit samples: a struct of zeros where there are none."""
    window = max(int(rate * 0.05), 160)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def signals(x: Column) -> Column:
        rms, median, peak, whole = x["rms"], x["median"], x["peak"], x["whole"]
        loud = longest_run(F.transform(rms, lambda r: r >= F.greatest(median * 4, F.lit(0.08))))
        heard = lambda value, none: F.when(F.size(rms) > 0, value).otherwise(none)
        return F.struct(
            heard(F.round(F.least(whole * 8, F.lit(1.0)), 3), 0.0).alias("loudness"),
            heard(F.round(clamp((peak / F.greatest(median, F.lit(1e-4)) - 4.0) / 8.0), 3), 0.0).alias("loud_impact"),
            heard(F.round(F.least(loud * (window / rate) / 2.0, F.lit(1.0)), 3), 0.0).alias("loud_speech"),
            heard(F.floor((F.array_position(rms, peak) - 1) * window / rate * 1000).cast("int"), 0).alias("impact_at_ms"),
        )

    def measured(s: Column) -> Column:
        return once(
            F.transform(frames(s, window), lambda f: root_mean_square(f, 32768.0)),
            lambda rms: F.struct(rms.alias("rms"), upper_median(rms).alias("median"), F.array_max(rms).alias("peak"), root_mean_square(s, 32768.0).alias("whole")),
        )

    return once(once(samples, measured), signals)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes ``[x1, y1, x2, y2]``."""
    at = lambda box, i: F.element_at(box, i).cast("double")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(at(a, hi), at(b, hi)) - F.greatest(at(a, lo), at(b, lo)))
    shared = side(1, 3) * side(2, 4)
    area = lambda box: F.greatest(F.lit(0.0), at(box, 3) - at(box, 1)) * F.greatest(F.lit(0.0), at(box, 4) - at(box, 2))
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def ordered_distinct(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
