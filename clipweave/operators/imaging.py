"""Geometry and brightness of pictures as Column expressions; the pixels themselves are left to injected tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of the detector's input, least sides of crops, part of a vehicle above its plate and beside it, brightness of a night.
INPUT, LEAST_PERSON, LEAST_VEHICLE, LEAST_PLATE_HEIGHT, PLATE_FROM, PLATE_MARGIN, DARK = 640, 20, 24, 12, 0.55, 0.08, 78
#: Images that a model is shown of a key clip and of another, and crops among them.
SHOWN_KEY, SHOWN, CROPS = 4, 1, 2


def luma_mean(pixels: Column) -> Column:
    """The mean brightness of a picture's pixels (0 to 255); 0 for none."""
    total = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(pixels) > 0, total / F.size(pixels)).otherwise(0.0)


def is_night(luma: Column) -> Column:
    return luma < DARK


def night_clip(nights: Column) -> Column:
    """Whether half of a clip's cells or more, and one at least, are dark."""
    return F.size(F.filter(nights, lambda n: F.coalesce(n, F.lit(False)))) >= F.greatest(F.lit(1), F.floor(F.size(nights) / 2))


def letterbox(width: Column, height: Column, side: int = INPUT) -> Column:
    """``scale, width, height, pad_x, pad_y`` of a picture fitted into a square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), ((side - w) / 2).alias("pad_x"), ((side - h) / 2).alias("pad_y"))


def fit_cell(width: Column, height: Column, cell_width: int, cell_height: int) -> Column:
    """``width, height, left, top`` of a picture in the middle of a cell."""
    scale = F.least(F.lit(float(cell_width)) / width, F.lit(float(cell_height)) / height)
    w, h = (F.greatest(F.lit(1), F.floor(x * scale).cast("int")) for x in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((cell_width - w) / 2).cast("int").alias("left"), F.floor((cell_height - h) / 2).cast("int").alias("top"))


def _clamped(box: Column, width: Column, height: Column) -> list[Column]:
    at = lambda i: F.try_element_at(box, F.lit(i)).cast("int")
    return [F.greatest(F.lit(0), at(1)), F.greatest(F.lit(0), at(2)), F.least(width, at(3)), F.least(height, at(4))]


def person_crop(box: Column, width: Column, height: Column) -> Column:
    """A person's box within the picture; null if it has not four sides or is too small."""
    x1, y1, x2, y2 = _clamped(box, width, height)
    return F.when((F.size(box) == 4) & (x2 - x1 >= LEAST_PERSON) & (y2 - y1 >= LEAST_PERSON), F.array(x1, y1, x2, y2))


def plate_crop(box: Column, width: Column, height: Column) -> Column:
    """The lower part of a vehicle's box, where its plate is; null if that is too small."""
    x1, y1, x2, y2 = _clamped(box, width, height)
    w, h = x2 - x1, y2 - y1
    pad, top = F.floor(w * PLATE_MARGIN).cast("int"), y1 + F.floor(h * PLATE_FROM).cast("int")
    fits = (F.size(box) == 4) & (w >= LEAST_VEHICLE) & (h >= LEAST_VEHICLE) & (w - 2 * pad >= LEAST_VEHICLE) & (y2 - top >= LEAST_PLATE_HEIGHT)
    return F.when(fits, F.array(x1 + pad, top, x2 - pad, y2))


def shown_images(key_clip: Column, splice: Column, frames: Column, crops: Column) -> Column:
    """The images of a clip that a model is shown: the splice, and of a key clip its middle frame and two crops; each once."""
    none = F.array().cast("array<string>")
    first = F.when(splice.isNotNull(), F.array(splice)).otherwise(none)
    middle = F.when(F.size(frames) > 0, F.slice(frames, F.floor(F.size(frames) / 2).cast("int") + 1, 1)).otherwise(none)
    more = F.concat(middle, F.slice(F.filter(F.coalesce(crops, none), lambda c: c.isNotNull()), 1, CROPS))
    every = F.array_distinct(F.concat(first, F.when(key_clip, more).otherwise(none)))
    return F.slice(every, F.lit(1), F.when(key_clip, SHOWN_KEY).otherwise(SHOWN))
