"""Places of media: their mapping between hosts, and which of them may be read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import video_id

#: Fixed value: a video's folder with a hash at its end.
HASHED = r"(/videos/)([^/]+)_([0-9a-f]{8})(/)"


def local_uri(uri: Column, places: Mapping[str, str]) -> Column:
    """A media URI on this host: the first prefix of ``places`` replaced, a hash after a video's folder left out; other paths stay.

    ``file://`` and blanks around are dropped, null stays null. A prefix ends at a folder.
    """
    path = F.regexp_replace(F.trim(uri), "^file://", "")
    out = path
    for old, new in reversed(list(places.items())):
        old, new = old.rstrip("/"), new.rstrip("/")
        under = F.startswith(path, F.lit(f"{old}/")) | (path == old)
        out = F.when(under, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(out)
    return F.regexp_replace(out, HASHED, "$1$2$4")


def allowed(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path without ``..`` lies in one of some folders, or is one of them."""
    inside = F.lit(False)
    for root in roots:
        folder = root.rstrip("/")
        inside = inside | (path == folder) | F.startswith(path, F.lit(f"{folder}/"))
    return F.coalesce(inside & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def previous_ids(video: Column, previous: Column, source_name: Column) -> Column:
    """The ids under which a video may stand in a graph: its own, an earlier one, and that of its file's name."""
    made = F.when(F.coalesce(source_name, F.lit("")) != "", video_id(source_name))
    ids = F.array(*[F.nullif(c, F.lit("")) for c in (video, previous)], made)
    return F.array_distinct(F.array_compact(ids))
