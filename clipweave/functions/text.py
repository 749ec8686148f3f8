"""Text of footage records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands whose repetition is counted.
COMMANDS = ("step away", "get back", "get down", "get on the ground", "don't move", "hands up", "stop")
#: Texts that state no value, that state none, and those that state a yes or a no to "an officer".
BLANK, NONE = ("", "null", "n/a", "unreadable"), ("none", "no", "no glasses")
YES, NO = ("true", "yes", "officer", "cop", "police"), ("false", "no", "civilian")
#: Attributes of a signature in their order.
SIGNATURE = ("race", "gender", "hair", "glasses", "clothes", "shoes", "bag", "distinctive")
#: Scene roles, the stronger first.
ROLES = ("potential_suspect", "officer", "civilian", "unknown")


def strip(text: Column) -> Column:
    """A text without white space, also the unbreakable, at its ends."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def slug(text: Column) -> Column:
    """Lower case with every other sign as one underscore, at most 48 letters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_"), "^_+|_+$", ""), 1, 48)


def one_line(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[\s\u00a0]+", " ")


def normal_plate(text: Column) -> Column:
    """A plate in capitals without signs; empty unless it has 4 to 10 of them and a digit."""
    bare = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    return F.when(F.length(bare).between(4, 10) & bare.rlike("[0-9]"), bare).otherwise("")


def clean(text: Column, default: Column | str = "unknown") -> Column:
    """An attribute in lower case; a default for texts that state nothing, ``none`` for those that state none."""
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.when(low.isin(*BLANK), F.lit(default) if isinstance(default, str) else default).when(low.isin(*NONE), "none").otherwise(low)


def is_officer(value: Column, role: Column) -> Column:
    """A yes, a no or null: never guessed."""
    a, b = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(a.isin(*YES) | b.isin("officer", "cop", "police"), True).when(a.isin(*NO) | (b == "civilian"), False)


def signature(person: Column | None = None) -> Column:
    """The known attributes of a person, cleaned, joined by `` | ``."""
    of = lambda k: F.col(k) if person is None else person[k]
    return F.concat_ws(" | ", *[F.when(~clean(of(k), "").isin("", "unknown"), clean(of(k), "")) for k in SIGNATURE])


def phrase_count(text: Column, phrase: Column) -> Column:
    """Occurrences of a phrase, case aside, without overlap."""
    t, p = F.lower(text), F.lower(phrase)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def repeated_commands(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(" + "|".join(COMMANDS) + r")\b"))


def event_name(*candidates: Column) -> Column:
    """The first of several names as a slug; the bare word ``event`` names nothing."""
    named = [F.when(~slug(c).isin("", "event"), slug(c)) for c in candidates]
    return F.coalesce(*named)


def braces(text: Column) -> Column:
    """The outermost object of a text that has words around its JSON."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def remap(value: Column, mapping: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, value), value)


def stronger_role(a: Column, b: Column) -> Column:
    """The stronger of two roles; unknown if neither is one."""
    out = F.lit("unknown")
    for role in reversed(ROLES):
        out = F.when((a == role) | (b == role), role).otherwise(out)
    return out


def role_rank(role: Column) -> Column:
    """0 for the strongest role; other texts rank last."""
    out = F.lit(len(ROLES))
    for i, r in enumerate(ROLES):
        out = F.when(role == r, i).otherwise(out)
    return out


def truthy(value: Column) -> Column:
    """A signal holds from 0.5 on; null does not."""
    return F.coalesce(value >= 0.5, F.lit(False))
