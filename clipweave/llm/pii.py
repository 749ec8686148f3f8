"""Personal data in free text: found and replaced by typed placeholders.

What a term tells about a protected entity is estimated from the corpus. A first pass over all texts counts
the terms and what they stand with. For words that is a slot that holds a person (after a title, "name is",
...), for numbers a cue of a kind ("call", "licence", ...) in the three words before; a number's term is its
form, each digit as 9. The disclosure of a term is the information that it gives about such a place,
log2 P(place | term) / P(place). Words above the threshold that are written as proper names, and forms of seven
digits or more above it that mostly stand with one kind, are protected. The second pass generalises every
mention of them to a placeholder, names in texts without case and punctuation too, joining first names,
initials, particles and surnames to one piece.

Emails, addresses and the usual forms of phone and identity numbers, also written out in words, disclose by
themselves whatever stands beside them; they are read by patterns before, and need no estimate.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Bits that a protected term gives at least about standing in a person's slot.
DISCLOSURE_BITS = 3.0
#: Share of a protected term's mentions inside sentences of cased texts that are capitalised.
CAPITALISED = 0.8
#: Slots that a protected term fills at least, and the share of a number form's mentions that stand with its kind.
SLOTS, WITH_CUE = 2, 0.5
#: Protected terms up to which the list is broadcast; beyond, each text gets its own terms by a join.
LEXICON_ROWS = 300_000

# Words of English that the patterns and the slots are made of.
DIGITS = {"zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
STREETS = (
    "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "court", "ct", "way", "terrace", "ter",
    "boulevard", "blvd", "place", "pl", "square", "sq", "circle", "cir", "crescent", "close", "parkway", "pkwy", "highway", "hwy", "row", "alley",
)
NOT_IN_STREETS = (
    "a", "an", "the", "of", "us", "to", "on", "in", "at", "for", "and", "or", "is", "are", "was", "we", "i", "you", "it", "that", "this",
    "minutes", "minute", "seconds", "feet", "dollars", "times", "more", "later", "please", "copy", "turned", "onto", "from", "with", "by", "go", "ahead",
)
TITLES = (
    "mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "officer", "witness", "sergeant", "sgt", "detective", "deputy",
    "captain", "lieutenant", "agent", "inspector", "constable", "judge", "nurse",
)
BEFORE_NAMES = (
    ("name", "is"), ("the", "name"), ("named",), ("ask", "for"), ("belongs", "to"), ("taken", "from"), ("spoke", "with"), ("are", "you"),
    ("registered", "owner"), ("thanks",), ("her", "brother"), ("his", "sister"), ("her", "sister"), ("his", "brother"), ("yelled",), ("called",),
)
CUES = {
    "phone": ("call", "called", "calling", "phone", "telephone", "cell", "mobile", "dial", "dialed", "text", "reach", "tel", "fax", "whatsapp"),
    "id_number": ("license", "licence", "passport", "ssn", "social", "security", "identity", "identification", "dob", "taxpayer", "insurance"),
}
DETERMINERS = ("the", "a", "an", "this", "that", "another", "each", "every", "any", "some", "which", "second", "no", "older", "younger")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "ó", "o", "o'", "mac", "mc", "st")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_D = "(?:" + "|".join(DIGITS) + ")"
_DOT = r"(?:\.|\s+dot\s+|\s?[\[({]\s?dot\s?[\])}]\s?)"
_AT = r"(?:@|\s+at\s+|\s?[\[({]\s?at\s?[\])}]\s?)"
_JOIN = rf"(?:{_DOT}|[_+-]|\s+(?:underscore|dash|hyphen|minus|plus)\s+)"
_EMAIL = rf"(?<![\w@.+-])[a-z0-9]+(?:{_JOIN}[a-z0-9]+)*{_AT}[a-z][a-z0-9-]*(?:{_DOT}[a-z][a-z0-9-]*)+(?![\w@+]|-\w|\s+(?:at|dot|plus|dash|hyphen|minus|underscore)\s|\s?[\[({{]\s?(?:at|dot)\b)"
_SPOKEN = rf"(?<![\w])(?:plus\s+)?{_D}(?:[\s-]+{_D}){{6,}}(?![\w])"
_EXT = r"(?:,?\s?(?:extension|ext\.?|x)\s?\d{1,6})?"
_PHONE = rf"""(?<![\w.+/@-])(?:
    \+1[\s.-]?(?:\(\d{{3}}\)|\d{{3}})[\s./-]?\d{{3}}[\s.-]?\d{{4}}
  | \+\d{{2,3}}\s?(?:\(0\)\s?)?\d{{2,4}}(?:[\s-]?\d{{3,4}}){{2}}
  | 00\d{{2}}[\s-]?(?:\(0\)\s?)?\d{{3,4}}(?:[\s-]?\d{{3,4}}){{2}}
  | 1[\s.-]\d{{3}}[\s.-]\d{{3}}[\s.-]\d{{4}}
  | \(\d{{3}}\)\s?\d{{3}}[\s.-]?\d{{4}}
  | \d{{3}}[\s./-]\d{{3}}[\s.-]\d{{4}}
  | 0\d{{4}}\s\d{{6}}
  | \d{{10}}
  | \d{{3}}-\d{{4}}
  )(?![\w@]|[-.]\d){_EXT}"""
_ID = r"""(?<![\w.+/@-])(?:
    \d{3}(?P<sep>[\s.-])\d{2}(?P=sep)\d{4}
  | \d{9}
  | [a-z]\d{3}-\d{4}-\d{4}
  | [a-z]\d{10}
  | [a-z]\d{7}
  )(?![\w@]|[-.]\d)"""
_NAME_OF_STREET = rf"(?!(?:{'|'.join((*NOT_IN_STREETS, *DIGITS))})\b)[^\W\d_](?:[^\W\d_]|['’-])*"
_ADDRESS = rf"""(?<![\w#.:/-])(?:\d{{1,5}}[a-z]?|{_D}(?:\s{_D}){{0,4}})\s(?P<street>(?:{_NAME_OF_STREET}\s){{1,3}}?(?:{'|'.join(STREETS)}))\b
   (?:\.?,?\s(?:apartment|apt\.?|suite|ste\.?|flat|room)\s\#?(?:\d+[a-z]?|{_D}(?:\s{_D})*)\b|\.?,?\s\#\s?\d+[a-z]?\b)?"""
_WORD = r"[\p{L}][\p{L}\p{M}]*(?:['’-][\p{L}\p{M}]+)*"


#: A number of other forms: at most 24 signs. How many digits it has is counted.
_NUMBER = r"(?<![\w.+/@-])[+(]?[0-9](?:[0-9() ./-]{5,21})[0-9](?![\w@]|[-.][0-9])"
LEAST_DIGITS = 7
_CUE_WORDS = {w: kind for kind, words in CUES.items() for w in words}
_WORD_ASCII = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
_DIGIT_WORDS, _STREETS = frozenset(DIGITS), frozenset(STREETS)


def _pieces(digits: Sequence[int], plus: bool) -> list[tuple[int, int, str]]:
    """``start, length, kind`` of the numbers in a run of spoken digits.

    The run's length decides: 7 or 10 digits, 11 after a leading one or zero and up to 15 after "plus" are
    a phone, 9 an identity number. Any other run is split where its phones have the exchange 555, so that
    the most of them and then the fewest digits outside a number remain; without one, more than 10 digits
    are one identity number, as nothing tells its parts, and 8 are none.
    """
    n = len(digits)
    if n in (7, 10) or n == 11 and digits[0] in (0, 1) or plus and n <= 15:
        return [(0, n, "phone")]
    if n == 9:
        return [(0, n, "id_number")]
    # From the end: the best reading of each rest as (phones with 555, - digits outside, - numbers), and its first number.
    best, first = [(0, 0, 0)] * (n + 1), [(1, "")] * n
    for i in range(n - 1, -1, -1):
        told, out, numbers = best[i + 1]
        best[i] = (told, out - 1, numbers)
        for size, at in ((11, 4), (10, 3), (9, None), (7, 0)):
            if i + size > n or size == 11 and digits[i] not in (0, 1):
                continue
            told, out, numbers = best[i + size]
            named = at is not None and list(digits[i + at : i + at + 3]) == [5, 5, 5]
            if (score := (told + named, out, numbers - 1)) > best[i]:
                best[i], first[i] = score, (size, "id_number" if at is None else "phone")
    if not best[0][0]:
        return [(0, n, "id_number")] if n > 10 else []
    pieces, i = [], 0
    while i < n:
        size, kind = first[i]
        if kind:
            pieces.append((i, size, kind))
        i += size
    return pieces


class Patterns:
    """Compiled patterns; made once per task."""

    def __init__(self):
        flags = re.IGNORECASE | re.VERBOSE
        self.email = re.compile(_EMAIL, re.IGNORECASE)
        self.spoken = re.compile(_SPOKEN, re.IGNORECASE)
        self.phone, self.id, self.address = (re.compile(p, flags) for p in (_PHONE, _ID, _ADDRESS))
        self.number = re.compile(_NUMBER)
        self.four = re.compile(r"\d{4}")
        self.digits = re.compile(r"[0-9]")
        self.letters = re.compile(r"[^\W\d_]+")
        self.digit = re.compile(_D, re.IGNORECASE)
        self.word = regex.compile(_WORD)
        #: First words of sentences: after the text's start or a sign that no sentence goes on over.
        self.start = regex.compile(rf"(?:\A|[^\p{{L}}\p{{M}}\p{{N}} ,'’-]\s*){_WORD}")
        #: The same for texts in ASCII, which need no tables of letters.
        self.word_ascii = re.compile(_WORD_ASCII)
        self.start_ascii = re.compile(rf"(?:\A|[^A-Za-z0-9 ,'-]\s*){_WORD_ASCII}")

    def word_of(self, text: str):
        return self.word_ascii if text.isascii() else self.word

    def words(self, text: str) -> list[str]:
        return self.word_of(text).findall(text)

    def inner_words(self, text: str) -> list[str]:
        """The words of a text that begin no sentence."""
        bare = (self.start_ascii if text.isascii() else self.start).sub("\0", text)
        return self.words(bare)

    def _said(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Phones and identity numbers written out in words, one run of digits at a time."""
        for m in self.spoken.finditer(text):
            words = [(w.start(), w.end(), DIGITS[w[0].lower()]) for w in self.digit.finditer(text, m.start(), m.end())]
            for i, n, kind in _pieces([w[2] for w in words], m[0][0] in "pP"):
                yield m.start() if i == 0 else words[i][0], words[i + n - 1][1], kind

    def shaped(self, text: str, words: Collection[str] | None = None) -> list[tuple[int, int, str]]:
        """Spans with a form of their own, without overlap; earlier kinds take precedence.

        ``words``, those of the text in lower case, tell which kinds cannot be in it. A kind is left out only
        where its pattern cannot match: digits and streets also stand inside joined words ("six-one", "Street's").
        """
        words = self.words(text.lower()) if words is None else words
        joined = not text.isascii() or "-" in text or "'" in text
        parts = [x for w in words if not w.isalpha() for x in self.letters.findall(w)] if joined else ()
        spans: list[tuple[int, int, str]] = []

        def add(start: int, end: int, kind: str) -> None:
            if all(end <= s or start >= e for s, e, _ in spans):
                spans.append((start, end, kind))

        if "@" in text or "dot" in words or "at" in words and ("{at" in text or "(at" in text or "[at" in text or "." in text):
            for m in self.email.finditer(text):
                add(*m.span(), "email")
        if not (_DIGIT_WORDS.isdisjoint(words) and _DIGIT_WORDS.isdisjoint(parts)):
            for start, end, kind in self._said(text):
                add(start, end, kind)
        four = self.four.search(text)
        if four or "+" in text:
            for m in self.phone.finditer(text):
                add(*m.span(), "phone")
        if four:
            for m in self.id.finditer(text):
                add(*m.span(), "id_number")
        if not (_STREETS.isdisjoint(words) and _STREETS.isdisjoint(parts)):
            for m in self.address.finditer(text):
                if not _cased(text) or self._proper(m):
                    add(*m.span(), "address")
        return spans

    def forms(self, text: str) -> Iterator[tuple[int, int, str]]:
        """``start, end, form`` of the numbers of seven digits or more."""
        for m in self.number.finditer(text):
            form = self.digits.sub("9", m[0])
            if form.count("9") >= LEAST_DIGITS:
                yield m.start(), m.end(), form

    def cue_before(self, text: str, at: int) -> str | None:
        """The kind that the nearest cue among the three words before a place tells."""
        said = self.words(text[max(0, at - 60) : at].lower())[-3:]
        return next((_CUE_WORDS[w] for w in reversed(said) if w in _CUE_WORDS), None)

    def _proper(self, m) -> bool:
        """Whether the street's words are capitalised, as they are in a text with case."""
        street = m["street"].split()
        return all(w[0].isupper() for w in street)


def _cased(text: str) -> bool:
    return text != text.lower()


_GAP = regex.compile(r"[ \t]+\Z")


class Tokens:
    """Words of a text with what stands between each and the one before it."""

    def __init__(self, text: str, word, spans: Sequence[tuple[int, int, str]]):
        taken = sorted(spans)
        self.at: list[tuple[int, int]] = []
        k = 0
        for m in word.finditer(text):
            s, e = m.span()
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if k < len(taken) and taken[k][0] < e:
                continue
            self.at.append((s, e))
        self.text = [text[s:e] for s, e in self.at]
        self.low = [t.lower() for t in self.text]
        self.gap = ["\n"] + [text[a[1] : b[0]] for a, b in zip(self.at, self.at[1:], strict=False)]


def _slots(t: Tokens) -> Iterator[int]:
    """Indices of words that stand where a person's name stands."""
    n = len(t.low)
    for i in range(1, n):
        gap = t.gap[i].strip()
        if gap not in ("", ".", ",", ":") or (gap == "." and t.low[i - 1] not in TITLES):
            continue
        before = t.low[i - 1]
        if before in _TITLES:
            if i < 2 or t.low[i - 2] not in _DETERMINERS:
                yield i
            continue
        for cue in _CUES.get(before, ()):
            if i >= len(cue) and tuple(t.low[i - len(cue) : i]) == cue:
                yield i
                break


_TITLES, _DETERMINERS, _PARTICLES = frozenset(TITLES), frozenset(DETERMINERS), frozenset(PARTICLES)
_CUES: dict[str, tuple] = defaultdict(tuple)
for _c in BEFORE_NAMES:
    _CUES[_c[-1]] += (_c,)
_CUES = dict(_CUES)
#: Words right before a slot.
_BEFORE = _TITLES | frozenset(_CUES)


def _masked(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """A text with its spans blacked out, every other sign in its place."""
    for s, e, _ in spans:
        text = text[:s] + "\0" * (e - s) + text[e:]
    return text


class _Counts:
    """Counts of a task: mentions, words inside sentences of cased texts as written, and ``[slot, first, last]``.

    Of a number's form ``first`` are its mentions with a cue of a phone, ``last`` those with one of an identity number.
    """

    def __init__(self):
        self.n, self.inside, self.slots = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])

    def rows(self) -> pd.DataFrame:
        inside: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for word, n in self.inside.items():
            c = inside[word.lower()]
            c[0] += n
            c[1] += n * word[0].isupper()
        none, never = [0, 0], [0, 0, 0]
        return pd.DataFrame(
            [(k, n, *inside.get(k, none), *self.slots.get(k, never)) for k, n in self.n.items()],
            columns=["term", "n", "inside", "capitalised", "slot", "first", "last"],
        )


def _count(texts: Sequence[str], p: Patterns, counts: _Counts) -> None:
    for text in texts:
        low_text = text.lower()
        words = p.words(low_text)
        if spans := p.shaped(text, words):
            text = _masked(text, spans)
            low_text = text.lower()
            words = p.words(low_text)
        counts.n.update(words)
        for start, _, form in p.forms(text):
            counts.n[form] += 1
            if kind := p.cue_before(text, start):
                counts.slots[form][1 if kind == "phone" else 2] += 1
        cased = text != low_text
        if cased:
            counts.inside.update(p.inner_words(text))
        if _BEFORE.isdisjoint(words):
            continue
        t = Tokens(text, p.word_of(text), ())
        for i in _slots(t):
            names = _run(t, i) if cased else [i]
            names = [j for j in names if len(t.low[j]) > 1 and t.low[j] not in _PARTICLES]
            for j in names:
                counts.slots[t.low[j]][0] += 1
            if cased and len(names) >= 2:
                # "Surname, First name" if a comma follows the first of two.
                comma = "," in t.gap[names[0] + 1]
                first, last = (names[1], names[0]) if comma else (names[0], names[-1])
                if not comma or len(names) == 2:
                    counts.slots[t.low[first]][1] += 1
                    counts.slots[t.low[last]][2] += 1


def _run(t: Tokens, i: int) -> list[int]:
    """The capitalised words of a slot, up to five, over initials, particles and one comma."""
    if not t.text[i][0].isupper() and t.low[i] not in _PARTICLES:
        return []
    run, last = [i], i
    for j in range(i + 1, min(i + 5, len(t.low))):
        gap, capital = t.gap[j], t.text[j][0].isupper()
        linked = gap == " " or (gap == ". " and len(t.text[j - 1]) == 1) or (gap == ", " and len(run) == 1 and capital)
        if not linked or not (capital or t.low[j] in _PARTICLES):
            break
        last = j
        if capital:
            run.append(last)
    return [j for j in run if t.text[j][0].isupper()]


_COUNTS = "term string, n bigint, inside bigint, capitalised bigint, slot bigint, first bigint, last bigint"


def _counting(columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Patterns()
        counts = _Counts()
        for pdf in batches:
            for c in columns:
                _count([x for x in pdf[c] if x], p, counts)
            if len(counts.n) > 200_000:
                yield counts.rows()
                counts = _Counts()
        yield counts.rows()

    return run


def disclosure(texts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every term of the corpus with its counts and ``bits``, the information that it gives about a person's slot.

    ``most_bits`` is what a term would give that stands in such slots only. For the forms of numbers ``bits`` is
    what they give about the cues of phones, ``id_bits`` about those of identity numbers.
    """
    counts = texts.select(*columns).mapInPandas(_counting(list(columns)), _COUNTS)
    terms = cut(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "inside", "capitalised", "slot", "first", "last")]))
    form = F.contains("term", F.lit("9"))
    # A cue reaches the three words after it.
    reached = [(3 * F.sum(F.when(F.col("term").isin(*words), F.col("n")).otherwise(0))).alias(kind) for kind, words in CUES.items()]
    seen = terms.agg(F.sum(F.when(~form, F.col("n"))).alias("n"), F.sum("slot").alias("slot"), *reached).first()
    of = lambda told: math.log2(max(2, seen["n"] or 1) / max(1, told or 1))
    most = math.log2((seen["n"] or 1) / (seen["slot"] or 1))
    told = lambda c, bits: F.log2(F.col(c) / F.col("n")) + bits
    return terms.withColumns(
        {"form": form, "bits": F.when(form, told("first", of(seen["phone"]))).otherwise(told("slot", most)), "id_bits": F.when(form, told("last", of(seen["id_number"]))), "most_bits": F.lit(most)}
    )


def protected_terms(
    terms: DataFrame, bits: float = DISCLOSURE_BITS, capitalised: float = CAPITALISED, slots: int = SLOTS
) -> DataFrame:
    """``term, role`` of the terms above the threshold, for words above half of what certainty would give if that is less.

    The role of a word is ``F`` (first name), ``L`` (surname) or ``B`` (either), of a number's form its kind.
    """
    particles, fixed = F.col("term").isin(*PARTICLES), F.col("term").isin(*TITLES)
    role = F.when(F.col("first") > 2 * F.col("last"), "F").when(F.col("last") > 2 * F.col("first"), "L").otherwise("B")
    names = terms.where(
        ~F.col("form") & (F.col("bits") >= F.least(F.lit(bits), F.col("most_bits") / 2)) & (F.col("slot") >= slots) & (F.col("capitalised") >= capitalised * F.col("inside")) & (F.col("inside") > 0)
        & ~particles & ~fixed & (F.length("term") > 1)
    ).select("term", role.alias("role"))
    most = F.greatest("first", "last")
    numbers = terms.where(F.col("form") & (F.greatest("bits", "id_bits") >= bits) & (most >= slots) & (most >= WITH_CUE * F.col("n")))
    return names.unionByName(numbers.select("term", F.when(F.col("first") >= F.col("last"), "phone").otherwise("id_number").alias("role")))


#: A person's name over the roles of its words: comma and blank keep their place, P is a particle, I an initial.
_GRAMMAR = regex.compile(
    r"P*[LB],[FB][FI]*(?!P*[LB])|[FB][FBI]*P*[LB]|I+P*[LB]|P*[LB]F(?![FBI]*P*[LB])|P*[LB]|[FB]+"
)


def _names(text: str, t: Tokens, lexicon: dict[str, str]) -> Iterator[tuple[int, int]]:
    cased, n, i = _cased(text), len(t.low), 0
    while i < n:
        if t.low[i] not in lexicon:
            i += 1
            continue
        # The chain of name-like words around the first protected one.
        first = i
        while first > 0 and _part(t, first - 1, lexicon, cased) in ("I", "P") and _linked(t, first):
            first -= 1
        last = i
        while last + 1 < n and _part(t, last + 1, lexicon, cased) and _linked(t, last + 1, comma=True):
            last += 1
        roles, where = "", []
        for j in range(first, last + 1):
            if j > first and "," in t.gap[j]:
                roles += ","
                where.append(j)
            roles += _part(t, j, lexicon, cased)
            where.append(j)
        for m in _GRAMMAR.finditer(roles):
            a, b = where[m.start()], where[m.end() - 1]
            yield t.at[a][0], t.at[b][1]
        i = last + 1


def _linked(t: Tokens, j: int, comma: bool = False) -> bool:
    gap = t.gap[j]
    return gap.strip() == "" and "\n" not in gap or (gap == ". " and len(t.text[j - 1]) == 1) or (comma and gap == ", ")


def _part(t: Tokens, j: int, lexicon: dict[str, str], cased: bool) -> str:
    low, said = t.low[j], t.text[j]
    role = lexicon.get(low)
    if role:
        return role if not cased or said[0].isupper() else ""
    if low in _PARTICLES and (len(low) > 1 or low == "ó"):
        return "P"
    if len(said) == 1:
        dotted = j + 1 < len(t.gap) and t.gap[j + 1].startswith(".")
        if cased:
            return "I" if said.isupper() and (dotted or low not in "ai") else ""
        # Without case "a" and "i" are words, unless they stand inside a name.
        inside = j > 0 and t.low[j - 1] in lexicon and j + 1 < len(t.low) and (t.low[j + 1] in lexicon or t.low[j + 1] in _PARTICLES)
        return "I" if low not in "ai" or inside else ""
    return ""


def personal_data(text: str | None, p: Patterns, lexicon: dict[str, str]) -> list[tuple[int, int, str]]:
    """All spans of one text in order: ``start, end, kind``."""
    if not text:
        return []
    words = p.words(text.lower())
    spans = p.shaped(text, words)
    if lexicon and p.digits.search(text):
        free = lambda a, b: all(b <= s or a >= e for s, e, _ in spans)
        spans += [(a, b, lexicon[form]) for a, b, form in p.forms(text) if form in lexicon and free(a, b)]
    if not lexicon.keys().isdisjoint(words):
        spans += [(s, e, "name") for s, e in _names(text, Tokens(text, p.word_of(text), spans), lexicon)]
    return sorted(spans)


def _tagging(columns: list[str], keys: list[str], shared, own: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Patterns()
        lexicon = {} if own else shared.value
        for pdf in batches:
            out = {k: pdf[k] for k in keys}
            terms = [{r["term"]: r["role"] for r in (t if t is not None else [])} for t in pdf["_terms"]] if own else None
            for c in columns:
                told, found = [], []
                for i, text in enumerate(pdf[c]):
                    spans = personal_data(text, p, terms[i] if own else lexicon)
                    found.append([{"kind": k, "found": text[s:e], "start": s} for s, e, k in spans])
                    if spans:
                        parts, at = [], 0
                        for s, e, k in spans:
                            parts += [text[at:s], PLACEHOLDER[k]]
                            at = e
                        text = "".join(parts) + text[at:]
                    told.append(text)
                out[c], out[f"{c}_found"] = told, found
            yield pd.DataFrame(out)

    return run


def sanitise(records: DataFrame, key: str, columns: Sequence[str], bits: float = DISCLOSURE_BITS, lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """``key``, the texts with placeholders, and for each text ``<column>_found``, an array of ``kind, found, start``.

    A row for each row of ``records``; null texts stay null, empty ones empty, all else but the found pieces
    stays as it is; very long texts are read whole. Further columns are ignored. Repeated rows are counted
    as often as they stand there. The corpus is read twice; between the passes only the counts of terms
    are shuffled, summed up before.
    """
    spark = records.sparkSession
    columns = list(columns)
    terms = protected_terms(disclosure(records, columns), bits)
    many = terms.limit(lexicon_rows + 1).count() > lexicon_rows
    found = "array<struct<kind: string, found: string, start: int>>"
    schema = f"`{key}` {records.schema[key].dataType.simpleString()}, " + ", ".join(f"`{c}` string, `{c}_found` {found}" for c in columns)
    if not many:
        shared = spark.sparkContext.broadcast({r["term"]: r["role"] for r in terms.collect()})
        return records.select(key, *columns).mapInPandas(_tagging(columns, [key], shared, False), schema)
    numbered = records.select(key, *columns).withColumn("_row", F.xxhash64(key, *columns))
    text = F.concat_ws("\n", *columns)
    forms = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, "[0-9]", "9"))
    said = numbered.select("_row", F.explode(F.array_union(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), forms)).alias("term")).distinct()
    own = said.join(terms, "term").groupBy("_row").agg(F.collect_list(F.struct("term", "role")).alias("_terms"))
    return numbered.join(own, "_row", "left").drop("_row").mapInPandas(_tagging(columns, [key], None, True), schema)


def found_pieces(sanitised: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, field, kind, found`` of every piece found, equal rows once."""
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"{c}_found").alias("pieces")) for c in columns]
    return (
        sanitised.select(key, F.explode(F.array(*rows)).alias("f"))
        .select(key, "f.field", F.explode("f.pieces").alias("p"))
        .select(key, "field", "p.kind", "p.found")
        .distinct()
    )
