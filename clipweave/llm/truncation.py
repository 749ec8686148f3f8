"""Texts that were cut off before they reached the corpus, and how often each source cuts.

Field limits show as spikes in a source's histogram of text lengths, in characters or in bytes; texts at
a spike that do not end a sentence are cut. Cuts in mid-transfer have no length of their own. They, and
the texts of sources whose writers leave final punctuation out, are decided by how the corpus ends its
sentences: for the last words of a text, the share of their other mentions that end a sentence or line
is weighed against the chance that a cut falls there. Objects must close what they open. Lines that only
stand at the end of texts (page numbers, signatures, tags) are endings of their own.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, join_unique
from ..session import cut as cut_lineage

#: Lengths on either side with which a length is compared, and how far above them a spike stands.
NEIGHBOURS, SIGMAS, SPIKE_TEXTS = 50, 6.0, 4
#: Prior odds that a text without final punctuation is cut: where its writer leaves it out, and by how much more where not.
ODDS, ODDS_PUNCTUATED = 0.1, 100.0
#: Characters of a word and its blank, at any of which a cut may fall; share of cut texts that end in blanks.
WORD_CHARS, CUT_AT_BLANK = 6.0, 0.17
#: What remains of the share where so many words never stood together.
UNSEEN = {2: 0.05, 3: 0.5}
#: Mentions by which a share leans on the shorter context; lines of one beginning, and the share with final punctuation from
#: which a line of that beginning without it is cut.
LEAN, LINES, PUNCTUATED_SHARE = 3.0, 20, 0.98
#: Mentions that the last word needs; share and number of the last lines among the lines that begin as a closing line does.
MENTIONS, CLOSING_SHARE, CLOSING_TEXTS = 3, 0.9, 4

#: What is put after a cut.
MARKER = r"(?:…|\.\.\.|�+|\s*[\[(<](?:…|\.\.\.|cont|more|trunc|cut|snip)[^\])>\n]*[\])>]?)\Z"
_ENDED = r"[.?!。！？][\"'»”’)\]]*\Z"
_TOKEN = r"[0-9]+(?:[.:/,-][0-9]+)*|[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|[.?!。！？]"
_TRAIL = r"[\p{So}\p{Sk}\p{Cf}\p{Mn}\s]+\Z"


class Reader:
    """Compiled patterns and the reading of one text."""

    def __init__(self):
        self.marker = regex.compile(MARKER, regex.IGNORECASE)
        self.ended = regex.compile(_ENDED)
        self.token = regex.compile(_TOKEN)
        #: The same tokens of a line in ASCII, which need no tables of letters.
        self.token_ascii = re.compile(r"[0-9]+(?:[.:/,-][0-9]+)*|[a-z]+(?:['-][a-z]+)*|[.?!]")
        self.trail = regex.compile(_TRAIL)
        self.object = regex.compile(r'[^{\n]{0,16}\{\s*(?:"|\Z)')
        self.digits = regex.compile("[0-9]+")

    def tokens(self, line: str) -> list[str]:
        low = self.digits.sub("0", line.lower())
        return (self.token_ascii if low.isascii() else self.token).findall(low)

    def core(self, text: str) -> tuple[str, bool]:
        """A text without blanks and a marker at its end, and whether there was a marker."""
        bare = text.rstrip()
        m = self.marker.search(bare)
        return (bare[: m.start()].rstrip(), True) if m else (bare, False)

    def lines(self, text: str) -> list[str]:
        return [x for x in (y.strip() for y in text.split("\n")) if x]

    def head(self, line: str) -> str:
        """How a line begins: its first word, or first sign, with digits masked."""
        first = line.split(None, 1)[0]
        return self.digits.sub("0", first)[:40]

    def contexts(self, tokens: list[str], end: int) -> list[str]:
        """The last three, two and one tokens before position ``end``."""
        return [" ".join(tokens[max(0, end - n) : end]) for n in (3, 2, 1) if end >= n]

    def opens(self, line: str) -> bool:
        """Whether a line leaves a bracket open."""
        return line.count("[") > line.count("]") or line.count("(") > line.count(")")

    def is_object(self, text: str) -> bool:
        return self.object.match(text) is not None

    def closed(self, text: str) -> bool:
        """Whether the object that a text begins with, after a few signs perhaps, is complete."""
        try:
            json.JSONDecoder().raw_decode(text[text.index("{") :])
        except (ValueError, RecursionError):
            return False
        return True


_STOP = frozenset(".?!。！？")


def _sentences(tokens: list[str]) -> list[list[str]]:
    """The words between the stops; none is empty."""
    if _STOP.isdisjoint(tokens):
        return [tokens] if tokens else []
    out: list[list[str]] = [[]]
    for t in tokens:
        if t not in _STOP:
            out[-1].append(t)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def _learn(reader: Reader, text: str, counts: dict[tuple[str, str], list[int]], contexts: Counter, ends_at: Counter) -> None:
    """Adds one text to the counts of ``(what, key)``, each ``[n, ends]``, and to those of contexts.

    ``contexts`` and ``ends_at``: words of a sentence, and how often a sentence ends there; ``h``: beginnings of lines after the
    first, and how often such a line is the last; ``p``: beginnings of lines before the last, and how often
    such a line has final punctuation; ``c``: beginnings of last lines with their last word; ``t``: all words;
    ``b``: texts with final punctuation, and how many of them have blanks after it.
    """
    core, _ = reader.core(text)
    if not core or reader.is_object(core):
        return
    lines = reader.lines(core)
    if reader.ended.search(core):
        c = counts["b", ""]
        c[0] += 1
        c[1] += text[-1] in " \t"
    total = counts["t", ""]
    said: list[str] = []
    ended: list[str] = []
    for i, line in enumerate(lines):
        last = i == len(lines) - 1
        head = reader.head(line)
        if i:
            c = counts["h", head]
            c[0] += 1
            c[1] += last
        if not last and not reader.trail.search(line):
            c = counts["p", head]
            c[0] += 1
            c[1] += reader.ended.search(line) is not None
        tokens = reader.tokens(line)
        if last and i:
            # What closing lines end with is counted apart, by their beginning.
            counts["c", f"{head} {tokens[-1] if tokens else ''}"][0] += 1
        for n, sentence in enumerate(found := _sentences(tokens)):
            open_ = last and n == len(found) - 1 and tokens[-1] not in _STOP
            # How a text's own last sentence ends is what is asked, so an open one is counted without its last word.
            t = ["^", *(sentence[:-1] if open_ else sentence)]
            two = [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)]
            three = [f"{a} {b}" for a, b in zip(two, t[2:], strict=False)]
            said += t[1:]
            said += two
            said += three
            total[0] += len(two)
            if not open_:
                ended += [x[-1] for x in (three, two, t) if x]
                total[1] += 1
    contexts.update(said)
    ends_at.update(ended)


def _learning(column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        contexts, ends_at = Counter(), Counter()

        def rows() -> pd.DataFrame:
            told = [(*k, *v) for k, v in counts.items()] + [("e", k, n, ends_at[k]) for k, n in contexts.items()]
            for held in (counts, contexts, ends_at):
                held.clear()
            return pd.DataFrame(told, columns=["what", "key", "n", "ends"])

        for pdf in batches:
            for text in pdf[column]:
                if text:
                    _learn(reader, text, counts, contexts, ends_at)
            if len(contexts) > 300_000:
                yield rows()
        yield rows()

    return run


def _verdict(reader: Reader, text: str) -> tuple[str, list[str], list[str]]:
    """``cut``, ``whole``, ``open`` (the words decide) or ``bare`` (cut unless a closing line), with head and contexts."""
    core, marked = reader.core(text)
    if not core:
        return ("cut" if marked else "whole"), [], []
    if reader.is_object(core):
        return ("whole" if not marked and reader.closed(core) else "cut"), [], []
    if marked:
        return "cut", [], []
    lines = reader.lines(core)
    if reader.opens(lines[-1]) or core[-1] in ",;:([{":
        return "cut", [], []
    tokens = ["^"]
    for t in reader.tokens(lines[-1]):
        tokens = ["^"] if t in _STOP else [*tokens, t]
    said = reader.trail.sub("", core)
    if reader.ended.search(said):
        # A number and a point may be the beginning of a longer number.
        number = regex.search(r"(?<![\w.:/-])[0-9]+\.\Z", said)
        if not number:
            return "whole", [], []
        before = ["^"]
        for t in reader.tokens(lines[-1])[:-1]:
            before = ["^"] if t in _STOP else [*before, t]
        return "number", [], reader.contexts(before, len(before))[:2]
    if said != core:
        return "whole", [], []
    head = reader.head(lines[-1])
    heads = [head, f"{head} {tokens[-1] if len(tokens) > 1 else ''}" if len(lines) > 1 else ""]
    before = [x for x in lines[:-1] if not x.startswith("#")]
    plain = [x for x in before if reader.trail.sub("", x) == x]
    if any(not reader.ended.search(x) for x in plain):
        style = "open"
    elif any(x.endswith((".", "。")) for x in plain) or regex.search(r"[.。]\s", lines[-1]) or regex.search(r"[\p{Han}\p{Hiragana}]", core) and "。" in core:
        style = "bare"
    else:
        style = "open"
    return style, heads, reader.contexts(tokens, len(tokens))


def _reading(key: str, source: str, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            rows = []
            for k, s, text in zip(pdf[key], pdf[source], pdf[column], strict=True):
                if not text or not text.strip():
                    continue
                verdict, heads, contexts = _verdict(reader, text)
                core, _ = reader.core(text)
                asked = []
                if verdict not in ("cut", "whole"):
                    asked = [("p", heads[0], 0)] if heads else []
                    asked += [("h", heads[0], 0), ("c", heads[1], 0)] if heads and heads[1] else []
                    asked += [("e", c, len(c.split(" "))) for c in contexts]
                rows.append((k, s, verdict, text[-1] in " \t", len(text), len(text.encode()), len(core), len(core.encode()), asked))
            yield pd.DataFrame(rows, columns=[key, source, "verdict", "blank", "chars", "bytes", "core_chars", "core_bytes", "asked"])

    return run


def length_spikes(lengths: DataFrame, source: str) -> DataFrame:
    """``source, unit, length`` at which a source has far more texts than at the lengths around."""
    units = F.explode(
        F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])
    ).alias("x")
    histogram = lengths.select(source, units).groupBy(source, "x.unit", "x.length").agg(F.count("*").alias("n"))
    around = Window.partitionBy(source, "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    usual = (F.sum("n").over(around) - F.col("n")) / (2 * NEIGHBOURS)
    return (
        histogram.withColumn("usual", usual)
        .where((F.col("n") >= SPIKE_TEXTS) & (F.col("n") > F.col("usual") + SIGMAS * F.sqrt(F.col("usual") + 0.5)))
        .select(source, "unit", "length", "n", "usual")
    )


def judge(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, cut, at_spike`` for every text that is not null, empty or blank.

    Null sources are a source of their own; further columns are ignored; ``key`` is taken as unique, so
    rows that repeat it in full may come out once; texts are read whole. What is put after a cut ("…", "[cont", replacement characters, blanks) is set
    aside first.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, F.coalesce(source, F.lit("")).alias(source), text)
    learnt = (
        rows.select(text)
        .mapInPandas(_learning(text), "what string, key string, n bigint, ends bigint")
        .groupBy("what", "key")
        .agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    )
    learnt = cut_lineage(learnt)
    read = rows.mapInPandas(
        _reading(key, source, text),
        f"`{key}` {kind}, `{source}` string, verdict string, blank boolean, chars bigint, bytes bigint, core_chars bigint, core_bytes bigint, "
        "asked array<struct<what: string, key: string, size: int>>",
    )
    spikes = broadcast_if_small(length_spikes(rows.where(F.trim(text) != "").select(source, F.length(text).alias("chars"), F.octet_length(text).alias("bytes")), source))
    def at(unit: str) -> DataFrame:
        found = spikes.where(F.col("unit") == unit).groupBy(source)
        return broadcast_if_small(found.agg(F.map_from_entries(F.collect_list(F.struct("length", F.col("n") / (F.col("usual") + 0.5)))).alias(f"at_{unit}")))

    stands_out = F.greatest(*[F.try_element_at(F.col(f"at_{unit}"), F.col(c)) for unit in ("chars", "bytes") for c in (unit, f"core_{unit}")])
    placed = (
        read.join(at("chars"), source, "left")
        .join(at("bytes"), source, "left")
        .withColumn("spike", stands_out)
        .withColumn("at_spike", F.col("spike").isNotNull())
        .drop("at_chars", "at_bytes", "chars", "bytes", "core_chars", "core_bytes")
    )
    # A few words of each text go on from here twice; the texts are read once.
    placed = cut_lineage(placed)
    clear = placed.where("verdict in ('cut', 'whole')").select(key, source, (F.col("verdict") == "cut").alias("cut"), "at_spike")
    asked = placed.where("verdict not in ('cut', 'whole')")
    said = asked.select(key, source, "verdict", "blank", "spike", "at_spike", F.explode_outer("asked").alias("a")).select(
        key, source, "verdict", "blank", "spike", "at_spike", "a.*"
    )
    # Many texts end alike; what the corpus knows of such an ending is joined in place.
    told = join_unique(said, learnt, ["what", "key"], "left")
    total = learnt.where("what = 't'").first()
    blank = learnt.where("what = 'b'").first()
    blanks = (blank["ends"] + 0.5) / (blank["n"] + 1.0) if blank else 0.01
    ends_per_token = total["ends"] / total["n"] if total and total["ends"] else 0.1

    def mention(size: int, column: str):
        return F.max(F.when((F.col("what") == "e") & (F.col("size") == size), F.col(column)))

    judged = told.groupBy(key, source, "verdict", "blank", "spike", "at_spike").agg(
        F.max(F.when(F.col("what") == "h", F.col("n"))).alias("head_n"),
        F.max(F.when(F.col("what") == "h", F.col("ends"))).alias("head_last"),
        F.max(F.when(F.col("what") == "c", F.col("n"))).alias("close_n"),
        F.max(F.when(F.col("what") == "p", F.col("n"))).alias("line_n"),
        F.max(F.when(F.col("what") == "p", F.col("ends"))).alias("line_ended"),
        *[mention(s, col).alias(f"{col}{s}") for s in (1, 2, 3) for col in ("n", "ends")],
    )
    closing = (
        (F.col("head_n") >= CLOSING_TEXTS) & (F.col("head_last") >= CLOSING_SHARE * F.col("head_n")) & (F.coalesce("close_n", F.lit(0)) >= 2)
    )
    # Each share leans on that of one word less, as if that had been seen a few times.
    share: Column = F.when(F.col("n1") >= MENTIONS, F.col("ends1") / F.col("n1")).otherwise(0.0)
    for size in (2, 3):
        n, ends = F.coalesce(f"n{size}", F.lit(0)), F.coalesce(f"ends{size}", F.lit(0))
        share = F.when(n == 0, UNSEEN[size] * share).otherwise((ends + LEAN * share) / (n + LEAN))
    punctuated = F.coalesce((F.col("line_n") >= LINES) & (F.col("line_ended") >= PUNCTUATED_SHARE * F.col("line_n")), F.lit(False))
    prior = F.coalesce("spike", F.lit(ODDS)) * F.when((F.col("verdict") == "bare") | punctuated, ODDS_PUNCTUATED).otherwise(1.0)
    after = F.when(F.col("blank"), CUT_AT_BLANK / blanks).otherwise((1 - CUT_AT_BLANK) / (1 - blanks))
    # A cut falls on the end of these words as seldom as on any other character; a whole text ends there as often as sentences do.
    by_words = prior * after * ends_per_token / WORD_CHARS > share
    cut = (
        F.when(F.coalesce(closing, F.lit(False)), False)
        .when(F.col("verdict") == "number", F.coalesce("ends2", F.lit(0)) == 0)
        .otherwise(by_words)
    )
    return clear.unionByName(judged.select(key, source, cut.alias("cut"), "at_spike"))


def truncated(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key`` of the documents that were cut off."""
    return judge(documents, key, text, source).where("cut").select(key)


def truncation_rates(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each source truncates: ``source, documents, cut, at_spike, share``."""
    return (
        judge(documents, key, text, source)
        .groupBy(source)
        .agg(
            F.count("*").alias("documents"),
            F.count_if("cut").alias("cut"),
            F.count_if(F.col("cut") & F.col("at_spike")).alias("at_spike"),
        )
        .withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
    )
