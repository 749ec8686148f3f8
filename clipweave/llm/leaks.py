"""Passages of held-out evaluation texts inside a training corpus.

The word n-grams of the evaluation texts are a hash set of bounded size that is broadcast: sorted 64-bit
hashes in one array, with the place of each gram in its item beside it. The corpus is scanned once, in
place, without a shuffle; the windows of a text are hashed and looked up as arrays, and the few hits are
verified word by word, so a hit is exact. A larger evaluation set is scanned in blocks of items.

Every passage of a text is told, so all of them can be cut out. What stands before and after a cut comes
together by it; where that is a passage again, it is cut out too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from clipweave.session import cut

WORDS = 12
#: Characters of evaluation texts in one broadcast; more items are taken in blocks. In English it holds 3.5 bytes for each (12 while it is made).
BLOCK_CHARS = 20_000_000
#: Fixed value: an odd factor of the rolling hash.
_FACTOR = 0x9E3779B97F4A7C15
_WORD = r"[\p{L}\p{N}]+"
_HIT = "item_id {kind}, first_char int, last_char int, words int, text_md5 string"


class Grams:
    """The n-grams of some items: all their words as numbers in one array, and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple], words: int):
        self.n = words
        self.number: dict[str, int] = {}
        self.items = [item for item, _ in items]
        word = regex.compile(_WORD)
        texts = [np.array([self.number.setdefault(w, len(self.number)) for w in word.findall(text.lower())], np.int32) for _, text in items]
        self.words = np.concatenate([*texts, np.empty(0, np.int32)])
        start = np.cumsum([0, *map(len, texts)])
        hashes, at, of = [], [], []
        for i, ids in enumerate(texts):
            h = self._hashes(ids)
            hashes.append(h)
            at.append(start[i] + np.arange(len(h), dtype=np.int64))
            of.append(np.full(len(h), i, np.int32))
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.at = np.concatenate([*at, np.empty(0, np.int64)])[order].astype(np.int32)
        self.of = np.concatenate([*of, np.empty(0, np.int32)])[order]

    def _hashes(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each window of ``n`` words."""
        windows = max(0, len(ids) - self.n + 1)
        out, told = np.zeros(windows, np.uint64), ids.astype(np.uint64) + np.uint64(1)
        for j in range(self.n):
            out = out * np.uint64(_FACTOR) + told[j : j + windows]
        return out ^ (out >> np.uint64(29))

    def hits(self, ids: np.ndarray) -> dict:
        """Every longest stretch of each item among the words (-1 for a word of no item): item to {first word: words}."""
        h = self._hashes(ids)
        if not len(h) or not len(self.hash):
            return {}
        unknown = np.cumsum(np.append(0, ids < 0))
        known = np.flatnonzero(unknown[self.n :] == unknown[: len(h)])
        low = np.searchsorted(self.hash, h[known], "left")
        some = low < len(self.hash)
        some[some] = self.hash[low[some]] == h[known[some]]
        found: dict = {}
        open_: dict[int, tuple[int, int]] = {}
        for first, k in zip(known[some].tolist(), low[some].tolist(), strict=True):
            end, value = first + self.n - 1, self.hash[k]
            seen = set()
            while k < len(self.hash) and self.hash[k] == value:
                i, at = int(self.of[k]), self.at[k]
                k += 1
                if i in seen or not np.array_equal(self.words[at : at + self.n], ids[first : end + 1]):
                    continue
                seen.add(i)
                since, last = open_.get(i, (first, None))
                if last != end - 1:
                    since = first
                open_[i] = (since, end)
                stretches = found.setdefault(self.items[i], {})
                stretches[since] = max(end - since + 1, stretches.get(since, 0))
        return found


def _spans(word, text: str) -> list[tuple[int, int]]:
    """The places of a text's words as they are compared; where lower case has other words than the text, each is traced to its letters."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in word.finditer(low)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in word.finditer(low)]


def _uncut(at: list[tuple[int, int]], spans: list[dict]) -> np.ndarray:
    """The words, by number, that stand in none of the spans."""
    starts, kept = np.array([since for since, _ in at], np.int64), np.ones(len(at), bool)
    for s in spans:
        kept[np.searchsorted(starts, s["first_char"]) : np.searchsorted(starts, s["last_char"])] = False
    return np.flatnonzero(kept)


def _told(held: Grams, word, text: str | None, spans: list[dict] | None = None) -> list[tuple]:
    """The passages in a text or in what the spans leave of it: item, first and last character, words."""
    said = word.findall(text.lower()) if text else []
    if len(said) < held.n:
        return []
    ids = np.fromiter((held.number.get(w, -1) for w in said), np.int32, len(said))
    left = np.arange(len(ids)) if spans is None else _uncut(_spans(word, text), spans)
    found = held.hits(ids[left])
    at = _spans(word, text) if found else []
    return [(item, at[left[i]][0], at[left[i + n - 1]][1], n) for item, stretches in found.items() for i, n in stretches.items()]


def _scan(grams: Broadcast, column: str, key: str, kind: pa.DataType, spans: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, word = grams.value, regex.compile(_WORD)
        for batch in batches:
            rows: list[tuple] = []
            gone = batch.column(spans) if spans else None
            for row, text in enumerate(batch.column(column).to_pylist()):
                told = _told(held, word, text, gone[row].as_py() if spans else None)
                if told:
                    digest = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
                    rows += [(row, *t, digest) for t in told]
            of, item, first, last, words, md5 = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [pa.array(item, kind), *(pa.array(c, pa.int32()) for c in (first, last, words)), pa.array(md5, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of, pa.int64())), *columns], [key, "item_id", "first_char", "last_char", "words", "text_md5"]
            )

    return run


def _kept(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are sorted by their first character."""
    out, at = [], 0
    for first, last in spans:
        out.append(text[at:first])
        at = max(at, last)
    return "".join(out) + text[at:]


def _clean(grams: Broadcast, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, word = grams.value, regex.compile(_WORD)
        for batch in batches:
            texts, at = batch.column(column).to_pylist(), batch.schema.get_field_index(column)
            for row, text in enumerate(texts):
                while told := _told(held, word, text):
                    texts[row] = text = _kept(text, sorted(t[1:3] for t in told))
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _blocks(items: DataFrame, words: int, block_chars: int) -> list[Broadcast]:
    """The grams of the items, in blocks of about ``block_chars`` characters."""
    asked = items.where("item_id is not null and text is not null").select("item_id", "text")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    told = []
    for b in range(blocks):
        block = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        told.append(items.sparkSession.sparkContext.broadcast(Grams(block, words)))
    return told


def _passages(documents: DataFrame, items: DataFrame, blocks: list[Broadcast], key: str, text: str, spans: str | None = None) -> DataFrame:
    """The passages of the items in the texts, or in what the ``spans`` leave of them."""
    kind = items.schema["item_id"].dataType
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, " + _HIT.format(kind=kind.simpleString())
    read = documents.select(key, text, *([spans] if spans else []))
    scans = [read.mapInArrow(_scan(grams, text, key, to_arrow_type(kind), spans), schema) for grams in blocks]
    return reduce(DataFrame.unionByName, scans)


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Documents that hold at least ``words`` consecutive words of an item, with every such passage at its full length.

    ``items``: ``item_id, text``. Words are longest runs of letters and digits, compared without regard
    to case. Returns ``key, item_id, first_char, last_char, words, text_md5`` (of the document's text), a row for
    each document row, item and passage. Null and empty texts, and items of fewer words, match nothing; further
    columns are ignored; texts are scanned whole.
    """
    return _passages(documents, items, _blocks(items, words, block_chars), key, text)


def _of(documents: DataFrame, key: str, text: str):
    """Whether ``_key`` and ``_md5`` are those of a document row; keys may be null or repeated."""
    return documents[key].eqNullSafe(F.col("_key")) & (F.md5(documents[text]) == F.col("_md5"))


def _spans_of(leaks: DataFrame, key: str) -> DataFrame:
    spans = F.sort_array(F.collect_set(F.struct("first_char", "last_char"))).alias("_spans")
    return leaks.groupBy(F.col(key).alias("_key"), F.col("text_md5").alias("_md5")).agg(spans)


@F.pandas_udf(StringType())
def _cut_out(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    rows = zip(texts, firsts, lasts, strict=True)
    return pd.Series([None if t is None else _kept(t, list(zip(first, last, strict=True))) for t, first, last in rows], dtype=object)


def without_leaks(documents: DataFrame, leaks: DataFrame, key: str = "doc_id", text: str = "text", spans_only: bool = True) -> DataFrame:
    """The documents without the leaked passages, or without the documents that hold one.

    ``leaks`` as of ``find_leaks``; all are cut out, overlapping ones once. Keeps all columns and rows
    (except, with ``spans_only`` off, the documents concerned).
    """
    spans = _spans_of(leaks, key)
    if not spans_only:
        return documents.join(spans, _of(documents, key, text), "left_anti")
    joined = documents.join(spans, _of(documents, key, text), "left")
    kept = _cut_out(F.when(F.col("_spans").isNotNull(), F.col(text)), F.col("_spans.first_char"), F.col("_spans.last_char"))
    return joined.withColumn(text, F.coalesce(kept, F.col(text))).select(*documents.columns)


def remove_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents without any passage of the items; ``find_leaks`` finds nothing in the result.

    The passages of a text are cut out, then those of what is left, until there are none. With one block of
    items each text does so where it stands, without a join; with more, a round goes over all blocks and the next one
    reads only the documents in which the last one found something, its words in lower case as they had it in the whole
    text (a capital sigma may have another after a cut). Keeps all columns and rows.
    """
    blocks = _blocks(items, words, block_chars)
    if len(blocks) == 1:
        return documents.mapInArrow(_clean(blocks[0], text), documents.schema)
    leaks = new = cut(_passages(documents, items, blocks, key, text))
    while not new.isEmpty():
        last = new.select(F.col(key).alias("_k"), F.col("text_md5").alias("_m"))
        spans = _spans_of(leaks, key).join(last, F.expr("_key <=> _k and _md5 = _m"), "left_semi")
        held = documents.join(spans, _of(documents, key, text), "inner")
        new = cut(_passages(held, items, blocks, key, text, spans="_spans"))
        leaks = leaks.unionByName(new)
    return without_leaks(documents, leaks, key, text)
