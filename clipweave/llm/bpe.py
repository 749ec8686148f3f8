"""Encoding by a byte-level BPE vocabulary as a streaming transducer with bounded lookahead.

The encoding of a text is the only sequence of tokens in which every two neighbours are compatible,
that is, are themselves the encoding of their joined bytes. So the last token of each prefix is the
longest token that ends there and is compatible with the last token of the prefix before it, and a
left-to-right pass needs no more of the past than the longest token is long. That length is the
sufficient lookahead of the merge list: a token is emitted once all prefixes within it agree on it,
and what lies before is forgotten. Texts are read in parts of bounded size; each part is cut into pieces by
the vocabulary's split pattern, and the last pieces, which a later part may change, wait for it. Pieces
that are tokens need no merging, encoded ones are kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the split pattern of the byte-level rank files, as their documentation states it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are read at once.
PART = 1 << 16
#: Pieces and pairs that a worker remembers; the table is emptied when full.
REMEMBERED = 200_000


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; a few hundred KB, read once on the driver."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks of a byte-level BPE and what follows from its merge list."""

    def __init__(self, ranks: bytes):
        self.id = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self.token = {r: t for t, r in self.id.items()}
        self.lookahead = max(map(len, self.id))
        self.ends: dict[int, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.id.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay two tokens when their bytes are encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known


class PieceEncoder:
    """The transducer over the bytes of one piece: feed bytes, get the tokens that are stable by then."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base = 0  # bytes before the window
        self.window = bytearray()
        self.last: list[tuple[int, int]] = [(-1, 0)]  # last token and its length, by prefix of the window

    def feed(self, data: bytes) -> list[int]:
        v, window, last = self.v, self.window, self.last
        out: list[int] = []
        for byte in data:
            window.append(byte)
            end = len(window)
            best = None
            for start in range(max(0, end - v.lookahead), end):
                before = last[start]
                if before is None:
                    continue
                token = v.id.get(bytes(window[start:end]))
                if token is None:
                    continue
                if before[0] < 0 or v.compatible(before[0], token):
                    best = (token, end - start)
                    break
            last.append(best)
            if end >= 4 * v.lookahead:
                out += self._settle()
                window, last = self.window, self.last
        return out

    def _path(self, end: int) -> list[int]:
        ends = []
        while end > 0:
            ends.append(end)
            end -= self.last[end][1]
        return ends

    def _emit(self, end: int) -> list[int]:
        out = [self.last[e][0] for e in reversed(self._path(end))]
        keep = self.last[end:]
        keep[0] = (keep[0][0], 0)
        self.window, self.last = self.window[end:], keep
        self.base += end
        return out

    def _settle(self) -> list[int]:
        """Tokens on which every prefix within the lookahead agrees."""
        n = len(self.window)
        common: set[int] | None = None
        for end in range(max(1, n - self.v.lookahead), n + 1):
            if self.last[end] is None:
                continue
            path = set(self._path(end))
            common = path if common is None else common & path
        return self._emit(max(common)) if common else []

    def finish(self) -> list[int]:
        """The tokens that were still open."""
        return self._emit(len(self.window)) if self.window else []


class Encoder:
    """Texts to token ids; ``feed`` takes a text in parts, ``encode`` a whole one."""

    def __init__(self, vocabulary: Vocabulary, split: str = SPLIT):
        self.v = vocabulary
        self.split = regex.compile(split)
        self.pieces: dict[str, list[int]] = {}
        self.rest = ""

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        whole = self.v.id.get(data)
        if whole is not None:
            return [whole]
        run = PieceEncoder(self.v)
        return run.feed(data) + run.finish()

    def _ids(self, parts: Iterable[str]) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self.piece(part)
                if len(part) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, without special tokens; none for an empty or null text. Read part by part."""
        if not text:
            return []
        out: list[int] = []
        for i in range(0, len(text), PART):
            out += self.feed(text[i : i + PART])
        return out + self.finish()

    def feed(self, text: str) -> list[int]:
        """Ids that no later part can change: all but those of the last two pieces.

        The last one may go on, and an apostrophe before it may become the beginning of a contraction. A piece
        longer than a part waits whole, as only its end shows where it is cut; its bytes pass the transducer.
        """
        said = self.rest + text
        parts = self.split.findall(said)
        waiting = parts[-2:]
        self.rest = said[len(said) - sum(map(len, waiting)) :]
        return self._ids(parts[:-2])

    def finish(self) -> list[int]:
        parts, self.rest = self.split.findall(self.rest), ""
        return self._ids(parts)


class Decoder:
    """Token ids to text: a state machine over UTF-8 that gives each character once its bytes are complete."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = vocabulary.token
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.token[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode_texts(texts: DataFrame, key: str, text: str, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", split: str = SPLIT) -> DataFrame:
    """``key, ids`` for every row of ``texts``: the ids of its text, an empty list for empty and null texts.

    Rows stay where they are, none is dropped, repeated or joined, and texts are encoded whole, however
    long. The vocabulary, a file of fixed size, goes to the executors as a broadcast.
    """
    ranks = texts.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(ranks.value), split)
        for batch in batches:
            offsets, flat = [0], []
            for value in batch.column(1):
                flat += encoder.encode(value.as_py())
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, key: str, ids: str = "ids", ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key, text`` of ``key, ids``: the way back. A null list gives a null text, an empty one an empty text."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(ranks.value)
        for batch in batches:
            out = []
            for value in batch.column(1):
                machine = Decoder(vocabulary)
                out.append(machine.feed(value.as_py()) + machine.finish() if value.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
