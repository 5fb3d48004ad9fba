"""Byte-level BPE over whole texts, as trees of halves joined at their boundaries.

Texts. A text is halved until a piece has ``LEAF`` characters; a piece is split into
matches of the pattern, and each match is merged alone. Two neighbours are joined by
encoding anew a window around their boundary. The window grows on each side until it
ends where every tokenisation must cut: white space after a byte that is an ASCII
letter, digit or mark. The split pattern can only take white space at the start of a
match or as a run of its own, so a match never crosses such a place, and what lies
beyond does not depend on the other half. Tokens outside the window are final.

Matches. The bytes of a match are halved until ``SHORT``; these are merged pair by pair,
least rank first. Two neighbours are joined by merging anew their boundary tokens, one
from each side and twice as many where that is not enough. It is enough where the
window's outer token and the token beyond it, taken by themselves, merge into just these
two: tokens of which all neighbours bear that test are the encoding of their bytes, as a
merge across a boundary that the two alone would not make is never made in a longer text.
Matches of up to ``WORD`` characters are kept in a bounded table, so a common word is
merged once a worker.

Decoding maps pieces of ids to bytes and concatenates up the same tree.

Defined results: a null text counts as empty and has no tokens; a null id stays null;
equal texts get equal ids; very long texts are encoded whole, in time that grows with
their length and its logarithm; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import words as W

#: Characters of a piece of text, characters of a first window, and bytes that are merged without a tree.
LEAF, WINDOW, SHORT = 512, 32, 16
#: Matches and pairs that a worker remembers, and characters of a match that it may remember.
REMEMBERED, WORD = 1 << 19, 64
#: White space that a match can only have in front, and what may stand before it.
BREAK = frozenset(" \t\n\r")
FIRM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?-_()[]{}<>/\\|@#$%^&*+=~`\"'")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Known(dict):
    """Ids of matches, merged when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = tuple(self.codec.match(match.encode()))
        if len(match) <= WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = ids
        return ids


class Codec:
    """Ids of texts and texts of ids, by a rank file's bytes and a split pattern."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW, short: int = SHORT):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.leaf, self.window, self.short = leaf, window, short
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.name_of = [str(i) for i in range(size)]
        self.known = Known(self)
        self.apart: dict[tuple[int, int], bool] = {}

    def small(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def match(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._tree(piece)

    def _tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.short:
            return self.merged(piece)
        middle = len(piece) // 2
        return self.joined(self._tree(piece[:middle]), self._tree(piece[middle:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of two neighbours, from the ids of each."""
        i = j = 1
        while True:
            middle = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            before = i == len(left) or self._stay(left[-i - 1], middle[0])
            after = j == len(right) or self._stay(middle[-1], right[j])
            if before and after:
                return left[:-i] + middle + right[j:]
            i = i if before else min(len(left), 2 * i)
            j = j if after else min(len(right), 2 * j)

    def _stay(self, a: int, b: int) -> bool:
        """Whether two tokens that meet stay as they are."""
        out = self.apart.get((a, b))
        if out is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            out = self.apart[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Neighbours merged, the pair of least rank and then the first of such first, until no pair is a token."""
        ranks = self.ranks
        if len(piece) > 4 * SHORT:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == 1 << 40:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return [ranks[x] for x in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """As ``merged``, with a heap of pairs over a list that is linked both ways."""
        n, ranks = len(piece), self.ranks
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if ends[i] == 0 or after[i] != j or j >= n or ranks.get(piece[i : ends[j]]) != rank:
                continue
            ends[i], ends[j] = ends[j], 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(piece[i : ends[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, after[j]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : ends[i]])) is not None:
                heapq.heappush(heap, (r, before[i], i))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.small(text)
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.small(text[a:b])
        middle = (a + b) // 2
        left, right = self._encode(text, a, middle), self._encode(text, middle, b)
        return self.join(text, a, middle, b, left, right)

    def join(self, text: str, a: int, middle: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of text[a:middle] and text[middle:b]."""
        low = self._cut_before(text, a, middle)
        high = self._cut_after(text, middle, b)
        keep = self._tokens_from_end(left, len(text[low:middle].encode()))
        skip = self._tokens_from_start(right, len(text[middle:high].encode()))
        return left[: len(left) - keep] + self.small(text[low:high]) + right[skip:]

    def _cut_before(self, text: str, a: int, middle: int) -> int:
        """The last sure cut in the window before the boundary, which doubles until it has one or is the whole half."""
        size = self.window
        while True:
            low = max(a, middle - size)
            for p in range(middle - 1, low, -1):
                if text[p] in BREAK and text[p - 1] in FIRM:
                    return p
            if low == a:
                return a
            size *= 2

    def _cut_after(self, text: str, middle: int, b: int) -> int:
        size = self.window
        while True:
            high = min(b, middle + size)
            for p in range(middle + 1, high):
                if text[p] in BREAK and text[p - 1] in FIRM:
                    return p
            if high == b:
                return b
            size *= 2

    def _tokens_from_end(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[ids[-n]])
        if size:
            raise AssertionError("a cut fell inside a token")
        return n

    def _tokens_from_start(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[n]])
            n += 1
        if size:
            raise AssertionError("a cut fell inside a token")
        return n

    def decode(self, ids: list[int]) -> bytes:
        """Halves decoded alone and put together; ids beyond the table are an error."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join(map(self.name_of.__getitem__, ids)).encode()).hexdigest()


@cache
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _shared(spark: SparkSession, ranks: str | None, pattern: str | None):
    """The rank file, read on the driver, goes out once as a broadcast: its size is that of one vocabulary file."""
    with open(ranks or default_ranks(), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or default_pattern()))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each document."""
    shared = _shared(docs.sparkSession, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in W.slices(batches, "text"):
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text (binary) of each row of ids; null ids give empty bytes."""
    shared = _shared(encoded.sparkSession, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids are made and decoded in one pass, so no token leaves its task."""
    shared = _shared(docs.sparkSession, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in W.slices(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids))
                ids_sha.append(codec.digest(ids))
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
