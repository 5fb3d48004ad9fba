"""Words, windows and hashes of whole text columns, in numpy over Arrow buffers.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``. All work
is by position in one byte buffer, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 18

STEP = U64(0x9E3779B97F4A7C15 | 1)
WINDOW_STEP = U64(0xD6E8FEB86659FD93)
#: Words longer than this many bytes are hashed one by one.
LONG = 64
PRIME = (1 << 61) - 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes that follow each place, zeros beyond the end, as one little-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _chunk(chunks: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The ``min(left, 8)`` bytes at each place, as a number."""
    out = chunks[at]
    short = left < 8
    out[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
    return out


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``: eight bytes a step, each through the mixer, so no step is linear."""
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    size = ends - starts
    out[:] = size
    out = mix(out)
    chunks = _chunks(data)
    with np.errstate(over="ignore"):
        live, done = np.flatnonzero(size <= LONG), 0
        while len(live):
            out[live] = mix((out[live] ^ _chunk(chunks, starts[live] + done, size[live] - done)) + STEP)
            done += 8
            live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def spans_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether ``data[start:end]`` and ``other[start:end]`` are the same bytes."""
    size = ends - starts
    same = size == other_ends - other_starts
    mine, its = _chunks(data), _chunks(other)
    live, done = np.flatnonzero(same & (size > 0)), 0
    while len(live) and done < LONG:
        left = size[live] - done
        same[live] = _chunk(mine, starts[live] + done, left) == _chunk(its, other_starts[live] + done, left)
        done += 8
        live = live[same[live] & (size[live] > done)]
    for i in live:
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    return same


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime 2**61 - 1."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it, by halves of 31 and 30 bits."""
    low = U64((1 << 31) - 1)
    ah, al, bh, bl = a >> U64(31), a & low, b >> U64(31), b & low
    cross = ah * bl + al * bh  # below 2**62
    # ah * bh * 2**62 is twice ah * bh; cross * 2**31 is split so that no part leaves 61 bits
    return _reduced(_reduced((ah * bh) << U64(1)) + _reduced(al * bl) + _reduced((cross >> U64(30)) + ((cross & U64((1 << 30) - 1)) << U64(31))))


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base modulo 2**61 - 1."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < n:
            have = np.concatenate([have, _times(have, np.full(len(have), pow(base, len(have), PRIME), U64))])
        if len(have) <= BLOCK * 16:
            _powers[base] = have
    return have


def runs_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each h[start:end], for runs of any length: a polynomial modulo 2**61 - 1, by prefix sums."""
    terms = _times(_reduced(h), _power(base, len(h))[: len(h)])
    low = U64((1 << 31) - 1)
    halves = [np.concatenate([np.zeros(1, U64), np.cumsum(x)]) for x in (terms >> U64(31), terms & low)]
    high, rest = (_reduced(x[end] - x[start]) for x in halves)
    sums = _reduced(_times(high, np.full(len(high), 1 << 31, U64)) + rest)
    place = _times(sums, _power(pow(base, -1, PRIME), len(h) + 1)[start])
    with np.errstate(over="ignore"):
        return mix(place + (end - start).astype(U64) * STEP)


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values of h; the result is k - 1 shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= WINDOW_STEP
            out += h[j : n + j]
    return mix(out)


@dataclass
class Words:
    """Words of consecutive documents. ``bounds[d]:bounds[d + 1]`` are the words of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends)

    def window_doc(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of k words that stay in a document, and their documents."""
        counts = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.bounds[doc] + first, doc


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of each row; a row's end also ends a word."""
    data = LOWER[data] if lower else data
    n = len(data)
    if not n:
        return Words(data, offsets, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    ink = ~WHITE[data]
    gap = np.ones(n + 1, bool)
    np.logical_not(ink[:-1], out=gap[1:n])
    gap[offsets] = True
    starts = np.flatnonzero(ink & gap[:n])
    gap[:-1] = ~ink
    gap[offsets] = True
    gap[n] = True
    ends = np.flatnonzero(ink & gap[1:]) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def of_column(column: pa.Array, lower: bool = False) -> Words:
    return split(*buffers(column), lower)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
