"""A Bloom filter of 64-bit keys of a table, bounded in size; a full one lets more through but loses nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import words as W

#: Bits for each key, probes, and the most bits of a filter (4 MiB).
PER_KEY, PROBES, MOST = 12, 6, 1 << 25
CHUNK = 1 << 16


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a = W.mix(keys.view(np.uint64))
    b = W.mix(a) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b) & np.uint64(bits - 1)).astype(np.int64)


def holds(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the table. filled: packed bits."""
    out = np.ones(len(keys), bool)
    for p in places(keys, 8 * len(filled)):
        out &= (filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def build(df: DataFrame, key: str, n: int) -> np.ndarray:
    """The filter of a long column, for about n keys. Partitions make pieces, which are joined by place before the driver gets them."""
    bits = 1 << 13
    while bits < min(n * PER_KEY, MOST):
        bits <<= 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for p in places(np.ascontiguousarray(keys), bits):
                flags[p] = True
        packed = np.packbits(flags, bitorder="little")
        pieces = [(i, packed[i : i + CHUNK].tobytes()) for i in range(0, len(packed), CHUNK) if packed[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int64()), pa.array([b for _, b in pieces], pa.binary())], ["at", "piece"])

    def together(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, None
        for batch in pieces:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(b, np.uint8)
                at, out = i, new.copy() if out is None else out | new
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["at", "piece"])

    filled = np.zeros(bits // 8, np.uint8)
    for r in df.select(key).mapInArrow(part, "at long, piece binary").groupBy("at").applyInArrow(together, "at long, piece binary").collect():
        filled[r["at"] : r["at"] + len(r.piece)] = np.frombuffer(r.piece, np.uint8)
    return filled


def parted(df: DataFrame, key: str, filled: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows whose long ``key`` surely isn't in the filter's table, and those where it may be."""
    shared = df.sparkSession.sparkContext.broadcast(filled)  # at most 4 MiB

    def rows(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(holds(shared.value, batch.column(key).to_numpy()) == inside))

        return df.mapInArrow(run, df.schema)

    return rows(False), rows(True)
