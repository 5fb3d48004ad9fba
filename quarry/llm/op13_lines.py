"""Repeated lines across documents, by hashes in order.

A line's key is the line without white at both ends, A-Z lower-cased. A key of at least
``LEAST`` code points stays only in the smallest document that holds it; other documents
lose all their lines with that key. Hashes travel, texts do not: what comes back is one
compressed bitmap of kept lines per document.

1. Map: each long enough line is a hash of 128 bits with its document and position.
2. Range partitions over (hash, document, position), sorted the same way. A line that a
   third of all rows holds so spans many partitions; none is a group of its own.
3. Each partition is streamed once, remembering one hash and its first document: rows of
   later documents are dropped at once. Only a partition's first run can have begun
   before: its first document stays open, and each partition reports its last hash, so
   that open rows are settled by a join of a few rows.
4. Dropped positions meet per document and become a bitmap.

Keys are compared by BLAKE2b digests of 128 bits, which stand for the bytes.

Defined results: a null or empty text is one empty line, which stays; a null doc_id counts
as the largest id; rows with one doc_id are one document for a line's count; repeated rows
get the same result; a very long line is hashed whole; an empty table gives an empty
result; columns of other names pass through ``without`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quarry.llm import scratch
from quarry.llm import words as W

#: Code points that a key needs to count.
LEAST = 10
LAST = np.iinfo(np.int64).max
BREAK = 10
DROPPED, OPEN, END = 0, 1, 2
LINE = "high long, low long, doc long, row long, position int, n_lines int"
TOLD = f"kind int, {LINE}"
BITMAP = "doc long, row long, n_lines long, n_dropped long, keep binary"
MARK = StructType().add("n_lines", LongType()).add("n_dropped", LongType()).add("text", StringType())


def keys(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, position, high, low) of each line that is long enough, and the lines of each document."""
    data, offsets = W.buffers(column)
    data = W.LOWER[data]
    breaks = np.flatnonzero(data == BREAK)
    # a line ends at a break or where its document ends
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    owner = np.concatenate([np.searchsorted(offsets[1:], breaks, "right"), np.arange(len(offsets) - 1)])
    owner = np.sort(owner, kind="stable")
    n_lines = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n_lines)])
    position = np.arange(len(ends)) - first[owner]
    starts = np.where(position == 0, offsets[owner], np.concatenate([[0], ends[:-1] + 1]))
    ink = np.flatnonzero(~W.WHITE[data])
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = b > a
    low, high = ink[a[some]], ink[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    enough = points[high] - points[low] >= LEAST
    at, low, high = np.flatnonzero(some)[enough], low[enough], high[enough]
    raw = data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(low.tolist(), high.tolist(), strict=True)])
    pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return owner[at], position[at], pair[:, 0], pair[:, 1], n_lines


def hashed(docs: DataFrame) -> DataFrame:
    """A row for each line that may be dropped; ``doc`` and ``row`` name the document's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            doc, position, high, low, n_lines = keys(batch.column("text"))
            at = pa.array(doc)
            columns = [pa.array(high), pa.array(low), batch.column("doc").take(at), batch.column("row").take(at), pa.array(position, pa.int32()), pa.array(n_lines[doc], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["high", "low", "doc", "row", "position", "n_lines"])

    return docs.select(*_named(), "text").mapInArrow(run, LINE)


def _named() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), F.xxhash64("doc_id", "text").alias("row")]


def told(lines: DataFrame) -> DataFrame:
    """Streams sorted ranges of lines: dropped ones, those that an earlier partition decides on, and each partition's last hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, head = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, doc = (batch.column(c).to_numpy() for c in ("high", "low", "doc"))
            new = np.concatenate([[now != (high[0], low[0])], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            firsts = np.append(doc[starts], first)  # the last stands for the run that goes on
            of = firsts[run_of]
            if now is None:
                head = (high[0], low[0], doc[0])
            kind = np.where(doc > of, DROPPED, -1)
            if head is not None:
                kind[(kind < 0) & (high == head[0]) & (low == head[1]) & (doc == head[2])] = OPEN
            now, first = (high[-1], low[-1]), of[-1]
            hit = np.flatnonzero(kind >= 0)
            out = batch.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([pa.array(kind[hit], pa.int32()), *out.columns], ["kind", *out.schema.names])
        if now is not None:
            one = [END, *now, first, 0, 0, 0]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], t) for x, t in zip(one, (pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 2), strict=True)], ["kind", *batch.schema.names])

    order = ["high", "low", "doc", "position"]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TOLD)


def bitmaps(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc, row, n_lines, n_dropped and ``keep`` (zlib over little-endian bits) of each document that loses lines; and a table to drop later."""
    rows, path = scratch.keep(told(hashed(docs)), "lines")
    ends = rows.filter(F.col("kind") == END).groupBy("high", "low").agg(F.min("doc").alias("first"))
    settled = rows.filter(F.col("kind") == OPEN).join(ends, ["high", "low"]).filter(F.col("doc") > F.col("first"))
    names = ["doc", "row", "n_lines", "position"]
    gone = rows.filter(F.col("kind") == DROPPED).select(*names).unionByName(settled.select(*names))
    per_doc = gone.groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("position").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, lost = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
                keep = np.ones(n, bool)
                keep[places.values.to_numpy()] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
                lost.append(n - int(keep.sum()))
            columns = [batch.column("doc"), batch.column("row"), batch.column("n_lines").cast(pa.int64()), pa.array(lost, pa.int64()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "row", "n_lines", "n_dropped", "keep"])

    return per_doc.mapInArrow(run, BITMAP), [path]


def kept_of(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").view(bool)


@F.pandas_udf(MARK)
def _struck(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    counts, lost, out = [], [], []
    for body, bits in zip(text, keep, strict=True):
        body = body or ""
        n, gone = body.count("\n") + 1, 0
        if bits is not None:
            stay = kept_of(bits, n)
            gone = n - int(stay.sum())
            body = "\n".join([line for line, one in zip(body.split("\n"), stay.tolist(), strict=True) if one])
        counts.append(n)
        lost.append(gone)
        out.append(body)
    return pd.DataFrame({"n_lines": counts, "n_dropped": lost, "text": out})


def marked(docs: DataFrame) -> DataFrame:
    """``all``: each row of docs as it is; ``mark``: its lines, the dropped ones and what is left of its text."""
    maps, _ = bitmaps(docs)
    rows = docs.select(F.struct(*docs.columns).alias("all"), *_named(), "text")
    return rows.join(maps.select("doc", "row", "keep"), ["doc", "row"], "left").select("all", _struck("text", "keep").alias("mark"))


def without(docs: DataFrame) -> DataFrame:
    """docs without repeated lines; a null text stays null."""
    columns = [F.when(F.col("all.text").isNotNull(), F.col("mark.text")).alias(c) if c == "text" else F.col(f"all.`{c}`") for c in docs.columns]
    return marked(docs).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return marked(docs).select("all.doc_id", "mark.n_lines", "mark.n_dropped", F.sha2("mark.text", 256).alias("kept_sha256"))
