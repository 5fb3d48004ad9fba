"""Exact removal of repeated passages, by super-k-mers.

A window is ``K`` consecutive words of a document. Its minimiser is the least hash of
its ``M``-word pieces. Consecutive windows with the same minimiser travel as one packed
string (their words, overlapping ones once) to the bucket of the minimiser, so equal
windows meet in one bucket, and sorting there finds them exactly.

1. Map: each block of text makes its super-k-mers; equal ones of a block go once, with
   the least and the greatest document. A hot passage so sends one string a block.
2. Bucket: windows are sorted; those in two documents or more get their first document.
   A string with such windows becomes a verdict: places in it and first documents.
3. Map again: occurrences of strings whose key a bounded Bloom filter of the verdicts
   holds are joined with the verdicts (hot keys are split by the adaptive skew join).
4. Documents that have something to lose, by a second bounded filter, meet their word
   places; all others never move.

Defined results: a null text has no words; a null doc_id counts as larger than any id;
rows with the same doc_id are not smaller than one another; repeated rows get the same
result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bloom, scratch
from quarry.llm import words as W

K, M = 13, 3
LAST = np.iinfo(np.int64).max
#: Text of a map block, and input bytes for each bucket.
BLOCK, PER_BUCKET, LEAST_BUCKETS = 4 << 20, 2 << 20, 256
#: Bases of two hashes of runs of words.
FIRST_BASE, SECOND_BASE = 0x0A0761D6478BD64F, 0x07037ED1A0B428DB
PACKED = "bucket int, body binary, lengths binary, least binary, greatest binary"
VERDICT = "key1 long, key2 long, places array<int>, firsts array<long>"
FOUND = "doc_id long, row long, start int, key1 long, key2 long"


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def super_kmers(words: W.Words, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(minimiser, document, first word, last word + 1, key1, key2) of each run of windows with one minimiser."""
    h = words.hashes()
    first, doc = words.window_doc(k)
    if not len(first):
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none, none, none
    least = least_of(W.windows_hash(h, m), k - m + 1)[first]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    start = first[at]
    end = first[np.append(at[1:], len(first)) - 1] + k
    return least[at], doc[at], start, end, W.signed(W.runs_hash(h, start, end, FIRST_BASE)), W.signed(W.runs_hash(h, start, end, SECOND_BASE))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("doc_id"), LAST).to_numpy(zero_copy_only=False)


def pack(docs: DataFrame, buckets: int) -> DataFrame:
    """The super-k-mers of each block of text by bucket, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", BLOCK):
            words = W.of_column(batch.column("text"))
            least, doc, start, end, key1, key2 = super_kmers(words)
            if not len(least):
                continue
            ids = _ids(batch)[doc]
            bucket = (W.mix(least) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key2, key1, bucket))
            new = np.concatenate([[True], (key1[order][1:] != key1[order][:-1]) | (key2[order][1:] != key2[order][:-1])])
            at = np.flatnonzero(new)
            one = order[at]
            low, high = np.minimum.reduceat(ids[order], at), np.maximum.reduceat(ids[order], at)
            a, b = words.starts[start[one]], words.ends[end[one] - 1]
            lengths = (b - a).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[one][1:] != bucket[one][:-1]]))
            raw, rows = words.data.tobytes(), []
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(one)], strict=True):
                body = b"".join([raw[s:e] for s, e in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)])
                rows.append((int(bucket[one[x]]), len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True), lengths[x:y].tobytes(), low[x:y].tobytes(), high[x:y].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "body", "lengths", "least", "greatest"])

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def judge(packed: DataFrame) -> DataFrame:
    """For each distinct string that has windows of several documents: their places in it and first documents."""

    def bodies(column: pa.Array) -> bytes:
        return b"".join(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in column.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        body = np.frombuffer(b"".join(bodies(c) for c in table.column("body").chunks), np.uint8)
        lengths, low, high = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("lengths", "least", "greatest"))
        words = W.split(body, np.concatenate([[0], np.cumsum(lengths)]))
        h = words.hashes()
        first, string = words.window_doc(K)
        key = W.windows_hash(h, K)[first]
        order = np.argsort(key, kind="stable")
        at = first[order]
        same = key[order][1:] == key[order][:-1]
        pair = np.flatnonzero(same)
        for j in range(K):  # exact: equal hashes must have equal bytes of words
            one, two = at[pair] + j, at[pair + 1] + j
            pair = pair[W.spans_equal(body, words.starts[one], words.ends[one], body, words.starts[two], words.ends[two])]
        same[:] = False
        same[pair] = True
        edge = np.flatnonzero(np.concatenate([[True], ~same]))
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        least, most = np.minimum.reduceat(low[string[order]], edge), np.maximum.reduceat(high[string[order]], edge)
        several = (least < most)[group]
        window, firsts = order[several], least[group[several]]
        back = np.argsort(window, kind="stable")
        window, firsts = window[back], firsts[back]
        of = string[window]
        hit = np.unique(of)
        ends = words.bounds[hit + 1]
        key1, key2 = (W.signed(W.runs_hash(h, words.bounds[hit], ends, s)) for s in (FIRST_BASE, SECOND_BASE))
        keep = np.unique(np.stack([key1, key2], axis=1), axis=0, return_index=True)[1] if len(hit) else np.empty(0, int)
        begin, end = np.searchsorted(of, hit[keep]), np.searchsorted(of, hit[keep], "right")
        sizes = end - begin
        pick = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        places = first[window[pick]] - words.bounds[of[pick]]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(key1[keep]), pa.array(key2[keep]), pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(firsts[pick]))], ["key1", "key2", "places", "firsts"])

    return packed.groupBy("bucket").applyInArrow(run, VERDICT)


def with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def occurrences(docs: DataFrame, filled: np.ndarray) -> DataFrame:
    """Where strings that may have a verdict stand: document, row, first word and key."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)  # at most 4 MiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", BLOCK):
            words = W.of_column(batch.column("text"))
            _, doc, start, _, key1, key2 = super_kmers(words)
            hit = np.flatnonzero(bloom.holds(shared.value, key1))
            at = pa.array(doc[hit])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(start[hit] - words.bounds[doc[hit]], pa.int32()), pa.array(key1[hit]), pa.array(key2[hit])], ["doc_id", "row", "start", "key1", "key2"])

    return with_row(docs).mapInArrow(run, FOUND)


def size_of(docs: DataFrame) -> int:
    """Bytes of input by the plan's statistics, or of text where they are unknown."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, row and lists of the first words of the windows to remove, per document that has any; and the tables to drop later."""
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, size_of(docs) // PER_BUCKET)
    verdicts, path = scratch.keep(judge(pack(docs, buckets)), "verdicts")
    filled = bloom.build(verdicts, "key1", verdicts.count())
    found = occurrences(docs, filled).join(verdicts, ["key1", "key2"])
    own = F.coalesce("doc_id", F.lit(int(LAST)))
    gone = F.expr("filter(transform(places, (p, i) -> CASE WHEN firsts[i] < own THEN start + p END), p -> p IS NOT NULL)")
    per_doc = found.withColumn("own", own).select("doc_id", "row", gone.alias("gone")).filter(F.size("gone") > 0)
    out, kept = scratch.keep(per_doc.groupBy("doc_id", "row").agg(F.collect_set("gone").alias("gone")), "removed")
    scratch.drop(spark, path)
    return out, [kept]


def without(docs: DataFrame, removed: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces: as text, or as kept_sha256."""
    filled = bloom.build(removed, "row", removed.count())
    shared = docs.sparkSession.sparkContext.broadcast(filled)  # at most 4 MiB
    name = "kept_sha256" if digest else "text"
    schema = f"doc_id long, n_words long, n_removed long, {name} string"

    def strike(batch: pa.RecordBatch, gone: list | None) -> pa.RecordBatch:
        words = W.of_column(batch.column("text"))
        cover = np.zeros(len(words.starts) + 1, np.int32)
        for i, lists in enumerate(gone or ()):
            for one in lists or ():
                at = words.bounds[i] + np.array(one, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + K, -1)
        lost = np.cumsum(cover[:-1]) > 0
        removed_ = np.diff(np.concatenate([[0], np.cumsum(lost)])[words.bounds])
        raw, out = words.data.tobytes(), []
        bounds, at = words.bounds.tolist(), words.offsets.tolist()
        for i in range(batch.num_rows):
            kept = raw[at[i] : at[i + 1]].split()
            if removed_[i]:
                kept = [w for w, x in zip(kept, lost[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not x]
            text = b" ".join(kept)
            out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed_, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", name])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            clear = ~bloom.holds(shared.value, batch.column("row").to_numpy())
            yield strike(batch.filter(pa.array(clear)), None)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.holds(shared.value, batch.column("row").to_numpy())))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            yield strike(batch, batch.column("gone").to_pylist())

    rows = with_row(docs)
    some = rows.mapInArrow(maybe, rows.schema)
    r = removed.select(F.col("doc_id").alias("r_doc"), F.col("row").alias("r_row"), "gone")
    met = some.join(r, some.doc_id.eqNullSafe(r.r_doc) & (some.row == r.r_row), "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(untouched, schema).unionByName(met.mapInArrow(touched, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without(docs, repeated(docs)[0], digest=True)
