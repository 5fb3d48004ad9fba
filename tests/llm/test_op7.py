import zlib
from collections import Counter

from quarry.llm import op7_shards


def check(rows, n):
    assert {r.law for r in rows} <= {"rows"}
    counts = Counter(r.shard for r in rows)
    if rows:
        full = [counts[s] for s in range(n)]
        assert max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op7_shards.assign(df).collect()
    assert len(rows) == df.count()
    check(rows, 40)
    text = {r.doc_id: r.text for r in df.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, ""), (1, ""), (7, "é"), (7, "b")] * 30, "doc_id long, text string")
    rows = op7_shards.assign(df.withColumn("shard", df.doc_id).withColumn("low", df.doc_id)).collect()
    assert len(rows) == 180
    check(rows, 40)
    assert op7_shards.assign(df.limit(0)).count() == 0


def test_few_move(spark):
    counts = {c: 100 + c % 7 for c in range(op7_shards.CELLS)}
    total = sum(counts.values())
    assert op7_shards.moved(counts) < total / 3
    assert sum(h - low for _, low, h, _, _ in op7_shards.deal(counts)) == total


def test_ring_is_consistent():
    small, large = set(op7_shards.ring(40, 128, 1 << 13)), set(op7_shards.ring(41, 128, 1 << 13))
    assert small < large and {s for _, s in large - small} == {40}
