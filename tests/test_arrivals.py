"""Manifests that come in pieces, late, or not to their end, over restarts from one checkpoint."""

import pytest

from quarry.streaming import arrivals

SCHEMA = "repo_name string, manifest long, kind string, path string, content_hash long, root string"
BUCKETS = 2


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(manifest, repo="r", **hashes):
    return [(repo, manifest, "file", f"{p[0]}/{p}", h, p[0]) for p, h in hashes.items()]


def end(manifest, repo="r"):
    return [(repo, manifest, "end", None, None, None)]


def test_plans_over_restarts(rocks, tmp_path):
    spark, source, out = rocks, f"{tmp_path}/in", f"{tmp_path}/out"

    def start(*batches):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            query = arrivals.tracked(stream, BUCKETS).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(out)
            query.awaitTermination()
            assert query.exception() is None

    start(files(1, a1=1, a2=2, b1=3) + files(1, "q", x=1))
    start(end(1), files(2, a1=1, a2=9), files(2, c1=4) + end(2) + end(1, "q"))
    start(end(1) + files(1, z=1), files(3, a1=1, a2=9, c1=4) + end(3) + [("r", None, "repair", None, None, None)])
    partials = spark.read.schema(arrivals.PARTIAL).parquet(out)
    got = {(r.repo_name, r.manifest, r.mode): (r.added, r.changed, r.deleted, r.unchanged, r.lexical, r.scip, r.graph, r.roots) for r in arrivals.plans(partials, BUCKETS).collect()}
    assert got == {
        ("r", 1, "FULL"): (3, 0, 0, 0, "FULL_REPO", "FULL_REPO", "DELTA_FILES", "a,b"), ("q", 1, "FULL"): (1, 0, 0, 0, "FULL_REPO", "FULL_REPO", "DELTA_FILES", "x"),
        ("r", 2, "DELTA"): (1, 1, 1, 1, "DELTA_FILES", "PROJECT_ROOTS", "DELTA_FILES", "a,c"), ("r", 3, "NOOP"): (0, 0, 0, 3, "NOOP", "NOOP", "NOOP", ""),
        ("r", 3, "SEMANTIC_REPAIR"): (0, 0, 0, 3, "NOOP", "FULL_REPO", "DELTA_FILES", "a,c"),
    }
    assert {(r.manifest, r.bucket) for r in partials.filter("outcome = 'late'").collect()} == {(1, 0), (1, 1)}
    assert arrivals.plans(partials, BUCKETS, file_delta=False).filter("mode = 'DELTA'").first().lexical == "FULL_REPO_REWRITE"
    assert arrivals.plans(partials, BUCKETS + 1).isEmpty()  # not told by every bucket
