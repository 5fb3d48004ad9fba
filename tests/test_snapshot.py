"""Snapshots are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import snapshot

SCHEMA = "org_id int, repo_id long, revision string, src string, dst string"
ONE, TWO = {"org_id": 1, "repo_id": 7, "revision": "main"}, {"org_id": 2, "repo_id": 8, "revision": "main"}


def edges(spark, tag, n=3):
    return spark.createDataFrame([(s["org_id"], s["repo_id"], r, f"{tag}{i}", "x") for s in (ONE, TWO) for r in ("main", "dev") for i in range(n)], SCHEMA)


def seen(spark, root, **scope):
    rows = snapshot.read(spark, root, "edges", edges(spark, "").schema, **scope)
    return sorted((r.org_id, r.repo_id, r.revision, r.src) for r in rows.collect())


def test_a_killed_write_leaves_the_old_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert seen(spark, root) == []
    snapshot.write(edges(spark, "a"), root, "edges", "s1")
    assert seen(spark, root) == []  # not active yet
    snapshot.activate(spark, root, "s1", [ONE, TWO], ("edges",))
    old = [(s["org_id"], s["repo_id"], "main", f"a{i}") for s in (ONE, TWO) for i in range(3)]
    assert seen(spark, root) == old

    @F.udf("string")
    def killed(x):
        if x == "b2":
            raise RuntimeError("killed")
        return x

    with pytest.raises(Exception, match="killed"):
        snapshot.write(edges(spark, "b").withColumn("src", killed("src")), root, "edges", "s2")
    assert seen(spark, root) == old and not snapshot.complete(spark, root, "edges", "s2")
    with pytest.raises(snapshot.Missing):
        snapshot.activate(spark, root, "s2", [ONE], ("edges",))
    snapshot.write(edges(spark, "b"), root, "edges", "s2")
    with pytest.raises(snapshot.Missing):
        snapshot.activate(spark, root, "s2", [ONE], ("edges", "vertices"))
    assert seen(spark, root) == old
    snapshot.activate(spark, root, "s2", [ONE], ("edges",))
    assert seen(spark, root) == [(1, 7, "main", f"b{i}") for i in range(3)] + old[3:]
    assert seen(spark, root, org_id=2) == old[3:] and seen(spark, root, repo_id=7) == [(1, 7, "main", f"b{i}") for i in range(3)]
    with pytest.raises(ValueError):
        snapshot.abandon(spark, root, "s2", ("edges",))
    snapshot.activate(spark, root, "s2", [TWO], ("edges",))
    snapshot.abandon(spark, root, "s1", ("edges",))
    snapshot.deactivate(spark, root, [ONE])
    assert seen(spark, root) == [(2, 8, "main", f"b{i}") for i in range(3)]


def test_reads_open_only_the_folders_of_a_scope(spark, tmp_path):
    root = f"file://{tmp_path}"
    snapshot.write(edges(spark, "a"), root, "edges", "s1")
    snapshot.activate(spark, root, "s1", [ONE, TWO], ("edges",))
    plan = snapshot.read(spark, root, "edges", edges(spark, "").schema, org_id=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org_id" in plan and "(org_id" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_names_of_folders(spark):
    for bad in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            snapshot.write(edges(spark, "a"), "file:///nowhere", "edges", bad)
