"""Symbol-index rows, lifecycle and evidence on small cases: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from quarry.operators import evidence, fused, lifecycle, scip


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_roles(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 8 | 32), (4, 64), (5, None)], "id int, mask int")
    assert rows(scip.by_role(df, "mask").select("id", "role")) == [(1, "REFERENCE"), (2, "DEFINITION"), (3, "READ"), (3, "REFERENCE"), (3, "TEST"), (4, "FORWARD_DEFINITION"), (5, "REFERENCE")]


def test_enclosed(spark):
    schema = "file string, ordinal int, symbol string, start_line int, start_col int, end_line int, end_col int"
    d = spark.createDataFrame([("a", 1, "outer", 0, 0, 20, 0), ("a", 2, "inner", 5, 4, 9, 1), ("b", 3, "other", 0, 0, 99, 0)], schema)
    o = spark.createDataFrame([("a", 4, "x", 6, 0, 6, 3), ("a", 5, "x", 5, 0, 5, 3), ("a", 6, "inner", 7, 0, 7, 1), ("a", 7, "x", 30, 0, 30, 1), ("c", 8, "x", 1, 0, 1, 1)], schema)
    got = scip.enclosed(o, d, ["file"], ["ordinal"], ["ordinal"])
    # The second starts before the inner one does, the third is the inner one itself, the rest are in none.
    assert rows(got) == [(4, "inner"), (5, "outer"), (6, "outer")]
    assert scip.enclosed(o.limit(0), d, ["file"], ["ordinal"], ["ordinal"]).count() == 0


def test_excluded(spark):
    schema = "id int, clone_url string, fork boolean, archived boolean, full_name string, topics array<string>, size long"
    df = spark.createDataFrame(
        [(1, None, False, False, "a/b", [], 1), (2, "u", True, None, "a/b", ["Go"], None), (3, "u", False, True, "a/b", ["Go"], 1), (4, "u", False, None, "x/b", ["go"], 1), (5, "u", None, None, None, None, 1), (6, "u", False, False, "a/b", ["GO"], 9)], schema
    )

    def left_out(rules, topics=()):
        return {r.id for r in df.filter(lifecycle.excluded(rules, topics)).collect()}

    assert left_out({}) == {1}
    assert left_out({"forks": True}) == {1, 2}
    assert left_out({"archived": True}) == {1, 3}
    assert left_out({"repos": ["x/*"]}) == {1, 4}
    assert left_out({"topics": ["g*"]}) == {1, 2, 3, 4, 6}
    assert left_out({}, ["go"]) == {1, 5}
    assert left_out({"max_size": 8000}) == {1, 6}
    assert left_out({"min_size": 1001}) == {1, 3, 4, 5}


def test_reachable(spark):
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 3), (5, 4)], "id long, parent long")
    assert {r.id for r in lifecycle.reachable(parents, 5).collect()} == {1, 2, 3, 4, 5}
    assert rows(lifecycle.ahead_behind(parents, 4, 3)) == [(1, 1)]
    assert rows(lifecycle.ahead_behind(parents, 99, 1)) == [(1, 1)]
    assert {r.id for r in lifecycle.reachable(parents, 5, 3).collect()} == {5, 3, 2}


def test_reachable_on_a_long_line(spark):
    """A line of commits takes as many rounds as its length has bits; where there are more than may be told, exactly those are told."""
    line = spark.range(2, 5001).select("id", (F.col("id") - 1).alias("parent"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    spark.sparkContext.setJobGroup("line", "line")
    assert lifecycle.reachable(line, 5000, 6000).count() == 5000
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("line"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150 and before is not None  # stages of adaptive queries are jobs of their own
    got = lifecycle.reachable(line, 5000, 1000)
    assert got.count() == 1000 and got.agg(F.min("id")).first()[0] == 4001


def test_activation_and_cleanup(spark):
    df = spark.createDataFrame([(1, 1, "r", "READY", 1), (2, 1, "r", "READY", 2), (3, 1, "r", "INDEXING", 1), (4, 1, "r", "INDEXING", 3), (5, 1, "s", "FAILED", 1)], "id int, repo_id int, revision string, status string, updated_at int")
    assert [(i, s) for i, _, _, s in rows(lifecycle.activated(df))] == [(1, "SUPERSEDED"), (2, "ACTIVE"), (3, "SUPERSEDED"), (4, "INDEXING"), (5, "FAILED")]
    pointers = spark.createDataFrame([(1, "r", 2), (1, "s", 2), (1, "s", 5)], "repo_id int, revision string, index_id int")
    kept, orphans = lifecycle.cleaned(pointers, df, "s")
    assert kept.count() == 1
    assert {r.id for r in orphans.collect()} == {1, 3, 4, 5}  # 2 is shared with the pointer that stays


def test_roots(spark):
    files = spark.createDataFrame([("r", "a/b/c.go"), ("r", "a/x.go"), ("r", "z.go"), ("q", "a/b/c.go")], "repo_name string, path string")
    roots = spark.createDataFrame([("r", "a"), ("r", "a/b"), ("r", "a/b")], "repo_name string, root string")
    assert rows(lifecycle.project_roots(files, roots)) == [("q", "a/b/c.go", "."), ("r", "a/b/c.go", "a/b"), ("r", "a/x.go", "a"), ("r", "z.go", ".")]


def test_slices(spark):
    df = spark.createDataFrame(
        [
            ("p", "a.go", 5, "focused", 50), ("p", "a.go", 6, "focused", 50), ("p", "a.go", 6, "runtime-env", 45), ("p", "a.go", 100, "broad", 40), ("p", "a.go", 200, "broad", 30), ("p", "a.go", 300, "broad", 20), ("p", "a_test.go", 1, "test", 60),
            ("q", "b.go", 1, "broad", 1), ("q", "x/vendor/c.go", 1, "broad", 99), ("q", "b.go", 0, "broad", 9), (None, "d.go", 1, "broad", 9), ("p", "a.go", 301, "scip-definition-requested", 10), ("p", "z/sdk.py", 9, "broad", 1),
        ],
        "repo_name string, path string, line int, source string, score int",
    ).withColumn("branch", F.lit("main"))
    chosen = fused.selected(df, 50, preferred=("sdk.py",))
    got = [(r.repo_name, r.path, r.line, r.score) for r in chosen.collect()]
    assert got == [("p", "a.go", 5, 50), ("p", "z/sdk.py", 9, 46), ("p", "a.go", 6, 45), ("p", "a.go", 100, 40), ("p", "a.go", 200, 30), ("p", "a_test.go", 1, 25), ("p", "a.go", 300, 20), ("p", "a.go", 301, 10), ("q", "b.go", 1, 1)]
    assert [r.score for r in fused.selected(df, 1, tests=True).collect()] == [60]
    got = [(r.path, r.line) for r in fused.diverse(chosen, 50, across=True, preferred=("sdk.py", "_test.go")).collect()]
    assert got == [("a.go", 5), ("b.go", 1), ("z/sdk.py", 9), ("a_test.go", 1), ("a.go", 6), ("a.go", 100), ("a.go", 301)]
    assert [(r.path, r.line) for r in fused.diverse(chosen, 2).collect()] == [("a.go", 5), ("z/sdk.py", 9)]


def test_trust(spark):
    df = spark.createDataFrame([(1, "scip", "x", 0.1, "nodejs"), (2, "", "ast-go", 0.9, "nodejs"), (3, "heuristic", "x", 0.9, "nodejs"), (4, "", "x", 0.8, "nodejs"), (5, "SCIP", "x", None, "python"), (6, "scip", "x", 0.1, "python nodejs webhook"), (7, "scip", "x", 0.1, "webhook"), (8, "scip", "x", 0.1, "plain")], "id int, provenance string, source string, confidence double, said string")
    assert [r.id for r in evidence.by_trust(df, F.col("said"), ["node"]).filter("trusted").collect()] == [1, 4, 6, 7]
    assert [r.id for r in evidence.by_trust(df).filter("trusted").collect()] == [1, 4, 5, 6, 7, 8]


def test_proof_lines(spark):
    df = spark.createDataFrame([(1, 1, "p"), (1, 2, "e"), (1, 3, "p"), (1, 4, "e"), (1, 5, "p"), (2, 1, "p")], "g int, n int, kind string")
    got = evidence.proof_lines(df, "g", ["n"], F.col("kind") == "e", F.col("kind") == "p", "n")
    assert rows(got.select("g", "n", "edge")) == [(1, 1, None), (1, 3, 2), (1, 5, 4), (2, 1, None)]
