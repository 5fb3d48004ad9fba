import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import build, chat, delta, edges, evidence, extract, graph, inspect, jobs, lexical, policy, scope
from quarry.plans import question, search, terms
from quarry.sources import walk
from quarry.streaming import leases


def test_intents_are_tested_in_order():
    assert question.plan("who calls import X").intent == "imports"
    assert question.plan("callers of f").direction == "incoming"
    assert question.plan("anything").intent == "default" and question.plan("anything").depth == 3
    assert question.plan("from a to b").intent == "path" and question.plan("from a to b").depth == 5
    assert question.focused("minimal_context", "x").intent == "impact"
    assert question.focused("callees", "x").contexts == ("call", "import")
    assert question.focused("callers", "the import of x").intent == "imports"
    assert "containment" in question.plan("which files call").contexts
    assert question.budget(25) == {"tokens": 8, "seed_rows": 25, "seeds": 100, "rows": 150}


def test_terms():
    assert terms.terms("Where is the Foo.bar and foo.BAR of pkg/x?") == ["Foo.bar", "pkg/x"]


@pytest.mark.parametrize("glob,yes,no", [("src/**/*.go", ["src/a.go", "src/b/c.go"], ["src/a.py", "x/src/a.go"]), ("*.{ts,js}", ["a.ts"], ["d/a.ts", "a.tsx"]), ("a?.md", ["ab.md"], ["a/.md", "abc.md"])])
def test_globs(glob, yes, no):
    import re

    assert all(re.search(text.glob_to_regex(glob), p) for p in yes) and not any(re.search(text.glob_to_regex(glob), p) for p in no)


def test_search_language():
    tree = search.parse('a -file:b "c d" or branch:refs/heads/x')
    assert search.atoms(tree) == [(True, search.Atom("content", "a")), (False, search.Atom("file", "b")), (True, search.Atom("content", "c d")), (True, search.Atom("branch", "x"))]
    assert [len(p.parts) for p in tree.parts] == [3, 1]
    grouped = search.parse("(a or b) -(c rev:d)")
    assert isinstance(grouped.parts[0].parts[0], search.Any) and isinstance(grouped.parts[0].parts[1], search.Not)
    assert search.branches("x branch:refs/heads/a -b:c (rev:d or b:a)") == ["a", "d"]
    for bad in ("(a", "a)", '"open'):
        with pytest.raises(ValueError):
            search.parse(bad)


def test_ids(spark):
    row = spark.range(1).select(text.hash_of(F.lit("abc"), F.lit("def")).alias("a"), text.hash_of(F.lit("")).alias("b"), text.normalized(F.lit(" a b!c ")).alias("c")).first()
    assert tuple(row) == ("516a5e92", "e3b0c442", "a_b_c")


def test_scope_arguments(spark):
    df = spark.createDataFrame([(1, "main"), (2, "rel/1")], "org_id int, branch string")
    with pytest.raises(ValueError):
        scope.in_org(df, 0)
    with pytest.raises(ValueError):
        scope.page(df, ["org_id"], 0, 5)
    allowed = lambda globs, default: [r.branch for r in df.filter(scope.branch_allowed(F.col("branch"), F.lit(default).cast("string"), globs)).collect()]
    assert allowed([], "main") == ["main"] and allowed([], None) == ["main", "rel/1"] and allowed(["*"], "main") == ["main", "rel/1"] and allowed(["rel*"], "main") == ["rel/1"]
    assert scope.page_limit(0) == 25 and scope.page_limit(500) == 100


def test_hops_against_plain_search(spark):
    r = random.Random(1)
    pairs = [(f"v{r.randint(0, 40)}", f"v{r.randint(0, 40)}") for _ in range(60)]
    near = {"v1": 0}
    for d in range(1, 4):
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if near.get(x) == d - 1:
                    near.setdefault(y, d)
    got = graph.hops(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("v1",)], "vid string"), 3)
    assert {r.vid: r.depth for r in got.collect()} == near


def test_hub_threshold_place(spark):
    degree = spark.createDataFrame([(str(i), i) for i in range(200)], "vid string, degree long")
    assert graph.hub_threshold(degree).first().threshold == 198


def test_reconcile_twice_is_once(spark):
    rows = [("a", "b", "CALLS", s, c, 1, i) for i, (s, c) in enumerate([("scip", 0.5), ("ast-go", 0.9), ("x", 0.9)])]
    df = spark.createDataFrame(rows, "src string, dst string, relation string, source string, confidence double, graph_index_id long, ordinal int")
    once = edges.reconciled(df)
    assert [r.ordinal for r in once.collect()] == [1]
    again = edges.reconciled(df.join(once.select("graph_index_id", "ordinal"), ["graph_index_id", "ordinal"]))
    assert once.collect() == again.collect()


def test_delta_modes(spark):
    same = spark.createDataFrame([("r", "main", "a", 1)], "repo_name string, branch string, path string, content_hash long")
    none = delta.counts(delta.changes(same, same))
    assert delta.strategies(none).first().mode == "NOOP"
    assert delta.strategies(none, fingerprint_changed=True).first().semantic == "ALL_CHUNKS"
    assert delta.strategies(none, toolchain_changed=True).first().scip == "FULL_REPO"
    assert delta.strategies(none, had_previous=False).first().mode == "FULL"
    other = same.withColumn("content_hash", F.lit(2).cast("long"))
    assert delta.strategies(delta.counts(delta.changes(same, other))).first().lexical == "DELTA_FILES"


def test_jobs(spark):
    rows = [(1, 9, "CLONE", "SUCCEEDED", 0), (2, 9, "SCIP", "FAILED", 0), (3, 9, "GRAPH_MERGE", "QUEUED", 0), (4, 9, "ACTIVATE", "QUEUED", 0), (5, 8, "CLONE", "RUNNING", 3), (6, 8, "SCIP", "QUEUED", 0)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "id long, job_id long, layer string, status string, attempt int, max_attempts int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    df = df.withColumns({c: F.lit(c) for c in ("workspace_id", "repo_id", "branch", "revision", "commit_hash")})
    assert [r.id for r in jobs.dispatchable(df).collect()] == [3]
    # an open clone of another revision is in nobody's way
    other = df.filter("id = 5").withColumns({"job_id": F.lit(9).cast("long"), "revision": F.lit("other"), "id": F.lit(7).cast("long")})
    assert [r.id for r in jobs.dispatchable(df.unionByName(other)).collect()] == [3]


def test_guard(spark):
    """One job of a branch at a time, under any of its names; one without a ref shuts all others out."""
    schema = "id long, repo_id long, ref string, created_at int"
    active = spark.createDataFrame([(1, 42, "main", 1), (2, 7, "", 1)], schema)
    asked = [(10, 42, "refs/heads/release-a", 2), (11, 42, "release-a", 3), (12, 42, "refs/heads/main", 4), (13, 42, None, 5), (14, 42, "refs/tags/main", 6), (20, 7, "x", 2), (30, 8, " ", 1), (31, 8, "x", 2), (40, 9, "x", 1), (41, 9, "", 2), (42, 9, "y", 3)]
    got = {r.id: (r.accepted, r.existing) for r in jobs.guarded(active, spark.createDataFrame(asked, schema)).collect()}
    assert got == {10: (True, None), 11: (False, 10), 12: (False, 1), 13: (False, 10), 14: (True, None), 20: (False, 2), 30: (True, None), 31: (False, 30), 40: (True, None), 41: (False, 40), 42: (True, None)}


def test_facts():
    go = list(extract.facts_of("a.go", "go", 'import "fmt"\nfunc Run() {\n\tfmt.Println(1)\n\tif (x) { Run(2) }\n}\nlater(1)'))
    assert [(f[3], f[4], f[7], f[10]) for f in go] == [("imports_from", "module:a.go", "module:fmt", 1), ("defines", "module:a.go", "function:a.go:Run", 2), ("calls", "function:a.go:Run", "function:?:fmt.Println", 3)]
    py = list(extract.facts_of("b.py", "python", "import y2\nfrom . import z\nclass D(E):\n    def f(self):\n        return g(1)\nh(2)"))
    assert [(f[3], f[8]) for f in py] == [("imports_from", "y2"), ("defines", "D"), ("extends", "E"), ("defines", "f"), ("calls", "g")]
    ts = list(extract.facts_of("c.ts", "typescript", "import { x } from './y'\nexport class A extends B implements C, D {\n}\nexport async function go(a) {\n  run(1)\n}"))
    assert [(f[3], f[8], f[9]) for f in ts] == [("imports_from", "./y", "module"), ("defines", "A", "class"), ("extends", "B", "class"), ("implements", "C", "interface"), ("implements", "D", "interface"), ("defines", "go", "function"), ("calls", "run", "function")]
    assert list(extract.facts_of("d.md", "docs", "func x() {")) == []


def test_callees():
    assert extract.callee_of("a  b") == "a b" and extract.callee_of("a'b") is None and extract.callee_of(" ") is None
    assert extract.callee_of("é" * 61) == "é" * 60 + "..."


def test_chat_context(spark):
    df = spark.createDataFrame([(1, t, "user" if t % 2 else " ", f"{t} " + "é" * 1000) for t in range(12)] + [(2, 0, "assistant", "  "), (3, 0, "assistant", " a "), (3, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.context for r in chat.context(df).collect()}
    lines = got[1].split("\n")
    assert lines[0] + "\n" == chat.OPENING and [x.split(" ")[1] for x in lines[1:9]] == [str(t) for t in range(4, 12)]
    assert lines[1].startswith("MESSAGE: 4 é") and lines[2].startswith("USER: 5 é") and lines[1].endswith(chat.CUT)
    assert len(lines[1].removeprefix("MESSAGE: ").removesuffix(chat.CUT).encode()) <= 1400
    assert got[2] == chat.OPENING.strip() and got[3] == chat.OPENING + "ASSISTANT: a"


def test_chat_anchors():
    said = "see `the code` in src/a/B.go and pkg/x.txt, ../up.go; FooBar.run is MAX_SIZE of the assistant, x.y, fooBar"
    assert chat.anchors_of(said) == ["src/a/B.go", "B.go", "x.txt", "up.go", "FooBar.run", "x.y", "MAX_SIZE", "FooBar", "the code"]
    assert chat.query_of(" q ", "") == "q" and chat.query_of("q", said).startswith("q" + chat.ANCHOR_OPENING + "- src/a/B.go\n")
    assert chat.query_of("x" * 3990, said).endswith(chat.CUT_ALL)


def test_read_limits(spark):
    files = spark.createDataFrame([("r", "main", "a", "x", "1\n2\n3")], "repo_name string, branch string, path string, lang string, content string")
    assert [r.content for r in lexical.read(files, "r", "a", 2, 1).collect()] == ["2"]
    with pytest.raises(ValueError):
        lexical.read(files, "r", "a", 0)


def test_stream_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = leases.counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "10000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT SUM(n) FROM counted").first()[0] == src.count()


def test_walk(spark, tmp_path):
    for path, body in (("a/x.go", "func F() {\n}\n"), ("a/node_modules/y.js", "function g() {}"), ("b.py", "def f():\n    g(1)\n"), ("c.txt", "x"), ("d.rb", "x" * 2000)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    got = walk.files(spark, str(tmp_path), bytes_=1000)
    assert sorted((r.path, r.language) for r in got.collect()) == [("a/x.go", "go"), ("b.py", "python")]
    assert [r.path for r in walk.files(spark, str(tmp_path), ["python"]).collect()] == ["b.py"]
    assert [r.path for r in walk.files(spark, str(tmp_path), most=1).collect()] == ["a/x.go"]
    assert extract.facts(got).filter("kind = 'defines'").count() == 2


def test_audit(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [("1", 1, "u", "READ", "t", at, {"a": "b"}), ("1", 1, "u", "READ", "t", at, {}), ("2", 0, "u", "READ", "t", at, {}), ("3", 2, " ", "READ", "t", at, None), (None, 1, "u", "x", None, at, None)]
    assert walk.append_audit(spark.createDataFrame(rows, walk.AUDIT), str(tmp_path / "audit")) == 3
    assert [(r.event_id, r.org_id) for r in spark.read.parquet(str(tmp_path / "audit")).collect()] == [("1", 1)]


def test_graph_sink_and_scope_delete(spark, tmp_path):
    rows = [(1, "w", r, "c", 1, "b", f"v{r}{i}") for r in (1, 2) for i in range(3)]
    v = spark.createDataFrame(rows, "org_id int, workspace_id string, repo_id int, commit_hash string, schema_version int, builder_version string, vid string")
    left = build.without_scope(v, v.filter("repo_id = 1"))
    assert {r.repo_id for r in left.collect()} == {2}
    build.write(v, v, str(tmp_path))
    build.write(v.filter("repo_id = 2 AND vid = 'v20'"), v.limit(0), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/vertices").groupBy("repo_id").count().orderBy("repo_id").collect() == [(1, 3), (2, 1)]


def test_text_helpers(spark):
    row = spark.range(1).select(*(text.is_reference(F.lit(x)).alias(f"r{i}") for i, x in enumerate(("main", "-x", "a b", "v1.0/x@y+z"))), text.cut_bytes(F.lit("aé😀b"), 3).alias("a"), text.cut_bytes(F.lit("aé😀b"), 6).alias("b"), text.cut_bytes(F.lit("aé😀b"), 8).alias("c")).first()
    assert tuple(row) == (True, False, False, True, "aé", "aé", "aé😀b")


def test_suffix_patterns():
    assert text.suffix_patterns(" a_b ") == [f"%{x}" for x in (r"/a\_b().", r"#a\_b().", r".a\_b().", r"a\_b().", r"/a\_b.", r"#a\_b.", r".a\_b.", r"a\_b.", r"/a\_b#", r"#a\_b#", r".a\_b#", r"a\_b#")]


def test_graph_tokens():
    assert question.tokens("Explain the flow of injectPython in node apps", 8) == ["NodeJS", "injectNodeJS", "Python", "injectPython", "node", "apps"]
    assert question.tokens("otel workloads", 8)[:4] == ["inject", "injectNodeJS", "injectPython", "injectDotNet"]


def test_scope_coverage(spark):
    repos = spark.createDataFrame([("a", "main", '{"indexedRevisions":["refs/heads/main"]}', 1, None, None), ("b", "main", "{}", None, None, None), ("c", "dev", '{"branches":["*"],"indexedRevisions":["refs/heads/x"]}', 1, None, None)], "name string, default_branch string, metadata string, indexed_at int, job_type string, job_status string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",), ("bad name",)], "repo_name string")
    got = {r.repo_name: (r.indexed, r.ref) for r in evidence.coverage(wanted, repos).collect()}
    assert got == {"a": (True, "refs/heads/main"), "b": (False, None), "c": (True, "refs/heads/x"), "zz": (False, None), "bad name": (False, None)}
    assert {r.repo_name for r in evidence.coverage(wanted, repos, "x").filter("indexed").collect()} == {"c"}
    with pytest.raises(ValueError):
        evidence.coverage(wanted, repos, "-bad")


def test_limits():
    assert policy.search_options(0, -1) == {"matches": 30, "context": 0, "most": 31} and policy.search_options(5000, 99) == {"matches": 1000, "context": 50, "most": 1001}
    assert policy.grep_limit(None) == 100 and policy.grep_limit(None, True) == 10_000 and policy.grep_limit(7) == 7
    with pytest.raises(ValueError):
        policy.grep_limit(0)


def test_lease_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, "claim", "w", at(0)), (1, "beat", "w", at(30)), (1, "done", "late", at(31)), (1, "done", "w", at(40)), (2, "claim", "w", at(0)), (2, "done", "w", at(500)), (2, "claim", "v", at(501)), (2, "fail", "v", at(502)), (3, "beat", "w", at(1))]
    spark.createDataFrame(rows, "id long, kind string, owner string, ts timestamp").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("id long, kind string, owner string, ts timestamp").parquet(str(tmp_path / "in"))
    q = leases.track(events, "1 second").writeStream.outputMode("append").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.id, r.status) for r in spark.sql("SELECT * FROM tracked ORDER BY id, at, attempt, status DESC").collect()]
    assert got == [(1, "CLAIMED"), (1, "RUNNING"), (1, "SUCCEEDED"), (2, "CLAIMED"), (2, "RETRYING"), (2, "CLAIMED"), (2, "RETRYING")]


def test_tree_limits_each_repository(spark):
    files = spark.createDataFrame([(f"r{r}", f"{c}/x.py") for r in range(3) for c in "Bac"], "repo_name string, path string")
    got = [(x.repo_name, x.entry) for x in lexical.tree(files, 2, 3).collect()]
    assert got == [(f"r{r}", e) for r in range(3) for e in ("a", "a/x.py", "B")]
    assert lexical.tree(files, 2, None).count() == 18


def test_a_small_table_of_sources_is_dealt_out(spark):
    files = spark.range(1000).selectExpr("concat('src/f', id, '.go') AS path").coalesce(1)
    dealt = build.dealt(files, 20)
    assert dealt.rdd.getNumPartitions() >= 50 and sorted(dealt.collect()) == sorted(files.collect())


def test_ends_join_the_rows_of_a_hop_alone(spark, monkeypatch):
    from quarry.sources.fixtures import Frames

    f, joined, with_ends = Frames(spark, "/root/testdata/sf0.001"), [], inspect.with_ends
    monkeypatch.setattr(inspect, "with_ends", lambda edges, vertices: joined.append(edges.count()) or with_ends(edges, vertices))
    rows = inspect.focused("callees", "Brand", edges=f.f_link, vertices=f.f_vertex, org_id=1, depth=2).count()
    assert rows and f.f_link.filter("org_id = 1").count() > 500 >= max(joined)


def test_every_anchor_link_is_kept(spark):
    n = 10_300
    edges = spark.range(n).selectExpr("CONCAT('a', id) AS src", "CONCAT('b', id) AS dst", "'CALLS' AS kind", "id AS rank", "0.6D AS confidence")
    marks = edges.selectExpr("EXPLODE(ARRAY(src, dst)) AS vid").selectExpr("vid", "vid AS normalized")
    assert build.anchor_links(edges, marks).select("src", "dst").distinct().count() == n
