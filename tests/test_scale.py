"""What must not grow with the tables: rows of a task, and the length of a method that the JVM has to compile."""

from __future__ import annotations

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import inspect
from quarry.sources import fixtures

SMALL = "/root/testdata/sf0.001"
TERMS = ["Python", "golang", "java", "volume mount", "s7", "Supplier"]


def test_score_is_compiled(spark):
    """Methods of more than 8000 bytes are interpreted."""
    f = fixtures.Frames(spark, SMALL)
    rows = spark.createDataFrame(spark.sparkContext.emptyRDD(), inspect.with_ends(f.f_link, f.f_vertex).schema)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        inspect.scored(rows, TERMS).select("score").explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())), default=0) < 8000


def test_marks_across_texts(spark):
    """A mark with a blank may begin in one text and end in another."""
    ends = "repo_id int, kind string, key string, label string, path string, vid string"
    vertices = spark.createDataFrame([(1, "class", "a", "b", "volume", "x"), (2, "mount", "k", "java", "p", "y"), (3, "go", "", "", "", "z")], ends)
    edge = "src string, dst string, relation string, source string, provenance string, context string, evidence_path string, confidence double"
    edges = spark.createDataFrame([(s, d, "IMPORTS", "scip", None, None, "q", 0.9) for s in "xyzn" for d in "xyzn"], edge)
    weighed = inspect.scored(inspect.with_ends(edges, inspect.weighed(vertices, TERMS)), TERMS)
    plain = inspect.scored(inspect.with_ends(edges, vertices), TERMS)
    columns = ["src", "dst", "score"]
    assert sorted(weighed.select(columns).collect()) == sorted(plain.select(columns).collect())
    told = inspect.told(inspect.with_ends(edges, inspect.weighed(vertices, [])))
    said = told.select("src", "dst", *(inspect.marked(F.col("marks"), n).alias(n) for n in ("core", "topic java", "language go"))).collect()
    assert {(r[0], r[1]) for r in said if r[2]} == {("x", "y")}
    assert {(r[0], r[1]) for r in said if r[3]} == {(s, d) for s in "xyzn" for d in "xyzn" if "y" in (s, d)}
    assert {(r[0], r[1]) for r in said if r[4]} == {(s, d) for s in "xyzn" for d in "xyzn" if "z" in (s, d)}


def test_lines_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TOGETHER", 100)
    f = fixtures.Frames(spark, SMALL)
    sizes = f.f_edge.groupBy(F.spark_partition_id()).count().select(F.sum("count"), F.max("count")).first()
    assert sizes[0] == f.lines and sizes[1] <= 300


def test_lines_are_dealt_by_rows_where_nothing_is_broadcast(spark, monkeypatch, request):
    monkeypatch.setattr(fixtures, "TOGETHER", 100)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    f = fixtures.Frames(spark, SMALL)
    sizes = f.f_occurrence.groupBy(F.spark_partition_id()).count().select(F.sum("count"), F.max("count")).first()
    assert sizes[0] == f.lines and sizes[1] <= 300


def test_short_rows_move_to_ends(spark, monkeypatch):
    moved, with_ends = [], inspect.with_ends
    monkeypatch.setattr(inspect, "with_ends", lambda edges, vertices: moved.append(edges.columns) or with_ends(edges, vertices))
    registry.queries()["stable_key"](spark, SMALL)
    assert [len(c) for c in moved] == [7]


def test_texts_of_answers_stay_in_parts(spark):
    """No task gathers a text: of a text's rows only a list's first ones and last headers meet."""
    plan = registry.queries()["harness_evidence"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "hashpartitioning(id" in plan


def moved(node) -> list[tuple[str, list[str]]]:
    """How each exchange of a plan deals its rows, and the types that they hold."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return moved(node.executedPlan())
    below = [x for i in range(node.children().size()) for x in moved(node.children().apply(i))]
    if node.nodeName() != "Exchange":
        return below
    held = [node.output().apply(i) for i in range(node.output().size())]
    return [(node.outputPartitioning().toString(), [f"{c.name()} {c.dataType().simpleString()}" for c in held]), *below]


def test_numbers_move_to_ends(spark, request):
    """An edge's texts do not move to its ends, nor those of one end to the other."""
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("edge_score", "edge_score_no_language"):
        plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan()
        edges = [kinds for by, kinds in moved(plan) if re.match(r"hashpartitioning\((src|dst)#", by) and any(k.startswith("graph_index_id ") for k in kinds)]
        assert len(edges) == 2 and {k for kinds in edges for k in kinds if k.endswith(" string")} == {"src string", "dst string"}


def test_numbers_of_ends_are_compiled(spark):
    f = fixtures.Frames(spark, SMALL)
    none = lambda df: spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        inspect.met(none(f.f_link), none(f.f_vertex), TERMS, ["ordinal"]).select(inspect.total(TERMS)).explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())), default=0) < 8000


def test_total_as_scored(spark):
    """Marks that lie across texts are found by how texts begin and end; what is missing counts as it does in the text."""
    assert all(m.count(" ") <= len(inspect.END_FIELDS) for group in inspect.groups().values() for m in group)
    r = random.Random(4)
    pieces = ["", "", None, " go", "go", "go ", "volume", "mount", " mount", "java", "javascript", "x java", "volume mount", "python", "fmt.", "webhook", " npm ", "local 3", "symbol"]
    vertices = spark.createDataFrame([(r.randint(1, 2) if i % 5 else None, *r.choices(pieces, k=4), f"v{i}") for i in range(60)], "repo_id int, kind string, key string, label string, path string, vid string")
    some = lambda: f"v{r.randint(0, 70)}" if r.random() < 0.95 else None
    edge = "n int, src string, dst string, relation string, source string, provenance string, context string, evidence_path string, confidence double"
    edges = spark.createDataFrame([(i, some(), some(), r.choice(["IMPORTS", "calls", "CONTAINS", None]), r.choice(["scip", "heuristic", None]), r.choice([None, " ", "scip"]), *r.choices(pieces, k=2), r.choice([None, 0.45, 0.9])) for i in range(1500)], edge)
    for terms in (TERMS, ["go"], ["mount", "node"], [" ", "x"], []):
        got = inspect.met(edges, vertices, terms, ["n"]).select("n", inspect.total(terms).alias("score"))
        assert sorted(got.collect()) == sorted(inspect.scored(inspect.with_ends(edges, vertices), terms).select("n", "score").collect())
    told = inspect.told(inspect.with_ends(edges, inspect.weighed(vertices, []))).select("n", "marks")
    assert sorted(told.collect()) == sorted(inspect.met(edges, vertices, [], ["n"]).select("n", F.col("marks").bitwiseAND((1 << inspect.ENDING) - 1)).collect())
