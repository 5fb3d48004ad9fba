"""What a question's plan holds, and one scan for all of its recalls."""

import pytest

from quarry.operators import fused
from quarry.plans import recall


def test_terms():
    asked = """How does 'MAX_retry' in src/pkg/loader.go work with `x` and "plain words", e.g. Foo.bar?"""
    assert recall.code_terms(asked, 9) == ["MAX_retry", "loader"]
    assert recall.broad(asked) == "MAX_retry|loader" and recall.broad("  ") == "." and recall.broad("is it") == "is it"
    assert recall.symbols("where is the Foo.bar of a/b and foo.BAR or x-y", 9) == ["Foo.bar", "x-y"]
    assert recall.cleaned(["(Foo)", "foo", "ab", "the", "`Bar`"], 9) == ["Foo", "Bar"]
    assert [t for t in ("Foo", "foo", "abcde", "a/b", "a-b", "x_y", "inject", "the") if recall.looks_like_symbol(t)] == ["Foo", "abcde", "x_y", "inject"]


def test_plan_of_a_plain_question():
    p = recall.plan("Which callers reach LoadConfig twice?", 7)
    assert [r.source for r in p.recalls] == ["broad"] or [r.source for r in p.recalls][-1] == "broad"
    assert p.symbols[:2] == ["callers", "reach"] and p.graph_query == p.question and not p.tests and not p.preferred


def test_plan_of_the_vocabulary():
    p = recall.plan("How does auto-instrumentation inject the python sdk, with tests and helper bodies across repositories?", 50, compact=True)
    sources = [r.source for r in p.recalls]
    assert sources[0] == "focused" and sources[-1] == "broad" and {"implementation", "runtime-env", "annotation", "crd-spec", "runtime-side", "test"} <= set(sources)
    assert sources.count("runtime-env") == 3 and sources.count("runtime-side") == 2
    by = {r.source: r for r in p.recalls}
    assert by["implementation"].most == 30 and by["annotation"].most == 40 and by["test"].include == "*_test.go" and by["test"].pattern.startswith("TestInjectPythonSDK|")
    assert "inject" not in p.symbols and len(p.symbols) == 3 and p.symbols[0] == "injectPython"
    assert p.tests and p.bodies and p.across and "internal/instrumentation/python.go" in p.preferred and p.preferred[-1] == "_test.go"
    assert p.graph_query.startswith("architecture flow inject ")


@pytest.mark.parametrize("bad", (("", 5), ("x", 0), ("x", 101)))
def test_plan_refuses(bad):
    with pytest.raises(ValueError):
        recall.plan(*bad)


def test_recalls_share_a_scan(spark):
    files = spark.createDataFrame([("r", "main", f"f{i}.go", f"alpha {i}\nbeta\n  alpha beta  ") for i in range(4)] + [("r", "dev", "x_test.go", "beta"), ("r", "main", "no.go", "gamma"), ("r", "main", "null.go", None)], "repo_name string, branch string, path string, content string")
    recalls = [recall.Recall("one", "alpha", "", 3), recall.Recall("two", "beta", "*_test.go", 9), recall.Recall("three", "alpha.*beta|delta", "", 9)]
    df = fused.recalled(files, recalls)
    got = [(r.source, r.branch, r.path, r.line, r.text, r.place) for r in df.orderBy("nth", "place").collect()]
    assert got[:4] == [("one", "main", "f0.go", 1, "alpha 0", 1), ("one", "main", "f0.go", 3, "alpha beta", 2), ("one", "main", "f1.go", 1, "alpha 1", 3), ("two", "dev", "x_test.go", 1, "beta", 1)]
    assert [g[2] for g in got[4:]] == ["f0.go", "f1.go", "f2.go", "f3.go"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1
