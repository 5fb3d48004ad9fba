"""Evidence of an answer's texts on one small text."""

import pytest

from quarry.operators import harness

TEXT = """[r] src/a.go:
  12: precise scip grep
   7: x
[r] tests/b_test.go:
  3: y
- a --CALLS--> b
  A --calls--> B
x CALLS y source=tree-sitter source=scip
<!-- no --> edge
* - gap: Missing this
gap: missing THIS
see src/webhook/c.py, ../up.go and plain/none"""


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id long, text string")


def test_lists(texts):
    got = [(r.list, r.place, r.repo, r.path, r.line, r.role, r.source, r.value) for r in harness.evidence(texts).orderBy("list", "place").collect()]
    assert got == [
        ("edge", 1, None, None, None, None, None, "- a --CALLS--> b"), ("edge", 2, None, None, None, None, None, "A --calls--> B"), ("edge", 3, None, None, None, None, None, "x CALLS y source=tree-sitter source=scip"),
        ("gap", 1, None, None, None, None, None, "gap: Missing this"), ("modify", 1, "", "src/webhook/c.py", 0, "candidate-edit-touchpoint", "answer", None),
        ("read", 1, "r", "src/a.go", 0, "read-before-edit", "tool-output", None), ("read", 2, "r", "src/a.go", 12, "read-before-edit", "tool-output", None), ("read", 3, "r", "src/a.go", 7, "read-before-edit", "tool-output", None),
        ("read", 4, "", "src/a.go", 0, "read-before-edit", "answer", None), ("read", 5, "", "src/webhook/c.py", 0, "read-before-edit", "answer", None),
        ("test", 1, "r", "tests/b_test.go", 0, "test", "tool-output", None), ("test", 2, "r", "tests/b_test.go", 3, "test", "tool-output", None), ("test", 3, "", "tests/b_test.go", 0, "test", "answer", None),
    ]


@pytest.mark.parametrize("cuts", [range(1, 12), (1, 3, 4, 10), (2,)])
def test_parts_say_what_a_text_says(spark, texts, cuts):
    """A header in one part also counts for the numbered lines of later ones."""
    lines = TEXT.split("\n")
    ends = [0, *cuts, len(lines)]
    rows = [(1, i, "\n".join(lines[a:b])) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    parts = spark.createDataFrame([*rows[::-1], (2, 0, None), (3, 0, "")], "id long, part int, text string")
    assert sorted(harness.evidence(parts).collect(), key=str) == sorted(harness.evidence(texts).collect(), key=str)
    assert sorted(harness.provenance(harness.lines(parts)).collect()) == sorted(harness.provenance(harness.lines(texts)).collect())


def test_classes(texts):
    got = {r.id: (r.scip, r.tree_sitter, r.zoekt, r.graph, r.confidence) for r in harness.provenance(harness.lines(texts)).collect()}
    assert got == {1: (2, 0, 1, 3, harness.SURE), 2: (0, 0, 0, 0, harness.UNSURE), 3: (0, 0, 0, 0, harness.UNSURE)}


def test_caps(spark):
    many = "\n".join(f"[r] p{i}/f.go:\n  1: x\n- e{i} --> f\n- gap {i}" for i in range(60))
    counts = {r.list: r["count"] for r in harness.evidence(spark.createDataFrame([(1, many)], "id long, text string")).groupBy("list").count().collect()}
    assert counts == {"read": 32, "edge": 24, "gap": 16}


def test_budgets():
    assert harness.budget() == {"tokens": 12_000, "bytes": 256_000} and harness.budget(" Brief ") == {"tokens": 3000, "bytes": 64_000} and harness.budget("") == harness.budget("full")
    with pytest.raises(ValueError):
        harness.budget("huge")
