"""Ranges, windows and the grep tool on small files."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import matches

FILES = [("r", "main", "src/héllo.go", "aé hit\nno\nhit hit\r\nx\n\nhit"), ("r", "dev", "src/b.go", "none"), ("s", "main", "lib/hit.py", "one\ntwo\nthree hit"), ("s", "main", "lib/empty.py", ""), ("s", "main", "lib/null.py", None)]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "repo_name string, branch string, path string, content string")


@pytest.fixture
def repos(spark):
    return spark.createDataFrame([("r", "main"), ("s", "main")], "repo_name string, default_branch string")


def plain(text, pattern):
    """Places of each match, counted by hand."""
    out = []
    for m in re.finditer(pattern, text or ""):
        def at(i):
            before = text[:i]
            return before.count("\n") + 1, i - (before.rfind("\n") + 1) + 1
        if m.end() > m.start():
            out.append((*at(m.start()), *at(m.end()), len(text[: m.start()].encode()), len(text[: m.end()].encode())))
    return out


@pytest.mark.parametrize("pattern", ("hit", "é", r"[a-z]+\n", r"t\nno\nh", "x|hit|two", r"\s+"))
def test_places(files, pattern):
    got = {}
    for r in matches.ranges(files, pattern).filter("NOT is_name").collect():
        got.setdefault((r.repo_name, r.branch, r.path), []).append((r.line, r.column, r.end_line, r.end_column, r.start_byte, r.end_byte))
    want = {f[:3]: p for f in FILES if (p := plain(f[3], pattern))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_names_are_ranges_of_their_own(files):
    named = [(r.path, r.line, r.column, r.end_column) for r in matches.ranges(files, "hit|llo").filter("is_name").orderBy("path").collect()]
    assert named == [("lib/hit.py", 1, 5, 8), ("src/héllo.go", 1, 7, 10)]


def test_nothing_has_no_ranges(files):
    with pytest.raises(ValueError):
        matches.ranges(files, "x*")


@pytest.mark.parametrize(("context", "want"), ((0, [(1, 1, 1, "1"), (3, 3, 2, "3"), (6, 6, 1, "6")]), (1, [(1, 4, 3, "1,3"), (5, 6, 1, "6")]), (2, [(1, 6, 4, "1,3,6")]), (99, [(1, 6, 4, "1,3,6")])))
def test_windows_merge_where_they_overlap(files, context, want):
    one = files.filter("repo_name = 'r'")
    got = matches.windows(one, matches.ranges(one, "hit"), context).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.matches, r.lines) for r in got] == want
    lines = FILES[0][3].split("\n")
    assert all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in got)


def test_grep(files, repos):
    got = {(r.path, r.line, r.text, r.exhaustive) for r in matches.grep(files, repos, "hit").collect()}
    assert got == {("src/héllo.go", 1, "aé hit", True), ("src/héllo.go", 3, "hit hit\r", True), ("src/héllo.go", 6, "hit", True), ("lib/hit.py", 3, "three hit", True)}
    assert {(r.path, r.line, r.exhaustive) for r in matches.grep(files, repos, "hit", 2).collect()} == {("src/héllo.go", 1, False), ("src/héllo.go", 3, False)}
    assert {r.path for r in matches.grep(files, repos, "hit", include="*.py").collect()} == {"lib/hit.py"}
    assert {(r.repo_name, r.matches, r.files) for r in matches.grep_totals(files, repos, "hit").collect()} == {("r", 4, 1), ("s", 1, 1)}
    assert matches.grep(files, repos, "none", repo="r").count() == 0 and matches.grep(files, repos, "none", repo="r", ref="refs/heads/dev").count() == 1
    wide = files.filter("repo_name = 's'").limit(1).withColumn("content", F.expr("concat(repeat('y', 2500), ' hit')")).withColumn("path", F.lit("w.py"))
    assert matches.grep(wide, repos, "hit").first().text == "y" * 2000 + "... (line truncated)"


def test_grep_refuses(files, repos):
    for bad in ({"pattern": ""}, {"pattern": "x", "repo": "r", "several": ("s",)}, {"pattern": "x", "ref": "dev"}, {"pattern": "x", "repo": "unknown"}, {"pattern": "x", "limit": 0}, {"pattern": "x", "several": ("a b",)}):
        with pytest.raises(ValueError):
            matches.grep(files, repos, **bad)


def test_globs():
    assert all(re.search(matches.included(g), p) for g, p in (("*.go", "a/b.go"), ("src/**/x", "src/a/b/x"), ("{a,b}.ts", "b.ts"), ("f?.c", "f1.c"), ("a+b", "a+b")))
    assert not any(re.search(matches.included(g), p) for g, p in (("^*.go$", "ago"), ("a/*.go$", "a/b.go"), ("{a,b}.ts", "c.ts"), ("f?.c", "f/.c")))
