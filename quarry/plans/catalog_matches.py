"""Named queries on match ranges, windows of lines and the grep tool."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import matches, symbols
from quarry.plans.catalog import ORG, _occurrences, query

PATTERN = "fr/d[0-9]*7|mail[0-9]+[.]|[Ll]icen[a-z]+|https?://[a-z]+"
_HITS = f"regexp_extract_all({{0}}, '{PATTERN}')"
_GAPS = f"string_split_regex({{0}}, '{PATTERN}')"
_BEFORE = "CONCAT(array_to_string(gaps[1:i], ''), array_to_string(hits[1:i - 1], ''))"
LINE_ROWS = "SELECT repo_name, branch, path, UNNEST(s) AS body, generate_subscripts(s, 1) AS line FROM (SELECT *, string_split(content, chr(10)) AS s FROM f_file) f"
RANGES = f"""SELECT repo_name, branch, path, is_name, line, LENGTH({_BEFORE}) + 1 AS "column", line AS end_line, LENGTH({_BEFORE}) + 1 + LENGTH(hits[i]) AS end_column, CAST(base + strlen({_BEFORE}) AS BIGINT) AS start_byte, CAST(base + strlen({_BEFORE}) + strlen(hits[i]) AS BIGINT) AS end_byte
FROM (SELECT *, UNNEST(range(1, len(hits) + 1)) AS i FROM (
SELECT repo_name, branch, path, FALSE AS is_name, line, base, {_HITS.format('body')} AS hits, {_GAPS.format('body')} AS gaps FROM (SELECT *, SUM(strlen(body) + 1) OVER (PARTITION BY repo_name, branch, path ORDER BY line) - strlen(body) - 1 AS base FROM ({LINE_ROWS}) l) m
UNION ALL SELECT repo_name, branch, path, TRUE, 1, 0, {_HITS.format('path')}, {_GAPS.format('path')} FROM f_file) h) e"""
_SHOWN = "CASE WHEN strlen(body) <= 2000 THEN body ELSE CONCAT(SUBSTR(body, 1, 2000), '... (line truncated)') END"


def _windows(context: int) -> str:
    return f"""WITH r AS ({RANGES}), h AS (SELECT repo_name, branch, path, line, COUNT(*) AS n FROM r WHERE NOT is_name GROUP BY ALL),
i AS (SELECT *, SUM(CASE WHEN before IS NULL OR before + {context} < line - {context} THEN 1 ELSE 0 END) OVER (PARTITION BY repo_name, branch, path ORDER BY line) AS chunk FROM (SELECT *, LAG(line) OVER (PARTITION BY repo_name, branch, path ORDER BY line) AS before FROM h) x),
c AS (SELECT repo_name, branch, path, CAST(chunk AS BIGINT) AS chunk, MIN(line) AS first, MAX(line) AS last, CAST(SUM(n) AS BIGINT) AS matches, STRING_AGG(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM i GROUP BY 1, 2, 3, 4)
SELECT c.repo_name, c.branch, c.path, chunk, GREATEST(1, first - {context}) AS start_line, LEAST(len(s), last + {context}) AS end_line, array_to_string(s[GREATEST(1, first - {context}):LEAST(len(s), last + {context})], chr(10)) AS content, matches, lines
FROM c JOIN (SELECT repo_name, branch, path, string_split(content, chr(10)) AS s FROM f_file) f ON f.repo_name = c.repo_name AND f.branch = c.branch AND f.path = c.path"""


def _scoped(where: str, most: int) -> str:
    """The first matches of files in a scope."""
    return f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY repo_name, branch, path, is_name DESC, line, "column") AS place, COUNT(*) OVER () <= {most} AS exhaustive FROM ({RANGES}) r WHERE {where}) x WHERE place <= {most}"""


@query("match_ranges", RANGES)
def _(f):
    return matches.ranges(f.f_file, PATTERN)


@query("match_windows", _windows(3))
def _(f):
    return matches.windows(f.f_file, matches.ranges(f.f_file, PATTERN), 3)


@query("match_totals", f"SELECT repo_name, COUNT(*) FILTER (NOT is_name) AS matches, COUNT(DISTINCT CONCAT(branch, chr(0), path)) AS files FROM ({RANGES}) r GROUP BY repo_name")
def _(f):
    return matches.totals(matches.ranges(f.f_file, PATTERN))


#: The organization's repositories as files name them, with their default branches.
REPOS = "SELECT DISTINCT repo_name, CASE WHEN repo_name LIKE '%1' THEN 'release' ELSE 'main' END AS default_branch FROM f_file"
DEFAULT = "branch = CASE WHEN repo_name LIKE '%1' THEN 'release' ELSE 'main' END"


def _repos(f):
    return f.f_file.select("repo_name", F.when(F.col("repo_name").endswith("1"), "release").otherwise("main").alias("default_branch")).distinct()


@query("grep_tool", f"""SELECT DISTINCT g.repo_name, g.branch, g.path, l.line, {_SHOWN} AS text, g.exhaustive FROM ({_scoped(DEFAULT + " AND regexp_matches(path, '[^/]*[.]py') AND contains(path, 'src/')", 100)}) g
JOIN ({LINE_ROWS}) l ON l.repo_name = g.repo_name AND l.branch = g.branch AND l.path = g.path AND l.line = g.line AND NOT g.is_name""")
def _(f):
    return matches.grep(f.f_file, _repos(f), PATTERN, path="src/", include="*.py")


@query("grep_tool_ref", f"""SELECT DISTINCT g.repo_name, g.branch, g.path, l.line, {_SHOWN} AS text, g.exhaustive FROM ({_scoped("branch = 'release' AND repo_name IN ('src1', 'src2', 'src3')", 40)}) g
JOIN ({LINE_ROWS}) l ON l.repo_name = g.repo_name AND l.branch = g.branch AND l.path = g.path AND l.line = g.line AND NOT g.is_name""")
def _(f):
    return matches.grep(f.f_file, _repos(f), PATTERN, 40, several=("src1", " src2", "src3"), ref="refs/heads/release")


@query("grep_tool_totals", f"SELECT repo_name, COUNT(*) FILTER (NOT is_name) AS matches, COUNT(DISTINCT CONCAT(branch, chr(0), path)) AS files FROM ({_scoped(DEFAULT, 10000)}) g GROUP BY repo_name")
def _(f):
    return matches.grep_totals(f.f_file, _repos(f), PATTERN)


def _lexical(pattern: str, most: int) -> str:
    return f"""SELECT DISTINCT 'lexical' AS evidence, g.repo_name, g.path, CAST(l.line AS BIGINT) AS line, {_SHOWN} AS text FROM ({_scoped(DEFAULT, most).replace(PATTERN, pattern)}) g
JOIN ({LINE_ROWS}) l ON l.repo_name = g.repo_name AND l.branch = g.branch AND l.path = g.path AND l.line = g.line AND NOT g.is_name"""


def _tool(f, roles, **of):
    precise = symbols.occurrences(f.f_symbol, f.f_occurrence, f.f_index, f.f_repo, ORG, "ring", roles, **of)
    return symbols.tool(precise, f.f_file, _repos(f), "ring", 20)


_PRECISE = "SELECT 'precise' AS evidence, repo_name, file_path AS path, CAST(start_line + 1 AS BIGINT) AS line, symbol AS text FROM ({0}) p"


@query("find_symbol_definitions", f"{_PRECISE.format(_occurrences("'DEFINITION'").replace('cold ring', 'ring'))} UNION ALL {_lexical('ring', 20)}")
def _(f):
    return _tool(f, ["DEFINITION"])


@query("find_symbol_references", f"{_PRECISE.format(_occurrences("'REFERENCE'").replace('cold ring', 'ring').replace('WHERE s.org_id = 1', "WHERE s.org_id = 1 AND s.file_path = 'internal/promo/file47.go'"))} UNION ALL {_lexical('ring', 20)}")
def _(f):
    return _tool(f, ["REFERENCE"], definition_file="internal/promo/file47.go")
