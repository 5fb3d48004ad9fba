"""Named queries on the evidence of an answer's texts; the texts are made of the files, one for each repository and branch, and come in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import harness
from quarry.plans.catalog import query

#: What one file adds to its text.
ENTRY = """CONCAT('[', repo_name, '] ', path, ':', CHR(10), '  ', CAST(doc_id % 50 + 1 AS VARCHAR(10)), ': grep hit', CHR(10), CASE doc_id % 6 WHEN 0 THEN CONCAT('- a', CAST(doc_id % 20 AS VARCHAR(10)), ' --CALLS--> B source=scip') WHEN 1 THEN CONCAT('x', CAST(doc_id % 4 AS VARCHAR(10)), ' REFERENCES y source=tree-sitter heuristic')
WHEN 2 THEN CONCAT(' - * Missing webhook part ', CAST(doc_id % 9 AS VARCHAR(10))) WHEN 3 THEN CONCAT('see webhook/crd', CAST(doc_id % 3 AS VARCHAR(10)), '/Main.go, and a/../b.py') WHEN 4 THEN '<!-- a --> source=ast graph' ELSE 'No Precise rows' END)"""
TEXTS = f"SELECT CASE branch WHEN 'main' THEN 0 ELSE 1000 END + CAST(SUBSTR(repo_name, 4) AS BIGINT) AS id, doc_id, {ENTRY} AS entry FROM f_file"
WHOLE = f"SELECT id, STRING_AGG(entry, chr(10) ORDER BY doc_id) AS text FROM ({TEXTS}) e GROUP BY id"
ROWS = f"SELECT id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({WHOLE}) w"
LOW = "LOWER(line)"


def _texts(f):
    """Each file's entry is a part of its text."""
    return f.f_file.select(F.expr("CASE branch WHEN 'main' THEN 0 ELSE 1000 END + CAST(SUBSTR(repo_name, 4) AS BIGINT)").alias("id"), F.struct("doc_id", "path").alias("part"), F.expr(ENTRY).alias("text"))


SCIP, TREE, AST = "contains(l, 'source=scip')", "contains(l, 'tree-sitter')", "contains(l, 'source=ast')"


@query(
    "evidence_provenance",
    f"""SELECT *, CASE WHEN scip > 0 AND graph > 0 AND zoekt > 0 THEN 'mixed-high-when-file-lines-match; verify heuristic graph edges' WHEN zoekt > 0 THEN 'lexical-plus-partial-structure' ELSE 'insufficient-evidence' END AS confidence FROM (SELECT id, COUNT(*) FILTER ({SCIP}) AS scip, COUNT(*) FILTER ({TREE} AND NOT {SCIP}) AS tree_sitter, COUNT(*) FILTER ({AST} AND NOT {SCIP} AND NOT {TREE}) AS ast,
COUNT(*) FILTER (contains(l, 'zoekt') OR contains(l, 'grep')) AS zoekt, COUNT(*) FILTER (contains(l, 'heuristic') OR contains(l, 'confidence=0.6')) AS heuristic, COUNT(*) FILTER (contains(l, 'graph') OR contains(line, '-->')) AS graph FROM (SELECT *, {LOW} AS l FROM ({ROWS}) r) r GROUP BY id) c""",
)
def _(f):
    return harness.provenance(harness.lines(_texts(f)))


#: Each file stands as a header, as a line, and in the answer, in the order of entries; the paths of entries are those of the table.
NAMED = f"""SELECT e.id, e.doc_id * 10 AS pos, repo_name AS repo, path, 0 AS line, 'tool-output' AS source FROM ({TEXTS}) e JOIN f_file f ON f.doc_id = e.doc_id UNION ALL SELECT e.id, e.doc_id * 10 + 1, repo_name, path, CAST(e.doc_id % 50 + 1 AS INT), 'tool-output' FROM ({TEXTS}) e JOIN f_file f ON f.doc_id = e.doc_id
UNION ALL SELECT e.id, 1000000000 + e.doc_id * 10, '', path, 0, 'answer' FROM ({TEXTS}) e JOIN f_file f ON f.doc_id = e.doc_id WHERE NOT path LIKE '%.txt' UNION ALL SELECT id, 1000000000 + doc_id * 10 + 1, '', CONCAT('webhook/crd', doc_id % 3, '/Main.go'), 0, 'answer' FROM ({TEXTS}) e WHERE doc_id % 6 = 3"""
FOUND = f"SELECT * FROM (SELECT id, repo, path, line, MIN(pos) AS pos, arg_min(source, pos) AS source FROM ({NAMED}) n GROUP BY ALL) g QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY pos) <= 80"
IS_TEST = "(contains(path, '_test.') OR contains(path, '/test/') OR contains(path, '/tests/'))"
TOUCHED = "regexp_matches(LOWER(path), 'touchpoint|definition|implementation|runtime|crd|webhook')"


def _files(name: str, keep: str, role: str, most: int) -> str:
    return f"SELECT id, '{name}' AS list, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY pos) AS INT) AS place, repo, path, line, '{role}' AS role, source, NULL AS value FROM ({FOUND}) f WHERE {keep} QUALIFY place <= {most}"


def _lines(name: str, value: str, hit: str, most: int) -> str:
    return f"SELECT id, '{name}' AS list, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY pos) AS INT) AS place, NULL AS repo, NULL AS path, NULL AS line, NULL AS role, NULL AS source, value FROM (SELECT id, MIN(pos) AS pos, arg_min(v, pos) AS value FROM (SELECT id, pos, {value} AS v FROM ({ROWS}) r) x WHERE v <> '' AND {hit} GROUP BY id, LOWER(v)) m QUALIFY place <= {most}"


LISTS = " UNION ALL ".join(
    f"({x})" for x in (
        _files("read", f"NOT {IS_TEST}", "read-before-edit", 32), _files("modify", f"NOT {IS_TEST} AND {TOUCHED}", "candidate-edit-touchpoint", 16), _files("test", IS_TEST, "test", 12),
        _lines("edge", "TRIM(line)", "(contains(v, '-->') OR contains(v, ' CALLS ') OR contains(v, ' REFERENCES ')) AND NOT starts_with(v, '<!--')", 24),
        _lines("gap", "TRIM(LTRIM(line, '-* '))", "regexp_matches(LOWER(v), 'gap|missing|insufficient|no precise')", 16),
    )
)


@query("harness_evidence", LISTS)
def _(f):
    return harness.evidence(_texts(f))
