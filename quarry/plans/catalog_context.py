"""Named queries on the fused context of a question. The SQL states patterns, limits and scores by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import fused, matches, symbols
from quarry.plans import recall
from quarry.plans.catalog import LATEST, ORG, query
from quarry.plans.catalog_matches import LINE_ROWS, DEFAULT, _repos

QUESTION = "How does the Rod webhook read https mail settings across the architecture of repositories?"
LIMIT = 10
#: What the question's plan must be, stated by hand: (source, pattern, paths).
RECALLS = (
    ("focused", "webhook|admission|mutate|Rod|https|mail|settings|across|repositories", "TRUE"),
    ("webhook", "NewWebhookHandler|type PodMutator|podmutation.PodMutator|instPodMutator|languageInstrumentations|func NewMutator|GetWebhookServer|mutate-v1-pod|internal/webhook/podmutation", "regexp_matches(path, '[^/]*[.]go')"),
    ("broad", "Rod|webhook|https|mail|settings|across|repositories", "TRUE"),
)
PROBES = ("webhook", "admission", "mutate", "Rod", "https")
TERMS = ("webhook", "admission", "mutate", "Rod", "https", "mail", "settings", "across", "repositories")


def _one(nth: int, source: str, pattern: str, paths: str) -> str:
    return f"""SELECT {nth} AS nth, '{source}' AS source, repo_name, branch, path, line, TRIM(body, ' ') AS text, CAST(ROW_NUMBER() OVER (PARTITION BY branch ORDER BY repo_name, path, line) AS INT) AS place
FROM ({LINE_ROWS}) l{nth} WHERE {DEFAULT} AND {paths} AND regexp_matches(body, '{pattern}') QUALIFY place <= {LIMIT}"""


RECALLED = " UNION ALL ".join(f"({_one(i, *r)})" for i, r in enumerate(RECALLS))


def _probe(nth: int, name: str) -> str:
    low = name.lower()
    ends = " OR ".join(f"LOWER(s.symbol) LIKE '%{before}{low}{after}'" for after in ("().", ".", "#") for before in ("/", "#", ".", ""))
    return f"""SELECT {nth} AS probe, s.repo_id, r.name AS repo_name, s.index_id, c.revision, s.symbol, s.display_name, c.seen, CASE WHEN LOWER(s.display_name) = '{low}' THEN 0 WHEN LOWER(s.symbol) = '{low}' THEN 1 ELSE 2 END AS match_rank
FROM f_symbol s JOIN (SELECT id AS index_id, revision, COALESCE(indexed_at, updated_at) AS seen FROM ({LATEST}) z WHERE org_id = {ORG}) c ON c.index_id = s.index_id JOIN f_repo r ON r.id = s.repo_id AND r.org_id = s.org_id
WHERE s.org_id = {ORG} AND (LOWER(s.display_name) = '{low}' OR LOWER(s.symbol) = '{low}' OR {ends})
QUALIFY ROW_NUMBER() OVER (ORDER BY match_rank, c.seen DESC NULLS LAST, r.name, s.display_name, s.symbol, s.index_id) <= 128"""


PROBED = f"""SELECT m.probe, o.role, CAST(ROW_NUMBER() OVER (PARTITION BY m.probe, o.role ORDER BY m.match_rank, m.seen DESC NULLS LAST, m.repo_name, o.file_path, o.start_line, m.symbol, m.index_id, o.ordinal) AS INT) AS place,
m.repo_id, m.repo_name, m.index_id, m.revision, m.symbol, m.display_name, o.file_path, o.start_line, m.match_rank FROM ({" UNION ALL ".join(f"({_probe(i, n)})" for i, n in enumerate(PROBES))}) m
JOIN f_occurrence o ON o.index_id = m.index_id AND o.symbol = m.symbol AND o.repo_id = m.repo_id AND o.org_id = {ORG} AND o.role IN ('DEFINITION', 'REFERENCE') QUALIFY place <= 16"""
BASE = """10 + CASE source WHEN 'scip-definition' THEN 105 WHEN 'webhook' THEN 90 WHEN 'focused' THEN 70 ELSE 0 END - CASE WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN 10 ELSE 0 END + CASE WHEN contains(path, '/internal/') OR contains(path, '/cmd/') THEN 10 ELSE 0 END
+ CASE WHEN contains(path, 'podmutator') OR contains(path, 'webhook') OR contains(path, 'sdk.go') THEN 8 ELSE 0 END - CASE WHEN line <= 5 THEN 10 ELSE 0 END - CASE WHEN contains(path, '_test.') THEN 35 ELSE 0 END"""
CANDIDATES = f"""SELECT source, repo_name, branch, path, line FROM ({RECALLED}) f UNION ALL SELECT 'scip-definition', repo_name, revision, file_path, start_line + 1 FROM ({PROBED}) p WHERE role = 'DEFINITION'"""
SELECTED = f"""SELECT * FROM (SELECT repo_name, branch, path, line, source, score FROM (SELECT *, {BASE} AS score FROM ({CANDIDATES}) c WHERE NOT regexp_matches(path, '/(vendor|node_modules|dist)/')) s
QUALIFY ROW_NUMBER() OVER (PARTITION BY repo_name, path, line // 80 ORDER BY score DESC, line, source, branch) = 1) b ORDER BY score DESC, repo_name, path, line, source LIMIT 72"""
CHOSEN = f"""SELECT repo_name, branch, path, line, source, CAST(score AS INT) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_name, path ORDER BY phase, rank) AS of_path FROM (SELECT *, CASE WHEN rank = MIN(rank) OVER (PARTITION BY repo_name) AND repos > 1 THEN 1 ELSE 3 END AS phase
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, path, line, repo_name, source) AS rank, (SELECT COUNT(DISTINCT repo_name) FROM ({SELECTED}) n) AS repos FROM ({SELECTED}) s) r) p) q WHERE of_path <= 3 ORDER BY phase, rank LIMIT 12"""


def _plan():
    return recall.plan(QUESTION, LIMIT)


def _files(f):
    return matches.scoped(f.f_file, _repos(f))


def _probed(f):
    return symbols.probed(f.f_symbol, f.f_occurrence, f.f_index, f.f_repo, ORG, _plan().symbols, recall.PROBE[0])


def _named(rows, role):
    return rows.filter(F.col("role") == role).select("repo_name", F.col("revision").alias("branch"), F.col("file_path").alias("path"), (F.col("start_line") + 1).alias("line"), F.col("symbol").alias("name"))


@query("recalled_lines", RECALLED)
def _(f):
    return fused.recalled(_files(f), _plan().recalls)


@query("probed_symbols", PROBED)
def _(f):
    return _probed(f)


@query("context_slices", CHOSEN)
def _(f):
    plan = _plan()
    found = fused.scored(fused.recalled(_files(f), plan.recalls)).unionByName(fused.from_definitions(plan, _named(_probed(f), "DEFINITION")))
    return fused.chosen_slices(plan, found)


SEARCHED = "LOWER(CONCAT_WS(' ', COALESCE(src, ''), COALESCE(dst, ''), COALESCE(relation, ''), COALESCE(source_file, ''), COALESCE(evidence, ''), COALESCE(rationale, '')))"


def _graph_sql(most: int) -> str:
    """Ranked edges of the question's terms: the statement of ``relation_rank`` with these terms."""
    from quarry.plans.catalog import EDGES

    some = " OR ".join(f"searched LIKE '%{t.lower()}%'" for t in TERMS)
    hits = " + ".join(f"CASE WHEN searched LIKE '%{t.lower()}%' THEN {len(t)} ELSE 0 END" for t in TERMS)
    sql = EDGES.replace("CASE WHEN searched LIKE '%part:1%' THEN 6 ELSE 0 END + CASE WHEN searched LIKE '%s7%' THEN 2 ELSE 0 END", hits).replace("searched LIKE '%part:1%' OR searched LIKE '%s7%'", some)
    # quotas of a limit of 10
    return sql.replace("LIMIT 40", f"LIMIT {most}").replace("IN ('CALLS', 'REFERENCES') THEN 20 WHEN relation IN ('IMPORTS', 'IMPORTS_FROM') THEN 5 ELSE 10 END", "IN ('CALLS', 'REFERENCES') THEN 8 WHEN relation IN ('IMPORTS', 'IMPORTS_FROM') THEN 3 ELSE 4 END")


GRAPH = f"""SELECT CAST(repo_id AS VARCHAR) AS repo_name, CONCAT(LPAD(CAST(graph_index_id AS VARCHAR), 20, '0'), ':', LPAD(CAST(ordinal AS VARCHAR), 10, '0')) AS id, score, producer,
CONCAT(src, ' --', relation, '--> ', dst, ' source=', CASE producer WHEN 'scip' THEN 'scip' WHEN 'ast' THEN 'ast-' ELSE 'heuristic' END) AS text FROM ({_graph_sql(LIMIT)}) g"""
SCIP_SCORE = "50 + CASE WHEN contains(LOWER(text), '--calls-->') THEN 40 ELSE 0 END + CASE WHEN contains(LOWER(text), '--references-->') THEN 25 ELSE 0 END"
AST_SCORE = "15 + CASE WHEN contains(LOWER(text), '--calls-->') THEN 20 ELSE 0 END + CASE WHEN contains(LOWER(text), 'webhook') THEN 8 ELSE 0 END"
CONTEXT = f"""SELECT CONCAT('recall ', source) AS layer, repo_name, path, CAST(line AS BIGINT) AS line, CAST(NULL AS BIGINT) AS score, text FROM ({RECALLED}) r
UNION ALL SELECT 'slice', s.repo_name, s.path, s.line, s.score, array_to_string(f.lines[CASE WHEN s.line <= 20 THEN 1 ELSE s.line - 20 END:CASE WHEN s.line <= 20 THEN 1 ELSE s.line - 20 END + 179], chr(10)) FROM ({CHOSEN}) s LEFT JOIN (SELECT repo_name, branch, path, string_split(content, chr(10)) AS lines FROM f_file) f ON f.repo_name = s.repo_name AND f.branch = s.branch AND f.path = s.path
UNION ALL SELECT LOWER(role), repo_name, file_path, start_line + 1, NULL, symbol FROM ({PROBED}) p
UNION ALL SELECT 'graph', repo_name, NULL, NULL, score, text FROM ({GRAPH}) g
UNION ALL SELECT 'scip proof', repo_name, NULL, NULL, s, text FROM (SELECT *, {SCIP_SCORE} AS s FROM ({GRAPH}) g WHERE producer = 'scip' ORDER BY s DESC, id LIMIT 3) a
UNION ALL SELECT 'ast proof', repo_name, NULL, NULL, s, text FROM (SELECT *, {AST_SCORE} AS s FROM ({GRAPH}) g WHERE producer = 'ast' ORDER BY s DESC, id LIMIT 3) b
UNION ALL SELECT 'manifest', NULL, NULL, NULL, NULL, CONCAT('graph=', CASE WHEN COUNT(*) FILTER (producer = 'scip') > 0 THEN 'native' WHEN COUNT(*) FILTER (producer = 'ast') > 0 THEN 'heuristic' WHEN COUNT(*) > 0 THEN 'any' ELSE 'none' END, ' scip=', CASE WHEN (SELECT COUNT(*) FROM ({PROBED}) p WHERE role = 'DEFINITION') > 0 THEN 'precise' ELSE 'missing' END,
' ast=', CASE WHEN COUNT(*) FILTER (producer = 'ast') > 0 THEN 'true' ELSE 'false' END, ' failed=', CASE WHEN COUNT(*) FILTER (producer = 'ast') = 0 THEN 'true' ELSE 'false' END) FROM ({GRAPH}) g"""


@query("codegraph_context", CONTEXT)
def _(f):
    probed = _probed(f)
    return fused.context(_plan(), _files(f), f.f_edge, _named(probed, "DEFINITION"), _named(probed, "REFERENCE"))
