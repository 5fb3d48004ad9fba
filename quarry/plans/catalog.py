"""Every query over the driver's tables by name, and SQL that says what it must return."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import chat, delta, edges, graph, jobs, latest, lexical, scope, status, symbols
from quarry.plans import search
from quarry.sources.fixtures import Frames, oracle

ORG, NAME, TERMS = 1, "cold ring", ["part:1", "s7"]
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(Frames(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return build

    return add


def first_by(view: str, keys: str, order: str, columns: str, where: str = "TRUE") -> str:
    return f"SELECT {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {view} WHERE {where}) x WHERE rn = 1"


USABLE = "status IN ('READY', 'PARTIAL')"
LATEST = first_by("f_index", "org_id, repo_id, revision", "COALESCE(indexed_at, updated_at) DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC", "*", USABLE)
IS_TEST = "(source_file LIKE '%\\_test.%' ESCAPE '\\' OR source_file LIKE '%/test/%' OR source_file LIKE 'tests/%')"
PRODUCER = "CASE WHEN source = 'scip' THEN 'scip' WHEN source LIKE 'ast-%' OR source LIKE 'tree-sitter%' OR source LIKE 'tree\\_sitter%' ESCAPE '\\' THEN 'ast' ELSE 'other' END"


@query("active_repo_semi", "SELECT id, org_id, name FROM f_repo r WHERE EXISTS (SELECT 1 FROM f_repo_to_connection l JOIN f_connection c ON c.id = l.connection_id WHERE l.repo_id = r.id AND c.org_id = r.org_id)")
def _(f):
    return scope.active_repos(f.f_repo, f.f_repo_to_connection, f.f_connection).select("id", "org_id", "name")


@query("count_distinct_repos", "SELECT r.org_id, COUNT(DISTINCT r.id) AS repos FROM f_repo r JOIN f_repo_to_connection l ON l.repo_id = r.id JOIN f_connection c ON c.id = l.connection_id AND c.org_id = r.org_id GROUP BY r.org_id")
def _(f):
    return scope.active_repos(f.f_repo, f.f_repo_to_connection, f.f_connection).groupBy("org_id").agg(F.countDistinct("id").alias("repos"))


@query("latest_index_rownum", f"SELECT org_id, repo_id, revision, id, status FROM ({LATEST}) y")
def _(f):
    return latest.latest_index(f.f_index).select("org_id", "repo_id", "revision", "id", "status")


@query("active_index_distinct_on", first_by("f_index", "repo_id, revision", "updated_at DESC NULLS FIRST, indexed_at DESC NULLS FIRST, id DESC", "repo_id, revision, id", USABLE))
def _(f):
    return latest.active_index(f.f_index).select("repo_id", "revision", "id")


@query("active_graph_distinct_on", first_by("f_index", "repo_id, revision", "indexed_at DESC NULLS FIRST, updated_at DESC NULLS FIRST, id DESC", "repo_id, revision, id", "status = 'READY'"))
def _(f):
    return latest.active_graph(f.f_index).select("repo_id", "revision", "id")


@query("latest_job_lateral", f"SELECT r.id AS repo_id, j.id AS job_id, j.type, j.status FROM f_repo r LEFT JOIN ({first_by('f_job', 'repo_id', 'created_at DESC NULLS LAST, id DESC', '*')}) j ON j.repo_id = r.id")
def _(f):
    j = latest.latest_job(f.f_job).select("repo_id", F.col("id").alias("job_id"), "type", "status")
    return f.f_repo.select(F.col("id").alias("repo_id")).join(j, "repo_id", "left")


@query("failed_per_parent", first_by("f_subjob", "job_id", "created_at DESC NULLS LAST, id DESC", "job_id, id, layer", "status = 'FAILED'"))
def _(f):
    return latest.failed_per_parent(f.f_subjob).select("job_id", "id", "layer")


@query("repo_revision_scope", "SELECT id, repo_id, revision FROM f_index WHERE repo_id = 3 OR (repo_id = 5 AND revision IN ('1-URGENT', '2-HIGH'))")
def _(f):
    return scope.in_revisions(f.f_index, [(3, []), (5, ["1-URGENT", "2-HIGH"])]).select("id", "repo_id", "revision")


@query("ilike_any_terms", "SELECT index_id, symbol, file_path FROM f_symbol WHERE LOWER(display_name) LIKE '%late%' OR LOWER(symbol) LIKE '%brand#1%' OR LOWER(file_path) LIKE '%file4%'")
def _(f):
    s = f.f_symbol
    return s.filter(text.like_any([F.col("display_name")], ["late"]) | text.like_any([F.col("symbol")], ["brand#1"]) | text.like_any([F.col("file_path")], ["file4"])).select("index_id", "symbol", "file_path")


def _occurrences(roles: str) -> str:
    match = " OR ".join(f"LOWER(symbol) LIKE '%{p}'" for p in ("/cold ring().", "#cold ring().", ".cold ring().", "cold ring().", "/cold ring.", "#cold ring.", ".cold ring.", "cold ring.", "/cold ring#", "#cold ring#", ".cold ring#", "cold ring#"))
    return f"""WITH cur AS (SELECT id AS index_id, revision, COALESCE(indexed_at, updated_at) AS seen FROM ({LATEST}) z WHERE org_id = {ORG}),
m AS (SELECT s.repo_id, r.name AS repo_name, s.index_id, c.revision, s.symbol, s.display_name, c.seen, CASE WHEN LOWER(s.display_name) = '{NAME}' THEN 0 WHEN LOWER(s.symbol) = '{NAME}' THEN 1 ELSE 2 END AS match_rank
FROM f_symbol s JOIN cur c ON c.index_id = s.index_id JOIN f_repo r ON r.id = s.repo_id AND r.org_id = s.org_id
WHERE s.org_id = {ORG} AND (LOWER(s.display_name) = '{NAME}' OR LOWER(s.symbol) = '{NAME}' OR {match.replace('symbol', 's.symbol')})
ORDER BY match_rank, seen DESC NULLS LAST, repo_name, display_name, symbol, index_id LIMIT 200)
SELECT m.repo_id, m.repo_name, m.index_id, m.revision, m.symbol, m.display_name, o.file_path, o.start_line, o.role, m.match_rank
FROM m JOIN f_occurrence o ON o.index_id = m.index_id AND o.symbol = m.symbol AND o.repo_id = m.repo_id AND o.org_id = {ORG} AND o.role IN ({roles})
ORDER BY m.match_rank, m.seen DESC NULLS LAST, m.repo_name, o.file_path, o.start_line, m.symbol, m.index_id, o.ordinal LIMIT 25"""


@query("symbol_definitions", _occurrences("'DEFINITION'"))
def _(f):
    return symbols.occurrences(f.f_symbol, f.f_occurrence, f.f_index, f.f_repo, ORG, NAME, ["DEFINITION"])


@query("symbol_references", _occurrences("'REFERENCE'"))
def _(f):
    return symbols.occurrences(f.f_symbol, f.f_occurrence, f.f_index, f.f_repo, ORG, NAME, ["REFERENCE"])


@query("symbol_kinds", "SELECT org_id, kind, COUNT(*) AS symbols, COUNT(DISTINCT display_name) AS names, COUNT(DISTINCT file_path) AS files FROM f_symbol GROUP BY org_id, kind")
def _(f):
    return symbols.kinds(f.f_symbol)


@query("ambiguous_symbols", "SELECT org_id, display_name, COUNT(DISTINCT symbol) AS symbols FROM f_symbol GROUP BY org_id, display_name HAVING COUNT(DISTINCT symbol) > 1")
def _(f):
    return symbols.ambiguous(f.f_symbol)


LIMIT = 40
LOCAL = "COALESCE(regexp_matches(src, '(^|[ /#.])local [0-9]+[.]?$', 'i') OR regexp_matches(dst, '(^|[ /#.])local [0-9]+[.]?$', 'i') OR regexp_matches(evidence, '(CALLS|REFERENCES|DEFINES) [0-9]+[.]?$', 'i'), FALSE)"
SEARCHED = "LOWER(CONCAT_WS(' ', COALESCE(src, ''), COALESCE(dst, ''), COALESCE(relation, ''), COALESCE(source_file, ''), COALESCE(evidence, ''), COALESCE(rationale, '')))"
RELATION_ORDER = "CASE relation WHEN 'HANDLES' THEN 0 WHEN 'EMITS' THEN 0 WHEN 'PROVIDES' THEN 0 WHEN 'CONSUMES' THEN 0 WHEN 'CALLS' THEN 1 WHEN 'REFERENCES' THEN 1 WHEN 'IMPLEMENTS' THEN 2 WHEN 'TYPE_DEFINES' THEN 2 WHEN 'EXTENDS' THEN 2 WHEN 'DEFINES' THEN 3 WHEN 'IMPORTS' THEN 4 WHEN 'IMPORTS_FROM' THEN 4 WHEN 'CONTAINS' THEN 6 ELSE 5 END"
PREFERRED = "(source_file LIKE '%/sdk.%' OR source_file LIKE '%/nodejs.%' OR source_file LIKE '%/python.%' OR source_file LIKE '%/dotnet.%' OR source_file LIKE '%/podmutator.%' OR source_file LIKE '%/webhook/%')"
BY_PLACE = "confidence DESC NULLS LAST, source_file NULLS LAST, start_line NULLS LAST, graph_index_id, ordinal"
EDGES = f"""WITH h AS (SELECT *, {PRODUCER} AS producer, {SEARCHED} AS searched FROM f_edge WHERE NOT {LOCAL}),
s AS (SELECT *, CASE WHEN searched LIKE '%part:1%' THEN 6 ELSE 0 END + CASE WHEN searched LIKE '%s7%' THEN 2 ELSE 0 END AS hits, {RELATION_ORDER} AS ro, CASE WHEN {IS_TEST} THEN 2 ELSE 0 END AS te FROM h WHERE searched LIKE '%part:1%' OR searched LIKE '%s7%'),
t AS (SELECT *, CAST(hits + CASE producer WHEN 'scip' THEN 100 WHEN 'ast' THEN 60 ELSE 0 END + CASE relation WHEN 'CALLS' THEN 80 WHEN 'REFERENCES' THEN 50 WHEN 'IMPLEMENTS' THEN 45 WHEN 'TYPE_DEFINES' THEN 45 WHEN 'DEFINES' THEN 20 ELSE 0 END
+ CASE WHEN {PREFERRED} THEN 30 ELSE 0 END + CASE WHEN {IS_TEST} THEN -50 ELSE 0 END AS INT) AS score FROM s),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY relation, producer ORDER BY hits DESC, CASE producer WHEN 'scip' THEN 0 ELSE 1 END, CASE relation WHEN 'CALLS' THEN 0 WHEN 'REFERENCES' THEN 1 WHEN 'IMPLEMENTS' THEN 2 WHEN 'TYPE_DEFINES' THEN 2 WHEN 'DEFINES' THEN 3 ELSE 4 END,
CASE WHEN {PREFERRED} THEN 0 ELSE 1 END, te, {BY_PLACE}) AS relation_rank FROM t),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY producer ORDER BY score DESC, ro, {BY_PLACE}) AS producer_rank FROM a
WHERE relation_rank <= CASE WHEN relation IN ('CALLS', 'REFERENCES') THEN 20 WHEN relation IN ('IMPORTS', 'IMPORTS_FROM') THEN 5 ELSE 10 END)
SELECT repo_id, graph_index_id, ordinal, src, dst, relation, producer, score, CAST(relation_rank AS INT) AS relation_rank, CAST(producer_rank AS INT) AS producer_rank FROM b
ORDER BY producer_rank, CASE producer WHEN 'scip' THEN 0 WHEN 'ast' THEN 1 ELSE 2 END, repo_id, score DESC, ro, te, confidence DESC NULLS LAST, source_file NULLS LAST, graph_index_id, ordinal LIMIT 40"""


@query("relation_rank", EDGES)
def _(f):
    return edges.ranked(f.f_edge, TERMS, LIMIT)


@query(
    "fallback_edges",
    f"""SELECT repo_id, producer, relation, graph_index_id, ordinal, CAST(bucket_rank AS INT) AS bucket_rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_id, producer, relation ORDER BY {BY_PLACE}) AS bucket_rank FROM (SELECT *, {PRODUCER} AS producer FROM f_edge WHERE NOT {LOCAL}) e) x WHERE bucket_rank <= 4
ORDER BY CASE producer WHEN 'scip' THEN 0 WHEN 'ast' THEN 1 ELSE 2 END, CASE relation WHEN 'CALLS' THEN 0 WHEN 'REFERENCES' THEN 1 WHEN 'HANDLES' THEN 2 WHEN 'EMITS' THEN 2 WHEN 'PROVIDES' THEN 2 WHEN 'CONSUMES' THEN 2 WHEN 'IMPLEMENTS' THEN 3 WHEN 'TYPE_DEFINES' THEN 3 WHEN 'EXTENDS' THEN 3 WHEN 'DEFINES' THEN 4 WHEN 'IMPORTS' THEN 5 WHEN 'IMPORTS_FROM' THEN 5 WHEN 'CONTAINS' THEN 7 ELSE 6 END,
CASE WHEN {IS_TEST} THEN 2 ELSE 0 END, confidence DESC NULLS LAST, repo_id, source_file NULLS LAST, start_line NULLS LAST, graph_index_id, ordinal LIMIT 200""",
)
def _(f):
    return edges.fallback(f.f_edge, 200)


@query("global_edges", f"SELECT graph_index_id, ordinal FROM f_edge WHERE NOT {LOCAL}")
def _(f):
    return edges.global_only(f.f_edge).select("graph_index_id", "ordinal")


@query("reconcile_edges", f"SELECT src, dst, relation, graph_index_id, ordinal, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst, relation ORDER BY value DESC, graph_index_id, ordinal) AS rn FROM (SELECT *, CAST(CAST(TRUNC(confidence * 1000) AS INT) * 10 + CASE {PRODUCER} WHEN 'scip' THEN 5 WHEN 'ast' THEN 3 ELSE 1 END AS INT) AS value FROM f_edge) e) x WHERE rn = 1")
def _(f):
    return edges.reconciled(f.f_edge)


@query("linked_edge_count", "SELECT e.graph_index_id, CAST(SUM(CASE WHEN e.source = 'anchor-linker' OR s.vid IS NOT NULL OR d.vid IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS linked, COUNT(*) AS edges FROM f_edge e LEFT JOIN (SELECT DISTINCT src AS vid FROM f_edge WHERE relation = 'DEFINES') s ON s.vid = e.src LEFT JOIN (SELECT DISTINCT src AS vid FROM f_edge WHERE relation = 'DEFINES') d ON d.vid = e.dst GROUP BY e.graph_index_id")
def _(f):
    e = f.f_edge
    return edges.linked_counts(e, e.filter("relation = 'DEFINES'").select(F.col("src").alias("vid")))


@query("vertex_ids", "SELECT id, SUBSTR(sha256(name), 1, 8) AS h FROM f_repo")
def _(f):
    return f.f_repo.select("id", text.hash_of(F.col("name")).alias("h"))


@query("edge_rank", "SELECT graph_index_id, ordinal, CAST(CONCAT('0x', SUBSTR(sha256(CONCAT(src, '->', dst, ':', relation, ':', source)), 1, 8)) AS BIGINT) AS edge_rank FROM f_edge")
def _(f):
    return edges.edge_rank(f.f_edge).select("graph_index_id", "ordinal", "edge_rank")


DEGREE = "SELECT vid, COUNT(*) AS degree FROM (SELECT src AS vid FROM f_edge UNION ALL SELECT dst FROM f_edge) x GROUP BY vid"


@query("degree_count", DEGREE)
def _(f):
    return graph.degrees(f.f_edge)


THRESHOLD = f"SELECT CAST(GREATEST(MIN(degree), 50) AS BIGINT) AS threshold FROM (SELECT degree, ROW_NUMBER() OVER (ORDER BY degree) AS rn, COUNT(*) OVER () AS n FROM ({DEGREE}) d) x WHERE rn = (n * 99) // 100 + 1"


@query("hub_threshold", THRESHOLD)
def _(f):
    return graph.hub_threshold(graph.degrees(f.f_edge))


@query("hub_filter", f"WITH t AS ({THRESHOLD}), d AS ({DEGREE}) SELECT e.graph_index_id, e.ordinal FROM f_edge e WHERE e.ordinal <= 1 OR e.dst NOT IN (SELECT vid FROM d, t WHERE degree >= threshold)")
def _(f):
    e = f.f_edge  # turned round, so that the suppliers, some of which are hubs, are where edges start
    return graph.without_hubs(e.select("graph_index_id", "ordinal", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ordinal").alias("depth"))).select("graph_index_id", "ordinal")


@query(
    "bfs_hops",
    """WITH st AS (SELECT src AS a, dst AS b FROM f_edge UNION SELECT dst, src FROM f_edge), h0 AS (SELECT DISTINCT src AS vid FROM f_edge WHERE src LIKE '%:part:7'),
h1 AS (SELECT DISTINCT b AS vid FROM st JOIN h0 ON a = vid WHERE b NOT IN (SELECT vid FROM h0)), s1 AS (SELECT vid FROM h0 UNION SELECT vid FROM h1),
h2 AS (SELECT DISTINCT b AS vid FROM st JOIN h1 ON a = vid WHERE b NOT IN (SELECT vid FROM s1)), s2 AS (SELECT vid FROM s1 UNION SELECT vid FROM h2),
h3 AS (SELECT DISTINCT b AS vid FROM st JOIN h2 ON a = vid WHERE b NOT IN (SELECT vid FROM s2))
SELECT vid, 0 AS depth FROM h0 UNION ALL SELECT vid, 1 FROM h1 UNION ALL SELECT vid, 2 FROM h2 UNION ALL SELECT vid, 3 FROM h3""",
)
def _(f):
    e = f.f_edge
    return graph.hops(e, e.filter(F.col("src").endswith(":part:7")).select(F.col("src").alias("vid")), 3)


@query("diversified_edges", "SELECT graph_index_id, ordinal, source, CAST(turn AS INT) AS turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY confidence DESC, graph_index_id, ordinal) AS turn FROM f_edge) x ORDER BY turn, source, confidence DESC, graph_index_id, ordinal LIMIT 50")
def _(f):
    return graph.diversified(f.f_edge, "source", [F.col("confidence").desc(), "graph_index_id", "ordinal"], 50).select("graph_index_id", "ordinal", "source", "turn")


@query("default_context", "SELECT relation, CASE relation WHEN 'CALLS' THEN 'call' WHEN 'DEFINES' THEN 'definition' WHEN 'REFERENCES' THEN 'reference' WHEN 'IMPORTS_FROM' THEN 'import' WHEN 'EXTENDS' THEN 'inherits' WHEN 'IMPLEMENTS' THEN 'inherits' WHEN 'TYPE_DEFINES' THEN 'type' WHEN 'CONTAINS' THEN 'containment' END AS context, COUNT(*) AS n FROM f_edge GROUP BY 1, 2")
def _(f):
    return f.f_edge.groupBy("relation", edges.choice(F.col("relation"), edges.CONTEXTS, None).alias("context")).agg(F.count(F.lit(1)).alias("n"))


LISTING = f"""SELECT r.id AS repo_id, r.org_id, j.id AS job_id, j.type AS job_type, j.status AS job_status, i.id AS index_id, i.status AS index_status FROM f_repo r
LEFT JOIN ({first_by('f_job', 'repo_id', 'created_at DESC NULLS LAST, id DESC', '*')}) j ON j.repo_id = r.id
LEFT JOIN ({first_by('f_index', 'repo_id', 'COALESCE(indexed_at, updated_at) DESC NULLS LAST, id DESC', '*', USABLE)}) i ON i.repo_id = r.id"""
RUN = "CASE WHEN job_status IN ('PENDING', 'IN_PROGRESS') THEN CASE WHEN job_type = 'REMOVE_INDEX' THEN 'removing' ELSE 'indexing' END WHEN job_status = 'FAILED' THEN 'failed' WHEN job_status = 'COMPLETED' THEN 'completed' ELSE 'none' END"
STATE = f"CASE WHEN {RUN} IN ('indexing', 'removing') THEN {RUN} WHEN {RUN} = 'failed' AND index_id IS NULL THEN 'failed' WHEN index_id IS NULL THEN 'not_indexed' ELSE 'indexed' END"


@query("repo_listing", LISTING)
def _(f):
    return status.listing(f.f_repo, f.f_job, f.f_index).select("repo_id", "org_id", "job_id", "job_type", "job_status", "index_id", "index_status")



@query("index_status_rollup", "SELECT repo_id, CASE WHEN MAX(CASE WHEN status = 'PARTIAL' THEN 1 ELSE 0 END) = 1 AND MAX(CASE WHEN status = 'READY' THEN 1 ELSE 0 END) = 1 THEN 'PARTIAL' WHEN MAX(CASE WHEN status = 'INDEXING' THEN 1 ELSE 0 END) = 1 THEN 'INDEXING' WHEN MAX(CASE WHEN status = 'READY' THEN 1 ELSE 0 END) = 1 THEN 'READY' ELSE 'UNCHANGED' END AS status FROM f_index GROUP BY repo_id")
def _(f):
    return status.index_rollup(f.f_index)


@query("search_contexts", "SELECT o.org_id, o.name, COALESCE(STRING_AGG(r.name, ',' ORDER BY r.name), '') AS names, COUNT(r.id) AS n FROM f_org o LEFT JOIN f_repo r ON r.org_id = o.org_id GROUP BY o.org_id, o.name")
def _(f):
    return status.contexts(f.f_repo, f.f_org)


@query("repo_page", "SELECT id, name FROM f_repo WHERE org_id = 1 ORDER BY name, id LIMIT 2 OFFSET 2")
def _(f):
    return scope.page(scope.in_org(f.f_repo, ORG), ["name", "id"], 2, 2).select("id", "name")


CHANGE = "SELECT COALESCE(p.repo_name, c.repo_name) AS repo_name, COALESCE(p.branch, c.branch) AS branch, COALESCE(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.content_hash <> c.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM f_manifest_prev p FULL JOIN f_manifest_cur c ON p.path = c.path AND p.repo_name = c.repo_name AND p.branch = c.branch"
COUNTED = f"SELECT repo_name, branch, {', '.join(f"CAST(SUM(CASE WHEN change = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in ('added', 'changed', 'deleted', 'unchanged'))} FROM ({CHANGE}) x GROUP BY repo_name, branch"


@query("delta_plan", CHANGE)
def _(f):
    return delta.changes(f.f_manifest_prev, f.f_manifest_cur)


@query("delta_counts", COUNTED)
def _(f):
    return delta.counts(delta.changes(f.f_manifest_prev, f.f_manifest_cur))


@query("delta_strategies", f"SELECT repo_name, branch, CASE WHEN t THEN 'DELTA' ELSE 'NOOP' END AS mode, CASE WHEN t THEN 'DELTA_FILES' ELSE 'NOOP' END AS lexical, CASE WHEN t THEN 'PROJECT_ROOTS' ELSE 'NOOP' END AS scip, CASE WHEN t THEN 'DELTA_FILES' ELSE 'NOOP' END AS graph, CASE WHEN t THEN 'CHANGED_CHUNKS' ELSE 'NOOP' END AS semantic FROM (SELECT *, added + changed + deleted > 0 AS t FROM ({COUNTED}) c) d")
def _(f):
    return delta.strategies(delta.counts(delta.changes(f.f_manifest_prev, f.f_manifest_cur)))


@query("merge_upsert", "SELECT path, repo_name, branch, content_hash FROM f_manifest_cur UNION ALL SELECT path, repo_name, branch, content_hash FROM f_manifest_prev p WHERE NOT EXISTS (SELECT 1 FROM f_manifest_cur c WHERE c.path = p.path AND c.repo_name = p.repo_name AND c.branch = p.branch)")
def _(f):
    return delta.merged(f.f_manifest_prev, f.f_manifest_cur, ["path", "repo_name", "branch"], ["content_hash"]).select("path", "repo_name", "branch", "content_hash")


@query("job_completion", "SELECT job_id, COUNT(*) AS subjobs FROM f_subjob GROUP BY job_id HAVING SUM(CASE WHEN status IN ('SUCCEEDED', 'SKIPPED', 'FAILED', 'CANCELED') THEN 0 ELSE 1 END) = 0".replace("FROM f_subjob", "FROM (SELECT CAST(FLOOR(id / 3) AS BIGINT) AS job_id, status FROM f_subjob) s"))
def _(f):
    return jobs.completed(f.f_subjob.withColumn("job_id", F.floor(F.col("id") / 3)))


@query("parent_failure", "SELECT id, job_id, layer FROM f_subjob s WHERE status IN ('QUEUED', 'CLAIMED', 'RUNNING', 'VALIDATING', 'RETRYING') AND EXISTS (SELECT 1 FROM f_subjob x WHERE x.job_id = s.job_id AND x.status = 'FAILED' AND x.layer NOT IN ('SCIP', 'AST_TREE_SITTER'))")
def _(f):
    return jobs.canceled_dependents(f.f_subjob)



LINES = "SELECT repo_name, branch, path, CAST(i AS INT) AS line, string_split(content, chr(10))[i] AS content FROM (SELECT *, UNNEST(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM f_file) x"


@query("grep", f"SELECT * FROM ({LINES}) l WHERE regexp_matches(content, 'mail[0-9]+[.]example') AND path LIKE 'src/%'")
def _(f):
    return lexical.grep(f.f_file, "mail[0-9]+[.]example", include="src/**")


@query("grep_by_repo", f"SELECT repo_name, COUNT(*) AS lines, COUNT(DISTINCT path) AS files FROM ({LINES}) l WHERE regexp_matches(content, '@[a-z0-9]+[.]') GROUP BY repo_name")
def _(f):
    return lexical.by_repo(lexical.grep(f.f_file, "@[a-z0-9]+[.]"))


@query("read_file", f"SELECT repo_name, branch, path, line, content FROM (SELECT *, SUM(strlen(content) + 1) OVER (PARTITION BY repo_name, branch, path ORDER BY line) AS used FROM (SELECT * REPLACE (CASE WHEN strlen(content) > 2000 THEN SUBSTR(content, 1, 2000) ELSE content END AS content) FROM ({LINES.replace('FROM f_file', "FROM (SELECT repo_name, branch, path, REPEAT(regexp_replace(content, '[^ -~]', chr(10), 'g'), 9) AS content FROM f_file WHERE doc_id = 5) w")}) l WHERE line BETWEEN 2 AND 400) m) n WHERE used <= 16384")
def _(f):
    one = f.f_file.filter("doc_id = 5")
    at = one.select("repo_name", "path").first()
    wide = one.withColumn("content", F.expr(r"REPEAT(regexp_replace(content, '[^ -~]', '\n'), 9)"))
    return lexical.read(wide, at.repo_name, at.path, 2, 399)


@query("list_tree", "SELECT DISTINCT repo_name, array_to_string(string_split(path, '/')[1:n], '/') AS entry, n = len(string_split(path, '/')) AS is_file, CAST(n AS INT) AS n FROM (SELECT repo_name, path, UNNEST(range(1, LEAST(len(string_split(path, '/')), 2) + 1)) AS n FROM f_file) x")
def _(f):
    return lexical.tree(f.f_file, 2, None)


@query("search_query", "SELECT repo_name, branch, path FROM f_file WHERE branch = 'main' AND ((lang = 'de' AND regexp_matches(path, '[.]go$') AND NOT regexp_matches(content, 'keit')) OR (repo_name IN ('src1', 'src2') AND regexp_matches(content, 'http')))")
def _(f):
    return f.f_file.filter(search.predicate('lang:de file:[.]go$ -keit or reposet:src1,src2 "http"')).select("repo_name", "branch", "path")


@query("search_groups", "SELECT repo_name, branch, path FROM f_file WHERE branch = 'release' AND (lang = 'de' OR lang = 'fr') AND regexp_matches(path, '^src/') AND NOT (regexp_matches(path, '[.]go$') OR regexp_matches(content, '(?i)HTTP'))")
def _(f):
    return f.f_file.filter(search.predicate("(lang:de or lang:fr) file:^src/ -(file:[.]go$ or HTTP) case:no", options=["refs/heads/release"])).select("repo_name", "branch", "path")


@query("list_tree_tool", "SELECT entry, is_file FROM (SELECT DISTINCT CONCAT('src/', array_to_string(string_split(p, '/')[1:n], '/')) AS entry, n = len(string_split(p, '/')) AS is_file FROM (SELECT p, UNNEST(range(1, LEAST(len(string_split(p, '/')), 2) + 1)) AS n FROM (SELECT SUBSTR(path, 5) AS p FROM f_file WHERE repo_name = 'src5' AND path LIKE 'src/%') a) b) c WHERE is_file ORDER BY LOWER(entry), entry LIMIT 20")
def _(f):
    return lexical.listed(f.f_file, "src5", "/src/", 2, folders=False, most=20).select("entry", "is_file")


@query("branch_pairs", "SELECT repo_name, branch, path FROM f_file WHERE (repo_name = 'src1' AND branch = 'main') OR (repo_name = 'src2' AND branch = 'release')")
def _(f):
    pairs = f.spark.createDataFrame([("src1", "main"), ("src2", "release")], "repo_name string, branch string")
    return lexical.in_branches(f.f_file, pairs).select("repo_name", "branch", "path")


@query("compare_branches", f"WITH l AS (SELECT repo_name, path, branch, content, COUNT(*) AS n FROM ({LINES}) z GROUP BY ALL), a AS (SELECT * FROM l WHERE branch = 'main'), b AS (SELECT * FROM l WHERE branch = 'release') SELECT COALESCE(a.repo_name, b.repo_name) AS repo_name, COALESCE(a.path, b.path) AS path, CAST(SUM(GREATEST(COALESCE(b.n, 0) - COALESCE(a.n, 0), 0)) AS BIGINT) AS additions, CAST(SUM(GREATEST(COALESCE(a.n, 0) - COALESCE(b.n, 0), 0)) AS BIGINT) AS deletions FROM a FULL JOIN b ON a.repo_name = b.repo_name AND a.path = b.path AND a.content = b.content GROUP BY 1, 2")
def _(f):
    return lexical.compared(f.f_file, "main", "release")


@query(
    "path_classes",
    """SELECT path, regexp_matches(path, '(^|/)(dist|build|coverage|target|generated|gen)/') OR regexp_matches(path, '(^|/)vendor/bundle/') OR contains(path, '.generated.') OR path LIKE '%.min.js' AS generated,
regexp_matches(path, '(^|/)(node_modules|vendor|third_party|[.]venv|venv)/') AS vendor, regexp_matches(path, '(^|/)(__tests__|test|tests|spec)/') OR regexp_matches(path, '[.](test|spec)[.][^./]+$') AS test,
CASE LOWER(regexp_extract(path, '[.][^.]*$')) WHEN '.ts' THEN 'typescript' WHEN '.jsx' THEN 'typescript' WHEN '.js' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.kt' THEN 'jvm' WHEN '.hpp' THEN 'cpp' WHEN '.cs' THEN 'dotnet' WHEN '.vb' THEN 'dotnet'
WHEN '.rb' THEN 'ruby' WHEN '.rs' THEN 'rust' WHEN '.dart' THEN 'dart' WHEN '.mdx' THEN 'docs' WHEN '.yaml' THEN 'config' END AS language FROM f_path""",
)
def _(f):
    p = F.col("path")
    return f.f_path.select("path", text.is_generated(p).alias("generated"), text.is_vendor(p).alias("vendor"), text.is_test_file(p).alias("test"), text.language(p).alias("language"))


@query("branch_policy", "SELECT path, branch FROM f_file WHERE branch LIKE 'rel%'")
def _(f):
    return f.f_file.filter(scope.branch_allowed(F.col("branch"), F.lit("main"), ["rel*"])).select("path", "branch")


@query("normalize_token", "SELECT page_id, LOWER(regexp_replace(TRIM(url), '[^A-Za-z0-9_.:-]+', '_', 'g')) AS token FROM pages")
def _(f):
    return f.table("pages").select("page_id", text.normalized(F.col("url")).alias("token"))


@query("json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(f):
    return f.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


LONG_CHAT = "SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN REPEAT(CONCAT(text, ' '), 30) WHEN turn = 1 AND conv_id % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations UNION ALL SELECT conv_id, turn + 100, CASE WHEN turn = 0 THEN ' ' ELSE role END, REPEAT(text, 40) FROM conversations WHERE conv_id % 2 = 0"


@query(
    "chat_context",
    f"""WITH c AS ({LONG_CHAT}), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c),
l AS (SELECT conv_id, turn, CONCAT(CASE WHEN TRIM(role) = '' THEN 'MESSAGE' ELSE UPPER(TRIM(role)) END, ': ', CASE WHEN strlen(TRIM(text)) > 1400 THEN CONCAT(SUBSTR(TRIM(text), 1, 1400), '... (truncated)') ELSE TRIM(text) END, chr(10)) AS line FROM b WHERE back <= 8 AND TRIM(text) <> ''),
u AS (SELECT *, 43 + SUM(strlen(line)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - strlen(line) AS before FROM l),
j AS (SELECT conv_id, CONCAT('Recent prior chat turns, oldest to newest:', chr(10), STRING_AGG(line, '' ORDER BY turn)) AS whole FROM u WHERE before < 12000 GROUP BY conv_id)
SELECT d.conv_id, CASE WHEN whole IS NULL THEN 'Recent prior chat turns, oldest to newest:' WHEN strlen(whole) < 12000 THEN TRIM(whole, chr(10)) WHEN strlen(whole) = 12000 THEN whole ELSE CONCAT(SUBSTR(whole, 1, 12000), chr(10), chr(10), '(Output truncated before sending back to the model.)') END AS context
FROM (SELECT DISTINCT conv_id FROM c) d LEFT JOIN j ON j.conv_id = d.conv_id""".replace("FROM conversations", "FROM (SELECT conv_id, turn, role, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM conversations) z"),
)
def _(f):
    rows = f.table("conversations").withColumn("text", F.regexp_replace("text", "[^ -~]", "?"))
    one = F.expr("CASE WHEN conv_id % 3 = 0 THEN REPEAT(CONCAT(text, ' '), 30) WHEN turn = 1 AND conv_id % 5 = 0 THEN '  ' ELSE text END")
    more = rows.filter("conv_id % 2 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"), F.when(F.col("turn") == 0, " ").otherwise(F.col("role")).alias("role"), F.expr("REPEAT(text, 40)").alias("text"))
    return chat.context(rows.withColumn("text", one).select("conv_id", "turn", "role", "text").unionByName(more))


#: What is said in each turn names the same code; a question of its own is asked in each conversation.
SAID = "CONCAT('see src/pkg/f', CAST(conv_id AS VARCHAR(20)), '.go and MAX_', CAST(conv_id AS VARCHAR(20)), ' or loadItem; ', LOWER(regexp_replace(SUBSTR(COALESCE(text, ''), 1, 200), '[^a-z ]', '')))"


@query(
    "chat_query",
    """SELECT DISTINCT conv_id, CONCAT('where is ', conv_id, chr(10), chr(10), 'Relevant prior code anchors for retrieval only:', chr(10), '- src/pkg/f', conv_id, '.go', chr(10), '- f', conv_id, '.go', chr(10), '- USER', chr(10), '- MAX_', conv_id, chr(10), '- loadItem') AS query FROM conversations""",
)
def _(f):
    rows = f.table("conversations").select("conv_id", "turn", F.lit("user").alias("role"), F.expr(SAID).alias("text"))
    asked = chat.context(rows).withColumn("query", F.concat(F.lit(" where is "), F.col("conv_id").cast("string"), F.lit("\n")))
    return chat.retrieval_query(asked)


@query("running_totals", "SELECT event_id, user_id, CAST(SUM(CAST(FLOOR(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def _(f):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return f.table("events").select("event_id", "user_id", F.sum(F.floor("value")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.lag("event_type").over(w).alias("before"))


@query("file_rollup", "SELECT source, lang, COUNT(*) AS files FROM documents GROUP BY ROLLUP (source, lang)")
def _(f):
    return f.table("documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("files"))


@query("symbol_set_difference", "SELECT symbol, file_path FROM f_occurrence WHERE role = 'DEFINITION' EXCEPT SELECT symbol, file_path FROM f_occurrence WHERE role = 'REFERENCE'")
def _(f):
    o = f.f_occurrence.select("symbol", "file_path", "role")
    return o.filter("role = 'DEFINITION'").drop("role").distinct().join(o.filter("role = 'REFERENCE'"), ["symbol", "file_path"], "left_anti")


