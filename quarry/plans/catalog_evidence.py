"""More named queries: symbol-index rows, repository lifecycle, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import evidence, fused, latest, lifecycle, scip
from quarry.plans.catalog import LATEST, first_by, query

MASK = "CAST((start_line * 7 + ordinal) % 128 AS INT)"
ROLE_ROWS = " UNION ALL ".join(
    ["SELECT index_id, ordinal, 'REFERENCE' AS role FROM m WHERE mask & 65 = 0"]
    + [f"SELECT index_id, ordinal, '{name}' FROM m WHERE mask & {bit} > 0" for name, bit in (("DEFINITION", 1), ("IMPORT", 2), ("WRITE", 4), ("READ", 8), ("GENERATED", 16), ("TEST", 32), ("FORWARD_DEFINITION", 64))]
)


@query("occurrence_roles", f"WITH m AS (SELECT index_id, ordinal, {MASK} AS mask FROM f_occurrence) {ROLE_ROWS}")
def _(f):
    return scip.by_role(f.f_occurrence.withColumn("mask", F.expr(MASK)), "mask").select("index_id", "ordinal", "role")


ENCLOSED = """SELECT index_id, ordinal, role, symbol, file_path, start_line, enclosing FROM (SELECT o.*, d.symbol AS enclosing,
ROW_NUMBER() OVER (PARTITION BY o.index_id, o.ordinal, o.role, o.symbol, o.file_path, o.start_line ORDER BY d.ordinal * 500000, d.index_id, d.ordinal, d.symbol) AS rn
FROM f_occurrence o JOIN f_occurrence d ON d.index_id = o.index_id AND d.file_path = o.file_path AND d.symbol <> o.symbol AND d.role = 'DEFINITION'
WHERE o.role <> 'DEFINITION' AND d.start_line <= o.start_line AND d.start_line + d.ordinal * 5 >= o.start_line) x WHERE rn = 1"""


def _enclosed(f):
    o = f.f_occurrence.withColumns({"start_col": F.lit(0), "end_col": F.lit(0)})
    d = o.filter("role = 'DEFINITION'").withColumn("end_line", F.col("start_line") + F.col("ordinal") * 5)
    found = o.filter("role <> 'DEFINITION'").withColumn("end_line", F.col("start_line"))
    return scip.enclosed(found, d, ["index_id", "file_path"], ["index_id", "ordinal", "role", "symbol", "file_path", "start_line"], ["ordinal"])


@query("enclosing_definition", ENCLOSED)
def _(f):
    return _enclosed(f)


@query("symbol_edges", f"SELECT enclosing AS src, symbol AS dst, CASE WHEN role = 'IMPORT' THEN 'IMPORTS' WHEN symbol LIKE '%().' THEN 'CALLS' ELSE 'REFERENCES' END AS relation, COUNT(*) AS n FROM ({ENCLOSED}) e GROUP BY 1, 2, 3")
def _(f):
    return scip.edges(_enclosed(f))


@query("grouped_occurrences", "SELECT repo_id, symbol, file_path, array_to_string(list_sort(list(DISTINCT start_line + 1)), ',') AS lines, COUNT(*) AS n FROM f_occurrence GROUP BY repo_id, symbol, file_path")
def _(f):
    return scip.grouped(f.f_occurrence)


@query("first_vertices", first_by("f_symbol", "symbol", "index_id, file_path", "symbol, index_id, file_path"))
def _(f):
    return scip.first_of_each(f.f_symbol, ["symbol"], ["index_id", "file_path"]).select("symbol", "index_id", "file_path")


REPO = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS clone_url, c_custkey % 5 = 0 AS fork, c_custkey % 7 = 0 AS archived, c_name AS full_name, c_mktsegment AS topic, c_custkey AS size FROM customer"


@query("excluded_repos", f"SELECT id, clone_url IS NULL OR fork OR archived OR full_name LIKE '%1' OR LOWER(topic) LIKE 'auto%' OR size * 1000 < 5000 OR size * 1000 > 90000 AS excluded FROM ({REPO}) r")
def _(f):
    rules = {"forks": True, "archived": True, "repos": ["*1"], "topics": ["AUTO*"], "min_size": 5000, "max_size": 90_000}
    repos = f.table("customer").selectExpr(
        "c_custkey AS id", "IF(c_custkey % 11 = 0, NULL, c_name) AS clone_url", "c_custkey % 5 = 0 AS fork", "c_custkey % 7 = 0 AS archived", "c_name AS full_name", "array(c_mktsegment) AS topics", "c_custkey AS size"
    )
    return repos.select("id", lifecycle.excluded(rules).alias("excluded"))


READY = first_by("f_index", "repo_id, revision", "updated_at DESC, id DESC", "repo_id, revision, updated_at AS newest_at, id AS newest_id", "status = 'READY'")


@query("activation", f"SELECT i.id, i.repo_id, i.revision, CASE WHEN i.id = r.newest_id THEN 'ACTIVE' WHEN i.status IN ('READY', 'INDEXING') AND (i.updated_at < r.newest_at OR (i.updated_at = r.newest_at AND i.id < r.newest_id)) THEN 'SUPERSEDED' ELSE i.status END AS status FROM f_index i LEFT JOIN ({READY}) r ON r.repo_id = i.repo_id AND r.revision = i.revision")
def _(f):
    return lifecycle.activated(f.f_index)


@query("merged_revisions", "SELECT repo_id, CONCAT('[\"', array_to_string(list_sort(list(DISTINCT revision)), '\",\"'), '\"]') AS revisions FROM f_index GROUP BY repo_id")
def _(f):
    return lifecycle.merged_revisions(f.f_index)


@query("branch_cleanup", f"SELECT id, repo_id, revision FROM f_index i WHERE NOT EXISTS (SELECT 1 FROM ({LATEST}) p WHERE p.id = i.id AND p.revision <> '5-LOW')")
def _(f):
    pointers = latest.latest_index(f.f_index).select("repo_id", "revision", F.col("id").alias("index_id"))
    return lifecycle.cleaned(pointers, f.f_index, "5-LOW")[1].select("id", "repo_id", "revision")


@query("replace_children", "SELECT path, repo_name, branch, content_hash FROM f_manifest_cur WHERE branch = 'release' UNION ALL SELECT path, repo_name, branch, content_hash FROM f_manifest_prev p WHERE NOT EXISTS (SELECT 1 FROM f_manifest_cur c WHERE c.branch = 'release' AND c.branch = p.branch AND c.repo_name = p.repo_name)")
def _(f):
    return lifecycle.replaced(f.f_manifest_prev, f.f_manifest_cur.filter("branch = 'release'"), ["repo_name", "branch"]).select("path", "repo_name", "branch", "content_hash")


REACHED = """{name}(id) AS (SELECT CAST({start} AS BIGINT) UNION SELECT p.parent FROM {name} r JOIN p ON p.id = r.id)"""


@query(
    "commit_reachability",
    f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 5 AND c_custkey % 3 = 0),
{REACHED.format(name='a', start=87)}, {REACHED.format(name='b', start=126)}
SELECT (SELECT COUNT(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS ahead, (SELECT COUNT(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS behind""",
)
def _(f):
    c = f.table("customer").select(F.col("c_custkey").alias("id"))
    parents = c.filter("id > 1").withColumn("parent", F.expr("id div 2")).unionByName(c.filter("id > 5 AND id % 3 = 0").withColumn("parent", F.expr("id div 3")))
    return lifecycle.ahead_behind(parents, 87, 126)


@query("project_roots", "SELECT f.repo_name, f.path, COALESCE(MAX(r.root), '.') AS root FROM f_file f LEFT JOIN (SELECT DISTINCT repo_name, regexp_replace(path, '/[^/]*$', '') AS root FROM f_file WHERE doc_id % 10 = 3) r ON r.repo_name = f.repo_name AND f.path LIKE CONCAT(r.root, '/%') GROUP BY f.repo_name, f.path")
def _(f):
    roots = f.f_file.filter("doc_id % 10 = 3").select("repo_name", F.regexp_replace("path", "/[^/]*$", "").alias("root"))
    return lifecycle.project_roots(f.f_file, roots)


SOURCES = ("focused", "runtime-env", "runtime-side", "scip-definition-forced", "scip-test-requested", "broad")
SLICE = f"SELECT CAST(repo_id AS VARCHAR) AS repo_name, '' AS branch, source_file AS path, CAST(start_line * ordinal * 10 AS INT) AS line, CASE (graph_index_id + ordinal) % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SOURCES))} END AS source, CAST(ROUND(confidence * 100) AS INT) AS score FROM f_edge"
OWN = "CASE WHEN source IN ('runtime-env', 'runtime-side') THEN source WHEN source IN ('scip-definition-forced', 'scip-definition-requested', 'scip-test-requested') THEN CONCAT(source, ':', line) ELSE '' END"
SELECTED = f"""SELECT repo_name, branch, path, line, source, score FROM (SELECT repo_name, branch, path, line, source, {OWN} AS own, score - CASE WHEN contains(path, '_test.') THEN 35 ELSE 0 END + CASE WHEN contains(path, '/sdk.py') OR contains(path, 'webhook') THEN 45 ELSE 0 END AS score FROM ({SLICE}) s WHERE line > 0 AND path <> '') c
QUALIFY ROW_NUMBER() OVER (PARTITION BY repo_name, path, own, line // 80 ORDER BY score DESC, line, source, branch) = 1 ORDER BY score DESC, repo_name, path, line, source LIMIT 60"""


@query("selected_slices", SELECTED)
def _(f):
    return fused.selected(_candidates(f), 60, preferred=PREFERRED)


PREFERRED = ("/sdk.py", "webhook")
RANKED = f"SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, path, line, repo_name, source) AS rank FROM ({SELECTED}) s"
TURNED = f"""SELECT *, CASE WHEN rank = MIN(rank) OVER (PARTITION BY repo_name) AND (SELECT COUNT(DISTINCT repo_name) FROM ({SELECTED}) n) > 1 THEN 100000 + rank WHEN rank = MIN(CASE WHEN contains(path, '/sdk.py') THEN rank END) OVER () THEN 200000 WHEN rank = MIN(CASE WHEN contains(path, 'webhook') THEN rank END) OVER () THEN 200001 ELSE 300000 + rank END AS turn FROM ({RANKED}) r"""


@query("slice_selection", f"SELECT repo_name, branch, path, line, source, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_name, path ORDER BY turn) AS of_path FROM ({TURNED}) t) p WHERE of_path <= 3 OR source IN ('scip-definition-requested', 'scip-test-requested') ORDER BY turn LIMIT 40")
def _(f):
    return fused.diverse(fused.selected(_candidates(f), 60, preferred=PREFERRED), 40, across=True, preferred=PREFERRED)


def _candidates(f):
    source = F.element_at(F.array(*map(F.lit, SOURCES)), ((F.col("graph_index_id") + F.col("ordinal")) % 6 + 1).cast("int"))
    return f.f_edge.select(F.col("repo_id").cast("string").alias("repo_name"), F.lit("").alias("branch"), F.col("source_file").alias("path"), (F.col("start_line") * F.col("ordinal") * 10).alias("line"), source.alias("source"), F.round(F.col("confidence") * 100).cast("int").alias("score"))


@query("files_to_read", "SELECT repo_id, path, revision FROM (SELECT repo_id, file_path AS path, 'active' AS revision FROM f_occurrence UNION SELECT e.repo_id, e.source_file, i.revision FROM f_edge e JOIN f_index i ON i.id = e.graph_index_id UNION SELECT repo_id, file_path, 'active' FROM f_symbol) x ORDER BY repo_id, path, revision LIMIT 25")
def _(f):
    blank = F.lit("").alias("revision")
    edge = f.f_edge.join(f.f_index.select(F.col("id").alias("graph_index_id"), "revision"), "graph_index_id").select("repo_id", F.col("source_file").alias("path"), "revision")
    return evidence.files_to_read([f.f_occurrence.select("repo_id", F.col("file_path").alias("path"), blank), edge, f.f_symbol.select("repo_id", F.col("file_path").alias("path"), blank)])


@query("proof_lines", "SELECT event_id, user_id, edge FROM (SELECT *, LAST_VALUE(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM events) x WHERE event_type = 'error'")
def _(f):
    return evidence.proof_lines(f.table("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "error", "event_id").select("event_id", "user_id", "edge")


@query("manifest_flags", "SELECT repo_id, BOOL_OR(source = 'scip') AS precise, BOOL_OR(source LIKE 'ast-%') AS ast, BOOL_OR(source <> 'scip' AND source NOT LIKE 'ast-%') AS other, CASE WHEN BOOL_OR(source = 'scip') THEN 'precise' WHEN BOOL_OR(source LIKE 'ast-%') THEN 'heuristic' ELSE 'missing' END AS verdict FROM f_edge GROUP BY repo_id")
def _(f):
    return evidence.flags(f.f_edge)


@query(
    "evidence_gate",
    """SELECT r.id AS repo_id, CONCAT_WS(',', CASE WHEN COALESCE(d, 0) < 150 THEN 'definition' END, CASE WHEN COALESCE(u, 0) < 150 THEN 'reference' END, CASE WHEN COALESCE(n, 0) < 150 THEN 'edge' END) AS lacks FROM f_repo r
LEFT JOIN (SELECT repo_id, COUNT(*) FILTER (role = 'DEFINITION') AS d, COUNT(*) FILTER (role = 'REFERENCE') AS u FROM f_occurrence GROUP BY repo_id) o ON o.repo_id = r.id LEFT JOIN (SELECT repo_id, COUNT(*) AS n FROM f_edge GROUP BY repo_id) e ON e.repo_id = r.id""",
)
def _(f):
    return evidence.missing(f.f_repo, f.f_occurrence, f.f_edge, 150)


@query("language_buckets", "SELECT repo_name, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM f_file WHERE lang <> '' GROUP BY repo_name")
def _(f):
    return f.f_file.filter("lang <> ''").groupBy("repo_name").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


KEY = "CONCAT_WS(chr(0), CAST(org_id AS VARCHAR(10)), 'root', CAST(repo_id AS VARCHAR(10)), revision, CAST(id AS VARCHAR(20)))"


@query("scoped_vertex_id", f"SELECT id, CONCAT('cg:o', org_id, ':w', SUBSTR(sha256('root'), 1, 8), ':r', repo_id, ':', SUBSTR(sha256({KEY}), 1, 32)) AS vid FROM f_index")
def _(f):
    parts = [F.col("org_id").cast("string"), F.lit("root"), F.col("repo_id").cast("string"), F.col("revision"), F.col("id").cast("string")]
    return f.f_index.select("id", F.concat(F.lit("cg:o"), parts[0], F.lit(":w"), text.hash_of(F.lit("root")), F.lit(":r"), parts[2], F.lit(":"), text.hash_of(*parts, digits=32)).alias("vid"))
