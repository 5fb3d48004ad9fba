"""Named queries on branch policy, search results and status. Their SQL states every fixed value by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import policy, status
from quarry.plans.catalog import first_by, query

LISTS = """SELECT *, list_filter(COALESCE(json_extract_string(metadata, '$.branches[*]'), []), lambda x: COALESCE(x, '') <> '') AS branches, list_filter(COALESCE(json_extract_string(metadata, '$.tags[*]'), []), lambda x: COALESCE(x, '') <> '') AS tags,
list_filter(COALESCE(json_extract_string(metadata, '$.indexedRevisions[*]'), []), lambda x: COALESCE(x, '') <> '') AS revisions FROM f_policy"""
GOOD = "len(regexp_extract_all(g, '\\[')) = len(regexp_extract_all(g, '\\]'))"
ALLOWED = "CASE WHEN len(branches) = 0 THEN COALESCE(default_branch, '') IN ('', {0}) ELSE list_contains(branches, '*') OR len(list_filter(branches, lambda g: {1} AND {0} GLOB g)) > 0 END"
EACH = f"SELECT p.*, r.rev, r.pos FROM ({LISTS}) p, UNNEST(p.revisions) WITH ORDINALITY AS r(rev, pos)"
POLICY = f"""SELECT id, rev, pos FROM ({EACH}) e WHERE CASE WHEN rev LIKE 'refs/heads/%' THEN {ALLOWED.format("regexp_replace(rev, '^refs/heads/', '')", GOOD)}
WHEN rev LIKE 'refs/tags/%' THEN len(list_filter(tags, lambda g: {GOOD} AND regexp_replace(rev, '^refs/tags/', '') GLOB g)) > 0 ELSE TRUE END"""
HIDDEN = "((job_type = 'REMOVE_INDEX' AND job_status IN ('PENDING', 'IN_PROGRESS', 'FAILED')) OR indexed_at IS NULL)"
SEEN = f"""SELECT l.id, l.name, l.default_branch, {HIDDEN} OR NOT (len(v) = 0 AND len(branches) = 0 AND default_branch IS NULL) AS enforced,
CASE WHEN {HIDDEN} THEN [] ELSE list_concat(n, CASE WHEN list_contains(n, default_branch) THEN ['HEAD'] ELSE [] END) END AS names
FROM (SELECT k.*, list_distinct(flatten(list_transform(v, lambda r: [r, regexp_replace(r, '^refs/(heads|tags)/', '')]))) AS n FROM (SELECT l.*, CASE WHEN p.v IS NOT NULL THEN p.v WHEN COALESCE(default_branch, '') <> '' AND {ALLOWED.format('default_branch', GOOD)} THEN [CONCAT('refs/heads/', default_branch)] ELSE [] END AS v
FROM ({LISTS}) l LEFT JOIN (SELECT id, list(rev) AS v FROM ({POLICY}) q GROUP BY id) p ON p.id = l.id) k) l"""
BRANCHES = "list_filter(names, lambda x: x NOT IN ('', 'HEAD') AND NOT starts_with(x, 'refs/'))"


@query("policy_visible_revisions", f"SELECT id, rev AS revision FROM ({POLICY}) p")
def _(f):
    return f.f_policy.select("id", F.explode(policy.visible_revisions()).alias("revision"))


#: Repositories with their policy, their latest job (some have none) and the status that they keep themselves.
SUMMARY = f"""SELECT p.id AS repo_id, p.org_id, j.type AS job_type, COALESCE(j.status, p.job_status) AS job_status, p.indexed_at IS NOT NULL AND EXISTS (SELECT 1 FROM ({POLICY}) v WHERE v.id = p.id) AS usable FROM f_policy p
LEFT JOIN ({first_by('f_job', 'repo_id', 'created_at DESC NULLS LAST, id DESC', '*', 'repo_id % 5 <> 0')}) j ON j.repo_id = p.id"""
RUN = "CASE WHEN job_status IN ('PENDING', 'IN_PROGRESS') THEN CASE WHEN job_type = 'REMOVE_INDEX' THEN 'removing' ELSE 'indexing' END WHEN job_status = 'FAILED' THEN 'failed' WHEN job_status = 'COMPLETED' THEN 'completed' ELSE 'none' END"
STATE = f"CASE WHEN {RUN} IN ('indexing', 'removing') THEN {RUN} WHEN {RUN} = 'failed' AND NOT usable THEN 'failed' WHEN usable THEN 'indexed' ELSE 'not_indexed' END"
COLOR = "CASE WHEN {0} IN ('indexed', 'completed') THEN 'green' WHEN {0} = 'failed' THEN 'red' WHEN {0} IN ('indexing', 'removing') THEN 'yellow' ELSE 'gray' END"


def _summary(f):
    repos = f.f_policy.select("id", "org_id", "default_branch", "metadata", "indexed_at", F.col("job_status").alias("latest_status"))
    return status.visible(status.listing(repos, f.f_job.filter("repo_id % 5 <> 0"), f.f_index))


@query("visible_status", f"SELECT repo_id, {RUN} AS run, {STATE} AS state, {COLOR.format(f'({STATE})')} AS color, {COLOR.format(f'({RUN})')} AS run_color, {RUN} IN ('indexing', 'removing') OR ({RUN} = 'failed' AND NOT usable) AS blocks FROM ({SUMMARY}) s")
def _(f):
    return _summary(f).select("repo_id", "run", "state", "color", "run_color", "blocks")


@query("org_status_rollup", f"SELECT org_id, COUNT(*) AS repos, {', '.join(f"CAST(SUM(CASE WHEN {STATE} = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in ('indexed', 'not_indexed', 'indexing', 'removing', 'failed'))} FROM ({SUMMARY}) l GROUP BY org_id")
def _(f):
    return status.rollup(_summary(f))


@query("branch_glob_policy", f"SELECT id, b AS branch, {ALLOWED.format('b', GOOD)} AS allowed FROM ({LISTS}) l, (VALUES ('main'), ('release-9'), ('hotfix/2'), ('hotfix/22'), ('dev'), ('bad')) x(b)")
def _(f):
    names = F.explode(F.array(*map(F.lit, ("main", "release-9", "hotfix/2", "hotfix/22", "dev", "bad"))))
    return f.f_policy.withColumn("branch", names).select("id", "branch", policy.branch_allowed(F.col("branch")).alias("allowed"))


@query("remove_index_block", "SELECT id, job_type = 'REMOVE_INDEX' AND job_status IN ('PENDING', 'IN_PROGRESS', 'FAILED') AS blocked FROM f_policy")
def _(f):
    return f.f_policy.select("id", policy.blocked().alias("blocked"))


@query("search_visibility", f"SELECT id, enforced, array_to_string(list_sort(names), ',') AS names FROM ({SEEN}) s")
def _(f):
    return policy.visibility(f.f_policy).select("id", "enforced", F.array_join(F.sort_array("names"), ",").alias("names"))


DEFAULT = f"CASE WHEN list_contains({BRANCHES}, default_branch) THEN default_branch ELSE list_min({BRANCHES}) END"


@query("default_branch_choice", f"SELECT id, {DEFAULT} AS branch FROM ({SEEN}) s")
def _(f):
    return policy.visibility(f.f_policy).select("id", policy.default_branch().alias("branch"))


PAIRS = f"SELECT name AS repo_name, enforced, CASE WHEN enforced THEN {DEFAULT} ELSE 'HEAD' END AS branch FROM ({SEEN}) s"
ASKED = f"SELECT DISTINCT name AS repo_name, enforced, b AS branch FROM ({SEEN}) s, (VALUES ('main'), ('dev')) x(b) WHERE NOT enforced OR list_contains({BRANCHES}, b)"


@query("branch_policy_pairs", f"SELECT * FROM ({PAIRS}) p WHERE branch IS NOT NULL")
def _(f):
    return policy.pairs(f.f_policy, [])


@query("branch_policy_asked", ASKED)
def _(f):
    return policy.pairs(f.f_policy, ["refs/heads/main", "dev", "main"])


FILES = "SELECT doc_id, CONCAT('Supplier#', LPAD(CAST(doc_id % 12 AS VARCHAR(10)), 9, '0')) AS repo_name, CASE doc_id % 3 WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'dev' ELSE 'refs/tags/v1.0' END AS branch FROM documents"


def _files(f):
    return f.table("documents").selectExpr("doc_id", "CONCAT('Supplier#', LPAD(CAST(doc_id % 12 AS STRING), 9, '0')) AS repo_name", "CASE doc_id % 3 WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'dev' ELSE 'refs/tags/v1.0' END AS branch")


@query("permitted_files", f"SELECT doc_id, repo_name, branch FROM ({FILES}) d WHERE EXISTS (SELECT 1 FROM ({ASKED}) a WHERE a.repo_name = d.repo_name AND a.branch = regexp_replace(d.branch, '^refs/(heads|tags)/', ''))")
def _(f):
    return policy.permitted(_files(f), f.f_policy, ["main", "dev"]).select("doc_id", "repo_name", "branch")


@query("file_visibility", f"SELECT doc_id, d.repo_name, branch FROM ({FILES}) d JOIN ({SEEN}) s ON s.name = d.repo_name WHERE NOT enforced OR list_contains(names, branch) OR list_contains(names, regexp_replace(branch, '^refs/(heads|tags)/', ''))")
def _(f):
    return policy.visible_files(_files(f).withColumn("branches", F.array("branch")), f.f_policy).select("doc_id", "repo_name", "branch")


@query(
    "known_branches",
    f"""SELECT id, array_to_string(list(b ORDER BY pos), ',') AS branches FROM (SELECT id, b, MIN(pos) AS pos FROM (SELECT id, default_branch AS b, 0 AS pos FROM f_policy WHERE COALESCE(default_branch, '') <> ''
UNION ALL SELECT id, x.b, x.pos FROM ({LISTS}) l, UNNEST(branches) WITH ORDINALITY AS x(b, pos) WHERE NOT regexp_matches(x.b, '[*?\\[\\]{{}}()!+@]') UNION ALL SELECT id, regexp_replace(x.b, '^refs/heads/', ''), 1000 + x.pos FROM ({LISTS}) l, UNNEST(revisions) WITH ORDINALITY AS x(b, pos) WHERE x.b LIKE 'refs/heads/%') u GROUP BY id, b) g GROUP BY id
UNION ALL SELECT id, '' FROM ({LISTS}) l WHERE COALESCE(default_branch, '') = '' AND len(list_filter(branches, lambda b: NOT regexp_matches(b, '[*?\\[\\]{{}}()!+@]'))) = 0 AND len(list_filter(revisions, lambda r: r LIKE 'refs/heads/%')) = 0""",
)
def _(f):
    return f.f_policy.select("id", F.array_join(policy.known_branches(), ",").alias("branches"))


HITS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 ELSE doc_id % 15 END AS repo_id, CONCAT('Supplier#', LPAD(CAST(doc_id % 7 AS VARCHAR(10)), 9, '0')) AS repo_name FROM documents"


@query("tenant_ids", f"SELECT doc_id, r.id AS own_id FROM ({HITS}) h JOIN f_repo r ON r.org_id = 1 AND CASE WHEN h.repo_id > 0 THEN r.id = h.repo_id ELSE r.name = h.repo_name END")
def _(f):
    hits = f.table("documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN 0 ELSE doc_id % 15 END AS repo_id", "CONCAT('Supplier#', LPAD(CAST(doc_id % 7 AS STRING), 9, '0')) AS repo_name")
    return policy.resolved(hits, f.f_repo.filter("org_id = 1"), need_id=False).select("doc_id", "own_id")


@query("result_totals", "SELECT user_id AS query, files, actual, CASE WHEN filtered OR claimed = 0 THEN actual ELSE claimed END AS total, CASE WHEN filtered OR claimed = 0 THEN actual ELSE claimed END <= actual AS exhaustive FROM (SELECT user_id, COUNT(*) FILTER (event_id % 20 <> 0) AS files, CAST(SUM(CASE WHEN event_id % 20 <> 0 THEN event_id % 7 ELSE 0 END) AS BIGINT) AS actual, MAX(user_id % 3 * 50) AS claimed, BOOL_OR(event_id % 20 = 0) AS filtered FROM events GROUP BY user_id) x")
def _(f):
    return policy.totals(f.table("events").selectExpr("user_id AS query", "event_id % 7 AS matches", "event_id % 20 <> 0 AS kept", "user_id % 3 * 50 AS claimed"))


@query("shard_stats", "SELECT user_id AS query, CAST(SUM(event_id % 100) AS BIGINT) AS files_loaded, CAST(SUM(event_id % 3) AS BIGINT) AS crashes, ARG_MAX(event_type, ts * 0 + event_id) AS flush_reason FROM (SELECT user_id, event_id, event_type, 1 AS ts FROM events) e GROUP BY user_id")
def _(f):
    rows = f.table("events").selectExpr("user_id AS query", "event_id", "event_id % 100 AS files_loaded", "event_id % 3 AS crashes", "event_type AS flush_reason")
    return policy.shard_stats(rows, ["files_loaded", "crashes"], ["event_id"])


REPOS = "SELECT id, name, CASE WHEN id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (id * 7 % 11) END AS pushed_at FROM f_repo"


@query("list_repos", f"SELECT id, name, total FROM (SELECT *, COUNT(*) OVER () AS total FROM ({REPOS}) r WHERE name ILIKE '%0000000%') x ORDER BY pushed_at DESC NULLS LAST, name, id LIMIT 4 OFFSET 4")
def _(f):
    r = f.f_repo.selectExpr("id", "name", "CASE WHEN id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id * 7 % 11)) END AS pushed_at")
    return status.list_repos(r, "0000000", "pushed", "desc", 2, 4).select("id", "name", "total")


CONFIG = "SELECT CAST(c_custkey AS BIGINT) AS org_id, CASE c_custkey % 4 WHEN 0 THEN CONCAT('{\"provider\":\"', c_mktsegment, '\",\"model\":\"m', CAST(c_custkey AS VARCHAR(10)), '\",\"displayName\":\"', c_name, '\"}') WHEN 1 THEN CONCAT('{\"provider\":\"p\",\"model\":\"', c_name, '\",\"displayName\":\" \"}') WHEN 2 THEN '{\"model\":\"alone\"}' ELSE 'no json' END AS config FROM customer"


@query("list_language_models", "SELECT c_custkey AS org_id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment ELSE 'p' END AS provider, CASE c_custkey % 4 WHEN 0 THEN CONCAT('m', CAST(c_custkey AS VARCHAR(10))) ELSE c_name END AS model, c_name AS display_name FROM customer WHERE c_custkey % 4 < 2")
def _(f):
    return status.language_models(f.spark.sql(CONFIG.replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}"), customer=f.table("customer")))


def _top(view: str, order: str, n: int, columns: str, where: str = "TRUE") -> str:
    return f"SELECT {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_id ORDER BY {order}) AS rn FROM {view} WHERE {where}) x WHERE rn <= {n}"


@query("current_graph", _top("f_graph", "CASE WHEN status = 'READY' AND revisions > 0 THEN 0 ELSE 1 END, CASE status WHEN 'READY' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'PENDING' THEN 2 WHEN 'FAILED' THEN 3 WHEN 'SKIPPED' THEN 4 WHEN 'DELETING' THEN 5 ELSE 99 END, CASE WHEN superseded_at IS NULL THEN 0 ELSE 1 END, COALESCE(epoch_ms(CAST(indexed_at AS TIMESTAMP)), 0) DESC, id DESC", 1, "repo_id, id, status"))
def _(f):
    return status.current_graph(f.f_graph).select("repo_id", "id", "status")


@query("graph_choice", _top("f_graph", "CASE WHEN status = 'READY' AND superseded_at IS NULL THEN 0 WHEN status = 'READY' THEN 1 ELSE 2 END, updated_at DESC NULLS FIRST, id DESC", 1, "repo_id, id, status"))
def _(f):
    return status.chosen_graph(f.f_graph).select("repo_id", "id", "status")


@query("status_lists", " UNION ALL ".join(f"SELECT '{kind}' AS kind, repo_id, id FROM ({_top(view, 'updated_at DESC NULLS FIRST, id DESC', n, 'repo_id, id')}) q{n}{kind}" for kind, view, n in (("graph", "f_graph", 10), ("scip", "f_scip", 10), ("manifest", "(SELECT m.*, i.updated_at FROM f_repo_manifest m JOIN f_index i ON i.id = m.id)", 20))))
def _(f):
    manifests = f.f_repo_manifest.join(f.f_index.select("id", "updated_at"), "id")
    lists = ((f.f_graph, "graph", status.MOST_GRAPHS), (f.f_scip, "scip", status.MOST_SCIP), (manifests, "manifest", status.MOST_MANIFESTS))
    parts = [status.newest(rows, most).select(F.lit(kind).alias("kind"), "repo_id", "id") for rows, kind, most in lists]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "graph_quality_issues",
    """SELECT repo_id, CONCAT('graph ', CAST(id AS VARCHAR), ': READY graph has edges but zero anchors') AS issue FROM f_graph WHERE status = 'READY' AND edge_count > 0 AND anchor_count = 0
UNION ALL SELECT repo_id, CONCAT('graph ', CAST(id AS VARCHAR), ': READY graph has edges but zero linked edges') FROM f_graph WHERE status = 'READY' AND edge_count > 0 AND linked_edge_count = 0
UNION ALL SELECT repo_id, CONCAT('graph ', CAST(id AS VARCHAR), ': READY graph has no Postgres semantic edge rows') FROM f_graph WHERE status = 'READY' AND edge_count > 0 AND semantic_edge_count = 0""",
)
def _(f):
    return status.graph_issues(f.f_graph)


@query("scip_quality_issues", "SELECT repo_id, CONCAT('SCIP ', CAST(id AS VARCHAR), CASE WHEN status = 'READY' THEN ': READY index has zero occurrences' ELSE CONCAT(': index is ', status) END) AS issue FROM f_scip WHERE (status = 'READY' AND occurrence_count = 0) OR status IN ('PARTIAL', 'INDEXING', 'FAILED')")
def _(f):
    return status.scip_issues(f.f_scip)


@query(
    "quality_issues",
    """WITH m AS (SELECT *, CONCAT('manifest ', CAST(id AS VARCHAR), ': ') AS head, status = 'READY' AND superseded_at IS NULL AS live FROM f_repo_manifest)
SELECT repo_id, CONCAT(head, 'ready manifest has no linked file rows') AS issue FROM m WHERE live AND file_count > 0 AND file_rows = 0
UNION ALL SELECT repo_id, CONCAT(head, 'ready manifest file row count does not match fileCount') FROM m WHERE live AND file_rows > 0 AND file_rows <> file_count
UNION ALL SELECT repo_id, CONCAT(head, 'Zoekt reindex used full-repo strategy for changed files') FROM m WHERE live AND lexical_strategy = 'FULL_REPO' AND (changed_files > 0 OR deleted_files > 0)
UNION ALL SELECT repo_id, CONCAT(head, 'stale pending manifest exists beside active READY manifest') FROM m WHERE status = 'PENDING' AND EXISTS (SELECT 1 FROM m n WHERE n.live AND n.repo_id = m.repo_id AND n.workspace_id = m.workspace_id AND n.branch = m.branch)""",
)
def _(f):
    return status.manifest_issues(f.f_repo_manifest)


@query(
    "semantic_health",
    f"""SELECT r.id AS repo_id, COALESCE(s.n, 0) AS scip_rows, COALESCE(g.anchor_count, 0) AS anchors, COALESCE(g.linked_edge_count, 0) AS linked, COALESCE(s.n, 0) = 0 OR COALESCE(g.anchor_count, 0) = 0 OR COALESCE(g.linked_edge_count, 0) = 0 AS needs_repair FROM f_repo r
LEFT JOIN ({_top('f_scip', 'indexed_at DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC', 1, 'repo_id, symbol_count + occurrence_count + relationship_count AS n', "status IN ('READY', 'PARTIAL')")}) s ON s.repo_id = r.id
LEFT JOIN ({_top('f_graph', 'indexed_at DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC', 1, 'repo_id, anchor_count, linked_edge_count', "status = 'READY' AND superseded_at IS NULL")}) g ON g.repo_id = r.id""",
)
def _(f):
    return status.semantic_health(f.f_repo, f.f_scip, f.f_graph)


@query("primary_connection", "SELECT repo_id, connection_id FROM (SELECT l.repo_id, l.connection_id, ROW_NUMBER() OVER (PARTITION BY l.repo_id ORDER BY c.org_id DESC, l.connection_id) AS rn FROM (SELECT repo_id, connection_id FROM f_repo_to_connection UNION ALL SELECT repo_id, (connection_id + 3) % 25 FROM f_repo_to_connection) l JOIN f_connection c ON c.id = l.connection_id) x WHERE rn = 1")
def _(f):
    l = f.f_repo_to_connection  # noqa: E741
    links = l.unionByName(l.select("repo_id", ((F.col("connection_id") + 3) % 25).alias("connection_id")))
    return status.primary_connection(links, f.f_connection.select("id", F.col("org_id").alias("updated_at"))).select("repo_id", "connection_id")
