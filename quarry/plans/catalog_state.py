"""Named queries on subjobs under leases and on evidence. Their SQL states every fixed value by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import delta, evidence, jobs, leases
from quarry.plans.catalog import query

ALIVE = "EXISTS (SELECT 1 FROM f_job j WHERE j.id = s.job_id AND j.type = 'INDEX' AND j.status = 'IN_PROGRESS')"
HELD = "('CLAIMED', 'RUNNING', 'ARTIFACT_WRITTEN', 'VALIDATING')"
REQUESTS = "SELECT id, CONCAT('w', CAST(id % 2 AS VARCHAR(5))) AS owner, CONCAT('a', CAST(id % 5 AS VARCHAR(5))) AS attempt_key, CAST(id % 4 + CASE WHEN id % 9 = 0 THEN 2 ELSE 1 END AS INT) AS asked, CASE id % 6 WHEN 0 THEN 'index is Semantically empty .scip file' WHEN 1 THEN 'timeout after 5 s' WHEN 2 THEN 'x has no semantic rows: y' ELSE 'broken' END AS message FROM f_lease"
NOW = 400


def _requests(f):
    rows = f.f_lease.selectExpr("id", "CONCAT('w', CAST(id % 2 AS STRING)) AS owner", "CONCAT('a', CAST(id % 5 AS STRING)) AS attempt_key", "CAST(id % 4 + IF(id % 9 = 0, 2, 1) AS INT) AS attempt", "CASE id % 6 WHEN 0 THEN 'index is Semantically empty .scip file' WHEN 1 THEN 'timeout after 5 s' WHEN 2 THEN 'x has no semantic rows: y' ELSE 'broken' END AS message")
    return rows.withColumn("sha256", F.sha2(F.col("id").cast("string"), 256))


#: By revision counts of the layers that are in the way, by repository the first activation: a formulation of its own.
OPEN = "SUM(CASE WHEN status NOT IN ('SUCCEEDED', 'SKIPPED') AND NOT (layer = 'SCIP' AND status IN ('FAILED', 'CANCELED')) AND {0} THEN 1 ELSE 0 END)"
OF = "job_id, workspace_id, repo_id, branch, revision, commit_hash"
READY = f"""SELECT s.id, s.job_id, s.layer, s.attempt FROM {{0}} s JOIN (SELECT {OF}, SUM(CASE WHEN layer = 'CLONE' AND status NOT IN ('SUCCEEDED', 'SKIPPED') THEN 1 ELSE 0 END) AS clones, {OPEN.format("layer IN ('AST_TREE_SITTER', 'SCIP')")} AS facts, {OPEN.format("layer <> 'ACTIVATE'")} AS others FROM {{0}} x GROUP BY {OF}) c USING ({OF})
JOIN (SELECT job_id, workspace_id, repo_id, MIN(CASE WHEN layer = 'ACTIVATE' AND status IN ('QUEUED', 'CLAIMED', 'RUNNING', 'VALIDATING', 'RETRYING') THEN CONCAT(CAST(created_at AS VARCHAR), LPAD(CAST(id AS VARCHAR), 12, '0')) END) AS turn FROM {{0}} x GROUP BY 1, 2, 3) t USING (job_id, workspace_id, repo_id)
WHERE s.status IN ('QUEUED', 'RETRYING') AND s.attempt < s.max_attempts AND CASE WHEN s.layer IN ('CLONE', 'REMOVE') THEN TRUE WHEN s.layer = 'GRAPH_MERGE' THEN c.facts = 0 WHEN s.layer = 'ACTIVATE' THEN c.others = 0 AND t.turn = CONCAT(CAST(s.created_at AS VARCHAR), LPAD(CAST(s.id AS VARCHAR), 12, '0')) ELSE c.clones = 0 END"""


@query("list_dispatchable", READY.format(f"(SELECT * FROM f_lease s WHERE {ALIVE})"))
def _(f):
    return jobs.dispatchable(leases.running(f.f_lease, f.f_job))


@query("next_dispatchable", f"SELECT r.id, r.layer FROM ({READY.format(f'(SELECT * FROM f_lease s WHERE {ALIVE})')}) r JOIN f_lease l ON l.id = r.id ORDER BY l.created_at, l.id LIMIT 50")
def _(f):
    return jobs.dispatchable(leases.running(f.f_lease, f.f_job), 50).select("id", "layer")


#: Requests and running jobs of each repository in order, folded one after another: what is taken is added to a text of what runs.
REF = "CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN 'main' WHEN 2 THEN 'refs/heads/main' WHEN 3 THEN 'refs/heads/dev' WHEN 4 THEN 'refs/tags/v1' WHEN 5 THEN ' dev ' ELSE NULL END"
ASKED = f"SELECT id, repo_id % 40 * 1000 + id % 97 AS repo_id, {REF} AS ref, created_at, status FROM f_job"
STEP = "CASE WHEN split_part(x, '~', 2) = '' AND acc <> '' THEN acc WHEN split_part(x, '~', 2) <> '' AND (contains(acc, '~' || split_part(x, '~', 2) || ';') OR contains(acc, '~;')) THEN acc ELSE acc || x || ';' END"
GUARDED = f"""WITH q AS (SELECT *, regexp_replace(TRIM(COALESCE(ref, '')), '^refs/heads/', '') AS branch FROM ({ASKED}) a),
g AS (SELECT repo_id, COALESCE(STRING_AGG(CONCAT(id, '~', branch, ';'), '' ORDER BY created_at, id) FILTER (status = 'IN_PROGRESS' AND id % 3 = 0), '') AS runs, COALESCE(list(CONCAT(id, '~', branch) ORDER BY created_at, id) FILTER (status = 'FAILED'), []) AS asks FROM q GROUP BY repo_id),
d AS (SELECT repo_id, list_reduce(list_concat([runs], asks), lambda acc, x: {STEP}) AS done FROM g),
j AS (SELECT repo_id, UNNEST(list_filter(string_split(done, ';'), lambda p: p <> '')) AS p, generate_subscripts(list_filter(string_split(done, ';'), lambda p: p <> ''), 1) AS n FROM d),
m AS (SELECT repo_id, CAST(split_part(p, '~', 1) AS BIGINT) AS id, split_part(p, '~', 2) AS branch, n FROM j),
r AS (SELECT q.*, m.n FROM q LEFT JOIN m ON m.repo_id = q.repo_id AND m.id = q.id WHERE status = 'FAILED')
SELECT r.id, r.repo_id, r.ref, r.n IS NOT NULL AS accepted, CASE WHEN r.n IS NULL THEN arg_max(m.id, m.n) END AS existing FROM r
LEFT JOIN m ON m.repo_id = r.repo_id AND (r.branch = '' OR m.branch = '' OR m.branch = r.branch) AND NOT EXISTS (SELECT 1 FROM r k WHERE k.repo_id = m.repo_id AND k.id = m.id AND (k.created_at, k.id) >= (r.created_at, r.id)) GROUP BY r.id, r.repo_id, r.ref, r.n"""


@query("job_dedupe", GUARDED)
def _(f):
    rows = f.f_job.select("id", (F.col("repo_id") % 40 * 1000 + F.col("id") % 97).alias("repo_id"), F.expr(REF).alias("ref"), "created_at", "status")
    return jobs.guarded(rows.filter("status = 'IN_PROGRESS' AND id % 3 = 0"), rows.filter("status = 'FAILED'"))


@query("claim", f"SELECT s.id, s.job_id, 'CLAIMED' AS status, CAST(s.attempt + 1 AS INT) AS attempt, r.owner AS lease_owner, r.attempt_key AS attempt_id, 900 AS lease_expires_at FROM f_lease s JOIN ({REQUESTS}) r ON r.id = s.id WHERE (s.status IN ('QUEUED', 'RETRYING') OR (s.status = 'CLAIMED' AND COALESCE(s.lease_expires_at, 0) < 400)) AND s.attempt = r.asked - 1 AND s.attempt < s.max_attempts AND {ALIVE}")
def _(f):
    return leases.claimed(f.f_lease, f.f_job, _requests(f).select("id", "attempt", "owner", "attempt_key"), NOW, F.lit(900))


OWN = f"FROM f_lease s JOIN ({REQUESTS}) r ON r.id = s.id AND r.owner = s.lease_owner AND r.attempt_key = s.attempt_id WHERE {ALIVE}"


@query("heartbeat", f"SELECT s.id, CASE WHEN s.status IN ('CLAIMED', 'RUNNING') THEN 'RUNNING' ELSE s.status END AS status, 900 AS lease_expires_at {OWN} AND s.status IN {HELD}")
def _(f):
    return leases.heartbeat(f.f_lease, f.f_job, _requests(f).drop("attempt"), F.lit(900))


@query("artifact_written", f"SELECT s.id, 'ARTIFACT_WRITTEN' AS status, sha256(CAST(s.id AS VARCHAR)) AS sha256 {OWN} AND s.status IN ('CLAIMED', 'RUNNING', 'ARTIFACT_WRITTEN') AND s.lease_expires_at > 400")
def _(f):
    return leases.artifact(f.f_lease, f.f_job, _requests(f).drop("attempt"), NOW)


@query("succeed", f"SELECT s.id, 'SUCCEEDED' AS status {OWN} AND s.status IN {HELD} AND s.lease_expires_at > 400")
def _(f):
    return leases.succeeded(f.f_lease, f.f_job, _requests(f).drop("attempt"), NOW)


AFTER = "CASE WHEN s.attempt < s.max_attempts THEN 'RETRYING' WHEN s.layer IN ('SCIP', 'AST_TREE_SITTER') THEN 'SKIPPED' ELSE 'FAILED' END"
FAIL = f"CASE WHEN s.layer = 'SCIP' AND s.id % 6 < 3 THEN 'SKIPPED' ELSE {AFTER} END"


@query("failure_transition", f"SELECT s.id, s.layer, {FAIL} AS status, {FAIL} <> 'RETRYING' AS completed {OWN} AND s.status IN {HELD} AND s.lease_expires_at > 400")
def _(f):
    return leases.failed(f.f_lease, f.f_job, _requests(f).drop("attempt"), NOW)


EXPIRED = f"SELECT s.id, s.job_id, s.layer, CASE WHEN {ALIVE} THEN {AFTER} ELSE 'CANCELED' END AS status FROM f_lease s WHERE s.status IN {HELD} AND s.lease_expires_at < 400 ORDER BY s.lease_expires_at, s.id LIMIT 300"


@query("lease_expiry", f"SELECT *, status <> 'RETRYING' AS completed FROM ({EXPIRED}) e")
def _(f):
    return leases.expired(f.f_lease, f.f_job, NOW, 300)


@query(
    "dispatch_cycle",
    f"""WITH e AS ({EXPIRED}), a AS (SELECT s.* REPLACE (COALESCE(e.status, s.status) AS status) FROM f_lease s LEFT JOIN e ON e.id = s.id),
l AS (SELECT id FROM a WHERE status IN ('QUEUED', 'CLAIMED', 'RUNNING', 'VALIDATING', 'RETRYING') AND job_id IN (SELECT job_id FROM a WHERE status = 'FAILED' AND layer NOT IN ('SCIP', 'AST_TREE_SITTER'))),
b AS (SELECT a.* REPLACE (CASE WHEN l.id IS NOT NULL THEN 'CANCELED' ELSE a.status END AS status) FROM a LEFT JOIN l ON l.id = a.id),
c AS (SELECT * FROM b s WHERE {ALIVE}), d AS ({READY.format('c')})
SELECT 'requeued' AS step, id FROM e UNION ALL SELECT 'reconciled', id FROM l UNION ALL SELECT CASE WHEN id % 4 = 0 AND attempt + 1 = 1 THEN 'duplicate' ELSE 'enqueued' END, id FROM d""",
)
def _(f):
    queued = f.f_lease.filter("id % 4 = 0").select(F.concat(F.col("id").cast("string"), F.lit(":1")).alias("task"))
    return leases.cycle(f.f_lease, f.f_job, queued, NOW, 300)


@query(
    "plan_subjobs",
    """WITH r AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS lex, c_custkey % 3 = 0 AS ast, c_custkey % 5 AS n FROM customer)
SELECT CAST(k AS VARCHAR) AS revision, 0 AS place, 'ZOEKT' AS layer, NULL AS project FROM r WHERE lex UNION ALL SELECT CAST(k AS VARCHAR), 1, 'AST_TREE_SITTER', NULL FROM r WHERE ast
UNION ALL SELECT CAST(k AS VARCHAR), 2, 'SCIP', CONCAT('p', CAST(i AS VARCHAR)) FROM r, range(1, 5) t(i) WHERE i <= n UNION ALL SELECT CAST(k AS VARCHAR), 3, 'GRAPH_MERGE', NULL FROM r WHERE ast OR n > 0 UNION ALL SELECT CAST(k AS VARCHAR), 4, 'ACTIVATE', NULL FROM r WHERE lex OR ast OR n > 0""",
)
def _(f):
    c = f.table("customer").selectExpr("CAST(c_custkey AS STRING) AS revision", "c_custkey % 2 = 0 AS run_lexical", "c_custkey % 3 = 0 AS run_ast", "IF(c_custkey % 5 = 0, array(), transform(sequence(1, int(c_custkey % 5)), i -> CONCAT('p', i))) AS projects")
    return leases.planned(c.withColumns({"run_merge": F.expr("run_ast OR size(projects) > 0"), "run_activate": F.expr("run_lexical OR run_ast OR size(projects) > 0")}))


SLICED = "SELECT graph_index_id, ordinal, source_file AS path, start_line AS line, CASE start_line % 6 WHEN 0 THEN 'scip-definition' WHEN 1 THEN 'test' WHEN 2 THEN 'focused' WHEN 3 THEN 'runtime-env' WHEN 4 THEN 'other' ELSE 'crd-spec' END AS found_by FROM f_edge"


@query("slice_score", f"SELECT graph_index_id, ordinal, CAST(10 + CASE found_by WHEN 'scip-definition' THEN 105 WHEN 'test' THEN 45 WHEN 'focused' THEN 70 WHEN 'runtime-env' THEN 75 WHEN 'crd-spec' THEN 82 ELSE 0 END - CASE WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN 10 ELSE 0 END + CASE WHEN contains(path, '/internal/') OR contains(path, '/cmd/') THEN 10 ELSE 0 END + CASE WHEN contains(path, 'podmutator') OR contains(path, 'webhook') OR contains(path, 'sdk.go') THEN 8 ELSE 0 END - CASE WHEN line <= 5 THEN 10 ELSE 0 END AS INT) AS score FROM ({SLICED}) s")
def _(f):
    e = f.f_edge.selectExpr("graph_index_id", "ordinal", "source_file AS path", "start_line AS line", "CASE start_line % 6 WHEN 0 THEN 'scip-definition' WHEN 1 THEN 'test' WHEN 2 THEN 'focused' WHEN 3 THEN 'runtime-env' WHEN 4 THEN 'other' ELSE 'crd-spec' END AS found_by")
    return e.select("graph_index_id", "ordinal", evidence.slice_score(F.col("found_by"), F.col("path"), F.col("line")).alias("score"))


STOP = ", ".join(f"'{w}'" for w in "a an and are as at be by can code codebase connect connection anchors context detail details diagram does entry exact explain file files flow focus for from function functions how important inside latest level lifecycle lines matter method methods of on operator part parts path piece pieces previous prior question relevant repo repos repository retrieval route service show spec symbol symbols test the their these this through to use used using work workloads what when where which with auto-instrumentation opentelemetry otel".split())
TERMS = "SELECT part_id, i, t FROM (SELECT p_partkey AS part_id, UNNEST(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT p_partkey, list_concat(string_split(CONCAT('(', p_name, ') the Path. ', p_type, ' x '), ' '), [CONCAT('a_', CAST(p_size % 3 AS VARCHAR)), 'src/x', '`Go.run`']) AS w FROM part) p) q"
BARE = "regexp_replace(t, '^[.,:;()\\[\\]{}<>\"''`]+|[.,:;()\\[\\]{}<>\"''`]+$', '', 'g')"


def _once(where: str, most: int, name: str) -> str:
    return f"""SELECT p.p_partkey AS part_id, COALESCE(s.{name}, '') AS {name} FROM part p LEFT JOIN (SELECT part_id, array_to_string(list(b ORDER BY i)[1:{most}], ',') AS {name} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY part_id, LOWER(b) ORDER BY i) AS rn FROM (SELECT part_id, i, {BARE} AS b FROM ({TERMS}) t0) t1
WHERE strlen(b) >= 3 AND LOWER(b) NOT IN ({STOP}) AND {where}) t2 WHERE rn = 1 GROUP BY part_id) s ON s.part_id = p.p_partkey"""


def _terms(f):
    words = F.concat(F.split(F.concat(F.lit("("), "p_name", F.lit(") the Path. "), "p_type", F.lit(" x ")), " "), F.array(F.concat(F.lit("a_"), (F.col("p_size") % 3).cast("string")), F.lit("src/x"), F.lit("`Go.run`")))
    return f.table("part").select(F.col("p_partkey").alias("part_id"), words.alias("words"))


@query("clean_terms", _once("TRUE", 4, "terms"))
def _(f):
    return _terms(f).select("part_id", F.array_join(evidence.cleaned_terms(F.col("words"), 4), ",").alias("terms"))


@query("symbol_candidates", _once("NOT contains(b, '/') AND NOT contains(b, '-') AND (regexp_matches(b, '[A-Z.$_]') OR strlen(b) >= 5)", 5, "names"))
def _(f):
    return _terms(f).select("part_id", F.array_join(evidence.symbol_candidates(F.col("words")), ",").alias("names"))


GRAPH_TEXT = "SELECT c_custkey AS id, CONCAT('Graph for ', c_name, '  ', chr(10), chr(10), 'second', chr(10), 'dropped', chr(10), '- depth 1 a -> b', chr(10), '  confidence=0.9', chr(10), 'plain source', chr(10), CASE WHEN c_custkey % 2 = 0 THEN '- step 2' ELSE 'x source=ast-go' END, chr(10), 'provenance=', c_mktsegment, chr(10), '- depth 1 a -> b') AS text FROM customer"


@query("compact_lines", "SELECT c_custkey AS id, CONCAT_WS(chr(10), CONCAT('Graph for ', c_name), 'second', '- depth 1 a -> b', '  confidence=0.9', CASE WHEN c_custkey % 2 = 0 THEN '- step 2' ELSE 'x source=ast-go' END, CONCAT('provenance=', c_mktsegment)) AS text FROM customer")
def _(f):
    return evidence.compacted(f.spark.sql(GRAPH_TEXT.replace("FROM customer", "FROM {customer}"), customer=f.table("customer")), 20)


@query("cache_key", "SELECT c_custkey AS id, sha256(CONCAT_WS(chr(0), LOWER(regexp_replace(TRIM(CONCAT('  ', c_name, '  ', c_mktsegment)), '\\s+', ' ', 'g')), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'main' END)) AS key FROM customer")
def _(f):
    c = f.table("customer")
    return c.select(F.col("c_custkey").alias("id"), evidence.cache_key([F.concat(F.lit("  "), "c_name", F.lit("  "), "c_mktsegment"), F.when(F.col("c_custkey") % 3 != 0, "MAIN ")]).alias("key"))


@query("evidence_seeds", "SELECT workspace_id, vid, score, ordinal FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY workspace_id, vid ORDER BY ordinal, score) AS rn FROM (SELECT CONCAT('w', CAST(org_id AS VARCHAR)) AS workspace_id, src AS vid, graph_index_id * 10 + ordinal AS ordinal, CAST(CASE ordinal % 5 WHEN 0 THEN 80 WHEN 1 THEN 65 WHEN 2 THEN 60 WHEN 3 THEN 50 ELSE 45 END + start_line % 4 AS INT) AS score FROM f_edge) e) x WHERE rn = 1")
def _(f):
    kinds = F.element_at(F.array(*map(F.lit, evidence.SEED_SCORES)), (F.col("ordinal") % 5 + 1).cast("int"))
    found = f.f_edge.select(kinds.alias("kind"), F.concat(F.lit("w"), F.col("org_id").cast("string")).alias("workspace_id"), F.col("src").alias("vid"), (F.col("start_line") % 4).alias("bonus"), (F.col("graph_index_id") * 10 + F.col("ordinal")).alias("ordinal"))
    return evidence.seeds(found)



@query("view_caps", "SELECT relation, graph_index_id, ordinal, CAST(rn AS INT) AS place, GREATEST(n - CASE relation WHEN 'CALLS' THEN 20 WHEN 'REFERENCES' THEN 12 ELSE 12 END, 0) AS omitted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY relation ORDER BY confidence DESC, graph_index_id, ordinal) AS rn, COUNT(*) OVER (PARTITION BY relation) AS n FROM f_edge WHERE relation IN ('CALLS', 'REFERENCES', 'IMPORTS')) x WHERE rn <= CASE relation WHEN 'CALLS' THEN 20 ELSE 12 END")
def _(f):
    caps = dict(zip(("CALLS", "REFERENCES", "IMPORTS"), evidence.PATH_CAPS, strict=True))
    return evidence.capped(f.f_edge.filter(F.col("relation").isin(*caps)), "relation", [F.col("confidence").desc(), "graph_index_id", "ordinal"], caps).select("relation", "graph_index_id", "ordinal", "place", "omitted")


#: Manifest pairs of each repository and branch; the two spellings of the toolchains are one value in another order.
PAIR = """repo_name, branch, n % 5 <> 0 AS had_previous, n % 2 = 0 AS file_delta, n AS org_id, CASE WHEN n % 11 = 3 THEN n + 1 ELSE n END AS old_org_id, 'w' AS workspace_id, CASE WHEN n % 11 IN (3, 4) THEN 'v' ELSE 'w' END AS old_workspace_id, n AS repo_id, n AS old_repo_id,
CASE WHEN n % 3 = 0 THEN NULL ELSE 7 END AS provider_connection_id, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 11 = 5 THEN 8 ELSE 7 END AS old_provider_connection_id, branch AS branch_name, branch AS old_branch_name,
CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"a": 1, "b": {"x": [1, 2], "y": 2}}' ELSE '{"a": 1}' END AS scip_toolchains, CASE n % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"b":{"y":2,"x":[1,2]},"a":1}' WHEN 2 THEN '{"a": 2}' ELSE '{"a":1}' END AS old_scip_toolchains,
CASE WHEN n % 6 = 1 THEN '{"model": "m"}' END AS semantic_extraction, CASE WHEN n % 6 = 2 THEN 'broken' END AS old_semantic_extraction"""
PAIRS = f"SELECT {PAIR} FROM (SELECT DISTINCT repo_name, branch, CAST(SUBSTR(repo_name, 4) AS INT) AS n FROM f_manifest_cur) m"
ROOT = "CASE WHEN content_hash % 7 = 0 THEN NULL ELSE split_part(path, '/', 1) END AS root"
TOUCHED = f"""SELECT repo_name, branch, COUNT(*) FILTER (change <> 'unchanged') AS touched, array_to_string(list_sort(list(DISTINCT root) FILTER (change <> 'unchanged')), ',') AS moved, array_to_string(list_sort(list(DISTINCT new_root) FILTER (new_root IS NOT NULL)), ',') AS every
FROM (SELECT COALESCE(c.repo_name, p.repo_name) AS repo_name, COALESCE(c.branch, p.branch) AS branch, COALESCE(c.root, p.root) AS root, c.root AS new_root, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.content_hash <> c.content_hash THEN 'changed' ELSE 'unchanged' END AS change
FROM (SELECT * REPLACE (COALESCE(root, '.') AS root) FROM (SELECT *, {ROOT} FROM f_manifest_prev) x) p FULL JOIN (SELECT * REPLACE (COALESCE(root, '.') AS root) FROM (SELECT *, {ROOT} FROM f_manifest_cur) y) c ON p.path = c.path AND p.repo_name = c.repo_name AND p.branch = c.branch) d GROUP BY 1, 2"""
TOOLS, PROMPT = "n % 4 = 2", "n % 6 = 1"
WRONG = "CASE WHEN had_previous THEN CASE WHEN n % 11 = 3 THEN 'orgId' WHEN n % 11 = 4 THEN 'workspaceId' WHEN n % 11 = 5 AND n % 3 <> 0 THEN 'providerConnectionId' END END"


def _when(value: str) -> str:
    return f"CASE WHEN {WRONG} IS NULL THEN {value} END"


@query(
    "manifest_plans",
    f"""SELECT p.repo_name, p.branch, {WRONG} AS error, {_when("CASE WHEN NOT had_previous THEN 'FULL' WHEN touched > 0 THEN 'DELTA' ELSE 'NOOP' END")} AS mode, {_when("CASE WHEN NOT had_previous THEN 'FULL_REPO' WHEN touched > 0 AND file_delta THEN 'DELTA_FILES' WHEN touched > 0 THEN 'FULL_REPO_REWRITE' ELSE 'NOOP' END")} AS lexical,
{_when("CASE WHEN NOT had_previous THEN 'No previous manifest exists.' WHEN touched > 0 AND file_delta THEN 'Search engine supports file-level shard updates.' WHEN touched > 0 THEN 'Zoekt rewrites repository shard files because file-level shard delta is not enabled.' END")} AS lexical_reason,
{_when(f"CASE WHEN NOT had_previous OR {TOOLS} THEN 'FULL_REPO' WHEN touched > 0 THEN 'PROJECT_ROOTS' ELSE 'NOOP' END")} AS scip, {_when(f"CASE WHEN NOT had_previous OR {TOOLS} THEN every ELSE COALESCE(moved, '') END")} AS scip_roots,
{_when(f"CASE WHEN NOT had_previous THEN 'No previous manifest exists.' WHEN {TOOLS} THEN 'SCIP toolchain fingerprint changed.' WHEN touched > 0 THEN 'Language indexers require project-root context for precise symbols.' END")} AS scip_reason, {_when("CASE WHEN NOT had_previous OR touched > 0 THEN 'DELTA_FILES' ELSE 'NOOP' END")} AS graph,
{_when(f"CASE WHEN NOT had_previous OR {PROMPT} THEN 'ALL_CHUNKS' WHEN touched > 0 THEN 'CHANGED_CHUNKS' ELSE 'NOOP' END")} AS semantic, {_when(f"CASE WHEN NOT had_previous THEN 'No previous semantic extraction cache exists.' WHEN {PROMPT} THEN 'Semantic extraction prompt, model, or schema changed.' END")} AS semantic_reason
FROM (SELECT *, CAST(SUBSTR(repo_name, 4) AS INT) AS n FROM ({PAIRS}) q) p JOIN ({TOUCHED}) t ON t.repo_name = p.repo_name AND t.branch = p.branch""",
)
def _(f):
    pairs = f.f_manifest_cur.select("repo_name", "branch").distinct().withColumn("n", F.expr("CAST(SUBSTR(repo_name, 4) AS INT)"))
    pairs = f.spark.sql(f"SELECT {PAIR.replace('{', '{{').replace('}', '}}')} FROM {{pairs}}", pairs=pairs)
    rooted = lambda df: df.withColumn("root", F.expr(ROOT.removesuffix(" AS root")))
    return delta.plans(pairs, delta.touched_files(rooted(f.f_manifest_prev), rooted(f.f_manifest_cur)))
