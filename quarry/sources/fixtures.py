"""The code-intelligence tables, as views over the driver's star schema. The same text serves Spark and the oracle.

Views over lineitem state a merge join: a small copy of the tables would else be broadcast whole and read by one task.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages", "embeddings")

VIEWS = {
    "f_org": """
SELECT CAST(r_regionkey + 1 AS INT) AS org_id, r_name AS name FROM region
""",
    "f_connection": """
SELECT n_nationkey AS id, CAST(n_regionkey + 1 AS INT) AS org_id, n_name AS name FROM nation
""",
    "f_repo": """
SELECT s.s_suppkey AS id, CAST(n.n_regionkey + 1 AS INT) AS org_id, s.s_name AS name,
       CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE 'main' END AS default_branch
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
""",
    "f_repo_to_connection": """
SELECT s_suppkey AS repo_id,
       CAST((s_nationkey + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) % 25 AS INT) AS connection_id
FROM supplier WHERE s_suppkey % 4 <> 0
""",
    "f_job": """
SELECT o_orderkey AS id, (SELECT MIN(s_suppkey) FROM supplier) + (o_custkey % (SELECT COUNT(*) FROM supplier)) AS repo_id,
       CASE WHEN o_orderpriority LIKE '5%' THEN 'REMOVE_INDEX' WHEN o_orderpriority LIKE '4%' THEN 'CLEANUP' ELSE 'INDEX' END AS type,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status,
       o_orderdate AS created_at
FROM orders
""",
    "f_index": """
SELECT j.id, r.org_id, j.repo_id, o.o_orderpriority AS revision,
       CASE o.o_orderstatus WHEN 'F' THEN 'READY' WHEN 'P' THEN 'PARTIAL' ELSE 'INDEXING' END AS status,
       CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderdate END AS indexed_at,
       o.o_orderdate AS updated_at
FROM f_job j JOIN orders o ON o.o_orderkey = j.id JOIN f_repo r ON r.id = j.repo_id
""",
    "f_symbol": """
SELECT /*+ MERGE(i) */ DISTINCT i.org_id, i.repo_id, i.id AS index_id,
       CONCAT('pkg ', p.p_brand, '/', p.p_name, '().') AS symbol, p.p_name AS display_name,
       LOWER(p.p_type) AS kind, CONCAT('internal/', LOWER(p.p_type), '/file', CAST(p.p_size AS VARCHAR(10)), '.go') AS file_path
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN f_index i ON i.id = l.l_orderkey
""",
    "f_occurrence": """
SELECT /*+ MERGE(i) */ i.org_id, i.repo_id, i.id AS index_id, l.l_linenumber AS ordinal,
       CONCAT('pkg ', p.p_brand, '/', p.p_name, '().') AS symbol,
       CONCAT('cmd/s', CAST(l.l_suppkey AS VARCHAR(10)), CASE WHEN l.l_suppkey % 5 = 0 THEN '_test.go' ELSE '.go' END) AS file_path,
       CAST(l.l_quantity AS INT) AS start_line,
       CASE l.l_returnflag WHEN 'A' THEN 'DEFINITION' WHEN 'R' THEN 'REFERENCE' ELSE 'IMPORT' END AS role
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN f_index i ON i.id = l.l_orderkey
""",
    "f_edge": """
SELECT /*+ MERGE(i) */ i.org_id, i.repo_id, i.id AS graph_index_id, l.l_linenumber AS ordinal,
       CONCAT('cg:o', CAST(i.org_id AS VARCHAR(10)), ':part:', CAST(l.l_partkey AS VARCHAR(10))) AS src,
       CONCAT('cg:o', CAST(i.org_id AS VARCHAR(10)), ':supp:', CAST(l.l_suppkey AS VARCHAR(10))) AS dst,
       CASE (l.l_orderkey + l.l_linenumber) % 9 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'REFERENCES' WHEN 2 THEN 'IMPORTS_FROM'
            WHEN 3 THEN 'DEFINES' WHEN 4 THEN 'IMPLEMENTS' WHEN 5 THEN 'CONTAINS' WHEN 6 THEN 'HANDLES' WHEN 7 THEN 'TYPE_DEFINES'
            ELSE 'IMPORTS' END AS relation,
       CASE l.l_linenumber % 5 WHEN 0 THEN 'scip' WHEN 1 THEN 'ast-go' WHEN 2 THEN 'anchor-linker' WHEN 3 THEN 'tree-sitter-python' ELSE 'heuristic' END AS source,
       ROUND(1.0 - l.l_discount, 2) AS confidence,
       CONCAT(CASE l.l_suppkey % 4 WHEN 0 THEN 'pkg/webhook/s' WHEN 1 THEN 'lib/test/s' ELSE 'internal/s' END, CAST(l.l_suppkey AS VARCHAR(10)),
              CASE WHEN l.l_suppkey % 5 = 0 THEN '_test.go' WHEN l.l_suppkey % 5 = 1 THEN '/sdk.py' ELSE '.go' END) AS source_file,
       CAST(l.l_quantity AS INT) AS start_line,
       CASE WHEN l.l_linenumber = 7 THEN CONCAT('CALLS ', CAST(l.l_partkey AS VARCHAR(10)), '.') ELSE CONCAT('ship ', l.l_returnflag) END AS evidence,
       CASE WHEN l.l_suppkey % 3 = 0 THEN NULL ELSE l.l_linestatus END AS rationale
FROM lineitem l JOIN f_index i ON i.id = l.l_orderkey
""",
    "f_vertex": """
SELECT e.vid, e.org_id, e.repo_id, CONCAT('ws', CAST(e.repo_id % 2 AS VARCHAR(10))) AS workspace_id,
       CASE e.k % 7 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'file' WHEN 3 THEN 'package' WHEN 4 THEN 'symbol' WHEN 5 THEN 'route' ELSE 'parameter' END AS kind,
       CONCAT(CASE WHEN e.k % 11 = 0 THEN 'fmt.' WHEN e.k % 13 = 0 THEN 'scip npm ' WHEN e.k % 17 = 0 THEN 'local 7 ' ELSE '' END, p.p_brand, '/', p.p_name) AS key,
       CONCAT(CASE e.k % 9 WHEN 0 THEN 'nodejs ' WHEN 1 THEN 'Python ' WHEN 2 THEN 'golang ' ELSE '' END, p.p_name) AS label,
       CASE WHEN e.k % 3 = 0 THEN '' ELSE CONCAT(CASE WHEN e.k % 5 = 0 THEN 'src/test/' ELSE 'src/' END, CAST(e.k AS VARCHAR(10)), '.py') END AS path,
       CASE WHEN e.k % 7 = 5 THEN CONCAT('/api/', CAST(e.k AS VARCHAR(10))) END AS route_path
FROM (SELECT src AS vid, org_id, MIN(repo_id) AS repo_id, CAST(split_part(src, ':', 4) AS BIGINT) AS k FROM f_edge GROUP BY src, org_id) e JOIN part p ON p.p_partkey = e.k
UNION ALL
SELECT e.vid, e.org_id, e.repo_id, CONCAT('ws', CAST(e.repo_id % 2 AS VARCHAR(10))), 'method', s.s_name,
       CONCAT(CASE e.k % 4 WHEN 0 THEN 'nodejs webhook ' WHEN 1 THEN 'logger. ' ELSE '' END, s.s_name), CONCAT('lib/', CASE WHEN e.k % 2 = 0 THEN 'python/' ELSE 'go/' END, CAST(e.k AS VARCHAR(10))), NULL
FROM (SELECT dst AS vid, org_id, MIN(repo_id) AS repo_id, CAST(split_part(dst, ':', 4) AS BIGINT) AS k FROM f_edge GROUP BY dst, org_id) e JOIN supplier s ON s.s_suppkey = e.k
""",
    "f_link": """
SELECT e.org_id, e.repo_id, e.graph_index_id, e.ordinal, e.src, e.dst, e.relation, e.source, CASE WHEN e.ordinal % 3 = 0 THEN NULL WHEN e.ordinal % 3 = 1 THEN ' ' ELSE e.source END AS provenance, e.confidence,
       CASE e.relation WHEN 'CALLS' THEN 'call' WHEN 'REFERENCES' THEN 'reference' WHEN 'IMPORTS_FROM' THEN 'import' WHEN 'DEFINES' THEN 'definition' WHEN 'IMPLEMENTS' THEN 'inherits' WHEN 'TYPE_DEFINES' THEN 'type' WHEN 'CONTAINS' THEN 'containment' END AS context,
       e.source_file AS evidence_path, e.start_line, CONCAT('ws', CAST(e.repo_id % 2 AS VARCHAR(10))) AS workspace_id, i.revision, CONCAT('c', CAST(e.graph_index_id AS VARCHAR(20))) AS commit_hash
FROM f_edge e JOIN f_index i ON i.id = e.graph_index_id
""",
    "f_policy": """
SELECT r.id, r.org_id, r.name, r.default_branch, CASE WHEN r.id % 9 = 8 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS indexed_at,
       CASE r.id % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{"branches":["release*","main"],"tags":["v1*"],"indexedRevisions":["refs/heads/main","refs/heads/release-2","refs/tags/v1.0","refs/tags/v2.0","refs/heads/dev"]}'
       WHEN 2 THEN '{"branches":["*"],"indexedRevisions":["refs/heads/dev","refs/heads/a-b","refs/heads/dev"]}' WHEN 3 THEN '{"indexedRevisions":["refs/heads/main","refs/heads/dev","abc123"]}'
       WHEN 4 THEN '{"branches":["hotfix/?","topic"],"indexedRevisions":["refs/heads/hotfix/1","refs/heads/hotfix/22"]}' ELSE '{"branches":["[bad","dev"],"tags":[],"indexedRevisions":["","refs/heads/dev"]}' END AS metadata,
       CASE WHEN r.id % 10 = 7 THEN 'REMOVE_INDEX' ELSE 'INDEX' END AS job_type, CASE r.id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END AS job_status
FROM f_repo r
""",
    "f_graph": """
SELECT i.id, i.org_id, i.repo_id, CONCAT('ws', CAST(i.repo_id % 2 AS VARCHAR(10))) AS workspace_id, i.revision,
       CASE i.id % 11 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'PARTIAL' WHEN 4 THEN 'DELETING' WHEN 5 THEN 'PENDING' WHEN 6 THEN 'ODD' ELSE 'READY' END AS status,
       i.indexed_at, i.updated_at, CASE WHEN i.id % 3 = 0 THEN i.updated_at END AS superseded_at, CAST(i.id % 4 AS INT) AS revisions, e.n AS edge_count,
       CASE WHEN i.id % 5 = 0 THEN 0 ELSE e.n END AS anchor_count, CASE WHEN i.id % 7 = 0 THEN 0 ELSE e.n END AS linked_edge_count, CASE WHEN i.id % 2 = 0 THEN 0 ELSE e.n END AS semantic_edge_count
FROM f_index i JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) e ON e.l_orderkey = i.id
""",
    "f_scip": """
SELECT i.id, i.org_id, i.repo_id, i.revision, CASE i.id % 8 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'INDEXING' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'PENDING' ELSE 'READY' END AS status,
       CASE WHEN i.id % 9 = 0 THEN 0 ELSE i.id % 50 END AS occurrence_count, i.id % 6 AS symbol_count, i.id % 4 AS relationship_count, i.indexed_at, i.updated_at
FROM f_index i
""",
    "f_repo_manifest": """
SELECT i.id, i.repo_id, CONCAT('ws', CAST(i.repo_id % 2 AS VARCHAR(10))) AS workspace_id, i.revision AS branch, CASE i.id % 4 WHEN 0 THEN 'PENDING' ELSE 'READY' END AS status,
       i.id % 5 AS file_count, CASE WHEN i.id % 3 = 0 THEN 0 WHEN i.id % 3 = 1 THEN i.id % 5 ELSE 1 END AS file_rows, CASE WHEN i.id % 2 = 0 THEN 'FULL_REPO' WHEN i.id % 7 = 0 THEN NULL ELSE 'DELTA_FILES' END AS lexical_strategy,
       i.id % 2 AS changed_files, i.id % 6 AS deleted_files, CASE WHEN i.id % 8 = 1 THEN i.updated_at END AS superseded_at
FROM f_index i
""",
    "f_lease": """
SELECT s.id, j.id AS job_id, s.created_at, s.layer, CASE s.id % 8 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RETRYING' WHEN 2 THEN 'CLAIMED' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'ARTIFACT_WRITTEN' WHEN 5 THEN 'VALIDATING' WHEN 6 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       CAST(s.id % 4 AS INT) AS attempt, 3 AS max_attempts, CONCAT('w', CAST(s.id % 3 AS VARCHAR(5))) AS lease_owner, CONCAT('a', CAST(s.id % 5 AS VARCHAR(5))) AS attempt_id,
       CASE WHEN s.id % 7 = 0 THEN NULL ELSE CAST(s.id * 37 % 1000 AS INT) END AS lease_expires_at,
       CONCAT('ws', CAST(CAST(FLOOR(s.id / 8) AS BIGINT) % 2 AS VARCHAR(5))) AS workspace_id, j.id % 50 AS repo_id, CASE CAST(FLOOR(s.id / 8) AS BIGINT) % 3 WHEN 0 THEN 'dev' ELSE 'main' END AS branch, CASE CAST(FLOOR(s.id / 8) AS BIGINT) % 3 WHEN 0 THEN 'refs/heads/dev' ELSE 'refs/heads/main' END AS revision, CONCAT('c', CAST(CAST(FLOOR(s.id / 8) AS BIGINT) % 4 AS VARCHAR(5))) AS commit_hash
FROM f_subjob s JOIN (SELECT id, id - (SELECT MIN(id) FROM f_job) + 1 AS n FROM f_job) j ON j.n = s.job_id
""",
    "f_source": """
SELECT k, language, path, REPLACE(REPLACE(body, '~', CHR(10)), '@', CAST(k AS VARCHAR(20))) AS content FROM (
SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 3 THEN 'ruby' WHEN 4 THEN 'rust' WHEN 5 THEN 'csharp' ELSE 'dart' END AS language,
       CONCAT('src/f', CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 7 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.java' WHEN 3 THEN '.rb' WHEN 4 THEN '.rs' WHEN 5 THEN '.cs' ELSE '.dart' END) AS path,
       CASE p_partkey % 7 WHEN 0 THEN 'package a~import (~"fmt"~"net/x@"~)~func (r *T) Fn@() {~ help@(1)~ if (x) { Fn@(2) }~}~out@()~'
       WHEN 1 THEN 'from a@ import b, c as d~class K@(B@, x.Y, 7):~    def go@(self):~        return os.run@(print(1))~out@()~'
       WHEN 2 THEN 'import a.b@;~public class K@ extends P@<T> implements I@, J {~  public int run@(int a) {~    help@(a);~  }~}~'
       WHEN 3 THEN 'require "x@"~class K@ < P@~  def go@~    help@(1)~  end~  out@(2)~end~'
       WHEN 4 THEN 'use std::x@;~pub struct S@ {~}~pub fn go@() {~    help::run@(1);~    Some(2);~}~out@();~'
       WHEN 5 THEN 'using A.B@;~public class K@ : P@, I@ {~  void go() { help@(1); }~}~'
       ELSE 'import "./x@";~class K@ extends P@ {~  void go() { help@(1); }~}~' END AS body FROM part) x
""",
    "f_code": """
SELECT k, path, CASE k % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' ELSE 'markdown' END AS language, LENGTH(said) - LENGTH(REPLACE(said, CHR(10), '')) + 1 AS above, CONCAT(said, CHR(10), REPLACE(REPLACE(body, '~', CHR(10)), '@', CAST(k AS VARCHAR(20)))) AS content
FROM (SELECT doc_id AS k, path, COALESCE(content, '') AS said, CASE doc_id % 4 WHEN 0 THEN 'package a~import "net/x@"~func Fn@() {~ help@(1)~}~' WHEN 1 THEN 'import os@~class K@(B@):~    def go(self):~        return os.run@(1)~'
             WHEN 2 THEN 'import { a } from "./x@";~export class K@ extends P@ implements I@ {~}~export async function go@() {~  help@(2);~}~' ELSE '# K@' END AS body FROM f_file) x
""",
    "f_file": """
SELECT doc_id, source AS repo_name, CASE WHEN doc_id % 5 = 0 THEN 'release' ELSE 'main' END AS branch,
       CONCAT(CASE WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 7 = 0 THEN 'tests/' ELSE 'src/' END,
              lang, '/d', CAST(doc_id AS VARCHAR(10)),
              CASE doc_id % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' ELSE '.md' END) AS path,
       lang, text AS content
FROM documents
""",
    "f_path": """
SELECT doc_id, CONCAT(CASE doc_id % 13 WHEN 0 THEN 'web/node_modules/' WHEN 1 THEN 'third_party/' WHEN 2 THEN 'app/.venv/' WHEN 3 THEN 'dist/' WHEN 4 THEN 'vendor/bundle/'
              WHEN 5 THEN 'src/coverage/' WHEN 6 THEN 'pkg/gen/' WHEN 7 THEN 'ui/__tests__/' WHEN 8 THEN 'spec/' WHEN 9 THEN 'mytest/' WHEN 10 THEN 'tests/' ELSE 'src/' END,
              'd', CAST(doc_id AS VARCHAR(10)),
              CASE doc_id % 17 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.test.ts' WHEN 3 THEN '.spec.jsx' WHEN 4 THEN '.min.js' WHEN 5 THEN '.generated.cs' WHEN 6 THEN '.kt'
              WHEN 7 THEN '.hpp' WHEN 8 THEN '.RB' WHEN 9 THEN '.rs' WHEN 10 THEN '.dart' WHEN 11 THEN '.mdx' WHEN 12 THEN '.yaml' WHEN 13 THEN '' WHEN 14 THEN '.test.' WHEN 15 THEN '.Vb' ELSE '_test.go' END) AS path
FROM documents
""",
    "f_tree": """
SELECT source AS repo_name, CONCAT(CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'apps/web/' WHEN 2 THEN 'apps/web/admin/' WHEN 3 THEN 'svc/api/' WHEN 4 THEN 'web/node_modules/x/' WHEN 5 THEN 'java/app/' WHEN 6 THEN 'java/app/src/main/'
              WHEN 7 THEN 'lib/src/ui/' WHEN 8 THEN 'app/coverage/' WHEN 9 THEN 'vendor/y/' WHEN 10 THEN 'apps/' WHEN 11 THEN 'java/' ELSE 'tools/Src/' END,
              CASE doc_id % 17 WHEN 0 THEN 'package.json' WHEN 1 THEN 'src/app.ts' WHEN 2 THEN 'Index.TSX' WHEN 3 THEN 'go.mod' WHEN 4 THEN 'setup.cfg' WHEN 5 THEN 'pom.xml' WHEN 6 THEN 'src/Main.java' WHEN 7 THEN 'App.kt' WHEN 8 THEN 'x.csproj' WHEN 9 THEN 'Gemfile'
              WHEN 10 THEN 'a.gemspec' WHEN 11 THEN 'Cargo.toml' WHEN 12 THEN 'types.d.ts' WHEN 13 THEN 'lib.min.js' WHEN 14 THEN 'tsconfig.json' WHEN 15 THEN 'build.sbt' ELSE 'src/lib/b.cjs' END) AS path
FROM documents
""",
    "f_manifest_prev": """
SELECT path, CAST(LENGTH(content) AS BIGINT) AS content_hash, repo_name, branch FROM f_file WHERE doc_id % 10 <> 0
""",
    "f_manifest_cur": """
SELECT path, CAST(LENGTH(content) + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS BIGINT) AS content_hash, repo_name, branch
FROM f_file WHERE doc_id % 10 <> 1
""",
    "f_subjob": """
SELECT event_id AS id, user_id AS job_id, ts AS created_at,
       CASE event_type WHEN 'click' THEN 'CLONE' WHEN 'view' THEN 'ZOEKT' WHEN 'signup' THEN 'AST_TREE_SITTER'
            WHEN 'purchase' THEN 'SCIP' ELSE 'ACTIVATE' END AS layer,
       CASE CAST(FLOOR(value) AS BIGINT) % 6 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RETRYING' WHEN 2 THEN 'RUNNING'
            WHEN 3 THEN 'FAILED' WHEN 4 THEN 'SKIPPED' ELSE 'SUCCEEDED' END AS status,
       CAST(event_id % 4 AS INT) AS attempt, 3 AS max_attempts
FROM events
""",
}


#: Lines of orders that one task joins, sorts and makes distinct.
TOGETHER = 200_000


def needed(text: str) -> list[str]:
    """The views that a statement reads, directly or through others, each after those that it reads."""
    out: list[str] = []

    def visit(statement: str) -> None:
        for name in re.findall(r"\bf_\w+", statement):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(text)
    return out


def oracle(body: str) -> str:
    """A statement with the views it reads in front; it may start with its own WITH list."""
    parts = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed(body))
    body = body.strip()
    if not parts:
        return body
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"


class Frames:
    """The views of one data folder as DataFrames: ``frames.f_repo``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @functools.cached_property
    def lines(self) -> int:
        return self.table("lineitem").count()  # from the footers

    def dealt(self, orders: DataFrame) -> DataFrame:
        """Orders over as many tasks as their lines ask for, which the lines that meet them follow. Lines are short on disk, so
        that Spark, which deals by bytes, gives one task millions of them, and their texts are long in memory."""
        return orders.repartition(self.parts, "o_orderkey") if self.parts else orders

    @functools.cached_property
    def parts(self) -> int:
        """Tasks that lines ask for, 0 where Spark's own number will do."""
        parts = -(-self.lines // TOGETHER)
        return max(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if parts > self.spark.sparkContext.defaultParallelism else 0

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        statement = oracle(f"SELECT * FROM {name}").replace("{", "{{").replace("}", "}}")
        used = sorted({t for t in TABLES if re.search(rf"\b{t}\b", statement)})
        tables = {t: self.table(t) for t in used}
        if {"lineitem", "orders"} <= tables.keys():
            tables["orders"] = self.dealt(tables["orders"])
            if self.parts:  # indexes once more, as they have met their repositories, which may be too many to broadcast
                index = VIEWS["f_index"].strip()
                statement = statement.replace(f"f_index AS ({index})", f"f_index AS (SELECT /*+ REPARTITION({self.parts}, id) */ * FROM ({index}) i)")
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", statement), **tables)
