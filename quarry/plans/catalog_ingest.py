"""Named queries on compiled symbol indexes: artifacts are written from the tables, read back and turned into rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import graph, ingest, projects
from quarry.plans.catalog import query
from quarry.sources import artifact

#: What an index holds here: a document for each file of its occurrences, the symbols defined there, and those that are used only, as external ones.
USED = "SELECT index_id, ordinal, symbol, file_path, start_line, CASE role WHEN 'DEFINITION' THEN 1 WHEN 'IMPORT' THEN 2 ELSE CASE WHEN ordinal % 2 = 0 THEN 8 ELSE 0 END END AS mask, CAST(start_line % 40 AS INT) AS syntax FROM f_occurrence"
KIND = "CAST(16 + ordinal AS INT)"


def _artifacts(f):
    used = f.f_occurrence.select(
        "index_id", "ordinal", "symbol", "file_path", "start_line", F.expr("CASE role WHEN 'DEFINITION' THEN 1 WHEN 'IMPORT' THEN 2 ELSE CASE WHEN ordinal % 2 = 0 THEN 8 ELSE 0 END END").alias("mask"), F.expr("CAST(start_line % 40 AS INT)").alias("syntax"),
    )
    used = used.withColumn("least", F.min(F.when(F.col("mask") == 1, F.col("symbol"))).over(Window.partitionBy("index_id")))  # and all that follows by index, in one pass
    around = F.when(F.col("mask") == 1, F.array("start_line", F.lit(0), (F.col("start_line") + F.col("ordinal") * 5).cast("int"), F.lit(9)))
    occurrence = F.struct(F.col("ordinal"), F.struct(F.array("start_line", F.lit(1), F.lit(5)).alias("range"), "symbol", F.col("mask").alias("symbol_roles"), F.col("syntax").alias("syntax_kind"), F.coalesce(around, F.array().cast("array<int>")).alias("enclosing_range")).alias("o"))
    related = F.array(F.struct(F.col("least").alias("symbol"), (F.col("ordinal") % 2 == 0).alias("is_reference"), (F.col("ordinal") % 3 == 0).alias("is_implementation"), F.lit(False).alias("is_type_definition"), F.lit(False).alias("is_definition")))
    info = F.struct(
        F.col("ordinal"),
        F.struct("symbol", F.array(F.concat(F.lit("says "), "symbol")).alias("documentation"), related.alias("relationships"), F.expr(KIND).alias("kind"), F.when(F.col("ordinal") % 2 == 0, "").otherwise(F.lit("shown")).alias("display_name"), F.struct(F.lit("sig").alias("text")).alias("signature"), F.lit("").alias("enclosing_symbol")).alias("s"),
    )
    documents = used.groupBy("index_id", "file_path").agg(F.sort_array(F.collect_list(occurrence)).alias("os"), F.sort_array(F.collect_list(F.when(F.col("mask") == 1, info))).alias("ss"), F.collect_set(F.when(F.col("mask") != 1, F.col("symbol"))).alias("es"))
    documents = documents.select("index_id", "es", F.struct(F.col("file_path").alias("relative_path"), F.transform("os", lambda x: x["o"]).alias("occurrences"), F.transform("ss", lambda x: x["s"]).alias("symbols"), F.lit("go").alias("language")).alias("d"))
    rows = documents.groupBy("index_id").agg(F.sort_array(F.collect_list("d")).alias("documents"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("es")))).alias("names"))
    named = F.transform("names", lambda n: F.struct(n.alias("symbol"), F.lit(7).alias("kind")))
    projects = f.f_index.select("id", F.lit("typescript").alias("project_language"), F.when(F.col("id") % 2 == 0, "app/").otherwise(F.lit(".")).alias("project_root"))
    rows = rows.select(F.col("index_id").alias("id"), "documents", named.alias("external_symbols")).join(projects, "id")  # where the index's rows are, so no artifact moves
    return artifact.encoded(rows)


def _documents(f):
    """All documents of an index lie in one task."""
    return ingest.placed(artifact.documents(_artifacts(f)))


PATH = "CONCAT(CASE WHEN index_id % 2 = 0 THEN 'app/' ELSE '' END, file_path)"
NUMBERED = f"SELECT *, {PATH} AS path, DENSE_RANK() OVER (PARTITION BY index_id ORDER BY file_path) AS doc, ROW_NUMBER() OVER () AS rid FROM ({USED}) u"
SYNTAX = "list_element(['Comment', 'PunctuationDelimiter', 'PunctuationBracket', 'Keyword', 'IdentifierOperator', 'Identifier', 'IdentifierBuiltin', 'IdentifierNull', 'IdentifierConstant', 'IdentifierMutableGlobal', 'IdentifierParameter', 'IdentifierLocal', 'IdentifierShadowed', 'IdentifierNamespace', 'IdentifierFunction', 'IdentifierFunctionDefinition', 'IdentifierMacro', 'IdentifierMacroDefinition', 'IdentifierType', 'IdentifierBuiltinType', 'IdentifierAttribute', 'RegexEscape', 'RegexRepeated', 'RegexWildcard', 'RegexDelimiter', 'RegexJoin', 'StringLiteral', 'StringLiteralEscape', 'StringLiteralSpecial', 'StringLiteralKey', 'CharacterLiteral', 'NumericLiteral', 'BooleanLiteral', 'Tag', 'TagAttribute', 'TagDelimiter'], syntax)"
AROUND = f"""SELECT o.*, d.symbol AS enclosing FROM ({NUMBERED}) o LEFT JOIN (SELECT * FROM ({NUMBERED}) n WHERE mask = 1) d ON d.index_id = o.index_id AND d.doc = o.doc AND d.symbol <> o.symbol AND d.start_line <= o.start_line AND d.start_line + d.ordinal * 5 >= o.start_line
QUALIFY ROW_NUMBER() OVER (PARTITION BY o.rid ORDER BY d.ordinal * 500000, d.ordinal, d.start_line, d.symbol) = 1"""
ROLES = f"""SELECT a.*, UNNEST(CASE mask WHEN 1 THEN ['DEFINITION'] WHEN 2 THEN ['REFERENCE', 'IMPORT'] WHEN 8 THEN ['REFERENCE', 'READ'] ELSE ['REFERENCE'] END) AS role FROM ({AROUND}) a"""


@query("artifact_occurrences", f"SELECT index_id AS id, path AS file_path, symbol, role, start_line, 'go' AS language, {SYNTAX} AS syntax_kind, enclosing FROM ({ROLES}) r")
def _(f):
    return ingest.occurrences(_documents(f), whole=True).select("id", "file_path", "symbol", "role", "start_line", "language", "syntax_kind", "enclosing")


LAST = f"SELECT index_id, symbol, arg_max(path, doc * 100 + ordinal) AS file_path, arg_max(start_line, doc * 100 + ordinal) AS start_line FROM ({NUMBERED}) n WHERE mask = 1 GROUP BY 1, 2"
NAME = "list_filter(regexp_split_to_array(n.symbol, '[/#.:!()\\[\\]]'), lambda p: p <> '')[-1]"


@query(
    "artifact_symbols",
    f"""SELECT n.index_id AS id, n.symbol, CASE WHEN ordinal % 2 = 0 THEN {NAME} ELSE 'shown' END AS display_name, list_element(['Function', 'Getter', 'Grammar', 'Instance', 'Interface', 'Key', 'Lang'], ordinal) AS kind, 'go' AS language, 'sig' AS signature, l.file_path, l.start_line
FROM ({NUMBERED}) n JOIN ({LAST}) l ON l.index_id = n.index_id AND l.symbol = n.symbol WHERE mask = 1
UNION ALL SELECT index_id, n.symbol, {NAME}, 'Class', 'typescript', NULL, NULL, NULL FROM (SELECT DISTINCT index_id, symbol FROM ({USED}) u WHERE mask <> 1) n""",
)
def _(f):
    return ingest.symbols(graph.kept(_documents(f))).select("id", "symbol", "display_name", "kind", "language", "signature", "file_path", "start_line")


@query(
    "artifact_relationships",
    f"""WITH d AS (SELECT DISTINCT index_id, symbol FROM ({USED}) u WHERE mask = 1), l AS (SELECT index_id, MIN(symbol) AS least FROM d GROUP BY 1)
SELECT DISTINCT n.index_id AS id, n.symbol AS source, l.least AS target, ordinal % 2 = 0 AS is_reference, ordinal % 3 = 0 AS is_implementation, FALSE AS is_type_definition, FALSE AS is_definition FROM ({USED}) n JOIN l ON l.index_id = n.index_id WHERE mask = 1
UNION SELECT r.index_id, enclosing, r.symbol, TRUE, FALSE, FALSE, FALSE FROM ({ROLES}) r JOIN d ON d.index_id = r.index_id AND d.symbol = r.symbol WHERE role = 'REFERENCE' AND enclosing IS NOT NULL""",
)
def _(f):
    return ingest.relationships(_documents(f)).select("id", "source", "target", *ingest.FLAGS)


#: Every project by its definition: each marker is held against every file of its repository.
TREE = "SELECT DISTINCT repo_name, path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/?[^/]*$', '') AS folder, LOWER(path) AS low FROM f_tree WHERE NOT regexp_matches(path, '(^|/)([.]git|node_modules|[.]next|dist|build|target|[.]venv|venv|__pycache__|vendor)(/|$)')"
INSIDE = "({1} = '' OR starts_with({0}, CONCAT({1}, '/')))"
PROJECTS = f"""WITH t AS ({TREE}),
k AS (SELECT DISTINCT repo_name, folder AS root, CASE WHEN base IN ('package.json', 'tsconfig.json', 'jsconfig.json') THEN 'typescript' WHEN base = 'go.mod' THEN 'go' WHEN base = 'setup.cfg' THEN 'python' WHEN base IN ('pom.xml', 'build.sbt') THEN 'java'
WHEN base LIKE '%.csproj' THEN 'dotnet' WHEN base = 'Gemfile' OR base LIKE '%.gemspec' THEN 'ruby' WHEN base = 'Cargo.toml' THEN 'rust' END AS language FROM t),
i AS (SELECT * FROM t WHERE regexp_matches(low, '[.](ts|tsx|js|jsx|mts|cts|mjs|cjs)$') AND low NOT LIKE '%.d.ts' AND low NOT LIKE '%.min.js' AND NOT regexp_matches(path, '(^|/)coverage/')),
s AS (SELECT DISTINCT k.repo_name, k.root FROM k JOIN i ON i.repo_name = k.repo_name AND k.language = 'typescript' AND {INSIDE.format('i.path', 'k.root')}
WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.repo_name = k.repo_name AND c.language = 'typescript' AND c.root <> k.root AND LENGTH(c.root) > LENGTH(k.root) AND {INSIDE.format('c.root', 'k.root')} AND {INSIDE.format('i.path', 'c.root')})),
n AS (SELECT DISTINCT i.repo_name, CASE WHEN regexp_matches(SUBSTR(path, strpos(path, '/')), '^/([^/]+/)*?src/') AND strpos(path, '/') > 0 THEN regexp_replace(regexp_extract(path, '^[^/]+/(?:[^/]+/)*?src/'), '/src/$', '') ELSE '' END AS root FROM i
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo_name = i.repo_name AND {INSIDE.format('i.path', 's.root')})),
a AS (SELECT repo_name, root, 'typescript' AS language FROM s UNION SELECT repo_name, root, 'typescript' FROM n UNION SELECT repo_name, root, language FROM k WHERE language NOT IN ('typescript', 'java')
UNION SELECT k.repo_name, k.root, 'java' FROM k WHERE language = 'java' AND EXISTS (SELECT 1 FROM t WHERE t.repo_name = k.repo_name AND {INSIDE.format('t.path', 'k.root')} AND regexp_matches(low, '[.](java|scala|kt)$') AND regexp_matches(SUBSTR(low, LENGTH(k.root) + 1), '(^|/)src/')))
SELECT *, CASE language WHEN 'typescript' THEN 'scip-typescript' WHEN 'go' THEN 'scip-go' WHEN 'python' THEN 'scip-python' WHEN 'java' THEN 'scip-java' WHEN 'dotnet' THEN 'scip-dotnet' WHEN 'ruby' THEN 'scip-ruby' ELSE 'rust-analyzer' END AS indexer,
CASE language WHEN 'typescript' THEN 'ts-js' WHEN 'java' THEN 'jvm' WHEN 'rust' THEN 'rust-dart' ELSE language END AS worker_class FROM a"""


@query("detected_projects", PROJECTS)
def _(f):
    return projects.detected(f.f_tree)


@query("planned_projects", f"SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY repo_name, runnable ORDER BY root, language) AS INT) AS place FROM (SELECT *, worker_class IN ('ts-js', 'go', 'jvm') AS runnable FROM ({PROJECTS}) p) x) y WHERE place <= 4")
def _(f):
    return projects.planned(projects.detected(f.f_tree), "ts-js, go,jvm,", 4)
