"""Named queries that read facts from sources and build a graph of them. Expected facts are stated by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import build, extract
from quarry.plans.catalog import query

MODULE = ("module:%", "%", "module")
#: Facts of a source of each language: kind, source, target, line; ``@`` is the source's number and ``%`` its path.
EXPECTED = {
    "go": (
        ("imports_from", MODULE, ("module:fmt", "fmt", "external"), 1), ("imports_from", MODULE, ("module:net/x@", "net/x@", "external"), 1),
        ("defines", MODULE, ("function:%:Fn@", "Fn@", "function"), 6), ("calls", ("function:%:Fn@", "Fn@", "function"), ("function:?:help@", "help@", "function"), 7),
    ),
    "python": (
        ("imports_from", MODULE, ("module:a@", "a@", "external"), 1), ("imports_from", MODULE, ("symbol:a@:b", "a@.b", "symbol"), 1), ("imports_from", MODULE, ("symbol:a@:c", "a@.c", "symbol"), 1),
        ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:B@", "B@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:x.Y", "x.Y", "class"), 2),
        ("defines", MODULE, ("function:%:go@", "go@", "function"), 3), ("calls", ("function:%:go@", "go@", "function"), ("function:?:os.run@", "os.run@", "function"), 4),
    ),
    "java": (
        ("imports_from", MODULE, ("module:a.b@", "a.b@", "external"), 1), ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:P@", "P@", "class"), 2),
        ("implements", ("class:%:K@", "K@", "class"), ("interface:?:I@", "I@", "interface"), 2), ("implements", ("class:%:K@", "K@", "class"), ("interface:?:J", "J", "interface"), 2),
        ("defines", ("class:%:K@", "K@", "module"), ("class:%:K@#run@", "run@", "method"), 3), ("calls", MODULE, ("function:?:run@", "run@", "function"), 3), ("calls", MODULE, ("function:?:help@", "help@", "function"), 4),
    ),
    "ruby": (
        ("imports_from", MODULE, ("module:x@", "x@", "external"), 1), ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:P@", "P@", "class"), 2),
        ("defines", MODULE, ("function:%:go@", "go@", "function"), 3), ("calls", ("function:%:go@", "go@", "function"), ("function:?:help@", "help@", "function"), 4),
    ),
    "rust": (
        ("imports_from", MODULE, ("module:std::x@", "std::x@", "external"), 1), ("defines", MODULE, ("class:%:S@", "S@", "class"), 2), ("defines", MODULE, ("function:%:go@", "go@", "function"), 4),
        ("calls", ("function:%:go@", "go@", "function"), ("function:?:help::run@", "help::run@", "function"), 5),
    ),
    "csharp": (
        ("imports_from", MODULE, ("module:A.B@", "A.B@", "external"), 1), ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:P@", "P@", "class"), 2),
        ("extends", ("class:%:K@", "K@", "class"), ("class:?:I@", "I@", "class"), 2), ("calls", MODULE, ("function:?:go", "go", "function"), 3), ("calls", MODULE, ("function:?:help@", "help@", "function"), 3),
    ),
    "dart": (
        ("imports_from", MODULE, ("module:./x@", "./x@", "module"), 1), ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:P@", "P@", "class"), 2),
        ("calls", MODULE, ("function:?:go", "go", "function"), 3), ("calls", MODULE, ("function:?:help@", "help@", "function"), 3),
    ),
}


def _filled(value: str) -> str:
    return f"REPLACE(REPLACE('{value}', '@', CAST(k AS VARCHAR(20))), '%', path)"


def _fact(language: str, i: int, kind: str, source: tuple, target: tuple, line: int) -> str:
    named = ", ".join(f"{_filled(v)} AS {n}" if n[-4:] != "kind" else f"'{v}' AS {n}" for n, v in zip(("source", "source_name", "source_kind", "target", "target_name", "target_kind"), (*source, *target), strict=True))
    return f"SELECT k, path, {i} AS ordinal, language, '{kind}' AS kind, {named}, {line} AS line, CAST(0.6 AS DOUBLE) AS confidence FROM f_source WHERE language = '{language}'"


FACTS = " UNION ALL ".join(_fact(lang, i, *fact) for lang, facts in EXPECTED.items() for i, fact in enumerate(facts))


@query("extract_facts", f"SELECT path, ordinal, language, kind, source, source_name, source_kind, target, target_name, target_kind, line, confidence FROM ({FACTS}) x")
def _(f):
    return extract.facts(f.f_source)


#: Facts of the sources that stand below the text of each file; a Go import counts as of line 1 wherever it stands.
BELOW = {
    "go": (("imports_from", MODULE, ("module:net/x@", "net/x@", "external"), "1 - above"), ("defines", MODULE, ("function:%:Fn@", "Fn@", "function"), 3), ("calls", ("function:%:Fn@", "Fn@", "function"), ("function:?:help@", "help@", "function"), 4)),
    "python": (
        ("imports_from", MODULE, ("module:os@", "os@", "external"), 1), ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:B@", "B@", "class"), 2),
        ("defines", MODULE, ("function:%:go", "go", "function"), 3), ("calls", ("function:%:go", "go", "function"), ("function:?:os.run@", "os.run@", "function"), 4),
    ),
    "typescript": (
        ("imports_from", MODULE, ("module:./x@", "./x@", "module"), 1), ("defines", MODULE, ("class:%:K@", "K@", "class"), 2), ("extends", ("class:%:K@", "K@", "class"), ("class:?:P@", "P@", "class"), 2), ("implements", ("class:%:K@", "K@", "class"), ("interface:?:I@", "I@", "interface"), 2),
        ("defines", MODULE, ("function:%:go@", "go@", "function"), 4), ("calls", ("function:%:go@", "go@", "function"), ("function:?:help@", "help@", "function"), 5),
    ),
}
FILE_FACTS = " UNION ALL ".join(_fact(lang, i, *fact[:3], f"CAST(above + {fact[3]} AS INT)").replace("f_source", "f_code") for lang, facts in BELOW.items() for i, fact in enumerate(facts))


@query("file_facts", f"SELECT path, ordinal, language, kind, source, source_name, source_kind, target, target_name, target_kind, line, confidence FROM ({FILE_FACTS}) x")
def _(f):
    return extract.facts(f.f_code)


def _scoped(f):
    facts = extract.facts(build.dealt(f.f_source)).withColumn("file_order", F.col("path"))
    k = F.regexp_extract("path", "f([0-9]+)", 1).cast("long")
    return facts.withColumns({"org_id": F.lit(1), "workspace_id": F.lit("w"), "repo_id": (k % 3 + 1).cast("int"), "commit_hash": F.lit("0123456789abcdef0123456789abcdef01234567"), "schema_version": F.lit(2), "builder_version": F.lit("b1")})


def vid(kind: str, key: str) -> str:
    return f"CONCAT('cg:o1:w', SUBSTR(sha256('w'), 1, 8), ':r', CAST(repo AS VARCHAR), ':c0123456789ab:s2:b', SUBSTR(sha256('b1'), 1, 8), ':', {kind}, ':', SUBSTR(sha256(CONCAT_WS(chr(0), '1', 'w', CAST(repo AS VARCHAR), '0123456789abcdef0123456789abcdef01234567', '2', 'b1', {kind}, {key})), 1, 32))"


RANK = "CAST(CONCAT('0x', SUBSTR(sha256(CONCAT(src, '->', dst, ':', kind, ':', source)), 1, 8)) AS BIGINT)"
OWN = "CASE source_kind WHEN 'class' THEN 'class' WHEN 'method' THEN 'method' ELSE 'function' END"
TARGET = "CASE target_kind WHEN 'external' THEN 'package' WHEN 'interface' THEN 'class' WHEN 'module' THEN 'file' ELSE target_kind END"
SCOPED = f"SELECT *, k % 3 + 1 AS repo FROM ({FACTS}) x"
VERTICES = f"""SELECT vid, kind, key, label, path, source FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vid ORDER BY spot, ordinal, nth) AS rn FROM (
SELECT {vid("'file'", "CONCAT('file:', path)")} AS vid, 'file' AS kind, path AS key, path AS label, path, 'scip' AS source, path AS spot, ordinal, 0 AS nth FROM ({SCOPED}) a
UNION ALL SELECT {vid(OWN, "CONCAT('ast:', source)")}, {OWN}, source, source_name, path, CONCAT('ast-', language), path, ordinal, 1 FROM ({SCOPED}) b WHERE source_kind <> 'module'
UNION ALL SELECT {vid(TARGET, "CONCAT('ast:', target)")}, {TARGET}, target, target_name, CASE WHEN target_kind <> 'external' THEN path END, CONCAT('ast-', language), path, ordinal, 2 FROM ({SCOPED}) c) u) v WHERE rn = 1"""
EDGES = f"""SELECT * FROM (SELECT *, {RANK} AS rank, ROW_NUMBER() OVER (PARTITION BY src, dst, kind, source ORDER BY spot, ordinal) AS rn FROM (
SELECT CASE WHEN source_kind = 'module' THEN {vid("'file'", "CONCAT('file:', path)")} ELSE {vid(OWN, "CONCAT('ast:', source)")} END AS src, {vid(TARGET, "CONCAT('ast:', target)")} AS dst,
UPPER(kind) AS kind, CONCAT('ast-', language) AS source, confidence, 'INFERRED' AS tier, path, line, path AS spot, ordinal FROM ({SCOPED}) a
UNION ALL SELECT {vid("'repo'", "'repo'")}, {vid("'file'", "CONCAT('file:', path)")}, 'CONTAINS', 'scip', 1.0, 'EXTRACTED', NULL, NULL, path, ordinal FROM ({SCOPED}) b) u) v WHERE rn = 1"""


@query("graph_vertices", VERTICES)
def _(f):
    return build.from_facts(_scoped(f))[0]


@query("graph_edges", f"SELECT src, dst, kind, rank, source, CAST(confidence AS DOUBLE) AS confidence, tier, path, line, CASE kind WHEN 'CALLS' THEN 'call' WHEN 'DEFINES' THEN 'definition' WHEN 'IMPORTS_FROM' THEN 'import' WHEN 'EXTENDS' THEN 'inherits' WHEN 'IMPLEMENTS' THEN 'inherits' WHEN 'CONTAINS' THEN 'containment' END AS context FROM ({EDGES}) e")
def _(f):
    return build.from_facts(_scoped(f))[1]


ANCHORS = f"SELECT DISTINCT vid, CASE WHEN kind = 'file' THEN 'file' ELSE 'symbol' END AS kind, label AS key, LOWER(regexp_replace(TRIM(label), '[^A-Za-z0-9_.:-]+', '_', 'g')) AS normalized FROM ({VERTICES}) x WHERE kind IN ('file', 'function', 'method', 'class', 'symbol') AND LOWER(label) NOT IN ('print', 'println', 'len', 'format', 'string', 'logger', 'log', 'error')"


@query("graph_anchors", ANCHORS)
def _(f):
    return build.anchors(build.from_facts(_scoped(f))[0])


@query(
    "anchor_links",
    f"""WITH n AS (SELECT vid, MIN(normalized) AS name FROM ({ANCHORS}) a GROUP BY vid),
l AS (SELECT e.*, a.name AS a, b.name AS b FROM ({EDGES}) e JOIN n a ON a.vid = e.src JOIN n b ON b.vid = e.dst WHERE e.kind IN ('CALLS', 'REFERENCES', 'IMPORTS', 'IMPORTS_FROM', 'EXTENDS', 'IMPLEMENTS', 'TYPE_DEFINES') AND a.name <> b.name)
SELECT src, dst, 'ANCHOR_LINK' AS kind, rank, source, confidence, normalized_key FROM (SELECT src, dst, CAST(CONCAT('0x', SUBSTR(sha256(CONCAT(src, '->', dst, ':ANCHOR_LINK:anchor-linker')), 1, 8)) AS BIGINT) AS rank, 'anchor-linker' AS source, CAST(LEAST(confidence, 0.9) AS DOUBLE) AS confidence, CONCAT(a, '->', b, ':', LOWER(kind)) AS normalized_key,
ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY kind) AS rn FROM l) x WHERE rn = 1""",
)
def _(f):
    vertices, edges = build.from_facts(_scoped(f))
    return build.anchor_links(edges, build.anchors(vertices))


OCC = """SELECT 1 AS repo, o.index_id * 10 + o.ordinal AS ordinal, o.symbol, CASE WHEN o.start_line % 4 = 0 THEN '' ELSE CONCAT('pkg enc/', CAST(o.start_line AS VARCHAR(10)), '#') END AS enclosing_symbol, CASE o.role WHEN 'REFERENCE' THEN 'READ' ELSE o.role END AS role,
CASE WHEN o.start_line % 5 = 0 THEN 'IdentifierFunction' ELSE 'Identifier' END AS syntax_kind, o.file_path AS path, o.start_line AS line,
CASE o.start_line % 6 WHEN 0 THEN 'import x' WHEN 1 THEN CONCAT('  y = ', regexp_extract(o.symbol, '/(.*)\\(\\)', 1), ' (z)') WHEN 2 THEN ' "quoted" name' WHEN 3 THEN 'a = require(b)' ELSE 'plain' END AS line_content FROM f_occurrence o WHERE o.repo_id <= 3"""
DISPLAY = "regexp_extract(regexp_replace(TRIM(symbol), '[.#)(\\]]+$', ''), '[^/#. (\\[:]*$', 0)"
IMPORTS = "(regexp_matches(LOWER(TRIM(line_content)), '^(import |from |require\\()') OR contains(LOWER(TRIM(line_content)), ' require(') OR (contains(line_content, '\"') AND NOT contains(line_content, '(') AND NOT contains(line_content, '=') AND contains(TRIM(line_content), ' ')))"
CALLS = f"(contains(LOWER(syntax_kind), 'function') OR (strpos(line_content, {DISPLAY}) > 0 AND regexp_matches(SUBSTR(line_content, strpos(line_content, {DISPLAY}) + LENGTH({DISPLAY})), '^[ \\t]*\\(')))"


@query(
    "index_edges",
    f"""WITH o AS ({OCC}), u AS (
SELECT {vid("'symbol'", 'symbol')} AS src, {vid("'symbol'", "CONCAT('pkg enc/', CAST(line AS VARCHAR), '#')")} AS dst, x.kind, x.context, path, line, 0 AS part, ordinal, x.nth FROM o, (VALUES ('REFERENCES', 'reference', 0), ('TYPE_DEFINES', 'type', 2)) x(kind, context, nth) WHERE role = 'DEFINITION' AND (x.nth = 0 OR line % 2 = 0)
UNION ALL SELECT {vid("'file'", 'path')}, {vid("'symbol'", 'symbol')}, 'IMPORTS', 'import', path, line, 1, ordinal, 0 FROM o WHERE role = 'IMPORT' OR (role = 'READ' AND {IMPORTS})
UNION ALL SELECT {vid("'symbol'", 'enclosing_symbol')}, {vid("'symbol'", 'symbol')}, CASE WHEN {CALLS} THEN 'CALLS' ELSE 'REFERENCES' END, CASE WHEN {CALLS} THEN 'call' ELSE 'reference' END, path, line, 1, ordinal, 0 FROM o WHERE role = 'READ' AND NOT {IMPORTS} AND enclosing_symbol <> '' AND enclosing_symbol <> symbol)
SELECT src, dst, kind, CAST(CONCAT('0x', SUBSTR(sha256(CONCAT(src, '->', dst, ':', kind, ':scip')), 1, 8)) AS BIGINT) AS rank, context, path, line FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst, kind ORDER BY part, ordinal, nth, context, path, line) AS rn FROM u) y WHERE rn = 1""",
)
def _(f):
    scope = {"org_id": F.lit(1), "workspace_id": F.lit("w"), "repo_id": F.lit(1), "commit_hash": F.lit("0123456789abcdef0123456789abcdef01234567"), "schema_version": F.lit(2), "builder_version": F.lit("b1")}
    enclosing = "CASE WHEN start_line % 4 = 0 THEN '' ELSE CONCAT('pkg enc/', CAST(start_line AS STRING), '#') END"
    line = "CASE start_line % 6 WHEN 0 THEN 'import x' WHEN 1 THEN CONCAT('  y = ', regexp_extract(symbol, r'/(.*)\\(\\)', 1), ' (z)') WHEN 2 THEN ' \"quoted\" name' WHEN 3 THEN 'a = require(b)' ELSE 'plain' END"
    o = f.f_occurrence.filter("repo_id <= 3").selectExpr("index_id * 10 + ordinal AS ordinal", "symbol", f"{enclosing} AS enclosing_symbol", "CASE role WHEN 'REFERENCE' THEN 'READ' ELSE role END AS role", "IF(start_line % 5 = 0, 'IdentifierFunction', 'Identifier') AS syntax_kind", "file_path AS path", "start_line AS line", f"{line} AS line_content").withColumns(scope)
    r = o.filter("role = 'DEFINITION'").select(*scope, "ordinal", "path", "line", F.col("symbol").alias("source_symbol"), F.concat(F.lit("pkg enc/"), F.col("line").cast("string"), F.lit("#")).alias("target_symbol"), F.lit(True).alias("is_reference"), F.lit(False).alias("is_implementation"), (F.col("line") % 2 == 0).alias("is_type_definition"), F.lit(False).alias("is_definition"))
    return build.from_index(o, r)


@query("occurrence_cap", "WITH o AS (SELECT * FROM f_occurrence WHERE file_path IN (SELECT DISTINCT file_path FROM f_occurrence ORDER BY file_path LIMIT 5)) SELECT index_id, ordinal, role FROM o ORDER BY CASE role WHEN 'DEFINITION' THEN 0 WHEN 'REFERENCE' THEN 1 WHEN 'IMPORT' THEN 2 ELSE 5 END, file_path, start_line, index_id, ordinal LIMIT 200")
def _(f):
    o = f.f_occurrence.select("index_id", F.col("ordinal").alias("nth"), "role", F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.struct("index_id", "ordinal").alias("ordinal"))
    return build.capped(o, 5, 200).select("index_id", F.col("nth").alias("ordinal"), "role")


@query("symbol_names", f"SELECT DISTINCT symbol, {DISPLAY} AS name FROM f_symbol")
def _(f):
    return f.f_symbol.select("symbol", build.display_name(F.col("symbol")).alias("name")).distinct()
