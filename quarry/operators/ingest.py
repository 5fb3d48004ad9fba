"""Rows of symbols, occurrences and relationships from the documents of symbol indexes.

Documents come from ``sources.artifact.documents``. What is not inside of its project is
left out: documents whose path leads out of it, symbols that a project does not define.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import scip

#: Names of the kinds of symbols by number from 1; number 83 has none.
KINDS = (
    "Array Assertion AssociatedType Attribute Axiom Boolean Class Constant Constructor DataFamily Enum EnumMember Event Fact Field File Function Getter Grammar Instance Interface Key Lang Lemma Macro Method MethodReceiver "
    "Message Module Namespace Null Number Object Operator Package PackageObject Parameter ParameterLabel Pattern Predicate Property Protocol Quasiquoter SelfParameter Setter Signature Subscript String Struct Tactic Theorem "
    "ThisParameter Trait Type TypeAlias TypeClass TypeFamily TypeParameter Union Value Variable Contract Error Library Modifier AbstractMethod MethodSpecification ProtocolMethod PureVirtualMethod TraitMethod TypeClassMethod "
    "Accessor Delegate MethodAlias SingletonClass SingletonMethod StaticDataMember StaticEvent StaticField StaticMethod StaticProperty StaticVariable - Extension Mixin Concept"
).split()
#: Names of the kinds of syntax by number from 1.
SYNTAX = (
    "Comment PunctuationDelimiter PunctuationBracket Keyword IdentifierOperator Identifier IdentifierBuiltin IdentifierNull IdentifierConstant IdentifierMutableGlobal IdentifierParameter IdentifierLocal IdentifierShadowed "
    "IdentifierNamespace IdentifierFunction IdentifierFunctionDefinition IdentifierMacro IdentifierMacroDefinition IdentifierType IdentifierBuiltinType IdentifierAttribute RegexEscape RegexRepeated RegexWildcard RegexDelimiter "
    "RegexJoin StringLiteral StringLiteralEscape StringLiteralSpecial StringLiteralKey CharacterLiteral NumericLiteral BooleanLiteral Tag TagAttribute TagDelimiter"
).split()
#: Bytes of a line that are kept, and bytes of a file whose lines are kept at all.
LINE_BYTES, FILE_BYTES = 2000, 8 << 20
#: Symbols that say nothing of a project: locals, parameters, generated properties, file scopes.
UNSEMANTIC = ("^local ", r"\(\)\.\([^)]+\)$", r"\d+:$", r"`[^`]+`\s*/$", "/$")
FLAGS = ("is_reference", "is_implementation", "is_type_definition", "is_definition")
RANGE = ("start_line", "start_col", "end_line", "end_col")


def named(number: Column, names: list[str]) -> Column:
    """The name of a kind's number, null where it has none."""
    name = F.get(F.array(*map(F.lit, names)), number - 1)
    return F.when((number >= 1) & (number <= len(names)) & (name != "-"), name)


def inside(path: Column) -> Column:
    """A path below its project without empty and dot steps; null where it is absolute or leads out."""
    clean = F.trim(path)
    steps = F.filter(F.split(clean, "/"), lambda s: ~s.isin("", "."))
    bad = clean.contains("\0") | clean.contains("\\") | clean.startswith("/") | (F.substring(clean, 2, 1) == ":") | F.array_contains(steps, "..")
    return F.when(~bad, F.array_join(steps, "/"))


def joined(root: Column, path: Column) -> Column:
    """A document's path in the repository."""
    root, path = inside(F.coalesce(root, F.lit(""))), inside(path)
    return F.when(root.isNotNull() & path.isNotNull(), F.concat_ws("/", F.when(root != "", root), F.when(path != "", path)))


def semantic(symbol: Column) -> Column:
    return reduce(lambda a, b: a & b, (~symbol.rlike(p) for p in UNSEMANTIC))


def display_name(symbol: Column) -> Column:
    """The last piece of a symbol between separators, or all of it."""
    compact = F.regexp_replace(F.trim(symbol), r"\s+", " ")
    pieces = F.filter(F.split(compact, r"[/#.:!()\[\]]"), lambda p: p != "")
    return F.when(F.size(pieces) > 0, F.element_at(pieces, -1)).otherwise(compact)


def placed(documents: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Documents with the language and root of their project (id, project_language, project_root) and their file's path.

    Documents move to meet their projects; without projects they came with these columns, by way of their artifacts, and stay."""
    met = documents if projects is None else documents.join(projects.select("id", "project_language", "project_root"), "id")
    met = met.withColumn("file_path", F.when(~F.col("external"), joined(F.col("project_root"), F.col("relative_path"))))
    language = F.when(F.col("language") == "", F.col("project_language")).otherwise(F.col("language"))
    return met.filter(F.col("external") | F.col("file_path").isNotNull()).withColumn("language", language)


def _bounds(range_: Column) -> Column:
    """A range of three or four numbers, as a struct; null for others."""
    third = F.when(F.size(range_) == 3, F.get(range_, F.lit(0))).otherwise(F.get(range_, F.lit(2)))
    values = (F.get(range_, F.lit(0)), F.get(range_, F.lit(1)), third, F.get(range_, F.size(range_) - 1))
    return F.when(F.size(range_).isin(3, 4), F.struct(*(v.alias(n) for v, n in zip(values, RANGE, strict=True))))


def _found(docs: DataFrame) -> DataFrame:
    """Every occurrence with a symbol, with its place."""
    one = docs.filter(~F.col("external")).select("id", "document", "file_path", "language", F.posexplode("occurrences").alias("nth", "o")).filter("o.symbol <> ''")
    return one.select("id", "document", "file_path", "language", "nth", "o.symbol", "o.symbol_roles", "o.syntax_kind", _bounds(F.col("o.range")).alias("at"), _bounds(F.col("o.enclosing_range")).alias("around"))


def _defines() -> Column:
    return F.col("symbol_roles").bitwiseAND(scip.ROLE_BITS["DEFINITION"] | scip.ROLE_BITS["FORWARD_DEFINITION"]) > 0


def symbols(docs: DataFrame) -> DataFrame:
    """A row for each symbol's information, with where the last of its definitions stands."""
    last = _found(docs).filter(_defines()).groupBy("id", "symbol").agg(F.max(F.struct("document", "nth", "file_path", "at")).alias("d")).select("id", "symbol", F.col("d.file_path").alias("file_path"), "d.at.*")
    each = docs.select("id", "document", "language", "external", F.posexplode("symbols").alias("nth", "s")).select("id", "document", "nth", "language", "external", "s.*")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = each.select(
        "id", "document", "nth", "external", "symbol", F.coalesce(blank("display_name"), display_name(F.col("symbol"))).alias("display_name"), named(F.col("kind"), KINDS).alias("kind"),
        blank("language").alias("language"), "documentation", blank("signature").alias("signature"), blank("enclosing_symbol").alias("enclosing_symbol"),
    )
    here = rows.filter(~F.col("external")).join(last, ["id", "symbol"], "left")
    return here.unionByName(rows.filter("external"), allowMissingColumns=True).drop("external")


def occurrences(docs: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each role of an occurrence, with the definition around it. ``whole``: all documents of an index lie in one task,
    as ``artifact.documents`` gives them, so that no occurrence moves."""
    found = _found(docs)
    key = ["id", "document", "nth", "file_path", "language", "symbol", "symbol_roles", "syntax_kind", *RANGE]
    if whole:
        around = F.when(_defines(), F.coalesce("around", "at"))
        rows = found.withColumn("around", around).filter("at IS NOT NULL OR around IS NOT NULL").select("*", "at.*")
        met = scip.swept_in_place(rows, ["id", "file_path"], key, ["document", "nth"]).filter("start_line IS NOT NULL")
        return _by_role(met)
    scopes = found.filter(_defines()).select("id", "file_path", "document", "nth", "symbol", F.coalesce("around", "at").alias("r")).filter("r IS NOT NULL").select("id", "file_path", "document", "nth", "symbol", "r.*")
    placed_ = found.filter("at IS NOT NULL").select("id", "document", "nth", "file_path", "language", "symbol", "symbol_roles", "syntax_kind", "at.*")
    return _by_role(scip.swept(placed_, scopes, ["id", "file_path"], key, ["document", "nth"]))


def _by_role(met: DataFrame) -> DataFrame:
    rows = scip.by_role(met, "symbol_roles").withColumn("syntax_kind", named(F.col("syntax_kind"), SYNTAX))
    return rows.withColumn("language", F.when(F.col("language") != "", F.col("language"))).drop("symbol_roles")


def with_lines(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences with the text of their first line from files (id, file_path, content): null without a file or with too large a one, empty beyond its end."""
    wanted = rows.groupBy("id", "file_path").agg(F.collect_set("start_line").alias("wanted"))
    read = files.filter(F.octet_length("content") <= FILE_BYTES).select("id", "file_path", F.split("content", "\r?\n").alias("lines"))
    each = wanted.join(read, ["id", "file_path"]).select("id", "file_path", "lines", F.explode("wanted").alias("start_line"))
    line = F.coalesce(F.get("lines", F.col("start_line")), F.lit(""))
    cut = F.when(F.octet_length(line) <= LINE_BYTES, line).otherwise(F.concat(text.cut_bytes(line, LINE_BYTES), F.lit("...")))
    told = each.filter("start_line >= 0").select("id", "file_path", "start_line", cut.alias("line_content"))
    return rows.join(told, ["id", "file_path", "start_line"], "left")


def relationships(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Relationships between the symbols that an index defines: those that it states and those that references inside of definitions make.

    Rows that agree in all six fields are one; (document, part, nth, sub) is where the first of them stands. ``rows`` are the
    documents' occurrences; without them all documents of an index lie in one task, and what they say is read in one pass.
    """
    return _settled(_claims(docs) if rows is None else _claimed(docs, rows))


#: What is known of a symbol: its index tells of it, and defines it.
TOLD, DEFINED = 1, 2


def _claim(part: int, nth: tuple, source: Column, target: Column | None = None, flags: list | None = None, known: int = 0) -> Column:
    """A relationship and where it stands, or without a target what is known of a symbol."""
    flags = flags or [F.lit(None).cast("boolean")] * len(FLAGS)
    where = F.struct(F.col("document"), F.lit(part).alias("part"), *(F.lit(n).cast("int").alias(x) for n, x in zip(nth, ("nth", "sub"), strict=True)))
    target = F.lit(None).cast("string") if target is None else target
    return F.struct(source.alias("source"), target.alias("target"), *(f.alias(n) for f, n in zip(flags, FLAGS, strict=True)), where.alias("first"), F.lit(known).alias("known"))


def _of_symbol(nth: Column, symbol: Column, relationships_: Column) -> Column:
    """What a symbol's information claims."""
    stated = F.transform(relationships_, lambda r, i: _claim(0, (nth, i), symbol, r["symbol"], [r[f] for f in FLAGS]))
    return F.concat(F.array(F.when(~F.col("external"), _claim(0, (nth, 0), symbol, known=TOLD))), stated)


def _of_use() -> Column:
    """What a reference inside of a definition claims."""
    return _claim(1, (F.col("nth"), 0), F.col("enclosing"), F.col("symbol"), [F.lit(f == "is_reference") for f in FLAGS])


def _claimed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    each = docs.select("id", "document", "external", F.posexplode("symbols").alias("nth", "s")).select("id", F.explode(_of_symbol(F.col("nth"), F.col("s.symbol"), F.col("s.relationships"))).alias("c"))
    made = rows.filter((F.col("role") == "REFERENCE") & F.col("enclosing").isNotNull() & (F.col("enclosing") != F.col("symbol"))).select("id", _of_use().alias("c"))
    defined = _found(docs).filter(_defines()).select("id", _claim(1, (F.col("nth"), 0), F.col("symbol"), known=DEFINED).alias("c"))
    return each.unionByName(made).unionByName(defined).filter("c IS NOT NULL").select("id", "c.*")


def _claims(docs: DataFrame) -> DataFrame:
    """``_claimed`` of documents whose occurrences stay where they are: a row is an occurrence or a symbol's information."""
    kind = lambda c: docs.schema[c].dataType.elementType
    used = F.transform("occurrences", lambda o, i: F.struct(i.alias("nth"), o.alias("o"), F.lit(None).cast(kind("symbols")).alias("s")))
    told = F.transform("symbols", lambda s, i: F.struct(i.alias("nth"), F.lit(None).cast(kind("occurrences")).alias("o"), s.alias("s")))
    items = docs.select("id", "document", "external", "file_path", F.explode(F.concat(used, told)).alias("x")).select("id", "document", "external", "file_path", "x.*")
    items = items.filter("s IS NOT NULL OR (NOT external AND o.symbol <> '')").select("id", "document", "external", "file_path", "nth", F.coalesce("o.symbol", "s.symbol").alias("symbol"), "o.symbol_roles", "s.relationships", F.col("s").isNotNull().alias("info"), _bounds(F.col("o.range")).alias("at"), _bounds(F.col("o.enclosing_range")).alias("around"))
    defines = F.coalesce(_defines(), F.lit(False))
    items = items.withColumn("around", F.when(defines, F.coalesce("around", "at")))
    met = scip.swept_in_place(items, ["id", "file_path"], ["id", "document", "external", "nth", "symbol", "symbol_roles", "relationships", "info"], ["document", "nth"])
    use = F.when(defines, _claim(1, (F.col("nth"), 0), F.col("symbol"), known=DEFINED)).when(F.col("enclosing") != F.col("symbol"), _of_use())
    claims = F.when(F.col("info"), _of_symbol(F.col("nth"), F.col("symbol"), F.col("relationships"))).otherwise(F.array(use))
    return met.select("id", F.explode(claims).alias("c")).filter("c IS NOT NULL").select("id", "c.*")


def _settled(claims: DataFrame) -> DataFrame:
    """Each relationship once, where its index tells of both ends and defines them. All claims of an index meet once, and stay for what follows."""
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, or AQE puts several together by their bytes, which are few
    here = claims.filter(semantic(F.col("source")) & (F.col("target").isNull() | semantic(F.col("target")))).repartition(parts, "id")
    one = here.groupBy("id", "source", "target", *FLAGS).agg(F.min("first").alias("first"), F.bit_or("known").alias("known"))
    sure = F.col("target").isNull() & (F.col("known") == (TOLD | DEFINED))
    for end in (F.col("source"), F.coalesce("target", "source")):
        one = one.withColumn("sure", F.max(sure).over(Window.partitionBy("id", end))).filter("sure")
    return one.filter("target IS NOT NULL").select("id", "source", "target", *FLAGS, "first.document", "first.part", "first.nth", "first.sub")


def first_seen(rows: DataFrame) -> DataFrame:
    """Relationships numbered in document order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("document", "part", "nth", "sub")))
