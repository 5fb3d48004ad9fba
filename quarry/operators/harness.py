"""What an answer's texts hold for the next step: files to read, to change and to test, call edges, gaps, and how sure it all is.

Texts are (id, text), or (id, part, text) where a text comes in parts, whole lines each, in the order of ``part``; no task
needs a text whole. Lines become rows once; every list keeps the first mention of each item, up to its cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import ingest
from quarry.operators.chat import PATH, SOURCE_ENDINGS

#: Files of a text that are looked at, and the caps of the lists.
FILES = 80
CAPS = {"read": 32, "modify": 16, "test": 12, "edge": 24, "gap": 16}
#: Bytes of an edge and of a gap.
EDGE_BYTES, GAP_BYTES = 420, 360
#: What makes a file one to change, a line an edge or a gap, and roles and sources of files.
TOUCH = ("touchpoint", "definition", "implementation", "runtime", "crd", "webhook")
EDGE_MARKS, GAP_MARKS = ("-->", " CALLS ", " REFERENCES "), ("gap", "missing", "insufficient", "no precise")
READ, EDIT, TEST, TOOL, ANSWER = "read-before-edit", "candidate-edit-touchpoint", "test", "tool-output", "answer"
#: Marks of where a line comes from; of the first three the first that a line holds counts.
SOURCES = (("scip", ("source=scip", "provenance=scip", "precise scip")), ("tree_sitter", ("source=tree-sitter", "source=tree_sitter", "tree-sitter")), ("ast", ("source=ast", "source=syntactic-ast")))
ALSO = (("zoekt", ("zoekt", "grep")), ("heuristic", ("heuristic", "confidence=0.6")))
#: How sure an answer is.
SURE, PARTLY, UNSURE = "mixed-high-when-file-lines-match; verify heuristic graph edges", "lexical-plus-partial-structure", "insufficient-evidence"
HEADER, NUMBERED = r"^\[([^\]]+)\] (.+):$", r"^\s+(\d+):"


def _holds(value: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (value.contains(m) for m in marks))


def parts(texts: DataFrame) -> DataFrame:
    return texts if "part" in texts.columns else texts.withColumn("part", F.lit(0))


def _at(answer: int) -> Column:
    """Where something stands: what tool output names comes before what the answer says."""
    return F.struct(F.lit(answer).alias("answer"), "part", "n").alias("at")


def lines(texts: DataFrame) -> DataFrame:
    rows = parts(texts).select("id", "part", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return rows.select("id", _at(0), "line")


def provenance(rows: DataFrame) -> DataFrame:
    """Lines of each text by what they come from, and the class of confidence that these make."""
    low, taken, counts = F.lower("line"), F.lit(False), []
    for name, marks in SOURCES:
        hit = _holds(low, marks)
        counts.append(F.count_if(hit & ~taken).alias(name))
        taken = taken | hit
    counts += [F.count_if(_holds(low, marks)).alias(name) for name, marks in ALSO]
    counts.append(F.count_if(low.contains("graph") | F.col("line").contains("-->")).alias("graph"))
    sure = F.when((F.col("scip") > 0) & (F.col("graph") > 0) & (F.col("zoekt") > 0), SURE).when(F.col("zoekt") > 0, PARTLY).otherwise(UNSURE)
    return rows.groupBy("id").agg(*counts).withColumn("confidence", sure)


def _stripped(path: Column) -> Column:
    return F.regexp_replace(path, r"^[ \t\r\n`.,:;]+|[ \t\r\n`.,:;]+$", "")


def _under_header(told: DataFrame) -> DataFrame:
    """Headers and numbered lines with the last header up to each, ``of``. Most find it in their own part; those that don't are
    few and look at the last headers of parts, so no task gets all lines of a text."""
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = told.withColumn("of", F.last("named", ignorenulls=True).over(upto("id", "part")))
    last = told.filter("header").groupBy("id", "part").agg(F.max("at").alias("at"), F.max_by("named", "at").alias("of"))
    before = own.filter("of IS NULL").select("id", "at", "line", "of").unionByName(last.select("id", "at", F.lit(None).cast("string").alias("line"), "of"))
    carried = before.withColumn("of", F.last("of", ignorenulls=True).over(upto("id"))).filter("line IS NOT NULL")
    return own.filter("of IS NOT NULL").select("id", "at", "line", "of").unionByName(carried.select("id", "at", "line", "of"))


def files(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Files that tool output names by header and numbered lines, then those that stand in the text, each place once."""
    header = F.col("line").rlike(HEADER)
    named = F.when(header, F.struct(F.trim(F.regexp_extract("line", HEADER, 1)).alias("repo"), F.trim(F.regexp_extract("line", HEADER, 2)).alias("path")))
    number = F.regexp_extract("line", NUMBERED, 1)
    told = rows.select("id", "at", F.when(header, "0").when(number != "", number).alias("line"), header.alias("header"), named.alias("named"), F.col("at.part").alias("part"))
    told = _under_header(told.filter("header OR line IS NOT NULL")).filter(F.col("of.path") != "")
    output = told.select("id", "at", F.col("of.repo").alias("repo"), _stripped(F.col("of.path")).alias("path"), F.col("line").cast("int").alias("line"), F.lit(TOOL).alias("source"))
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATH.pattern), F.lit(0)), lambda p: F.regexp_replace(p, r"""^[.,:;()\[\]{}<>"'`]+|[.,:;()\[\]{}<>"'`]+$""", ""))
    ends = reduce(lambda a, b: a | b, (F.lower("p").endswith(e) for e in SOURCE_ENDINGS))
    said = parts(texts).select("id", "part", F.posexplode(found).alias("n", "p")).filter(ends).select("id", _at(1), F.lit("").alias("repo"), _stripped(ingest.inside(F.col("p"))).alias("path"), F.lit(0).alias("line"), F.lit(ANSWER).alias("source"))
    every = output.unionByName(said).filter(F.col("path").contains("."))
    first = every.groupBy("id", "repo", "path", "line").agg(F.min(F.struct("at", "source")).alias("f")).select("id", "repo", "path", "line", "f.at", "f.source")
    place = F.row_number().over(Window.partitionBy("id").orderBy("at", "line"))
    return first.withColumn("place", place).filter(F.col("place") <= FILES)


def _first(rows: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def _mentions(rows: DataFrame, value: Column, hit: Column, most_bytes: int, most: int) -> DataFrame:
    """The first of each line that says something, without regard to case."""
    kept = rows.select("id", "at", value.alias("value")).filter((F.col("value") != "") & hit).withColumn("value", T.cut_bytes(F.col("value"), most_bytes))
    once = kept.groupBy("id", F.lower("value").alias("low")).agg(F.min(F.struct("at", "value")).alias("f")).select("id", "f.at", "f.value")
    return _first(once, most)


def evidence(texts: DataFrame) -> DataFrame:
    """(id, list, place, repo, path, line, role, source, value): the lists ``read``, ``modify``, ``test``, ``edge`` and ``gap`` of each text."""
    rows = lines(texts)
    found = files(texts, rows).drop("place")
    tests = F.col("path").contains("_test.") | F.col("path").contains("/test/") | F.col("path").contains("/tests/")
    touched = _holds(F.lower(F.concat_ws(" ", F.lit(READ), "source", "path")), TOUCH)
    parts = [
        _first(found.filter(keep), CAPS[name]).select("id", F.lit(name).alias("list"), "place", "repo", "path", "line", F.lit(role).alias("role"), "source", F.lit(None).cast("string").alias("value"))
        for name, keep, role in (("read", ~tests, READ), ("modify", ~tests & touched, EDIT), ("test", tests, TEST))
    ]
    plain, bullet = F.trim(F.col("line")), F.trim(F.regexp_replace("line", r"^[-* ]+", ""))
    none = lambda kind: F.lit(None).cast(kind)
    for name, value, hit, most_bytes in (("edge", plain, _holds(F.col("value"), EDGE_MARKS) & ~F.col("value").startswith("<!--"), EDGE_BYTES), ("gap", bullet, _holds(F.lower("value"), GAP_MARKS), GAP_BYTES)):
        one = _mentions(rows, value, hit, most_bytes, CAPS[name])
        parts.append(one.select("id", F.lit(name).alias("list"), "place", none("string").alias("repo"), none("string").alias("path"), none("int").alias("line"), none("string").alias("role"), none("string").alias("source"), "value"))
    return reduce(DataFrame.unionByName, parts)


#: Tokens and bytes of an answer by its budget.
BUDGETS = {"full": (12_000, None), "standard": (8000, 160_000), "compact": (6000, 96_000), "brief": (3000, 64_000)}


def budget(mode: str = "full", most_bytes: int = 256_000) -> dict[str, int]:
    """What an answer may take; a full one as many bytes as the service allows."""
    mode = mode.strip().lower() or "full"
    if mode not in BUDGETS:
        raise ValueError(f"a budget is one of {', '.join(BUDGETS)}")
    tokens, size = BUDGETS[mode]
    return {"tokens": tokens, "bytes": most_bytes if size is None else size}
