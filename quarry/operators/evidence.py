"""Evidence for an answer: slices, files to read, proof lines, flags and what is still missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: files to read.
MOST_FILES = 25


def files_to_read(lists: list[DataFrame], most: int = MOST_FILES) -> DataFrame:
    """Files (repo_id, path, revision) that any evidence names, in order; a blank revision is the active one."""
    every = reduce(DataFrame.unionByName, (x.select("repo_id", "path", "revision") for x in lists)).filter("path <> ''")
    revision = F.when(F.trim(F.coalesce("revision", F.lit(""))) == "", "active").otherwise(F.col("revision"))
    return every.select("repo_id", "path", revision.alias("revision")).distinct().orderBy("repo_id", "path", "revision").limit(most)


def proof_lines(lines: DataFrame, group: str, order: list[str], is_edge: Column, is_proof: Column, value: str) -> DataFrame:
    """Each proof line with the nearest edge line before it in its group (``edge``, null where there is none)."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("edge", F.last(F.when(is_edge, F.col(value)), ignorenulls=True).over(before)).filter(is_proof)


def flags(edges: DataFrame) -> DataFrame:
    """What kinds of producer a repository's edges have, and what that makes of its graph."""
    scip, ast = F.col("source") == "scip", F.col("source").startswith("ast-")
    out = edges.groupBy("repo_id").agg(F.bool_or(scip).alias("precise"), F.bool_or(ast).alias("ast"), F.bool_or(~scip & ~ast).alias("other"))
    return out.withColumn("verdict", F.when(F.col("precise"), "precise").when(F.col("ast"), "heuristic").otherwise("missing"))


def missing(repos: DataFrame, found: DataFrame, edges: DataFrame, needed: int = 1) -> DataFrame:
    """Which required evidence a repository lacks, comma-joined; an empty string where the gate is passed."""
    seen = found.groupBy("repo_id").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("DEFINITION", "REFERENCE")))
    graph = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("EDGE"))
    all_ = repos.select(F.col("id").alias("repo_id")).join(seen, "repo_id", "left").join(graph, "repo_id", "left")
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit(0)) < needed, c.lower()) for c in ("DEFINITION", "REFERENCE", "EDGE"))))
    return all_.select("repo_id", F.array_join(lacks, ",").alias("lacks"))


#: What the source of a slice adds to its score, and what its path does.
SLICE_BASE, SLICE_SOURCES = 10, {
    "scip-test-requested": 215, "scip-definition-requested": 220, "scip-definition-forced": 140, "scip-definition": 105, "webhook": 90, "webhook-registration": 88, "implementation": 80, "runtime-env": 75,
    "python-constants": 130, "annotation": 78, "focused": 70, "spec": 55, "crd-spec": 82, "runtime-side": 60, "otlp-flow": 86, "test": 45,
}
#: Markers of one corpus in paths, as data: (markers, score).
SLICE_PATHS = ((("/internal/", "/cmd/"), 10), (("podmutator", "webhook", "sdk.go"), 8), (("annotation.go", "instrumentation_types.go"), 12), (("config/webhook/", "manager_webhook"), 12))


def slice_score(source: Column, path: Column, line: Column, paths: tuple = SLICE_PATHS) -> Column:
    """How much a stretch of a file says, by what found it, where it stands, and less for tests and first lines."""
    out = F.lit(SLICE_BASE)
    for name, value in SLICE_SOURCES.items():
        out = out + F.when(source == name, value).otherwise(0)
    out = out + F.when(path.endswith("_test.go"), -10).otherwise(0) + F.when(line <= 5, -10).otherwise(0)
    for markers, value in paths:
        out = out + F.when(reduce(lambda a, b: a | b, (path.contains(m) for m in markers)), value).otherwise(0)
    return out


#: What surrounds a term and is no part of it.
AROUND = ".,;:()[]{}<>\"'`"


def _bare(term: Column) -> Column:
    return F.regexp_replace(term, r"""^[.,:;()\[\]{}<>"'`]+|[.,:;()\[\]{}<>"'`]+$""", "")


def _first_of_each(terms: Column, most: int) -> Column:
    """The first of each term without regard to case, in order."""
    low = F.transform(terms, F.lower)
    return F.slice(F.filter(terms, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def cleaned_terms(terms: Column, most: int) -> Column:
    """An array's terms without what surrounds them, short ones and words that name no code."""
    from quarry.operators.chat import STOP

    kept = F.filter(F.transform(terms, _bare), lambda x: (F.octet_length(x) >= 3) & ~F.lower(x).isin(*sorted(STOP)))
    return _first_of_each(kept, most)


def symbol_candidates(terms: Column, most: int = 5) -> Column:
    """Terms that look like names: a capital, a dot, dollar or underscore, or five characters; no paths and no hyphens."""
    from quarry.operators.chat import STOP

    def names(x: Column) -> Column:
        like = x.rlike("[A-Z.$_]") | (F.octet_length(x) >= 5) | F.lower(x).isin("inject", "instrumentation")
        return (F.octet_length(x) >= 3) & ~x.contains("/") & ~x.contains("-") & ~F.lower(x).isin(*sorted(STOP)) & like

    return _first_of_each(F.filter(F.transform(terms, _bare), names), most)


#: What lines of a graph's text begin with, or hold, that say most.
HIGH_STARTS = ("- depth ", "- step ", "- [repoid:", "native graph traversal", "high-signal connected flow", "heuristic connected flow", "ranked implementation path")
HIGH_MARKS = ("injectnodejs", "injectpython", "injectdotnet", "source=scip", "provenance=scip", "source=tree-sitter", "source=ast-", "provenance=heuristic")
PROVENANCE_MARKS = ("source=", "provenance=", "confidence=")


def compacted(texts: DataFrame, most: int) -> DataFrame:
    """(id, text): of each text the first three lines, then those that say most and the provenance after them, each once.

    Lines and their order are arrays of a row, so nothing is shuffled.
    """
    blank = lambda x: F.trim(x) == ""
    low = lambda x: F.lower(F.trim(x))
    any_ = lambda x, marks, test: reduce(lambda a, b: a | b, (getattr(low(x), test)(m) for m in marks))
    high = lambda x: any_(x, HIGH_STARTS, "startswith") | any_(x, HIGH_MARKS, "contains")
    rows = texts.select("id", F.split(F.trim("text"), "\n").alias("lines"))
    keep = F.filter("lines", lambda x, i: (i < 3) | high(x) | ((i > 3) & any_(x, PROVENANCE_MARKS, "contains") & high(F.get("lines", i - 1))))
    clean = F.filter(F.transform(keep, lambda x: F.regexp_replace(x, "[ \t]+$", "")), lambda x: ~blank(x))
    return rows.select("id", F.array_join(F.slice(F.array_distinct(clean), 1, most), "\n").alias("text"))


def resolved_ref(asked: Column) -> Column:
    """The revision that a reference means in a repository's ``names`` of readable revisions: itself, its branch or tag, or,
    where none is named, the default branch or the first branch."""
    from quarry.operators import policy

    plain = F.coalesce(F.trim(asked), F.lit(""))
    implicit = plain.isin("", "HEAD")
    found = F.when(F.array_contains("names", F.concat(F.lit("refs/heads/"), plain)), F.concat(F.lit("refs/heads/"), plain)).when(F.array_contains("names", F.concat(F.lit("refs/tags/"), plain)), F.concat(F.lit("refs/tags/"), plain)).when(F.array_contains("names", plain), plain)
    default = policy.default_branch()
    return F.when(implicit, F.when(default.isNotNull(), F.concat(F.lit("refs/heads/"), default))).otherwise(found)


def coverage(wanted: DataFrame, repos: DataFrame, asked: str = "") -> DataFrame:
    """(repo_name, indexed, reason) of repositories that a question names, by what may be read of them."""
    from quarry.functions import text
    from quarry.operators import policy

    if asked and not wanted.sparkSession.range(1).select(text.is_reference(F.lit(asked))).first()[0]:
        raise ValueError("that is no reference")
    seen = policy.visibility(repos).select(F.col("name").alias("repo_name"), "default_branch", "enforced", "names", F.lit(True).alias("known"))
    met = wanted.select("repo_name").distinct().join(seen, "repo_name", "left").withColumn("ref", resolved_ref(F.lit(asked)))
    valid = F.col("repo_name").rlike(r"^[^\s,]+$")
    reason = F.when(~valid, "repository name is not valid for scoped retrieval").when(F.col("known").isNull(), "repository is not active in this organization").when(F.col("ref").isNull(), "reference is not indexed")
    return met.select("repo_name", reason.isNull().alias("indexed"), reason.alias("reason"), "ref")


def cache_key(parts: list[Column]) -> Column:
    """A digest of a request in normal form: lower case, white space as one blank, NUL between parts."""
    normal = [F.lower(F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), r"\s+", " ")) for p in parts]
    return F.sha2(F.concat_ws("\0", *normal), 256)


#: Seed scores by the kind of evidence.
SEED_SCORES = {"edge": 80, "fact": 65, "anchor": 60, "relationship": 50, "symbol": 45}


def seeds(found: DataFrame) -> DataFrame:
    """Evidence (kind, workspace_id, vid, bonus, ordinal) as seeds: the first mention of each vertex, the best first."""
    from quarry.operators.edges import choice

    score = choice(F.col("kind"), SEED_SCORES, 0) + F.coalesce("bonus", F.lit(0))
    first = found.filter("workspace_id <> '' AND vid <> ''").groupBy("workspace_id", "vid").agg(F.min(F.struct("ordinal", score.alias("score"))).alias("f"))
    return first.select("workspace_id", "vid", "f.score", "f.ordinal")


#: What a text's topic adds where it is asked for and where another is, what a core flow adds, and what makes a text irrelevant.
ASKED_TOPIC, OTHER_TOPIC, CORE, IRRELEVANT, SURE = 42, -72, 24, -30, 0.8


def relevance(marks: Column, asked: list[str]) -> Column:
    """How a text with these marks fits the runtimes that a question asks for; 0 where it asks for none."""
    from quarry.operators import inspect

    if not asked:
        return F.lit(0)
    hits = {topic: inspect.marked(marks, f"topic {topic}") for topic, _ in inspect.TOPICS}
    some = reduce(lambda a, b: a | b, hits.values())
    points = sum((F.when(hit, ASKED_TOPIC if topic in asked else OTHER_TOPIC).otherwise(0) for topic, hit in hits.items()), F.lit(0))
    return points + F.when(~some & inspect.marked(marks, "core"), CORE).otherwise(0)


def fits(marks: Column, asked: list[str]) -> Column:
    """Whether a text with these marks names what is asked for and no other runtime, or a core flow."""
    from quarry.operators import inspect

    if not asked:
        return F.lit(True)
    named = {True: F.lit(False), False: F.lit(False)}
    for topic, _ in inspect.TOPICS:
        named[topic in asked] = named[topic in asked] | inspect.marked(marks, f"topic {topic}")
    return (named[True] & ~named[False]) | inspect.marked(marks, "core")


def by_trust(edges: DataFrame, text: Column | None = None, asked: list[str] = (), marks: str | None = None) -> DataFrame:
    """Edges with whether they are trusted: those that say what a question asks for, and are precise, or no guess and sure enough.

    The ``text`` in lower case is searched for marks, unless ``marks`` names a column that has them."""
    from quarry.operators import inspect

    rows = edges if marks else edges.withColumn("__marks", inspect.marks(F.lit("") if text is None else text, kinds=("topic", "core")))
    of = F.col(marks or "__marks")
    provenance, source = F.lower(F.coalesce("provenance", F.lit(""))), F.lower(F.trim(F.coalesce("source", F.lit(""))))
    guess = source.startswith("ast-") | (provenance == "heuristic")
    sure = (provenance == "scip") | (~guess & F.coalesce(F.col("confidence") >= SURE, F.lit(False)))
    return rows.withColumn("trusted", (relevance(of, asked) >= IRRELEVANT) & fits(of, asked) & sure).drop("__marks")


#: Rows of each list in the views of a path and of a minimal context.
PATH_CAPS, MINIMAL_CAPS = (20, 12, 12), (10, 8, 8, 8, 8, 10)


def capped(rows: DataFrame, group: str, order: list, caps: dict[str, int]) -> DataFrame:
    """Each list's first rows, with how many of it are left out."""
    w = Window.partitionBy(group)
    cap = reduce(lambda out, x: F.when(F.col(group) == x[0], x[1]).otherwise(out), caps.items(), F.lit(0))
    rows = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "all": F.count(F.lit(1)).over(w)})
    return rows.filter(F.col("place") <= cap).withColumn("omitted", F.greatest(F.col("all") - cap, F.lit(0))).drop("all")
