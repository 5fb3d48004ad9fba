"""The fused context of a question: all recalls in one scan of the files, slices of what they find, symbols, graph rows and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import edges, evidence, matches
from quarry.operators import graph as graph_
from quarry.plans import recall

FILE = ("repo_name", "branch", "path")
#: Lines of a slice's bucket, what tests cost, what a preferred path adds, slices of a path, lines before a match, proof lines.
BUCKET, TEST_COST, PREFERRED, PER_PATH, BEFORE, PROOFS = 80, 35, 45, 3, 20, 3
#: Sources that have buckets of their own, and those whose every line is one; the latter two are taken whatever a path has.
OWN_BUCKET, OWN_LINE, ALWAYS = ("runtime-env", "runtime-side"), ("scip-definition-forced", "scip-definition-requested", "scip-test-requested"), ("scip-definition-requested", "scip-test-requested")
UNREAD = "/(vendor|node_modules|dist)/"
#: Marks of a proof: (marks, score). Marks of one group count once in the first list, each in the second.
SCIP_PROOF = ((("source=scip", "provenance=scip"), 50), ((" calls:", "--calls-->", " calls "), 40), ((" references:", "--references-->", " references "), 25), (("injectnodejs",), 15), (("injectpython",), 15), (("injectdotnet",), 15), (("injectcommon",), 15), (("sdkinjector",), 15), (("annotation",), -15))
AST_PROOF = (
    (("source=tree-sitter", "source=tree_sitter"), 20), (("source=ast-",), 15), *(((m,), 20) for m in (" calls:", "--calls-->", " calls ", " handles:", " emits:", " provides:", " consumes:")),
    *(((m,), 8) for m in ("webhook", "route", "handler", "mutate", "inject", "sdk", "event")), (("_test.", "/test/", "tests/"), -15),
)


def _holds(value: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (value.contains(m) for m in marks))


def recalled(files: DataFrame, recalls: list[recall.Recall]) -> DataFrame:
    """The first matching lines of each recall, in each branch: ``nth`` recall, source, line and text.

    Files are scanned once: an alternation of all patterns passes over those that answer nothing, lines that it matches are
    tagged with the recalls that they answer, and tags become rows.
    """
    every = "|".join(f"(?:{r.pattern})" for r in recalls)
    lines = files.filter(F.col("content").rlike(every)).select(*FILE, F.posexplode(F.split("content", "\n")).alias("line", "text"))
    lines = lines.filter(F.col("text").rlike(every)).withColumn("line", F.col("line") + 1)
    tags = [F.when(F.col("text").rlike(r.pattern) & (F.col("path").rlike(matches.included(r.include)) if r.include else F.lit(True)), F.lit(i)) for i, r in enumerate(recalls)]
    tagged = lines.select("*", F.explode(F.array_compact(F.array(*tags))).alias("nth"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("nth"))
    place = F.row_number().over(Window.partitionBy("nth", "branch").orderBy("repo_name", "path", "line"))
    cut = tagged.withColumn("place", place).filter(F.col("place") <= of([r.most for r in recalls]))
    return cut.select("nth", of([r.source for r in recalls]).alias("source"), *FILE, "line", F.trim("text").alias("text"), "place")


def scored(found: DataFrame) -> DataFrame:
    return found.withColumn("score", evidence.slice_score(F.col("source"), F.col("path"), F.col("line")))


def from_definitions(plan: recall.Plan, found: DataFrame) -> DataFrame:
    """Slices of definitions (repo_name, branch, path, line, name): those that a question names count most, and bodies that it wants."""
    asked = [s.lower() for s in recall.symbols(plan.question, recall.EXPANDED) if len(s) >= 5 and not set(s) & set("/-:") and any(c.islower() for c in s) and any(c.isupper() for c in s)]
    named = F.lower("name").isin(asked) if asked else F.lit(False)
    source = F.when(F.lit(plan.tests) & F.col("path").contains("_test.") & named, "scip-test-requested")
    if plan.bodies:
        source = source.when(named, "scip-definition-requested").otherwise("scip-definition-forced")
    else:
        source = source.otherwise("scip-definition")
    return scored(found.select(F.lit(-1).alias("nth"), source.alias("source"), *FILE, "line", F.col("name").alias("text"), F.lit(0).alias("place")))


def selected(found: DataFrame, most: int, tests: bool = False, preferred: tuple[str, ...] = ()) -> DataFrame:
    """The best of (repo_name, branch, path, line, source, score) in each stretch of a file, the first ``most`` by score."""
    clean = found.filter((F.col("repo_name") != "") & (F.col("path") != "") & (F.col("line") > 0) & ~F.col("path").rlike(UNREAD))
    worth = F.col("score")
    if not tests:
        worth = worth - F.when(F.col("path").contains("_test."), TEST_COST).otherwise(0)
    if preferred:
        worth = worth + F.when(_holds(F.col("path"), tuple(preferred)), PREFERRED).otherwise(0)
    own = F.when(F.col("source").isin(*OWN_BUCKET), F.col("source")).when(F.col("source").isin(*OWN_LINE), F.concat_ws(":", "source", "line")).otherwise("")
    keyed = clean.withColumns({"score": worth, "own": own, "stretch": F.floor(F.col("line") / BUCKET)})
    best = keyed.groupBy("repo_name", "path", "own", "stretch").agg(F.min(F.struct((-F.col("score")).alias("cost"), "line", "source", "branch")).alias("b"))
    rows = best.select("repo_name", "b.branch", "path", "b.line", "b.source", (-F.col("b.cost")).alias("score"))
    return rows.orderBy(F.col("score").desc(), "repo_name", "path", "line", "source").limit(most)


def diverse(chosen: DataFrame, most: int, per_path: int = PER_PATH, across: bool = False, preferred: tuple[str, ...] = ()) -> DataFrame:
    """``most`` of the chosen slices: where it is wanted the best of each repository, then the best of each preferred path, then the others, few of a path.

    What comes in has a bounded number of rows; a slice stands where it is first wanted.
    """
    alone = Window.partitionBy()
    ranked = chosen.withColumn("rank", F.row_number().over(alone.orderBy(F.col("score").desc(), "path", "line", "repo_name", "source")))
    several = F.size(F.collect_set("repo_name").over(alone)) > 1
    of_repo = F.min("rank").over(Window.partitionBy("repo_name"))
    turn = F.when(F.lit(across) & several & (F.col("rank") == of_repo), F.struct(F.lit(1).alias("phase"), F.col("rank").alias("at")))
    for j, fragment in enumerate(preferred):
        first = F.min(F.when(F.col("path").contains(fragment), F.col("rank"))).over(alone)
        turn = F.coalesce(turn, F.when(F.col("rank") == first, F.struct(F.lit(2).alias("phase"), F.lit(j).alias("at"))))
    turn = F.coalesce(turn, F.struct(F.lit(3).alias("phase"), F.col("rank").alias("at")))
    placed = ranked.withColumn("turn", turn)
    nth = F.row_number().over(Window.partitionBy("repo_name", "path").orderBy("turn"))
    kept = placed.withColumn("of_path", nth).filter((F.col("of_path") <= per_path) | F.col("source").isin(*ALWAYS))
    return kept.orderBy("turn").limit(most).drop("rank", "turn", "of_path")


def sliced(files: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The lines of each slice, from BEFORE lines ahead of its match; null where there is no such file to read."""
    start = F.when(F.col("line") <= BEFORE, 1).otherwise(F.col("line") - BEFORE)
    wanted = F.broadcast(chosen.select(*FILE).distinct())  # chosen rows are few
    read = files.join(wanted, list(FILE)).select(*FILE, F.split("content", "\n").alias("all"))
    met = chosen.join(read, list(FILE), "left").withColumn("start_line", start.cast("long"))
    return met.select(*chosen.columns, "start_line", F.array_join(F.slice("all", F.col("start_line").cast("int"), F.lit(most)), "\n").alias("text"))


def proofs(rows: DataFrame, asked: Column, marks: tuple, most: int = PROOFS) -> DataFrame:
    """The best-scored proof lines (id, text) of those that are ``asked`` for."""
    low = F.lower("text")
    score = sum((F.when(_holds(low, m), v).otherwise(0) for m, v in marks), F.lit(0))
    return rows.filter(asked).withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(most)


def graph_rows(found: DataFrame, terms: list[str], most: int) -> DataFrame:
    """Ranked edges as the lines that a graph layer shows."""
    low = edges.ranked(found, terms, most)
    text = F.concat(F.col("src"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("dst"), F.lit(" source="), F.when(F.col("producer") == "scip", "scip").when(F.col("producer") == "ast", "ast-").otherwise("heuristic"))
    return low.select(F.col("repo_id").cast("string").alias("repo_name"), F.concat_ws(":", F.lpad(F.col("graph_index_id").cast("string"), 20, "0"), F.lpad(F.col("ordinal").cast("string"), 10, "0")).alias("id"), text.alias("text"), "score", "producer")


def manifest(graph: DataFrame, definitions: DataFrame, probed: bool) -> DataFrame:
    """One row: what the graph and the symbol index give, whether there is syntax evidence, and whether a required layer failed."""
    g = graph.agg(F.count_if(F.col("producer") == "scip").alias("native"), F.count_if(F.col("producer") == "ast").alias("ast"), F.count(F.lit(1)).alias("any"))
    told = definitions.agg(F.count(F.lit(1)).alias("found"))
    one = g.crossJoin(told)  # one row each
    coverage = F.when(F.col("native") > 0, "native").when(F.col("ast") > 0, "heuristic").when(F.col("any") > 0, "any").otherwise("none")
    precise = F.when(~F.lit(probed), "inconclusive").when(F.col("found") > 0, "precise").otherwise("missing")
    return one.select(coverage.alias("graph"), precise.alias("scip"), (F.col("ast") > 0).alias("ast"), (F.col("ast") == 0).alias("failed"))


def chosen_slices(plan: recall.Plan, found: DataFrame, several: bool = True) -> DataFrame:
    """The slices to read, of candidates from recalls and definitions; of one repository in a full answer just the best."""
    preferred = tuple(plan.preferred)
    if not plan.compact and not several:
        return selected(found, recall.CHOSEN[0], plan.tests, preferred)
    most = recall.READ[1] if plan.compact else recall.CHOSEN[0]
    return diverse(selected(found, max(recall.CHOSEN), plan.tests, preferred), most, PER_PATH, plan.across, preferred)


def context(plan: recall.Plan, files: DataFrame, graph: DataFrame, definitions: DataFrame, references: DataFrame, several: bool = True) -> DataFrame:
    """Every layer of a question's context: (layer, place, repo_name, path, line, score, text).

    ``files`` are those that may be read, ``graph`` the edges in scope, definitions and references those of the plan's symbols
    (repo_name, branch, path, line, name). Layers: recall, slice, definition, reference, graph, proof, manifest.
    """
    compact = int(plan.compact)
    # each of these has few rows and is read by several layers
    found, definitions, references = (graph_.kept(x) for x in (recalled(files, plan.recalls), definitions, references))
    candidates = scored(found).unionByName(from_definitions(plan, definitions))
    slices = sliced(files, chosen_slices(plan, candidates, several), recall.LINES[compact])
    rows = graph_.kept(graph_rows(graph, plan.terms or [plan.question], min(plan.limit, recall.GRAPH[compact])))
    proof = proofs(rows, F.col("producer") == "scip", SCIP_PROOF).withColumn("kind", F.lit("scip proof")).unionByName(proofs(rows, F.col("producer") == "ast", AST_PROOF).withColumn("kind", F.lit("ast proof")))
    none = lambda kind: F.lit(None).cast(kind)
    told = manifest(rows, definitions, bool(plan.symbols))
    parts = [
        found.select(F.concat(F.lit("recall "), "source").alias("layer"), "repo_name", "path", F.col("line").cast("long").alias("line"), none("long").alias("score"), "text"),
        slices.select(F.lit("slice").alias("layer"), "repo_name", "path", F.col("line").cast("long"), F.col("score").cast("long"), "text"),
        *(rows_.select(F.lit(layer).alias("layer"), "repo_name", "path", F.col("line").cast("long"), none("long").alias("score"), F.col("name").alias("text")) for layer, rows_ in (("definition", definitions), ("reference", references))),
        rows.select(F.lit("graph").alias("layer"), "repo_name", none("string").alias("path"), none("long").alias("line"), F.col("score").cast("long"), "text"),
        proof.select(F.col("kind").alias("layer"), "repo_name", none("string").alias("path"), none("long").alias("line"), F.col("score").cast("long"), "text"),
        told.select(F.lit("manifest").alias("layer"), none("string").alias("repo_name"), none("string").alias("path"), none("long").alias("line"), none("long").alias("score"), F.concat(F.lit("graph="), "graph", F.lit(" scip="), "scip", F.lit(" ast="), F.col("ast").cast("string"), F.lit(" failed="), F.col("failed").cast("string")).alias("text")),
    ]
    return reduce(DataFrame.unionByName, parts)
