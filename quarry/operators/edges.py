"""Scoring, ranking and balancing of relationship edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: What a relation, a producer and a place add to an edge's score, and the order of relations.
RELATION_SCORE = {"CALLS": 80, "REFERENCES": 50, "IMPLEMENTS": 45, "TYPE_DEFINES": 45, "DEFINES": 20}
RELATION_ORDER = {"HANDLES": 0, "EMITS": 0, "PROVIDES": 0, "CONSUMES": 0, "CALLS": 1, "REFERENCES": 1, "IMPLEMENTS": 2, "TYPE_DEFINES": 2, "EXTENDS": 2, "DEFINES": 3, "IMPORTS": 4, "IMPORTS_FROM": 4, "CONTAINS": 6}
SCIP_SCORE, AST_SCORE, PATH_SCORE, TEST_SCORE = 100, 60, 30, -50
#: The order of relations among edges of one relation's turn, and in the fallback.
TURN_ORDER = {"CALLS": 0, "REFERENCES": 1, "IMPLEMENTS": 2, "TYPE_DEFINES": 2, "DEFINES": 3}
FALLBACK_ORDER = {"CALLS": 0, "REFERENCES": 1, "HANDLES": 2, "EMITS": 2, "PROVIDES": 2, "CONSUMES": 2, "IMPLEMENTS": 3, "TYPE_DEFINES": 3, "EXTENDS": 3, "DEFINES": 4, "IMPORTS": 5, "IMPORTS_FROM": 5, "CONTAINS": 7}
#: Paths that one corpus prefers, as data: another corpus passes its own.
PREFERRED_PATHS = ("%/sdk.%", "%/nodejs.%", "%/python.%", "%/dotnet.%", "%/podmutator.%", "%/webhook/%")
#: Ends that only name a local symbol of one file.
LOCAL_SYMBOL, LOCAL_EVIDENCE = r"(?i)(^|[ /#.])local [0-9]+[.]?$", r"(?i)(CALLS|REFERENCES|DEFINES) [0-9]+[.]?$"
PRODUCER_ORDER = {"scip": 0, "ast": 1}
CONTEXTS = {"CALLS": "call", "REFERENCES": "reference", "IMPORTS_FROM": "import", "DEFINES": "definition", "IMPLEMENTS": "inherits", "EXTENDS": "inherits", "TYPE_DEFINES": "type", "CONTAINS": "containment"}


def choice(column: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def producer(source: Column) -> Column:
    ast = source.startswith("ast-") | source.startswith("tree-sitter") | source.startswith("tree_sitter")
    return F.when(source == "scip", "scip").when(ast, "ast").otherwise("other")


def searched() -> Column:
    """What a term is looked for in: ends, relation, path, evidence and rationale in one text."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("src", "dst", "relation", "source_file", "evidence", "rationale")))


def global_only(edges: DataFrame) -> DataFrame:
    """Edges of which no end is a symbol that only one file knows."""
    return edges.filter(~F.coalesce(F.col("src").rlike(LOCAL_SYMBOL) | F.col("dst").rlike(LOCAL_SYMBOL) | F.col("evidence").rlike(LOCAL_EVIDENCE), F.lit(False)))


def preferred(path: Column, paths: tuple[str, ...]) -> Column:
    """Whether a path, in lower case, is like one of the patterns."""
    out = F.lit(False)
    for p in paths:
        out = out | path.like(p.lower())
    return out


def java_literal(term: str) -> str:
    """A term as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in term)


def term_lengths(terms: list[str], low: Column) -> Column:
    """Lengths of the terms that a text in lower case holds."""
    return sum((F.when(low.contains(t.lower()), max(1, len(t))).otherwise(0) for t in terms), F.lit(0))


def quota(relation: Column, limit: int) -> Column:
    return F.when(relation.isin("CALLS", "REFERENCES"), max(8, limit // 2)).when(relation.isin("IMPORTS", "IMPORTS_FROM"), max(3, limit // 8)).otherwise(max(4, limit // 4))


def ranked(edges: DataFrame, terms: list[str], limit: int, paths: tuple[str, ...] = PREFERRED_PATHS) -> DataFrame:
    """Edges that hold a term, best first, with quotas for each relation and turns for each producer.

    The greatest quota is a filter of its own, so that each task keeps no more of a group before the shuffle.
    """
    relation = F.upper("relation")
    # texts are made once: what is used several times stays a column of its own
    hit = global_only(edges).withColumns({"low": F.lower(searched()), "low_path": F.lower(F.coalesce("source_file", F.lit(""))), "producer": producer(F.col("source"))})
    if terms:
        hit = hit.filter(F.col("low").rlike("|".join(java_literal(t.lower()) for t in terms)))
    hit = hit.withColumns({"hits": term_lengths(terms, F.col("low")), "liked": preferred(F.col("low_path"), paths), "tested": text.is_test(F.col("low_path"))})
    worth = F.col("hits") + F.when(F.col("producer") == "scip", SCIP_SCORE).when(F.col("producer") == "ast", AST_SCORE).otherwise(0) + choice(relation, RELATION_SCORE, 0)
    worth = worth + F.when(F.col("liked"), PATH_SCORE).otherwise(0) + F.when(F.col("tested"), TEST_SCORE).otherwise(0)
    scored = hit.withColumns({"score": worth, "relation_order": choice(relation, RELATION_ORDER, 5), "test_order": F.when(F.col("tested"), 2).otherwise(0)})
    tie = [F.col("graph_index_id"), F.col("ordinal")]
    place = [F.col("confidence").desc_nulls_last(), F.col("source_file").asc_nulls_last(), F.col("start_line").asc_nulls_last(), *tie]
    first = [F.col("hits").desc(), F.when(F.col("producer") == "scip", 0).otherwise(1), choice(relation, TURN_ORDER, 4), F.when(F.col("liked"), 0).otherwise(1), F.col("test_order"), *place]
    needed = ["repo_id", "graph_index_id", "ordinal", "src", "dst", "relation", "producer", "hits", "score", "relation_order", "test_order", "liked", "confidence", "source_file", "start_line"]
    scored = scored.select(*needed)
    scored = scored.withColumn("relation_rank", F.row_number().over(Window.partitionBy(relation, "producer").orderBy(*first)))
    scored = scored.filter(F.col("relation_rank") <= max(8, limit // 2)).filter(F.col("relation_rank") <= quota(relation, limit))
    second = [F.col("score").desc(), F.col("relation_order"), *place]
    scored = scored.withColumn("producer_rank", F.row_number().over(Window.partitionBy("producer").orderBy(*second)))
    order = ["producer_rank", choice(F.col("producer"), PRODUCER_ORDER, 2), "repo_id", F.col("score").desc(), "relation_order", "test_order", F.col("confidence").desc_nulls_last(), F.col("source_file").asc_nulls_last(), *tie]
    return scored.orderBy(*order).limit(limit).select("repo_id", "graph_index_id", "ordinal", "src", "dst", "relation", "producer", "score", "relation_rank", "producer_rank")


def fallback(edges: DataFrame, limit: int, per_bucket: int = 4) -> DataFrame:
    """The surest edges of each repository, producer and relation; precise producers and calls first."""
    tie = [F.col("graph_index_id"), F.col("ordinal")]
    w = Window.partitionBy("repo_id", "producer", F.upper("relation")).orderBy(F.col("confidence").desc_nulls_last(), F.col("source_file").asc_nulls_last(), F.col("start_line").asc_nulls_last(), *tie)
    rows = global_only(edges).withColumn("producer", producer(F.col("source"))).withColumn("bucket_rank", F.row_number().over(w)).filter(F.col("bucket_rank") <= per_bucket)
    order = [choice(F.col("producer"), PRODUCER_ORDER, 2), choice(F.upper("relation"), FALLBACK_ORDER, 6), F.when(text.is_test(F.coalesce("source_file", F.lit(""))), 2).otherwise(0), F.col("confidence").desc_nulls_last(), "repo_id", F.col("source_file").asc_nulls_last(), F.col("start_line").asc_nulls_last(), *tie]
    return rows.orderBy(*order).limit(limit).select("repo_id", "producer", "relation", "graph_index_id", "ordinal", "bucket_rank")


def reconciled(edges: DataFrame) -> DataFrame:
    """One edge for each pair and relation: the surest, by confidence and then producer; ties by place."""
    value = (F.col("confidence") * 1000).cast("int") * 10 + choice(producer(F.col("source")), {"scip": 5, "ast": 3}, 1)
    w = Window.partitionBy("src", "dst", "relation").orderBy(F.col("value").desc(), "graph_index_id", "ordinal")
    return edges.withColumn("value", value).withColumn("r", F.row_number().over(w)).filter("r = 1").select("src", "dst", "relation", "graph_index_id", "ordinal", "value")


def linked_counts(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """By graph the edges that the anchor linker made or that touch an anchor (``vid``)."""
    marks = anchors.select("vid").distinct()
    tagged = edges.join(marks.select(F.col("vid").alias("src"), F.lit(True).alias("s")), "src", "left").join(marks.select(F.col("vid").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    hit = (F.col("source") == "anchor-linker") | F.col("s").isNotNull() | F.col("d").isNotNull()
    return tagged.groupBy("graph_index_id").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("linked"), F.count(F.lit(1)).alias("edges"))


def edge_rank(edges: DataFrame) -> DataFrame:
    """The first 32 bits of a digest of an edge's ends, kind and source, as its rank among parallel edges."""
    key = F.concat(F.col("src"), F.lit("->"), F.col("dst"), F.lit(":"), F.col("relation"), F.lit(":"), F.col("source"))
    return edges.withColumn("edge_rank", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"))
