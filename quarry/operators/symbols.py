"""Symbol search: definitions and references over the latest indexes of a tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import latest, scope


def occurrences(symbols: DataFrame, found: DataFrame, indexes: DataFrame, repos: DataFrame, org_id: int, name: str, roles: list[str], limit: int = 25, definition_file: str | None = None) -> DataFrame:
    """Symbols, of one file if it is named, whose name is ``name``, or whose id ends in it, ranked, then their occurrences of the given roles.

    The symbols are cut to ``max(32, 8 * limit)`` before occurrences are joined, as in the service.
    """
    limit = scope.page_limit(limit)
    lower = name.lower()
    rank = F.when(F.lower("display_name") == lower, 0).when(F.lower("symbol") == lower, 1).otherwise(2)
    match = F.lower(F.col("display_name")).eqNullSafe(lower) | F.lower(F.col("symbol")).eqNullSafe(lower)
    for p in text.suffix_patterns(name):
        match = match | F.col("symbol").ilike(p)
    current = latest.latest_index(scope.in_org(indexes, org_id)).select(F.col("id").alias("index_id"), "revision", F.coalesce("indexed_at", "updated_at").alias("seen"))
    names = scope.in_org(repos, org_id).select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"))
    if definition_file:
        match = match & (F.col("file_path") == definition_file)
    matched = scope.in_org(symbols, org_id).filter(match).join(current, "index_id").join(names, "repo_id")
    matched = matched.select("repo_id", "repo_name", "index_id", "revision", "symbol", "display_name", "seen", rank.alias("match_rank"))
    order = [F.col("match_rank"), F.col("seen").desc_nulls_last(), F.col("repo_name"), F.col("display_name"), F.col("symbol"), F.col("index_id")]
    matched = matched.orderBy(*order).limit(max(32, limit * 8))
    places = scope.in_org(found, org_id).filter(F.col("role").isin(roles)).select("index_id", "repo_id", "symbol", "file_path", "start_line", "role", "ordinal")
    out = matched.join(places, ["index_id", "repo_id", "symbol"])
    out = out.orderBy("match_rank", F.col("seen").desc_nulls_last(), "repo_name", "file_path", "start_line", "symbol", "index_id", "ordinal").limit(limit)
    return out.select("repo_id", "repo_name", "index_id", "revision", "symbol", "display_name", "file_path", "start_line", "role", "match_rank")


def tool(precise: DataFrame, files: DataFrame, repos: DataFrame, name: str, limit: int = 25, **scope_of) -> DataFrame:
    """What the symbol tools tell: occurrences from ``occurrences`` as precise rows, and the lines of a grep for the name beside them."""
    from quarry.operators import matches

    if not name.strip():
        raise ValueError("a symbol is needed")
    exact = precise.select(F.lit("precise").alias("evidence"), "repo_name", F.col("file_path").alias("path"), (F.col("start_line") + 1).cast("long").alias("line"), F.col("symbol").alias("text"))
    lexical = matches.grep(files, repos, name.strip(), scope.page_limit(limit), **scope_of).select(F.lit("lexical").alias("evidence"), "repo_name", "path", F.col("line").cast("long"), "text")
    return exact.unionByName(lexical)


def probed(symbols: DataFrame, found: DataFrame, indexes: DataFrame, repos: DataFrame, org_id: int, names: list[str], limit: int) -> DataFrame:
    """Definitions and references of several names in one scan of the symbols: of each name and role the first ``limit``, with the same ranks and cuts."""

    def rank(name: str):
        low = name.lower()
        match = F.when(F.lower("display_name") == low, 0).when(F.lower("symbol") == low, 1)
        for p in text.suffix_patterns(name):
            match = match.when(F.col("symbol").ilike(p), 2)
        return match

    tags = F.filter(F.array(*(F.struct(F.lit(i).alias("probe"), rank(n).alias("match_rank")) for i, n in enumerate(names))), lambda t: t["match_rank"].isNotNull())
    current = latest.latest_index(scope.in_org(indexes, org_id)).select(F.col("id").alias("index_id"), "revision", F.coalesce("indexed_at", "updated_at").alias("seen"))
    known = scope.in_org(repos, org_id).select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"))
    tagged = scope.in_org(symbols, org_id).select("repo_id", "index_id", "symbol", "display_name", F.explode(tags).alias("t")).select("*", "t.*").drop("t")
    met = tagged.join(current, "index_id").join(known, "repo_id")
    order = [F.col("match_rank"), F.col("seen").desc_nulls_last(), F.col("repo_name"), F.col("display_name"), F.col("symbol"), F.col("index_id")]
    cut = met.withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*order))).filter(F.col("place") <= max(32, 8 * limit)).drop("place")
    places = scope.in_org(found, org_id).filter(F.col("role").isin("DEFINITION", "REFERENCE")).select("index_id", "repo_id", "symbol", "file_path", "start_line", "role", "ordinal")
    out = cut.join(places, ["index_id", "repo_id", "symbol"])
    order = [F.col("match_rank"), F.col("seen").desc_nulls_last(), *map(F.col, ("repo_name", "file_path", "start_line", "symbol", "index_id", "ordinal"))]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("probe", "role").orderBy(*order))).filter(F.col("place") <= limit)
    return out.select("probe", "role", "place", "repo_id", "repo_name", "index_id", "revision", "symbol", "display_name", "file_path", "start_line", "match_rank")


def kinds(symbols: DataFrame) -> DataFrame:
    """Symbols, names and files of each organisation by kind."""
    return symbols.groupBy("org_id", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("display_name").alias("names"), F.countDistinct("file_path").alias("files"))


def ambiguous(symbols: DataFrame) -> DataFrame:
    """Display names that stand for several symbols in an organisation."""
    return symbols.groupBy("org_id", "display_name").agg(F.countDistinct("symbol").alias("symbols")).filter("symbols > 1")
