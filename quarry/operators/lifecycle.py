"""Repositories and revisions over time: exclusion rules, activation, cleanup, commit reachability, project roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graph, latest

#: Fixed value: bytes in the kilobyte of a repository's size.
KILOBYTE = 1000
#: Fixed value: the most commits that a side of a comparison reaches.
MOST_COMMITS = 50_000


def _any(value: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | value.rlike(text.glob_to_regex(g))
    return out


def excluded(exclude: dict, include_topics: list[str] = ()) -> Column:
    """Whether a repository (clone_url, fork, archived, full_name, topics, size in KB) is left out.

    exclude may hold forks, archived, repos, topics, min_size and max_size (bytes). Topics ignore case.
    """
    out = F.coalesce(F.col("clone_url"), F.lit("")) == ""
    topics = F.coalesce(F.col("topics"), F.array().cast("array<string>"))

    def topic(globs: list[str]) -> Column:
        return F.exists(topics, lambda t: _any(F.lower(t), [g.lower() for g in globs]))

    if exclude.get("forks"):
        out = out | F.coalesce(F.col("fork"), F.lit(False))
    if exclude.get("archived"):
        out = out | F.coalesce(F.col("archived"), F.lit(False))
    if exclude.get("repos"):
        out = out | F.coalesce(_any(F.col("full_name"), exclude["repos"]), F.lit(False))
    if exclude.get("topics"):
        out = out | topic(exclude["topics"])
    if include_topics:
        out = out | ~topic(list(include_topics))
    size = F.col("size").cast("long") * KILOBYTE
    if exclude.get("min_size") is not None:
        out = out | F.coalesce(size < exclude["min_size"], F.lit(False))
    if exclude.get("max_size") is not None:
        out = out | F.coalesce(size > exclude["max_size"], F.lit(False))
    return out


def activated(indexes: DataFrame) -> DataFrame:
    """The newest ready index of a repository's revision is active; ready ones and unfinished ones before it are superseded."""
    ready = latest.top(indexes.filter("status = 'READY'"), ["repo_id", "revision"], [F.col("updated_at").desc(), F.col("id").desc()])
    now = ready.select("repo_id", "revision", F.struct("updated_at", "id").alias("newest"))
    at = F.struct("updated_at", "id")
    new = F.when(at == F.col("newest"), "ACTIVE").when(F.col("status").isin("READY", "INDEXING") & (at < F.col("newest")), "SUPERSEDED").otherwise(F.col("status"))
    return indexes.join(now, ["repo_id", "revision"], "left").select("id", "repo_id", "revision", new.alias("status"))


def merged_revisions(indexes: DataFrame) -> DataFrame:
    """A repository's indexed revisions as a JSON list, sorted, each once."""
    return indexes.groupBy("repo_id").agg(F.to_json(F.sort_array(F.collect_set("revision"))).alias("revisions"))


def cleaned(pointers: DataFrame, indexes: DataFrame, revision: str) -> tuple[DataFrame, DataFrame]:
    """Pointers without those of a revision; and the indexes that no pointer names any more."""
    kept = pointers.filter(~F.col("revision").eqNullSafe(revision))
    return kept, indexes.join(kept.select(F.col("index_id").alias("id")), "id", "left_anti")


def replaced(current: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of a scope that the new rows touch give way to the new rows."""
    return current.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def jumps(parents: DataFrame, most: int) -> list[DataFrame]:
    """Tables (id, to) of the first parent, and of what it leads to in 2, 4, 8 ... steps, as long as there is any."""
    now = graph.kept(parents.filter("nth = 0").select("id", F.col("parent").alias("to")))
    out = [now]
    while 2 ** len(out) < most:
        far = now.alias("a").join(now.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        now = graph.kept(far)
        if now.isEmpty():
            break
        out.append(now)
    return out


def ordered(parents: DataFrame) -> DataFrame:
    """(id, parent, nth): where parents have no order, the least is the first."""
    known = parents.filter("parent IS NOT NULL")
    if "nth" not in known.columns:
        known = known.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("parent")) - 1)
    return known.select("id", "parent", "nth")


def reachable(parents: DataFrame, start: int, most: int = MOST_COMMITS, far: list[DataFrame] | None = None) -> DataFrame:
    """Commits (id) that a commit reaches by (id, parent), itself included; the nearest ``most`` where there are more.

    Along first parents, what is marked marks what lies 1, 2, 4, 8 ... steps on, so a line of n commits takes log n joins;
    other parents of what is reached then start again. ``far``: the jumps, where they are there already.
    """
    spark, known = parents.sparkSession, ordered(parents)
    far, others = jumps(known, most) if far is None else far, known.filter("nth > 0")
    front, seen, turn = spark.createDataFrame([(start,)], "id long"), None, 0
    while True:
        marked = front.select("id", F.lit(0).alias("steps"))
        for k, jump in enumerate(far):
            on = marked.join(jump, "id", "left").select(F.explode(F.array(F.struct("id", "steps"), F.struct(F.col("to").alias("id"), (F.col("steps") + 2**k).alias("steps")))).alias("m"))
            marked = on.select("m.*").filter("id IS NOT NULL").groupBy("id").agg(F.min("steps").alias("steps"))
        new = marked.withColumn("turn", F.lit(turn))
        new = graph.kept(new if seen is None else new.join(seen.select("id"), "id", "left_anti"))
        seen = new if seen is None else seen.unionByName(new)
        front = graph.kept(new.join(others, "id").select(F.col("parent").alias("id")).distinct().join(seen.select("id"), "id", "left_anti"))
        turn += 1
        if front.isEmpty() or seen.count() >= most:
            return seen.orderBy("turn", "steps", "id").limit(most).select("id")


def ahead_behind(parents: DataFrame, base: int, head: int) -> DataFrame:
    """One row: commits of head that base lacks, and of base that head lacks."""
    known = graph.kept(ordered(parents))
    far = jumps(known, MOST_COMMITS)
    a, b = reachable(known, base, far=far), reachable(known, head, far=far)
    ahead = b.join(a, "id", "left_anti").agg(F.count(F.lit(1)).alias("ahead"))
    return ahead.crossJoin(a.join(b, "id", "left_anti").agg(F.count(F.lit(1)).alias("behind")))  # one row each


def project_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest root (repo_name, root) above each file's path; ``.`` where there is none. Files meet roots by their own folders."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = files.select("repo_name", "path", F.explode(above).alias("root")).join(roots.select("repo_name", "root").distinct(), ["repo_name", "root"])
    longest = met.groupBy("repo_name", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.select("repo_name", "path").distinct().join(longest, ["repo_name", "path"], "left").select("repo_name", "path", F.coalesce("root", F.lit(".")).alias("root"))
