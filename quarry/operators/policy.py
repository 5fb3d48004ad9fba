"""Which branches of a repository a search may see, and what that makes of its results.

Repositories have name, default_branch, metadata (JSON with branches, tags and indexedRevisions), indexed_at, and the
type and status of their latest job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA = "branches array<string>, tags array<string>, indexedRevisions array<string>"
HEADS, TAGS = "refs/heads/", "refs/tags/"
#: Fixed value: what makes a configured branch a pattern.
PATTERN_CHARACTERS = r"[*?\[\]{}()!+@]"


def listed(field: str) -> Column:
    """A list of the metadata without blanks; empty where the metadata can't be read."""
    value = F.from_json(F.coalesce("metadata", F.lit("{}")), METADATA)[field]
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def short(ref: Column) -> Column:
    return F.regexp_replace(ref, "^refs/(heads|tags)/", "")


def matches(name: Column, globs: Column) -> Column:
    """Whether any glob of an array matches a name; ``*`` and ``?`` cross slashes, and one with an open bracket matches nothing."""

    def one(glob: Column) -> Column:
        pattern = F.regexp_replace(glob, r"([.+^$|()\\])", r"\\$1")
        pattern = F.replace(F.replace(F.replace(F.replace(pattern, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("{"), F.lit("(?:")), F.lit("}"), F.lit(")"))
        pattern = F.when(glob.contains("{"), F.replace(pattern, F.lit(","), F.lit("|"))).otherwise(pattern)
        whole = (F.regexp_count(glob, F.lit(r"\[")) == F.regexp_count(glob, F.lit("]"))) & (F.regexp_count(glob, F.lit(r"\{")) == F.regexp_count(glob, F.lit(r"\}")))
        return whole & F.rlike(name, F.concat(F.lit("^"), F.when(whole, pattern).otherwise(""), F.lit("$")))

    return F.exists(globs, one)


def branch_allowed(branch: Column) -> Column:
    """No patterns: the default branch, or any if there is none. ``*``: any. Else what a pattern matches."""
    patterns, default = listed("branches"), F.coalesce("default_branch", F.lit(""))
    name = F.regexp_replace(branch, f"^{HEADS}", "")
    return F.when(F.size(patterns) == 0, (default == "") | (name == default)).otherwise(F.array_contains(patterns, "*") | matches(name, patterns))


def revision_allowed(revision: Column) -> Column:
    """Branches by the branch patterns, tags by the tag patterns (none allow none), other revisions always."""
    return F.when(revision.startswith(HEADS), branch_allowed(revision)).when(revision.startswith(TAGS), matches(F.regexp_replace(revision, f"^{TAGS}", ""), listed("tags"))).otherwise(True)


def visible_revisions() -> Column:
    return F.filter(listed("indexedRevisions"), revision_allowed)


def blocked() -> Column:
    """Whether the latest job takes the index away, or failed to."""
    return F.coalesce((F.col("job_type") == "REMOVE_INDEX") & F.col("job_status").isin("PENDING", "IN_PROGRESS", "FAILED"), F.lit(False))


def visibility(repos: DataFrame) -> DataFrame:
    """Adds ``enforced`` and ``names``: the revisions that a search may see, by full and by short name."""
    none, default = F.array().cast("array<string>"), F.coalesce("default_branch", F.lit(""))
    out = repos.withColumn("visible", visible_revisions())
    instead = (F.size("visible") == 0) & (default != "") & branch_allowed(default)
    out = out.withColumn("visible", F.when(instead, F.array(F.concat(F.lit(HEADS), default))).otherwise(F.col("visible")))
    hidden, unread = blocked() | F.col("indexed_at").isNull(), F.coalesce("metadata", F.lit("")) == ""
    free = (F.size("visible") == 0) & (F.size(listed("branches")) == 0) & F.col("default_branch").isNull()
    names = F.array_distinct(F.flatten(F.transform("visible", lambda r: F.array(r, short(r)))))
    names = F.when((default != "") & F.array_contains(names, default), F.array_union(names, F.array(F.lit("HEAD")))).otherwise(names)
    enforced = hidden | ~(unread | free)
    return out.withColumn("enforced", enforced).withColumn("names", F.when(hidden | ~F.col("enforced"), none).otherwise(names)).drop("visible")


def branches() -> Column:
    """Short branch names among ``names``."""
    return F.filter("names", lambda x: (x != "") & (x != "HEAD") & ~x.startswith("refs/"))


def default_branch() -> Column:
    """The default branch if it may be seen, else the first in order; null if none may."""
    return F.when(F.array_contains(branches(), F.col("default_branch")), F.col("default_branch")).otherwise(F.array_min(branches()))


def pairs(repos: DataFrame, wanted: list[str]) -> DataFrame:
    """(repo_name, branch) that a search may read: the branches asked for, else each repository's default."""
    seen = visibility(repos)
    if wanted:
        asked = F.array_distinct(F.array(*(F.lit(w.removeprefix(HEADS).removeprefix(TAGS)) for w in wanted)))
        out = F.when(F.col("enforced"), F.array_intersect(asked, branches())).otherwise(asked)
    else:
        out = F.when(F.col("enforced"), F.array_compact(F.array(default_branch()))).otherwise(F.array(F.lit("HEAD")))
    return seen.select(F.col("name").alias("repo_name"), "enforced", F.explode(out).alias("branch")).distinct()


def permitted(files: DataFrame, repos: DataFrame, wanted: list[str]) -> DataFrame:
    """Files (repo_name, branch) that a search may read. No repository that enforces: all; repositories but no pair: none."""
    allowed = pairs(repos, wanted)
    any_ = visibility(repos).agg(F.coalesce(F.max("enforced"), F.lit(False)).alias("any_enforced"), F.count(F.lit(1)).alias("repos"))
    marked = files.withColumn("__short", short(F.col("branch"))).join(allowed.select("repo_name", F.col("branch").alias("__short"), F.lit(True).alias("__ok")), ["repo_name", "__short"], "left")
    marked = marked.crossJoin(F.broadcast(any_))  # one row
    return marked.filter((F.col("repos") > 0) & (~F.col("any_enforced") | F.col("__ok"))).drop("__short", "__ok", "any_enforced", "repos")


def visible_files(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files (repo_name, branches) of which a branch, by its full or short name, may be seen."""
    seen = visibility(repos).select(F.col("name").alias("repo_name"), "enforced", "names")
    short_names = F.transform("branches", short)
    ok = ~F.col("enforced") | F.arrays_overlap("names", F.col("branches")) | F.arrays_overlap("names", short_names)
    return files.join(seen, "repo_name").filter(ok).drop("enforced", "names")


def known_branches() -> Column:
    """Default, configured and indexed branches, in this order, each once; patterns are no branches."""
    default = F.array_compact(F.array(F.when(F.coalesce("default_branch", F.lit("")) != "", F.col("default_branch"))))
    configured = F.filter(listed("branches"), lambda b: ~b.rlike(PATTERN_CHARACTERS))
    indexed = F.transform(F.filter(listed("indexedRevisions"), lambda r: r.startswith(HEADS)), short)
    return F.array_distinct(F.concat(default, configured, indexed))


def resolved(hits: DataFrame, repos: DataFrame, need_id: bool = True) -> DataFrame:
    """Hits (repo_id, repo_name) of this tenant's repositories. An id decides alone: a wrong one never falls back to the name."""
    own = repos.select(F.col("id").alias("own_id"), F.col("name").alias("own_name"))
    by_id = hits.filter("repo_id > 0").join(own, F.col("repo_id") == F.col("own_id"))
    if need_id:
        return by_id
    first = own.groupBy("own_name").agg(F.min("own_id").alias("own_id")).select("own_id", "own_name")
    return by_id.unionByName(hits.filter("repo_id IS NULL OR repo_id <= 0").join(first, F.col("repo_name") == F.col("own_name")))


def totals(files: DataFrame) -> DataFrame:
    """By query: files (matches, kept, claimed) to the matches shown, the total, and whether that is all there are."""
    out = files.groupBy("query").agg(F.sum(F.when(F.col("kept"), F.col("matches")).otherwise(0)).alias("actual"), F.max("claimed").alias("claimed"), F.max(~F.col("kept")).alias("filtered"), F.count_if("kept").alias("files"))
    total = F.when(F.col("filtered") | (F.coalesce("claimed", F.lit(0)) == 0), F.col("actual")).otherwise(F.col("claimed"))
    return out.select("query", "files", "actual", total.alias("total"), (total <= F.col("actual")).alias("exhaustive"))


def shard_stats(stats: DataFrame, counters: list[str], order: list[str]) -> DataFrame:
    """Counters of all shards of a query added up; the reason for the last flush is that of the last shard."""
    return stats.groupBy("query").agg(*(F.sum(c).alias(c) for c in counters), F.max_by("flush_reason", F.struct(*order)).alias("flush_reason"))


#: Matches of a search, context lines, and matches of a grep, grouped or not.
MATCHES, MOST_MATCHES, MOST_CONTEXT, GREP, GROUPED_GREP, BROADEST = 30, 1000, 50, 100, 10_000, 250


def search_options(matches: int = MATCHES, context: int = 0) -> dict[str, int]:
    matches = MATCHES if matches < 1 else min(matches, MOST_MATCHES)
    return {"matches": matches, "context": max(0, min(context, MOST_CONTEXT)), "most": matches + 1}


def grep_limit(limit: int | None, grouped: bool = False) -> int:
    if limit is None:
        return GROUPED_GREP if grouped else GREP
    if limit <= 0:
        raise ValueError("a limit must be positive")
    return limit


def check_breadth(repos: DataFrame) -> None:
    """A grep that names no repository may span a bounded number of them."""
    if repos.limit(BROADEST + 1).count() > BROADEST:
        raise ValueError(f"a grep without a repository spans more than {BROADEST}; name some")
