"""What changed between two manifests, and what to index again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_name, branch, path, change) for every file of either manifest."""
    keys = ["repo_name", "branch", "path"]
    a = previous.select(*keys, F.col("content_hash").alias("old"))
    b = current.select(*keys, F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("repo_name", "branch").agg(*(F.sum(F.when(F.col("change") == c, 1).otherwise(0)).cast("long").alias(c) for c in ("added", "changed", "deleted", "unchanged")))


def strategies(counted: DataFrame, had_previous: bool = True, toolchain_changed: bool = False, fingerprint_changed: bool = False, commit_changed: bool = True) -> DataFrame:
    """What each engine does. Nothing touched and nothing else new is a no-op; a new commit alone goes the delta way."""
    touched = F.col("added") + F.col("changed") + F.col("deleted") > 0
    if not had_previous:
        full = {"mode": "FULL", "lexical": "FULL_REPO_REWRITE", "scip": "FULL_REPO", "graph": "FULL", "semantic": "ALL_CHUNKS"}
        return counted.select("repo_name", "branch", *(F.lit(v).alias(k) for k, v in full.items()))
    other = toolchain_changed or fingerprint_changed
    work = touched | F.lit(other)
    return counted.select(
        "repo_name",
        "branch",
        F.when(work, "DELTA").otherwise("NOOP").alias("mode"),
        F.when(touched, "DELTA_FILES").otherwise("NOOP").alias("lexical"),
        F.when(F.lit(toolchain_changed), "FULL_REPO").when(touched, "PROJECT_ROOTS").otherwise("NOOP").alias("scip"),
        F.when(touched, "DELTA_FILES").otherwise("NOOP").alias("graph"),
        F.when(F.lit(fingerprint_changed), "ALL_CHUNKS").when(touched, "CHANGED_CHUNKS").otherwise("NOOP").alias("semantic"),
    )


def merged(current: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert: the first of the new rows of each key replaces what is there."""
    from quarry.operators.latest import top

    first = top(new, keys, order)
    return current.join(first.select(*keys), keys, "left_anti").unionByName(first)


#: What two manifests must agree in to be compared, in the order in which a disagreement is told.
SCOPE = (("org_id", "orgId"), ("workspace_id", "workspaceId"), ("repo_id", "repoId"), ("provider_connection_id", "providerConnectionId"), ("branch_name", "branch"))
#: Why an engine does what it does.
NO_MANIFEST, NO_CACHE = "No previous manifest exists.", "No previous semantic extraction cache exists."
BY_FILE, BY_SHARD = "Search engine supports file-level shard updates.", "Zoekt rewrites repository shard files because file-level shard delta is not enabled."
TOOLS, ROOTS, PROMPT = "SCIP toolchain fingerprint changed.", "Language indexers require project-root context for precise symbols.", "Semantic extraction prompt, model, or schema changed."
TOP = "."


def canonical(value: Column, instead: str) -> Column:
    """JSON with its keys in order at every depth; ``instead`` where there is none or it can't be read."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), F.lit(instead))


def touched_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Counts of changes of each repository and branch, the roots of what changed, and all roots, from files with a ``root``."""
    keys = ["repo_name", "branch", "path"]
    a = previous.select(*keys, F.col("content_hash").alias("old"), F.coalesce("root", F.lit(TOP)).alias("old_root"))
    b = current.select(*keys, F.col("content_hash").alias("new"), F.coalesce("root", F.lit(TOP)).alias("new_root"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    rows = a.join(b, keys, "full").withColumn("change", change)
    moved = F.when(F.col("change") != "unchanged", F.coalesce("new_root", "old_root"))
    counts_ = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "deleted", "unchanged")]
    return rows.groupBy("repo_name", "branch").agg(*counts_, F.sort_array(F.collect_set(moved)).alias("moved_roots"), F.sort_array(F.collect_set("new_root")).alias("all_roots"))


def plans(manifests: DataFrame, touched: DataFrame) -> DataFrame:
    """The plan of each manifest pair, by its own columns.

    manifests: repo_name, branch, had_previous, file_delta (whether shards can take single files), and of both the previous
    (``old_``) and the new one the scope's columns, scip_toolchains and semantic_extraction (JSON). A pair that disagrees in
    its scope gets an ``error`` and no plan.
    """
    rows = manifests.join(touched, ["repo_name", "branch"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("added", "changed", "deleted", "unchanged")}
    rows = rows.withColumns({**zero, **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("moved_roots", "all_roots")}})
    fresh, some = ~F.col("had_previous"), F.col("added") + F.col("changed") + F.col("deleted") > 0
    error = F.coalesce(*(F.when(F.col("had_previous") & ~F.col(f"old_{c}").eqNullSafe(F.col(c)), said) for c, said in SCOPE))
    differs = lambda c, instead: canonical(F.col(f"old_{c}"), instead) != canonical(F.col(c), instead)
    tools, prompt = differs("scip_toolchains", "{}"), differs("semantic_extraction", "null")
    rows = rows.withColumns({"error": error, "tools": tools, "prompt": prompt})
    tools, prompt = F.col("tools"), F.col("prompt")
    choice = lambda *cases, other="NOOP": reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), reversed(cases), F.lit(other))
    by_root = F.size("moved_roots") > 0
    made = {
        "mode": choice((fresh, "FULL"), (some, "DELTA")),
        "lexical": choice((fresh, "FULL_REPO"), (some & F.col("file_delta"), "DELTA_FILES"), (some, "FULL_REPO_REWRITE")),
        "lexical_reason": choice((fresh, NO_MANIFEST), (some & F.col("file_delta"), BY_FILE), (some, BY_SHARD), other=None),
        "scip": choice((fresh | tools, "FULL_REPO"), (by_root, "PROJECT_ROOTS")),
        "scip_roots": F.array_join(F.when(fresh | tools, F.col("all_roots")).otherwise(F.col("moved_roots")), ","),
        "scip_reason": choice((fresh, NO_MANIFEST), (tools, TOOLS), (by_root, ROOTS), other=None),
        "graph": choice((fresh | some, "DELTA_FILES")),
        "semantic": choice((fresh | prompt, "ALL_CHUNKS"), (some, "CHANGED_CHUNKS")),
        "semantic_reason": choice((fresh, NO_CACHE), (prompt, PROMPT), other=None),
    }
    held = {name: F.when(F.col("error").isNull(), value) for name, value in made.items()}
    return rows.withColumns(held).select("repo_name", "branch", "error", *made)
