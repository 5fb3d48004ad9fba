"""State of index subjobs: what may run, what a failure does, what an expired lease does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DONE = ("SUCCEEDED", "SKIPPED")
PRODUCERS = ("ZOEKT", "AST_TREE_SITTER", "SCIP")
OPEN = ("QUEUED", "CLAIMED", "RUNNING", "VALIDATING", "RETRYING")


#: What a dependency has in common with what waits for it, and what activations take turns within.
SCOPE = ("job_id", "workspace_id", "repo_id", "branch", "revision", "commit_hash")
TURN = SCOPE[:3]


def dispatchable(subjobs: DataFrame, most: int | None = None) -> DataFrame:
    """Waiting subjobs whose dependencies in the same revision are met, the oldest ``most`` of them.

    Flags by revision and the first activation by repository, one aggregate each, stand for the correlated checks.
    """
    tolerated = (F.col("layer") == "SCIP") & F.col("status").isin("FAILED", "CANCELED")
    unmet = ~F.col("status").isin(*DONE) & ~tolerated
    flags = subjobs.groupBy(*SCOPE).agg(
        F.max(((F.col("layer") == "CLONE") & ~F.col("status").isin(*DONE)).cast("int")).alias("clone_open"),
        F.max((F.col("layer").isin("AST_TREE_SITTER", "SCIP") & unmet).cast("int")).alias("facts_open"),
        F.max(((F.col("layer") != "ACTIVATE") & unmet).cast("int")).alias("any_open"),
    )
    first = subjobs.groupBy(*TURN).agg(F.min(F.when((F.col("layer") == "ACTIVATE") & F.col("status").isin(*OPEN), F.struct("created_at", "id"))).alias("first_activation"))
    ready = (
        F.col("layer").isin("CLONE", "REMOVE")
        | (F.col("layer").isin(*PRODUCERS) & (F.col("clone_open") == 0))
        | ((F.col("layer") == "GRAPH_MERGE") & (F.col("facts_open") == 0))
        | ((F.col("layer") == "ACTIVATE") & (F.col("any_open") == 0) & (F.col("first_activation.id") == F.col("id")))
    )
    waiting = subjobs.filter(F.col("status").isin("QUEUED", "RETRYING") & (F.col("attempt") < F.col("max_attempts")))
    out = waiting.join(flags, list(SCOPE)).join(first, list(TURN)).filter(ready)
    if most is not None:
        out = out.orderBy("created_at", "id").limit(most)
    return out.select("id", "job_id", "layer", "attempt")


def completed(subjobs: DataFrame) -> DataFrame:
    """Jobs with no unfinished subjob."""
    finished = F.col("status").isin(*DONE, "FAILED", "CANCELED")
    return subjobs.groupBy("job_id").agg(F.sum((~finished).cast("int")).alias("open"), F.count(F.lit(1)).alias("subjobs")).filter("open = 0").select("job_id", "subjobs")


def canceled_dependents(subjobs: DataFrame) -> DataFrame:
    """Open subjobs of jobs in which a layer that nothing can replace has failed."""
    fatal = subjobs.filter((F.col("status") == "FAILED") & ~F.col("layer").isin("SCIP", "AST_TREE_SITTER")).select("job_id").distinct()
    return subjobs.filter(F.col("status").isin(*OPEN)).join(fatal, "job_id", "left_semi").select("id", "job_id", "layer")


def guarded(active: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, repo_id, ref, created_at) with whether they become jobs, and the job that stands in their way.

    A request waits for a job of its repository whose ref is the same branch, or which has no ref; one without a ref for any.
    Requests come in order of time and id, those that are accepted count for later ones. As a ref's first request alone can
    be accepted, and one without a ref only as the very first of a repository, one pass of windows gives what a loop would.
    """
    branch = F.regexp_replace(F.trim(F.coalesce("ref", F.lit(""))), "^refs/heads/", "")
    rows = active.select("id", "repo_id", "ref", "created_at", F.lit(0).alias("asks")).unionByName(requests.select("id", "repo_id", "ref", "created_at", F.lit(1).alias("asks"))).withColumn("branch", branch)
    order, every = ["asks", "created_at", "id"], Window.partitionBy("repo_id")
    before, same = (w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for w in (every, Window.partitionBy("repo_id", "branch")))
    blank = F.col("branch") == ""
    rows = rows.withColumns({"running": F.max(F.col("asks") == 0).over(every), "blank_runs": F.max((F.col("asks") == 0) & blank).over(every), "opens": F.row_number().over(every.orderBy(*order)) == 1, "again": F.count(F.lit(1)).over(same) > 0})
    rows = rows.withColumn("opened_blank", F.max(F.col("opens") & blank & (F.col("asks") == 1)).over(every))
    accepted = F.when(blank, F.col("opens") & ~F.col("running")).otherwise(~F.col("blank_runs") & ~F.col("opened_blank") & ~F.col("again"))
    rows = rows.withColumn("accepted", (F.col("asks") == 1) & accepted)
    job = F.when((F.col("asks") == 0) | F.col("accepted"), F.struct(*order))
    newest = F.max(job).over(before)
    mine = F.greatest(F.max(job).over(same), F.max(F.when(blank, job)).over(before))
    rows = rows.withColumn("existing", F.when(~F.col("accepted"), F.when(blank, newest).otherwise(mine)))
    return rows.filter("asks = 1").select("id", "repo_id", "ref", "accepted", F.col("existing.id").alias("existing"))
