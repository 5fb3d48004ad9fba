"""Subjobs under leases: claims, heartbeats, artifacts, results and expiry, each as one step over a snapshot.

Subjobs have id, job_id, layer, status, attempt, max_attempts, lease_owner, attempt_id and lease_expires_at; jobs id,
type and status; requests id and what the worker says of itself. A step gives the rows that change, as they then are: a
worker that comes late, or for another attempt, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = ("CLAIMED", "RUNNING", "ARTIFACT_WRITTEN", "VALIDATING")
#: What a message says of a symbol index that is empty, or took too long.
EMPTY, TOO_LONG = ("%semantically empty .scip%", "%has no semantic rows:%"), "%timeout after%"
TOLERANT = ("SCIP", "AST_TREE_SITTER")
#: The layers of a revision, in order, and what they need.
LAYERS = ("ZOEKT", "AST_TREE_SITTER", "SCIP", "GRAPH_MERGE", "ACTIVATE")


def running(subjobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Subjobs whose job is an index job in progress."""
    return subjobs.join(jobs.filter("type = 'INDEX' AND status = 'IN_PROGRESS'").select(F.col("id").alias("job_id")).distinct(), "job_id", "left_semi")


def claimed(subjobs: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column | int, until: Column) -> DataFrame:
    """requests: id, attempt, owner, attempt_key. One request a subjob; the attempt counts from one, as the worker is told it."""
    waits = F.col("status").isin("QUEUED", "RETRYING")
    free = waits | ((F.col("status") == "CLAIMED") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)))
    met = running(subjobs, jobs).join(requests.withColumnRenamed("attempt", "asked"), "id")
    ok = met.filter(free & (F.col("attempt") == F.col("asked") - 1) & (F.col("attempt") < F.col("max_attempts")))
    return ok.select("id", "job_id", F.lit("CLAIMED").alias("status"), (F.col("attempt") + 1).alias("attempt"), F.col("owner").alias("lease_owner"), F.col("attempt_key").alias("attempt_id"), until.alias("lease_expires_at"))


def _own(subjobs: DataFrame, jobs: DataFrame, requests: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    met = running(subjobs, jobs).join(requests.select("id", "owner", "attempt_key", *(c for c in requests.columns if c not in ("id", "owner", "attempt_key"))), "id")
    return met.filter((F.col("lease_owner") == F.col("owner")) & (F.col("attempt_id") == F.col("attempt_key")) & F.col("status").isin(*statuses))


def heartbeat(subjobs: DataFrame, jobs: DataFrame, requests: DataFrame, until: Column) -> DataFrame:
    status = F.when(F.col("status").isin("CLAIMED", "RUNNING"), "RUNNING").otherwise(F.col("status"))
    return _own(subjobs, jobs, requests, HELD).select("id", status.alias("status"), until.alias("lease_expires_at"))


def artifact(subjobs: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column | int) -> DataFrame:
    ok = _own(subjobs, jobs, requests, HELD[:3]).filter(F.col("lease_expires_at") > now)
    return ok.select("id", F.lit("ARTIFACT_WRITTEN").alias("status"), "sha256")


def succeeded(subjobs: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column | int) -> DataFrame:
    return _own(subjobs, jobs, requests, HELD).filter(F.col("lease_expires_at") > now).select("id", F.lit("SUCCEEDED").alias("status"))


def after_failure(message: Column) -> Column:
    """What a failed subjob becomes: an empty or slow symbol index is left out, others are tried again while they may be."""
    said = F.coalesce(message, F.lit(""))
    nothing = said.ilike(EMPTY[0]) | said.ilike(EMPTY[1]) | said.ilike(TOO_LONG)
    again = F.when(F.col("attempt") < F.col("max_attempts"), "RETRYING").when(F.col("layer").isin(*TOLERANT), "SKIPPED").otherwise("FAILED")
    return F.when((F.col("layer") == "SCIP") & nothing, "SKIPPED").otherwise(again)


def failed(subjobs: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column | int) -> DataFrame:
    """requests also have a message."""
    ok = _own(subjobs, jobs, requests, HELD).filter(F.col("lease_expires_at") > now)
    out = after_failure(F.col("message"))
    return ok.select("id", "layer", out.alias("status"), (out != "RETRYING").alias("completed"))


def expired(subjobs: DataFrame, jobs: DataFrame, now: Column | int, most: int) -> DataFrame:
    """Held subjobs whose lease is over, the longest over first: tried again, left out, failed, or canceled with their job."""
    over = subjobs.join(jobs.select(F.col("id").alias("job_id"), F.col("type").alias("job_type"), F.col("status").alias("job_status")), "job_id").filter(F.col("status").isin(*HELD) & (F.col("lease_expires_at") < now))
    over = over.orderBy("lease_expires_at", "id").limit(most)
    alive = (F.col("job_type") == "INDEX") & (F.col("job_status") == "IN_PROGRESS")
    again = F.when(F.col("attempt") < F.col("max_attempts"), "RETRYING").when(F.col("layer").isin(*TOLERANT), "SKIPPED").otherwise("FAILED")
    out = F.when(alive, again).otherwise("CANCELED")
    return over.select("id", "job_id", "layer", out.alias("status"), (out != "RETRYING").alias("completed"))


def updated(subjobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot with new statuses; a row that changes loses its lease."""
    new = changes.select("id", F.col("status").alias("__new"))
    met = subjobs.join(new, "id", "left")
    lease = [c for c in ("lease_owner", "attempt_id", "lease_expires_at") if c in subjobs.columns]
    return met.withColumns({"status": F.coalesce("__new", "status"), **{c: F.when(F.col("__new").isNull(), F.col(c)) for c in lease}}).drop("__new").select(*subjobs.columns)


def cycle(subjobs: DataFrame, jobs: DataFrame, queued: DataFrame, now: Column | int, most: int = 1000) -> DataFrame:
    """One round of the dispatcher as (step, id): expired leases, dependents of lost jobs, then what may run.

    queued holds task ids (subjob and attempt) that the queue has already: those are duplicates, once each.
    """
    from quarry.operators import jobs as J

    over = expired(subjobs, jobs, now, most)
    after = updated(subjobs, over)
    lost = J.canceled_dependents(after)
    after = updated(after, lost.select("id", F.lit("CANCELED").alias("status")))
    ready = J.dispatchable(running(after, jobs)).withColumn("task", F.concat_ws(":", "id", (F.col("attempt") + 1).cast("string")))
    step = F.when(F.col("have").isNotNull(), "duplicate").otherwise("enqueued")
    sent = ready.join(queued.select("task", F.lit(True).alias("have")).distinct(), "task", "left").select(step.alias("step"), "id")
    return over.select(F.lit("requeued").alias("step"), "id").unionByName(lost.select(F.lit("reconciled").alias("step"), "id")).unionByName(sent)


def planned(revisions: DataFrame) -> DataFrame:
    """Subjobs (revision, place, layer, project) of revisions with flags and a list of projects; wrong plans raise.

    A merge needs a producer of facts, an activation any producer or a merge.
    """
    some = F.col("run_ast") | (F.size("projects") > 0)
    wrong = (F.col("run_merge") & ~some) | (F.col("run_activate") & ~(F.col("run_lexical") | some) & ~F.col("run_merge"))
    core = lambda flag, layer, place: F.when(F.col(flag), F.array(F.struct(F.lit(place).alias("place"), F.lit(layer).alias("layer"), F.lit(None).cast("string").alias("project")))).otherwise(F.array())
    projects = F.transform("projects", lambda p: F.struct(F.lit(2).alias("place"), F.lit("SCIP").alias("layer"), p.alias("project")))
    rows = F.concat(core("run_lexical", LAYERS[0], 0), core("run_ast", LAYERS[1], 1), projects, core("run_merge", LAYERS[3], 3), core("run_activate", LAYERS[4], 4))
    checked = F.when(wrong, F.raise_error(F.lit("a merge needs facts, and an activation a producer")).cast("string")).otherwise(F.col("revision"))
    return revisions.select(checked.alias("revision"), F.explode(rows).alias("x")).select("revision", "x.place", "x.layer", "x.project")
