"""Repository lists, counts and the status that users see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import latest, policy


def listing(repos: DataFrame, jobs: DataFrame, indexes: DataFrame) -> DataFrame:
    """Repositories with their latest job and latest usable index, where there are any."""
    job = latest.latest_job(jobs).select("repo_id", F.col("id").alias("job_id"), F.col("type").alias("job_type"), F.col("status").alias("job_status"))
    index = latest.top(latest.usable(indexes), ["repo_id"], [F.coalesce("indexed_at", "updated_at").desc_nulls_last(), F.col("id").desc()])
    index = index.select("repo_id", F.col("id").alias("index_id"), F.col("status").alias("index_status"))
    return repos.withColumnRenamed("id", "repo_id").join(job, "repo_id", "left").join(index, "repo_id", "left")


def visible(rows: DataFrame) -> DataFrame:
    """Run state of the latest job, and the state to show: a usable index outlives a failed run.

    A repository's index is usable if it was indexed and its policy shows at least one indexed revision. Without a job the
    status that the repository itself keeps of its latest one counts (``latest_status``).
    """
    status = F.coalesce("job_status", "latest_status") if "latest_status" in rows.columns else F.col("job_status")
    run = (
        F.when(status.isin("PENDING", "IN_PROGRESS") & F.coalesce(F.col("job_type") == "REMOVE_INDEX", F.lit(False)), "removing")
        .when(status.isin("PENDING", "IN_PROGRESS"), "indexing")
        .when(status == "FAILED", "failed")
        .when(status == "COMPLETED", "completed")
        .otherwise("none")
    )
    active = F.when(F.col("indexed_at").isNotNull() & (F.size(policy.visible_revisions()) > 0), "indexed").otherwise("not_indexed")
    rows = rows.withColumns({"run": run, "active": active})
    state = F.when(F.col("run").isin("indexing", "removing"), F.col("run")).when((F.col("run") == "failed") & (F.col("active") != "indexed"), "failed").otherwise(F.col("active"))
    rows = rows.withColumn("state", state)
    blocks = F.col("run").isin("indexing", "removing") | ((F.col("run") == "failed") & (F.col("active") != "indexed"))
    return rows.withColumns({"color": color(F.col("state")), "run_color": color(F.col("run")), "blocks": blocks})


def color(state: Column) -> Column:
    return F.when(state.isin("indexed", "completed"), "green").when(state == "failed", "red").when(state.isin("indexing", "removing"), "yellow").otherwise("gray")


def rollup(rows: DataFrame) -> DataFrame:
    """Counts of visible states by organisation."""
    counts = [F.sum(F.when(F.col("state") == s, 1).otherwise(0)).cast("long").alias(s) for s in ("indexed", "not_indexed", "indexing", "removing", "failed")]
    return rows.groupBy("org_id").agg(F.count(F.lit(1)).alias("repos"), *counts)


def index_rollup(indexes: DataFrame) -> DataFrame:
    """One status by repository: partial, indexing or ready by what its indexes are."""
    flags = indexes.groupBy("repo_id").agg(*(F.max(F.when(F.col("status") == s, 1).otherwise(0)).alias(s.lower()) for s in ("READY", "PARTIAL", "INDEXING")))
    status = F.when((F.col("partial") == 1) & (F.col("ready") == 1), "PARTIAL").when(F.col("indexing") == 1, "INDEXING").when(F.col("ready") == 1, "READY").otherwise("UNCHANGED")
    return flags.select("repo_id", status.alias("status"))


def contexts(repos: DataFrame, orgs: DataFrame) -> DataFrame:
    """Names of an organisation's repositories, in order; an empty list where it has none."""
    names = repos.groupBy("org_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))
    return orgs.join(names, "org_id", "left").select("org_id", "name", F.coalesce("names", F.lit("")).alias("names"), F.coalesce("n", F.lit(0)).alias("n"))


def repo_order(sort: str, direction: str) -> list:
    """One of the six orders that a list of repositories may have: dates with nulls last and then by name."""
    column = {"name": "name", "pushed": "pushed_at", "indexedAt": "indexed_at"}.get(sort)
    if column is None or direction not in ("asc", "desc"):
        raise ValueError("sort by name, pushed or indexedAt, asc or desc")
    c = F.col(column)
    if column == "name":
        return [c.asc() if direction == "asc" else c.desc(), F.col("id")]
    return [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last(), F.col("name").asc(), F.col("id")]


def list_repos(repos: DataFrame, query: str = "", sort: str = "name", direction: str = "asc", number: int = 1, size: int = 30) -> DataFrame:
    """A page of repositories whose name holds a text, with the total of all such."""
    from quarry.functions import text
    from quarry.operators import scope

    found = repos.filter(F.col("name").ilike(f"%{text.like_escape(query)}%")) if query else repos
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return scope.page(found, repo_order(sort, direction), number, size).crossJoin(F.broadcast(total))  # one row


def language_models(configs: DataFrame) -> DataFrame:
    """(org_id, config JSON) to provider, model and name to show; the model's where there is none; rows that can't be read go."""
    parsed = configs.select("org_id", F.from_json("config", "provider string, model string, displayName string").alias("c"))
    rows = parsed.select("org_id", "c.provider", "c.model", F.coalesce(F.when(F.trim("c.displayName") != "", F.col("c.displayName")), F.col("c.model")).alias("display_name"))
    return rows.filter("provider IS NOT NULL AND model IS NOT NULL")


#: Statuses of graphs, the best first; any other comes last.
STATUS_RANK = {"READY": 0, "PARTIAL": 1, "BUILDING": 2, "PENDING": 2, "FAILED": 3, "SKIPPED": 4, "DELETING": 5}
#: Rows of the lists that a repository's status shows.
MOST_MANIFESTS, MOST_GRAPHS, MOST_SCIP = 20, 10, 10


def current_graph(graphs: DataFrame) -> DataFrame:
    """The graph of each repository that counts: current ones first, then by status, not superseded, last indexed."""
    from quarry.operators.edges import choice

    current = (F.col("status") == "READY") & (F.col("revisions") > 0)
    order = [current.desc(), choice(F.col("status"), STATUS_RANK, 99), F.col("superseded_at").isNull().desc(), F.coalesce(F.unix_millis(F.col("indexed_at").cast("timestamp")), F.lit(0)).desc(), F.col("id").desc()]
    return latest.top(graphs, ["repo_id"], order)


def chosen_graph(graphs: DataFrame) -> DataFrame:
    """The graph that a list shows: ready and live, ready, else any; the last updated of these."""
    rank = F.when((F.col("status") == "READY") & F.col("superseded_at").isNull(), 0).when(F.col("status") == "READY", 1).otherwise(2)
    return latest.top(graphs, ["repo_id"], [rank, F.col("updated_at").desc_nulls_first(), F.col("id").desc()])


def newest(rows: DataFrame, most: int) -> DataFrame:
    """Of each repository the rows last updated."""
    return latest.top(rows, ["repo_id"], [F.col("updated_at").desc_nulls_first(), F.col("id").desc()], most)


def graph_issues(graphs: DataFrame) -> DataFrame:
    """What a ready graph lacks."""
    some, ready = F.col("edge_count") > 0, F.col("status") == "READY"
    what = {"READY graph has edges but zero anchors": F.col("anchor_count") == 0, "READY graph has edges but zero linked edges": F.col("linked_edge_count") == 0, "READY graph has no Postgres semantic edge rows": F.col("semantic_edge_count") == 0}
    found = F.array_compact(F.array(*(F.when(some & lacks, F.concat(F.lit("graph "), F.col("id").cast("string"), F.lit(f": {said}"))) for said, lacks in what.items())))
    return graphs.filter(ready).select("repo_id", F.explode(found).alias("issue"))


def scip_issues(indexes: DataFrame) -> DataFrame:
    name = F.concat(F.lit("SCIP "), F.col("id").cast("string"))
    said = F.when((F.col("status") == "READY") & (F.col("occurrence_count") == 0), F.concat(name, F.lit(": READY index has zero occurrences")))
    said = said.when(F.col("status").isin("PARTIAL", "INDEXING", "FAILED"), F.concat(name, F.lit(": index is "), F.col("status")))
    return indexes.select("repo_id", said.alias("issue")).filter("issue IS NOT NULL")


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """What ready manifests lack, and pending ones that a ready one of their workspace and branch leaves behind."""
    ready, rows, files = F.col("status") == "READY", F.col("file_rows"), F.col("file_count")
    what = (
        (ready & (files > 0) & (rows == 0), "ready manifest has no linked file rows"),
        (ready & (rows > 0) & (rows != files), "ready manifest file row count does not match fileCount"),
        (ready & (F.col("lexical_strategy") == "FULL_REPO") & ((F.col("changed_files") > 0) | (F.col("deleted_files") > 0)), "Zoekt reindex used full-repo strategy for changed files"),
    )
    named = lambda said: F.concat(F.lit("manifest "), F.col("id").cast("string"), F.lit(f": {said}"))
    live = ready & F.col("superseded_at").isNull()
    own = manifests.filter(live).select("repo_id", F.explode(F.array_compact(F.array(*(F.when(c, named(said)) for c, said in what)))).alias("issue"))
    scopes = manifests.filter(live).select("repo_id", "workspace_id", "branch").distinct()
    stale = manifests.filter("status = 'PENDING'").join(scopes, ["repo_id", "workspace_id", "branch"], "left_semi")
    return own.unionByName(stale.select("repo_id", named("stale pending manifest exists beside active READY manifest").alias("issue")))


def semantic_health(repos: DataFrame, indexes: DataFrame, graphs: DataFrame) -> DataFrame:
    """By repository whether its last usable symbol index and its last live graph hold anything, and whether it needs repair."""
    order = [F.col("indexed_at").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("id").desc()]
    scip = latest.top(indexes.filter(F.col("status").isin("READY", "PARTIAL")), ["repo_id"], order).select("repo_id", (F.col("symbol_count") + F.col("occurrence_count") + F.col("relationship_count")).alias("scip_rows"))
    graph = latest.top(graphs.filter((F.col("status") == "READY") & F.col("superseded_at").isNull()), ["repo_id"], order).select("repo_id", F.col("anchor_count").alias("anchors"), F.col("linked_edge_count").alias("linked"))
    out = repos.select(F.col("id").alias("repo_id")).join(scip, "repo_id", "left").join(graph, "repo_id", "left").na.fill(0)
    return out.withColumn("needs_repair", (F.col("scip_rows") == 0) | (F.col("anchors") == 0) | (F.col("linked") == 0))


def primary_connection(links: DataFrame, connections: DataFrame) -> DataFrame:
    """The connection of each repository that was last updated, the first by id among equals."""
    met = links.join(connections.withColumnRenamed("id", "connection_id"), "connection_id")
    return latest.top(met, ["repo_id"], [F.col("updated_at").desc_nulls_first(), F.col("connection_id")])
