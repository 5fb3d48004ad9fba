"""Degrees, hubs and bounded traversal of the code graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUB_FLOOR, FEWEST = 50, 4


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vid")).groupBy("vid").agg(F.count(F.lit(1)).alias("degree"))


def hub_threshold(degree: DataFrame) -> DataFrame:
    """One row: the degree at place ``n * 99 / 100`` (from 0) of all in order, 50 at least.

    Places come from counts by degree, of which there are few, so no task sorts all vertices.
    """
    by = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    upto = by.withColumn("upto", F.sum("n").over(Window.orderBy("degree")))
    place = F.floor(F.col("total") * 99 / 100)
    return upto.crossJoin(F.broadcast(total)).filter(F.col("upto") > place).agg(F.greatest(F.min("degree"), F.lit(HUB_FLOOR)).cast("long").alias("threshold"))


def without_hubs(edges: DataFrame) -> DataFrame:
    """Edges (with depth) less those deeper than 1 that leave a hub; fewer than four edges stay as they are."""
    degree = degrees(edges)
    some = edges.limit(FEWEST).agg((F.count(F.lit(1)) >= FEWEST).alias("some"))
    hubs = degree.crossJoin(F.broadcast(hub_threshold(degree))).crossJoin(F.broadcast(some)).filter("some AND degree >= threshold")  # one row each
    return edges.join(hubs.select(F.col("vid").alias("src"), F.lit(True).alias("hub")), "src", "left").filter("depth <= 1 OR hub IS NULL").drop("hub")


def hops(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = True) -> DataFrame:
    """(vid, depth) of what lies within ``depth`` hops of the seeds, each vertex at its least depth.

    The visited set is a DataFrame; a hop is a join and an anti join, so the frontier may be of any size.
    """
    step = edges.select(F.col("src").alias("vid"), F.col("dst").alias("next"))
    if both:
        step = step.unionByName(edges.select(F.col("dst").alias("vid"), F.col("src").alias("next")))
    seen = front = kept(seeds.select("vid").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        near = step.join(front.select("vid"), "vid").select(F.col("next").alias("vid")).distinct()
        front = kept(near.join(seen.select("vid"), "vid", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def kept(df: DataFrame) -> DataFrame:
    """A front, computed once: a table in the session's folder for checkpoints (a checkpoint computes its rows twice), else cached, which an executor may lose."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def diversified(edges: DataFrame, bucket: str, order: list, limit: int) -> DataFrame:
    """Edges in turns over buckets: the best of each, then the second of each, and so on."""
    w = Window.partitionBy(bucket).orderBy(*order)
    return edges.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= limit).orderBy("turn", bucket, *order).limit(limit)
