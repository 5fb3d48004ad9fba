"""Hard negatives by inverted lists with radii: exact, by bounds that prove what need not be read.

Centroids are fitted by k-means on a bounded sample; every row goes to the list of its
nearest centroid, and each list keeps the greatest distance of its rows, its radius. For
an anchor q, no row of a list scores more than q.c + |q| r nor less than q.c - |q| r
(Cauchy-Schwarz), and so:

1. Each anchor looks into the ``PROBES`` lists of highest bound for its positives. That
   gives a k-th score that is reached in any case.
2. All lists are read; an anchor visits those whose bound is not below its k-th score,
   which rises while a task goes on. Ties at the k-th score are visited, so nothing is lost.
3. With the positives known, each has a window of scores for its negatives. Lists whose
   bounds lie outside of all windows of an anchor are passed over, and so are those whose
   bound is below the k-th score found in each window.

Anchors come in blocks of some ``ANCHORS`` / 2, which are broadcast; the rows never move
for a search, and each task returns a few candidates an anchor. Lists are range-partitioned
by (list, vec_id), so that a list with a third of all rows is read by many tasks.

Defined results: rows with a null vec_id, label or vector, an empty vector, or a component
that is null or not finite take no part; of rows with an anchor's vec_id the one with the
least label and vector is the anchor, and none of them is its positive or negative; other
repeated rows count as often as they occur; a shorter vector counts as followed by zeros;
floored components are limited to 2^24 either way and scores are exact below 2^53; an anchor without
positives or a positive without negatives gives no row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import scratch

POSITIVES = NEGATIVES = 5
#: Negatives score at least 80 hundredths of the positive's score, and at most as much.
LOW, HIGH = 80, 100
#: Rows that the centroids are fitted on at most, lists at most, and rounds of the fit.
SAMPLE, LISTS, ROUNDS = 16_384, 1024, 8
#: Anchors broadcast at a time at most (blocks are by hash, half as large on average), and lists that an anchor looks into first.
ANCHORS, PROBES = 4096, 4
#: Rows multiplied at a time.
STRIP = 2048
LIMIT = 1 << 24
#: Below any score.
NONE = -(1 << 62)
ROW = "vec_id long, label long, vector array<int>"
LISTED = f"list int, distance double, {ROW}"
FOUND = "anchor_id long, place int, other long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part: relabelled, with floored components."""
    v = F.col("embedding").cast("array<double>")
    whole = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    floored = F.transform(v, lambda x: F.greatest(F.least(F.floor(256 * x), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    label = F.col("label").cast("long")
    part = rows.filter(whole & F.col("vec_id").isNotNull() & label.isNotNull())
    return part.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), floored.alias("vector"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` doubles; shorter ones are followed by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list and the distance of each row."""
    gap = (centroids**2).sum(1)[None, :] - 2 * (x @ centroids.T)
    at = gap.argmin(1)
    return at.astype(np.int32), np.sqrt(((x - centroids[at]) ** 2).sum(1))


def fit(rows: DataFrame, dim: int, lists: int) -> np.ndarray:
    """Centroids of a bounded sample: the rows whose hashes are least."""
    table = rows.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    x = matrix(table.column("vector"), dim)
    centroids = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(ROUNDS):
        at, _ = nearest(x, centroids)
        counts = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


class Index:
    """Centroids and radii; the lists are a table sorted by list."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, radii: np.ndarray, dim: int):
        self.table, self.centroids, self.radii, self.dim = table, centroids, radii, dim

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a row of each list can have, with room for rounding."""
        middle = q @ self.centroids.T
        reach = np.sqrt((q**2).sum(1))[:, None] * self.radii[None, :] * (1 + 1e-9) + 1 + np.abs(middle) * 1e-9
        return middle - reach, middle + reach


def build(rows: DataFrame) -> Index:
    """The index over every row."""
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = dim or 1
    centroids = fit(rows, dim, max(1, min(LISTS, int(n**0.5)))) if n else np.zeros((1, dim))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # LISTS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(matrix(batch.column("vector"), dim), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(distance), *batch.columns], ["list", "distance", *batch.schema.names])

    order = ["list", "vec_id"]
    listed, path = scratch.keep(rows.mapInArrow(assign, LISTED), "listed")
    table, _ = scratch.keep(listed.repartitionByRange(*order).sortWithinPartitions(*order), "lists")
    scratch.drop(rows.sparkSession, path)
    radii = np.zeros(len(centroids))
    for r in table.groupBy("list").agg(F.max("distance").alias("radius")).collect():  # LISTS rows at most
        radii[r.list] = r.radius
    return Index(table, centroids, radii, dim)


def blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with a ``block`` of ANCHORS / 2 on average, by a hash, and the number of blocks."""
    anchors = rows.filter(F.col("vec_id") % 100 == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("first")).select("vec_id", "first.label", "first.vector")
    anchors, _ = scratch.keep(anchors, "anchors")
    n = -(-anchors.count() // max(1, ANCHORS // 2))
    return anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n)))), n


class Queries:
    """A block of anchors with, for each, ``windows`` of scores and how many rows each wants."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool, want: int, low: np.ndarray, high: np.ndarray, least: np.ndarray, lists: np.ndarray | None):
        self.ids, self.labels, self.q, self.same, self.want = ids, labels, q, same, want
        self.low, self.high, self.least, self.lists = low, high, least, lists  # (anchors, windows); least: a k-th score that is reached


def candidates(index: Index, asked: Queries) -> DataFrame:
    """For each anchor and window the best rows of each task, by score and then vec_id."""
    spark = index.table.sparkSession
    lower, upper = index.bounds(asked.q)
    shared = spark.sparkContext.broadcast((asked, lower, upper))  # ANCHORS rows at most
    dim = index.dim

    def strip(asked: Queries, live: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, best: np.ndarray, whose: np.ndarray) -> None:
        """Merge one strip of rows of a list, in order of vec_id, into the best so far."""
        scores = (asked.q[live] @ x.T).astype(np.int64)
        fits = (labels[None, :] == asked.labels[live][:, None]) == asked.same
        fits &= ids[None, :] != asked.ids[live][:, None]
        n = x.shape[0]
        for w in range(asked.low.shape[1]):
            good = fits & (scores >= asked.low[live, w][:, None]) & (scores <= asked.high[live, w][:, None])
            good &= scores >= np.maximum(best[live, w, -1], asked.least[live, w])[:, None]
            hit = np.flatnonzero(good.any(1))
            if not len(hit):
                continue
            at = live[hit]
            key = np.where(good[hit], scores[hit], NONE)
            k = min(asked.want, n)
            # equal scores: the row that comes first has the smaller id
            order = np.argsort(-key, axis=1, kind="stable") if k == n else _top(key, k)
            new, owner = np.take_along_axis(key, order, 1), ids[order]
            both, owners = np.concatenate([best[at, w], new], 1), np.concatenate([whose[at, w], owner], 1)
            rank = np.lexsort((owners, -both), axis=1)[:, : asked.want]
            best[at, w], whose[at, w] = np.take_along_axis(both, rank, 1), np.take_along_axis(owners, rank, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, lower, upper = shared.value
        shape = (*asked.low.shape, asked.want)
        best, whose = np.full(shape, NONE, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            lists = batch.column("list").to_numpy()
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else []
            for a, b in zip(cuts, [*cuts[1:], len(lists)], strict=True):
                c = lists[a]
                reached = np.maximum(best[:, :, -1], asked.least)
                live = ((upper[:, c, None] >= np.maximum(reached, asked.low)) & (lower[:, c, None] <= asked.high)).any(1)
                if asked.lists is not None:
                    live &= (asked.lists == c).any(1)
                live = np.flatnonzero(live)
                if not len(live):
                    continue
                x = matrix(batch.column("vector").slice(a, b - a), dim)
                for s in range(0, b - a, STRIP):
                    part = slice(a + s, min(a + s + STRIP, b))
                    for one in range(0, len(live), STRIP // 4):
                        strip(asked, live[one : one + STRIP // 4], ids[part], labels[part], x[s : s + STRIP], best, whose)
        i, w, k = np.nonzero(best > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[i]), pa.array(w.astype(np.int32)), pa.array(whose[i, w, k]), pa.array(best[i, w, k])], ["anchor_id", "place", "other", "score"])

    return index.table.select("list", "vec_id", "label", "vector").mapInArrow(run, FOUND)


def _top(key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row; of equal ones those that come first."""
    kth = np.partition(key, key.shape[1] - k, axis=1)[:, -k][:, None]
    above, equal = key > kth, key == kth
    keep = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1)[:, None]))
    return np.nonzero(keep)[1].reshape(len(key), k)


def firsts(found: DataFrame, want: int) -> DataFrame:
    """The best of all tasks, ranked."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want)


def mined(rows: DataFrame) -> DataFrame:
    """Positives of each anchor and hard negatives of each positive."""
    spark = rows.sparkSession
    index = build(usable(rows))
    anchors, n_blocks = blocks(index.table)
    out = []
    for block in range(n_blocks):
        own = anchors.filter(F.col("block") == block).drop("block").toArrow()
        if not own.num_rows:
            continue
        ids, labels, q = own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("vector"), index.dim)
        n = len(ids)
        every = np.full((n, 1), NONE), np.full((n, 1), -NONE)
        probes = np.argsort(-index.bounds(q)[1], axis=1, kind="stable")[:, :PROBES]
        start = firsts(candidates(index, Queries(ids, labels, q, True, POSITIVES, *every, np.full((n, 1), NONE), probes)), POSITIVES).toPandas()
        place = {x: i for i, x in enumerate(ids.tolist())}
        least = np.full((n, 1), NONE)
        for r in start[start["rank"] == POSITIVES].itertuples():
            least[place[r.anchor_id], 0] = r.score
        positive = firsts(candidates(index, Queries(ids, labels, q, True, POSITIVES, *every, least, None)), POSITIVES).select("anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place"))
        positive = positive.collect()  # POSITIVES rows an anchor of the block
        low, high = np.full((n, POSITIVES), -NONE), np.full((n, POSITIVES), NONE)  # of a place without a positive: empty
        for r in positive:
            low[place[r.anchor_id], r.place], high[place[r.anchor_id], r.place] = -(-LOW * r.positive_score // 100), HIGH * r.positive_score // 100
        negative = firsts(candidates(index, Queries(ids, labels, q, False, NEGATIVES, low, high, low, None)), NEGATIVES)
        known = F.broadcast(spark.createDataFrame(positive, "anchor_id long, positive_id long, positive_score long, place int"))
        out.append(negative.join(known, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
