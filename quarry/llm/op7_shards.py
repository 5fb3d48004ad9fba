"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Law ``rows``: shard counts differ by one at most. The ring has a fixed number of
cells. Each shard has virtual nodes on it; a cell belongs to the next node clockwise.
One aggregate counts the documents of each cell. From these counts, a bounded table,
the driver walks the ring once: the documents of a cell fill its own shard up to the
shard's bound and those left over go on clockwise to the next shard with room. The
result is, for each cell, runs of ranks with their shards and first slots. A document
then needs only its rank in its cell. Cells are many, so no task holds a shard.

Only DataFrame functions touch rows. Defined results: a null text has size 16 and the
CRC of nothing; equal rows take neighbouring slots; a null id has a place on the ring
like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, NODES, CELLS = 40, 128, 1 << 13
PLAN = "cell int, low long, high long, shard int, first_slot long"


def _spread(x: int) -> int:
    """A fixed 64-bit mixer for node places."""
    x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return x ^ (x >> 31)


@cache
def ring(shards: int, nodes: int, cells: int) -> tuple[tuple[int, int], ...]:
    """Places and shards of the virtual nodes, clockwise. A shard's places don't depend on how many shards there are."""
    return tuple(sorted((_spread(s * 1_000_003 + v) % cells, s) for s in range(shards) for v in range(nodes)))


def deal(counts: dict[int, int], shards: int = SHARDS, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, low, high, shard, first slot): ranks low to high - 1 of the cell's documents go to the shard."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, around, out = [0] * shards, ring(shards, nodes, cells), []
    places = [p for p, _ in around]
    after = list(range(1, len(around))) + [0]  # the next node that may have room, shortened as shards fill up
    for cell in sorted(counts):
        left, rank = counts[cell], 0
        at = bisect.bisect_left(places, cell) % len(around)
        passed = []
        while left:
            shard = around[at][1]
            n = min(left, room[shard] - used[shard])
            if n:
                out.append((cell, rank, rank + n, shard, used[shard]))
                used[shard] += n
                rank, left = rank + n, left - n
            if left:
                passed.append(at)
                at = after[at]
        for p in passed:
            after[p] = at
    return out


def moved(counts: dict[int, int], shards: int = SHARDS, nodes: int = NODES, cells: int = CELLS) -> int:
    """How many documents a plan takes past their first shard."""
    around = ring(shards, nodes, cells)
    places = [p for p, _ in around]
    return sum(high - low for cell, low, high, shard, _ in deal(counts, shards, nodes, cells) if around[bisect.bisect_left(places, cell) % len(around)][1] != shard)


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document."""
    spark = docs.sparkSession
    place = F.xxhash64("doc_id")
    cell = F.pmod(F.shiftrightunsigned(place, 17), F.lit(cells)).cast("int")
    counts = {r.cell: r.n for r in docs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``cells`` rows
    plan = spark.createDataFrame(deal(counts, shards, nodes, cells), PLAN)  # at most cells + nodes rows and the runs between
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), cell.alias("cell"), place.alias("place"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")) - 1)
    dealt = ranked.join(F.broadcast(plan), (ranked.cell == plan.cell) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
