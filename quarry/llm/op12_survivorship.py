"""One golden record per cluster of client records, by a segmented scan.

Rows are range-partitioned and sorted by (cluster, RECENT), so a cluster of any size
spans as many partitions as it needs. Each partition is folded once, batch by batch, in
numpy: a run of one cluster becomes a summary of fixed size, and a run that goes on in the
next batch is merged with it. Inner clusters leave as records; the first and the last run
of a partition leave as summaries, two a partition at most. The driver joins these in
order, as a segmented scan. What a partition in the middle of a cluster cannot know, the
cluster's latest time and chosen segment, is asked for in one more aggregation over the
rows of the clusters that span partitions, of which there are fewer than partitions.

A summary needs no threshold of staleness: of each level of trust it holds the most recent
candidate, and a level has a fresh candidate only if its most recent one is fresh.

RECENT: updated_at falling, null last, then trust, then client_id.

Defined results: strings that are empty or white are null; a source that is null or not
listed has the least trust; a null client_id comes last and is given as null; where both
ids are null, the rows are one cluster with a null id; rows that agree in all of RECENT are
ordered by a hash of their values, so repeated rows give the same record; a balance that is
not finite counts as null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import scratch

#: Sources by falling trust; others come after all of these.
SOURCES = ("crm", "web", "store", "partner")
LEVELS = len(SOURCES) + 1
#: A record is stale if it is more than so many microseconds older than its cluster's latest.
STALE = 60 * 24 * 3600 * 1_000_000
NONE = np.iinfo(np.int64).max
NEVER = np.iinfo(np.int64).min

RECORD = "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id int, balance_cents long, name_from long, email_from long, segment_from long, balance_from long, address_from long"
#: A candidate: when it was updated (microseconds; null: never), trust, client and value.
CANDIDATE = "at long, trust int, client_id long, value string"
SUMMARY = f"cluster_id long, n_records long, latest long, n_stale long, emails array<struct<{CANDIDATE}>>, longest int, names array<struct<{CANDIDATE}>>, segment string, segment_from long, filled int, city string, nation_id int, address_from long, balance double, balance_from long, own boolean"
FOLDED = f"place int, turn int, record struct<{RECORD}>, part struct<{SUMMARY}>"
VALUES = ("name", "email", "city", "segment", "nation_id", "balance")


def arrow(of: str) -> pa.StructType:
    """The Arrow type of a struct stated above."""
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    lists = {f"array<struct<{CANDIDATE}>>": "candidates"}
    for text, name in lists.items():
        of = of.replace(text, name)
    return pa.struct([(name, pa.list_(arrow(CANDIDATE)) if kind == "candidates" else plain[kind]) for name, kind in (f.split() for f in of.split(", "))])


def said(value: Column) -> Column:
    """Null for strings without ink."""
    return F.when(~value.rlike(r"^[\x20\x09-\x0D]*$"), value)


def micros(clients: DataFrame) -> Column:
    """updated_at in microseconds since 1970, of times without a zone without asking the session's."""
    if dict(clients.dtypes)["updated_at"] != "timestamp_ntz":
        return F.unix_micros(F.col("updated_at").cast("timestamp"))
    since = F.col("updated_at") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, hours, minutes, seconds = (F.extract(F.lit(u), since) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return ((days.cast("long") * 24 + hours) * 60 + minutes) * 60_000_000 + (seconds * 1_000_000).cast("long")


def rows(clients: DataFrame) -> DataFrame:
    """The columns that count, in their clean form, with the keys of RECENT."""
    trust = F.lit(len(SOURCES))
    for level, source in reversed(list(enumerate(SOURCES))):
        trust = F.when(F.col("source") == source, F.lit(level)).otherwise(trust)
    balance = F.col("balance").cast("double")
    finite = ~F.isnan(balance) & (F.abs(balance) < F.lit(float("inf")))
    return clients.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"), F.col("client_id").cast("long").alias("client_id"), micros(clients).alias("at"), trust.alias("trust"),
        *[said(F.col(c)).alias(c) for c in ("name", "email", "city", "segment")], F.col("nation_id").cast("int").alias("nation_id"), F.when(finite, balance).alias("balance"),
    )


def recent() -> list[Column]:
    tie = F.xxhash64(*VALUES)
    return [F.col("cluster_id").asc_nulls_last(), F.col("at").desc_nulls_last(), F.col("trust").asc(), F.col("client_id").asc_nulls_last(), tie.asc()]


class Batch:
    """Sorted rows as arrays. ``starts`` are the first rows of its runs of one cluster."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.num_rows
        get = batch.column
        self.raw = {c: get(c) for c in ("name", "email", "city", "segment", "cluster_id", "client_id", "nation_id", "balance")}
        self.cluster = pc.fill_null(get("cluster_id"), 0).to_numpy(zero_copy_only=False)
        self.lost = pc.is_null(get("cluster_id")).to_numpy(zero_copy_only=False)
        self.at = pc.fill_null(get("at"), NEVER).to_numpy(zero_copy_only=False)
        self.trust = get("trust").to_numpy(zero_copy_only=False)
        self.has = {c: pc.is_valid(self.raw[c]).to_numpy(zero_copy_only=False) for c in VALUES}
        self.length = pc.fill_null(pc.utf8_length(self.raw["name"]), -1).to_numpy(zero_copy_only=False)
        self.segment = pc.fill_null(self.raw["segment"].dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], (self.cluster[1:] != self.cluster[:-1]) | (self.lost[1:] != self.lost[:-1])])
        self.starts = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.places = np.arange(self.n)

    def first(self, where: np.ndarray) -> np.ndarray:
        """The first such row of each run, or NONE."""
        return np.minimum.reduceat(np.where(where, self.places, NONE), self.starts)

    def of(self, column: str, i: int):
        return self.raw[column][i].as_py() if i != NONE else None

    def candidate(self, column: str, i: int) -> dict | None:
        return None if i == NONE else {"at": None if self.at[i] == NEVER else int(self.at[i]), "trust": int(self.trust[i]), "client_id": self.of("client_id", i), "value": self.of(column, i)}


def summaries(b: Batch, latest_before: int | None, segment_before: str | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """For each run the rows that may supply a field, and the count of stale records.

    The first run may go on from an earlier batch: its latest time and chosen segment then come from there.
    """
    filled = b.has["city"].astype(int) + b.has["nation_id"]
    longest = np.maximum.reduceat(b.length, b.starts)
    long = (b.length == longest[b.run]) & (b.length >= 0)
    out = {f"email{t}": b.first(b.has["email"] & (b.trust == t)) for t in range(LEVELS)}
    out |= {f"name{t}": b.first(long & (b.trust == t)) for t in range(LEVELS)}
    out["address"] = b.first(filled == np.maximum.reduceat(filled, b.starts)[b.run])
    out["segment"] = b.first(b.has["segment"])
    chosen = np.where(out["segment"] == NONE, -1, b.segment[np.minimum(out["segment"], b.n - 1)])
    if segment_before is not None:
        same = pc.equal(b.raw["segment"], segment_before)
        ours = np.where(b.run == 0, pc.fill_null(same, False).to_numpy(zero_copy_only=False), b.segment == chosen[b.run])
    else:
        ours = b.segment == chosen[b.run]
    out["own_balance"], out["any_balance"] = b.first(b.has["balance"] & ours), b.first(b.has["balance"])
    latest = b.at[b.starts].copy()
    if latest_before is not None:
        latest[0] = latest_before
    stale = (b.at == NEVER) | (latest[b.run] - np.where(b.at == NEVER, latest[b.run], b.at) > STALE)
    return out, np.add.reduceat(stale.astype(np.int64), b.starts)


def summary(b: Batch, found: dict[str, np.ndarray], stale: np.ndarray, r: int) -> dict:
    """The summary of one run."""
    end = b.starts[r + 1] if r + 1 < len(b.starts) else b.n
    first, at = b.starts[r], {k: v[r] for k, v in found.items()}
    named = [b.candidate("name", at[f"name{t}"]) for t in range(LEVELS)]
    own = at["own_balance"] if at["own_balance"] != NONE else at["any_balance"]
    address = at["address"]
    filled = int(b.has["city"][address]) + int(b.has["nation_id"][address])
    return {
        "cluster_id": b.of("cluster_id", first), "n_records": int(end - first), "latest": None if b.at[first] == NEVER else int(b.at[first]), "n_stale": int(stale[r]),
        "emails": [c for t in range(LEVELS) if (c := b.candidate("email", at[f"email{t}"]))], "longest": int(np.max(b.length[first:end])), "names": [c for c in named if c],
        "segment": b.of("segment", at["segment"]), "segment_from": b.of("client_id", at["segment"]), "filled": filled, "city": b.of("city", address), "nation_id": b.of("nation_id", address), "address_from": b.of("client_id", address) if filled else None,
        "balance": b.of("balance", own), "balance_from": b.of("client_id", own), "own": at["own_balance"] != NONE,
    }


def merged(one: dict, two: dict) -> dict:
    """The summary of a run whose rows of ``two`` all come after those of ``one``.

    n_stale and balance are right only if two was folded with the latest time and the segment of one.
    """
    out = dict(one)
    out["n_records"] += two["n_records"]
    out["n_stale"] += two["n_stale"]
    have = {c["trust"] for c in one["emails"]}
    out["emails"] = one["emails"] + [c for c in two["emails"] if c["trust"] not in have]
    if two["longest"] > one["longest"]:
        out |= {"longest": two["longest"], "names": two["names"]}
    elif two["longest"] == one["longest"]:
        have = {c["trust"] for c in one["names"]}
        out["names"] = one["names"] + [c for c in two["names"] if c["trust"] not in have]
    if one["segment"] is None:
        out |= {k: two[k] for k in ("segment", "segment_from")}
        if two["segment"] is not None:
            # the segment is chosen only now: balances so far are of other records
            out["own"] = False
    if two["filled"] > one["filled"]:
        out |= {k: two[k] for k in ("filled", "city", "nation_id", "address_from")}
    if (not out["own"] and two["own"]) or out["balance"] is None:
        out |= {k: two[k] for k in ("balance", "balance_from", "own")}
    return out


def best(candidates: list[dict], latest: int | None) -> dict | None:
    """The first by TRUSTED: fresh ones before stale ones, then trust. Each level holds its most recent."""

    def order(c: dict) -> tuple[bool, int]:
        return (latest is None or c["at"] is None or latest - c["at"] > STALE, c["trust"])

    return min(candidates, key=order, default=None)


def cents(balance: float | None) -> int | None:
    return None if balance is None else int(np.floor(100 * balance + 0.5))


def record(s: dict) -> dict:
    """The golden record of a cluster's summary."""
    name, email = best(s["names"], s["latest"]) or {}, best(s["emails"], s["latest"]) or {}
    return {
        "cluster_id": s["cluster_id"], "n_records": s["n_records"], "n_stale": s["n_stale"], "name": name.get("value"), "email": email.get("value"), "segment": s["segment"], "city": s["city"], "nation_id": s["nation_id"],
        "balance_cents": cents(s["balance"]), "name_from": name.get("client_id"), "email_from": email.get("client_id"), "segment_from": s["segment_from"], "balance_from": s["balance_from"], "address_from": s["address_from"],
    }


def records(b: Batch, found: dict[str, np.ndarray], stale: np.ndarray, low: int, high: int) -> pa.StructArray:
    """The golden records of the runs from low to high, without a Python step for each."""
    latest = b.at[b.starts]

    def trusted(field: str) -> np.ndarray:
        pick = np.full(high - low, NONE)
        for fresh in (False, True):  # what comes later wins
            for t in reversed(range(LEVELS)):
                at = found[f"{field}{t}"][low:high]
                when = b.at[np.minimum(at, b.n - 1)]
                old = (when == NEVER) | (latest[low:high] - np.where(when == NEVER, latest[low:high], when) > STALE)
                pick = np.where((at != NONE) & (old != fresh), at, pick)
        return pick

    def take(column: str, at: np.ndarray) -> pa.Array:
        return b.raw[column].take(pa.array(at, pa.int64(), mask=at == NONE))

    name, email, segment, address = trusted("name"), trusted("email"), found["segment"][low:high], found["address"][low:high]
    own, other = found["own_balance"][low:high], found["any_balance"][low:high]
    balance = np.where(own != NONE, own, other)
    counts = np.diff(np.append(b.starts, b.n))[low:high]
    supplies = np.where(b.has["city"][address] | b.has["nation_id"][address], address, NONE)
    amount = pc.cast(pc.floor(pc.add(pc.multiply(take("balance", balance), 100.0), 0.5)), pa.int64(), safe=False)
    columns = [
        take("cluster_id", b.starts[low:high]), pa.array(counts, pa.int64()), pa.array(stale[low:high], pa.int64()), take("name", name), take("email", email), take("segment", segment), take("city", address), take("nation_id", address),
        amount, *[take("client_id", at) for at in (name, email, segment, balance, supplies)],
    ]
    return pa.StructArray.from_arrays(columns, [f.split()[0] for f in RECORD.split(", ")])


def folded(clients: DataFrame) -> DataFrame:
    """Sorted ranges folded: records of inner clusters, and summaries of each partition's first and last run."""
    record_type, part_type = arrow(RECORD), arrow(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, going, turn = TaskContext.get().partitionId(), None, 0

        def part(s: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([turn], pa.int32()), pa.nulls(1, record_type), pa.array([s], part_type)], ["place", "turn", "record", "part"])

        def whole(array: pa.StructArray) -> pa.RecordBatch:
            n = len(array)
            return pa.RecordBatch.from_arrays([pa.array([place] * n, pa.int32()), pa.nulls(n, pa.int32()), array.cast(record_type), pa.nulls(n, part_type)], ["place", "turn", "record", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b = Batch(batch)
            on = going is not None and going["cluster_id"] == b.of("cluster_id", 0)
            found, stale = summaries(b, (NEVER if going["latest"] is None else going["latest"]) if on else None, going["segment"] if on else None)
            runs, low = len(b.starts), 0
            if on:
                going, low = merged(going, summary(b, found, stale, 0)), 1
            if low < runs:  # what went on has ended
                if going is not None:
                    yield part(going) if turn == 0 else whole(pa.array([record(going)], record_type))
                    turn += 1
                if turn == 0 and low < runs - 1:  # the partition's first run
                    yield part(summary(b, found, stale, low))
                    low, turn = low + 1, turn + 1
                if low < runs - 1:
                    yield whole(records(b, found, stale, low, runs - 1))
                    turn += runs - 1 - low
                going = summary(b, found, stale, runs - 1)
        if going is not None:
            yield part(going)

    order = recent()
    return rows(clients).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FOLDED)


def scanned(parts: list[dict]) -> list[tuple[dict, bool]]:
    """Summaries in order of partition and turn, those of one cluster merged; with each, whether it had several."""
    out: list[tuple[dict, bool]] = []
    for s in parts:
        if out and out[-1][0]["cluster_id"] == s["cluster_id"]:
            out[-1] = merged(out[-1][0], s), True
        else:
            out.append((s, False))
    return out


def spanning(clients: DataFrame, several: list[dict]) -> dict:
    """Stale records and balance of the clusters that span partitions, by cluster: one partial aggregation."""
    spark = clients.sparkSession
    asked = spark.createDataFrame([(s["cluster_id"], s["latest"], s["segment"]) for s in several], "a_cluster long, latest long, chosen string")
    r = rows(clients).join(F.broadcast(asked), F.col("cluster_id").eqNullSafe(F.col("a_cluster")))  # fewer rows than partitions
    other = ~F.col("segment").eqNullSafe(F.col("chosen"))
    tie = F.xxhash64(*VALUES)
    order = F.struct(other.alias("other"), F.col("at").isNull().alias("never"), (-F.col("at")).alias("age"), "trust", F.col("client_id").isNull().alias("odd"), "client_id", tie.alias("tie"))
    stale = F.col("at").isNull() | (F.col("latest") - F.col("at") > STALE)
    found = r.groupBy("a_cluster").agg(
        F.count_if(stale).alias("n_stale"),
        F.min_by(F.struct("balance", "client_id"), F.when(F.col("balance").isNotNull(), order)).alias("supplied"),
    )
    return {x.a_cluster: (x.n_stale, *(x.supplied or (None, None))) for x in found.collect()}


def golden(clients: DataFrame) -> DataFrame:
    """One record per cluster."""
    spark = clients.sparkSession
    out, _ = scratch.keep(folded(clients), "folded")
    # two summaries a partition at most, each of fixed size
    parts = sorted(out.filter("part IS NOT NULL").select("place", "turn", "part").collect(), key=lambda r: (r.place, r.turn))
    done = scanned([r.part.asDict(True) for r in parts])
    facts = spanning(clients, [s for s, several in done if several]) if any(x for _, x in done) else {}
    last = []
    for s, several in done:
        if several:
            s["n_stale"], s["balance"], s["balance_from"] = facts[s["cluster_id"]]
        last.append(record(s))
    return out.filter("record IS NOT NULL").select("record.*").unionByName(spark.createDataFrame(last, RECORD))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(spark.read.parquet(f"{sf_dir}/clients.parquet"))
