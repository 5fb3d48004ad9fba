import random
from datetime import datetime, timedelta

import pytest

from quarry.llm import op12_survivorship as op

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, record string, at int"
TRUST = {"crm": 0, "web": 1, "store": 2, "partner": 3}


def clean(s):
    return None if s is None or not s.strip(" \t\n\v\f\r") else s


def brute(rows):
    """Each field of each cluster, by the contract's words."""
    groups, out = {}, set()
    for r in rows:
        groups.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    for cluster, g in groups.items():
        latest = max((r[3] for r in g if r[3]), default=None)
        recent = lambda r: (r[3] is None, -(r[3] - datetime(1970, 1, 1)).total_seconds() if r[3] else 0, TRUST.get(r[2], 4), r[0])
        stale = lambda r: r[3] is None or latest - r[3] > timedelta(hours=1440)
        trusted = lambda r: (stale(r), TRUST.get(r[2], 4), recent(r))
        first = lambda order, field: next(((field(r), r[0]) for r in sorted(g, key=order) if field(r) is not None), (None, None))
        segment, segment_from = first(recent, lambda r: clean(r[8]))
        email, email_from = first(trusted, lambda r: clean(r[5]))
        name, name_from = first(lambda r: (-len(clean(r[4]) or ""), trusted(r)), lambda r: clean(r[4]))
        balance, balance_from = first(lambda r: (clean(r[8]) != segment, recent(r)), lambda r: r[9])
        a = min(g, key=lambda r: ((clean(r[6]) is None) + (r[7] is None), recent(r)))
        given = clean(a[6]) is not None or a[7] is not None
        cents = None if balance is None else int((100 * balance + 0.5) // 1)
        out.add((cluster, len(g), sum(map(stale, g)), name, email, segment, clean(a[6]), a[7], cents, name_from, email_from, segment_from, balance_from, a[0] if given else None))
    return out


def rows_of(r, n, clusters):
    out = []
    for i in range(n):
        at = None if r.random() < 0.1 else datetime(2024, 1, 1) + timedelta(days=r.choice((0, 1, 40, 60, 61, 100)), microseconds=r.choice((0, 0, 1)))
        pick = lambda *x: r.choice((None, "", " \t", *x))
        out.append((i, None if r.random() < 0.1 else r.choice(clusters), r.choice(("crm", "web", "store", "partner", "else", None)), at, pick("Ann", "Bobo", "Cé", "Dora", "Évie"), pick("a@x", "b@x"), pick("P", "Q"), r.choice((None, 1, 2)), pick("r", "s", "t"), r.choice((None, 1.005, -2.5, 3.0)), "x", 1))
    return out


def check(spark, rows, parts=3):
    got = [tuple(x) for x in op.golden(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


@pytest.mark.parametrize("batch", (1, 7, 10_000))
def test_random(spark, batch):
    r = random.Random(batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(spark, rows_of(r, 400, [*range(10_000, 10_060), 5, 6]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_cluster_over_all_partitions(spark):
    """Half of the rows have one cluster, without a segment in its most recent rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for seed in range(3):
            r = random.Random(seed)
            rows = rows_of(r, 300, [77]) + [(1000 + x[0], *x[1:]) for x in rows_of(r, 200, range(3000, 3100))]
            cut = sorted((x[3] for x in rows if x[3]))[-150 * (seed > 0)]
            rows = [(*x[:8], None if x[3] and x[3] >= cut else x[8], *x[9:]) for x in rows]
            check(spark, rows, 5)
            places = op.folded(spark.createDataFrame(rows, SCHEMA)).filter("part.cluster_id = 77").select("place").distinct().count()
            assert places > 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    now = datetime(2024, 5, 1)
    rows = [(1, None, None, None, None, None, None, None, None, None, None, None), (2, 1, "web", now, "x" * 100_000, " ", "\n", 3, "s", float("inf"), "r", 0), (2, 1, "web", now, "x" * 100_000, " ", "\n", 3, "s", float("inf"), "r", 0), (None, None, "crm", now, "N", None, "C", None, None, 0.5, None, None), (None, None, "crm", now, "M", None, "C", None, None, 0.5, None, None)]
    got = {r.cluster_id: r for r in op.golden(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, None} and got[1].n_records == 3 and got[1].n_stale == 1 and got[1].balance_cents is None and got[1].name_from == 2 and got[1].nation_id == 3
    assert got[None].n_records == 2 and got[None].balance_cents == 50 and got[None].balance_from is None
    assert op.golden(spark.createDataFrame([], SCHEMA)).count() == 0


def test_times_of_a_zone(spark):
    """Times with a zone give the same records."""
    r = random.Random(8)
    rows = rows_of(r, 60, [1, 2, 3])
    df = spark.createDataFrame(rows, SCHEMA)
    zoned = df.withColumn("updated_at", df.updated_at.cast("timestamp"))
    assert {tuple(x) for x in op.golden(zoned).collect()} == brute(rows)
