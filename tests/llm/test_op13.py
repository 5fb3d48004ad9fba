import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import op13_lines as op
from tests.llm import brute

SCHEMA = "doc_id long, text string, doc long, keep string"


def plain(rows):
    key = lambda line: brute.lowered(line.strip(" \t\n\v\f\r"))
    held = {}
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(d)
    out = set()
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (k := key(x)) or len(k) < 10 or min(held[k]) == d]
        out.add((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    out = op.marked(df).selectExpr("all.doc_id", "mark.n_lines", "mark.n_dropped", "sha2(mark.text, 256)")
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    r = random.Random(seed)
    pool = ["a shared line of text", "A SHARED line of text\r", "short", "exactly10!", "nine char", "élan vital à", "  padded line here \t", "padded line here", ""]
    rows = [(d * 3 - 40, "\n".join(r.choice([*pool, f"own {r.randint(0, 9**9)} line"]) for _ in range(r.randint(0, 12)))) for d in range(80)]
    got = run(spark, rows)
    assert len(got) == 80 and set(got) == plain(rows)


def test_one_line_over_all_partitions(spark):
    """A line that most rows hold, alone and many times, spans partitions and is settled between them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = [(d, "\n".join(["the common line of all"] * (300 if d == 5 else 3) + [f"line number {d} alone"])) for d in range(5, 200)]
        assert set(run(spark, rows)) == plain(rows)
        told = op.told(op.hashed(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)))
        assert told.filter("kind = 1").select("high").distinct().count() >= 1 and told.filter("kind = 2").count() == 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    long = "\n".join(f"line {i % 5000} of a very long text" for i in range(40_000)) + "\n" + "x" * 300_000
    rows = [(1, None), (2, ""), (3, "\n"), (4, long), (5, long), (6, "the same text twice"), (6, "the same text twice"), (6, "the same text twice\nand more"), (7, "THE SAME TEXT TWICE"), (8, "\n\n the same text twice \n\n")]
    got = run(spark, rows)
    assert set(got) == plain(rows) and len(got) == len(rows)
    pair = "a line of ten or more"
    want = {(None if d == 99 else d, *rest) for d, *rest in plain([(99, pair), (3, pair)])}
    assert set(run(spark, [(None, pair), (3, pair)])) == want
    assert run(spark, []) == []


def test_bitmaps_and_columns(spark):
    rows = [(1, "first shared line\nown line of one", 5, "k"), (2, "own line of two\nfirst shared line\nlast line of two", 6, "k"), (3, None, 7, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = op.bitmaps(docs)[0].collect()
    assert [(r.doc, r.n_lines, r.n_dropped) for r in one] == [(2, 3, 1)]
    assert np.unpackbits(np.frombuffer(zlib.decompress(one[0].keep), np.uint8), bitorder="little")[:3].tolist() == [1, 0, 1]
    got = {tuple(r) for r in op.without(docs).collect()}
    assert got == {rows[0], (2, "own line of two\nlast line of two", 6, "k"), rows[2]}
    assert op.without(docs).columns == docs.columns
