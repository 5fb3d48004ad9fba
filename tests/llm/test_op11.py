import math
import random

import pytest

from quarry.llm import op11_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, list string"


def brute(rows):
    """Every score, by the contract's words."""
    good = []
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, first = [], {}
    for i, label, v in good:
        if i % 100 == 0:
            first[i] = min(first.get(i, (label, v)), (label, v))
    for i, (label, v) in first.items():
        scores = [(-dot(v, w), j, other == label) for j, other, w in good if j != i]
        for p, j, _ in sorted(x for x in scores if x[2])[:5]:
            window = sorted((s, n) for s, n, same in scores if not same and -80 * p <= -100 * s <= -100 * p)[:5]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n) in enumerate(window)]
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x")[:4] for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in op.mined(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert sorted(got) == sorted(brute(rows))
    return got


def vectors(r, n, dim, centres):
    at = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x / 4 + r.gauss(0, 0.08) for x in r.choice(at)], r.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(op, "STRIP", 16)
    monkeypatch.setattr(op, "ANCHORS", 2)
    assert check(spark, vectors(r, 700, 6, 12))


def test_ties_and_a_hot_vector(spark):
    r = random.Random(3)
    rows = vectors(r, 400, 4, 5)
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.125], i % 3) for i in range(300)]
    assert check(spark, rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [None, 1.0], 2), (4, [float("nan"), 1.0], 2), (5, [float("inf"), 1.0], 2), (6, None, 2), (None, [1.0, 0.5], 2), (8, [1.0, 0.5], None), (9, [], 2)]
    rows += [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.5, 0.5], 0), (200, [-1.0, -0.5], 3), (201, [1.0, 0.5], 3), (11, [1.0], 2), (12, [0.95, 0.5, 0.1], 2), (2, [0.9, 0.5], 2), (300, [1.0, 0.0], 7)]
    check(spark, rows)


def test_empty(spark):
    assert op.mined(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_outside_of_bounds_are_passed_over(spark):
    """Bounds hold for every row of a list, and leave lists out."""
    r = random.Random(5)
    rows = op.usable(spark.createDataFrame([(*x, "x") for x in vectors(r, 500, 8, 10)], SCHEMA))
    index = op.build(rows)
    import numpy as np

    table = index.table.toPandas()
    x = np.array(table["vector"].tolist(), float)
    low, high = index.bounds(x[:20])
    scores = x[:20] @ x.T
    assert (scores <= high[:, table["list"]]).all() and (scores >= low[:, table["list"]]).all()
    assert (high < np.sort(scores, axis=1)[:, -6][:, None]).mean() > 0.3
