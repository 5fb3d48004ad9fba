import random

import numpy as np
import pytest

from quarry.llm import components, op4_minhash
from quarry.llm import words as W
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def check(spark, rows, k=2):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_minhash.report(docs, k).collect()}
    assert got == brute.near(rows, k)


def copies(r, n, words=60, changes=3):
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_random(spark):
    r = random.Random(5)
    texts = [t for _ in range(12) for t in copies(r, r.randint(1, 12), r.randint(5, 80), 4)]
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_large_families(spark):
    """Families whose members differ by more and less than the threshold, with copies of copies."""
    r = random.Random(9)
    texts = []
    for _ in range(3):
        base = [f"w{r.randint(0, 300)}" for _ in range(80)]
        family = [base]
        for _ in range(70):
            w = r.choice(family)[:] if r.random() < 0.4 else base[:]
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            family.append(w[: len(w) - r.randint(0, 8)])
        texts += [" ".join(w) for w in family]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert len({c for _, c in brute.near(rows, 2).values()}) > 20
    check(spark, rows)


def test_chain_of_links(spark):
    w = [f"w{i}" for i in range(400)]
    check(spark, [(100 - i, " ".join(w[10 * i : 10 * i + 100])) for i in range(30)])


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "A"), (5, "a"), (6, "a b"), (7, "B a"), (8, "a B"), (9, "É x"), (10, "é x"), (11, "z " * 50000), (12, "z z")])
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q r"), (None, None)], SCHEMA + "")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in op4_minhash.report(docs).collect())
    assert got == [("7", "7", True), ("7", "7", True), ("None", "7", False), ("None", "None", True), ("None", "None", True)]
    assert op4_minhash.report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_documents(spark, k):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.collect()], k)


def test_keep(spark):
    r = random.Random(2)
    rows = [(i, t, "s", i) for i, t in enumerate([*copies(r, 6, 90, 1), *copies(r, 3, 50, 0), "alone one", None, None])]
    df = spark.createDataFrame(rows, SCHEMA + ", source string, cls int")
    kept = {d for d, (_, c) in brute.near([x[:2] for x in rows], 5).items() if c == d}
    got = op4_minhash.keep(df)
    assert got.columns == df.columns
    assert sorted(got.collect()) == sorted(x for x in map(tuple, df.collect()) if x[0] in kept)


def test_signatures_estimate():
    e = W.mix(np.arange(1000, dtype=np.uint64))
    sets = [e[:800], e[100:900], e[:3], e[:1]]
    doc = np.repeat(np.arange(4), [len(s) for s in sets])
    s = op4_minhash.signatures(np.concatenate(sets), doc, 4, 200)
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.09
    assert (s >> np.uint64(48)).max() < 200 and len(set((s[3] >> np.uint64(48)).tolist())) == 200


def test_components(spark):
    r = random.Random(1)
    links = [tuple(x.to_bytes(4, "big") for x in (r.randint(0, 300), r.randint(0, 300))) for _ in range(150)] + [((7).to_bytes(4, "big"), i.to_bytes(4, "big")) for i in range(400, 600)]
    forest = components.Forest()
    for a, b in links:
        forest.join(a, b)
    links = [x for x in links if x[0] != x[1]]
    df = spark.createDataFrame(links, "a binary, b binary").repartition(4)
    got = {bytes(x.node): bytes(x.root) for x in components.components(df)[0].collect()}
    assert got == {x: forest.root(x) for pair in links for x in pair}


def test_words_of_equal_polynomials(spark):
    """Words of two letters that collide in every polynomial hash modulo a power of two."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, one), (2, other), (3, f"{one} x y z"), (4, f"{other} x y z"), (5, f"x {one}"), (6, " ".join([one, other] * 600)), (7, " ".join([other, one] * 600))])


def test_cut_texts_and_changed_copies(spark):
    """Sets that differ by what they lack: beginnings of one text, some with changes of their own or shared ones."""
    r = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = base[r.randint(0, 12) : r.randint(75, 120)]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(("y1", "y2", f"x{r.randint(0, 99)}"))
        rows.append((i, " ".join(w)))
    assert 1 < len({c for _, c in brute.near(rows, 2).values()}) < 60
    for k in (1, 2, 5):
        check(spark, rows, k)


def test_no_centre(spark):
    """Changed copies of a text that isn't there, no two of which are linked, and some that are."""
    r = random.Random(4)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(50):
        w = base[:]
        for j in r.sample(range(100), r.randint(3, 8)):
            w[j] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_keep_leaves_one_row_of_each_component(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (7, "g h i j k l", 3), (7, "g h i j k l", 4), (8, "g h i j k l", 5), (None, None, 6), (9, "", 7), (None, "m n o p q r", 8), (3, "m n o p q r", 9)]
    got = op4_minhash.keep(spark.createDataFrame(rows, SCHEMA + ", n long").repartition(3)).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.text) for r in got} == {(None, "a b c d e f"), (7, "g h i j k l"), (None, None), (9, ""), (3, "m n o p q r")}


def test_pivots_do_not_meet_their_own_component_or_sets_of_another_size(spark):
    rows = [(1, "a", "x", 10, True), (1, "b", "x", 10, True), (1, "c", "y", 10, False), (1, "d", "z", 20, False), (1, "e", "v", 12, False)]
    stars = spark.createDataFrame(rows, "bucket long, cls string, comp string, n long, also boolean")
    assert {(r.cls, r.q) for r in op4_minhash.met(stars, 80).collect()} == {("c", "a"), ("c", "b"), ("e", "a"), ("e", "b")}
