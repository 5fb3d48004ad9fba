import random

import numpy as np
import pyarrow as pa

from quarry.llm import op5_decontaminate as op
from quarry.llm import words as W

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(docs, items):
    """Documents with a region that an item's words pass for, every region tried."""
    out = set()
    for i, t in items:
        a, answer = op.lowered(t or ""), op.lowered(op.answer_of(t or ""))
        if not a:
            continue
        masks = set(a)
        for d, text in docs:
            w = op.lowered(text or "")
            for low in range(0, max(1, len(w) - len(a) + 1), 4):
                region = w[max(0, low - len(a)) : low + 2 * len(a)]
                if sum(x in masks for x in region) < 0.6 * len(a):
                    continue
                shared, found = op.confirm(a, answer, region)
                if shared >= op.SUBSEQUENCE and found >= op.ANSWER:
                    out.add((d, i))
                    break
    return out


def found(spark, docs, items):
    rows = op.leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id) for r in rows}


def test_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 90))] for _ in range(2))
        assert op.common_subsequence(a, b) == subsequence(a, b)


def test_documents_and_paraphrases(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    r = random.Random(3)
    other = [w for _, t in docs[:50] for w in t.split()]
    planted = set()
    for n, (i, t) in enumerate(items):
        w = t.split()
        changed = [r.choice(other) if r.random() < 0.15 else x for x in w if r.random() > 0.1]
        body = [r.choice(other) for _ in range(r.randint(0, 300))]
        at = r.randint(0, len(body))
        docs.append((10**6 + n, " ".join([*body[:at], *changed, *body[at:]])))
        planted.add((10**6 + n, i))
    got, all_ = found(spark, docs, items), brute(docs, items)
    assert len(got & all_) >= 0.95 * len(all_)
    assert len(got & planted & all_) >= 0.9 * len(planted & all_) and len(planted & all_) > 30
    exact = {(d, i) for d, t in docs for i, x in items if " ".join(x.split()) in " ".join(t.split())}
    assert exact <= got and len(exact) > 20
    clean = {d for d, _ in got} - {d for d, _ in all_}
    assert not clean


def test_odd_rows(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Answer: lambda mu"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (5, "x " * 90000), (6, "alpha beta"), (7, item.replace("lambda mu", "no"))]
    assert found(spark, docs, [(1, item), (2, item), (3, None), (4, ""), (None, item)]) == {(d, i) for d in (3, None) for i in (1, 2, None)}
    assert found(spark, docs, []) == set() and found(spark, [], [(1, item)]) == set()
    df = spark.createDataFrame([(1, item, 2), (2, "clean", 3), (3, None, 4)], DOCS + ", item_id int")
    assert [r.doc_id for r in op.keep(df, spark.createDataFrame([(1, item)], ITEMS)).orderBy("doc_id").collect()] == [2, 3]


def test_latent_space_is_that_of_the_full_decomposition(spark):
    r = np.random.default_rng(2)
    items = op.items_of([(i, " ".join(f"w{x}" for x in r.integers(0, 40, 20))) for i in range(30)])
    idf = np.ones(len(items.terms))
    passages = spark.createDataFrame([], "terms array<int>")
    v = op.latent(passages, items, idf)
    a = np.zeros((30, len(items.terms)))
    np.add.at(a, (items.item, items.of), 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(a @ v @ v.T, a, atol=1e-6)
    assert len(W.of_column(pa.array(["a"])).starts) == 1


def test_recall_does_not_depend_on_the_number_of_items(spark):
    r = random.Random(11)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if x.text and len(x.text.split()) > 80]
    items = []
    for i in range(2000):
        w = r.choice(texts).split()
        n = r.randint(16, 59)
        at = r.randint(0, len(w) - n)
        items.append((i, " ".join(w[at : at + n])))
    other = [w for t in texts for w in t.split()]
    docs, planted = [], set()
    for i, t in r.sample(items, 300):
        body = [r.choice(other) for _ in range(r.randint(0, 400))]
        at = r.randint(0, len(body))
        docs.append((i, " ".join([*body[:at], t, *body[at:]])))
        planted.add((i, i))
    got = found(spark, docs, items)
    assert planted <= got, len(planted & got)
    some = r.sample(items, 150)
    all_ = brute(docs[:80], some)
    assert {x for x in all_ if x[0] in {d for d, _ in docs[:80]}} <= got


def test_items_longer_than_any_window(spark):
    r = random.Random(13)
    w = [f"w{i}" for i in range(4000)]
    changed = [x for x in w if r.random() > 0.1]
    docs = [(1, " ".join(["other"] * 700 + w + ["words"] * 90)), (2, " ".join(changed)), (3, " ".join(w[:1500])), (4, "w1 w2 w3")]
    assert found(spark, docs, [(7, " ".join(w))]) == {(1, 7), (2, 7)}


def test_same_cosines_under_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    one, seven = (sorted(map(tuple, op.leaks(docs.repartition(n), items).collect())) for n in (1, 7))
    assert one == seven and len(one) > 5


def test_the_latent_space_is_fitted_on_every_document(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('alpha ', id, ' beta') AS text")
    fit, seen = op.latent, []
    monkeypatch.setattr(op, "latent", lambda passages, *rest: seen.append(passages.count()) or fit(passages, *rest))
    op.keep(docs, spark.createDataFrame([(1, "alpha beta gamma. answer: delta")], ITEMS)).count()
    assert seen == [5000]


def test_products_read_the_passages_once_and_give_the_same_space(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = op.items_of([(i, " ".join(r.text.split()[:40])) for i, r in enumerate(docs.filter("length(text) > 200").orderBy("doc_id").limit(12).collect())])
    passages, idf = op.passages_of(docs, items.terms), np.linspace(1, 2, len(items.terms))
    reads, gram = [], op.co_occurrences
    monkeypatch.setattr(op, "co_occurrences", lambda *a: reads.append(1) or gram(*a))
    monkeypatch.setattr(op, "NEAR", 1000)  # most pairs take the way of rare ones
    pairs = op.latent(passages, items, idf)
    assert reads == [1]
    monkeypatch.setattr(op, "CELLS", 0)
    assert np.allclose(abs(pairs.T @ op.latent(passages, items, idf)), np.eye(pairs.shape[1]), atol=1e-6) and reads == [1]
