import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import op9_suffix_tree as pst
from tests.llm import brute

SCHEMA = "doc_id long, text string"


class Plain:
    """The model by its definition: counts in dictionaries, one token after the other."""

    def __init__(self, texts):
        self.count, self.next = Counter(), defaultdict(Counter)
        for t in texts:
            words = [*brute.words(brute.lowered(t)), "\n"]
            for i, w in enumerate(words):
                self.count[w] += 1
                for n in (1, 2):
                    if i >= n:
                        self.next[tuple(words[i - n : i])][w] += 1
        self.total, self.distinct = sum(self.count.values()), len(self.count)
        self.kept = {s for s, c in self.next.items() if sum(c.values()) >= 2 and self.gain(s) > 0.5 * math.log(max(self.total, 2)) * len(c)}

    def root(self, w):
        return (self.count[w] + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def gain(self, s):
        c = self.next[s]
        n = sum(c.values())
        shorter = self.next[s[1:]] if len(s) > 1 else None
        suffix = lambda w: shorter[w] / sum(shorter.values()) if shorter else self.root(w)
        return sum(k * math.log(k / n / suffix(w)) for w, k in c.items())

    def p(self, w, s):
        if not s:
            return self.root(w)
        below = self.p(w, s[1:])
        if s not in self.kept:
            return below
        c = self.next[s]
        n = sum(c.values())
        return max(c[w] - 0.75, 0) / n + 0.75 * len(c) / n * below

    def score(self, text):
        words = [*brute.words(brute.lowered(text)), "\n"]
        return sum(math.log10(self.p(w, tuple(words[max(0, i - 2) : i]))) for i, w in enumerate(words))


def check(spark, rows, files=3):
    base = brute.base_scores(rows)
    model = Plain([t for d, t in rows if not base[d][0]])
    got = {x.doc_id: x for x in pst.score(spark.createDataFrame(rows, SCHEMA).repartition(files)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        x, (held, n, known, total, score) = got[d], base[d]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert math.isclose(x.base_score, score, rel_tol=1e-9)
        assert math.isclose(x.score, model.score(t), rel_tol=1e-9), d
    return model


def test_against_the_definition(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["of the", "in a", "x y z", "Q", "w%d" % r.randint(0, 80)]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(2000 + i, "k q r m q s " * 4) for i in range(9)]
    rows += [(1000, None), (1001, ""), (1002, "never seen of the"), (1003, " \n")]
    model = check(spark, rows)
    assert {len(s) for s in model.kept} == {1, 2} and len(model.kept) < len(model.next)


def test_documents_in_small_blocks(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))  # two words that collide in every polynomial hash modulo a power of two
    other = one.translate(str.maketrans("ab", "ba"))
    rows += [(10**6, f"{one} {one} x"), (10**6 + 1, f"{other} {one}"), (10**6 + 2, other)]
    monkeypatch.setattr(pst, "PER_RANGE", 1 << 16)
    check(spark, rows, 7)


def test_laws_sum_to_one():
    r = random.Random(6)
    model = Plain([" ".join(r.choice(["a b", "b c", "c", "a b c a"]) for _ in range(30)) for _ in range(80)])
    for s in ((), ("a",), ("a", "b"), ("c", "a"), ("zzz",)):
        assert math.isclose(sum(model.p(w, s) for w in [*model.count, "unknown"]), 1, rel_tol=1e-9)
    assert model.kept


def test_numbers_are_packed_without_loss():
    r = np.random.default_rng(1)
    for x in (np.empty(0, np.uint64), r.integers(0, 2**64 - 1, 1000, np.uint64), np.arange(5, dtype=np.uint64), np.array([-3, 7]).view(np.uint64)):
        assert (pst.unpacked(pst.packed(x)) == x).all()


def test_context_helps_held_out_text(spark):
    rows = pst.query(spark, "/root/testdata/sf0.01").collect()
    assert sum(x.score for x in rows if x.held_out) > sum(x.base_score for x in rows if x.held_out)


def test_a_text_that_occurs_twice_scores_apart(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulmnprst") for _ in range(r.randint(2, 6)))
    common = [word() for _ in range(60)]
    text = lambda: " ".join(r.choice(common) if r.random() < 0.5 else word() for _ in range(120))
    train = [i for i in range(1000) if not brute.base_scores([(i, "")])[i][0]]
    rows = [(i, text()) for i in train[:400]]
    rows += [(train[400 + i], rows[i][1]) for i in range(40)]
    got = {x.doc_id: (x.score - x.base_score) / x.n_tokens for x in pst.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    twice, once = [got[i] for i in train[400:440]], [got[i] for i in train[40:400]]
    assert min(twice) > max(once)


def test_odd_tables(spark):
    assert pst.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if brute.base_scores([(i, "")])[i][0])
    x = pst.score(spark.createDataFrame([(held, "a b"), (held, None)], SCHEMA)).collect()
    assert len(x) == 2 and all(r.n_known == 0 and r.train_tokens == 0 for r in x)
    docs = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (1, None, 3)], SCHEMA + ", block long")
    assert sorted(r.n_known for r in pst.score(docs).collect()) == [1, 3, 3]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    assert pst.query(spark, f"/root/testdata/sf{sf}").columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
