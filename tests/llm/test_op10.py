import random

import pytest

from quarry.llm import op10_substring
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return op10_substring.without(docs, op10_substring.repeated(docs)[0], digest=True).collect()


def check(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, rows)}
    assert got == brute.substring(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(r.randint(10, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, 5)
            w += p[a:] if r.random() < 0.5 else [r.choice("ab") for _ in range(r.randint(0, 40))]
            w += ["é" + str(r.randint(0, 3))] * r.randint(0, 20)
        rows.append((d * 7 - 40, r.choice([" ", "\n", "  "]).join(w)))
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(30000))
    passage = " ".join(f"p{i}" for i in range(20))
    check(spark, [(1, None), (2, ""), (3, long), (4, long), (5, "a " * 12), (6, "a " * 13), (7, "a " * 40), (9, passage), (8, "x " + passage + " y")])
    again = run(spark, [(None, passage), (3, passage), (3, passage), (None, "q")])
    assert sorted((r.doc_id or 0, r.n_removed) for r in again) == [(0, 0), (0, 20), (3, 0), (3, 0)]
    assert run(spark, []) == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op10_substring.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute.substring(rows)


def test_text(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, passage, "s"), (2, f"a {passage}\nb", "s")], SCHEMA + ", row string")
    got = {r.doc_id: r.text for r in op10_substring.without(docs, op10_substring.repeated(docs)[0]).collect()}
    assert got == {1: passage, 2: "a b"}


def test_words_of_equal_polynomials(spark):
    """Words, and runs of words, of two kinds that collide in every polynomial hash modulo a power of two."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    kinds = lambda x: " ".join({"a": "left", "b": "right"}[c] for c in x)
    rows = [(1, f"{one} c d e f g h i j k l m n"), (2, f"{other} c d e f g h i j k l m n"), (3, kinds(one)), (4, kinds(other))]
    check(spark, rows)
