import hashlib
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quarry.llm import op1_quality, op2_bpe, op5_decontaminate, op6_pii
from tests.llm import brute, test_op5

SMALL = "/root/testdata/sf0.001"


def redacted(text):
    """Kind after kind with Python's own expressions."""
    def swap(pattern, ok, mark):
        return lambda t: re.sub(pattern, lambda m: mark if ok(m[0]) else m[0], t)

    for step in (
        swap(brute.EMAIL, lambda m: True, "[EMAIL]"),
        swap(brute.IP, lambda m: all(int(p) <= 255 for p in m.split(".")), "[IP]"),
        swap(brute.CARD, lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and brute.luhn(d), "[CARD]"),
        swap(brute.PHONE, lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15, "[PHONE]"),
    ):
        text = step(text)
    return text


def test_pipeline_against_plain_steps(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    t = op1_quality.Texts.of(pa.array([x for _, x in docs]))
    passed = ~np.logical_or.reduce([r.rejects(t) for r in op1_quality.RULES])
    docs = [d for d, ok in zip(docs, passed, strict=True) if ok]
    near = brute.near(docs, 5)
    docs = [(d, x) for d, x in docs if near[d][1] == d]
    bad = {d for d, _ in test_op5.brute(docs, items)}
    docs = [(d, redacted(x)) for d, x in docs if d not in bad]
    codec = op2_bpe.Codec(open(op2_bpe.default_ranks(), "rb").read(), op2_bpe.default_pattern())
    want = {(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), brute.sha(x)) for d, x in docs for ids in [codec.small(x)]}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == want and len(want) > 50


def test_stages_keep_columns_and_bear_odd_rows(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "word " * 30, "en", "s", 150), (None, None, None, None, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            assert name == "tokens" or out.schema.names == schema.names
            assert out.count() <= df.count()


def test_stages_pass_columns_of_any_name(spark):
    """Columns named as the operators name their own come out as they went in."""
    names = ("stays", "__th", "__row", "m_doc", "m_th", "row", "key", "all", "mark", "keep", "doc", "th", "cls")
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    for n in names:
        schema = schema.add(n, "string")
    more = tuple(f"v {n}" for n in names)
    text = "some words of a text that is long enough to pass all rules of quality and has no marks of any kind within it at all"
    rows = [(1, text, "en", "s", len(text), *more), (2, text, "en", "s", len(text), *more), (3, f"{text} and more of it", "en", "s", len(text) + 15, *more)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(rows, schema), SMALL)
        got = out.collect()
        assert out.columns == schema.names and got, name
        assert all(tuple(r)[5:] == more for r in got), name


def test_kinds_of_the_plain_steps_are_all_that_fire(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert op6_pii.report(df).filter("spans rlike 'iban|ssn'").count() == 0
    assert op5_decontaminate.COSINE < 1
