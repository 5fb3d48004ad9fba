import random

import pytest

from quarry.llm import op6_pii
from tests.llm import brute

TEXTS = [
    None,
    "",
    "a@b.c x@a.b_c@d.e, ..@-.- and @b.c a@b a@b. a.b@c-d.ef.gh.",
    "1.2.3.4.5.6.7.8 300.1.2.3.4 001.0002.255.00255 1.2.3 256.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 5 67 4111  1111",
    "+49 (30) 1234-5678. +1 + +12345678 +1234567890123456 é+33.1.23.45.67.89)x",
    "é€😀 IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 or GB82WEST12345698765431",
    "social security 123-45-6789, part 123-45-6789 no",
    "aaaa" * 20000 + "@",
    "1" * 50000,
    "a@b.cd 10.0.0.1 " * 3000,
]


def base(row):
    return {k: row[k] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")}


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in op6_pii.report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert base(got[i]) == brute.pii(t), t[:200]
    return got


def test_cases(spark):
    got = check(spark, TEXTS)
    assert got[6]["spans"] == "iban:9:36,iban:41:63"
    assert got[7]["spans"] == "ssn:16:27"


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    bits = ["a", "@", ".", "-", "_", " ", "+", "1", "12", "255", "4111111111111111", "(", "\n", "é", "b.c", "1.2"]
    check(spark, ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)])


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [r.text for r in df.orderBy("doc_id").collect()])


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail me.x@y.org or +49 30 1234567", "en", "s", 33, 5), (2, None, None, None, None, None), (3, "card 4111 1111 1111 1111, no 4111 1111 1111 1112", "en", "s", 1, 5)], "doc_id long, text string, lang string, source string, n_chars long, kind int")
    got = {r.doc_id: r for r in op6_pii.redact(df).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]" and got[1].n_chars == 23
    assert got[2].text is None and got[2].n_chars is None
    assert got[3].text == "card [CARD], no 4111 1111 1111 1112"
    assert op6_pii.redact(df).columns == df.columns


def test_redact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail me.x@y.org", "a", "b", "c")], "doc_id long, text string, m_email string, g_email string, row string")
    assert [tuple(r) for r in op6_pii.redact(df).collect()] == [(1, "mail [EMAIL]", "a", "b", "c")]
    assert op6_pii.report(df).first().n_email == 1


def test_context_decides(spark):
    iban, texts = "DE89370400440532013000", {}
    for i, before in enumerate(("", "account ", "order no. ", "order to account ")):
        texts[i] = f"see {before}{iban} now"
    texts[4], texts[5] = "123-45-6789", "social security number 123-45-6789"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in op6_pii.report(df).collect()}
    assert [bool(got[i][0]) for i in range(6)] == [True, True, False, True, False, True]
    assert got[0][1] == "0.8" and got[1][1] == "1.2" and got[5] == ("ssn:23:34", "0.8")


def test_very_many_matches(spark):
    text = "x@y.zz " * 300_000
    row = op6_pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_email == 300_000 and row.spans.endswith("email:2099993:2099999")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op6_pii.report(df).count() == 0 and op6_pii.redact(df).count() == 0
