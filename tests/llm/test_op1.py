import numpy as np
import pyarrow as pa

from quarry.llm import op1_quality as op
from tests.llm import brute

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", " \n\t", "a b c", "x " * 40, "é€ wörd\n" * 30, "one two three four five six seven eight " * 3 + "nine", "###$$ a*b\n\na\na\nb", "A" * 90000, "\x1c\x85 \xa0word", "w " * 8 + "q " * 8]
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(spark, rows):
    got = {r.doc_id: r.asDict() for r in op.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert {n: got[d][n] for n in NAMES} == brute.quality(t), (d, (t or "")[:80])
        assert not (got[d]["base_failed"] and got[d]["kept"])


def test_cases(spark):
    check(spark, list(enumerate(TEXTS)))


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.collect()])


def test_order_does_not_change_verdicts():
    t = op.Texts.of(pa.array(TEXTS * 3))
    want = ~np.logical_or.reduce([r.rejects(t) for r in op.RULES])
    for rules in (op.RULES, op.RULES[::-1]):
        assert (op.cascade(op.Texts.of(pa.array(TEXTS * 3)), rules) == want).all()


def plainly_kept(text):
    """The rules one by one, by Python's own means."""
    import re

    text = text or ""
    w, lines = brute.words(text), [x for x in text.split("\n") if brute.words(x)]
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    flags = sum(x.lower().strip(".,;:!?\"'()[]") in op.FLAGGED for x in w)
    base = brute.quality(text)
    return not (
        base["base_failed"]
        or 10 * base["n_symbols"] > 2 * len(w)
        or not 3 * len(w) <= base["word_chars"] <= 12 * len(w)
        or 100 * upper > 50 * (upper + lower)
        or 100 * base["n_dup_lines"] > 40 * len(lines)
        or max(100 * w.count(x) // len(w) for x in set(w)) > 30
        or (flags >= 2 and 200 * flags >= len(w))
    )


def test_verdicts_against_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + list(enumerate(TEXTS, 10**6))
    got = {r.doc_id: r.kept for r in op.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {d: plainly_kept(t) for d, t in rows}
    assert got == want and 20 < sum(want.values()) < len(want)


def test_estimates_order_rules():
    good = "Some plain words that make a sentence, each of them not like the other and with no marks at all in here. "
    part = op.measured(op.Texts.of(pa.array([good, "short", "s", "t"] * 20)), op.RULES)
    assert sum(part["rejected"]["base_words"]) == 60 and not any(part["rejected"]["flagged"])
    assert {"words", "hashes", "n_repeat_words"} <= set(part["needs"]["base_repeats"]) and "hashes" not in part["needs"]["base_words"]
    assert op.ordered([part], op.RULES)[0].name in ("base_words", "symbols", "word_length")


def test_shared_features_are_paid_once():
    rule = lambda name: op.Rule(name, lambda t: None)
    part = {"spent": {"f": 8.0, "a": 1.0, "b": 1.0, "c": 4.0}, "needs": {"a": ["f"], "b": ["f"], "c": []}, "rejected": {"a": [1, 1, 1, 0, 0, 0], "b": [0, 0, 0, 1, 0, 0], "c": [0, 0, 0, 0, 1, 0]}}
    assert [r.name for r in op.ordered([part], (rule("a"), rule("b"), rule("c")))] == ["a", "b", "c"]  # b alone would cost 9
    part["rejected"]["c"] = [1, 1, 1, 0, 1, 0]
    assert [r.name for r in op.ordered([part], (rule("a"), rule("b"), rule("c")))] == ["c", "b", "a"]  # c leaves nothing to a


def test_taken_documents_keep_words():
    t = op.Texts.of(pa.array(TEXTS))
    t["n_repeat_words"]
    rows = np.array([3, 4, 6, 10])
    some, fresh = t.take(rows), op.Texts.of(pa.array([TEXTS[i] for i in rows]))
    assert some.spent.total() == 0 and (some.words.starts == fresh.words.starts).all() and (some.words.ends == fresh.words.ends).all() and (some.hashes == fresh.hashes).all()
    assert (some["top_share"] == fresh["top_share"]).all()


def test_words_of_equal_polynomials(spark):
    """Words of two letters that collide in every polynomial hash modulo a power of two."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    text = " ".join([one, *"cdefghi", "|", other, *"cdefghi"]) + " and twenty words or more so that it passes"
    check(spark, [(1, text)])


def test_labels(spark):
    at = "/root/testdata/sf0.1"
    got = op.report(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("NOT base_failed").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.kept.mean() > 0.995
    assert got[got.quality == 0].kept.mean() < 0.1
    english = spark.read.parquet(f"{at}/documents.parquet").filter("lang = 'en'").select("doc_id").toPandas().doc_id
    assert got[(got.toxic == 1) & got.doc_id.isin(english)].kept.mean() < 0.2  # the flagged words are English


def test_keep(spark):
    df = spark.createDataFrame([(1, TEXTS[6] + " and more words that differ from all of those before it here now", 5), (2, "short", 6), (3, None, 7)], SCHEMA + ", n_words int")
    assert op.keep(df).columns == df.columns
    assert op.keep(df.limit(0)).count() == 0 and op.report(df.limit(0)).count() == 0
    assert {r.doc_id for r in op.keep(df).collect()} <= {1}
    assert op.report(df.union(df)).count() == 6


def test_toxic_documents_in_other_languages(spark):
    """Beginnings learned on one half of the labels, held against the other."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rules = op.learned(docs, labels.filter("doc_id % 2 = 0"))
    got = op.report(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    t = op.Texts.of(pa.array(docs.join(labels, "doc_id").filter("doc_id % 2 = 1").orderBy("doc_id").toPandas().text))
    got = got.sort_values("doc_id").assign(flagged=next(r for r in rules if r.name == "flagged").rejects(t))
    for lang, part in got.groupby("lang"):
        toxic, clean = part[part.toxic == 1], part[part.toxic == 0]
        print(lang, len(toxic), toxic.flagged.sum(), toxic.kept.sum(), len(clean), clean.flagged.sum())
        assert toxic.flagged.mean() > 0.8 and clean.flagged.mean() < 0.02


def test_few_labels_teach_nothing():
    toxic, clean = ("fr", True, *op.marking("réeuxpa réeuxle")), ("fr", False, *op.marking("les eau"))
    assert op.beginnings([toxic] * 9 + [clean]) == ()
    assert op.beginnings([toxic] * 10 + [clean]) != ()
