import base64
import hashlib
import random

import pytest
import tiktoken

from quarry.llm import op2_bpe as op

SCHEMA = "doc_id long, text string"
BITS = [" ", "  ", "\n", "'s", "'re", "'r", "'", "é", "a", "1", "!", "　", "\xa0", "ab ", "x y", "\t", "\x1c", "ſ", "😀", "_", "\r\n"]


@pytest.fixture(scope="module")
def ranks():
    with open(op.default_ranks(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("library", pat_str=op.default_pattern(), mergeable_ranks=table, special_tokens={}).encode_ordinary


@pytest.mark.parametrize(("leaf", "short"), [(1, 1), (3, 2), (64, 16)])
def test_joins_give_what_the_library_gives(ranks, library, leaf, short):
    codec, r = op.Codec(ranks, op.default_pattern(), leaf=leaf, window=2, short=short), random.Random(leaf)
    for _ in range(300):
        text = "".join(r.choice(BITS) for _ in range(r.randint(0, 150)))
        ids = codec.encode(text)
        assert ids == library(text)
        assert codec.decode(ids).decode() == text


@pytest.mark.parametrize("short", [1, 4])
def test_trees_of_one_match(ranks, library, short):
    """Long runs of letters, in which nothing but the merges decides where tokens end."""
    codec, r = op.Codec(ranks, op.default_pattern(), short=short), random.Random(short)
    words = [w.decode() for w in list(codec.ranks)[300:9000] if w.isalpha()]
    for _ in range(400):
        text = "".join(r.choice((r.choice(words), r.choice("abeinrstz"), "aa")) for _ in range(r.randint(1, 60)))
        assert codec.match(text.encode()) == library(text)


def test_characters_are_classed_as_in_the_library(ranks, library):
    """Every character that both know, between letters, digits, marks and white space."""
    codec = op.Codec(ranks, op.default_pattern())
    for low in range(0x20, 0x30000, 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}!\n{chr(c)}  " for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text) == library(text), hex(low)


def test_long_texts(ranks, library):
    codec = op.Codec(ranks, op.default_pattern())
    for text in ("a" * 60000 + " " * 5000 + "!" * 999, "word " * 40000, "\n" * 40000, "é" * 40000):
        assert codec.encode(text) == library(text)


def test_documents(spark, ranks, library):
    codec = op.Codec(ranks, op.default_pattern())
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert codec.encode(row.text or "") == library(row.text or "")


def test_query(spark, ranks, library):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (3, "<|endoftext|> a"), (None, "é 😀")]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", n_tokens int")
    want = sorted((d or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows for ids in [library(t or "")])
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in op.round_trip(df).collect()) == want
    assert op.round_trip(df.limit(0)).count() == 0
    back = op.decode(op.encode(df)).collect()
    assert sorted((r.doc_id or 0, bytes(r.text).decode()) for r in back) == sorted((d or 0, t or "") for d, t in rows)
