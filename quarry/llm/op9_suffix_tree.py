"""Language-model scores by a probabilistic suffix tree over words.

Contexts have up to ``DEPTH`` words. A context s that occurs ``LEAST`` times or more is
retained if its next-word distribution diverges from that of its longest suffix by more
than its parameters cost: the sum over its occurrences of ``ln P(w|s) / P(w|suffix(s))``,
in relative frequencies, against half a log of the corpus for each distinct next word
(for a suffix without words, the root law below). A retained s gives
``P(w|s) = max(c(sw) - D, 0) / c(s) + D T(s) / c(s) P(w|suffix(s))``, T(s) being its
distinct next words, so it sums to 1; other contexts are their suffix. The root is the
add-half unigram law over all words of the corpus and one unknown word. A word is scored
by its longest state.

The tree is never held anywhere: no count and no context is left out for the corpus's
size, and what is gathered grows with it. Texts go into blocks. A block asks for what it
needs by sorted hashes (its share of the counts with them), one packed row for each
range of hashes; the task of a range adds up what all blocks sent and answers each row
in its order. Three such rounds give each block all it needs:

1. counts of its words and pairs of words,
2. which of its words are retained contexts, with T, and the counts of its triples whose
   context occurs ``LEAST`` times,
3. which of its pairs are retained contexts, with T.

Sums over a context's occurrences are sums over blocks: T is that of 1 / c(sw). A block
sends a word once however often it has it, so a hot word costs a row no more than others.

Defined results: a null or empty text is the end token alone; a null doc_id counts as
the empty string (it trains); repeated rows train and score each for itself; without
training rows every score is that of unknown words; a very long text is a block of its
own; an empty table gives an empty result; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.llm import words as W

DEPTH, LEAST, DISCOUNT = 2, 2, 0.75
#: Text of a block, and text whose hashes one task of a range adds up.
BLOCK, PER_RANGE, LEAST_RANGES = 4 << 20, 8 << 20, 8
END = np.uint64(0x2545F4914F6CDD1D)
#: What a unit of a gain and of a share of T is, so that sums don't depend on their order.
GAIN, SHARE = 1 << 16, 1 << 32
BLOCKS = "ids array<long>, held array<boolean>, lengths array<long>, body binary, bytes long, tokens long"
ASKED = "block long, part int, keys binary, values binary"
ANSWER = "block long, part int, distinct long, answer binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers by planes of their bytes, so that small ones and small steps take few."""
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True) if len(x) else b""


def unpacked(x: bytes | None) -> np.ndarray:
    if not x:
        return np.empty(0, np.uint64)
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """The texts in blocks, with ids, whether they are held out, and how many tokens of the block train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", BLOCK):
            data, offsets = W.buffers(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False)
            n = W.split(data, offsets).counts + 1
            rows = [pa.array([batch.column(c).to_pylist()], t) for c, t in (("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())))]
            body = len(data).to_bytes(8, "little") + (pa.compress(data.tobytes(), "zstd", asbytes=True) if len(data) else b"")
            yield pa.RecordBatch.from_arrays([*rows, pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([body], pa.binary()), pa.array([len(data)]), pa.array([int(n[~held].sum())])], ["ids", "held", "lengths", "body", "bytes", "tokens"])

    rows = docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, BLOCKS)
    return rows.select(F.monotonically_increasing_id().alias("block"), "*")


@dataclass
class Tokens:
    """The tokens of a block. ``word`` are hashes, ``place`` is a token's place in its document, ``train`` whether it counts."""

    ids: list[int | None]
    held: np.ndarray
    bounds: np.ndarray
    word: np.ndarray
    place: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Tokens:
        size = int.from_bytes(row["body"][:8], "little")
        data = np.frombuffer(pa.decompress(row["body"][8:], size, "zstd"), np.uint8) if size else np.empty(0, np.uint8)
        words = W.split(data, np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64), lower=True)
        bounds = words.bounds + np.arange(len(words.bounds))
        word = np.empty(bounds[-1], np.uint64)
        end = np.zeros(len(word), bool)
        end[bounds[1:] - 1] = True
        word[end], word[~end] = END, words.hashes()
        held = np.array(row["held"], bool)
        sizes = np.diff(bounds)
        return cls(row["ids"], held, bounds, word, np.arange(len(word)) - np.repeat(bounds[:-1], sizes), ~np.repeat(held, sizes))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a gram of n words ends, and a hash of each; the two lowest bits say n."""
        at = np.flatnonzero(self.place >= n - 1)
        x = self.word[at - n + 1] if n > 1 else self.word[at]
        with np.errstate(over="ignore"):
            for j in range(n - 2, -1, -1):
                x = W.mix(x) * W.WINDOW_STEP + self.word[at - j]
        return at, W.mix(x) & ~np.uint64(3) | np.uint64(n)


class Asking:
    """Sorted hashes that a block asks about, and at each place of ``at`` which of them is meant."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([np.empty(0, np.uint64), *(k for _, k in parts)])
        self.keys, inverse = np.unique(keys, return_inverse=True)
        cuts = np.cumsum([0, *(len(k) for _, k in parts)])
        self.parts = [(at, inverse[a:b]) for (at, _), a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)]

    def spread(self, part: int, answer: np.ndarray, n: int) -> np.ndarray:
        """The answers at the places of one part, zeros elsewhere."""
        out = np.zeros(n, np.int64)
        at, which = self.parts[part]
        out[at] = answer[which]
        return out

    def total(self, part: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums by key of whole numbers at some of a part's places."""
        out = np.zeros(len(self.keys), np.int64)
        np.add.at(out, self.parts[part][1][rows], values)
        return out

    def rows(self, block: int, ranges: int, values: list[np.ndarray]) -> Iterator[tuple]:
        part = ((self.keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(int(cuts[p]), int(cuts[p + 1]))
            steps = np.diff(self.keys[own], prepend=np.uint64(0))
            yield block, p, packed(steps), b"".join(len(x).to_bytes(8, "little") + x for x in (packed(v[own].view(np.uint64)) for v in values))


def words_and_pairs(t: Tokens) -> Asking:
    return Asking([t.grams(1), t.grams(2)])


@dataclass
class Counted:
    """What rounds so far told of a block's tokens: counts of the word, of the pair and of the triple that ends there."""

    tokens: Tokens
    one: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, t: Tokens, answer: np.ndarray) -> Counted:
        asking = words_and_pairs(t)
        return cls(t, *(asking.spread(i, answer, len(t.word)) for i in (0, 1)))

    def contexts(self) -> Asking:
        """Words that are contexts, where the word after them stands; and triples whose context occurs often enough."""
        t = self.tokens
        _, k1 = t.grams(1)
        after = np.flatnonzero(t.place >= 1)
        after = after[self.one[after - 1] >= LEAST]
        at, k3 = t.grams(3)
        some = (self.two[at - 1] >= LEAST) & (self.two[at] >= 1)
        return Asking([(after, k1[after - 1]), (at[some], k3[some])])

    def pairs(self) -> Asking:
        """Pairs that are contexts, where the word after them stands."""
        at, k2 = self.tokens.grams(2)
        of = np.zeros(len(self.tokens.word), np.uint64)
        of[at] = k2
        after = np.flatnonzero(self.tokens.place >= 2)
        after = after[self.two[after - 1] >= LEAST]
        return Asking([(after, of[after - 1])])


def evidence(asking: Asking, part: int, train: np.ndarray, ratio: np.ndarray, next_count: np.ndarray) -> list[np.ndarray]:
    """By context its gain and its share of T, from the training tokens that follow it."""
    at = asking.parts[part][0]
    rows = np.flatnonzero(train[at])
    gain = np.rint(np.log(ratio[rows]) * GAIN).astype(np.int64)
    share = np.rint(SHARE / next_count[rows]).astype(np.int64)
    return [asking.total(part, rows, gain), asking.total(part, rows, share)]


def exchange(asked: DataFrame, values: int, answer: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Answers to each packed row, from sums over all rows of its range; with block -1 the distinct words that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, sums, part = [], [], [[] for _ in range(values)], None
        for batch in batches:
            for r in batch.to_pylist():
                k = np.cumsum(unpacked(r["keys"]), dtype=np.uint64)
                rows.append((r["block"], len(k)))
                keys.append(k)
                part, at = r["part"], 0
                for v in sums:
                    size = int.from_bytes(r["values"][at : at + 8], "little")
                    v.append(unpacked(r["values"][at + 8 : at + 8 + size]).view(np.int64))
                    at += 8 + size
        all_, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = []
        for v in sums:
            total = np.zeros(len(all_), np.int64)
            np.add.at(total, inverse, np.concatenate(v))
            totals.append(total)
        said = answer(all_, totals)[inverse]
        words = int(((all_ & np.uint64(3) == 1) & (totals[0] > 0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([part], pa.int32()), pa.array([words]), pa.array([b""], pa.binary())], ["block", "part", "distinct", "answer"])
        cuts = np.cumsum([0, *(n for _, n in rows)])
        for i, (block, _) in enumerate(rows):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), pa.array([0]), pa.array([packed(said[cuts[i] : cuts[i + 1]].view(np.uint64))], pa.binary())], ["block", "part", "distinct", "answer"])

    return asked.groupBy("part").applyInArrow(run, ANSWER)


def answered(first: DataFrame, answers: list[DataFrame], run: Callable[[dict, list[np.ndarray]], Iterator], schema: str) -> DataFrame:
    """``run`` over each block with its answers of each round, which come in the order of their ranges, streaming."""
    own, build, turns = ["block", "ids", "held", "lengths", "body"], _records(schema), len(answers)
    rows = first.select(*own, F.lit(-1).alias("turn"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("answer"))
    for i, said in enumerate(answers):
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in first.select(*own[1:]).schema.fields]
        rows = rows.unionByName(said.filter("block >= 0").select("block", *none, F.lit(i).alias("turn"), "part", "answer"))
    met = rows.repartition("block").sortWithinPartitions("block", "turn", "part")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            return [np.concatenate([np.empty(0, np.uint64), *p]).view(np.int64) for p in parts]

        head, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["turn"] < 0:
                    if head is not None:
                        yield from map(build, run(head, told(parts)))
                    head, parts = r, [[] for _ in range(turns)]
                else:
                    parts[r["turn"]].append(unpacked(r["answer"]))
        if head is not None:
            yield from map(build, run(head, told(parts)))

    return met.mapInArrow(go, schema)


def _records(schema: str) -> Callable[[list], pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.split(" ") for x in schema.split(", ")]

    def build(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return build


def _root(count: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return (count + 0.5) / (total + 0.5 * (distinct + 1))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    first, _ = scratch.keep(blocks(docs), "blocks")
    size, total = first.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ranges, cost = max(LEAST_RANGES, size // PER_RANGE), 0.5 * math.log(max(total, 2))

    def ask_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = Tokens.of(row)
                asking = words_and_pairs(t)
                count = sum((asking.total(p, rows, np.ones(len(rows), np.int64)) for p in (0, 1) for rows in [np.flatnonzero(t.train[asking.parts[p][0]])]), np.zeros(len(asking.keys), np.int64))
                for x in asking.rows(row["block"], ranges, [count]):
                    yield _records(ASKED)([x])

    counts, _ = scratch.keep(exchange(first.select("block", "ids", "held", "lengths", "body").mapInArrow(ask_counts, ASKED), 1, lambda keys, sums: sums[0]), "counts")
    scratch.release(spark)
    distinct = counts.filter("block < 0").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def ask_contexts(row: dict, answers: list[np.ndarray]) -> Iterator[list]:
        c = Counted.of(Tokens.of(row), answers[0])
        t, asking = c.tokens, c.contexts()
        at = asking.parts[0][0]
        gains = evidence(asking, 0, t.train, np.where(t.train[at], c.two[at] / c.one[at - 1] / _root(c.one[at], total, distinct), 1.0), np.maximum(c.two[at], 1))
        rows = np.flatnonzero(t.train[asking.parts[1][0]])
        triples = asking.total(1, rows, np.ones(len(rows), np.int64))
        for x in asking.rows(row["block"], ranges, [triples, *gains]):
            yield [x]

    def retained(gain: np.ndarray, share: np.ndarray) -> np.ndarray:
        t = np.rint(share / SHARE).astype(np.int64)
        return np.where((t > 0) & (gain / GAIN > cost * t), t, 0)

    told, _ = scratch.keep(exchange(answered(first, [counts], ask_contexts, ASKED), 3, lambda keys, sums: np.where(keys & np.uint64(3) == 3, sums[0], retained(sums[1], sums[2]))), "told")
    scratch.release(spark)

    def ask_pairs(row: dict, answers: list[np.ndarray]) -> Iterator[list]:
        c = Counted.of(Tokens.of(row), answers[0])
        t, asking = c.tokens, c.pairs()
        three = c.contexts().spread(1, answers[1], len(t.word))
        at = asking.parts[0][0]
        ratio = np.where(t.train[at], np.maximum(three[at], 1) / c.two[at - 1] / (np.maximum(c.two[at], 1) / c.one[at - 1]), 1.0)
        for x in asking.rows(row["block"], ranges, evidence(asking, 0, t.train, ratio, np.maximum(three[at], 1))):
            yield [x]

    last, _ = scratch.keep(exchange(answered(first, [counts, told], ask_pairs, ASKED), 2, lambda keys, sums: retained(*sums)), "last")
    scratch.release(spark)

    def law(row: dict, answers: list[np.ndarray]) -> Iterator[list]:
        c = Counted.of(Tokens.of(row), answers[0])
        t, contexts = c.tokens, c.contexts()
        one, three = contexts.spread(0, answers[1], len(t.word)), contexts.spread(1, answers[1], len(t.word))
        two = c.pairs().spread(0, answers[2], len(t.word))
        base = _root(c.one, total, distinct)
        p = base.copy()
        for next_words, of, own in ((one, np.roll(c.one, 1), c.two), (two, np.roll(c.two, 1), three)):
            some = next_words > 0
            p[some] = np.maximum(own[some] - DISCOUNT, 0) / of[some] + DISCOUNT * next_words[some] / of[some] * p[some]
        starts = t.bounds[:-1]
        if not len(starts):
            return
        sums = [np.add.reduceat(np.log10(x), starts) for x in (base, p)]
        known = np.add.reduceat((c.one > 0).astype(np.int64), starts)
        yield list(zip(t.ids, t.held.tolist(), np.diff(t.bounds).tolist(), known.tolist(), [total] * len(starts), sums[0].tolist(), sums[1].tolist(), strict=True))

    return answered(first, [counts, told, last], law, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
