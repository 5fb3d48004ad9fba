"""Quality rules as a short-circuit cascade.

Each rule is a cheap or dear test that can reject a document. ``plan`` runs every rule
over a bounded sample of documents, whole and where they lie. Rules share features
(words, their hashes, lines); the plan takes the seconds of each feature and of each rule
beyond its features, and which documents each rule rejects. It then chooses the rules
one after another: next is the one that rejects most of what is left per second that it
adds, as features that an earlier rule needs are there already. ``cascade`` gives each
rule only what the rules before it left. The verdict is the conjunction of all rules, so
it does not depend on the measured order.

The flagged rule counts fixed English words and, for other abuse, beginnings of words
that ``learned`` takes per language from a bounded sample of the labels table: those that
mark toxic documents which the words so far miss, and hardly any clean document of any
language. A language with fewer than ``LEAST_TOXIC`` labelled toxic documents in the
sample gives none.

Defined results: a null or empty text has no words and fails the base rule; null ids
stay null; equal rows get equal verdicts; a very long text is read whole, as a batch of
its own; an empty table gives an empty result, and rules in their given order; in
``keep`` all columns of the input pass through, else other columns are not read.
"""

from __future__ import annotations

import json
import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W

#: Words that mark abuse.
FLAGGED = ("trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting")
FLAGGED_BYTES = frozenset(w.encode() for w in FLAGGED)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
ALPHA_UPPER = np.zeros(256, bool)
ALPHA_UPPER[65:91] = True
ALPHA_LOWER = np.zeros(256, bool)
ALPHA_LOWER[97:123] = True
EDGE = b".,;:!?\"'()[]"


class Texts:
    """Some documents, with each feature computed once when a rule asks for it.

    ``spent`` takes the seconds of each feature less those of the features that it asks
    for, ``needs`` these features, with theirs.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._have: dict[str, np.ndarray] = {}
        self._words: dict[str, W.Words | np.ndarray] = {}
        self.spent: Counter = Counter()
        self.needs: dict[str, set[str]] = defaultdict(set)
        self._open: list[str] = []

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        return cls(*W.buffers(column))

    def take(self, rows: np.ndarray) -> Texts:
        """The documents at these places, with the features, words and hashes that are there already."""
        lengths = np.diff(self.offsets)
        if len(rows) == len(lengths):
            return self
        parts = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        out = Texts(np.concatenate(parts) if parts else self.data[:0], np.concatenate([[0], np.cumsum(lengths[rows])]))
        out._have = {k: v[rows] for k, v in self._have.items()}
        if "words" in self._words:
            w = self._words["words"]
            n = w.counts[rows]
            bounds = np.concatenate([[0], np.cumsum(n)])
            which = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - w.bounds[rows], n)
            shift = np.repeat(out.offsets[:-1] - self.offsets[rows], n)
            out._words["words"] = W.Words(out.data, out.offsets, w.starts[which] + shift, w.ends[which] + shift, bounds)
            if "hashes" in self._words:
                out._words["hashes"] = self._words["hashes"][which]
        return out

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def timed(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        """What ``make`` gives, its seconds added to ``name``."""
        self._open.append(name)
        before, began = self.spent.total(), time.perf_counter()
        out = make()
        self.spent[name] += time.perf_counter() - began - (self.spent.total() - before)
        self._open.pop()
        return out

    def _feature(self, table: dict, name: str, make: Callable):
        if name not in table:
            table[name] = self.timed(name, make)
        if self._open:
            self.needs[self._open[-1]] |= {name, *self.needs[name]}
        return table[name]

    def __getitem__(self, name: str) -> np.ndarray:
        return self._feature(self._have, name, getattr(self, f"_{name}"))

    @property
    def words(self) -> W.Words:
        return self._feature(self._words, "words", lambda: W.split(self.data, self.offsets))

    @property
    def hashes(self) -> np.ndarray:
        return self._feature(self._words, "hashes", lambda: self.words.hashes())

    def _per_doc(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[self.offsets])

    def _n_words(self) -> np.ndarray:
        return self.words.counts.astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        return self._per_doc(~W.WHITE[self.data] & ((self.data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self._per_doc(SYMBOLS[self.data])

    def _n_upper(self) -> np.ndarray:
        return self._per_doc(ALPHA_UPPER[self.data])

    def _n_lower(self) -> np.ndarray:
        return self._per_doc(ALPHA_LOWER[self.data])

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        whole, n, repeated = self.data.tobytes(), [], []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
            n.append(len(lines))
            repeated.append(len(lines) - len(set(lines)))
        return np.array(n, np.int64), np.array(repeated, np.int64)

    def _line_counts(self) -> np.ndarray:
        return np.stack(self._lines(), axis=1)

    def _n_lines(self) -> np.ndarray:
        return self["line_counts"][:, 0]

    def _n_dup_lines(self) -> np.ndarray:
        return self["line_counts"][:, 1]

    def _n_repeat_words(self, k: int = 8) -> np.ndarray:
        h = self.hashes
        first, doc = self.words.window_doc(k)
        out = np.zeros(len(self), np.int64)
        if not len(first):
            return out
        key = W.windows_hash(h, k)[first]
        order = np.lexsort((key, doc))
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = first[order[again]]
        if not len(hit):
            return out
        cover = np.zeros(len(h) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + k, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        return np.diff(inside[self.words.bounds]).astype(np.int64)

    def _top_share(self) -> np.ndarray:
        """Words that are the document's commonest word, in hundredths."""
        h, doc = self.hashes, self.words.doc
        out = np.zeros(len(self), np.int64)
        if len(h):
            order = np.lexsort((h, doc))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
            at = np.flatnonzero(new)
            np.maximum.at(out, doc[order[at]], np.diff(np.append(at, len(order))))
        return 100 * out // np.maximum(self["n_words"], 1)

    def _n_flagged(self) -> np.ndarray:
        return self.n_marked(())

    def n_marked(self, starts: tuple[bytes, ...]) -> np.ndarray:
        """Words that are flagged or begin with one of ``starts``."""
        lowered, marks = W.LOWER[self.data].tobytes(), (*FLAGGED_BYTES, *starts)
        out = np.zeros(len(self), np.int64)
        if any(m in lowered for m in marks):
            for d, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
                text = lowered[a:b]
                if any(m in text for m in marks):
                    out[d] = sum(w in FLAGGED_BYTES or w.startswith(starts) for w in (w.strip(EDGE) for w in text.split()))
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray] = field(compare=False)


def base_words(t: Texts) -> np.ndarray:
    return t["n_words"] < 20


def base_repeats(t: Texts) -> np.ndarray:
    return 100 * t["n_repeat_words"] > 30 * t["n_words"]


def symbols(t: Texts) -> np.ndarray:
    return 10 * t["n_symbols"] > 2 * t["n_words"]


def word_length(t: Texts) -> np.ndarray:
    return (t["word_chars"] < 3 * t["n_words"]) | (t["word_chars"] > 12 * t["n_words"])


def shouting(t: Texts) -> np.ndarray:
    return 100 * t["n_upper"] > 50 * (t["n_upper"] + t["n_lower"])


def dup_lines(t: Texts) -> np.ndarray:
    return 100 * t["n_dup_lines"] > 40 * t["n_lines"]


def one_word(t: Texts) -> np.ndarray:
    return t["top_share"] > 30


def marks(t: Texts, n: np.ndarray) -> np.ndarray:
    return (n >= 2) & (200 * n >= t["n_words"])


def flagged(t: Texts) -> np.ndarray:
    return marks(t, t["n_flagged"])


RULES = (
    Rule("base_words", base_words),
    Rule("base_repeats", base_repeats),
    Rule("symbols", symbols),
    Rule("word_length", word_length),
    Rule("shouting", shouting),
    Rule("dup_lines", dup_lines),
    Rule("one_word", one_word),
    Rule("flagged", flagged),
)
#: Labelled documents, toxic and clean each, that flagged beginnings are taken from at most; toxic ones a language needs.
LABELLED, LEAST_TOXIC = 3000, 10
#: Characters of a beginning; the share of clean documents it may mark; the share of missed toxic ones it must.
BEGIN, FALSE_SHARE, TRUE_SHARE = range(4, 9), 0.005, 0.1


def is_marked(n: int, words: int) -> bool:
    """As ``marks``, for one document."""
    return n >= 2 and 200 * n >= words


def marking(text: str) -> tuple[bool, list[str]]:
    """Whether the fixed words flag a text, and the beginnings that would; as many as a text can have."""
    words = [w.strip(EDGE) for w in W.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()]
    n: Counter = Counter()
    for w in words:
        one = w.decode("utf-8", "ignore")
        n.update(one[:k] for k in BEGIN if len(one) >= k)
    return is_marked(sum(x in FLAGGED_BYTES for x in words), len(words)), sorted(b for b, c in n.items() if is_marked(c, len(words)))


def beginnings(sample: list[tuple[str | None, bool, bool, list[str]]]) -> tuple[bytes, ...]:
    """Beginnings of words that mark toxic documents, from (language, toxic, *``marking``); greedily, the most documents first."""
    missed, clean, toxic_of = defaultdict(list), [], Counter()
    for lang, toxic, flagged_, hits in sample:
        if not toxic:
            clean.append(set(hits))
        else:
            toxic_of[lang] += 1
            if not flagged_:
                missed[lang].append(set(hits))
    out: list[bytes] = []
    for lang, by_doc in sorted(missed.items(), key=lambda x: str(x[0])):
        if toxic_of[lang] < LEAST_TOXIC:
            continue
        least = max(3, TRUE_SHARE * len(by_doc))
        some = {b for b, c in Counter(x for h in by_doc for x in h).items() if c >= least}
        false = Counter(x for h in clean for x in h & some)
        some = {b for b in some if false[b] <= FALSE_SHARE * len(clean)}
        while some:
            gain = Counter(x for h in by_doc for x in h & some)
            best = max(some, key=lambda b: (gain[b] - false[b], len(b), b))
            if gain[best] < least or gain[best] <= false[best]:
                break
            out.append(best.encode())
            by_doc = [h for h in by_doc if best not in h]
    return tuple(out)


def learned(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> tuple[Rule, ...]:
    """The rules with the flagged beginnings of a sample: at most ``rows`` toxic and clean labels each of the smallest
    id hashes. Ids go to the documents and of rows with one id one text is read, that of the least hash, so the driver
    gets only what marks them, of 2 * ``rows`` texts at most."""
    place = F.xxhash64("doc_id")
    ids = [labels.filter(F.col("toxic") == t).select("doc_id", F.lit(bool(t)).alias("is_toxic")).distinct().orderBy(place, "doc_id").limit(rows) for t in (1, 0)]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", lang.alias("lang"), "text").filter("text IS NOT NULL")
    met = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # 2 * rows ids
    chosen = met.groupBy("doc_id", "is_toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("one")).select("one.lang", "is_toxic", "one.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = [marking(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("is_toxic"), pa.array([x for x, _ in found], pa.bool_()), pa.array([x for _, x in found], pa.list_(pa.string()))], ["lang", "is_toxic", "flagged", "hits"])

    found = chosen.mapInArrow(run, "lang string, is_toxic boolean, flagged boolean, hits array<string>").collect()
    starts = beginnings(sorted(map(tuple, found), key=str))
    more = Rule("flagged", partial(flagged_or, starts))
    return tuple(more if r.name == "flagged" and starts else r for r in RULES)


def flagged_or(starts: tuple[bytes, ...], t: Texts) -> np.ndarray:
    return marks(t, t.n_marked(starts))


#: Documents that cost and selectivity are estimated on at most.
SAMPLE_ROWS = 400


def measured(t: Texts, rules: tuple[Rule, ...]) -> dict:
    """Seconds of features and of rules beyond them, the features that rules need, and the rows that they reject."""
    rejected = {r.name: t.timed(r.name, partial(r.rejects, t)).tolist() for r in rules}
    return {"spent": dict(t.spent), "needs": {r.name: sorted(t.needs[r.name]) for r in rules}, "rejected": rejected}


def ordered(parts: list[dict], rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules by rejections of what is left per second that a rule adds, from measurements."""
    spent: Counter = Counter()
    for p in parts:
        spent.update(p["spent"])
    needs = {r.name: set().union(*(p["needs"][r.name] for p in parts)) for r in rules}
    rejects = {r.name: np.concatenate([np.zeros(0, bool), *(np.array(p["rejected"][r.name], bool) for p in parts)]) for r in rules}
    alive, have, left, out = np.ones(len(rejects[rules[0].name]), bool), set(), {r.name: r for r in rules}, []
    while left:
        share = alive.mean() if len(alive) else 0.0

        def adds(name: str) -> float:
            return max(share * (spent[name] + sum(spent[f] for f in needs[name] - have)), 1e-9)  # noqa: B023

        best = max(left, key=lambda n: ((rejects[n] & alive).sum() / adds(n), -adds(n), n))  # noqa: B023
        out.append(left.pop(best))
        alive &= ~rejects[best]
        have |= needs[best]
    return tuple(out)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in the order of a sample of at most ``rows`` documents of the smallest id hashes.

    Ids are chosen first and texts measured where they lie, so no text moves.
    """
    place = F.xxhash64("doc_id")
    chosen = [r.place for r in docs.select(place.alias("place")).orderBy("place").limit(rows).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(measured(Texts.of(batch.column("text")), rules))])], ["m"])

    sample = docs.select("text", place.alias("place")).filter(F.col("place") <= max(chosen, default=0)).limit(rows).select("text")
    parts = [json.loads(r.m) for r in sample.mapInArrow(run, "m string").collect()]  # figures of ``rows`` documents
    return ordered(parts, rules) if parts else rules


def cascade(t: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which documents no rule rejects; each rule sees what those before it left."""
    alive, left = np.arange(len(t)), t
    for rule in rules:
        if not len(alive):
            break
        ok = ~rule.rejects(left)
        if not ok.all():
            alive, left = alive[ok], left.take(np.flatnonzero(ok))
    kept = np.zeros(len(t), bool)
    kept[alive] = True
    return kept


REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def report(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id with the base statistics, base_failed and the verdict of the whole cascade, per document."""
    rules = rules or plan(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            t = Texts.of(batch.column("text"))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")  # wanted of all; the cascade reuses them
            stats = [pa.array(t[n]) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *stats, pa.array(base_words(t) | base_repeats(t)), pa.array(cascade(t, rules))], ["doc_id", *names, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {REPORT}")


def keep(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The documents that pass every rule, with all their columns; each rule runs only on what is left."""
    rules, schema = rules or plan(docs), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            yield batch.filter(pa.array(cascade(Texts.of(batch.column("text")), rules)))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(docs, plan(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
