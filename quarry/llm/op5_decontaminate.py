"""Benchmark decontamination by latent semantic retrieval.

Words of the benchmark's items are the terms. One pass over all documents counts, in
units of ``UNIT`` words, how many units hold each term. The TF-IDF matrix of the items
and of all passages of all documents is factored by a
distributed randomised SVD: each partition gives its share of the product of the
matrix's Gram operator and a thin block, shares are summed by pieces, and the driver
only holds the thin block, terms by ``RANK`` + ``OVER``. Where pairs of terms are few
enough (``CELLS``) the Gram matrix itself is summed once, by pairs of terms that occur in
one passage, and products read it instead of all passages. Items become latent vectors.

Then every document is searched. An item can only pass if at least ``SUBSEQUENCE`` of
its words are in one region, so of its rarest words (all but about a third) that many
less the rest must be there: an inverted list of these gives, without loss, the pieces
of text where an item can be at all. There, units become sums of latent word vectors,
windows of the item's length are sums of units, and those whose latent cosine with the
item reaches ``COSINE`` are its candidates. Each is held against the item's words in the
text around: the longest common subsequence must hold ``SUBSEQUENCE`` of the item, and
the item's answer (what follows its last "answer:", else its last sentence) must be
there in ``ANSWER`` of its words. So copies, and paraphrases that keep most words in
order, are found. Both vectors of a cosine are latent ones, so an item of which
``RANK`` directions keep little, as there are many items, is found as well as others.

The benchmark is the query set. It goes out in blocks of about ``ITEMS`` items, each
with one pass over the documents.

Defined results: null or empty texts match nothing, on either side; repeated documents
give one row; equal items each give a row; an empty table gives an empty result; a very
long text is a batch of its own, searched piece by piece, and items of any length have
windows of theirs; in ``keep`` all columns of the input pass through, else other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.llm import words as W

#: Words of a unit, and units of a passage.
UNIT, PASSAGE = 8, 4
RANK, OVER, POWERS = 128, 16, 2
#: Items of a block (about), and passages that a task multiplies at a time.
ITEMS, ROWS = 4096, 256
#: Most pairs of terms that are summed, those of frequent terms that a task holds in one list (16 MiB), passages that it adds
#: at a time, and pairs of a stretch.
CELLS, NEAR, PAIRED, STRETCH = 1 << 24, 1 << 21, 2048, 1 << 20
COSINE, SUBSEQUENCE, ANSWER = 0.2, 0.6, 0.5
BLOCK, PIECE, DENSE = 1 << 18, 512, 1 << 22
LEAKS = "doc_id long, item_id long, cosine double, subsequence double, answer double"


@dataclass
class Items:
    """The items of a block that have words, and their terms. of: term of each word, items after one another; window:
    words of an item's windows, the power of two units next to its length."""

    ids: list[int | None]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    terms: np.ndarray
    of: np.ndarray
    item: np.ndarray
    window: np.ndarray


def answer_of(text: str) -> str:
    """What follows the last "answer:", else the last sentence."""
    low = text.lower().rfind("answer:")
    if low >= 0:
        return text[low + len("answer:") :]
    return re.split(r"(?<=[.!?])\s+", text.strip())[-1]


def lowered(text: str) -> list[bytes]:
    return W.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


def items_of(rows: list[tuple[int | None, str | None]]) -> Items:
    rows = [(i, t) for i, t in rows if t and lowered(t)]
    words = W.of_column(pa.array([t for _, t in rows], pa.string()), lower=True)
    terms, of = np.unique(words.hashes(), return_inverse=True)
    sizes = words.counts
    window = np.array([UNIT << max(0, round(math.log2(n / UNIT))) for n in sizes], np.int64)
    texts = [lowered(t) for _, t in rows]
    return Items([i for i, _ in rows], texts, [lowered(answer_of(t)) or w[-1:] for (_, t), w in zip(rows, texts, strict=True)], terms, of, words.doc, window)


def term_of(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of word hashes among the terms, or -1."""
    if not len(terms):
        return np.full(len(h), -1, np.int64)
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    return np.where(terms[at] == h, at, -1)


def units_of(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of all units, and for each document the bounds of its units."""
    n = -(-words.counts // UNIT)
    bounds = np.concatenate([[0], np.cumsum(n)])
    number = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    return np.repeat(words.bounds[:-1], n) + UNIT * number, bounds


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Units of all documents, and how many of them hold each term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # the terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, units = shared.value, 0
        seen = np.zeros(len(t), np.int64)
        for batch in W.slices(batches, "text", BLOCK):
            words = W.of_column(batch.column("text"), lower=True)
            start, _ = units_of(words)
            units += len(start)
            place = term_of(t, words.hashes())
            unit = np.searchsorted(start, np.arange(len(place)), "right") - 1
            some = place >= 0
            once = np.unique(unit[some] * max(len(t), 1) + place[some])
            seen += np.bincount(once % max(len(t), 1), minlength=len(t))[: len(t)]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], units))], ["term", "n"])

    out, units = np.zeros(len(terms), np.int64), 0
    for term, n in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # at most a row a term
        if term < 0:
            units = n
        else:
            out[term] = n
    return units, out


def passages_of(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The passages (term lists of ``PASSAGE`` units of one document) that hold a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", BLOCK):
            words = W.of_column(batch.column("text"), lower=True)
            place = term_of(shared.value, words.hashes())
            start, bounds = units_of(words)
            start = start[(np.arange(len(start)) - np.repeat(bounds[:-1], np.diff(bounds))) % PASSAGE == 0]
            unit = np.searchsorted(start, np.arange(len(place)), "right") - 1
            some = place >= 0
            counts = np.bincount(unit[some], minlength=len(start))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(place[some], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists], ["terms"]).filter(pa.array(counts > 0))

    return docs.select("text").mapInArrow(run, "terms array<int>")


def _weights(of: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the entries of n rows of unit length, in order."""
    size = len(idf)
    key, times = np.unique(row.astype(np.int64) * size + of, return_counts=True)
    row, of = key // size, key % size
    weight = times * idf[of]
    return row, of, weight / np.sqrt(np.maximum(np.bincount(row, weight**2, n), 1e-12))[row]


def _gram(of: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray, thin: np.ndarray, out: np.ndarray) -> None:
    """Add the transpose of A times A times ``thin`` to ``out``, for rows of unit length."""
    row, of, weight = _weights(of, row, n, idf)
    product = np.zeros((n, thin.shape[1]))
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    if len(row):
        product[row[cut]] = np.add.reduceat(weight[:, None] * thin[of], cut)
    order = np.argsort(of, kind="stable")
    if len(row):
        cut = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
        out[of[order][cut]] += np.add.reduceat(weight[order, None] * product[row[order]], cut)


def _ranks(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms from the most frequent on, and the place of each there. The pair of places i <= j is the cell j (j + 1) / 2 + i,
    so pairs of frequent terms come first."""
    order = np.argsort(idf, kind="stable")
    rank = np.empty(len(idf), np.int64)
    rank[order] = np.arange(len(idf))
    return order, rank


def _summed(cell: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells, each once and in order, with the sums of their values."""
    if not len(cell):
        return cell, value
    order = np.argsort(cell, kind="stable")
    cell, low, _ = _runs(cell[order])
    return cell, np.add.reduceat(value[order], low)


def _pairs(of: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of the transpose of A times A, for rows of unit length and terms by rank: added to ``near``, or given where it ends."""
    row, of, weight = _weights(of, row, n, idf)
    sizes = np.bincount(row, minlength=n)
    start = np.cumsum(sizes) - sizes
    for m in np.unique(sizes[sizes > 0]):
        at = start[sizes == m][:, None] + np.arange(m)
        term, value = of[at], weight[at]
        i, j = np.triu_indices(m)
        cell = (term * (term + 1) // 2)[:, j] + term[:, i]
        cell, value = cell.ravel(), (value[:, i] * value[:, j]).ravel()
        some = cell < len(near)
        np.add.at(near, cell[some], value[some])
        yield cell[~some], value[~some]


def co_occurrences(passages: DataFrame, idf: np.ndarray) -> DataFrame:
    """(at, cell, value): the passages' Gram matrix, as sums of weights of pairs of terms that occur together. ``at`` names a
    stretch of ``STRETCH`` cells. Pairs of frequent terms are added in place, others sorted and summed as they come."""
    shared = passages.sparkSession.sparkContext.broadcast(idf)  # a weight for each term of one block of items
    kind = "at long, cell array<int>, value array<double>"

    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, rank = _ranks(shared.value)
        idf, size = shared.value[order], len(order)
        near = np.zeros(min(size * (size + 1) // 2, NEAR))
        far, waiting = (np.empty(0, np.int64), np.empty(0)), []
        for batch in batches:
            part = batch.column(0)
            for a in range(0, len(part), PAIRED):
                some = part.slice(a, PAIRED)
                waiting += _pairs(rank[some.flatten().to_numpy()], np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy())), len(some), idf, near)
                if sum(len(c) for c, _ in waiting) > NEAR // 4:
                    far, waiting = _summed(*map(np.concatenate, zip(far, *waiting, strict=True))), []
        far = _summed(*map(np.concatenate, zip(far, *waiting, strict=True)))
        cell = np.flatnonzero(near)
        cell, value = np.concatenate([cell, far[0]]), np.concatenate([near[cell], far[1]])
        for at, low, high in zip(*_runs(cell // STRETCH), strict=True) if len(cell) else ():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), lists(cell[low:high] % STRETCH, pa.int32()), lists(value[low:high], pa.float64())], ["at", "cell", "value"])

    def together(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(STRETCH)
        for batch in pieces:
            for k in range(batch.num_rows):
                at = batch.column(0)[k].as_py()
                total[batch.column(1)[k].values.to_numpy()] += batch.column(2)[k].values.to_numpy()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), lists(cell, pa.int32()), lists(total[cell], pa.float64())], ["at", "cell", "value"])

    return passages.mapInArrow(run, kind).groupBy("at").applyInArrow(together, kind)


def latent(passages: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """Orthonormal directions (terms by rank) of the items and passages, by subspace iteration from a random block.

    Terms of which there are so few that a task can hold their pairs get the passages' Gram matrix once; else each product
    reads all passages.
    """
    spark, size = passages.sparkSession, len(items.terms)
    width = min(RANK + OVER, size)
    thin = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
    passages_n, paired = passages.count(), size * (size + 1) // 2 <= CELLS
    source, path = scratch.keep(co_occurrences(passages, idf), "pairs") if paired else (passages, None)

    def product(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((block, idf))  # terms of one block of items by rank

        def of_passages(batches: Iterator[pa.RecordBatch], block: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
            for batch in batches:
                lists = batch.column(0)
                for a in range(0, len(lists), ROWS):
                    part = lists.slice(a, ROWS)
                    sizes = np.diff(part.offsets.to_numpy())
                    _gram(part.flatten().to_numpy(), np.repeat(np.arange(len(part)), sizes), len(part), idf, block, out)

        def of_pairs(batches: Iterator[pa.RecordBatch], block: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
            order, _ = _ranks(idf)
            place = np.arange(len(order))
            begin = place * (place + 1) // 2
            for batch in batches:
                for k in range(batch.num_rows):
                    cell = batch.column(0)[k].as_py() * STRETCH + batch.column(1)[k].values.to_numpy().astype(np.int64)
                    value = batch.column(2)[k].values.to_numpy()
                    for t, low, high in zip(*_runs(np.searchsorted(begin, cell, "right") - 1), strict=True) if len(cell) else ():
                        i, v = cell[low:high] - begin[t], value[low:high]
                        out[order[t]] += v @ block[order[i]]
                        other = i < t
                        out[order[i[other]]] += v[other, None] * block[order[t]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, idf = shared.value
            out = np.zeros_like(block)
            (of_pairs if paired else of_passages)(batches, block, idf, out)
            at = list(range(0, len(out), PIECE)) if out.any() else []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([out[i : i + PIECE].tobytes() for i in at], pa.binary())], ["at", "piece"])

        def together(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, 0.0
            for batch in pieces:
                for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    at, total = i, total + np.frombuffer(b)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "piece"])

        out = np.zeros_like(block)
        for r in source.mapInArrow(run, "at long, piece binary").groupBy("at").applyInArrow(together, "at long, piece binary").collect():  # terms by rank
            out[r["at"] : r["at"] + PIECE] = np.frombuffer(r.piece).reshape(-1, block.shape[1])
        own = np.zeros_like(block)
        _gram(items.of, items.item, len(items.ids), idf, block, own)
        rows = max(passages_n, 1)
        return out / rows + own / max(len(items.ids), 1)  # items weigh as much as all passages

    for _ in range(POWERS):
        thin = np.linalg.qr(product(thin))[0]
    small = thin.T @ product(thin)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:RANK]
    if path:
        scratch.drop(spark, path)
    return thin @ vectors[:, order]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[cut], cut, np.append(cut[1:], len(x))


@dataclass
class Postings:
    """Items of about one length. Any region of theirs has at most ``reach`` words; of the
    rare words of item ``items[j]`` at least ``least[j]`` are in a region that passes. Term t has the rows
    ``bounds[t]:bounds[t + 1]`` of ``own`` (places in ``items``) and ``times`` (its rare words in the item)."""

    items: np.ndarray
    reach: int
    least: np.ndarray
    bounds: np.ndarray
    own: np.ndarray
    times: np.ndarray


def needed(size: int) -> int:
    """The least count of an item's ``size`` words whose share reaches ``SUBSEQUENCE``."""
    return next(n for n in range(max(0, int(SUBSEQUENCE * size) - 1), size + 1) if n / size >= SUBSEQUENCE)


def postings(items: Items, seen: np.ndarray) -> list[Postings]:
    """The items by powers of two of their lengths. seen: units of the documents that hold each term."""
    out, first = [], np.searchsorted(items.item, np.arange(len(items.ids) + 1))
    sizes = np.diff(first)
    for power in np.unique(np.log2(sizes).astype(int)):
        own = np.flatnonzero(np.log2(sizes).astype(int) == power)
        least, term, place = [], [], []
        for j, i in enumerate(own):
            n = needed(int(sizes[i]))
            least.append(max(1, n // 2))
            of = items.of[first[i] : first[i + 1]]
            rare = of[np.lexsort((of, seen[of]))][: sizes[i] - n + least[-1]]  # of these at most sizes - n are missing
            term.append(rare)
            place.append(np.full(len(rare), j))
        key, times = np.unique(np.concatenate(term) * len(own) + np.concatenate(place), return_counts=True)
        reach = int((items.window[own] + 2 * sizes[own]).max())
        out.append(Postings(own, reach, np.array(least), np.searchsorted(key // len(own), np.arange(len(items.terms) + 1)), key % len(own), times))
    return out


@dataclass
class Index:
    """vectors: for each term its latent vector times idf; latent: the items' latent vectors, of unit length."""

    items: Items
    vectors: np.ndarray
    latent: np.ndarray
    postings: list[Postings]


def index(docs: DataFrame, items: Items) -> Index:
    units, seen = frequencies(docs, items.terms)
    idf = np.log((1 + units) / (1 + seen)) + 1
    passages, path = scratch.keep(passages_of(docs, items.terms), "passages")
    directions = latent(passages, items, idf)
    scratch.drop(docs.sparkSession, path)
    vectors = (idf[:, None] * directions).astype(np.float32)
    rows = np.zeros((len(items.ids), vectors.shape[1]), np.float32)
    np.add.at(rows, items.item, vectors[items.of])
    rows /= np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]
    return Index(items, vectors, rows, postings(items, seen))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with the bits of an integer as one row of the table."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & masks.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def confirm(item: list[bytes], answer: list[bytes], region: list[bytes]) -> tuple[float, float]:
    inside = set(region)
    return common_subsequence(item, region) / len(item), sum(w in inside for w in answer) / len(answer)


def candidates(words: W.Words, place: np.ndarray, p: Postings) -> Iterator[tuple[int, int, int]]:
    """(document, first word, place in ``p.items``) of pieces of ``2 * p.reach`` words with enough of an item's rare words.

    Pieces start every ``p.reach`` words, so each region lies in the piece in which it starts.
    """
    pieces = -(-words.counts // p.reach)
    bounds = np.concatenate([[0], np.cumsum(pieces)])
    has = np.diff(p.bounds)
    at = np.flatnonzero(place >= 0)
    at = at[has[place[at]] > 0]
    doc = np.searchsorted(words.bounds, at, "right") - 1
    number = (at - words.bounds[doc]) // p.reach
    piece, term = bounds[doc] + number, place[at]
    early = number > 0  # a word is in the second half of the piece before
    size = len(has)
    key = np.unique(np.concatenate([piece * size + term, (piece[early] - 1) * size + term[early]]))
    piece, term = key // size, key % size
    n, step = len(p.items), max(1, DENSE // len(p.items))
    cuts = np.concatenate([[0], np.cumsum(has[term])])
    a = 0
    while a < len(key):
        low = int(piece[a])
        b = int(np.searchsorted(piece, low + step))
        b = min(b, max(a + 1, int(np.searchsorted(cuts, cuts[a] + DENSE, "right")) - 1))
        if b < len(key):  # whole pieces, but for one piece with more rows than the bound
            whole = int(np.searchsorted(piece, piece[b]))
            b = whole if whole > a else int(np.searchsorted(piece, piece[a], "right"))
        width = has[term[a:b]]
        row = np.arange(width.sum()) - np.repeat(cuts[a:b] - cuts[a], width) + np.repeat(p.bounds[term[a:b]], width)
        count = np.bincount(np.repeat(piece[a:b] - low, width) * n + p.own[row], p.times[row], (int(piece[b - 1]) - low + 1) * n)
        for x in np.flatnonzero(count.reshape(-1, n) >= p.least):
            c = low + int(x) // n
            d = int(np.searchsorted(bounds, c, "right")) - 1
            yield d, (c - int(bounds[d])) * p.reach, int(x) % n
        a = b


def cosines(place: np.ndarray, start: np.ndarray, end: np.ndarray, vectors: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Latent cosines of an item with the windows ``place[start:end]`` of terms; starts are ``UNIT`` apart."""
    sums = np.zeros((len(place) + 1, vectors.shape[1]))
    np.cumsum(np.where((place >= 0)[:, None], vectors[place], 0.0), axis=0, out=sums[1:])
    window = sums[end] - sums[start]
    norm = np.linalg.norm(window, axis=1)
    return np.where(norm > 1e-6, window @ item / np.maximum(norm, 1e-6), 0.0)


def search(batch: pa.RecordBatch, ix: Index) -> list[tuple[int, int, float, float, float]]:
    """(row, item, cosine, subsequence, answer) of the items that the rows hold, each once with its best window."""
    words = W.of_column(batch.column("text"), lower=True)
    if not len(words.starts) or not len(ix.items.ids):
        return []
    place = term_of(ix.items.terms, words.hashes())
    best: dict[tuple[int, int], tuple] = {}
    texts: dict[int, list[bytes]] = {}
    raw = words.data.tobytes()

    def text_of(d: int) -> list[bytes]:
        if d not in texts:
            texts[d] = raw[words.offsets[d] : words.offsets[d + 1]].split()
        return texts[d]

    inside: tuple = (None, set())
    for p in ix.postings:
        for d, low, j in candidates(words, place, p):
            item, text = int(p.items[j]), text_of(d)
            about, answer, n = ix.items.words[item], ix.items.answers[item], int(ix.items.window[item])
            size, need = len(about), SUBSEQUENCE * len(about)
            piece = text[low : low + 2 * p.reach]
            if inside[0] != (d, low, p.reach):
                inside = (d, low, p.reach), set(piece)
            if sum(w in inside[1] for w in about) < need - 1e-6 or sum(w in inside[1] for w in answer) < ANSWER * len(answer):
                continue
            first = np.arange(0 if low == 0 else -(-(low + size) // UNIT) * UNIT, min(low + p.reach + size, len(text)), UNIT)
            if not len(first):
                continue
            start, end = words.bounds[d] + first, np.minimum(words.bounds[d] + first + n, words.bounds[d + 1])
            span = slice(int(start[0]), int(end[-1]))
            cosine = cosines(place[span], start - span.start, end - span.start, ix.vectors, ix.latent[item])
            some = np.flatnonzero(cosine >= COSINE)
            if not len(some) or (most := common_subsequence(about, piece)) < need - 1e-6:
                continue
            top = most / size, sum(w in inside[1] for w in answer) / len(answer)
            for u in some[np.argsort(-cosine[some], kind="stable")]:
                at = int(first[u])
                shared, answered = confirm(about, answer, text[max(0, at - size) : at + n + size])
                if shared >= SUBSEQUENCE and answered >= ANSWER:
                    found = (shared, answered, round(float(cosine[u]), 6))
                    best[d, item] = max(best.get((d, item), found), found)
                    if (shared, answered) == top:
                        break  # no window of the piece has more, and those that follow have less cosine
    return [(d, item, c, shared, answer) for (d, item), (shared, answer, c) in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, about ``ITEMS`` at a time; the driver holds one block."""
    n = benchmark.count()
    parts = -(-n // ITEMS)
    for b in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b).select("item_id", "text").collect()
        items = items_of(sorted(map(tuple, rows), key=str))
        if items.ids:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, subsequence, answer) of every document that holds an item."""
    spark, out = docs.sparkSession, None
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index(docs, items))  # one block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in W.slices(batches, "text", BLOCK):
                found = search(batch, ix)
                ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([ix.items.ids[x[1]] for x in found], pa.int64()), *(pa.array([x[j] for x in found], pa.float64()) for j in (2, 3, 4))], ["doc_id", "item_id", "cosine", "subsequence", "answer"])

        new = docs.select("doc_id", "text").mapInArrow(run, LEAKS)
        out = new if out is None else out.unionByName(new)
    if out is None:
        return spark.createDataFrame([], LEAKS)
    top = F.max(F.struct("subsequence", "answer", "cosine")).alias("top")
    return out.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.cosine", "top.subsequence", "top.answer")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, that hold no item."""
    spark, schema, out = docs.sparkSession, docs.schema, docs
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index(docs, items))  # one block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in W.slices(batches, "text", BLOCK):
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in search(batch, shared.value)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
