"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find.

Each shingle of a document draws, by its hash, a random permutation of the signature's
places; with step j it offers the value j + u (u uniform) to its j-th place. Each place
keeps its least offer. A document stops as soon as no later step can lower any of its
places. The values of a place are as for MinHash, but the steps of a shingle are ranks
of one permutation, so places are negatively correlated and the estimate varies less.

Documents with equal sets form a class first, so copies cost one row. Bands of the
signature put classes into buckets. Nothing is compared pair by pair within a bucket:
each member is compared with one pivot P, the class that meets most others in its own
or a neighbouring bucket, on their full sets. Union-find joins what is linked. For what
that leaves open, let D be the shingles that a set has outside P, M those of P that it
lacks, and ``E = 100 |M| + p |D| - (100 - p) |P|`` (p per cent; E > 0: no link with P).
The sets x and z differ by at most the share that a link allows only if

* they share at least ``(E(x) + p (|z| - |P|)) / (100 + p)`` shingles of D, or
* z is smaller than P, and x lacks all of M(z) but ``(p (|P| - |z|) - E(x)) / (100 + p)``,

where x is one of the two without a link to P (both in one component needs no link).
So members meet again only in new buckets, one for each such shingle, of the rarest
ones that must hold a shared one (a prefix filter): independent changes fall apart at
once, and what was copied together stays together. The new bucket gets a pivot of its
own, and sets are from then on known by D and M alone. This goes on until no bucket
holds two components: the same components as all pairs of all buckets would give. A
bucket's pivots leave it, and each round has four times as many of them, so rounds are
logarithmic; only sets that all resemble one another, share their changes and still
differ by too much cost more than their number. At the threshold itself 40 bands of 5
places lose one link in 8 million.

Sets are those of the 64-bit shingle hashes that n_shingles counts.

Defined results: null, empty and white texts have an empty set and no links, each being
a component of its own; texts with fewer words than a shingle are one shingle; null ids
count after all ids (a component without ids has a null component_id and is kept);
repeated rows are in one component and have the same result; an empty table gives an
empty result; columns other than doc_id and text are not read. ``keep`` leaves one row
of each component, also of rows without ids or with equal ones, and every empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bloom, scratch
from quarry.llm import words as W
from quarry.llm.components import components

BANDS, ROWS, PERCENT = 40, 5, 80
#: Text of a batch: sets that are compared, and sets that are signed, of which each shingle holds all places.
BLOCK, SIGNING = 1 << 20, 1 << 18
SHORT_BASE = 0x1B873593CC9E2D51
#: Pairs of one pivot that a task compares in a run.
RUN = 2000
FRACTION = np.uint64(48)
SIGNED = "doc_id long, th long, n_shingles long, cls binary, bands array<long>"


def shingles(words: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their documents, in order of document."""
    h, counts = words.hashes(), words.counts
    first, doc = words.window_doc(k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    e = np.concatenate([W.windows_hash(h, k)[first], W.runs_hash(h, words.bounds[short], words.bounds[short + 1], SHORT_BASE)])
    doc = np.concatenate([doc, short])
    order = np.lexsort((e, doc))
    e, doc = e[order], doc[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (doc[1:] != doc[:-1])
    return e[new], doc[new]


def signatures(e: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash of n documents; places of a document without shingles stay at the greatest value."""
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    top = np.zeros(n, np.uint64)
    places = None
    for j in range(m):
        if not len(e):
            break
        with np.errstate(over="ignore"):
            draw = W.mix(e + np.uint64(j + 1) * W.STEP)
        at = j + (((draw & np.uint64(0xFFFF)) * np.uint64(m - j)) >> np.uint64(16)).astype(np.int64)
        if j == 0:
            place = at
        else:
            row = np.arange(len(e))
            place = places[row, at].astype(np.int64)
            places[row, at] = places[row, j]
        np.minimum.at(out, doc * m + place, (np.uint64(j) << FRACTION) | (draw >> np.uint64(16)))
        live = np.unique(doc)
        top[:] = 0
        top[live] = out.reshape(n, m)[live].max(axis=1)
        stay = top[doc] >= np.uint64(j + 1) << FRACTION
        if j == 0:
            e, doc, at = e[stay], doc[stay], at[stay]
            places = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(e), 1))
            places[np.arange(len(e)), at] = 0
        elif not stay.all():
            e, doc, places = e[stay], doc[stay], places[stay]
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        with np.errstate(over="ignore"):
            x = np.full(len(signature), np.uint64(b) * W.WINDOW_STEP, np.uint64)
            for r in range(rows):
                x = W.mix(x * W.WINDOW_STEP + signature[:, b * rows + r])
        out[:, b] = x
    return W.signed(out)


def sign(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, a 128-bit name of the set, and band keys of each document; the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", SIGNING):
            n = batch.num_rows
            e, doc = shingles(W.of_column(batch.column("text"), lower=True), k)
            size = np.bincount(doc, minlength=n)
            some = np.flatnonzero(size)
            name = np.zeros((len(some), 2), np.uint64)
            if len(some):
                cut = np.searchsorted(doc, some)
                for i, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
                    name[:, i] = np.add.reduceat(W.mix(e ^ np.uint64(salt)), cut)
            keys = band_keys(signatures(e, doc, n, bands * rows)[some], bands, rows)
            names = np.full(n, None, object)
            names[some] = [x.tobytes() for x in name]
            offsets = pa.array(np.concatenate([[0], np.cumsum((size > 0) * bands)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(size, pa.int64()), pa.array(names, pa.binary()), lists], ["doc_id", "th", "n_shingles", "cls", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, SIGNED)


def texts_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, str]:
    """(cls, text) of the classes in pairs, and the table's path."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", "rep"), "cls")
    spark, identity = docs.sparkSession, lambda doc: F.xxhash64(F.coalesce(doc, F.lit(0)), "th")
    wanted, path = scratch.keep(wanted.select("cls", F.col("rep.doc_id").alias("r_doc"), F.col("rep.th").alias("th")), "wanted")
    filled = bloom.build(wanted.select(identity("r_doc").alias("row")), "row", wanted.count())
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").withColumn("row", identity("doc_id"))
    _, rows = bloom.parted(rows, "row", filled)  # a text that surely isn't wanted doesn't move
    wanted = wanted.withColumnRenamed("th", "r_th")
    out = scratch.keep(rows.join(wanted, rows.doc_id.eqNullSafe(wanted.r_doc) & (rows.th == wanted.r_th)).select("cls", "text").dropDuplicates(["cls"]), "texts")
    scratch.drop(spark, path)
    return out


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the text of a, each run of one b after a row of b's own text (a null there).

    A pivot's pairs spread over runs of about RUN rows, so no task holds a hot pivot and its text is sent once a run.
    """
    size = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
    parted = pairs.join(size, "b").withColumn("run", F.pmod(F.xxhash64("a"), "runs"))
    heads = parted.select("b", "run").distinct().join(texts.withColumnRenamed("cls", "b"), "b")
    rows = parted.join(texts.withColumnRenamed("cls", "a"), "a").select("a", "b", "run", "text")
    heads = heads.select(F.lit(None).cast("binary").alias("a"), "b", "run", "text")
    return rows.unionByName(heads).repartition("b", "run").sortWithinPartitions("b", "run", F.asc_nulls_first("a")).select("a", "b", "text")


def compared(met: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs with texts: the sizes of both full sets, whether they are linked, and hashes of the shingles that only
    a (d) and only b (m) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, np.uint64)
        for batch in W.slices(batches, "text", BLOCK):
            rows = batch.num_rows
            e, doc = shingles(W.of_column(batch.column("text"), lower=True), k)
            cut = np.searchsorted(doc, np.arange(rows + 1))
            head = batch.column("a").is_null().to_numpy(zero_copy_only=False)
            bounds = np.unique(np.concatenate([[0], np.flatnonzero(head), [rows]]))
            hit, b_n, lacks = np.zeros(len(e), bool), np.zeros(rows, np.int64), []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if head[low]:
                    pivot = e[cut[low] : cut[low + 1]].copy()
                mine = slice(cut[low], cut[high])
                at = np.minimum(np.searchsorted(pivot, e[mine]), max(len(pivot) - 1, 0))
                hit[mine] = pivot[at] == e[mine] if len(pivot) else False
                b_n[low:high] = len(pivot)
                for r in range(low, high):
                    own = slice(cut[r] - cut[low], cut[r + 1] - cut[low])
                    there = np.zeros(len(pivot), bool)
                    there[at[own][hit[mine][own]]] = True
                    lacks.append(pivot[~there])
            n, both = np.diff(cut), np.bincount(doc[hit], minlength=rows)
            link = 100 * both >= percent * (n + b_n - both)
            d = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - both)]), pa.int32()), pa.array(W.signed(e[~hit])))
            m = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lacks])]), pa.int32()), pa.array(W.signed(np.concatenate([pivot[:0], *lacks]))))
            full = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int64()), pa.array(b_n), pa.array(link), d, m], ["a", "b", "n", "b_n", "link", "d", "m"])
            yield full.filter(pa.array(~head))

    return met.mapInArrow(run, "a binary, b binary, n long, b_n long, link boolean, d array<long>, m array<long>")


def led(classes: DataFrame) -> tuple[DataFrame, str]:
    """(bucket, cls, leader) of buckets with several classes, and the table's path: the leader is the class that meets
    most others, of those in the bucket or in another bucket of one of its members."""
    spark, paths = classes.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written, so that its size is known: Spark broadcasts it below its own limit and nothing else moves."""
        df, path = scratch.keep(df, name)
        paths.append(path)
        return df

    placed = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = kept(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    live = kept(placed.join(shared, "bucket"), "live")
    best = kept(live.groupBy("cls").agg(F.struct((-F.sum("c")).alias("score"), "cls").alias("best")), "best")
    by_bucket = kept(live.join(best, "cls").groupBy("bucket").agg(F.min("best").alias("best")), "best")
    best = kept(live.select("bucket", "cls").join(by_bucket, "bucket").groupBy("cls").agg(F.min("best").alias("best")), "best")
    by_bucket = kept(live.join(best, "cls").groupBy("bucket").agg(F.min("best").alias("best")), "best")
    out = scratch.keep(live.select("bucket", "cls").join(by_bucket, "bucket").select("bucket", "cls", F.col("best.cls").alias("leader")), "led")
    scratch.drop(spark, *paths)
    return out


def postings(state: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """(bucket, scope, cls, comp, n, first): the buckets in which members of a scope, that is of a pivot, can still be linked.
    And tables to drop once it is written.

    See the module's text. ``first`` orders a bucket's members: those without a link to the pivot, with least of their
    own, lead. Shingles that members of one component alone have count as the rarest, as no open pair shares them.
    """
    d, m = F.size("d"), F.size("m")
    ceil = lambda x: F.ceil(x / (100 + percent))
    state = state.withColumn("e", 100 * m + percent * d - (100 - percent) * F.col("p_n"))
    open_ = state.groupBy("scope").agg(F.min(F.when(~F.col("link"), F.col("e"))).alias("e_min"), F.max(F.col("p_n") - F.col("n")).alias("less"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_, open_path = scratch.keep(open_.filter("low <> high AND e_min IS NOT NULL").drop("low", "high"), "open")
    state = state.join(open_, "scope")
    smaller = F.greatest(F.col("less"), F.lit(0))
    need = F.greatest(F.lit(1), F.when(F.col("link"), ceil(F.col("e_min") + percent * (F.col("n") - F.col("p_n")))).otherwise(ceil(F.col("e") - percent * smaller)))
    short = percent * (F.col("p_n") - F.col("n")) - F.col("e_min")
    some = F.when(~F.col("link") & (F.col("e") <= percent * smaller), m).when(short >= 0, F.floor(short / (100 + percent)) + 1).otherwise(0)
    sides = F.array(F.struct(F.lit(0).alias("side"), (d - need + 1).alias("prefix"), F.col("d").alias("all")), F.struct(F.lit(1).alias("side"), some.alias("prefix"), F.col("m").alias("all")))
    rows = state.select("scope", "cls", "comp", "n", F.struct("link", d.alias("own"), "cls").alias("first"), F.explode(sides).alias("s")).filter("s.prefix > 0")
    rows = rows.select("scope", "cls", "comp", "n", "first", "s.side", "s.prefix", F.size("s.all").alias("size"), F.explode("s.all").alias("one")).withColumn("bucket", F.xxhash64("scope", "side", "one")).drop("one")
    useful = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("often"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket", "often")
    useful, useful_path = scratch.keep(useful, "useful")
    own = Window.partitionBy("scope", "cls", "side")
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "bucket"))
    return rows.join(useful, "bucket").withColumn("place", place).filter("place <= prefix").select("bucket", "scope", "cls", "comp", "n", "first"), [open_path, useful_path]


def turned(pairs: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """Pairs (scope, cls, p) as rows of a state whose scope is the pivot p, by differences from the old scope's pivot.

    Where ``whole`` is not set, only the link counts.
    """
    x = state.select("scope", "cls", "comp", "n", F.col("p_n").alias("s_n"), F.col("d").alias("xd"), F.col("m").alias("xm"))
    y = state.select("scope", F.col("cls").alias("p"), F.col("comp").alias("p_comp"), F.col("n").alias("p_n"), F.col("d").alias("yd"), F.col("m").alias("ym"))
    both = F.col("s_n") - F.size(F.array_union("xm", "ym")) + F.size(F.array_intersect("xd", "yd"))
    met = pairs.join(x, ["scope", "cls"]).join(y, ["scope", "p"]).withColumn("both", both)
    met = met.withColumn("link", 100 * F.col("both") >= percent * (F.col("n") + F.col("p_n") - F.col("both")))
    d = F.concat(F.array_except("ym", "xm"), F.array_except("xd", "yd"))
    m = F.concat(F.array_except("xm", "ym"), F.array_except("yd", "xd"))
    return met.select(F.xxhash64("scope", "p").alias("scope"), "cls", "p", "n", "p_n", "link", F.when(F.col("link"), F.col("p_comp")).otherwise(F.col("comp")).alias("comp"), F.when(F.col("whole"), d).alias("d"), F.when(F.col("whole"), m).alias("m"))


def met(stars: DataFrame, percent: int) -> DataFrame:
    """Members of a bucket with its pivots besides the first, ``q``, but for those in one component and those whose sizes
    alone rule a link out."""
    others = stars.filter("also").select("bucket", F.col("cls").alias("q"), F.col("comp").alias("q_comp"), F.col("n").alias("q_n"))
    may = (F.col("comp") != F.col("q_comp")) & (100 * F.least("n", "q_n") >= percent * F.greatest("n", "q_n"))
    return stars.join(others, "bucket").filter(may)


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> tuple[DataFrame | None, list[str]]:
    """(node, root) of the classes that have a link; and the tables to drop later. See the module's text.

    A state's ``comp`` is a class that its row is linked to, if by several steps: rows of one comp need no link, and
    union-find runs once, over the links of all rounds.
    """
    spark = docs.sparkSession
    places, places_path = led(classes)
    pairs, path = scratch.keep(places.filter("cls <> leader").select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    scratch.drop(spark, places_path)
    if pairs.isEmpty():
        scratch.drop(spark, path)
        return None, []
    texts, texts_path = texts_of(pairs, docs, classes)
    seen, seen_path = scratch.keep(compared(with_texts(pairs, texts), k, percent), "compared")
    scratch.drop(spark, texts_path, path)
    comp = F.when(F.col("link"), F.col("b")).otherwise(F.col("a"))
    state = seen.select(F.xxhash64("b").alias("scope"), F.col("a").alias("cls"), F.col("b").alias("p"), "n", F.col("b_n").alias("p_n"), "link", comp.alias("comp"), "d", "m")
    links, paths = state.filter("link").select(F.col("cls").alias("a"), F.col("p").alias("b")), [seen_path]
    more = 3  # pivots of a bucket besides the first, about
    while True:
        posts, used = postings(state, percent)
        posts, path = scratch.keep(posts, "posts")
        scratch.drop(spark, *used)
        of = posts.groupBy("bucket").agg(F.min("first").alias("p"), F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        of, of_path = scratch.keep(of.filter("low <> high").select("bucket", "c", F.col("p.cls").alias("p")), "of")
        if of.isEmpty():
            scratch.drop(spark, path, of_path)
            break
        also = F.pmod(F.xxhash64("cls", F.lit(more)), F.lit(1 << 20)) * F.col("c") < more << 20
        stars, stars_path = scratch.keep(posts.join(of, "bucket").select("bucket", "scope", "cls", "comp", "n", "p", also.alias("also")), "stars")
        extra = met(stars, percent).select("scope", "cls", F.col("q").alias("p"), F.lit(False).alias("whole"))
        # a pivot besides the first has met all of the bucket, and needs no other of it
        pairs = stars.select("scope", "cls", "p", (~F.col("also")).alias("whole")).unionByName(extra).filter("cls <> p")
        seen, seen_path = scratch.keep(turned(pairs.groupBy("scope", "cls", "p").agg(F.max("whole").alias("whole")), state, percent), "turned")
        scratch.drop(spark, path, of_path, stars_path)
        links = links.unionByName(seen.filter("link").select(F.col("cls").alias("a"), F.col("p").alias("b")))
        paths.append(seen_path)
        state, more = seen.filter("d IS NOT NULL"), 4 * more + 3
    roots, path = components(links)
    scratch.drop(spark, *paths)
    return roots, [path]


def components_of(docs: DataFrame, k: int, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th, cls, n_shingles, component_id, kept for each document, and the id and text hash of the one of its
    component that comes first."""
    spark = docs.sparkSession
    signed, _ = scratch.keep(sign(docs, k, bands, rows), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes, classes_path = scratch.keep(signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(order).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    roots, paths = linked(docs, classes, k, percent)
    reps = classes.select("cls", "rep")
    if roots is None:
        reps = reps.withColumn("root", F.col("cls"))
    else:
        reps = reps.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = reps.groupBy("root").agg(F.min("rep").alias("first"))
    named, _ = scratch.keep(reps.join(least, "root").select("cls", "first"), "named")
    scratch.drop(spark, classes_path, *paths)
    out = signed.select("doc_id", "th", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", "th", "cls", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"))


def report(docs: DataFrame, k: int = 2) -> DataFrame:
    return components_of(docs, k).select("doc_id", "n_shingles", "component_id", "kept")


def keep(docs: DataFrame, k: int = 5) -> DataFrame:
    """The documents, with all columns, one row of each component: of those with the smallest id.

    Rows that surely stay, by a bounded filter of the rows that go or are there again, never move.
    """
    identity = lambda doc, text: F.xxhash64(F.coalesce(doc, F.lit(0)), text)
    whole = components_of(docs, k).filter("cls IS NOT NULL")
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("th") == F.col("first_th"))
    marked = whole.groupBy(F.col("doc_id").alias("m_doc"), F.col("th").alias("m_th")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("times"))
    marked, _ = scratch.keep(marked.filter("NOT stays OR times > 1").select("m_doc", "m_th", "stays"), "marked")
    filled = bloom.build(marked.select(identity("m_doc", "m_th").alias("key")), "key", marked.count())
    # no name of the input meets those used here
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th")).withColumn("key", identity("doc", "th"))
    clear, maybe = bloom.parted(rows, "key", filled)
    met = maybe.join(marked, maybe.doc.eqNullSafe(marked.m_doc) & (maybe.th == marked.m_th), "left")
    once = met.filter("stays").dropDuplicates(["doc", "th"])
    out = clear.select("row").unionByName(met.filter("stays IS NULL").select("row")).unionByName(once.select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
