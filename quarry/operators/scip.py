"""Rows from compiled symbol indexes: roles, enclosing definitions, the edges they make."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of a role mask, in the order in which their names are listed.
ROLE_BITS = {"DEFINITION": 1, "IMPORT": 2, "WRITE": 4, "READ": 8, "GENERATED": 16, "TEST": 32, "FORWARD_DEFINITION": 64}
#: Fixed value: what a line weighs against a column in a range's span.
LINE_SPAN = 100_000
#: Lines of a file that are swept together.
STRETCH = 8192


def roles(mask: Column) -> Column:
    """Names of a mask's roles; what defines nothing is first of all a reference."""
    named = F.array_compact(F.array(*(F.when(mask.bitwiseAND(bit) > 0, F.lit(name)) for name, bit in ROLE_BITS.items())))
    defines = mask.bitwiseAND(ROLE_BITS["DEFINITION"] | ROLE_BITS["FORWARD_DEFINITION"]) > 0
    return F.when(defines, named).otherwise(F.concat(F.array(F.lit("REFERENCE")), named))


def by_role(found: DataFrame, mask: str) -> DataFrame:
    """One row for each role of an occurrence."""
    return found.withColumn("role", F.explode(roles(F.coalesce(F.col(mask), F.lit(0)))))


def changed(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before it; the first does not."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        one, two = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def swept(found: DataFrame, definitions: DataFrame, file: list[str], key: list[str], order: list[str]) -> DataFrame:
    """``key`` columns of each occurrence, and the symbol of the smallest definition of another symbol around it (``enclosing``, null without one).

    Both sides have symbol, start_line, start_col, end_line, end_col; no range ends before it begins. Starts of a stretch of a file, sorted, are streamed past
    the definitions that are open, which are all that a task holds; of equal spans the first by ``order`` counts. A long
    file is several stretches, and a definition goes to each that it spans.
    """
    place = F.struct("start_line", "start_col", "end_line", "end_col")
    where, stretch = F.struct(*file).alias("file"), lambda c: F.floor(F.col(c) / STRETCH)
    span = (F.col("end_line") - F.col("start_line")).cast("long") * LINE_SPAN + F.greatest(F.col("end_col") - F.col("start_col"), F.lit(0))
    open_ = definitions.select(where, F.explode(F.sequence(stretch("start_line"), F.greatest(stretch("start_line"), stretch("end_line")))).alias("stretch"), place.alias("place"), F.lit(0).alias("kind"), "symbol", span.alias("span"), F.struct(*order).alias("order"))
    ask = found.select(where, stretch("start_line").alias("stretch"), place.alias("place"), F.lit(1).alias("kind"), "symbol", F.struct(*key).alias("key"))
    return _streamed(open_.unionByName(ask, allowMissingColumns=True).repartition("file", "stretch"))


def swept_in_place(rows: DataFrame, file: list[str], key: list[str], order: list[str]) -> DataFrame:
    """``swept`` where all rows of a file lie in one task: they are sorted there, and none moves.

    Rows have a symbol, a range (``at``) and that of what they define (``around``), structs that are null without one. A row
    without a range lies in nothing, and its ``enclosing`` is null.
    """
    at, around = F.col("at"), F.col("around")
    span = (around["end_line"] - around["start_line"]).cast("long") * LINE_SPAN + F.greatest(around["end_col"] - around["start_col"], F.lit(0))
    place = lambda c: F.struct(*(F.coalesce(c[n], F.lit(0)).alias(n) for n in ("start_line", "start_col", "end_line", "end_col"))).alias("place")
    order_, key_ = F.struct(*order).alias("order"), F.struct(*key)
    opens = F.struct(place(around), F.lit(0).alias("kind"), span.alias("span"), order_, F.when(F.lit(False), key_).alias("key"))
    asks = F.struct(place(at), F.when(at.isNull(), 2).otherwise(1).alias("kind"), F.lit(0).cast("long").alias("span"), order_, key_.alias("key"))
    both = rows.select(F.struct(*file).alias("file"), F.lit(0).cast("long").alias("stretch"), "symbol", F.explode(F.array(F.when(around.isNotNull(), opens), asks)).alias("x")).filter("x IS NOT NULL")
    return _streamed(both.select("file", "stretch", "symbol", "x.*"))


def _streamed(both: DataFrame) -> DataFrame:
    """The sweep over open definitions (kind 0), what asks for them (1) and what only goes along (2), a stretch of a file in one task."""
    both = both.sortWithinPartitions("file", "stretch", "place.start_line", "place.start_col", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, inner, ends = None, [], []  # open definitions by span, and by end
        for batch in batches:
            if not batch.num_rows:
                continue
            where = [*batch.column("file").flatten(), batch.column("stretch")]
            new, kinds = changed(where), batch.column("kind").to_numpy()
            new[0], last = tuple(c[0].as_py() for c in where) != last, tuple(c[-1].as_py() for c in where)
            ranks = iter(batch.column("order").take(pa.array(np.flatnonzero(kinds == 0))).to_pylist())
            numbers = [c.to_numpy(zero_copy_only=False).tolist() for c in batch.column("place").flatten()]
            told = []
            for fresh, kind, start_line, start_col, end_line, end_col, symbol, size in zip(new.tolist(), kinds.tolist(), *numbers, batch.column("symbol").to_pylist(), batch.column("span").to_pylist(), strict=True):
                if fresh:
                    inner, ends = [], []
                begin, end = (start_line, start_col), (end_line, end_col)
                while ends and ends[0][0] < begin:
                    del inner[bisect.bisect_left(inner, heapq.heappop(ends)[1])]
                if kind == 0:
                    one = (size, tuple((v is not None, v) for v in next(ranks).values()), symbol, end)
                    bisect.insort(inner, one)
                    heapq.heappush(ends, (end, one))
                elif kind == 2:
                    told.append(None)
                else:
                    told.append(next((d[2] for d in inner if d[2] != symbol and d[3] >= end), None))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.flatnonzero(kinds))), pa.array(told, pa.string())], ["key", "enclosing"])

    held = StructType().add("key", both.schema["key"].dataType).add("enclosing", "string")
    return both.mapInArrow(run, held).select("key.*", "enclosing")


def enclosed(found: DataFrame, definitions: DataFrame, file: list[str], key: list[str], order: list[str]) -> DataFrame:
    """Occurrences inside a definition of another symbol, with the smallest such definition's symbol (``enclosing``)."""
    return swept(found, definitions, file, key, order).filter("enclosing IS NOT NULL")


def edges(found: DataFrame) -> DataFrame:
    """(src, dst, relation, n) from enclosing symbols to those they use: imports, calls of what ends like a method, else references."""
    relation = F.when(F.col("role") == "IMPORT", "IMPORTS").when(F.col("symbol").endswith("()."), "CALLS").otherwise("REFERENCES")
    return found.groupBy(F.col("enclosing").alias("src"), F.col("symbol").alias("dst"), relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def grouped(found: DataFrame) -> DataFrame:
    """Occurrences by symbol and file, lines from 1, in order."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_set("start_line")), lambda x: (x + 1).cast("string")), ",")
    return found.groupBy("repo_id", "symbol", "file_path").agg(lines.alias("lines"), F.count(F.lit(1)).alias("n"))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: vertices by id, edges by both ends, kind and rank."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")
