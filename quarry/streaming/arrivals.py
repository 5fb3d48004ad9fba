"""Files that arrive, planned as they come: a stream that keeps each repository's last manifest and tells what a new one changes.

Events are (repo_name, manifest, kind, path, content_hash, root): ``file`` rows of a manifest by its number, its ``end``,
and ``repair``, which asks for the semantic layer anew. State is by repository and bucket of paths, so a repository
with a third of all files is the work of many tasks and no manifest is ever held whole: each bucket tells its own
counts, and ``plans`` adds them up. A manifest whose end never comes is forgotten when a later one ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 16
PARTIAL = "repo_name string, bucket int, manifest long, outcome string, had_previous boolean, added long, changed long, deleted long, unchanged long, roots string"


class Planner(StatefulProcessor):
    """``files``: path to hash and root of the last whole manifest; ``coming``: those of manifests without an end so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "content_hash long, root string")
        self.coming = handle.getMapState("coming", "manifest long, path string", "content_hash long, root string")
        self.done = handle.getValueState("done", "manifest long")

    def _last(self) -> int | None:
        return self.done.get()[0] if self.done.exists() else None

    def _ended(self, key: tuple, manifest: int) -> tuple:
        """Compare what came with what was there, and take its place."""
        last = self._last()
        new = {path: value for (number, path), value in list(self.coming.iterator()) if number == manifest}
        old = {path: value for (path,), value in list(self.files.iterator())}
        added, deleted = [p for p in new if p not in old], [p for p in old if p not in new]
        changed = [p for p in new if p in old and new[p][0] != old[p][0]]
        roots = sorted({new[p][1] for p in [*added, *changed] if new[p][1] is not None})
        for p in deleted:
            self.files.removeKey((p,))
        for p in [*added, *changed]:
            self.files.updateValue((p,), new[p])
        self._forget(manifest)
        self.done.update((manifest,))
        return (*key, manifest, "whole", last is not None, len(added), len(changed), len(deleted), len(new) - len(added) - len(changed), "\n".join(roots))

    def _forget(self, upto: int) -> None:
        for number, path in [k for k, _ in list(self.coming.iterator()) if k[0] <= upto]:
            self.coming.removeKey((number, path))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        order = {"file": 0, "end": 1, "repair": 2}
        events = events.assign(step=events["kind"].map(order)).sort_values(["manifest", "step"], na_position="last")
        out = []
        for e in events.itertuples():
            last = self._last()
            if e.kind == "repair":
                if last is not None:
                    roots = sorted({v[1] for _, v in list(self.files.iterator()) if v[1] is not None})
                    out.append((*key, last, "repair", True, 0, 0, 0, len(list(self.files.iterator())), "\n".join(roots)))
            elif last is not None and e.manifest <= last:
                if e.kind == "end":
                    out.append((*key, int(e.manifest), "late", True, 0, 0, 0, 0, ""))
            elif e.kind == "file":
                self.coming.updateValue((int(e.manifest), e.path), (int(e.content_hash), e.root))
            else:
                out.append(self._ended(key, int(e.manifest)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])

    def close(self) -> None:
        pass


def tracked(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What each bucket of a repository's paths tells of each manifest; ends and repairs go to all buckets."""
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    dealt = events.withColumn("bucket", F.explode(F.when(F.col("kind") == "file", own).otherwise(every)))
    return dealt.groupBy("repo_name", "bucket").transformWithStateInPandas(statefulProcessor=Planner(), outputStructType=PARTIAL, outputMode="Append", timeMode="None")


def plans(partials: DataFrame, buckets: int = BUCKETS, file_delta: bool = True) -> DataFrame:
    """The plan of each manifest that every bucket has told of, and of each repair."""
    totals = {c: F.sum(c).alias(c) for c in ("added", "changed", "deleted", "unchanged")}
    roots = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("roots", "\n"))), lambda r: r != ""))).alias("roots")
    whole = partials.filter(F.col("outcome").isin("whole", "repair")).groupBy("repo_name", "manifest", "outcome").agg(F.countDistinct("bucket").alias("told"), F.max("had_previous").alias("had_previous"), *totals.values(), roots)
    touched, repair = F.col("added") + F.col("changed") + F.col("deleted") > 0, F.col("outcome") == "repair"
    mode = F.when(repair, "SEMANTIC_REPAIR").when(~F.col("had_previous"), "FULL").when(touched, "DELTA").otherwise("NOOP")
    rows = whole.filter(F.col("told") == buckets).withColumn("mode", mode)
    some = lambda **of: F.coalesce(*(F.when(F.col("mode") == m, v) for m, v in of.items()), F.lit("NOOP"))
    return rows.select(
        "repo_name", "manifest", "mode", "added", "changed", "deleted", "unchanged",
        some(FULL="FULL_REPO", DELTA="DELTA_FILES" if file_delta else "FULL_REPO_REWRITE").alias("lexical"),
        some(FULL="FULL_REPO", SEMANTIC_REPAIR="FULL_REPO", DELTA="PROJECT_ROOTS").alias("scip"),
        some(FULL="DELTA_FILES", SEMANTIC_REPAIR="DELTA_FILES", DELTA="DELTA_FILES").alias("graph"),
        F.lit("SKIPPED").alias("semantic"), F.when(F.col("mode") != "NOOP", F.array_join("roots", ",")).otherwise("").alias("roots"),
    )
