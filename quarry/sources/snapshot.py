"""Snapshots of graphs and symbol indexes: parts are written first, and a pointer is swapped when all of them are there.

    root/data/part=<part>/snapshot=<id>/org_id=<o>/repo_id=<r>/*.parquet
    root/active/<digest of the scope>.json

Readers follow the pointers of a scope (organization, repository, revision), so a write that was
killed, was given up or is still under way is never seen, and what was active stays readable.
Organization and repository are folders: a read that names them lists and opens no others.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCOPE = ("org_id", "repo_id", "revision")
FOLDERS = ("org_id", "repo_id")
POINTER = "org_id int, repo_id long, revision string, snapshot string, parts array<string>"


class Missing(RuntimeError):
    """A part that a snapshot needs was not written to its end."""


def _store(spark: SparkSession, path: str):
    """The path's file system, as the driver's JVM sees it, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", name):
        raise ValueError(f"{name!r} can't be the name of a folder")
    return name


def _folder(root: str, part: str, snapshot: str) -> str:
    return f"{root.rstrip('/')}/data/part={_checked(part)}/snapshot={_checked(snapshot)}"


def write(df: DataFrame, root: str, part: str, snapshot: str) -> None:
    """Write one part of a snapshot. The marker of a finished write is Spark's own; a part that is written again is replaced."""
    df.repartition(*FOLDERS).write.mode("overwrite").partitionBy(*FOLDERS).parquet(_folder(root, part, snapshot))


def complete(spark: SparkSession, root: str, part: str, snapshot: str) -> bool:
    store, at = _store(spark, f"{_folder(root, part, snapshot)}/_SUCCESS")
    return store.exists(at)


def _pointer(root: str, scope: dict) -> str:
    key = hashlib.sha256("\0".join(str(scope[c]) for c in SCOPE).encode()).hexdigest()
    return f"{root.rstrip('/')}/active/{key}.json"


def activate(spark: SparkSession, root: str, snapshot: str, scopes: list[dict], parts: tuple[str, ...]) -> None:
    """Let the scopes show a snapshot, once all of its parts are there. Each pointer is written aside and moved into place."""
    lacking = [p for p in parts if not complete(spark, root, p, snapshot)]
    if lacking:
        raise Missing(f"snapshot {snapshot} lacks {', '.join(lacking)}")
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    for scope in scopes:
        path = _pointer(root, scope)
        aside = path.replace("/active/", "/aside/") + "." + _checked(snapshot)
        store, at = _store(spark, aside)
        out = store.create(at, True)
        out.write(bytearray((json.dumps({c: scope[c] for c in SCOPE} | {"snapshot": snapshot, "parts": list(parts)}) + "\n").encode()))
        out.close()
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store.mkdirs(to.getParent())
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(store.makeQualified(at), store.makeQualified(to), overwrite)


def deactivate(spark: SparkSession, root: str, scopes: list[dict]) -> None:
    for scope in scopes:
        store, at = _store(spark, _pointer(root, scope))
        store.delete(at, False)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """What each scope shows; no rows where nothing was ever active."""
    store, at = _store(spark, f"{root.rstrip('/')}/active")
    if not store.exists(at):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).json(f"{root.rstrip('/')}/active")


def read(spark: SparkSession, root: str, part: str, schema: StructType, org_id: int | None = None, repo_id: int | None = None) -> DataFrame:
    """The rows of a part that the pointers show, of all scopes or of an organization or repository.

    A snapshot may hold more revisions than a scope shows: rows are those of the pointer's own organization, repository and revision.
    """
    shown = pointers(spark, root).filter(F.array_contains("parts", part))
    for name, value in (("org_id", org_id), ("repo_id", repo_id)):
        if value is not None:
            shown = shown.filter(F.col(name) == value)
    base = f"{root.rstrip('/')}/data/part={_checked(part)}"
    store, at = _store(spark, base)
    if not store.exists(at):
        return spark.createDataFrame([], schema)
    held = StructType([f for f in schema.fields if f.name not in FOLDERS]).add("snapshot", "string").add("org_id", "integer").add("repo_id", "long")
    rows = spark.read.schema(held).parquet(base)
    for name, value in (("org_id", org_id), ("repo_id", repo_id)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.join(shown.select(*SCOPE, "snapshot"), [*SCOPE, "snapshot"]).select(*schema.names)


def abandon(spark: SparkSession, root: str, snapshot: str, parts: tuple[str, ...]) -> None:
    """Delete the parts of a snapshot that no scope shows."""
    if not pointers(spark, root).filter(F.col("snapshot") == snapshot).isEmpty():
        raise ValueError(f"snapshot {snapshot} is active")
    for part in parts:
        store, at = _store(spark, _folder(root, part, snapshot))
        store.delete(at, True)
