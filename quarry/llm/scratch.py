"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a statement's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to Python.
BATCH = 4 << 20
#: Tables that this process made and has not dropped: paths, and how to reach their store.
_made: dict[str, tuple] = {}


def small_batches(spark: SparkSession) -> None:
    """Python gets rows in batches of some ``BATCH`` bytes; by default one of texts has 10,000 rows, which both sides hold whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on a local master (tests) a folder of our own, set for later calls."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def place(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    _made[path] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return path


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet, and the table read again. Its files survive the loss of any executor; the shuffle files of the plan
    go as soon as they are written, as nothing reads them again."""
    spark = df.sparkSession
    path = place(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(path: str) -> None:
    jvm, configuration = _made.pop(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(configuration).delete(at, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        _delete(path)


def release(spark: SparkSession) -> None:
    """Let the cleaner take the shuffle files of plans that are done: it sees them when no frame here and then nothing in
    the driver's JVM refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    """What results still read goes when the driver ends."""
    for path in list(_made):
        try:
            _delete(path)
        except (Py4JError, OSError):
            return
