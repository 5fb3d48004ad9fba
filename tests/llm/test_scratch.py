"""Kept tables leave no shuffle files behind."""

import time

import pyarrow as pa

import corpus_pipeline
from quarry.llm import scratch


def _shuffles(spark):
    return {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before, rows = _shuffles(spark), spark.range(1000).repartition(3).groupBy("id").count()
    kept, path = scratch.keep(rows, "rows")
    for _ in range(50):
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 1000 and rows.count() == 1000
    assert spark.conf.get(scratch.CLEANUP) == "false"
    scratch.drop(spark, path)


def test_pipeline_gives_python_small_batches(spark):
    """A batch's bytes are bounded, not only its rows."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        for step, stage in corpus_pipeline.STAGES:
            spark.conf.set(setting, before)
            docs = spark.createDataFrame([(i, "a b c " * 20_000) for i in range(80)], "doc_id long, text string").coalesce(1)
            if step in ("near_dedup", "tokens"):
                stage(spark, docs.limit(1), "/root/testdata/sf0.001")
                assert max(r.b for r in docs.mapInArrow(_sizes, "b long").collect()) <= scratch.BATCH + (1 << 20)
    finally:
        spark.conf.set(setting, before)


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"])
