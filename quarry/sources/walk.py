"""Source files of a folder, for extraction: ignored folders left out, sizes and numbers bounded, language by extension.

The listing is Spark's own reader, so any store that Spark reads will do and files are read where they are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.extract import BY_EXTENSION

#: Files that a walk takes and bytes of each, at most.
MOST_FILES, MOST_BYTES = 5000, 512 << 10
#: Folders that hold no source of one's own.
IGNORED = (".git", "node_modules", "vendor", "dist", "build", "target", "coverage", ".venv", "venv", "__pycache__")


def extractor(path: Column) -> Column:
    """The language whose extractor reads a file; null where there is none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair)), text.extension(path))


def files(spark: SparkSession, folder: str, languages: list[str] | None = None, most: int = MOST_FILES, bytes_: int = MOST_BYTES) -> DataFrame:
    """(path, language, size, content) of the first files by path; all languages in one listing unless some are named."""
    base = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.split("://")[-1].lstrip("/")) + "/", "")
    rows = found.select(relative.alias("path"), F.col("length").alias("size"), "content").withColumn("language", extractor(F.col("path")))
    ignored = "(^|/)(" + "|".join(re.escape(x) for x in IGNORED) + ")/"
    rows = rows.filter(F.col("language").isNotNull() & ~F.col("path").rlike(ignored) & (F.col("size") <= bytes_) & text.safe_path(F.col("path")))
    if languages:
        rows = rows.filter(F.col("language").isin(languages))
    chosen = rows.select("path").orderBy("path").limit(most)  # names alone are sorted; contents stay where they are
    return rows.join(chosen, "path", "left_semi").select("path", "language", "size", F.decode("content", "UTF-8").alias("content"))


#: What every audit event says.
AUDIT = "event_id string, org_id int, actor string, action string, target string, at timestamp, metadata map<string,string>"


def append_audit(events: DataFrame, path: str) -> int:
    """Appends valid events (tenant, actor and action given, each id once) by tenant; the number of rows that were not valid."""
    ok = (F.col("org_id") > 0) & (F.trim("actor") != "") & (F.trim("action") != "") & F.col("event_id").isNotNull()
    marked = events.withColumn("ok", F.coalesce(ok, F.lit(False)))
    rows = marked.filter("ok").drop("ok").dropDuplicates(["event_id"]).withColumn("metadata", F.to_json("metadata"))
    rows.write.mode("append").partitionBy("org_id").parquet(path)
    return marked.filter("NOT ok").count()
