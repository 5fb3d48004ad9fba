"""Text search, trees and slices over files (repo_name, branch, path, lang, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: Lines and bytes of a slice, bytes of a source that is read at all, and bytes of a line.
MOST_LINES, MOST_BYTES, MOST_SOURCE, MOST_LINE = 800, 16_384, 4 << 20, 2000
#: Depth and entries of a tree.
DEEPEST, MOST_ENTRIES = 10, 10_000


def lines(files: DataFrame) -> DataFrame:
    return files.select("repo_name", "branch", "path", F.posexplode(F.split("content", "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def grep(files: DataFrame, pattern: str, include: str | None = None, repos: list[str] | None = None, branch: str | None = None) -> DataFrame:
    """Matching lines. The whole text is tested first, so files without a match are never split."""
    if repos:
        files = files.filter(F.col("repo_name").isin(repos))
    if branch:
        files = files.filter(F.col("branch") == branch)
    if include:
        files = files.filter(F.col("path").rlike(text.glob_to_regex(include)))
    return lines(files.filter(F.col("content").rlike(pattern))).filter(F.col("content").rlike(pattern))


def by_repo(matches: DataFrame) -> DataFrame:
    return matches.groupBy("repo_name").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("path").alias("files"))


def read(files: DataFrame, repo: str, path: str, offset: int = 1, limit: int = MOST_LINES) -> DataFrame:
    if offset < 1 or not 1 <= limit <= MOST_LINES:
        raise ValueError(f"lines count from 1, and {MOST_LINES} at most are read")
    one = files.filter((F.col("repo_name") == repo) & (F.col("path") == path) & (F.octet_length("content") <= MOST_SOURCE))
    rows = lines(one).filter(F.col("line").between(offset, offset + limit - 1)).withColumn("content", text.cut_bytes(F.col("content"), MOST_LINE))
    upto = Window.partitionBy("repo_name", "branch", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.octet_length("content") + 1).over(upto)).filter(F.col("used") <= MOST_BYTES).drop("used")


def listed(files: DataFrame, repo: str, below: str = "", depth: int = 1, folders: bool = True, leaves: bool = True, most: int = 1000) -> DataFrame:
    """Entries of one repository below a folder, as the tool lists them; depth counts from that folder."""
    if not 1 <= depth <= DEEPEST or not 1 <= most <= MOST_ENTRIES:
        raise ValueError(f"depth is 1 to {DEEPEST}, and entries are 1 to {MOST_ENTRIES}")
    base = below.strip("/")
    inside = files.filter(F.col("repo_name") == repo)
    if base:
        inside = inside.filter(F.col("path").startswith(base + "/")).withColumn("path", F.substr("path", F.lit(len(base) + 2)))
    rows = tree(inside, depth, None).filter((F.col("is_file") & F.lit(leaves)) | (~F.col("is_file") & F.lit(folders)))
    named = F.concat(F.lit(base + "/" if base else ""), F.col("entry"))
    return rows.withColumn("entry", named).orderBy(F.lower("entry"), "entry").limit(most)


def tree(files: DataFrame, depth: int, most: int | None = 1000) -> DataFrame:
    """Folders and files down to a depth, in case-folded order; of each repository the first ``most``, all if None."""
    parts = F.split("path", "/")
    entries = files.select("repo_name", parts.alias("parts")).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth)))))
    entries = entries.select("repo_name", F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("entry"), (F.col("n") == F.size("parts")).alias("is_file"), "n").distinct()
    if most is not None:
        place = F.row_number().over(Window.partitionBy("repo_name").orderBy(F.lower("entry"), "entry", "is_file"))
        entries = entries.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    return entries.orderBy("repo_name", F.lower("entry"), "entry")


def in_branches(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files of the allowed pairs of repository and branch."""
    return files.join(pairs, ["repo_name", "branch"], "left_semi")


def compared(files: DataFrame, base: str, head: str) -> DataFrame:
    """Added and deleted lines of each file between two branches, as multisets."""
    one = lines(files).groupBy("repo_name", "path", "branch", "content").agg(F.count(F.lit(1)).alias("n"))
    a = one.filter(F.col("branch") == base).select("repo_name", "path", "content", F.col("n").alias("old"))
    b = one.filter(F.col("branch") == head).select("repo_name", "path", "content", F.col("n").alias("new"))
    d = F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))
    return a.join(b, ["repo_name", "path", "content"], "full").groupBy("repo_name", "path").agg(F.sum(F.greatest(d, F.lit(0))).alias("additions"), F.sum(F.greatest(-d, F.lit(0))).alias("deletions"))
