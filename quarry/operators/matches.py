"""Where a pattern matches: ranges in texts and in paths, windows of lines around them, and what a search tells of them.

Files are (repo_name, branch, path, content). A file without a match is never split, and a
file with matches becomes one row a match, not one a line: places are running sums over
what lies between matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import policy

FILE = ("repo_name", "branch", "path")
#: Fixed value: bytes of a line that are shown.
SHOWN = 2000
CUT = "... (line truncated)"
PLACE = ("line", "column", "end_line", "end_column", "start_byte", "end_byte")


def included(glob: str) -> str:
    """A glob as a pattern that may match any stretch of a path: ``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` is a choice of words."""
    tokens = re.findall(r"\*\*|\*|\?|\{[^}]*\}|.", glob, re.DOTALL)
    plain = {"**": ".*", "*": "[^/]*", "?": "[^/]"}

    def piece(token: str) -> str:
        if len(token) > 1 and token[0] == "{":
            return "(" + "|".join(map(re.escape, token[1:-1].split(","))) + ")"
        return plain.get(token) or re.escape(token)

    return "".join(map(piece, tokens))


def _newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n")))


def _after_last(x: Column) -> Column:
    """Characters up to the last newline, with it; 0 where there is none."""
    return F.when(x.contains("\n"), F.length(x) - F.length(F.substring_index(x, "\n", -1))).otherwise(0)


def _checked(files: DataFrame, pattern: str) -> None:
    if files.sparkSession.range(1).select(F.lit("").rlike(pattern)).first()[0]:
        raise ValueError("a pattern that matches nothing at all has no ranges")


def _sizes(x: Column) -> Column:
    """Of a match and of what lies between it and the one before: characters, bytes, newlines and where the last of these is."""
    parts = [part(x[of]).alias(of + name) for of in ("gap", "hit") for name, part in (("", F.length), ("_bytes", F.octet_length), ("_lines", _newlines), ("_last", _after_last))]
    return F.struct(*parts)


def spans(rows: DataFrame, keys: tuple[str, ...], value: str, pattern: str) -> DataFrame:
    """keys and the places of each match in ``value``: lines and columns from 1, bytes from 0, ends excluded."""
    v = F.col(value)
    pairs = F.arrays_zip(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)).alias("hit"), F.split(v, pattern, -1).alias("gap"))
    sizes = F.transform(F.filter(pairs, lambda x: x["hit"].isNotNull()), _sizes)  # what follows the last match has no match
    found = rows.filter(v.rlike(pattern)).select(*keys, F.posexplode(sizes)).select(*keys, F.col("pos").alias("nth"), "col.*")
    upto = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    found = found.withColumns({
        "at": F.sum(F.col("gap") + F.col("hit")).over(upto) - F.col("hit"), "start_byte": F.sum(F.col("gap_bytes") + F.col("hit_bytes")).over(upto) - F.col("hit_bytes"),
        "line": 1 + F.sum("gap_lines").over(upto) + none(F.sum("hit_lines").over(before)),
    })
    in_gap = F.when(F.col("gap_last") > 0, F.col("at") - F.col("gap") + F.col("gap_last"))
    in_hit = F.when(F.col("hit_last") > 0, F.col("at") + F.col("hit_last"))
    line_start = F.greatest(F.lit(0), none(F.max(in_gap).over(upto)), none(F.max(in_hit).over(before)))
    found = found.withColumn("column", F.col("at") - line_start + 1)
    end_column = F.when(F.col("hit_last") > 0, F.col("hit") - F.col("hit_last") + 1).otherwise(F.col("column") + F.col("hit"))
    return found.select(*keys, "line", "column", (F.col("line") + F.col("hit_lines")).alias("end_line"), end_column.alias("end_column"), "start_byte", (F.col("start_byte") + F.col("hit_bytes")).alias("end_byte"))


def ranges(files: DataFrame, pattern: str) -> DataFrame:
    """Each match in a text, and each in a path as a range of its own (``is_name``)."""
    _checked(files, pattern)
    inside = spans(files, FILE, "content", pattern).withColumn("is_name", F.lit(False))
    named = files.select("repo_name", "branch", "path", F.col("path").alias("name"))
    return inside.unionByName(spans(named, FILE, "name", pattern).withColumn("is_name", F.lit(True)))


def windows(files: DataFrame, found: DataFrame, context: int = 0) -> DataFrame:
    """Stretches of lines around the matches in texts: those that overlap are one, touching ones are not.

    start_line, end_line, content, matches and the lines that match. Only files with matches are read again.
    """
    context = policy.search_options(context=context)["context"]
    own = found.filter(~F.col("is_name"))
    order = Window.partitionBy(*FILE).orderBy("line", "column")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (reach + context < F.col("line") - context)
    island = own.withColumn("new", new.cast("int")).withColumn("chunk", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = island.groupBy(*FILE, "chunk").agg(F.min("line").alias("first"), F.max("end_line").alias("last"), F.count(F.lit(1)).alias("matches"), F.array_join(F.sort_array(F.collect_set("line")), ",").alias("lines"))
    texts = files.select(*FILE, F.split("content", "\n").alias("all"))
    start, end = F.greatest(F.lit(1), F.col("first") - context), F.least(F.size("all"), F.col("last") + context)
    met = chunks.join(texts, list(FILE)).withColumns({"start_line": start, "end_line": end})
    body = F.array_join(F.slice("all", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return met.select(*FILE, "chunk", "start_line", F.col("end_line").cast("long").alias("end_line"), body.alias("content"), "matches", "lines")


def first_matches(found: DataFrame, most: int) -> DataFrame:
    """The first matches in order of files, and whether these are all (``exhaustive``): one more than ``most`` is asked for."""
    order = [*FILE, F.col("is_name").desc(), "line", "column"]
    cut = found.orderBy(*order).limit(most + 1)
    place = F.row_number().over(Window.orderBy(*order))  # most + 1 rows
    cut = cut.withColumn("place", place)
    return cut.withColumn("exhaustive", F.max("place").over(Window.partitionBy()) <= most).filter(F.col("place") <= most)


def totals(found: DataFrame) -> DataFrame:
    """What a grouped search tells: matches in texts, and files with a match in text or name, of each repository."""
    files = F.countDistinct(*FILE).alias("files")
    return found.groupBy("repo_name").agg(F.count_if(~F.col("is_name")).alias("matches"), files)


def shown_lines(files: DataFrame, found: DataFrame) -> DataFrame:
    """The matching lines as the tool shows them, long ones cut."""
    chunks = windows(files, found, 0)
    each = chunks.select(*FILE, "start_line", F.posexplode(F.split("content", "\n")).alias("nth", "body"))
    body = F.when(F.octet_length("body") <= SHOWN, F.col("body")).otherwise(F.concat(F.expr(f"LEFT(body, {SHOWN})"), F.lit(CUT)))
    return each.select(*FILE, (F.col("start_line") + F.col("nth")).alias("line"), body.alias("text"))


def scoped(files: DataFrame, repos: DataFrame, path: str = "", include: str = "", repo: str = "", several: tuple[str, ...] = (), ref: str = "") -> DataFrame:
    """The files that a grep may read. ``repos`` are (repo_name, default_branch) of the organization.

    Repositories that are named must be there. Without a reference each repository is read at its default branch; a
    reference needs a repository; and without either, the number of repositories is bounded.
    """
    several = tuple(x.strip() for x in several if x.strip())
    if repo and several:
        raise ValueError("either one repository or several")
    wanted = [repo] if repo else list(several)
    if ref and not wanted:
        raise ValueError("a reference needs a repository")
    if not wanted:
        policy.check_breadth(repos)
    elif any(re.search(r"[\s,]", x) for x in wanted):
        raise ValueError("that is no repository's name")
    else:
        known = {r.repo_name for r in repos.filter(F.col("repo_name").isin(wanted)).select("repo_name").collect()}
        if set(wanted) - known:
            raise ValueError(f"no such repository: {', '.join(sorted(set(wanted) - known))}")
        repos = repos.filter(F.col("repo_name").isin(wanted))
    branch = F.col("default_branch") if ref in ("", "HEAD") else F.lit(re.sub("^refs/(heads|tags)/", "", ref))
    pairs = repos.select("repo_name", branch.alias("branch")).distinct()
    out = files.join(pairs, ["repo_name", "branch"], "left_semi")
    if path:
        out = out.filter(F.col("path").contains(path))
    if include:
        out = out.filter(F.col("path").rlike(included(include)))
    return out


def grep(files: DataFrame, repos: DataFrame, pattern: str, limit: int | None = None, **scope) -> DataFrame:
    """The tool: matching lines of the first matches, as many as its limit allows, with whether these are all."""
    if not pattern:
        raise ValueError("a pattern is needed")
    inside = scoped(files, repos, **scope)
    cut = first_matches(ranges(inside, pattern), policy.grep_limit(limit))
    told = cut.agg(F.max("exhaustive").alias("exhaustive"))
    return shown_lines(inside, cut).crossJoin(F.broadcast(told))  # one row


def grep_totals(files: DataFrame, repos: DataFrame, pattern: str, limit: int | None = None, **scope) -> DataFrame:
    """The grouped tool: matches and files of each repository among the first matches."""
    inside = scoped(files, repos, **scope)
    return totals(first_matches(ranges(inside, pattern), policy.grep_limit(limit, grouped=True)))
