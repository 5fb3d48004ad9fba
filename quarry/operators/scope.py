"""Tenant, repository and branch scope."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_repos(repos: DataFrame, links: DataFrame, connections: DataFrame) -> DataFrame:
    """Repositories with a connection of their own organisation."""
    pairs = links.join(connections, F.col("connection_id") == connections.id).select(F.col("repo_id").alias("id"), "org_id")
    return repos.join(pairs, ["id", "org_id"], "left_semi")


def in_org(df: DataFrame, org_id: int) -> DataFrame:
    if org_id <= 0:
        raise ValueError("an organisation id must be positive")
    return df.filter(F.col("org_id") == org_id)


def in_revisions(df: DataFrame, scopes: list[tuple[int, list[str]]]) -> DataFrame:
    """Rows of the named repositories, each with its revisions or with all when it names none. No scopes: all rows."""
    if not scopes:
        return df
    ok = F.lit(False)
    for repo, revisions in scopes:
        one = F.col("repo_id") == repo
        ok = ok | (one & F.col("revision").isin(revisions) if revisions else one)
    return df.filter(ok)


def branch_allowed(branch: Column, default: Column, globs: list[str]) -> Column:
    """No globs: the default branch, or any if there is none. ``*``: any. A bad glob matches nothing."""
    if not globs:
        return default.isNull() | (branch == default)
    out = F.lit(False)
    for g in globs:
        try:
            out = out | branch.rlike("^" + fnmatch.translate(g).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$")
        except re.error:
            continue
    return out


def page_limit(limit: int, default: int = 25, most: int = 100) -> int:
    return default if limit <= 0 else min(limit, most)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
