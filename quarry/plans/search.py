"""The search language: ``repo:``, ``file:``, ``branch:``, ``lang:``, ``reposet:``, ``case:``, negation, quotes, groups, ``or``.

``and`` binds closer than ``or``; a minus negates what follows it, an atom or a group. What can't be read raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = {"repo": "repo_name", "file": "path", "branch": "branch", "rev": "branch", "b": "branch", "lang": "lang", "reposet": "repo_name", "content": "content", "case": "case"}
TOKEN = re.compile(r"""\s*(?:(?P<open>-?\()|(?P<close>\))|(?P<minus>-)?(?:(?P<field>repo|file|branch|rev|b|lang|reposet|content|case):)?(?P<value>"(?:[^"\\]|\\.)*"|[^\s()"]+))""")


@dataclass(frozen=True)
class Atom:
    field: str
    value: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


def branch_name(name: str) -> str:
    return name.removeprefix("refs/heads/").removeprefix("refs/tags/")


def parse(query: str) -> Any:
    """A tree of alternatives."""
    at, stack = 0, [[[]]]  # for each open group its alternatives, each a list of parts
    signs: list[bool] = []

    def closed(alternatives: list[list]) -> Any:
        return Any(tuple(All(tuple(a)) for a in alternatives if a))

    while query[at:].strip():
        m = TOKEN.match(query, at)
        if not m:
            raise ValueError(f"can't read the search from {query[at:]!r} on")
        at = m.end()
        if m["open"]:
            stack.append([[]])
            signs.append(m["open"] == "-(")
        elif m["close"]:
            if len(stack) == 1:
                raise ValueError("a group is closed that was not opened")
            group = closed(stack.pop())
            stack[-1][-1].append(Not(group) if signs.pop() else group)
        elif m["value"] == "or" and not m["field"] and not m["minus"]:
            stack[-1].append([])
        else:
            value = m["value"]
            if value.startswith('"'):
                value = re.sub(r"\\(.)", r"\1", value[1:-1])
            field = m["field"] or "content"
            atom = Atom(field, branch_name(value) if FIELDS[field] == "branch" else value)
            stack[-1][-1].append(Not(atom) if m["minus"] else atom)
    if len(stack) > 1:
        raise ValueError("a group is not closed")
    return closed(stack[0])


def atoms(part: object, wanted: bool = True) -> list[tuple[bool, Atom]]:
    """The atoms of a tree, and whether each is asked for rather than excluded."""
    if isinstance(part, Atom):
        return [(wanted, part)]
    if isinstance(part, Not):
        return atoms(part.part, not wanted)
    return [x for p in part.parts for x in atoms(p, wanted)]


def branches(query: str) -> list[str]:
    """Branches that a query asks for, by their short names, each once."""
    return list(dict.fromkeys(a.value for wanted, a in atoms(parse(query)) if wanted and FIELDS[a.field] == "branch" and a.value))


def _column(part: object, fold: bool) -> Column:
    if isinstance(part, Not):
        return ~_column(part.part, fold)
    if isinstance(part, All):
        return reduce(and_, (_column(p, fold) for p in part.parts), F.lit(True))
    if isinstance(part, Any):
        return reduce(or_, (_column(p, fold) for p in part.parts)) if part.parts else F.lit(True)
    c = F.col(FIELDS[part.field]) if part.field != "case" else F.lit(True)
    if part.field == "case":
        return c
    if part.field == "reposet":
        return c.isin(part.value.split(","))
    if FIELDS[part.field] in ("branch", "lang"):
        return c == part.value
    return c.rlike(("(?i)" if fold else "") + part.value)


def predicate(query: str, default_branch: str | None = "main", options: list[str] | None = None, scoped: bool = False) -> Column:
    """A filter over files. A query that names no branch gets those of the options, else the default; none if a policy scopes it."""
    tree = parse(query)
    fold = any(a.field == "case" and a.value == "no" for _, a in atoms(tree))
    out = _column(tree, fold)
    if scoped or any(FIELDS[a.field] == "branch" for _, a in atoms(tree)):
        return out
    names = [branch_name(o) for o in options or []] or ([default_branch] if default_branch else [])
    return out & F.col("branch").isin(names) if names else out
