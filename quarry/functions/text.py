"""Scalar expressions over names, paths and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension, as manifests name them.
LANGUAGES = {
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
    "go": (".go",),
    "python": (".py",),
    "jvm": (".java", ".kt", ".scala"),
    "cpp": (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hh"),
    "dotnet": (".cs", ".vb", ".fs"),
    "ruby": (".rb",),
    "rust": (".rs",),
    "dart": (".dart",),
    "docs": (".md", ".mdx", ".rst", ".txt"),
    "config": (".json", ".yaml", ".yml", ".toml", ".xml", ".gradle", ".sbt"),
}
#: Folders that mark generated, vendored and test files.
GENERATED_DIRS = ("dist", "build", "coverage", "target", "generated", "gen", "vendor/bundle")
VENDOR_DIRS = ("node_modules", "vendor", "third_party", ".venv", "venv")
TEST_DIRS = ("__tests__", "test", "tests", "spec")


def like_escape(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_any(columns: list[Column], terms: list[str]) -> Column:
    """Whether any column, null as empty, holds any term without regard to case."""
    out = F.lit(False)
    for c in columns:
        for t in terms:
            out = out | F.coalesce(c, F.lit("")).ilike(f"%{like_escape(t)}%")
    return out


def suffix_patterns(name: str) -> list[str]:
    """LIKE patterns of symbol ids that end in a name: as method, term or type, after each separator or after anything."""
    return ["%" + like_escape(before + name.strip() + after) for after in ("().", ".", "#") for before in ("/", "#", ".", "")]


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` is a choice; the whole path must match."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + ")" * depth + "$"


def normalized(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(token), "[^A-Za-z0-9_.:-]+", "_"))


def hash_of(*parts: Column, digits: int = 8) -> Column:
    """Leading hex digits of SHA-256 over parts with NUL between."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits)


def _under(folders: tuple[str, ...]) -> str:
    return "(^|/)(" + "|".join(f.replace(".", "[.]") for f in folders) + ")/"


def is_generated(path: Column) -> Column:
    return path.rlike(_under(GENERATED_DIRS)) | path.contains(".generated.") | path.endswith(".min.js")


def is_vendor(path: Column) -> Column:
    return path.rlike(_under(VENDOR_DIRS))


def is_test_file(path: Column) -> Column:
    """In a folder of tests, or named ``x.test.y`` or ``x.spec.y``."""
    return path.rlike(_under(TEST_DIRS)) | path.rlike("(^|/)[^/]*[.](test|spec)[.][^./]+$")


def extension(path: Column) -> Column:
    """What follows the last dot, with it, in lower case; empty where there is no dot."""
    return F.lower(F.regexp_extract(path, "[.][^.]*$", 0))


def language(path: Column) -> Column:
    known = [F.when(extension(path).isin(*endings), name) for name, endings in LANGUAGES.items()]
    return F.coalesce(*known)


def safe_path(path: Column) -> Column:
    """Relative, without parent steps or control characters, and of bounded length."""
    return (F.length(path) > 0) & (F.length(path) <= 4096) & ~path.startswith("/") & ~path.rlike("(^|/)[.][.](/|$)") & ~path.rlike("[\\x00-\\x1f]")


def is_reference(ref: Column) -> Column:
    """What may name a branch, tag or commit: it begins with a letter or digit and has 256 characters at most."""
    return ref.rlike("^[A-Za-z0-9][A-Za-z0-9._/@+-]{0,255}$")


def cut_bytes(value: Column, most: int) -> Column:
    """The longest beginning of whole characters that ``most`` bytes of UTF-8 hold."""
    raw = F.substring(F.encode(value, "UTF-8"), 1, most + 1)
    tail = F.substring(F.hex(raw), 1, 2 * most)
    whole = F.regexp_replace(tail, "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(value) <= most, value).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def is_test(path: Column) -> Column:
    return path.ilike("%\\_test.%") | path.ilike("%/test/%") | path.ilike("tests/%")
