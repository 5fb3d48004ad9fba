"""Context of a chat and the question that searches with it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

TURNS, EACH, ALL, QUERY, ANCHORS = 8, 1400, 12_000, 4000, 32
#: What opens a context and what marks cuts.
OPENING, CUT, CUT_ALL = "Recent prior chat turns, oldest to newest:\n", "... (truncated)", "\n\n(Output truncated before sending back to the model.)"
#: Fixed value: what opens the list of anchors.
ANCHOR_OPENING = "\n\nRelevant prior code anchors for retrieval only:\n"
#: Words that name no code.
STOP = frozenset(
    (
        "a", "an", "and", "are", "as", "at", "be", "by", "can", "code", "codebase", "connect", "connection",
        "anchors", "context", "detail", "details", "diagram", "does", "entry", "exact", "explain", "file", "files", "flow", "focus", "for",
        "from", "function", "functions", "how", "important", "inside", "latest", "level", "lifecycle", "lines", "matter", "method", "methods",
        "of", "on", "operator", "part", "parts", "path", "piece", "pieces", "previous", "prior", "question", "relevant", "repo", "repos", "repository", "retrieval",
        "route", "service", "show", "spec", "symbol", "symbols", "test", "the", "their", "these", "this", "through",
        "to", "use", "used", "using", "work", "workloads", "what", "when", "where", "which", "with",
        "auto-instrumentation", "opentelemetry", "otel",
    )
)
#: Words of a chat that name no code either.
CHAT_STOP = STOP | {"assistant", "conversation", "evidence", "latest", "previous", "prior", "question", "retrieval", "using"}
#: Endings of source files.
SOURCE_ENDINGS = (
    ".go", ".rs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".kt", ".kts", ".scala", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp",
    ".cs", ".fs", ".vb", ".rb", ".dart", ".php", ".swift", ".sql", ".proto", ".yaml", ".yml", ".json", ".toml", ".xml", ".md",
)
PATH = re.compile(r"[A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)+")
#: A member of something, a constant, a name with an inner capital, quoted code.
ANCHOR_RULES = tuple(re.compile(p, re.ASCII) for p in (r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b", r"\b[A-Z][A-Z0-9_]{3,}\b", r"\b[A-Za-z_][A-Za-z0-9_]*(?:[A-Z][A-Za-z0-9_]*)+\b", "`([^`]{3,120})`"))


def context(conversations: DataFrame) -> DataFrame:
    """(conv_id, context): the last turns that say something, oldest first, until the context is full; bytes count.

    Cuts keep whole characters. A window holds one conversation's last turns, eight at most, so none is ever long.
    """
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = conversations.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= TURNS)
    said, role = F.trim(F.coalesce("text", F.lit(""))), F.upper(F.trim(F.coalesce("role", F.lit(""))))
    kept = F.when(F.octet_length(said) > EACH, F.concat(text.cut_bytes(said, EACH), F.lit(CUT))).otherwise(said)
    line = F.concat(F.when(role == "", "MESSAGE").otherwise(role), F.lit(": "), kept, F.lit("\n"))
    rows = last.select("conv_id", "turn", F.when(said != "", line).alias("line"))
    size = F.octet_length("line")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.lit(len(OPENING)) + F.coalesce(F.sum(size).over(upto), F.lit(0)) - F.coalesce(size, F.lit(0)))
    whole = F.concat(F.lit(OPENING), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull() & (F.col("before") < ALL), F.struct("turn", "line")))), lambda x: x["line"]), ""))
    joined = rows.groupBy("conv_id").agg(whole.alias("whole"))
    out = F.when(F.octet_length("whole") > ALL, F.concat(text.cut_bytes(F.col("whole"), ALL), F.lit(CUT_ALL))).when(F.octet_length("whole") == ALL, F.col("whole")).otherwise(F.regexp_replace("whole", "^[ \n]+|[ \n]+$", ""))
    return joined.select("conv_id", out.alias("context"))


def anchors_of(said: str, most: int = ANCHORS) -> list[str]:
    """Paths, then names that look like code, each once without regard to case."""
    out: dict[str, str] = {}

    def found() -> Iterator[str]:
        paths = {}
        for p in PATH.findall(said):
            p = p.strip(".,:;()[]{}<>\"'`")
            if p.lower().endswith(SOURCE_ENDINGS) and not any(x in ("", ".", "..") for x in p.split("/")):
                paths.setdefault(p, None)
        yield from list(paths)[:most]
        for rule in ANCHOR_RULES:
            for m in rule.finditer(said):
                one = m[1] if rule.groups and m[1].strip() else m[0]
                if "\n" not in one:
                    yield one

    for one in found():
        one = one.strip(" \t\r\n.,:;()[]{}<>\"'`")
        if len(one.encode()) >= 3 and one.lower() not in CHAT_STOP:
            out.setdefault(one.lower(), one)
            if len(out) >= most:
                break
    return list(out.values())


def query_of(question: str, said: str, most: int = QUERY) -> str:
    """The question with the anchors of what was said before, as long as bytes allow."""
    question, found = question.strip(), anchors_of(said) if said.strip() else []
    if not found:
        return question
    out = question + ANCHOR_OPENING
    for one in found:
        out += f"- {one}\n"
        if len(raw := out.encode()) >= most:
            return out if len(raw) == most else raw[:most].decode("utf-8", "ignore") + CUT_ALL
    return out.strip()


def retrieval_query(asked: DataFrame) -> DataFrame:
    """(conv_id, query, context) to (conv_id, query) with anchors. Several expressions over one text, so Python, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("query").to_pylist(), b.column("context").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([query_of(q or "", c or "") for q, c in pairs], pa.string())], ["conv_id", "query"])

    return asked.select("conv_id", "query", "context").mapInArrow(run, "conv_id long, query string")
