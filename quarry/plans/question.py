"""From a question to a traversal: intent, direction, depth, edge kinds, contexts and budget."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WIDE = ("CALLS", "DEPENDS_ON", "REFERENCES", "IMPORTS", "IMPORTS_FROM", "CONTAINS", "DEFINES", "EXTENDS", "IMPLEMENTS", "TYPE_DEFINES", "PROVIDES", "CONSUMES", "HANDLES", "EMITS", "ANCHOR_LINK")
#: Intents in the order in which they are tested: words, direction, depth, edge kinds.
INTENTS = (
    ("imports", ("import", "imports", "imported by"), "bidirectional", 3, ("IMPORTS", "IMPORTS_FROM")),
    ("callers", ("caller", "who calls", "references to"), "incoming", 3, ("CALLS", "REFERENCES", "USES")),
    ("callees", ("callee", "calls from", "what does", "depends on"), "outgoing", 3, ("CALLS", "DEPENDS_ON", "CONTAINS")),
    ("impact", ("impact", "blast radius", "affected", "risk"), "bidirectional", 4, ("CALLS", "DEPENDS_ON", "REFERENCES", "IMPORTS", "IMPORTS_FROM", "DEFINES", "EXTENDS", "IMPLEMENTS", "TYPE_DEFINES", "HANDLES", "EMITS")),
    ("path", ("path", "sequence", "chain"), "bidirectional", 5, WIDE),
    ("architecture", ("architecture", "flow", "lifecycle", "data flow", "cross-repo", "route", "event"), "bidirectional", 4, WIDE),
)
#: Phrases that ask for edges of a context.
HINTS = {
    "call": ("who calls", "caller", "calls", "called by", "call site", "invokes", "invocation", "callee", "call from", "uses"),
    "inherits": ("implements", "implementation", "subclass", "superclass", "super class", "inherit", "extends", "derived from", "base class", "parent class", "interface of", "protocol", "trait"),
    "type": ("type of", "return type", "returns", "typed", "typedef"),
    "import": ("imports", "imported by", "importing", "depend on", "depends on", "dependencies of", "dependency"),
    "reference": ("references", "referenced", "refers to", "refer to", "usages", "uses", "used by", "where is", "where used"),
    "definition": ("defined", "definition", "declared", "declaration", "where defined"),
    "containment": ("contains", "files", "file contains", "in file"),
}
#: What the focused tools put in front of a question.
PREFIXES = {
    "callers": "callers references to ",
    "callees": "callees calls from depends on ",
    "impact": "impact blast radius affected risk ",
    "path": "path sequence chain from ",
    "minimal_context": "minimal context architecture flow impact ",
}


@dataclass(frozen=True)
class Plan:
    intent: str = "default"
    direction: str = "bidirectional"
    depth: int = 3
    kinds: tuple[str, ...] = ()
    contexts: tuple[str, ...] = field(default=())


def plan(question: str) -> Plan:
    low = question.lower()
    contexts = tuple(sorted(c for c, phrases in HINTS.items() if any(p in low for p in phrases)))
    for intent, phrases, direction, depth, kinds in INTENTS:
        between = intent == "path" and "from " in low and " to " in low
        if between or any(p in low for p in phrases):
            return Plan(intent, direction, depth, kinds, contexts)
    return Plan(contexts=contexts)


def focused(tool: str, subject: str) -> Plan:
    return plan(PREFIXES[tool] + subject)


#: Words that a search of the graph leaves out.
STOP = frozenset(
    (
        "the", "and", "for", "from", "with", "this", "that", "how", "what", "where", "when", "which", "code", "flow", "path", "repo", "service",
        "explain", "show", "important", "workloads", "pieces", "auto-instrumentation", "opentelemetry", "operator", "otel",
    )
)
#: Words of one corpus that bring others along, as data: (any of these in a question, words that come first, unless a language is named).
EXPANSIONS = (
    (("instrument", "workload", "otel", "opentelemetry"), ("inject",), False),
    (("instrument", "workload", "otel", "opentelemetry"), ("injectNodeJS", "injectPython", "injectDotNet"), True),
    (("node", "javascript", "js"), ("NodeJS", "injectNodeJS"), False),
    (("python",), ("Python", "injectPython"), False),
    ((".net", "dotnet", "c#"), ("DotNet", "injectDotNet"), False),
    (("instrument", "workload", "otel", "opentelemetry"), ("sdkInjector", "InstrumentationSpec", "instrumentation"), False),
    (("webhook", "admission", "mutat"), ("webhook", "admission", "mutate"), False),
    (("controller", "reconcile"), ("controller", "Reconcile"), False),
)
RUNTIMES = ("node", "javascript", "js", "python", ".net", "dotnet", "c#", " golang", " go ")


def tokens(asked: str, most: int, expansions: tuple = EXPANSIONS) -> list[str]:
    """Words to look up: those that the question's words bring along, then its own, each once, without stop words."""
    low, out = asked.lower(), {}
    runtime = low == "go" or any(r in low for r in RUNTIMES)
    brought = [w for marks, words, alone in expansions if any(m in low for m in marks) and not (alone and runtime) for w in words]
    own = [w for w in re.findall(r"[A-Za-z0-9_.$@:/-]+", asked) if len(w) >= 3]
    for word in [*brought, *own]:
        if word.lower() not in STOP and len(out) < most:
            out.setdefault(word.lower(), word)
    return list(out.values())


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


def budget(limit: int) -> dict[str, int]:
    return {"tokens": 8, "seed_rows": clamp(limit, 1, 200), "seeds": clamp(4 * limit, 50, 200), "rows": clamp(6 * limit, 100, 500)}
