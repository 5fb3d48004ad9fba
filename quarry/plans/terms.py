"""Terms of a question."""

from __future__ import annotations

import re

#: Words that say nothing about code.
STOP = ("the", "and", "for", "from", "with", "this", "that", "how", "what", "where", "when", "which", "code", "flow", "path", "repo", "service")


def terms(question: str, most: int = 12) -> list[str]:
    """Identifier-like words of three characters or more, each once without regard to case."""
    out: dict[str, str] = {}
    for word in re.findall(r"[A-Za-z0-9_.$@:/-]+", question):
        if len(word) >= 3 and word.lower() not in STOP:
            out.setdefault(word.lower(), word)
    return list(out.values())[:most]
