"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(cover), "base_failed": failed}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text, out = text or "", []
    for order, (kind, pattern, valid) in enumerate(
        (
            ("email", EMAIL, lambda m: True),
            ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
            ("card", CARD, lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
            ("phone", PHONE, lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
        )
    ):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if valid(m[0])]
    n = Counter(x[3] for x in out)
    return {f"n_{k}": n[k] for k in ("email", "ip", "card", "phone")} | {"base_sha256": sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out)))}


def sets(text, k):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, k, percent=80):
    """rows: (doc_id, text) with distinct ids; gives id: (set size, component)."""
    s = {d: sets(t, k) for d, t in rows}
    parent = {d: d for d in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            A, B = s[a], s[b]
            if A and B and 100 * min(len(A), len(B)) >= percent * max(len(A), len(B)) and 100 * (n := len(A & B)) >= percent * (len(A) + len(B) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def substring(rows, k=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            first[x] = min(first.get(x, d), d)
    out = {}
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def base_scores(rows):
    import math

    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = Counter()
    for d, t in rows:
        if not held[d]:
            c.update(words(lowered(t)))
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in rows:
        tokens = [*words(lowered(t)), "\n"]
        out[d] = (held[d], len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens))
    return out


def chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out
