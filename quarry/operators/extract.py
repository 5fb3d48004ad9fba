"""Facts from source text: imports, definitions, bases and calls, by line rules of each language.

A language is a row of ``LANGUAGES``: what its lines may say, how far a function reaches, and whose calls count. One
scanner reads all of them. Its state (the open function, the depth of braces) runs from line to line, so it is Python
over Arrow batches of files; files are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = "path string, ordinal int, language string, kind string, source string, source_name string, source_kind string, target string, target_name string, target_kind string, line int, confidence double"
#: The confidence of facts by line rules, and the bytes of a callee that are kept.
CONFIDENCE, CALLEE_BYTES = 0.6, 120
#: Names that are never calls, by language.
KEYWORDS = {
    "go": frozenset(("if", "for", "switch", "case", "select", "return", "go", "defer", "func", "type", "package", "import", "var", "const", "range", "chan", "make", "new", "len", "cap", "append", "panic", "recover", "fmt", "context", "errors", "string", "int", "bool")),
    "python": frozenset(("if", "elif", "else", "for", "while", "return", "yield", "def", "class", "import", "from", "as", "with", "try", "except", "finally", "raise", "lambda", "print", "len", "range", "list", "dict", "set", "tuple", "str", "int", "float", "bool", "None", "True", "False", "self")),
    "java": frozenset(("if", "else", "for", "while", "switch", "case", "return", "new", "this", "super", "class", "interface", "extends", "implements", "import", "package", "public", "private", "protected", "static", "final", "void", "int", "String", "boolean", "long", "double", "float", "char", "byte", "short")),
    "ruby": frozenset(("if", "elsif", "else", "unless", "case", "when", "for", "while", "until", "return", "yield", "def", "class", "module", "require", "include", "extend", "self", "super", "nil", "true", "false", "puts", "print", "raise", "rescue", "begin", "end")),
    "csharp": frozenset(("if", "else", "for", "while", "switch", "case", "return", "new", "this", "base", "class", "interface", "struct", "enum", "namespace", "using", "public", "private", "protected", "internal", "static", "void", "int", "string", "bool", "var", "throw", "try", "catch", "finally")),
    "rust": frozenset(("if", "else", "match", "for", "while", "loop", "return", "let", "fn", "struct", "enum", "trait", "impl", "use", "mod", "pub", "self", "Self", "Box", "Vec", "Option", "Result", "Some", "None", "Ok", "Err", "i32", "u32", "u64", "i64", "bool", "str", "String")),
    "dart": frozenset(("if", "else", "for", "while", "switch", "case", "return", "new", "this", "super", "class", "interface", "extends", "implements", "import", "library", "part", "void", "int", "String", "bool", "double", "var", "final", "const", "static")),
    "typescript": frozenset(("if", "else", "for", "while", "switch", "case", "return", "new", "this", "super", "class", "interface", "type", "enum", "extends", "implements", "import", "export", "from", "async", "await", "function", "const", "let", "var", "public", "private", "protected", "static", "string", "number", "boolean", "undefined", "null", "Promise", "Array", "Object", "console", "require")),
    "javascript": frozenset(("if", "else", "for", "while", "switch", "case", "return", "new", "this", "super", "class", "extends", "import", "export", "from", "async", "await", "function", "const", "let", "var", "undefined", "null", "Promise", "Array", "Object", "console", "require")),
}

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
DOTTED, COLONED = rf"{NAME}(?:\.{NAME})*", rf"{NAME}(?:::{NAME})*"


def _rule(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


@dataclass(frozen=True)
class Language:
    """What a language's lines say. Patterns name their groups: ``target``; ``name``, ``base``, ``faces``.

    reach: how a function ends (braces, indent, end), or ``file`` where calls belong to the module. only: whether a line
    that names an import, and one that names a type, says nothing else. whole: a callee is held against the keywords as
    a whole, else by its head. first: functions are looked for before types.
    """

    imports: re.Pattern
    types: re.Pattern | None = None
    functions: re.Pattern | None = None
    methods: re.Pattern | None = None
    reach: str = "file"
    calls: re.Pattern = _rule(rf"\b({DOTTED})\s*\(")
    only: tuple[bool, bool] = (True, True)
    whole: bool = False
    first: bool = False
    face: str = ""


WORDS = r"(?:{0})"
LANGUAGES = {
    "go": Language(_rule(r"(?!)"), functions=_rule(rf"^\s*func\s+(?:\([^)]+\)\s*)?(?P<name>{NAME})\s*\("), reach="braces", whole=True, first=True),
    "python": Language(
        _rule(rf"^\s*(?:from\s+(?P<target>[A-Za-z_][A-Za-z0-9_.]*)\s+import\s+(?P<names>[A-Za-z_,\s]+)|import\s+(?P<other>[A-Za-z_][A-Za-z0-9_.]*))"),
        _rule(rf"^(\s*)class\s+(?P<name>{NAME})\s*(?:\((?P<base>[^)]*)\))?"), _rule(rf"^(?P<indent>\s*)(?:async\s+)?def\s+(?P<name>{NAME})\s*\("), reach="indent", whole=True, first=True,
    ),
    "java": Language(
        _rule(r"^\s*import\s+(?:static\s+)?(?P<target>[A-Za-z_][A-Za-z0-9_.]*)\s*;"),
        _rule(rf"\b(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface)\s+(?P<name>{NAME})(?:\s+extends\s+(?P<base>[A-Za-z_][A-Za-z0-9_.<>]*))?(?:\s+implements\s+(?P<faces>[A-Za-z_][A-Za-z0-9_.<>,\s]+?))?\s*\{{"),
        methods=_rule(rf"\b(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[A-Za-z_<>\[\]?]+\s+(?P<name>{NAME})\s*\([^)]*\)\s*(?:throws\s+[A-Za-z_,\s.]+)?\s*\{{?"),
        only=(False, False), face="interface",
    ),
    "ruby": Language(
        _rule(r"""^\s*require(?:_relative)?\s+["'](?P<target>[^"']+)["']"""), _rule(rf"^\s*class\s+(?P<name>{NAME})(?:\s*<\s*(?P<base>[A-Za-z_][A-Za-z0-9_:]*))?"),
        _rule(r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_][A-Za-z0-9_!?=]*)"), reach="end",
    ),
    "csharp": Language(
        _rule(r"^\s*using\s+(?:static\s+)?(?P<target>[A-Za-z_][A-Za-z0-9_.]*)\s*;"),
        _rule(rf"\b(?:public|private|protected|internal|abstract|sealed|static)\s+(?:[A-Za-z_]+\s+)*(?:class|interface|struct|record)\s+(?P<name>{NAME})(?:\s*:\s*(?P<base>[A-Za-z_][A-Za-z0-9_,<>\s.]*))?"),
        only=(False, False),
    ),
    "rust": Language(
        _rule(r"^\s*use\s+(?P<target>[A-Za-z_][A-Za-z0-9_:]*)(?:\s*::\s*\{[^}]*\})?\s*;"), _rule(rf"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(?P<name>{NAME})"),
        _rule(rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<name>{NAME})\s*[<(]"), reach="braces", calls=_rule(rf"\b({COLONED})\s*\("), only=(True, False), first=True,
    ),
    "dart": Language(
        _rule(r"""^\s*import\s+['"](?P<target>[^'"]+)['"]"""),
        _rule(rf"^\s*(?:abstract\s+)?class\s+(?P<name>{NAME})(?:\s+extends\s+(?P<base>[A-Za-z_][A-Za-z0-9_<>]*))?(?:\s+implements\s+[A-Za-z_][A-Za-z0-9_<>,\s]*)?"),
        only=(True, False),
    ),
    # an approximation by lines, as there is no parser of it here
    "typescript": Language(
        _rule(r"""^\s*(?:import\b.*?|export\b.*?\bfrom\s+)['"](?P<target>[^'"]+)['"]"""),
        _rule(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{NAME})(?:\s+extends\s+(?P<base>[A-Za-z_][A-Za-z0-9_.<>]*))?(?:\s+implements\s+(?P<faces>[A-Za-z_][A-Za-z0-9_.<>,\s]*))?"),
        _rule(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})\s*[<(]"), reach="braces", face="interface", first=True,
    ),
}
LANGUAGES["javascript"] = LANGUAGES["typescript"]
#: Extractors by what manifests call a language, and by extension where that is finer.
BY_EXTENSION = {".go": "go", ".py": "python", ".java": "java", ".rb": "ruby", ".cs": "csharp", ".rs": "rust", ".dart": "dart", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
GO_IMPORT = _rule(r'(?m)^\s*import\s+(?:"([^"]+)"|(?:\(\s*([^)]+?)\s*\)))')
BASE, SYMBOL = _rule(r"[A-Za-z_][A-Za-z0-9_.:]*"), _rule(NAME)


def callee_of(text: str) -> str | None:
    """A callee in one line; None if it holds quotes or nothing, cut at whole characters if it is long."""
    flat = " ".join(text.split())
    if not flat or any(q in flat for q in "\"'`"):
        return None
    raw = flat.encode()
    return flat if len(raw) <= CALLEE_BYTES else raw[:CALLEE_BYTES].decode("utf-8", "ignore") + "..."


class Scan:
    """The facts of one file, in order of the lines and rules that state them."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.lines = path, language, text.split("\n")
        self.text, self.rules, self.words = text, LANGUAGES[language], KEYWORDS[language]
        self.module = (f"module:{path}", path, "module")
        self.found: list[tuple] = []

    def say(self, kind: str, source: tuple[str, str, str], target: tuple[str, str, str], line: int) -> None:
        self.found.append((kind, *source, *target, line))

    def import_(self, name: str, line: int) -> None:
        self.say("imports_from", self.module, (f"module:{name}", name, "module" if name.startswith(".") else "external"), line)

    def function(self, name: str) -> tuple[str, str, str]:
        return f"function:{self.path}:{name}", name, "function"

    def type_(self, m: re.Match, line: int) -> tuple[str, str, str]:
        """A type with what it is based on."""
        own = (f"class:{self.path}:{m['name']}", m["name"], "class")
        self.say("defines", self.module, own, line)
        groups = m.groupdict()
        for kind, group, what in (("extends", "base", "class"), ("implements", "faces", self.rules.face)):
            for one in (groups.get(group) or "").split(","):
                one = one.split("<")[0].strip()
                if BASE.fullmatch(one):
                    self.say(kind, own, (f"{what}:?:{one}", one, what), line)
        return own

    def calls(self, text: str, by: tuple[str, str, str], line: int) -> None:
        for m in self.rules.calls.finditer(text):
            name = callee_of(m[1])
            if name and name != (by[1] if by is not self.module else None) and (name if self.rules.whole else re.split(r"\.|::", name)[0]) not in self.words:
                self.say("calls", by, (f"function:?:{name}", name, "function"), line)

    def names(self, m: re.Match, line: int) -> None:
        groups = m.groupdict()
        of = groups.get("target") or groups.get("other")
        self.import_(of, line)
        for one in (groups.get("names") or "").split(","):
            one = re.split(r"\s+as\s+", one.strip())[0]
            if SYMBOL.fullmatch(one):
                self.say("imports_from", self.module, (f"symbol:{of}:{one}", f"{of}.{one}", "symbol"), line)

    def run(self) -> list[tuple]:
        r = self.rules
        if self.language == "go" and (m := GO_IMPORT.search(self.text)):
            for name in [m[1]] if m[1] else chain.from_iterable(re.findall(r'"([^"]+)"', x)[:1] for x in m[2].split("\n")):
                self.import_(name, 1)
        if r.methods is not None:
            self.nested()
        else:
            self.flat()
        return self.found

    def flat(self) -> None:
        """Languages whose functions stand by themselves, and those without any that are looked for."""
        r, open_, depth, indent = self.rules, None, 0, 0
        for n, line in enumerate(self.lines, 1):
            if m := r.imports.search(line):
                self.names(m, n)
                if r.only[0]:
                    continue
            function, type_ = (r.functions.search(line) if r.functions else None), (r.types.search(line) if r.types else None)
            if function and (r.first or not type_):
                open_, indent = self.function(function["name"]), len(function.groupdict().get("indent") or "")
                depth = line.count("{") - line.count("}")
                self.say("defines", self.module, open_, n)
                continue
            if type_:
                self.type_(type_, n)
                if r.only[1]:
                    continue
            if r.reach == "file":
                self.calls(line, self.module, n)
                continue
            if r.reach == "end" and re.match(r"\s*end\b", line):
                open_ = None
            if open_ is None or (r.reach == "indent" and line.strip() and len(line) - len(line.lstrip()) <= indent):
                open_ = None
                continue
            depth += line.count("{") - line.count("}")
            self.calls(line, open_, n)
            if r.reach == "braces" and depth <= 0:
                open_, depth = None, 0

    def nested(self) -> None:
        """Languages whose functions are methods of the type around them, and whose calls are the module's: three passes."""
        r, inside, outer, depth = self.rules, None, 0, 0
        for n, line in enumerate(self.lines, 1):
            if m := r.imports.search(line):
                self.names(m, n)
        for n, line in enumerate(self.lines, 1):
            if m := r.types.search(line):
                inside, outer = self.type_(m, n), depth
            m = r.methods.search(line)
            if m and inside and not re.search(r"(class|interface)\s+", line) and m["name"] not in self.words:
                self.say("defines", (inside[0], inside[1], "module"), (f"{inside[0]}#{m['name']}", m["name"], "method"), n)
            depth += line.count("{") - line.count("}")
            if inside and depth <= outer:
                inside = None
        for n, line in enumerate(self.lines, 1):
            self.calls(line, self.module, n)


def facts_of(path: str, language: str, text: str) -> Iterator[tuple]:
    """Rows of FACTS for one file."""
    if language in LANGUAGES:
        for i, (kind, *rest, line) in enumerate(Scan(path, language, text).run()):
            yield path, i, language, kind, *rest, line, CONFIDENCE


def facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in FACTS.split(", ")]
        for batch in batches:
            rows = [f for p, lang, t in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True) if t and lang for f in facts_of(p, lang, t)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "language", "content").mapInArrow(run, FACTS)
