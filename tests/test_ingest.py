"""Compiled symbol indexes: the wire format, rows, sweeps and projects."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import ingest, projects, scip
from quarry.sources import artifact

CREATE, HANDLER, PROMISE = "ts npm app 1.0.0 src/orders/create.ts/create().", "ts npm app 1.0.0 src/routes/handler.ts/handler().", "ts npm typescript 5.0.0 lib/es5.d.ts/Promise#"


def index():
    return {
        "documents": [
            {
                "language": "typescript", "relative_path": "src/orders/create.ts",
                "occurrences": [{"range": [0, 22, 33], "symbol": CREATE, "symbol_roles": 1, "syntax_kind": 16, "enclosing_range": [0, 0, 2, 1]}],
                "symbols": [{"symbol": CREATE, "documentation": ["Makes an order."], "kind": 17, "display_name": "create", "signature": {"text": "function create()"}}],
            },
            {
                "relative_path": "./src/routes/handler.ts",
                "occurrences": [
                    {"range": [1, 22, 29], "symbol": HANDLER, "symbol_roles": 1, "syntax_kind": 16, "enclosing_range": [1, 0, 3, 1]}, {"range": [2, 9, 20], "symbol": CREATE, "symbol_roles": 8, "syntax_kind": 15},
                    {"range": [0, 9, 20], "symbol": CREATE, "symbol_roles": 2, "syntax_kind": 6}, {"range": [0, 9], "symbol": CREATE}, {"range": [9, 0, 1], "symbol": ""}, {"range": [2, 0, 3, 0], "symbol": "local 3"},
                ],
                "symbols": [{"symbol": HANDLER, "kind": 17, "relationships": [{"symbol": CREATE, "is_reference": True}, {"symbol": CREATE, "is_implementation": True}, {"symbol": PROMISE, "is_reference": True}]}],
            },
            {"relative_path": "../outside.ts", "symbols": [{"symbol": "leak"}], "occurrences": [{"range": [0, 0, 4], "symbol": "leak", "symbol_roles": 1}]},
        ],
        "external_symbols": [{"symbol": PROMISE, "documentation": ["External."], "kind": 7}],
    }


@pytest.fixture(scope="module")
def docs(spark):
    artifacts = spark.createDataFrame([(1, bytearray(artifact.write("index", index())))], "id long, content binary")
    projects_ = spark.createDataFrame([(1, "javascript", " app/. ")], "id long, project_language string, project_root string")
    return ingest.placed(artifact.documents(artifacts), projects_).cache()


def test_wire_format():
    raw = artifact.write("index", index())
    again = artifact.read("index", raw)
    assert artifact.write("index", again) == raw and again["documents"][1]["occurrences"][5]["range"] == [2, 0, 3, 0]
    assert artifact.read("occurrence", bytes([0x18, 0xFF, 0xFF, 0xFF, 0xFF, 0x0F]))["symbol_roles"] == -1
    assert artifact.read("occurrence", bytes([0x08, 5, 0x08, 7]))["range"] == [5, 7]  # not packed
    assert artifact.read("relationship", bytes([0x7D, 1, 2, 3, 4, 0x79, 1, 2, 3, 4, 5, 6, 7, 8, 0x10, 1]))["is_reference"] is True  # unknown fields
    for bad in (raw[:-1], b"\x0b", b"\x12\xff", b"\x80" * 11):
        with pytest.raises(ValueError):
            artifact.read("index", bad)


def test_messages_of_a_batch_are_written_and_read_as_one_by_one():
    kinds = artifact._types()
    symbol = pa.struct([f if f.name != "signature" else pa.field("signature", pa.struct([("text", pa.string())])) for f in kinds.field("symbols").type.value_type])
    document = pa.struct([("relative_path", pa.string()), ("occurrences", kinds.field("occurrences").type), ("symbols", pa.list_(symbol)), ("language", pa.string())])
    odd = {"documents": [{"relative_path": "é" * 90, "occurrences": [{"range": [-1, 0, 300], "symbol": "x" * 200, "symbol_roles": 1 << 30}] * n, "symbols": []} for n in (0, 1, 70)] * 40, "external_symbols": []}
    every = [index(), odd, {"documents": [], "external_symbols": []}, {"documents": [{}], "external_symbols": [{"symbol": ""}]}] * 30
    raw = [artifact.write("index", x) for x in every]
    whole = [artifact.read("index", r) for r in raw]
    assert artifact.written("index", pa.array(whole, pa.struct([("documents", pa.list_(document)), ("external_symbols", pa.list_(symbol))]))).to_pylist() == raw
    ends = np.cumsum([len(r) for r in raw])
    got = artifact.decoded("index", np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw]), ends)
    assert got.to_pylist() == whole
    for bad in (raw[0][:-1], b"\x0b", b"\x12\xff", b"\x80" * 11):
        for n in (1, 200):
            with pytest.raises(ValueError):
                artifact.decoded("index", np.frombuffer(bad * n, np.uint8), np.arange(n) * len(bad), np.arange(1, n + 1) * len(bad))


def test_an_empty_artifact_is_an_error(spark):
    with pytest.raises(PythonException, match="an empty artifact"):
        artifact.documents(spark.createDataFrame([(1, bytearray())], "id long, content binary")).collect()


def test_symbols(docs):
    got = {r.symbol: r for r in ingest.symbols(docs).collect()}
    assert set(got) == {CREATE, HANDLER, PROMISE}
    assert (got[CREATE].display_name, got[CREATE].kind, got[CREATE].file_path, got[CREATE].signature, got[CREATE].start_line, got[CREATE].end_col) == ("create", "Function", "app/src/orders/create.ts", "function create()", 0, 33)
    assert (got[PROMISE].display_name, got[PROMISE].kind, got[PROMISE].file_path, got[PROMISE].language) == ("Promise", "Class", None, "javascript")
    assert got[HANDLER].display_name == "handler" and got[HANDLER].language == "javascript"


def test_occurrences_and_lines(spark, docs):
    files = spark.createDataFrame([(1, "app/src/routes/handler.ts", "import { create }\r\nexport\n  return create();\n"), (1, "app/src/orders/create.ts", "x" * 1999 + "éé")], "id long, file_path string, content string")
    got = {(r.symbol, r.role, r.start_line): (r.enclosing, r.line_content, r.syntax_kind) for r in ingest.with_lines(ingest.occurrences(docs), files).collect()}
    assert got == {
        (CREATE, "DEFINITION", 0): (None, "x" * 1999 + "...", "IdentifierFunctionDefinition"), (HANDLER, "DEFINITION", 1): (None, "export", "IdentifierFunctionDefinition"),
        (CREATE, "REFERENCE", 2): (HANDLER, "  return create();", "IdentifierFunction"), (CREATE, "READ", 2): (HANDLER, "  return create();", "IdentifierFunction"),
        (CREATE, "REFERENCE", 0): (None, "import { create }", "Identifier"), (CREATE, "IMPORT", 0): (None, "import { create }", "Identifier"), ("local 3", "REFERENCE", 2): (HANDLER, "  return create();", None),
    }


def test_relationships(docs):
    got = [(r.source, r.target, r.is_reference, r.is_implementation) for r in ingest.first_seen(ingest.relationships(docs, ingest.occurrences(docs))).orderBy("place").collect()]
    assert got == [(HANDLER, CREATE, True, False), (HANDLER, CREATE, False, True)]


def test_paths_and_symbols(spark):
    paths = {"a/./b//c": "a/b/c", ".": "", "": "", "/a": None, "a/../b": None, "C:/x": None, "a\\b": None, " a ": "a"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ingest.inside(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in rows} == paths
    said = {"local 1": False, "a().(x)": False, "a 7:": False, "`f.ts` /": False, "`f.ts`/": False, "pkg/": False, "pkg/A#": True}
    rows = spark.createDataFrame([(p,) for p in said], "p string").select("p", ingest.semantic(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in rows} == said


def smallest(definitions, symbol, at):
    inside = [d for d in definitions if d[1] != symbol and d[2][:2] <= at[:2] and d[2][2:] >= at[2:]]
    span = lambda p: (p[2] - p[0]) * 100_000 + max(p[3] - p[1], 0)
    return min(inside, key=lambda d: (span(d[2]), d[0]))[1] if inside else None


@pytest.mark.parametrize("stretch", (7, 8192))
def test_sweep_against_all_pairs(spark, monkeypatch, stretch):
    monkeypatch.setattr(scip, "STRETCH", stretch)
    r = random.Random(stretch)
    place = lambda span: (a := r.randint(0, 60), b := r.randint(0, 5), c := a + r.randint(0, span), r.randint(0 if c > a else b, 9))
    definitions = [(i, f"s{r.randint(0, 9)}", place(30)) for i in range(80)]
    found = [(i, f"s{r.randint(0, 9)}", place(2)) for i in range(300)]
    frame = lambda rows: spark.createDataFrame([("f", n, s, *p) for n, s, p in rows], "file string, n int, symbol string, start_line int, start_col int, end_line int, end_col int").repartition(3)
    got = {x.n: x.enclosing for x in scip.swept(frame(found), frame(definitions), ["file"], ["n"], ["n"]).collect()}
    assert got == {n: smallest(definitions, s, p) for n, s, p in found}
    assert {x.n for x in scip.enclosed(frame(found), frame(definitions), ["file"], ["n"], ["n"]).collect()} == {n for n, x in got.items() if x}


def test_a_file_of_many_occurrences(spark):
    """All pairs of this file would be ten billion."""
    n = 100_000
    found = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("n"), F.lit("use").alias("symbol"), F.col("id").cast("int").alias("start_line"), F.lit(0).alias("start_col"), F.col("id").cast("int").alias("end_line"), F.lit(1).alias("end_col"))
    definitions = found.withColumns({"symbol": F.concat(F.lit("d"), F.col("n").cast("string")), "end_line": F.col("end_line") + 3})
    got = scip.swept(found, definitions, ["file"], ["n"], ["n"])
    assert got.filter("enclosing = concat('d', n) OR enclosing LIKE 'd%'").count() == n


def test_projects(spark):
    def found(paths, workers="all", most=50):
        files = spark.createDataFrame([("r", p) for p in paths], "repo_name string, path string")
        rows = projects.planned(projects.detected(files), workers, most).orderBy("root", "language").collect()
        return [f"{r.root}:{r.language}:{r.indexer}:{r.worker_class}" for r in rows if r.runnable], [f"{r.root}:{r.language}" for r in rows if not r.runnable]

    many = ["package.json", "src/index.ts", "services/api/go.mod", "python/requirements.txt", "java/pom.xml", "java/src/main/java/App.java", "native/compile_commands.json", "dotnet/app.csproj", "ruby/foo.gemspec", "ruby/Gemfile", "rust/Cargo.toml", "dart/pubspec.yaml", "node_modules/pkg/package.json", "dist/generated/package.json", "vendor/lib/go.mod"]
    assert found(many)[0] == [
        ":typescript:scip-typescript:ts-js", "dart:dart:dart:rust-dart", "dotnet:dotnet:scip-dotnet:dotnet", "java:java:scip-java:jvm", "native:cpp:scip-clang:cpp",
        "python:python:scip-python:python", "ruby:ruby:scip-ruby:ruby", "rust:rust:rust-analyzer:rust-dart", "services/api:go:scip-go:go",
    ]
    inferred = found(["apps/web/src/app.ts", "apps/admin/src/app.jsx", "coverage/ignored.ts", "src/global.d.ts", "src/vendor.min.js"], "ts-js", 10)
    assert inferred[0] == ["apps/admin:typescript:scip-typescript:ts-js", "apps/web:typescript:scip-typescript:ts-js"]
    some = ["one/go.mod", "two/go.mod", "three/requirements.txt", "four/package.json", "four/src/app.ts"]
    assert [x.split(":")[0] for x in found(some, "go,python", 2)[0]] == ["one", "three"]
    assert found(some, "none")[0] == [] and len(found(some, "none")[1]) == 4
    assert found(["go.mod", "package.json", "src/index.ts", "service/requirements.txt"], "go")[1] == [":typescript", "service:python"]
    tools = ["package.json", "auto/nodejs/package.json", "auto/nodejs/tsconfig.json", "auto/nodejs/Dockerfile", ".github/triage/requirements.txt", ".github/triage/triage.py"]
    assert [x.split(":")[0] for x in found(tools)[0]] == [".github/triage"]
    nested = ["e2e/package.json", "e2e/web/package.json", "e2e/web/src/app.ts", "e2e/api/tsconfig.json", "e2e/api/src/server.ts"]
    assert [x.split(":")[0] for x in found(nested, "ts-js")[0]] == ["e2e/api", "e2e/web"]
    jvm = ["tests/java/build.gradle", "tests/java/Demo.java", "real/build.gradle", "real/src/main/java/App.java"]
    assert [x.split(":")[0] for x in found(jvm, "jvm")[0]] == ["real"]
    assert found(["src/src/a.ts", "src/b.ts"], "ts-js")[0] == [":typescript:scip-typescript:ts-js", "src:typescript:scip-typescript:ts-js"]


def test_in_place_as_by_way_of_others(spark, monkeypatch):
    """Documents of one path count as one file, though an index leaves in several batches; nothing moves until relationships meet."""
    monkeypatch.setattr(artifact, "TOGETHER", 64)
    r = random.Random(5)
    place = lambda: [a := r.randint(0, 30), r.randint(0, 5), a + r.randint(0, 9), r.randint(6, 9)]
    names = [f"pkg {c}#" for c in "abcdefgh"] + ["local 1", ""]

    def document(path):
        used = [{"range": r.choice([place(), [1, 2], []]), "symbol": r.choice(names), "symbol_roles": r.choice([0, 1, 2, 8, 64]), "enclosing_range": r.choice([[], place()])} for _ in range(40)]
        told = [{"symbol": s, "relationships": [{"symbol": r.choice(names), "is_reference": r.random() < 0.5} for _ in range(2)]} for s in r.sample(names, 5)]
        return {"relative_path": path, "occurrences": used, "symbols": told}

    def index():
        return {"documents": [document(p) for p in ("a//b.ts", "c.ts", "a/./b.ts", "../x.ts", "a/b.ts")], "external_symbols": [{"symbol": names[0], "relationships": [{"symbol": names[1], "is_definition": True}]}]}

    rows = spark.createDataFrame([(i, bytearray(artifact.write("index", index())), "go", "p") for i in range(6)], "id long, content binary, project_language string, project_root string").repartition(3)
    docs = ingest.placed(artifact.documents(rows))
    apart = ingest.placed(artifact.documents(rows.select("id", "content")), rows.select("id", "project_language", "project_root")).cache()
    # of equal spans in equal places the first counts, so both ways agree to the row
    found, plain = ingest.occurrences(docs, whole=True), ingest.occurrences(apart)
    assert sorted(map(repr, found.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    related, other = ingest.relationships(docs), ingest.relationships(apart, plain)
    assert related.count() > 0 and sorted(map(repr, related.collect())) == sorted(map(repr, other.collect()))


@pytest.mark.parametrize("name,moves", [("artifact_occurrences", 0), ("artifact_relationships", 1)])
def test_artifacts_and_their_rows_stay(spark, name, moves):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "MapInArrow" in line]  # written, read, swept
    assert len(at) == 3 and sum("Exchange" in line for line in plan[: at[-1]]) == moves
