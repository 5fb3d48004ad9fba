"""From a question to the searches that an answer needs: one scan answers all of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quarry.operators.chat import PATH, SOURCE_ENDINGS, STOP

#: Marks in a question that ask for a part of the vocabulary.
INSTRUMENT, ENTRY, CONTROL = ("instrument", "workload", "otel", "opentelemetry"), ("webhook", "admission", "mutat"), ("controller", "reconcile")
NODE, PYTHON, DOTNET = ("node", "javascript", "js"), ("python",), (".net", "dotnet", "c#")
TESTS = ("test evidence", "tests", "unit test", "e2e", "integration test", "coverage", "coding harness", "touchpoint", "touchpoints", "development touchpoint")
BODIES = ("body", "bodies", "definition", "definitions", "helper", "helpers", "source")
ACROSS = ("across repo", "across these repos", "across these repositories", "cross-repo", "multi-repo", "multiple repos", "repositories", "end-to-end", "architecture", "flow")
TRACES = ("otlp", "exporttrace", "trace export", "traceservice", "collector")
#: Words of questions that name no symbol.
NO_SYMBOL = frozenset(
    """architecture between branch branches codebase compare difference explain feature files flows function implementation indexed inside lifecycle method repos repository service symbol through where which answer code exact
    inspect marker anchors avoid context focus latest lines matter only previous prior question read retrieval relevant risk starts string using tenant tools value whose with a an and are as at be by does for from how important of on show
    that the their these this to use used what when""".split()
)
#: What the vocabulary adds to a question: (marks, words, only where no runtime is named).
BROUGHT = (
    (INSTRUMENT, ("inject",), False),
    (INSTRUMENT, ("injectNodeJS", "injectPython", "injectDotNet"), True),
    (NODE, ("NodeJS", "nodejs", "injectNodeJS", "injectNodeJSSDKToContainer", "injectNodeJSSDKToPod", "nodejs_test"), False),
    (PYTHON, ("Python", "python", "injectPython", "injectPythonSDKToContainer", "python_test"), False),
    (DOTNET, ("DotNet", "dotnet", "injectDotNet", "injectDotNetSDKToContainer", "dotnet_test"), False),
    (INSTRUMENT, ("sdkInjector", "instrumentation", "Instrumentation", "InstrumentationSpec", "injectCommonSDKConfig", "injectCommonEnvVar", "validateContainerEnv", "getIndexOfEnv", "appendIfNotSet"), False),
    (ENTRY, ("webhook", "admission", "mutate", "Mutate", "Webhook"), False),
    (CONTROL, ("controller", "reconcile", "Reconcile"), False),
)
#: Searches of the vocabulary: source of what they find, all groups of marks that a question needs one of, words, paths, and most matches (at most the question's own limit where ``own``).
SEARCHES = (
    ("implementation", (INSTRUMENT,), "injectPythonSDKToContainer|injectPythonSDKToPod|injectNodeJSSDKToContainer|injectNodeJSSDKToPod|injectDotNetSDKToContainer|injectDotNetSDKToPod|pythonPlatformSrc|getDefaultPythonEnvVars|getDefaultNodeJSEnvVars|injectDotNetSDK", "", 30, True),
    ("runtime-env", (INSTRUMENT,), "envNodeOptions|NODE_OPTIONS|getDefaultNodeJSEnvVars|nodejsInstrMountPath|nodejsRequireArg", "internal/instrumentation/*.go", 16, False),
    ("runtime-env", (INSTRUMENT,), "envPythonPath|PYTHONPATH|getDefaultPythonEnvVars|pythonPlatformSrc|pythonInstrMountPath|pythonAutoInstrumentationPath", "internal/instrumentation/*.go", 16, False),
    ("runtime-env", (INSTRUMENT,), "envDotNetCoreClrEnableProfiling|envDotNetCoreClrProfiler|envDotNetCoreClrProfilerPath|envDotNetStartupHook|envDotNetOTelAutoHome|CORECLR_ENABLE_PROFILING|CORECLR_PROFILER|CORECLR_PROFILER_PATH|DOTNET_STARTUP_HOOKS|OTEL_DOTNET_AUTO_HOME", "internal/instrumentation/*.go", 16, False),
    ("webhook", ((*ENTRY, "controller"),), "NewWebhookHandler|type PodMutator|podmutation.PodMutator|instPodMutator|languageInstrumentations|func NewMutator|GetWebhookServer|mutate-v1-pod|internal/webhook/podmutation", "*.go", 40, True),
    ("annotation", ((*INSTRUMENT, "annotation"),), "annotationInjectContainerName|annotationInjectNodeJS|annotationInjectNodeJSContainersName|annotationInjectPython|annotationInjectPythonContainersName|annotationInjectDotNet|annotationInjectDotnetContainersName|instrumentation.opentelemetry.io/inject-nodejs|instrumentation.opentelemetry.io/inject-python|instrumentation.opentelemetry.io/inject-dotnet", "internal/instrumentation/*.go", 40, True),
    ("spec", (), "", "", 30, True),
    ("crd-spec", ((*INSTRUMENT, "crd", "spec"),), "type InstrumentationSpec|type NodeJS|type Python|type DotNet|NodeJS NodeJS|Python Python|DotNet DotNet|VolumeClaimTemplate|VolumeSizeLimit|InstrumentationSpec", "*.go", 40, True),
    ("otlp-flow", (TRACES,), "ExportTraceServiceRequest|TraceService|otlptracegrpc|otlptracehttp|NewExporter|ExportSpans|SpanExporter|NewTracerProvider|TracerProvider|WithEndpoint|ConsumeTraces|pdata.Traces|trace_service.proto|generated_proto_exporttraceservicerequest|receiver|exporter", "", 160, False),
    ("runtime-side", (INSTRUMENT, NODE), "NODE_OPTIONS|node_options|--require|registerInstrumentations|autoInstrumentation|instrumentation.js|opentelemetry-instrumentation", "", 16, False),
    ("runtime-side", (INSTRUMENT, PYTHON), "PYTHONPATH|sitecustomize|auto_instrumentation|opentelemetry-instrument|instrumentation.auto_instrumentation|initialize", "", 16, False),
    ("runtime-side", (INSTRUMENT, DOTNET), "DOTNET_STARTUP_HOOKS|DOTNET_ADDITIONAL_DEPS|DOTNET_SHARED_STORE|CORECLR_ENABLE_PROFILING|CORECLR_PROFILER|CORECLR_PROFILER_PATH|StartupHook|OpenTelemetry.AutoInstrumentation|OTEL_DOTNET_AUTO_HOME", "", 16, False),
)
#: Words of the runtimes that a question on instrumentation names, searched for together.
RUNTIME_SIDE = (
    (NODE, ("NODE_OPTIONS", "node_options", "--require", "registerInstrumentations", "auto-instrument", "autoInstrumentation", "instrumentation.js")),
    (PYTHON, ("PYTHONPATH", "sitecustomize", "auto_instrumentation", "opentelemetry-instrument", "initialize", "instrumentation.auto_instrumentation")),
    (DOTNET, ("DOTNET_STARTUP_HOOKS", "CORECLR_ENABLE_PROFILING", "CORECLR_PROFILER", "StartupHook", "OpenTelemetry.AutoInstrumentation", "OTEL_DOTNET_AUTO_HOME")),
)
#: Names of tests that questions on instrumentation look for first.
TEST_NAMES = ("TestInjectPythonSDK", "TestInjectNodeJSSDK", "TestInjectDotNetSDK", "TestAppendIfNotSet", "injectPythonSDK", "injectNodeJSSDK", "injectDotNetSDK")
#: Paths that a question's marks make worth more, with those of one runtime.
PREFERRED = (
    (("instrumentation", "auto-instrument", "inject", "sdk", "runtime", "webhook", "admission", "controller", "crd"), ("apis/v1alpha1/instrumentation_types.go", "apis/v1beta1/instrumentation_types.go", "config/webhook/manifests.yaml", "config/default/manager_webhook_patch.yaml", "main.go", "internal/webhook/podmutation/webhookhandler.go", "internal/instrumentation/podmutator.go", "internal/instrumentation/sdk.go", "internal/instrumentation/annotation.go")),
    (TRACES, ("pdata/internal/generated_proto_exporttraceservicerequest.go", "trace_service.proto", "otlptracegrpc", "otlptracehttp", "exporter", "receiver")),
)
#: Terms of a pattern, terms that are brought along, symbols that are looked up, and those of a compact answer.
PATTERN_TERMS, EXPANDED, SYMBOLS, COMPACT_SYMBOLS = 18, 24, 5, 3
#: Default and greatest limit, rows of a graph, depth of a path, rows of a symbol, slices chosen, read, and lines of each; the second is that of a compact answer.
LIMIT, MOST, GRAPH, DEPTH, PROBE, CHOSEN, READ, LINES = 25, 100, (25, 16), (3, 1), (16, 12), (12, 72), (12, 18), (180, 140)


def has(low: str, marks: tuple[str, ...]) -> bool:
    return any(m in low for m in marks)


def bare(term: str) -> str:
    return term.strip(".,:;()[]{}<>\"'`")


def cleaned(terms: list[str], most: int) -> list[str]:
    """Terms without what surrounds them, each once, without short ones and words that name no code."""
    out: dict[str, str] = {}
    for term in map(bare, terms):
        if len(term.encode()) >= 3 and term.lower() not in STOP:
            out.setdefault(term.lower(), term)
    return list(out.values())[:most]


def symbols(question: str, most: int) -> list[str]:
    """Words of a question that may name a symbol."""
    out: dict[str, str] = {}
    for word in re.findall(r"[A-Za-z0-9_.$@:/-]+", question):
        word = word.strip(".,:;()[]{}<>\"'")
        if "/" not in word and len(word) >= 3 and word.lower() not in NO_SYMBOL:
            out.setdefault(word.lower(), word)
    return list(out.values())[:most]


def code_terms(question: str, most: int) -> list[str]:
    """Quoted names with an underscore or dollar, and the names of files that are mentioned."""
    quoted = [q.strip() for q in re.findall(r"""["']([^"']+)["']""", question)]
    paths = [p for p in map(bare, PATH.findall(question)) if p.lower().endswith(SOURCE_ENDINGS) and ".." not in p.split("/")]
    stems = [re.sub(r"(?<=.)\.[^.]*$", "", p.rsplit("/", 1)[-1]) for p in dict.fromkeys(paths)]
    out: dict[str, str] = {}
    for term in map(bare, [*(q for q in quoted if "_" in q or "$" in q), *stems]):
        if len(term) >= 3:
            out.setdefault(term.lower(), term)
    return list(out.values())[:most]


def broad(question: str) -> str:
    return "|".join(code_terms(question, 4) or symbols(question, 8)) or question.strip() or "."


def pattern(question: str, terms: list[str], most: int = PATTERN_TERMS) -> str:
    return "|".join(cleaned([*(code_terms(question, most) if question else []), *terms], most)) or broad(question)


def expanded(question: str) -> list[str]:
    low = question.lower()
    runtime = has(low, (*NODE, *PYTHON, *DOTNET, " golang", " go ")) or low == "go"
    brought = [w for marks, words, alone in BROUGHT if has(low, marks) and not (alone and runtime) for w in words]
    return cleaned([*brought, *symbols(question, EXPANDED)], EXPANDED)


def looks_like_symbol(term: str) -> bool:
    low = term.lower()
    if len(term.encode()) < 3 or "/" in term or "-" in term or low in STOP:
        return False
    return low in ("inject", "instrumentation") or bool(re.search("[A-Z.$_]", term)) or len(term.encode()) >= 5


def probes(question: str, terms: list[str], compact: bool) -> list[str]:
    """Symbols to look up: likely names, without broad ones where there are specific ones; in a compact answer the most telling."""
    out: dict[str, str] = {}
    for term in map(bare, [*terms, *symbols(question, 2 * SYMBOLS)]):
        if looks_like_symbol(term):
            out.setdefault(term.lower(), term)
    found = list(out.values())[:SYMBOLS]
    specific = any("inject" in t.lower() and t.lower() != "inject" for t in found)
    if len(found) > 1 and specific:
        found = [t for t in found if t.lower() not in ("inject", "instrumentation")] or found
    if not compact or len(found) <= COMPACT_SYMBOLS:
        return found
    low, first = question.lower(), []
    if wants_tests(question):
        first += [s for s in ("TestInjectPythonSDK", "TestInjectNodeJS", "TestInjectDotNetSDK", "TestAppendIfNotSet") if s in found or s.lower() in low]
    if has(low, ("helper", "body", "validate", "getindex")):
        first += [s for s in ("validateContainerEnv", "getIndexOfEnv", "appendIfNotSet") if s in found or s.lower() in low]
    if has(low, INSTRUMENT):
        first += [s for s in ("injectNodeJS", "injectPython", "injectDotNet", "injectCommonSDKConfig", "sdkInjector") if s in found]
    return list(dict.fromkeys([*first, *found]))[:COMPACT_SYMBOLS]


def wants_tests(question: str) -> bool:
    return has(question.lower(), TESTS)


def preferred_paths(question: str) -> list[str]:
    low = question.lower()
    out = [p for marks, paths in PREFERRED if has(low, marks) for p in paths]
    if has(low, PREFERRED[0][0]):
        out += [f"internal/instrumentation/{name}.go" for marks, name in ((NODE, "nodejs"), (PYTHON, "python"), (DOTNET, "dotnet")) if has(low, marks)]
    return [*out, "_test.go"] if wants_tests(question) else out


@dataclass(frozen=True)
class Recall:
    """One search of a scan: what its finds are called, a pattern, which paths, and how many matches of a branch."""

    source: str
    pattern: str
    include: str
    most: int


@dataclass(frozen=True)
class Plan:
    question: str
    compact: bool
    limit: int
    terms: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    recalls: list[Recall] = field(default_factory=list)
    preferred: list[str] = field(default_factory=list)
    graph_query: str = ""
    tests: bool = False
    bodies: bool = False
    across: bool = False


def plan(question: str, limit: int = LIMIT, compact: bool = False) -> Plan:
    question = question.strip()
    if not question:
        raise ValueError("a question is needed")
    if not 0 < limit <= MOST:
        raise ValueError(f"a limit is 1 to {MOST}")
    low, terms = question.lower(), expanded(question)
    found = probes(question, terms, compact)
    wide, focused = broad(question), pattern(question, [*found, *terms])
    spec = pattern("", terms) if terms else broad("")
    taken, recalls = {wide, focused}, []
    if focused != wide:
        recalls.append(Recall("focused", focused, "", min(limit, 30)))
    for source, needs, words, include, most, own in SEARCHES:
        words = words or spec
        always = source in ("crd-spec", "runtime-side")
        if all(has(low, marks) for marks in needs) and (always or words not in taken):
            recalls.append(Recall(source, words, include, max(limit, most) if source == "otlp-flow" else min(limit, most) if own else most))
            if source == "implementation":
                taken.add(words)
    together = [w for marks, words in RUNTIME_SIDE if has(low, INSTRUMENT) and has(low, marks) for w in words]
    if together:
        recalls.append(Recall("runtime-side", "|".join(cleaned(together, EXPANDED)), "", min(limit, 40)))
    tests = wants_tests(question)
    if tests:
        names = [*(TEST_NAMES if has(low, INSTRUMENT) else ()), *terms]
        recalls.append(Recall("test", pattern("", list(names)), "*_test.go", min(limit, 30)))
    recalls.append(Recall("broad", wide, "", min(limit, 30)))
    domain = has(low, (*INSTRUMENT, *ENTRY, *CONTROL))
    graph_terms = cleaned(terms, PATTERN_TERMS)
    query = "architecture flow " + " ".join(graph_terms) if domain and graph_terms else question
    return Plan(question, compact, limit, terms, found, recalls, preferred_paths(question), query, tests, has(low, BODIES), has(low, ACROSS))
