"""Projects that an indexer can run on, from the paths of a repository alone.

Files are (repo_name, path). A file meets the folders above it, from the top ("") down,
as rows of a trie; markers, sources and roots then meet by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Language, indexer, worker class, names of marker files and endings of marker files.
LANGUAGES = (
    ("typescript", "scip-typescript", "ts-js", ("package.json", "tsconfig.json", "jsconfig.json"), ()),
    ("python", "scip-python", "python", ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile"), ()),
    ("go", "scip-go", "go", ("go.mod",), ()),
    ("java", "scip-java", "jvm", ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "build.sbt"), ()),
    ("cpp", "scip-clang", "cpp", ("compile_commands.json",), ()),
    ("dotnet", "scip-dotnet", "dotnet", (), (".sln", ".csproj", ".vbproj", ".fsproj")),
    ("ruby", "scip-ruby", "ruby", ("Gemfile",), (".gemspec",)),
    ("rust", "rust-analyzer", "rust-dart", ("Cargo.toml",), ()),
    ("dart", "dart", "rust-dart", ("pubspec.yaml",), ()),
)
#: Folders that are not looked into, endings of sources, and projects of a repository.
IGNORED = (".git", "node_modules", ".next", "dist", "build", "target", ".venv", "venv", "__pycache__", "vendor")
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
JVM_ENDINGS = (".java", ".scala", ".kt")
MOST = 50
#: Classes of workers that stand for all of them.
EVERY = ("all", "universal")


def _ends(value: Column, endings: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (value.endswith(e) for e in endings), F.lit(False))


def _steps() -> Column:
    return F.split("path", "/")


def _folder(depth: Column) -> Column:
    """The folder that the first steps of a path name; the top is empty."""
    return F.array_join(F.slice(_steps(), 1, depth), "/")


def above(files: DataFrame, most: Column | None = None) -> DataFrame:
    """repo_name, path and each folder (``root``) that a file is in, down to ``most`` steps."""
    most = F.size(_steps()) - 1 if most is None else most
    return files.filter(most >= 0).select("repo_name", "path", F.explode(F.transform(F.sequence(F.lit(0), most), _folder)).alias("root"))


def looked_into(files: DataFrame) -> DataFrame:
    return files.select("repo_name", "path").distinct().filter(~F.arrays_overlap(_steps(), F.array(*map(F.lit, IGNORED))))


def markers(files: DataFrame) -> DataFrame:
    """(repo_name, root, language) of the files that mark a project."""
    base = F.element_at(_steps(), -1)
    kinds = F.array_compact(F.array(*(F.when(base.isin(list(names)) | _ends(base, endings), language) for language, _, _, names, endings in LANGUAGES)))
    return files.select("repo_name", _folder(F.size(_steps()) - 1).alias("root"), F.explode(kinds).alias("language")).distinct()


def scripts(files: DataFrame) -> DataFrame:
    """Sources that a TypeScript indexer reads."""
    low = F.lower("path")
    return files.filter(_ends(low, SCRIPT_ENDINGS) & ~low.endswith(".d.ts") & ~low.endswith(".min.js") & ~F.col("path").rlike("(^|/)coverage/"))


def detected(files: DataFrame) -> DataFrame:
    """(repo_name, root, language, indexer, worker_class) of all projects.

    A TypeScript marker needs a source that no deeper marker has; a JVM marker needs a source in a ``src`` folder below it;
    sources below no TypeScript project make one of what stands before their first ``src``.
    """
    files = looked_into(files)
    found = markers(files)
    own = found.filter("language = 'typescript'").select("repo_name", "root")
    inputs = scripts(files)
    deepest = above(inputs).join(own, ["repo_name", "root"]).groupBy("repo_name", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    script = deepest.select("repo_name", "root").distinct()
    last_src = F.array_position(F.reverse(F.slice(F.transform(_steps(), F.lower), F.lit(1), F.size(_steps()) - 1)), "src")
    below_src = F.when(last_src > 0, F.size(_steps()) - 1 - last_src).otherwise(-1).cast("int")
    sources = above(files.filter(_ends(F.lower("path"), JVM_ENDINGS)), below_src).select("repo_name", "root")
    jvm = found.filter("language = 'java'").join(sources, ["repo_name", "root"], "left_semi").select("repo_name", "root")
    first_src = F.array_position(F.slice(_steps(), 2, F.size(_steps())), "src").cast("int")
    uncovered = inputs.join(above(inputs).join(script, ["repo_name", "root"], "left_semi").select("repo_name", "path").distinct(), ["repo_name", "path"], "left_anti")
    inferred = uncovered.select("repo_name", F.when(first_src > 0, _folder(first_src)).otherwise("").alias("root"))
    every = found.filter("language NOT IN ('typescript', 'java')")
    for rows, language in ((script.unionByName(inferred).distinct(), "typescript"), (jvm, "java")):
        every = every.unionByName(rows.withColumn("language", F.lit(language)))
    of = lambda at: F.coalesce(*(F.when(F.col("language") == row[0], row[at]) for row in LANGUAGES))
    return every.withColumns({"indexer": of(1), "worker_class": of(2)})


def planned(projects: DataFrame, workers: str = "all", most: int = MOST) -> DataFrame:
    """Projects in order of root and language, those whose worker class runs apart from those that are skipped, ``most`` of each in a repository."""
    allowed = {w.strip() for w in workers.split(",") if w.strip()} or {"all"}
    runs = F.lit(False) if "none" in allowed else F.lit(True) if allowed & set(EVERY) else F.col("worker_class").isin(*allowed)
    place = F.row_number().over(Window.partitionBy("repo_name", "runnable").orderBy("root", "language"))
    return projects.withColumn("runnable", runs).withColumn("place", place).filter(F.col("place") <= (most if most > 0 else MOST))
