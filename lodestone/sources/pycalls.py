"""Calls in Python sources: files are parsed by executors, calls are resolved by joins.

Definitions are functions of a module and methods of its classes. A call is resolved where its name is a function of
the module, a name it imports, a method of its own class through self or cls, or a function of a module it imports
by an alias; everything else is left out.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical_id
from ..operators.ordinals import numbered
from .contract import Cohort, Normalized, Provider, evidence_of

# Folders that hold no sources of the project.
EXCLUDED = {".git", "__pycache__", ".venv", "venv", ".tox", "build", "dist", ".eggs", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache"}
FACTS = "kind string, path string, module string, owner string, name string, target string, base_type string, lines array<int>"


def source_files(root: str) -> list[str]:
    """Paths of .py files, without excluded folders and virtual environments."""
    found = []
    for at, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in EXCLUDED and not os.path.isfile(os.path.join(at, f, "pyvenv.cfg")))
        found += [os.path.relpath(os.path.join(at, f), root).replace(os.sep, "/") for f in files if f.endswith(".py")]
    return sorted(found)


def module_of(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def module_keys(path: str) -> list[str]:
    """Names under which a file can be imported: from the root, and without a leading src."""
    whole = module_of(path)
    return [whole, whole.removeprefix("src.")] if whole.startswith("src.") else [whole]


def absolute(module: str, level: int, name: str | None) -> str | None:
    """The module that a relative import names; None above the root."""
    package = module.split(".")[:-1]
    if level - 1 > len(package):
        return None
    return ".".join([*package[: len(package) - (level - 1)], *(name.split(".") if name else ())]) or None


def own_calls(node: ast.AST) -> Iterator[ast.Call]:
    """Calls in a body, without those of functions and classes defined in it."""
    stack = list(ast.iter_child_nodes(node))
    while stack:
        n = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
            continue
        if isinstance(n, ast.Call):
            yield n
        stack += ast.iter_child_nodes(n)


def facts_of(path: str, source: str) -> list[tuple]:
    """Rows of FACTS: definitions, imports and calls of a file; none where it cannot be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    module, out = module_of(path), []
    scopes = [(None, s) for s in tree.body] + [(c.name, s) for c in tree.body if isinstance(c, ast.ClassDef) for s in c.body]
    for owner, s in scopes:
        if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        out.append(("def", path, module, owner, s.name, None, "METHOD" if owner else "FUNCTION", [s.lineno - 1, (s.end_lineno or s.lineno) - 1, s.col_offset, s.end_col_offset or 0]))
        caller = f"{owner}.{s.name}" if owner else s.name
        for body in s.body:
            if isinstance(body, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            for call in [*([body] if isinstance(body, ast.Call) else []), *own_calls(body)]:
                f = call.func
                if isinstance(f, ast.Name):
                    out.append(("call", path, module, caller, f.id, None, None, None))
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    if f.value.id in ("self", "cls") and owner:
                        out.append(("self", path, module, caller, f.attr, owner, None, None))
                    else:
                        out.append(("attribute", path, module, caller, f.attr, f.value.id, None, None))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("alias", path, module, None, a.asname, a.name, None, None) for a in node.names if a.asname]
        elif isinstance(node, ast.ImportFrom):
            origin = absolute(module, node.level, node.module) if node.level else node.module
            out += [("from", path, module, origin, a.asname or a.name, a.name, None, None) for a in node.names if origin and a.name != "*"]
    return out


def parse(files: DataFrame) -> DataFrame:
    """FACTS of files (path, source)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        for batch in batches:
            for path, source in zip(batch["path"], batch["source"], strict=True):
                rows = facts_of(path, source)
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, FACTS)


def resolve(facts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (qualified_name, path, name, base_type, lines) and calls (caller, callee), each pair once.

    keys: module, path of every parsed file. A later definition of a name replaces an earlier one.
    """
    last = Window.partitionBy("path", "owner", "name").orderBy(F.desc(F.col("lines")[0]))
    defs = facts.where("kind = 'def'").withColumn("r", F.row_number().over(last)).where("r = 1")
    local = F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    defs = defs.select("path", "owner", "name", "base_type", "lines", F.concat(F.col("path"), F.lit("::"), local).alias("qualified_name"))
    functions = defs.where("owner IS NULL")
    by_module = keys.join(functions, "path").select("module", F.col("name").alias("function"), F.col("qualified_name").alias("callee"))
    bound = Window.partitionBy("path", "name").orderBy(F.desc("target"), F.desc("owner"))
    named = facts.where("kind = 'from'").withColumn("submodule", F.concat_ws(".", "owner", "target"))
    named = named.join(keys.select(F.col("module").alias("submodule")).distinct().withColumn("is_module", F.lit(True)), "submodule", "left")
    names = named.where("is_module IS NULL").withColumn("r", F.row_number().over(bound)).where("r = 1").select("path", F.col("name").alias("bound"), F.col("owner").alias("module"), F.col("target").alias("function"))
    aliases = named.where("is_module").select("path", "name", F.col("submodule").alias("module")).unionByName(facts.where("kind = 'alias'").select("path", "name", F.col("target").alias("module"))).distinct()
    calls = facts.withColumn("caller", F.concat(F.col("path"), F.lit("::"), F.col("owner")))
    bare = calls.where("kind = 'call'").select("path", "caller", "name").distinct()
    own = bare.join(functions.select("path", "name", F.col("qualified_name").alias("callee")), ["path", "name"], "left")
    here = own.where("callee IS NOT NULL").select("caller", "callee")
    there = own.where("callee IS NULL").drop("callee").withColumnRenamed("name", "bound").join(names, ["path", "bound"]).join(by_module, ["module", "function"]).select("caller", "callee")
    methods = defs.where("owner IS NOT NULL").select("path", F.col("owner").alias("target"), "name", F.col("qualified_name").alias("callee"))
    itself = calls.where("kind = 'self'").select("path", "caller", "target", "name").join(methods, ["path", "target", "name"]).select("caller", "callee")
    through = calls.where("kind = 'attribute'").select("path", "caller", F.col("target").alias("alias"), F.col("name").alias("function")).distinct()
    through = through.join(aliases.withColumnRenamed("name", "alias"), ["path", "alias"]).join(by_module, ["module", "function"]).select("caller", "callee")
    return defs, here.unionByName(there).unionByName(itself).unionByName(through).distinct()


class PythonCallsProvider(Provider):
    name, capabilities = "python_calls", ("CALL_RELATIONSHIP", "SOURCE_LOCATION")

    def extract(self, spark: SparkSession, repository, capabilities):
        rows = []
        for path in source_files(repository.path):
            try:
                rows.append((path, (Path(repository.path) / path).read_text(encoding="utf-8")))
            except (OSError, UnicodeDecodeError):
                continue  # one unreadable file leaves the others alone
        files = spark.createDataFrame(rows, "path string, source string")
        keys = spark.createDataFrame([(m, p) for p, _ in rows for m in module_keys(p)], "module string, path string")
        return Cohort(self.name, self.version, repository.head_revision, [c for c in self.capabilities if c in capabilities]), (parse(files.repartition(8)), keys)

    def normalize(self, spark, repository, cohort, payload):
        from ..storage import keep

        facts, keys = payload
        defs, calls = resolve(keep(facts), keys)
        about = F.lit(repository.repository_id), F.lit(repository.head_revision)
        ident = lambda kind, q: canonical_id(*about, kind, q)
        named = defs.select(ident(F.col("base_type"), F.col("qualified_name")).alias("id"), "qualified_name", "path", "name", "owner", "base_type", "lines")
        place = F.struct(F.col("path").alias("file_path"), F.col("lines")[0].alias("start_line"), F.col("lines")[1].alias("end_line"), *(F.when(F.col("lines")[0] != F.col("lines")[1], F.col("lines")[i]).when(F.col("lines")[3] >= F.col("lines")[2], F.col("lines")[i]).alias(n) for i, n in ((2, "start_column"), (3, "end_column"))))
        entities = named.select(
            F.col("id").alias("canonical_id"), about[0].alias("repository_id"), about[1].alias("repository_revision"), F.concat_ws(".", "owner", "name").alias("name"), "qualified_name", "base_type", F.lit(None).cast("string").alias("language"),
            F.array().cast("array<string>").alias("roles"), place.alias("source_location"), F.lit("ACTIVE").alias("lifecycle_status"), F.create_map(F.lit(self.name), F.col("name")).alias("provider_ids"), F.lit(0).alias("ordinal"),
        )
        ids = named.select("qualified_name", "id")
        links = calls.join(ids.toDF("caller", "subject"), "caller").join(ids.toDF("callee", "object"), "callee")
        links = numbered(links, ["caller", "callee"], "nth")
        links = links.select(F.concat(F.lit(f"python_calls:{repository.head_revision}:call:"), F.col("nth").cast("string")).alias("evidence_id"), "subject", F.lit("CALLS").alias("predicate"), "object", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("raw_reference"))
        return Normalized(entities, evidence_of(cohort, links), cohort)
