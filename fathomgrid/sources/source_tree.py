"""A source tree as relations: files, symbols, imports and calls."""

from __future__ import annotations

import ast
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import generate_id, ignored, language_of, role_of

_SHIPPED: dict[str, str] = {}
MAX_BYTES = 1_000_000
_JS = (
    ("class", re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)", re.M)),
    ("interface", re.compile(r"^[ \t]*(?:export\s+)?interface\s+(\w+)", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)", re.M)),
    ("type", re.compile(r"^[ \t]*(?:export\s+)?type\s+(\w+)\s*=", re.M)),
    ("constant", re.compile(r"^(?:export\s+)?(?:const|let)\s+(\w+)", re.M)),
)
_GO = (("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", re.M)), ("interface", re.compile(r"^type\s+(\w+)\s+interface\b", re.M)), ("class", re.compile(r"^type\s+(\w+)\s+struct\b", re.M)))
_JS_EXPORT = re.compile(r"""^export\s+(?:\*\s+(?:as\s+(?P<space>\w+)\s+)?from\s+['"](?P<all>[^'"]+)['"]|\{(?P<names>[^}]*)\}(?:\s*from\s+['"](?P<source>[^'"]+)['"])?|(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function|interface|type|const|let|enum)\s*\*?\s*(?P<own>\w+))""", re.M)
_JS_CALL = re.compile(r"(?P<new>\bnew\s+)?(?:(?P<receiver>\w+)\s*\.\s*)?(?P<callee>[A-Za-z_$]\w*)\s*\(")
_JS_BINDING = re.compile(r"(?:const|let|var)\s+(\w+)\s*(?::\s*\w+\s*)?=\s*new\s+(\w+)")
_JS_TYPE = re.compile(r"(?:class|interface)\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<extends>[\w.,\s]+?))?(?:\s+implements\s+(?P<implements>[\w.,\s]+?))?\s*\{")
_JS_ROUTE = re.compile(r"""\b\w+\.(get|post|put|delete|patch)\(\s*['"`](/[^'"`]*)['"`]""")
_JS_FETCH = re.compile(r"""\bfetch\(\s*['"`](/[^'"`]*)['"`](?:[^)]*?method:\s*['"](\w+)['"])?""")
_PY_ROUTE = ("get", "post", "put", "delete", "patch")
#: Words before a bracket that call nothing.
_NO_CALL = frozenset("if for while switch catch function return typeof await super import require constructor".split())
_JS_IMPORT = re.compile(r"""(?:from|import|require\()\s*['"]([^'"]+)['"]""")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    app = spark.sparkContext.applicationId
    if _SHIPPED.get("app") != app:
        top = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="fathomgrid-code-")) / "fathomgrid-core.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(out))
        _SHIPPED["app"] = app


def _lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of one small file, none if there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def discover(spark: SparkSession, root: str, more_ignored: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, language, role, size, hash, content): files up to a megabyte without NUL in the first 8 KB.

    The root's ``.gitignore``, if there is one, and ``more_ignored`` rule out paths beside the default names.
    """
    more_ignored = (*_lines(spark, f"{root.rstrip('/')}/.gitignore"), *more_ignored)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.withColumn("path", F.regexp_replace("path", r"^.*?" + re.escape(root.strip("/")) + "/", ""))
    f = f.where((F.col("length") <= MAX_BYTES) & ~ignored(F.col("path"), more_ignored) & (F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) == 0))
    return f.select(generate_id(F.lit("file"), F.col("path")).alias("id"), "path", language_of(F.col("path")).alias("language"), role_of(F.col("path")).alias("role"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content"))


def parse(path: str, language: str | None, text: str) -> list[tuple[str, str, str, int, int]]:
    """(what, kind, name, first line, last line) of a file; a file that does not parse has none.

    what: symbol, import, export (kind: the source it passes on), call (kind: its receiver, or ``new``),
    binding (kind: the class), extends and implements (kind: the type), route and route_reference (kind: the
    method).
    """
    out: list[tuple[str, str, str, int, int]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        for n in ast.walk(tree):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("symbol", "class" if isinstance(n, ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno or n.lineno))
                for b in n.bases if isinstance(n, ast.ClassDef) else ():
                    if isinstance(b, ast.Name | ast.Attribute):
                        out.append(("extends", n.name, b.id if isinstance(b, ast.Name) else b.attr, n.lineno, n.lineno))
                for d in n.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _PY_ROUTE and d.args and isinstance(d.args[0], ast.Constant):
                        out.append(("route", d.func.attr.upper(), str(d.args[0].value), n.lineno, n.lineno))
            elif isinstance(n, ast.Import):
                out += [("import", "module", a.name, n.lineno, n.lineno) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.append(("import", "module", "." * n.level + (n.module or ""), n.lineno, n.lineno))
            elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id[:1].isupper():
                out += [("binding", n.value.func.id, t.id, n.lineno, n.lineno) for t in n.targets if isinstance(t, ast.Name)]
            elif isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    receiver = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else ""
                    out.append(("call", receiver, name, n.lineno, n.lineno))
        return sorted(out, key=lambda x: (x[3], x[0], x[2]))
    for kind, rule in _GO if language == "go" else _JS if language in ("typescript", "javascript") else ():
        out += [("symbol", kind, m[1], text.count("\n", 0, m.start(1)) + 1, text.count("\n", 0, m.start(1)) + 1) for m in rule.finditer(text)]
    if language in ("typescript", "javascript"):
        line = lambda at: text.count("\n", 0, at) + 1
        add = lambda what, kind, name, at: out.append((what, kind, name, line(at), line(at)))
        for m in _JS_EXPORT.finditer(text):
            if m["all"]:
                add("export", m["all"], m["space"] or "*", m.start())
            elif m["names"] is not None:
                for x in filter(None, (x.strip() for x in m["names"].split(","))):
                    add("export", m["source"] or "", x.split(" as ")[-1].strip(), m.start())
            else:
                add("export", "", m["own"], m.start())
        for m in _JS_CALL.finditer(text):
            if m["callee"] not in _NO_CALL:
                add("call", "new" if m["new"] else m["receiver"] or "", m["callee"], m.start("callee"))
        for m in _JS_BINDING.finditer(text):
            add("binding", m[2], m[1], m.start())
        for m in _JS_TYPE.finditer(text):
            for what in ("extends", "implements"):
                for x in (m[what] or "").split(","):
                    if x.strip():
                        add(what, m[1], x.strip(), m.start())
        for m in _JS_ROUTE.finditer(text):
            add("route", m[1].upper(), m[2], m.start())
        for m in _JS_FETCH.finditer(text):
            add("route_reference", (m[2] or "GET").upper(), m[1], m.start())
        out += [("import", "module", m[1], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.start()) + 1) for m in _JS_IMPORT.finditer(text)]
    return out


def facts(files: DataFrame) -> DataFrame:
    """(path, what, kind, name, first, last) of all files' symbols, imports and calls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *x) for p, lang, t in zip(f.path, f.language, f.content) for x in parse(p, lang, t)]
            yield pd.DataFrame(rows, columns=["path", "what", "kind", "name", "first", "last"])

    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInPandas(run, "path string, what string, kind string, name string, first int, last int")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target): the file that each import(path, name) means."""
    from ..operators.code import resolve_imports as resolve

    return resolve(imports.select(F.col("path").alias("importer"), F.col("name").alias("specifier")), files).select(F.col("importer").alias("path"), F.col("specifier").alias("name"), "target")
