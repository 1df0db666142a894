"""Stores: Parquet tables under one root, a registry of projects, a vector store, and what goes out."""

from __future__ import annotations

import json
import subprocess
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.session import first_candidate
from .source_tree import ship


class Store:
    """Tables in versioned folders: a table's new version is written whole, then its pointer is replaced.

    A writer that fails leaves the old version in place; one writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.hadoop(f"{self.root}/{path}")

    def _version(self, name: str) -> str | None:
        p = self._at(f"{name}/CURRENT")
        if not self.fs.exists(p):
            return None
        return self.spark.read.text(p.toString()).first().value

    def tables(self) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")) if s.isDirectory() and self.fs.exists(self.hadoop(f"{s.getPath().toString()}/CURRENT")))

    def read(self, name: str) -> DataFrame | None:
        version = self._version(name)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> None:
        old, new = self._version(name), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{new}")
        out = self.fs.create(self._at(f"{name}/NEXT"), True)
        out.write(bytearray(new.encode()))
        out.close()
        self.fs.delete(self._at(f"{name}/CURRENT"), False)
        self.fs.rename(self._at(f"{name}/NEXT"), self._at(f"{name}/CURRENT"))
        if old:
            self.fs.delete(self._at(f"{name}/{old}"), True)

    def replace(self, name: str, df: DataFrame, key: list[str]) -> None:
        """Rows of these keys go, the new ones come: how a file's symbols and chunks are kept."""
        old = self.read(name)
        keep = df if old is None else old.join(df.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(df, allowMissingColumns=True)
        self.write(name, keep)

    def health(self) -> DataFrame:
        """(name, rows, columns) of every table."""
        out = [self.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.lit(len(self.read(n).columns)).alias("columns")) for n in self.tables()]
        every = out[0] if out else self.spark.createDataFrame([], "name string, rows long, columns int")
        for df in out[1:]:
            every = every.unionByName(df)
        return every


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """registry(name, path, seq) with new entries: the last of each name stays, then the last of each path; by name."""
    every = first_candidate(registry.unionByName(entries), ["name"], [F.desc("seq")])
    return first_candidate(every, ["path"], [F.desc("seq")]).orderBy("name")


@dataclass
class ToolResult:
    """What a tool answers with."""

    status: str
    project: str
    freshness: str
    data: list[dict] = field(default_factory=list)
    nextAction: str | None = None
    display: str = ""

    def json(self) -> str:
        return json.dumps(asdict(self), default=str)


def tool_result(rows: DataFrame, project: str, freshness: str = "fresh", limit: int = 100) -> ToolResult:
    """At most ``limit`` rows of a result, and what to do next where there are none or the index is not fresh."""
    data = [r.asDict(recursive=True) for r in rows.limit(limit).collect()]
    status = "ok" if data else "empty"
    then = "sync_index" if freshness != "fresh" else None if data else "search_code"
    return ToolResult(status, project, freshness, data, then, f"{len(data)} rows of {project}")


# ---- manifests and git


def alias_rules(manifests: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(pattern, target, priority) of (path, text) of a project's tsconfig.json and package.json files.

    Order: ``#imports`` of packages, tsconfig ``paths`` (below ``baseUrl``), package exports, exact ones before
    those with a star.  A file that is no JSON has none.
    """
    out: list[tuple[str, str, int]] = []

    def first(x):
        while isinstance(x, dict):
            x = next((x[k] for k in ("import", "default", "require", "types") if k in x), next(iter(x.values()), None))
        return x[0] if isinstance(x, list) and x else x

    for path, text in sorted(manifests):
        folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
        try:
            j = json.loads(text)
        except ValueError:
            continue
        join = lambda *parts: "/".join(p.strip("/").removeprefix("./") for p in parts if p.strip("./"))
        if path.endswith("package.json"):
            name = j.get("name", "")
            for pattern, target in (j.get("imports") or {}).items():
                out.append((pattern, join(folder, first(target) or ""), 0))
            exports = j.get("exports") or ({".": j["main"]} if j.get("main") else {})
            exports = exports if isinstance(exports, dict) and all(k.startswith(".") for k in exports) else {".": exports}
            for pattern, target in exports.items():
                if name and first(target):
                    out.append((name + pattern[1:], join(folder, first(target)), 3 if "*" in pattern else 2))
        else:
            c = j.get("compilerOptions") or {}
            for pattern, targets in (c.get("paths") or {}).items():
                out += [(pattern, join(folder, c.get("baseUrl", ""), t), 1) for t in targets]
    return out


def git_commits(spark: SparkSession, root: str, last: int = 20) -> DataFrame:
    """(branch, hash, author, at, subject) of the last commits of a checkout the driver can see; none if it is no checkout."""
    kind = "branch string, hash string, author string, at long, subject string"
    ask = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=60)
    got = ask("log", f"-{last}", "--format=%H%x1f%an%x1f%at%x1f%s")
    if got.returncode:
        return spark.createDataFrame([], kind)
    branch = ask("rev-parse", "--abbrev-ref", "HEAD").stdout.strip()
    rows = [(branch, h, who, int(at), what) for h, who, at, what in (x.split("\x1f") for x in got.stdout.splitlines())]
    return spark.createDataFrame(rows, kind)


def file_commit(root: str, path: str) -> str | None:
    """Hash of the last commit that changed a file, renames followed."""
    got = subprocess.run(["git", "-C", root, "log", "-1", "--follow", "--format=%H", "--", path], capture_output=True, text=True, timeout=60)
    return got.stdout.strip() or None


# ---- embeddings and summaries by a given provider


def hashed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A provider that needs no network: signed counts of hashed words, of unit length."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def provided(docs: DataFrame, provider: Callable[[list[str]], list], kind: str, batch: int = 32, retries: int = 2) -> DataFrame:
    """(id, value): what a provider says of each text, some at a time; null where it keeps failing.

    ``kind``: ``array<double>`` for embeddings, ``string`` for summaries.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values: list = []
            for k in range(0, len(f), batch):
                some = f.text.iloc[k : k + batch].fillna("").tolist()
                for left in range(retries, -1, -1):
                    try:
                        values += provider(some)
                        break
                    except Exception:  # noqa: BLE001  a provider's failure costs its batch only
                        if not left:
                            values += [None] * len(some)
            yield pd.DataFrame({"id": f.id, "value": values})

    ship(docs.sparkSession)
    return docs.select("id", "text").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, value {kind}")


# ---- vectors


def add_vectors(store: Store, records: DataFrame, name: str = "vectors") -> None:
    """records(id, vec, ...) take the place of those with the same id."""
    store.replace(name, records, ["id"])


def delete_vectors(store: Store, ids: DataFrame, name: str = "vectors") -> None:
    old = store.read(name)
    if old is not None:
        store.write(name, old.join(ids.select("id").distinct(), "id", "left_anti").select(old.columns))


def vector_stats(store: Store, name: str = "vectors") -> DataFrame:
    """(n, dims): rows and vector lengths."""
    old = store.read(name)
    if old is None:
        return store.spark.createDataFrame([(0, 0)], "n long, dims long")
    return old.agg(F.count("*").alias("n"), F.countDistinct(F.size("vec")).alias("dims"))


def _lloyd(x: np.ndarray, k: int, steps: int = 10) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(steps):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def ivf_index(vectors: DataFrame, partitions: int = 256, parts: int = 16, codes: int = 16, sample: int = 4096) -> tuple[DataFrame, list, list]:
    """((id, cell, code) of every vector, centres, codebooks): an inverted file with product codes.

    Centres and codebooks are fitted on at most ``sample`` vectors (those with the smallest hashes); every vector is filed.
    """
    rows = vectors.where("vec is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()  # bounded
    if not rows:
        return vectors.select("id", F.lit(0).alias("cell"), F.array().cast("array<int>").alias("code")).limit(0), [], []
    x = np.array([r.vec for r in rows], float)
    centres = _lloyd(x, partitions)
    rest = x - centres[((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    books = [_lloyd(p, codes) for p in np.array_split(rest, min(parts, x.shape[1]), axis=1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.array(f.vec.tolist(), float).reshape(len(f), -1)
            cell = ((v * v).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(axis=1)[None]).argmin(axis=1)
            split = np.array_split(v - centres[cell], len(books), axis=1)
            code = np.stack([((p[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for p, b in zip(split, books)], axis=1)
            yield pd.DataFrame({"id": f.id, "cell": cell.astype("int32"), "code": [c.astype("int32").tolist() for c in code]})

    ship(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.where(F.size("vec") == x.shape[1]).select("id", "vec").mapInPandas(run, f"id {kind}, cell int, code array<int>"), centres.tolist(), [b.tolist() for b in books]


def ivf_search(vectors: DataFrame, index: DataFrame, centres: list, query: list[float], probes: int = 8, limit: int = 10) -> DataFrame:
    """(id, distance): exact distances within the ``probes`` nearest cells."""
    from ..operators.retrieval import knn

    d = ((np.array(centres) - np.array(query)) ** 2).sum(axis=1)
    some = [int(k) for k in np.argsort(d, kind="stable")[:probes]]
    return knn(vectors.join(index.where(F.col("cell").isin(some)).select("id"), "id", "left_semi"), query, limit)


def wiki(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(document): one JSON document of an index: counts, languages, the most imported files."""
    one = files.agg(F.count("*").alias("files")).crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    lang = files.groupBy(tx.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("language", "n"))).alias("languages"))  # a row for each language
    top = edges.where("type = 'IMPORTS'").groupBy("to_id").agg(F.count("*").alias("n")).join(files.select(F.col("id").alias("to_id"), "path"), "to_id").orderBy(F.desc("n"), "path").limit(20).agg(F.collect_list(F.struct("path", "n")).alias("imported"))
    return one.crossJoin(lang).crossJoin(top).select(F.to_json(F.struct("files", "symbols", "edges", "languages", "imported")).alias("document"))
