"""What the operators share: the shared work folder, connected components, Arrow settings."""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a batch handed to Python.
ARROW_ROWS, ARROW_BYTES = 8192, 2 << 20

#: Spark's setting by which a query's shuffle files go when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN_DIR: list[str] = []
_SHIPPED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, as in tests on one machine, a temporary folder is made and set; a cluster has to
    name one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="fathomgrid-"))
        spark.sparkContext.setCheckpointDir(_OWN_DIR[0])
    return _OWN_DIR[0]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    top = pathlib.Path(__file__).resolve().parents[1]
    path = pathlib.Path(tempfile.mkdtemp(prefix="fathomgrid-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _SHIPPED["app"] = sc.applicationId


def tune(spark: SparkSession) -> None:
    """For operators with Python on the executors: the code, and Arrow batches bounded by their bytes, so
    that a batch of long texts fits a worker (one row may be larger).  The settings are the same for all
    operators, as results are lazy and may run when another operator has been called.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under plain names of its own, and the new name of each column.

    Operators that join columns of their own to whole rows work on these, so that an input column may
    have any name; ``toDF(*docs.columns)`` puts the names back.
    """
    new = [f"_in_{k}" for k in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new))


class Workspace:
    """Tables written once to the shared folder and read back: lineage ends there.

    A lost executor costs a re-read, never a recomputation of what came before.  Tables that are no
    longer needed go with :meth:`drop`; the rest goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def save(self, df: DataFrame, key: str) -> DataFrame:
        conf, kept = self.spark.conf, self.spark.conf.get(CLEAN)
        conf.set(CLEAN, "true")  # the table stands for the plan: its shuffles aren't needed again
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(key))
        finally:
            conf.set(CLEAN, kept)
        return self.read(key, df)

    def read(self, key: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(key))

    def drop(self, key: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key) if key else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            self.drop()


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder.  Every step is
    a min-aggregate, which Spark combines before its shuffle, and an equi-join that adaptive
    execution can split, so a hub with very many neighbours meets in no single task; the number of
    steps grows with the logarithm of the longest path.
    """
    cur = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        now = cur.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == state or now[0] == 0:
            break
        state, step = now, step + 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        ws.save(new, f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
        cur = ws.read(f"{name}-{step}", cur)
    return cur.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


_SPACE = bytes(k in (9, 10, 11, 12, 13, 32) for k in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of a text, words parting at ASCII white space: eight bytes of all words at once."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = np.frombuffer(raw.translate(_SPACE), bool)
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    h = mixed((eight[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    k, longer = 8, np.flatnonzero(length > 8)
    while len(longer):
        h[longer] = mixed(h[longer] ^ (eight[start[longer] + k] & _MASK[np.minimum(length[longer] - k, 8)]))
        k += 8
        longer = longer[length[longer] > k]
    return start, h
