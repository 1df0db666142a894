"""Token-ID output: tokenized documents in doc_id order as range-ANS segment files, and back.

A segment is one file's bytes (:mod:`fathomgrid.llm.rans`).  Segments travel as rows of a Parquet
table, so any store that Spark can reach can hold them; :func:`export_files` writes them as plain files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans, tokens
from .common import Workspace, ship, tune

#: Ids after which a segment ends with the document that reaches them.
SEGMENT = 1 << 19
_FILES = "file_no int, segment int, start long, n_ids long, data binary"


def _encoded(spec: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.encoder(spec), TaskContext.get().partitionId()
        seg, at, held, n = 0, 0, [], 0

        def flush():
            docs, ids, counts = [d for x in held for d in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            data = rans.write_segment(docs, counts, ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seg, pa.int32()), (at, pa.int64()), (n, pa.int64()), (data, pa.binary()))], ["file_no", "segment", "start", "n_ids", "data"])

        for b in batches:
            docs = b.column(0).to_pylist()
            ids, counts = tokens.with_end(*enc.encode(b.column(1).to_pylist()), end_id)
            upto, lo = np.cumsum(counts), 0
            while lo < len(docs):
                first = int(upto[lo - 1]) if lo else 0
                hi = min(len(docs), int(np.searchsorted(upto, first + SEGMENT - n)) + 1)  # the document that fills the segment
                held.append((docs[lo:hi], ids[first : upto[hi - 1]], counts[lo:hi]))
                n += int(upto[hi - 1]) - first
                lo = hi
                if n >= SEGMENT:
                    yield flush()
                    seg, at, held, n = seg + 1, at + n, [], 0
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Writes ``docs`` in ascending doc_id order (null first, equal ones in any order) below ``path``.

    Null and empty texts are the end id alone; an empty table writes no segment.  Rows of one doc_id,
    null included, may lie in many partitions, whatever their number.
    """
    tune(docs.sparkSession)
    spec = tokens.load(tokenizer)
    keys = ["doc_id", "_spread", "_row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_spread", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(_encoded(spec, end_id), _FILES).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def _decoded(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, data in zip(b.column(0), b.column(2), b.column(4)):
                data = data.as_py()
                index = rans.read_index(data)
                ids, n = rans.read_blocks(data, index).astype("<u4"), index["lengths"].astype(np.int64)
                if n.sum() != len(ids):
                    raise rans.Damaged("documents and ids differ in length")
                where = base[part.as_py()] + start.as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(index["doc_ids"], mask=index["known"] == 0), pa.array(where), pa.array(n), tokens.as_binary(ids, n, 4)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of what :func:`write_tokens` wrote; raises where a checksum fails.

    An empty folder of segments gives no rows.  One number for each written partition goes to the driver
    and to every task: some 10 MB at a million partitions.
    """
    ship(spark)
    files = spark.read.schema(_FILES).parquet(path)
    totals = sorted((r.file_no, r.n) for r in files.groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect())  # one row for each partition
    base = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))
    return files.mapInArrow(_decoded(base), "doc_id long, start long, n_tokens long, ids binary")


def export_files(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Plain files in a folder that the executors share, one for each segment; the names, in order.

    Every task writes the segments it holds; a task that runs again writes the same bytes again.
    No segments, no files.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [f"{folder}/{f:06d}-{s:06d}.fgr" for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for name, data in zip(names, b.column(4)):
                with open(f"{name}.part", "wb") as f:
                    f.write(data.as_buffer())
                os.replace(f"{name}.part", name)
            yield pa.RecordBatch.from_arrays([pa.array(names)], ["name"])

    ship(spark)
    return sorted(r.name for r in spark.read.schema(_FILES).parquet(path).mapInArrow(run, "name string").collect())


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's digest: writes the files, reads them back."""
    ws = Workspace(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, ws.path("files"))
    return read_tokens(docs.sparkSession, ws.path("files")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
