"""Packing: concatenate and cut.

First pass: every partition tokenizes its documents, writes their ids and the running token count
inside the partition.  The partitions' totals, prefix-summed on the driver (one number for each
partition), give each document its global offset.  Second pass: any split of the written table cuts
its documents at multiples of the window, independently of all others; a document that crosses a
boundary leaves a piece on both sides.  No shuffle, no sort, and padding in the last window only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Workspace, tune

WINDOW = 1024


def _tokenized(spec: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens.encoder(spec), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, n = tokens.with_end(*enc.encode(b.column(1).to_pylist()), end_id)
            start = at + np.cumsum(n) - n
            at += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), tokens.as_binary(ids, n, enc.width)], ["doc_id", "part", "start", "n", "ids"])

    return run


def _cut(base: dict[int, int], window: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            part, at, n = (b.column(k).to_numpy() for k in (1, 2, 3))
            at = at + np.array([base[p] for p in part.tolist()], np.int64)
            many = (at + n - 1) // window - at // window + 1
            doc = np.repeat(np.arange(len(n)), many)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(at[doc], (at[doc] // window + nth) * window)
            length = np.minimum(at[doc] + n[doc], (begin // window + 1) * window) - begin
            ids = np.frombuffer(b"".join(b.column(4).to_pylist()), f"<u{width}")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(length), tokens.as_binary(ids, length, 4), pa.array(n[doc]), pa.array(begin // window), pa.array(begin % window)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, name: str = "pack") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece.

    ``ids`` holds little-endian unsigned 32-bit integers.  Null and empty texts are their end id
    alone; repeated rows are packed once each; an empty table gives no rows.  Only the last sequence
    is short of ``window``: pad it there.
    """
    tune(docs.sparkSession)
    ws, spec = Workspace(docs.sparkSession, name), tokens.load(tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = ws.save(docs.select("doc_id", "text").mapInArrow(_tokenized(spec, end_id), f"doc_id {kind}, part int, start long, n long, ids binary"), "ids")
    totals = sorted((r.part, r.n) for r in done.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition
    base = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))
    return done.mapInArrow(_cut(base, window, tokens.encoder(spec).width), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array): the windows, padded; ``pieces`` of :func:`pack` with this window.

    An empty table gives no rows; a null piece counts as no ids.
    """
    tune(pieces.sparkSession)
    done = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(1).to_pylist():
                x = np.frombuffer(b"".join(e["ids"] or b"" for e in p), "<u4").astype(np.int32)
                rows.append(np.pad(x, (0, window - len(x)), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return done.mapInArrow(run, "sequence_id long, ids array<int>")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's digest."""
    p = pack(docs, tokenizer)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
