"""Exact top-k inner products by pivot-table elimination.

Rows lie in cells around some of the pivots, cells in blocks, blocks in leaves of rows that are about as
far from their pivot.  Distances to all pivots are computed once for each row, and their ranges are kept
for each leaf and cell.  For a query ``q`` and any pivot ``p``, ``|q - x| >= | |q - p| - |x - p| |``, so
the largest of these lower bounds gives an upper bound on ``q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2``.

A query first searches its own cell, and then only the cells whose bound reaches the k-th score found
there.  In a block it evaluates leaves in the order of their bounds, some at a time, and stops where the
next bound is below its k-th score, which is exact.

Queries go to blocks (they are the small side: a stated set, in blocks), rows go nowhere twice.
Partial results are k rows for each query and block; the last k come from a window over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tune
from .vectors import by_length

#: Pivots, and rows (those with the smallest hashes) they are chosen from; rows of a cell, a block, a leaf.
PIVOTS, SAMPLE, CELL, BLOCK, LEAF = 64, 4096, 4096, 16_384, 32
#: Leaves that a query evaluates first; each further step takes twice as many.
FIRST = 4
#: Scaled components up to which sums of products are exact in doubles.
EXACT = float(1 << 22)


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice of rows of ``x``."""
    if not len(x):
        return x
    chosen, far = [0], np.full(len(x), np.inf)
    for _ in range(min(n, len(x)) - 1):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers; clamped to 64 bits where they are larger."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(a) for a in q.tolist()]
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(a * int(b) for a, b in zip(whole, row)))) for row in x.tolist()], np.int64)


def upper(own: np.ndarray, sq: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bound on an inner product from both squared lengths and a lower bound on the distance."""
    return (own + sq - low * low) / 2 + 1e-9 * (own + sq) + 1e-6 * (np.sqrt(own * sq) + 1)  # rounding of the distances


def gap(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest lower bound on the distance to what lies within ``lo`` to ``hi`` of the pivots (last axis)."""
    return np.maximum(np.maximum(lo - d, d - hi).max(axis=-1, initial=0.0), 0.0)


class Block:
    """Rows in leaves, with the ranges of their distances to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        table = distances(x, pivots)
        if len(pivots):  # rows near each other share a leaf: those of one nearest pivot, by their distance to it
            near = table.argmin(axis=1)
            order = np.lexsort((table[np.arange(len(x)), near], near))
            ids, x, table = ids[order], x[order], table[order]
        self.ids, self.x, self.pivots = ids, x, pivots
        self.edge = np.append(np.arange(0, len(x), LEAF), len(x))
        self.lo, self.hi = np.minimum.reduceat(table, self.edge[:-1]), np.maximum.reduceat(table, self.edge[:-1])
        self.sq = np.maximum.reduceat((x * x).sum(axis=1), self.edge[:-1])
        self.scored = self.asked = 0

    def search(self, i: int, v: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of a query's k best rows here, ties to the smaller id; none below ``least`` count."""
        bound = upper((v * v).sum(), self.sq, gap(distances(v[None], self.pivots)[0], self.lo, self.hi))
        self.asked += len(self.x)
        order = np.flatnonzero(bound >= least)
        order = order[np.argsort(-bound[order], kind="stable")]
        ids, s = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, FIRST
        while at < len(order) and bound[order[at]] >= least:
            some = order[at : at + step]
            some = some[bound[some] >= least]
            at, step = at + len(some), 2 * step
            if 2 * len(some) > len(self.edge):  # most of the block: no copy
                rows = np.zeros(len(self.x), bool)
                for leaf in some.tolist():
                    rows[self.edge[leaf] : self.edge[leaf + 1]] = True
                got, own = scores(v, self.x)[rows], self.ids[rows]
            else:
                rows = np.concatenate([np.arange(self.edge[leaf], self.edge[leaf + 1]) for leaf in some.tolist()])
                got, own = scores(v, self.x[rows]), self.ids[rows]
            self.scored += len(own)
            other = (own != i) & (got >= least)
            ids, s = np.concatenate([ids, own[other]]), np.concatenate([s, got[other]])
            if len(s) > k:
                keep = np.flatnonzero(s >= np.partition(s, -k)[-k])
                keep = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
                ids, s = ids[keep], s[keep]
            if len(s) == k:
                least = max(least, float(s.min()))
        return ids, s


def _placed(pivots: dict[int, np.ndarray], cells: int, scale: float):
    """Scaled vectors and the cells of their nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in by_length(b.column(0), b.column(1)):
                x, n = np.floor(scale * x), len(ids)
                p = pivots.get(x.shape[1], x[:0])[:cells]
                cell = distances(x, p).argmin(axis=1) if len(p) else np.zeros(n, np.int64)
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(ids), v], ["dim", "cell", "vec_id", "v"])

    return run


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def _ranges(pivots: dict[int, np.ndarray]):
    """For each cell and pivot the range of distances; pivot -1: the largest squared length, and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for b in batches:
            dims, cells = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim, cell in set(zip(dims.tolist(), cells.tolist())):
                x = _matrix(b.column(3).filter(pa.array((dims == dim) & (cells == cell))), dim)
                d = distances(x, pivots.get(dim, x[:0]))
                new = [d.min(axis=0), d.max(axis=0), (x * x).sum(axis=1).max(), len(x)]
                old = found.get((dim, cell))
                found[dim, cell] = new if old is None else [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), max(old[2], new[2]), old[3] + new[3]]
        out = [(*key, p, lo, hi, 0) for key, (a, z, _, _) in found.items() for p, (lo, hi) in enumerate(zip(a.tolist(), z.tolist()))]
        out += [(*key, -1, 0.0, float(sq), n) for key, (_, _, sq, n) in found.items()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], ["dim", "cell", "pivot", "lo", "hi", "n"])

    return run


def _routed(cells: dict, pivots: dict[int, np.ndarray]):
    """The blocks that a query has to ask: without ``least`` those of its cell, else those of the other
    cells whose bound reaches it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, block = [], []
            vectors = b.column(3)
            for k, (dim, cell, least) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 4)))):
                if least is None:
                    mine = [cell]
                else:
                    v = np.asarray(vectors[k].as_py())
                    own, d = (v * v).sum(), distances(v[None], pivots.get(dim, np.zeros((0, dim))))[0]
                    mine = [c for (kind, c), x in cells.items() if kind == dim and c != cell and upper(own, x["sq"], gap(d, x["lo"], x["hi"])) >= least]
                for c in mine:
                    first, n = cells[dim, c]["blocks"]
                    at += [k] * n
                    block += range(first, first + n)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.ones(len(at), np.int32)), *(b.column(j).take(take) for j in (0, 2, 3, 4))], ["block", "asks", "dim", "vec_id", "v", "least"])

    return run


def _searched(pivots: dict[int, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, ids, parts = None, None, [], []
        for b in batches:
            # rows come sorted by block and then rows before queries; a block has one vector length
            blocks, asks, dims = (b.column(j).to_numpy() for j in range(3))
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(b)]):
                if hi <= lo:
                    continue
                if blocks[lo] != at:
                    at, block, ids, parts = blocks[lo], None, [], []
                dim = int(dims[lo])
                own, x = b.column(3)[lo:hi].to_numpy(), _matrix(b.column(4)[lo:hi], dim)
                if not asks[lo]:
                    ids.append(own), parts.append(x)
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(parts), pivots.get(dim, x[:0]))
                least = b.column(5)[lo:hi].to_pylist()
                found = [(i, *block.search(i, v, k, -np.inf if m is None else m)) for i, v, m in zip(own.tolist(), x, least)]
                cols = [np.concatenate([np.full(len(s), i, np.int64) for i, _, s in found]), np.concatenate([c for _, c, _ in found]), np.concatenate([s for *_, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, name: str = "topk") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table(vec_id, embedding)`` with the highest
    integer inner product, for every row whose vec_id is divisible by ``every``.

    Components are ``floor(scale * x)``.  Rows that are null or hold null or non-finite components
    take no part; vectors of different lengths have no score.  A query's own id is no candidate;
    repeated rows are candidates each; fewer than k candidates give fewer rows, an empty table none.
    Pivots come from a bounded sample; every row is placed and bounded.
    """
    spark = table.sparkSession
    tune(spark)
    ws = Workspace(spark, name)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = rows.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # bounded: SAMPLE rows
    pivots = {}
    for _, x in by_length(pa.array(sample.vec_id, pa.int64()), pa.array(list(sample.embedding), pa.list_(pa.float64()))):
        pivots[x.shape[1]] = choose_pivots(np.floor(scale * x))
    count = max(1, min(PIVOTS, rows.count() // CELL))
    placed = ws.save(rows.mapInArrow(_placed(pivots, count, scale), "dim int, cell int, vec_id long, v array<double>"), "placed")
    ranges = placed.mapInArrow(_ranges(pivots), "dim int, cell int, pivot int, lo double, hi double, n long")
    cells: dict[tuple[int, int], dict] = {}
    for r in ranges.groupBy("dim", "cell", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect():  # PIVOTS squared for each vector length
        x = cells.setdefault((r.dim, r.cell), {"lo": np.zeros(len(pivots.get(r.dim, ()))), "hi": np.zeros(len(pivots.get(r.dim, ())))})
        if r.pivot < 0:
            x["sq"], x["n"] = r.hi, r.n
        else:
            x["lo"][r.pivot], x["hi"][r.pivot] = r.lo, r.hi
    total = 0
    for key in sorted(cells):
        n = -(-cells[key]["n"] // BLOCK)
        cells[key]["blocks"] = total, n
        total += n
    where = spark.createDataFrame([(*key, *x["blocks"]) for key, x in cells.items()], "dim int, cell int, first int, blocks int")
    block = (F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("blocks"))).cast("int")
    dealt = placed.join(F.broadcast(where), ["dim", "cell"]).select(block.alias("block"), F.lit(0).alias("asks"), "dim", "vec_id", "v", F.lit(None).cast("double").alias("least"))
    dealt = ws.save(dealt, "dealt")
    asked = placed.where(F.col("vec_id") % every == 0)

    def searched(queries: DataFrame, step: str) -> DataFrame:
        routed = queries.select("dim", "cell", "vec_id", "v", "least").mapInArrow(_routed(cells, pivots), dealt.schema)
        both = dealt.unionByName(routed).repartitionById(max(1, total), "block").sortWithinPartitions("block", "asks")
        return ws.save(both.mapInArrow(_searched(pivots, k), "query_id long, vec_id long, score long"), step)

    own = searched(asked.withColumn("least", F.lit(None).cast("double")), "own")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = own.withColumn("rank", best).where(f"rank = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("found"))
    others = asked.join(least, "vec_id", "left").withColumn("least", F.coalesce("found", F.lit(-1e300)))
    found = own.unionByName(searched(others, "others"))
    return found.withColumn("rank", best).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
