"""Embedding near-dedup by collision-counting projections.

Vectors are projected on many random directions, and every direction has two sorted lists: of the vectors
that it is among the strongest directions of, by the sign of the projection.  So a list holds the ends
of a sorted projection, where few vectors lie and near ones lie together.  Two vectors collide in a list
if one is in the window of half-width ``window(cosine)`` centred on the other; a list is walked in order,
so a window is a run of it.  A pair is a candidate if it shares at least ``shared`` lists, and if its
projections on ``COUNTED`` further directions collide at least ``needed`` times; candidates are verified
by cosine in double precision.

:func:`layout` calibrates the counts on simulated pairs exactly at the threshold.  With many vectors a
list of one direction grows long, so vectors meet in the lists of all sets of ``shared`` directions; the
number of lists follows the number of vectors, and lists stay short.

Equal vectors are one class with a count, so a vector under a million ids is filed once.  A list that is
long all the same is cut into chunks, and every two chunks meet in a task of their own.  A pair is counted
in the first list it shares, so links are never shuffled: a task returns each class's number of links
and a forest of them.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grayindex
from .common import Workspace, connected_components, tune
from .vectors import by_length

#: Further projections counted per pair; half-width of a window in standard deviations at the threshold.
COUNTED, WIDE = 24, 2.5
#: Chance that a pair exactly at the threshold shares too few lists, and that it collides too seldom.
MISS, MISCOUNT = 0.002, 1e-4
#: Mean length that lists should not exceed; vectors in a chunk of a long one.
LISTED, CHUNK = 2500, 2048
#: Directions with lists; strongest ones that a vector may be filed under; simulated pairs.
DIRECTIONS, STRONGEST, PAIRS = (128, 512), 12, 4000


def window(cosine: float) -> float:
    return WIDE * math.sqrt(2 - 2 * cosine)


def needed(cosine: float) -> int:
    """Least number of collisions: a pair at the threshold has fewer with a chance of MISCOUNT at most."""
    p, below, k = 2 * NormalDist().cdf(WIDE) - 1, 0.0, 0
    while (below := below + math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)) <= MISCOUNT:
        k += 1
    return k


@functools.cache
def directions(dim: int, n: int, what: int) -> np.ndarray:
    return np.random.default_rng([what, dim]).standard_normal((dim, n))


def strongest(unit: np.ndarray, directed: int, take: int) -> np.ndarray:
    """(rows, take) numbers of each vector's lists, strongest first: twice the direction, and one if negative."""
    p = unit @ directions(unit.shape[1], directed, 1)
    size = np.abs(p)
    take = min(take, directed)
    top = np.argpartition(-size, take - 1, axis=1)[:, :take]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
    return 2 * top + (np.take_along_axis(p, top, 1) < 0)


@functools.cache
def layout(n: int, dim: int, cosine: float) -> tuple[int, int, int]:
    """(directions, lists that a pair has to share, lists that a vector is filed under) for ``n`` vectors.

    The fewest lists a pair has to share that keep the mean list at ``LISTED``, and with them the fewest
    to file under that a pair at the threshold passes but for a chance of ``MISS``.
    """
    r = np.random.default_rng([4, dim])
    x = units(r.standard_normal((PAIRS, dim)))
    if dim > 1:
        y = r.standard_normal((PAIRS, dim))
        y = units(y - (x * y).sum(axis=1, keepdims=True) * x)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y
    else:
        y = x
    best = None
    for directed in DIRECTIONS:
        a, b = strongest(x, directed, STRONGEST), strongest(y, directed, STRONGEST)
        both = [(a[:, :t, None] == b[:, None, :t]).any(axis=2).sum(axis=1) for t in range(1, STRONGEST + 1)]
        for shared in (1, 2, 3, 4):
            for t in range(shared, STRONGEST + 1):
                if (both[t - 1] < shared).mean() <= MISS:
                    length = n * math.comb(t, shared) / (math.comb(directed, shared) * 2**shared)
                    if best is None or length < best[0]:
                        best = length, (directed, shared, t)
                    if length <= LISTED:
                        return directed, shared, t
                    break
    return best[1] if best else (DIRECTIONS[0], 1, STRONGEST)


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square leaves the range of a double."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _valid(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in by_length(b.column(0), b.column(1)):
                some = np.abs(x).max(axis=1) > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(some.sum(), x.shape[1], np.int32)), _lists(x[some] + 0.0, kind)], ["vec_id", "dim", "v"])

    return run


def list_keys(mine: np.ndarray, dim: int, shared: int) -> Iterator[np.ndarray]:
    """A number for each set of ``shared`` of a vector's lists."""
    mine = np.sort(mine, axis=1).astype(np.int64)
    for some in itertools.combinations(range(mine.shape[1]), shared):
        key = np.full(len(mine), dim, np.int64)
        for j in some:
            key = key * 1031 + mine[:, j] + 1
        yield key


def _filed(how: dict[int, tuple[int, int, int]], whole: bool):
    """Each class once for each of its lists; with ``whole``, the vector too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                directed, shared, take = how[dim]
                mine = strongest(units(_matrix(own.column(3), dim).astype(np.float64)), directed, take)
                for key in list_keys(mine, dim, shared):
                    yield pa.RecordBatch.from_arrays([pa.array(key), *own.columns], ["key", "dim", "cid", "n", "v"]) if whole else pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

    return run


def first_shared(a: np.ndarray, b: np.ndarray, dim: int, shared: int) -> np.ndarray:
    """The number of the first list of both, for rows of (sorted) list numbers."""
    key, left = np.full(len(a), dim, np.int64), np.full(len(a), shared)
    for j in range(a.shape[1]):
        hit = (a[:, j, None] == b).any(axis=1) & (left > 0)
        key = np.where(hit, key * 1031 + a[:, j] + 1, key)
        left = left - hit
    return key


def _linked(how: dict[int, tuple[int, int, int]], cosine: float):
    wide, least = window(cosine), needed(cosine)

    def links(key: int, dim: int, one: tuple, two: tuple | None, out: list) -> None:
        """Links between two chunks (two: None for those inside one)."""
        (ia, na, ua, pa_, ha), (ib, nb, ub, pb, hb) = one, two or one
        for lo in range(0, len(ia), 128):
            s = slice(lo, lo + 128)
            # the window on the first projection is a run of the sorted list
            begin = int(np.searchsorted(pb[:, 0], pa_[s, 0].min() - wide))
            end = int(np.searchsorted(pb[:, 0], pa_[s, 0].max() + wide, "right"))
            hits = np.zeros((len(ia[s]), end - begin), np.uint8)
            for j in range(COUNTED):
                hits += np.abs(pa_[s, j, None] - pb[None, begin:end, j]) <= wide
            a, b = np.nonzero(hits >= least)
            a, b = a + lo, b + begin
            if two is None:
                a, b = a[a < b], b[a < b]
            near = np.einsum("ij,ij->i", ua[a], ub[b]) >= cosine
            a, b = a[near], b[near]
            first = first_shared(ha[a], hb[b], dim, how[dim][1]) == key  # else another list has the pair
            a, b = a[first], b[first]
            out.append((ia[a], ib[b], na[a], nb[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(dim: int, parts: list) -> tuple:
            ids, n, x = (np.concatenate(c) for c in zip(*parts))
            u = units(x.astype(np.float64))
            p = (u @ directions(dim, COUNTED, 3)).astype(np.float32)
            order = np.argsort(p[:, 0], kind="stable")
            directed, _, take = how[dim]
            return ids[order], n[order], u[order], p[order], np.sort(strongest(u, directed, take), axis=1)[order]

        def done(key: tuple, dim: int, parts: dict[int, list]) -> pa.RecordBatch | None:
            number, c, d = key
            out: list = []
            if c in parts and d in parts:
                one = side(dim, parts[c])
                links(number, dim, one, None if c == d else side(dim, parts[d]), out)
            a, b, na, nb = (np.concatenate([p[j] for p in out]) if out else np.zeros(0, np.int64) for j in range(4))
            if not len(a):
                return None
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([nb, na])).astype(np.int64)
            parent = grayindex.join_sets(np.arange(len(ids)), at[: len(a)], at[len(a) :])
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(ids[parent])], ["cid", "n", "root"])

        key, dim, parts = None, 0, {}
        for b in batches:
            cols = [b.column(j).to_numpy() for j in range(7)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(b)]):
                if hi <= lo:
                    continue
                now = tuple(int(cols[j][lo]) for j in range(3))
                if now != key:
                    if parts and (r := done(key, dim, parts)):
                        yield r
                    key, dim, parts = now, int(cols[4][lo]), {}
                own, x = cols[3][lo:hi], _matrix(b.column(7)[lo:hi], dim)
                for w in np.unique(own).tolist():
                    at = own == w
                    parts.setdefault(w, []).append((cols[5][lo:hi][at], cols[6][lo:hi][at], x[at]))
        if parts and (r := done(key, dim, parts)):
            yield r

    return run


def near_vectors(table: DataFrame, cosine: float = 0.95, name: str = "embeddings") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``table(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths, nor rows without a vec_id.  Repeated rows are one vector and share
    its result; rows that have one vec_id and different vectors share the result too, and their links
    add up.  An empty table gives no rows.
    """
    spark = table.sparkSession
    tune(spark)
    ws = Workspace(spark, name)
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    valid = ws.save(rows.mapInArrow(_valid(pa.float32() if single else pa.float64()), f"vec_id long, dim int, v array<{kind}>"), "valid")
    classes = ws.save(valid.groupBy("dim", "v").agg(F.min("vec_id").alias("cid"), F.count_distinct("vec_id").alias("n")).select("dim", "cid", "n", "v"), "classes")
    how = {r.dim: layout(r.n, r.dim, cosine) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each vector length
    crowd = classes.mapInArrow(_filed(how, False), "key long").groupBy("key").agg(F.count("*").alias("n")).where(f"n > {CHUNK}").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    crowd = ws.save(crowd, "crowd")
    filed = classes.mapInArrow(_filed(how, True), f"key long, dim int, cid long, n long, v array<{kind}>")
    filed = filed.join(crowd, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid", "v"), F.col("chunks")).cast("int"))
    # every two chunks meet once: chunk i goes to (i, j) and (j, i)
    filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    filed = filed.select("key", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "own", "dim", "cid", "n", "v")
    filed = filed.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d")
    found = ws.save(filed.mapInArrow(_linked(how, cosine), "cid long, n long, root long"), "found")
    # vec_ids and their classes; an id with several vectors ties their classes together
    mine = valid.select("vec_id", *_name()).distinct().join(classes.select(*_name(), "cid", F.col("n").alias("size")), ["h", "g"]).select("vec_id", "cid", "size")
    mine = ws.save(mine, "mine")
    tied = mine.groupBy("vec_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b")
    tied = mine.join(tied.select("vec_id", "a"), "vec_id").where("cid <> a").select("a", F.col("cid").alias("b"))
    cc = connected_components(ws, found.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(tied))
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    own = mine.join(links, "cid", "left").join(cc, F.col("cid") == F.col("node"), "left")
    own = own.groupBy("vec_id").agg(F.sum(F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "cid")).alias("component"))
    own = ws.save(own, "own")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(own, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _name() -> list[F.Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g")]
