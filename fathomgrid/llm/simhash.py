"""SimHash near-dedup over a Gray-order hierarchical index.

Equal fingerprints collapse first.  A fingerprint with at most ``radius`` differing bits agrees in one
of ``radius + 1`` blocks of bits, so fingerprints meet by block value: each goes to one place per
block, whatever its neighbours.  There the codes, rotated so that the block leads, form one
hierarchical index in Gray order (:mod:`fathomgrid.llm.grayindex`); a task keeps the links as a
forest, never as a list of all pairs, so a large group of near copies costs as many rows as it has
members.  Components of the links then come from :func:`fathomgrid.llm.common.connected_components`.

With ``words > 1`` a fingerprint has that many 64-bit words, cut into 32-bit tables; codes that meet
in any table are checked against the whole fingerprint (``most`` differing bits).

:func:`similar_groups` links a pair if the Jaccard similarity of its shingle sets, counted exactly, is
high enough.  Its sets meet where a band of least hashes is equal: a block of a fingerprint has so few
values that the sets that share one, and with them the time for each set, grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grayindex
from .common import Workspace, aside, connected_components, mixed, tune, word_hashes

SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time: bounds memory for texts of any length.
CHUNK = 1 << 15
#: Hashes whose bits are laid out at a time.
ROUND = 2040
#: Rows after which a task indexes the block values that it has whole.
ROWS = 200_000
#: Bands whose places are dealt out together, and pairs whose marks are compared together.
TOGETHER, PAIRS = 12, 1 << 16
#: Followers in a key that a set is compared with at first: all there are in a key of one more set.
NEXT = 9
#: Shingles whose least hashes are taken at a time: the numbers stay in a processor's cache.
LEAST = 128


def shingles(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, repeats included, some at a time.

    A-Z are lowered, words part at ASCII white space.  A text with fewer words than ``size`` is one
    shingle; null, empty and blank texts have none.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    for k in range(0, len(starts), CHUNK):
        yield np.array([h(whole[s:e], SEED) for s, e in zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())], np.uint64)


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """The hash itself for word 0, else another hash of it (splitmix64)."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int, words: int = 1) -> np.ndarray:
    """``words`` unsigned 64-bit words; a bit is set if it is in over half of the shingles' hashes."""
    return _sketch(shingles(text, size), words)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the text's shingles, each once, in order: as :func:`shingles` parts them, by a faster hash."""
    _, h = word_hashes((text or "").encode("utf-8", "replace").translate(_LOWER))
    if len(h) < size:
        size = max(1, len(h))
    n = len(h) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(_spread(out, 1))


def _sketch(chunks: Iterable[np.ndarray], words: int) -> np.ndarray:
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in chunks:
        n += len(h)
        for k in range(0, len(h), ROUND):
            some = h[k : k + ROUND]
            wide = np.stack([_spread(some, w) for w in range(words)], axis=1)
            bits = np.unpackbits(wide.view(np.uint8).reshape(len(some), 8 * words), axis=1, bitorder="little")
            for j in range(0, len(some), 255):  # so many ones fit a byte
                ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int, words: int = 1) -> DataFrame:
    """(doc_id, fp binary little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, size, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


def _cuts(width: int, blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block."""
    at = [width * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _placed(words: int, width: int, radius: int):
    """Each fingerprint once per table and block, with the place's number as key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64 if width == 64 else np.uint32).reshape(len(b), -1)
            for t in range(raw.shape[1]):
                for k, (low, bits) in enumerate(_cuts(width, radius + 1)):
                    value = (raw[:, t].astype(np.uint64) >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                    key = (value.astype(np.int64) << 8) | (t * (radius + 1) + k)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], ["key", "fp"])

    return run


def _linked(words: int, width: int, radius: int, most: int | None):
    """Links of the fingerprints that share a key, as a forest: (a, b) of fingerprints."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, start, count = np.unique(keys, return_index=True, return_counts=True)
        keep = np.repeat(count > 1, count)  # keys come sorted
        keys, fps = keys[keep], fps[keep]
        if not len(keys):
            return
        # one code for each row: the place first, then the other bits
        place, cuts = keys & 255, _cuts(width, radius + 1)
        codes, same = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint64)
        parts = fps.view(np.uint64 if width == 64 else np.uint32).reshape(len(fps), -1)
        for p in np.unique(place):
            low, bits = cuts[p % (radius + 1)]
            at = place == p
            x = parts[at, p // (radius + 1)].astype(np.uint64)
            turn, full = low + bits, (1 << width) - 1
            codes[at] = ((x << np.uint64(width - turn)) | (x >> np.uint64(turn))) & np.uint64(full) if turn < width else x
            same[at] = full ^ ((1 << (width - bits)) - 1)
        out_a, out_b = [], []
        for p in np.unique(place):
            at = np.flatnonzero(place == p)
            at = at[np.argsort(grayindex.gray_rank(codes[at]), kind="stable")]
            mine, parent = fps[at], np.arange(len(at))
            for i, j in grayindex.GrayIndex(codes[at]).pairs(radius, same[at[0]]):
                if most is not None:
                    near = np.bitwise_count(mine[i] ^ mine[j]).sum(axis=1, dtype=np.int64) <= most
                    i, j = i[near], j[near]
                parent = grayindex.join_sets(parent, i, j)
            child = np.flatnonzero(parent != np.arange(len(parent)))
            out_a += [x.tobytes() for x in mine[child]]
            out_b += [x.tobytes() for x in mine[parent[child]]]
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros((0, words), np.uint64)
        more_k, more_f, n = [], [], 0
        for b in batches:
            more_k.append(b.column(0).to_numpy())
            more_f.append(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(b), words))
            n += len(b)
            if n >= ROWS:
                keys, fps, more_k, more_f = np.concatenate([keys, *more_k]), np.concatenate([fps, *more_f]), [], []
                upto = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                yield from links(keys[:upto], fps[:upto])
                keys, fps = keys[upto:], fps[upto:]
                n = len(keys) // 2 if len(keys) >= ROWS else len(keys)  # a huge key is not copied again and again
        yield from links(np.concatenate([keys, *more_k]), np.concatenate([fps, *more_f]))

    return run


def near_groups(docs: DataFrame, size: int = 5, words: int = 8, radius: int = 2, most: int | None = 94, name: str = "simhash") -> DataFrame:
    """(doc_id, fp, component_id): every row of ``docs`` with the smallest doc_id it is linked to.

    ``size``: words of a shingle.  ``words``: 64-bit words of a fingerprint; 1 links whole
    fingerprints at ``radius`` or fewer differing bits and needs no ``most``; more are cut into
    32-bit tables, two texts meet if any table differs in at most ``radius`` bits, and link if at
    most ``most`` bits differ in all.  Texts of similarity 0.8 differ in 15 % of the bits on average.
    Null, empty and blank texts have fingerprint zero and link like any other; repeated rows and
    ties are one class; rows with a null doc_id get their class's smallest doc_id (null if it has
    none); an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    ws, width = Workspace(spark, name), 64 if words == 1 else 32
    rows = ws.save(fingerprints(docs, size, words), "rows")
    tune(spark)
    distinct = ws.save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    placed = distinct.select("fp").mapInArrow(_placed(words, width, radius), "key long, fp binary").repartition("key").sortWithinPartitions("key")
    edges = ws.save(placed.mapInArrow(_linked(words, width, radius, most), "a binary, b binary").distinct(), "edges")
    pairs = edges.select(_node("a", words).alias("a"), _node("b", words).alias("b"))
    cc = ws.save(connected_components(ws, pairs), "cc")
    named = distinct.withColumn("node", _node("fp", words)).join(cc, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = ws.save(named.join(least, "component").select(F.col("fp").alias("fp_"), "component_id"), "named")
    return rows.join(named, rows.fp == named.fp_, "left").select("doc_id", "fp", "component_id")


def _node(col: str, words: int) -> F.Column:
    """A fingerprint as a long: its own bits if they fit, else its hash."""
    return F.conv(_hex(col), 16, -10).cast("long") if words == 1 else F.xxhash64(col)


def _hex(col: str) -> F.Column:
    """A one-word fingerprint's digits, highest first."""
    return F.lower(F.concat(*[F.hex(F.substring(col, k, 1)) for k in range(8, 0, -1)]))


def _least_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The least of the set's numbers under each of ``n`` hashes; two sets agree in one with the chance of their Jaccard similarity."""
    odd, turn = (mixed(np.arange(k, k + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (1, 1 << 32))
    odd, low = odd | np.uint64(1), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(h), LEAST):
        x = h[k : k + LEAST, None] ^ turn
        x *= odd
        np.minimum(low, x.min(axis=0), out=low)
    return low


def _set_rows(docs: DataFrame, size: int, bands: int, width: int) -> DataFrame:
    """(doc_id, th, node, sketch): hash of the text, hash of its shingle set, and of that set's least hashes
    a 64-bit key for each band, whose last byte is the band's number, and a byte as a mark for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, low = [], []
            for t in b.column(2).to_pylist():
                h = shingle_set(t, size)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                low.append(_least_hashes(h, bands * width))
            low = mixed(np.array(low, np.uint64).reshape(len(b), bands, width))
            key = low[:, :, 0]
            for k in range(1, width):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, k])
            key = key << np.uint64(8) | np.arange(bands, dtype=np.uint64)
            marks = (low & np.uint64(255)).astype(np.uint8).reshape(len(b), bands * width)
            sketch = [k.tobytes() + m.tobytes() for k, m in zip(key, marks)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "th", "node", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, node long, sketch binary")


def _set_places(some: range, bands: int):
    """Each (node, group) once for each of these bands, with the band's key and the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            keys = np.frombuffer(b"".join(x[: 8 * bands] for x in raw), np.int64).reshape(len(b), bands)
            marks = pa.array([x[8 * bands :] for x in raw], pa.binary())
            for k in some:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, k].copy()), b.column(0), b.column(1), marks], ["key", "node", "grp", "marks"])

    return run


def _ranges(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j from ``first[i]`` to before ``end[i]``, some ``PAIRS`` at a time and one i at least."""
    upto = np.concatenate([[0], np.cumsum(end - first)])
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        n = end[a:b] - first[a:b]
        if n.any():
            yield np.repeat(np.arange(a, b), n), np.arange(upto[a], upto[b]) - np.repeat(upto[a:b] - first[a:b], n)
        a = b


def _ends(*columns: np.ndarray) -> np.ndarray:
    """For every row the end of the rows that have its values; equal rows come together."""
    last = np.append(np.any([c[1:] != c[:-1] for c in columns], axis=0), True)
    edge = np.flatnonzero(last) + 1
    return edge[np.cumsum(last) - last]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the pairs that make a spanning forest; earlier pairs go first."""
    parent, at, out = np.arange(n), np.arange(len(a)), []
    while len(at):
        ra, rb = parent[a[at]], parent[b[at]]
        differ = ra != rb
        at, ra, rb = at[differ], ra[differ], rb[differ]
        if not len(at):
            break
        # the first pair of every tree; the order is total, so these never close a ring
        _, first = np.unique(np.column_stack([ra, rb]).ravel(), return_index=True)
        first = np.unique(first // 2)
        out.append(at[first])
        parent = grayindex.join_sets(parent, ra[first], rb[first])
    return np.concatenate(out) if out else at


def _candidates(bands: int, width: int, most: int, every: bool):
    """Pairs (a, b) of nodes of other groups that share a key and differ in ``most`` marks at most: all of
    them with ``every``.

    Else each set, in the order of the marks that follow the band's, is compared with the next ``NEXT`` of
    its key: these are all in a key of few rows.  Of a key of more rows the nearest of these pairs that hold
    its nodes together follow, and a row (key, null): it has to be looked at again.
    """

    def links(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, count = np.unique(keys, return_counts=True)
        keep = np.repeat(count > 1, count)  # keys come sorted
        keys, ids, marks = keys[keep], ids[keep], marks[keep]
        if not len(keys):
            return
        if every:
            order = np.lexsort([ids[:, 1], keys])
        else:
            after = ((keys & 255) * width + width)[:, None] + np.arange(8)
            order = np.lexsort([np.take_along_axis(marks, after % marks.shape[1], axis=1).view(np.uint64)[:, 0], keys])
        keys, node, group, marks = keys[order], ids[order, 0], ids[order, 1], marks[order]
        end, at = _ends(keys), np.arange(1, len(keys) + 1)
        crowded = (end - np.searchsorted(keys, keys) > NEXT + 1) & (not every)
        best, held, n = np.zeros((3, 0), np.int64), [], 0

        def nearest() -> np.ndarray:
            x = np.concatenate([best, *held], axis=1)
            x = x[:, np.argsort(x[0], kind="stable")]
            return x[:, np.sort(_forest(len(keys), x[1], x[2]))]

        for i, j in _ranges(_ends(keys, group), end) if every else _ranges(at, np.minimum(at + NEXT, end)):
            far = (marks[i] != marks[j]).sum(axis=1)
            near = far <= most
            far, i, j = far[near], i[near], j[near]
            many = crowded[i]
            if many.any():
                held.append(np.stack([far[many], i[many], j[many]]))
                n += held[-1].shape[1]
                if n >= max(4 * PAIRS, best.shape[1]):
                    best, held, n = nearest(), [], 0
            if not many.all():
                yield _pair_batch(node[i[~many]], node[j[~many]])
        if crowded.any():
            best = nearest()
            yield _pair_batch(node[best[1]], node[best[2]])
            again = np.unique(keys[crowded])
            yield pa.RecordBatch.from_arrays([pa.array(again), pa.nulls(len(again), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, marks = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, bands * width), np.uint8)
        more, n = [], 0
        for b in batches:
            more.append((b.column(0).to_numpy(), np.column_stack([b.column(1).to_numpy(), b.column(2).to_numpy()]), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(b), bands * width)))
            n += len(b)
            if n >= ROWS:
                keys, ids, marks = (np.concatenate([x, *y]) for x, y in zip((keys, ids, marks), zip(*more)))
                more, upto = [], int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                yield from links(keys[:upto], ids[:upto], marks[:upto])
                keys, ids, marks = keys[upto:], ids[upto:], marks[upto:]
                n = len(keys) // 2 if len(keys) >= ROWS else len(keys)
        if more:
            keys, ids, marks = (np.concatenate([x, *y]) for x, y in zip((keys, ids, marks), zip(*more)))
        yield from links(keys, ids, marks)

    return run


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _verified(ws: Workspace, docs: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int, least: float, name: str) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose shingle sets have a Jaccard similarity of ``least`` or more."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = distinct.join(ends, "node").select("th", "node")
    texts = docs.select(F.xxhash64("text").alias("th"), "text").join(wanted.select("th"), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "h"])

    tune(docs.sparkSession)
    held = ws.save(wanted.join(texts, "th").select("node", "text").mapInArrow(sets, "node long, h binary"), f"{name}-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    two = pairs.join(held.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("h").alias("y")), "b").select("a", "b", "x", "y")
    out = ws.save(two.mapInArrow(run, "a long, b long"), name)
    ws.drop(f"{name}-sets")
    return out


def similar_groups(docs: DataFrame, size: int = 5, bands: int = 24, width: int = 5, most: int = 44, least: float = 0.8, name: str = "similar") -> DataFrame:
    """(doc_id, component_id): every row of ``docs`` with the smallest doc_id it is linked to.

    Two texts link if their sets of shingles of ``size`` words have a Jaccard similarity of ``least``
    or more, counted exactly.  Pairs to count are those that agree in all ``width`` least hashes of one
    of the ``bands`` (255 at most) and differ in at most ``most`` of all the hashes' marks: with the
    defaults a pair at 0.8 differs in 24 marks of 120 on average (deviation 4.4) and is counted with
    probability 0.9999, whatever the sets' sizes.  Sets with little in common share no key, so the time
    for a set does not grow with the table.

    A key of few sets has all its pairs counted; of a crowded one first the nearest pairs that hold its
    nodes together, and then every pair whose ends are still in two groups: a large group of near copies
    is one group by then, and only pairs that have to be told apart are left.
    Rows are treated as in :func:`near_groups`.
    """
    spark = docs.sparkSession
    tune(spark)
    ws = Workspace(spark, name)
    rows = ws.save(_set_rows(docs, size, bands, width), "rows")
    distinct = ws.save(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("th").alias("th"), F.min("sketch").alias("sketch")), "distinct")
    group, links, again = distinct.select("node", F.col("node").alias("grp"), "sketch"), None, None
    for step, every in (("near", False), ("all", True)):
        found = None
        for k in range(0, bands, TOGETHER):  # some bands at a time: their shuffle files go in between
            placed = group.mapInArrow(_set_places(range(k, min(k + TOGETHER, bands)), bands), "key long, node long, grp long, marks binary")
            if every:
                placed = placed.join(again, "key", "left_semi")
            placed = placed.repartition("key").sortWithinPartitions("key")
            some = ws.save(placed.mapInArrow(_candidates(bands, width, most, every), "a long, b long").distinct(), f"{step}-{k}")
            found = some if found is None else found.unionByName(some)
        if not every:
            again = ws.save(found.where("b is null").select(F.col("a").alias("key")), "again")
        found = found.where("b is not null").distinct()
        if links is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        tried = ws.save(found, f"{step}-pairs")
        good = _verified(ws, docs, distinct, tried, size, least, step)
        links = good if links is None else links.unionByName(good)
        cc = ws.save(connected_components(ws, links, f"{step}-steps"), f"{step}-cc")
        group = ws.save(distinct.join(cc, "node", "left").select("node", F.coalesce("component", "node").alias("grp"), "sketch"), f"{step}-groups")
        if again.isEmpty():
            break
    named = distinct.select("node", "low").join(group.select("node", "grp"), "node")
    least_id = named.groupBy("grp").agg(F.min("low").alias("component_id"))
    named = ws.save(named.join(least_id, "grp").select("node", "component_id"), "named")
    return rows.join(named, "node").select("doc_id", "component_id")


def simhash_documents(docs: DataFrame) -> DataFrame:
    """The contract's digest: 3-word shingles, 64 bits, at most 2 differing."""
    g = near_groups(docs, size=3, words=1, radius=2, most=None)
    return g.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id.

    Rows that repeat doc_id and text are one document; rows that share a doc_id stay or go together.
    """
    first = similar_groups(docs.select("doc_id", "text"), **how).where("doc_id <=> component_id").select("doc_id").distinct()
    d, name = aside(docs)
    kept = d.join(first, F.col(name["doc_id"]).eqNullSafe(F.col("doc_id")), "left_semi")
    return kept.dropDuplicates([name["doc_id"], name["text"]]).toDF(*docs.columns)
