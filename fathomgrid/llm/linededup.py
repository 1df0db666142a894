"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words.  Lines are ordered by (doc_id, line number); a line goes if
an earlier line has a Jaccard similarity of ``similarity`` or more with it.  Equal lines collapse to
the first of them before anything is joined (Spark combines them before its shuffle), so a line that
repeats everywhere is one row.

Words are ordered by rarity: by a table of hashed word counts over all lines (``SLOTS`` numbers, the
same size for any corpus), ties by hash.  Any one order gives exact results; rarity keeps the lists
short.  Two sets that similar share a word among the first few of either (prefix filter), at
positions that leave room for the overlap (positional filter), and are close in size (length filter).
A word that occurs once is in no list.  The list of a word that may be long is cut into chunks, and
every two chunks meet in a list of their own, so no list is larger than a task can hold.

Entries travel packed, a block of bytes for each bucket of words, so Spark moves blocks and not rows.
In a list a set only looks for *an* earlier partner, the oldest first and at most ``TRIES`` at a time
after a bitmap bound; pairs are verified on whole lines, and sets whose partners failed look further
in another round.  So families of near-equal lines cost no quadratic pair list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, aside, mixed, tune, word_hashes

SIMILARITY, LEAST_WORDS = 0.8, 1
#: Slots of the table of word counts, and slots of a part of it.
SLOTS, SLICE = 1 << 22, 1 << 16
#: Partners that a set proposes in a word's list in the first round; 64 times as many in each later one.
TRIES = 1
#: Lines whose words are sorted at once; entries of a list beyond which it is cut; entries after which a
#: task compares the lists that it has whole.
BATCH, LIST, ROWS = 4096, 20_000, 500_000
#: Bytes of an entry; bytes of a bucket, of a task's buckets, and of packed entries that a task gathers.
ENTRY, BUCKET, TASK, GATHERED = 52, 8 << 20, 64 << 20, 24 << 20
#: Ids of lines to verify up to which they are broadcast (some MB).
BROADCAST_IDS = 250_000
_LEFT = "word long, shape long, bits long, more_bits long, id long, place long, b long, asks boolean"
#: Bytes of text hashed at a time: bounds memory for lines of any length.
CHUNK = 1 << 22


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every word."""
    raw = "\n".join(map(str.lower, lines)).encode("utf-8", "replace")  # line by line: ASCII ones are quick
    start, h = word_hashes(raw)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    return np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate([[0], np.searchsorted(start, breaks), [len(start)]]))), h


def hashed_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every word of these lines, in order."""
    out, some, at, size = [], [], 0, 0
    for k, x in enumerate([*lines, None]):
        if some and (x is None or size + len(x) > CHUNK):
            row, h = _hashed(some)
            out.append((row + at, h))
            some, at, size = [], k, 0
        if x is not None and len(x) > CHUNK:  # one line in parts
            for j in range(0, len(w := x.lower().encode("utf-8", "replace").split()), 1 << 18):
                _, h = _hashed([b" ".join(w[j : j + (1 << 18)]).decode()])
                out.append((np.full(len(h), k), h))
            at = k + 1
        elif x is not None:
            some.append(x)
            size += len(x)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def word_set(line: str) -> set[bytes]:
    return set(line.lower().encode("utf-8", "replace").split())


def slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix_length(size, similarity: float):
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def jaccard_reaches(a: set, b: set, similarity: float) -> bool:
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _counts(similarity: float):
    """The table of word counts in slices, as packed numbers; the slice -1 has the number of entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, entries = np.zeros(SLOTS, np.uint32), 0
        for b in batches:
            row, h = hashed_words(b.column(0).to_pylist())
            np.add.at(total, slot(h), np.uint32(1))
            entries += int(prefix_length(np.bincount(row), similarity).sum())
        parts = [k for k in range(SLOTS // SLICE) if total[k * SLICE : (k + 1) * SLICE].any()]
        data = [total[k * SLICE : (k + 1) * SLICE].tobytes() for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array([*parts, -1], pa.int32()), pa.array([*data, entries.to_bytes(8, "little")], pa.binary())], ["slice", "n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices' sums as :func:`rank`, and the sum of the numbers of entries."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, n in zip(b.column(0).to_pylist(), b.column(1)):
            n = np.frombuffer(n.as_buffer(), np.int64 if k < 0 else np.uint32).astype(np.int64)
            total[k] = total[k] + n if k in total else n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x if k < 0 else rank(x)).tobytes() for k, x in total.items()], pa.binary())], ["slice", "n"])


def rank(counts: np.ndarray) -> np.ndarray:
    """Rarity in 256 steps, rarest first: 0 for a word that occurs once."""
    return np.minimum(255, np.ceil(np.log2(np.maximum(counts, 1)) * 6)).astype(np.uint8)


def chunks_of(steps: np.ndarray) -> np.ndarray:
    """Chunks that the lists of words of this rarity are cut into."""
    return np.ceil(2.0 ** (steps / 6.0) / LIST).astype(np.int64)


def sorted_sets(row: np.ndarray, h: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the distinct words of at most ``BATCH`` lines, in order, a line's rarest word first."""
    key = row.astype(np.uint64) << np.uint64(52) | rarity[slot(h)].astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)


def _listed(rarity, similarity: float, least: int, buckets: int):
    """Entries of the words of each line's prefix, packed by bucket: the list, a parity bitmap of the
    whole set, the line's id and place, size and position."""

    def entries(b: pa.RecordBatch, steps: np.ndarray) -> list[np.ndarray]:
        row, key = sorted_sets(*hashed_words(b.column(3).to_pylist()), steps)
        size = np.bincount(row, minlength=len(b))
        start = np.cumsum(size) - size
        bits = np.zeros((2, len(b)), np.uint64)
        some = np.flatnonzero(size)
        if len(some):
            one, half = np.uint64(1) << (key & np.uint64(63)), (key & np.uint64(64)) == 0
            bits[0, some] = np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0)), start[some])
            bits[1, some] = np.bitwise_xor.reduceat(np.where(half, np.uint64(0), one), start[some])
        pos = np.arange(len(row)) - start[row]
        keep = (size[row] >= least) & (pos < prefix_length(size, similarity)[row]) & (key >> np.uint64(44) > 0)
        row, pos, key = row[keep], pos[keep], key[keep]
        ids, doc, line = (b.column(k).to_numpy() for k in range(3))
        # a long list in chunks: one's own chunk meets every other
        chunks = chunks_of((key >> np.uint64(44)).astype(np.float64))
        many = np.repeat(np.arange(len(key)), chunks)
        key, row, pos, chunks = key[many], row[many], pos[many], chunks[many]
        other = np.arange(len(many)) - np.searchsorted(many, many)
        own = (mixed(ids[row].astype(np.uint64)) % chunks.astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(own, other), np.maximum(own, other)
        key = mixed(key + (low * 1_000_003 + high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return [key, bits[0, row], bits[1, row], ids[row], doc[row], line[row].astype(np.int32), size[row].astype(np.uint32), pos.astype(np.uint32)]

    def packed(held: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held)]
        bucket = (cols[0] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, cols = bucket[order], [c[order] for c in cols]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
        data = [b"".join([c[lo:hi].tobytes() for c in cols]) for lo, hi in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(data, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, held, n = rarity.value, [], 0
        for whole in batches:
            for lo in range(0, len(whole), BATCH):
                held.append(entries(whole.slice(lo, BATCH), steps))
                n += ENTRY * len(held[-1][0])
                if n >= GATHERED:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return run


def unpacked(blocks: list[bytes]) -> list[np.ndarray]:
    """Columns of packed entries, in the order of lists and places."""
    out = []
    for data in blocks:
        n, at, cols = len(data) // ENTRY, 0, []
        for kind in ("<u8", "<u8", "<u8", "<i8", "<i8", "<i4", "<u4", "<u4"):
            cols.append(np.frombuffer(data, kind, n, at))
            at += cols[-1].nbytes
        out.append(cols)
    cols = [np.concatenate(c) for c in zip(*out)]
    # most lists have one entry: these fall away before the rest is ordered
    order = np.argsort(cols[0])
    same = np.diff(cols[0][order]) == 0
    order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    some = [cols[k][order] for k in (3, 5, 4, 0)]
    order = order[np.lexsort(some)]
    return [c[order] for c in cols]


def candidates(word, shape, bits, asks, similarity: float, skip: int, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, more) over whole lists, each in the order of places: entry i asks for an earlier j that
    passes the filters, from its candidate number ``skip`` on; more: the list may hold others for i."""
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    start = np.repeat(first, np.diff(np.append(first, len(word))))
    index, size, pos = np.arange(len(word)) - start, shape >> 32, shape & 0xFFFFFFFF
    found, out = np.zeros(len(word), np.int32), []
    active = np.flatnonzero(asks & (index > 0))
    for r in count():
        active = active[index[active] > r]
        if not len(active):
            break
        j = start[active] + r
        a, b = size[active], size[j]
        overlap = np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
        ok = np.flatnonzero((np.minimum(a - pos[active], b - pos[j]) >= overlap) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9))
        i, j = active[ok], j[ok]
        near = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in bits) <= (a + b - 2 * overlap)[ok]
        i, j = i[near], j[near]
        found[i] += 1
        now = (found[i] > skip) & (found[i] <= skip + tries)
        out.append((i[now], j[now]))
        if len(i):
            active = active[found[active] <= skip + tries]
    i, j = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))
    return i, j, found[i] > skip + tries


def _pairs(cols: list[np.ndarray], similarity: float, skip: int, tries: int) -> pa.RecordBatch:
    """Pairs: line ``id`` may equal the earlier line ``b``.  Lists that may hold further partners for some
    of their lines (``asks``) follow whole, ``b`` being null and ``place`` their order."""
    word, shape, *bits, ids, asks = cols
    i, j, more = candidates(word, shape, [x.view(np.uint64) for x in bits], asks, similarity, skip, tries)
    ask = np.zeros(len(word), bool)
    ask[i[more]] = True
    left = np.flatnonzero(np.isin(word, word[ask])) if ask.any() else np.zeros(0, np.int64)
    at = np.concatenate([i, left])
    b = np.concatenate([ids[j], np.zeros(len(left), np.int64)])
    order = np.concatenate([np.zeros(len(i), np.int64), left])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c[at].view(np.int64)) for c in (word, shape, *bits, ids)), pa.array(order), pa.array(b, mask=np.arange(len(at)) >= len(i)), pa.array(np.concatenate([more, ask[left]]))],
        ["word", "shape", "bits", "more_bits", "id", "place", "b", "asks"],
    )


def _first_round(similarity: float, tries: int):
    """The pairs of every bucket's lists; buckets come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks = None, []

        def done() -> pa.RecordBatch:
            word, one, two, ids, _, _, size, pos = unpacked(blocks)
            blocks.clear()
            return _pairs([word, size.astype(np.int64) << 32 | pos, one, two, ids, np.ones(len(word), bool)], similarity, 0, tries)

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != bucket and blocks:
                    yield done()
                bucket = k
                blocks.append(data)
        if blocks:
            yield done()

    return run


def _later_round(similarity: float, skip: int, tries: int):
    """The same for lists that are left, which come in order, a row for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(6)])
            n += len(b)
            if n >= ROWS:
                cols = [np.concatenate(c) for c in zip(*held)]
                upto = len(cols[0]) - int(np.argmax(cols[0][::-1] != cols[0][-1])) if cols[0][0] != cols[0][-1] else 0  # the last list may go on
                if upto:
                    yield _pairs([c[:upto] for c in cols], similarity, skip, tries)
                held = [[c[upto:] for c in cols]]
                n = (len(cols[0]) - upto) // 2
        if held and any(len(c[0]) for c in held):
            yield _pairs([np.concatenate(c) for c in zip(*held)], similarity, skip, tries)

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard_reaches(word_set(x), word_set(y), similarity) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield b.select([0]).filter(pa.array(ok, pa.bool_()))

    return run


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text) of the lines that have a word."""
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(F.ltrim("text", F.lit(" \t\n\v\f\r")) != "")


def _place(docs: DataFrame) -> tuple[F.Column, F.Column, F.Column]:
    """(place, doc_id, line): a line's place as one number, and what it says of the column ``place``.

    One number is combined in place before a shuffle.  It is a long if the range of ids and lines lets
    it be, else a decimal.  Texts are read only if ids are so far apart that the lines' number matters.
    """
    known, bits = docs.where("doc_id is not null"), 31
    lo, hi = known.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if lo is not None and (hi - lo).bit_length() + bits > 62:
        text = F.coalesce("text", F.lit(""))
        bits = known.agg(F.max(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))).first()[0].bit_length()
    if lo is None or (hi - lo).bit_length() + bits <= 62:
        lo = lo or 0
        place = F.shiftleft(F.col("doc_id") - F.lit(lo).cast("long"), bits) + F.col("line")
        return place, F.shiftright("place", bits) + F.lit(lo).cast("long"), F.col("place").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    wide = F.lit(1 << 31).cast("decimal(10,0)")
    line = F.pmod(F.col("place"), F.lit(1 << 31)).cast("int")
    return F.col("doc_id").cast("decimal(20,0)") * wide + F.col("line"), F.floor((F.col("place") - line) / F.lit(1 << 31)).cast("long"), line


def _name() -> list[F.Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g")]


def _only(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines with these ids; the ids are broadcast where they are few enough, else both are shuffled."""
    return lines.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def later_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, name: str = "lines") -> tuple[Workspace, DataFrame]:
    """(doc_id, drop: sorted line numbers from 0) of the lines to remove; also the workspace.

    Lines without a word always stay, as do the lines of rows whose doc_id is null.  Lines of fewer
    than ``least_words`` distinct words go only if an earlier line has the same text.  Rows that
    repeat a doc_id count as one document there.
    """
    spark = docs.sparkSession
    tune(spark)
    ws = Workspace(spark, name)
    place, doc_id, line = _place(docs)
    first = exploded(docs).groupBy("text").agg(F.min(place).alias("place"), F.count("*").alias("times")).select("text", doc_id.alias("doc_id"), line.alias("line"), "times", *_name())
    lines = ws.save(first.withColumn("id", F.monotonically_increasing_id()), "first")
    parts = lines.select("text").mapInArrow(_counts(similarity), "slice int, n binary").repartition("slice").mapInArrow(_added, "slice int, n binary").toArrow()  # SLOTS bytes
    steps, entries = np.zeros(SLOTS, np.uint8), 0
    for k, n in zip(parts["slice"].to_pylist(), parts["n"]):
        if k < 0:
            entries = int(np.frombuffer(n.as_buffer(), np.int64)[0])
        else:
            steps[k * SLICE : (k + 1) * SLICE] = np.frombuffer(n.as_buffer(), np.uint8)
    rarity = spark.sparkContext.broadcast(steps)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ENTRY * entries // TASK + 1)
    buckets = max(8 * tasks, ENTRY * entries // BUCKET + 1)
    rows = lines.select("id", "doc_id", "line", "text").mapInArrow(_listed(rarity, similarity, least_words, buckets), "bucket int, data binary")
    found = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_first_round(similarity, TRIES), _LEFT)
    hits, step, skip, tries = None, 0, 0, TRIES
    while True:
        out = ws.save(found, f"pairs-{step}")
        pairs = ws.save(out.where("b is not null").select(F.col("id").alias("a"), "b").distinct(), f"unique-{step}")
        whole = _only(lines.select("id", "text"), pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        x, y = whole.select(F.col("id").alias("a"), F.col("text").alias("x")), whole.select(F.col("id").alias("b"), F.col("text").alias("y"))
        near = pairs.join(x, "a").join(y, "b").select("a", "x", "y")
        hit = ws.save(near.mapInArrow(_verified(similarity), "a long").distinct(), f"hit-{step}")
        hits = hit if hits is None else hits.unionByName(hit)
        # only lists in which some line still asks go on; lines that have gone ask no more
        late, left = hit.select(F.col("a").alias("id")), out.where("b is null").drop("b")
        open_ = ws.save(left.where("asks").select("word", "id").join(late, "id", "left_anti").select("word").distinct(), f"open-{step}")
        if open_.isEmpty():
            break
        left = left.join(open_.hint("shuffle_hash"), "word", "left_semi").join(late.withColumn("late", F.lit(True)), "id", "left")
        rows = left.select("word", "shape", "bits", "more_bits", "id", "place", (F.col("asks") & F.col("late").isNull()).alias("asks"))
        if step:
            ws.drop(f"pairs-{step - 1}")
        ws.drop(f"unique-{step}")
        step, skip, tries = step + 1, skip + tries, 64 * tries
        rows = rows.repartition("word").sortWithinPartitions("word", "place").select("word", "shape", "bits", "more_bits", "id", "asks")
        found = rows.mapInArrow(_later_round(similarity, skip, tries), _LEFT)
    for k in (step - 1, step):
        ws.drop(f"pairs-{k}")
    # texts that occur again or have an earlier partner: of all others every line stays
    late = hits.distinct().select(F.col("a").alias("id"), F.lit(True).alias("late"))
    state = lines.select("id", "h", "g", "times", F.struct("doc_id", "line").alias("at")).join(late, "id", "left").where("times > 1 or late").drop("id", "times")
    gone = exploded(docs).select(*_name(), "doc_id", "line").join(state.hint("shuffle_hash"), ["h", "g"]).where((F.struct("doc_id", "line") > F.col("at")) | F.coalesce("late", F.lit(False)))
    gone = ws.save(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("drop")), "gone")
    ws.drop("first")
    rarity.unpersist()
    return ws, gone


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, name: str = "lines") -> DataFrame:
    """``docs`` with their texts short of the later lines (and ``n_chars`` following, where there is one),
    and a column ``removed`` with the numbers of the lines that went.

    Null texts stay null, empty ones empty; an empty table gives no rows.
    """
    out, cols = _without(docs, similarity, least_words, name)
    return out.select(*cols, "gone").toDF(*docs.columns, "removed")


def _without(docs: DataFrame, similarity: float, least_words: int, name: str) -> tuple[DataFrame, list[str]]:
    """``docs`` under names of :func:`aside`, texts changed, with ``gone``; and those names."""
    _, gone = later_lines(docs.select("doc_id", "text"), similarity, least_words, name)
    d, of = aside(docs)
    key = F.col(of["doc_id"])
    # the same plan at any size; rows without an id, however many, stay where they are
    known = d.where(key.isNotNull()).join(gone.hint("shuffle_hash"), key.cast("long") == F.col("doc_id"), "left").drop("doc_id")
    d = known.unionByName(d.where(key.isNull()).withColumn("drop", F.lit(None).cast("array<int>")))
    lines = F.split(of["text"], "\n")
    kept = F.filter(lines, lambda _, k: ~F.array_contains("drop", k))
    put = {of["text"]: F.when(F.col("drop").isNull(), F.col(of["text"])).otherwise(F.array_join(kept, "\n"))}
    if "n_chars" in of:
        length = F.length(put[of["text"]]).cast(docs.schema["n_chars"].dataType)
        put[of["n_chars"]] = F.when(F.col("drop").isNull(), F.col(of["n_chars"])).otherwise(length)
    return d.withColumns(put | {"gone": F.coalesce("drop", F.array().cast("array<int>"))}), list(of.values())


def keep_documents(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """A pipeline stage: line-deduplicated ``docs``; documents that had lines and have none left go."""
    out, cols = _without(docs, similarity, least_words, "lines")
    text = F.col(cols[docs.columns.index("text")])
    return out.where((F.size("gone") == 0) | text.rlike(r"[^\x20\x09-\x0D]")).select(cols).toDF(*docs.columns)


def line_documents(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, lines, removed (line numbers from 0), text_crc32 of the text that stays."""
    d = dedup_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")))
    return d.select("doc_id", "lines", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
