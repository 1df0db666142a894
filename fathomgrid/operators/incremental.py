"""Incremental indexing: what a batch of changes means for files, edges and the index's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .session import first_candidate

# Changed paths beyond which everything is scanned; largest file; age at which a lock is stale.
MOST_PATHS, MOST_BYTES, LOCK_SECONDS = 500, 1_000_000, 6 * 3600
# A quiet time that ends a batch of changes, and its longest duration, in seconds.
QUIET, LONGEST = 0.5, 2.0


def coalesce(changes: DataFrame) -> DataFrame:
    """The last change of each path of changes(path, op, ts, seq)."""
    return first_candidate(changes, ["path"], [F.desc("ts"), F.desc("seq")])


def batches(changes: DataFrame, quiet: float = QUIET, longest: float = LONGEST) -> DataFrame:
    """changes(key, ts, seq) with ``batch``: a batch ends after a quiet time, or when it has lasted the longest time.

    Quiet times cut a key's changes into runs; a run is cut again at each change that comes ``longest``
    after the batch's first.  The second cut depends on the first change of each batch, so a run is folded
    in order; a run's changes are one burst of one key.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy("ts", "seq")
    c = changes.withColumn("us", us).withColumn("new", F.when(F.col("us") - F.lag("us").over(w) <= int(quiet * 1e6), 0).otherwise(1))
    c = c.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("us", "seq")))
    kind = "array<struct<us:bigint,seq:bigint,batch:bigint,first:bigint>>"
    start = F.array().cast(kind)

    def step(a, x):
        last = F.element_at(a, -1)
        fresh = (F.size(a) == 0) | (x["us"] - last["first"] >= int(longest * 1e6))
        row = F.struct(x["us"].alias("us"), x["seq"].cast("long").alias("seq"), F.when(F.size(a) == 0, F.lit(0)).otherwise(last["batch"] + fresh.cast("int")).cast("long").alias("batch"), F.when(fresh, x["us"]).otherwise(last["first"]).alias("first"))
        return F.concat(a, F.array(row)).cast(kind)

    g = c.groupBy("key", "run").agg(F.aggregate(rows, start, step).alias("r"))
    return g.select("key", "run", F.inline("r")).select("key", "run", "batch", "seq", F.timestamp_micros("us").alias("ts"))


def dirty_plan(changed: DataFrame, present: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, state) of changed(path): ignored, unsupported, deleted, changed; all of them ``scan`` if there are too
    many or one is a folder.  ``present(path, size, folder)`` is what lies there now, ``previous(path)`` the index.
    """
    paths = changed.select("path").where("path is not null and path <> ''").distinct()
    c = paths.join(present.select("path", "size", "folder", F.lit(True).alias("here")), "path", "left").join(previous.select("path").distinct().withColumn("known", F.lit(True)), "path", "left")
    skip, outside = tx.ignored(F.col("path")), F.startswith("path", F.lit("../"))
    state = F.when(skip, "ignored").when(outside, "unsupported").when(F.col("here").isNull(), F.when(F.col("known"), "deleted").otherwise("unsupported"))
    state = state.when((F.col("size") > MOST_BYTES) | (tx.language_of(F.col("path")) == "unknown"), "unsupported").otherwise("changed")
    whole = paths.agg(F.count("*").alias("n")).crossJoin(c.agg(F.coalesce(F.max(F.col("folder") & ~skip), F.lit(False)).alias("folders")))  # one row
    return c.crossJoin(F.broadcast(whole)).select("path", F.when((F.col("n") > MOST_PATHS) | F.col("folders"), "scan").otherwise(state).alias("state"))


def expand_dirty(dirty: DataFrame, imports: DataFrame) -> DataFrame:
    """(id): the dirty files and, one hop away, the files that import or pass them on; imports(from_id, to_id)."""
    near = imports.join(dirty.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return dirty.select("id").unionByName(near).distinct()


def rebuild_edges(old: DataFrame, new: DataFrame, dirty: DataFrame) -> DataFrame:
    """``old`` edges that touch no dirty node(id), and the ``new`` ones."""
    d = dirty.select("id").distinct()
    kept = old.join(d.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(d.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return kept.select(old.columns).unionByName(new)


def write_buffer(writes: DataFrame) -> DataFrame:
    """One row for each edge of writes(from_id, to_id, type, confidence, evidence, seq): the last confidence, all evidence."""
    key = ["from_id", "to_id", "type"]
    return writes.groupBy(*key).agg(F.max_by("confidence", "seq").alias("confidence"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def run_state(events: DataFrame) -> DataFrame:
    """(run, state) of events(run, event, seq): indexing, committing, completed, failed; interrupted if a later run began before it ended."""
    last = first_candidate(events, ["run"], [F.desc("seq")]).select("run", "event", "seq")
    first = events.groupBy("run").agg(F.min("seq").alias("began"))
    ended = last.join(first, "run").crossJoin(F.broadcast(first.agg(F.max("began").alias("later"))))  # one row
    open_ = F.col("event").isin("indexing", "committing")
    return ended.select("run", F.when(open_ & (F.col("later") > F.col("seq")), "interrupted").otherwise(F.col("event")).alias("state"))


def lock_state(held_since: Column, now: Column) -> Column:
    """free, held, or stale after six hours."""
    age = F.unix_timestamp(now) - F.unix_timestamp(held_since)
    return F.when(held_since.isNull(), "free").when(age > LOCK_SECONDS, "stale").otherwise("held")


def freshness(index: DataFrame) -> DataFrame:
    """``index(exists, indexing, watch_status, watch_error, changed, indexed_commit, commit)`` with ``status``: missing, rebuilding, failed, stale or fresh."""
    failed = (F.col("watch_status") == "failed") | F.coalesce(F.col("watch_error") != "", F.lit(False))
    stale = (F.col("changed") > 0) | F.coalesce(F.col("indexed_commit") != F.col("commit"), F.lit(False))
    state = F.when(~F.col("exists"), "missing").when(F.col("indexing"), "rebuilding").when(F.coalesce(failed, F.lit(False)), "failed").when(stale, "stale").otherwise("fresh")
    return index.withColumn("status", state)


def pending(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, state): changes(path, seq) that no finished run has taken: in flight if a run(upto, done) has them, else pending."""
    done = runs.where("done").agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("done_upto"))
    taken = runs.where("not done").agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("taken_upto"))
    last = changes.groupBy("path").agg(F.max("seq").alias("seq")).crossJoin(F.broadcast(done.crossJoin(taken)))  # one row
    return last.where("seq > done_upto").select("path", F.when(F.col("seq") <= F.col("taken_upto"), "in_flight").otherwise("pending").alias("state"))
