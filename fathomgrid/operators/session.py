"""Session ledger, memory, packing and incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Spans that one task of ``nested`` sorts on average; 8 times as many where that takes over ``SHARES`` tasks, up to which Spark
#: deals rows out without sorting them.
SPANS, SHARES = 1 << 18, 200


def delta(seen: DataFrame, candidates: DataFrame) -> DataFrame:
    """(session, total, repeated, novelty, penalty) of candidates(session, item) against seen ones."""
    s = seen.select("session", "item").distinct().withColumn("old", F.lit(1))
    c = candidates.select("session", "item").distinct().join(s, ["session", "item"], "left")
    g = c.groupBy("session").agg(F.count("*").alias("total"), F.count("old").alias("repeated"))
    return g.select("session", "total", "repeated", F.round(F.greatest(F.lit(0.0), 1 - F.col("repeated") / F.col("total")), 6).alias("novelty"), F.round(F.col("repeated") * 0.08, 2).alias("penalty"))


def compact(ledger: DataFrame) -> DataFrame:
    """(session, items, entries, tokens) of ledger(session, item, tokens)."""
    return ledger.groupBy("session").agg(F.countDistinct("item").alias("items"), F.count("*").alias("entries"), F.sum("tokens").alias("tokens"))


def decay(memories: DataFrame, changed: DataFrame) -> DataFrame:
    """memories(id, scope, confidence) after changed(scope): over .5 less .3, else stale."""
    m = memories.join(changed.select("scope", F.lit(True).alias("hit")).distinct(), "scope", "left")
    hit = F.coalesce("hit", F.lit(False))
    return m.select("id", "scope", F.when(hit & (F.col("confidence") > 0.5), F.round(F.greatest(F.lit(0.0), F.col("confidence") - 0.3), 6)).otherwise(F.col("confidence")).alias("confidence"), (hit & (F.col("confidence") <= 0.5)).alias("stale"))


def pack_prefix(items: DataFrame, budget: int, key: list[str], order: list) -> DataFrame:
    """Items while their running sum of tokens stays within the budget; stops at the first overflow."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def pack_greedy(items: DataFrame, budget: int, key: list[str], order: str, id_: str) -> DataFrame:
    """(key, taken, used): an item that does not fit is skipped and packing goes on.

    The fold runs over a key's sorted array; a key's items are one pack's candidates, some hundreds.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(id_), F.col("tokens"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), (s["taken"] + 1).alias("taken"))).otherwise(s)
    return items.groupBy(*key).agg(F.aggregate(rows, start, step).alias("p")).select(*key, "p.taken", "p.used")


def debounce(changes: DataFrame, gap_seconds: int) -> DataFrame:
    """(path, first, last, n): runs of changes with no pause over the gap."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    at = F.col("ts").cast("timestamp")
    new = F.when(F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) <= gap_seconds * 1_000_000, 0).otherwise(1)
    runs = changes.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("path", "run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of files(path, hash): new, changed, deleted; unchanged ones are left out."""
    a, b = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def containment(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(item, owner): the smallest outer(file, owner, lo, hi) around each inner(file, item, lo, hi)."""
    o = outer.select("file", "owner", F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    w = Window.partitionBy("file", "item").orderBy(F.col("ohi") - F.col("olo"), "owner")
    return inner.join(o, "file").where("olo <= lo and hi <= ohi").withColumn("k", F.row_number().over(w)).where("k = 1").select("file", "item", "owner")


def nested(spans: DataFrame) -> DataFrame:
    """(file, item, owner): the smallest span of another item around a span of each item of spans(file, item, hi).

    All spans begin alike, so the longer of two holds the shorter: one walk from the longest down meets every owner, no pairs
    are formed. A task's share is bounded whatever the table's size; for that the spans are counted at once.
    """
    n = spans.count()
    tasks = max(min(n // SPANS + 1, SHARES), n // (8 * SPANS) + 1)
    whole = spans.where("file is not null and item is not null and hi is not null").select("file", "item", "hi").repartition(tasks, "file")
    down = Window.partitionBy("file").orderBy(F.desc("hi"), F.desc("item"))
    after = F.lag("item").over(down)
    walked = whole.withColumn("turn", F.when(after != F.col("item"), after))
    walked = walked.withColumn("next", F.last("turn", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    equal = Window.partitionBy("file").orderBy(F.desc("hi")).rangeBetween(Window.unboundedPreceding, 0)
    walked = walked.withColumn("least", F.min(F.struct("hi", "item")).over(equal)["item"])
    owner = F.when(F.col("least") != F.col("item"), F.col("least")).otherwise(F.col("next"))
    return walked.groupBy("file", "item").agg(F.min_by(owner, "hi").alias("owner")).where("owner is not null")


def first_candidate(candidates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The best-ranked candidate of each key: what import, call and target resolution end in."""
    return candidates.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("k = 1").drop("k")
