"""Mixing sources to target weights: capped water-filling, DataFrame functions only.

Targets: every source gets ``lambda * weight`` words, but at most ``max_epochs`` times its size; the
excess goes to the others by weight until nobody is above.  With sources in the order of
``cap / weight`` the clamped ones are a prefix, so running sums give lambda without iterating.

Repetitions: a source with target ``e`` times its size repeats every document ``floor(e)`` times and
then takes documents in a seeded order until the target is met; the document at the cut is taken in
part.  The cut is found in two passes (totals of hash buckets, then rows of one bucket per source),
so no source, however hot, is sorted or summed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, aside

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = "1"
#: Sources up to which the per-source table is broadcast (at most some MB); beyond, Spark joins it by key.
BROADCAST_SOURCES = 50_000
#: Rows of a source that the bucket at its cut should hold: buckets grow finer with the table.
ROWS = 100_000


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(per_source: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with ``weight`` and ``target``; as many rows as sources.

    Weights repeat over the sources in code-point order, null last.  A source of size 0 gets 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("weight", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("weights", F.sum("weight").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    s = s.withColumn("lambda", F.min(free).over(whole)["level"])  # the level at the first source that is not clamped
    target = F.when(F.col("lambda").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("lambda") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _by_source(left: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """Joins on ``source``, null included; ``n``: how many sources there are."""
    names = [c for c in small.columns if c != "source"]
    right = small.select(F.col("source").alias("_source"), *names)
    return left.join(F.broadcast(right) if n <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED, name: str = "mix") -> DataFrame:
    """(doc_id, source, size, h, source_size, target, whole, part): a row for each document.

    The mix holds a document ``whole`` times and then ``part`` words more.  Null texts and texts
    without words have size 0 and are taken 0 words; a null source is a source; rows that agree in
    doc_id and size (repeated rows) at the cut share what is left evenly; an empty table gives no
    rows.  The order depends on ``seed`` and doc_id alone, so reruns agree.
    """
    ws = Workspace(docs.sparkSession, name)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = ws.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h")), "sizes")
    n, digits = rows.count(), 3
    while 16**digits * ROWS < n and digits < 8:
        digits += 1
    bucket = F.substring("h", 1, digits)
    buckets = ws.save(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "buckets")
    targets = ws.save(water_fill(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs), "targets")
    n = targets.count()
    # whole repetitions, and the words still missing
    e = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", e).withColumn("missing", F.round(F.col("target") - e * F.col("source_size")).cast("long"))
    # first pass: the bucket in which each source's order reaches what is missing
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = _by_source(buckets.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))), targets.select("source", "missing"), n)
    at = at.where("before <= missing and missing < before + n").select("source", F.col("bucket").alias("cut_bucket"), (F.col("missing") - F.col("before")).alias("within"))
    # second pass: the row in that bucket
    near = _by_source(rows, at, n).where(bucket == F.col("cut_bucket"))
    near = near.groupBy("source", "within", "h", "doc_id", "size").agg(F.count("*").alias("copies"))
    up = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(up), F.lit(0)))
    cut = near.where("before <= within and within < before + size * copies").select(
        "source", F.col("h").alias("cut_h"), F.coalesce("doc_id", F.lit(0)).alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("within") - F.col("before")) / F.col("copies")).cast("long").alias("share")
    )
    tell = targets.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "weight")
    out = _by_source(rows, ws.save(tell, "tell"), n)
    mine, edge = F.struct("h", F.coalesce("doc_id", F.lit(0)), "size"), F.struct("cut_h", "cut_id", "cut_size")
    part = F.when(F.col("missing") <= 0, 0).when(F.col("cut_h").isNull() | (mine < edge), F.col("size")).when(mine == edge, F.col("share")).otherwise(0)
    return out.select("doc_id", "source", "size", "h", "source_size", "target", "whole", part.cast("long").alias("part"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    m = mix(docs.select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: ``docs`` with every row as often as the mix takes it.

    The document at a source's cut comes once more with its first words only (and ``n_chars``, where
    there is such a column, follows); everything else is a whole copy.  Null texts, texts without words and
    documents that the mix takes no word of are left out; repeated rows come each as often as one of them;
    other columns pass through, whatever their names; an empty table gives no rows.
    """
    m = mix(docs.select("doc_id", "source", "text"), **how).groupBy("doc_id", "source", "size").agg(F.max("whole").alias("whole"), F.max("part").alias("part"))
    m = m.where("whole > 0 or part > 0")
    d, name = aside(docs)
    text = F.col(name["text"])
    d = d.withColumn("n", word_count(text))
    d = d.join(m, F.col(name["doc_id"]).eqNullSafe(F.col("doc_id")) & F.col(name["source"]).eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")))
    copies = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("take", F.explode(copies))
    piece = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("take").cast("int")), "")
    cut = F.col("take") < F.col("size")
    put = {name["text"]: F.when(cut, piece).otherwise(text)}
    if "n_chars" in name:
        put[name["n_chars"]] = F.when(cut, F.length(piece).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(name["n_chars"]))
    return d.withColumns(put).select(*name.values()).toDF(*docs.columns)


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level,
             row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
f AS (SELECT min(place) AS place FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l JOIN f USING (place)) * weight), cap) AS target FROM l),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT d.doc_id, d.size, d.source, d.h, count(*) AS copies FROM d GROUP BY ALL),
c AS (SELECT g.*, m.source_size, m.target, m.whole, round(m.target - m.whole * m.source_size)::BIGINT
        - coalesce(sum(g.size * g.copies) OVER (PARTITION BY g.source ORDER BY g.h, g.doc_id, g.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM g JOIN m ON g.source IS NOT DISTINCT FROM m.source),
p AS (SELECT *, CASE WHEN room <= 0 THEN 0 WHEN room >= size * copies THEN size ELSE room // copies END AS part FROM c)
SELECT d.doc_id, d.size, p.source_size, p.target, (p.whole * p.size + p.part)::BIGINT AS taken
FROM d JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.size = p.size AND d.source IS NOT DISTINCT FROM p.source
"""
