"""Ranked retrieval: BM25, nearest neighbours, rank fusion, penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, RRF_K = 1.2, 0.75, 60
WEIGHTS = {"keyword": 0.20, "vector": 0.30, "graph": 0.25}
# Words that a relaxed query leaves out.
STOP = frozenset("a an and are as before by class does for from how in into is it logic of on or that the this to where with".split())


def query_terms(query: str, relaxed: bool = False) -> list[str]:
    import re

    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    return [t for t in terms if t not in STOP] or terms if relaxed else terms


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == F.lit(term))).cast("double")


def bm25(docs: DataFrame, terms: list[str], every: bool = False, limit: int = 20) -> DataFrame:
    """(id, score): BM25 with idf floored at 1e-6; ``every``: documents that hold all terms only.

    One scan counts a document's length and its query terms with array functions, so no posting is
    shuffled; corpus statistics are one row, joined back by broadcast.
    """
    terms = terms or [""]
    d = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    tf = [_times(t).alias(f"tf{k}") for k, t in enumerate(terms)]
    d = d.select("id", F.size("w").alias("len"), *tf)
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(terms))])
    s = d.where(" and ".join(f"tf{k} > 0" for k in range(len(terms))) if every else " or ".join(f"tf{k} > 0" for k in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    norm, total = F.lit(K1) * (1 - B + B * F.col("len") / F.col("avg")), F.lit(0.0)
    for k in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(1e-6))
        total = total + idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + norm)
    return s.select("id", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def ranked(df: DataFrame, *order) -> DataFrame:
    """(id, rank) of an already limited result."""
    return df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def knn(vectors: DataFrame, query: list[float], limit: int = 10, where: str | None = None) -> DataFrame:
    """(id, distance): smallest L2 distances; vectors of another length are passed over."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where(where) if where else vectors
    v = v.where(F.size("vec") == len(query))
    sq = F.aggregate(F.zip_with("vec", q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.round(F.sqrt(sq), 6).alias("distance")).orderBy("distance", "id").limit(limit)


def knn_scored(vectors: DataFrame, query: list[float], limit: int = 10, where: str | None = None) -> DataFrame:
    """(id, score): ``1 - distance / largest`` over twice as many rows as are asked for, at least .001."""
    near = knn(vectors, query, 2 * limit, where)
    top = F.max("distance").over(Window.partitionBy(F.lit(1)))  # 2 * limit rows
    score = F.greatest(F.round(1 - F.col("distance") / top, 6), F.lit(0.001))
    return near.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def rrf(lists: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """(id, score): sum of weight / (60 + rank) over the ranked lists (id, rank)."""
    parts = [df.select("id", (F.lit(WEIGHTS[name]) / (RRF_K + F.col("rank"))).alias("s")) for name, df in lists.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def penalize(ranked_: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, score): file .15, symbol .35, chunk .60, capped at .85, off the scores of seen items."""
    w = F.when(F.col("kind") == "file", 0.15).when(F.col("kind") == "symbol", 0.35).otherwise(0.60)
    p = seen.select("id", "kind").distinct().groupBy("id").agg(F.least(F.sum(w), F.lit(0.85)).alias("p"))
    return ranked_.join(p, "id", "left").select("id", F.greatest(F.lit(0.0), F.round(F.col("score") - F.coalesce("p", F.lit(0.0)), 6)).alias("score"))
