"""Search end to end: full text over postings, strict then relaxed, vectors, graph expansion, fusion, penalties."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph, retrieval
from .session import first_candidate

# How much more each list fetches than is asked for, ids the graph starts from, its hops, the most that a search returns.
OVER = {"keyword": 2, "vector": 2, "graph": 3, "ledger": 3, "kind": 4}
SEEDS, HOPS, MOST = 5, 2, 50


def fts_terms(query: str) -> tuple[list[str], list[str]]:
    """(strict, relaxed) terms: the query's words and those of its normalised form, relaxed without stop words."""
    parts = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query))
    plain = re.sub("[^A-Za-z0-9 ]", "", re.sub(r"[_\-./\\]+", " ", parts)).lower()
    terms = list(dict.fromkeys(t for t in (re.sub("[^A-Za-z0-9_]", "", x) for x in [*query.split(), *plain.split()]) if t))
    return terms, [t for t in terms if t.lower() not in retrieval.STOP] or terms


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, len) of docs(id, text): built once; written by term, a query reads its terms only."""
    w = docs.select("id", tx.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(n, avg): one row."""
    return docs.select(F.size(tx.tokens(F.coalesce("text", F.lit("")))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))


def search_postings(index: DataFrame, stats: DataFrame, terms: list[str], every: bool = False, limit: int = 20) -> DataFrame:
    """(id, score): BM25 from :func:`postings`; ``every``: documents that hold all terms only."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    hit = index.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term
    s = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.lit(retrieval.K1) * (1 - retrieval.B + retrieval.B * F.col("len") / F.col("avg"))
    g = s.groupBy("id").agg(F.round(F.sum(idf * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + norm)), 6).alias("score"), F.count("*").alias("hits"))
    return (g.where(F.col("hits") == len(terms)) if every else g).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def snippet(text: Column, terms: list[str], most: int = 12) -> Column:
    """At most ``most`` words around the first hit, hits in ``<<`` and ``>>``."""
    w = F.split(text, r"\s+")
    hit = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "").isin(*[t.lower() for t in terms])
    first = F.coalesce(F.array_position(F.transform(w, hit), F.lit(True)), F.lit(1))
    some = F.slice(w, F.greatest(first - most // 2, F.lit(1)).cast("int"), F.lit(most))
    return F.array_join(F.transform(some, lambda x: F.when(hit(x), F.concat(F.lit("<<"), x, F.lit(">>"))).otherwise(x)), " ")


def full_text(docs: DataFrame, query: str, limit: int = 20, kind: str | None = None, path: str | None = None) -> DataFrame:
    """(id, rank, score, snippet) of docs(id, text, kind, path): strict hits first, then relaxed ones that are new.

    Statistics are of all documents; ``kind`` and the glob ``path`` choose among the hits.
    """
    strict, relaxed = fts_terms(query)
    keep = F.lit(True)
    if kind is not None:
        keep = keep & (F.col("kind") == kind)
    if path is not None:
        keep = keep & F.col("path").rlike(tx.glob_regex(path))
    index, stats = postings(docs), corpus_stats(docs)
    chosen = docs.where(keep).select("id")
    some = index.join(chosen, "id", "left_semi")

    def tier(terms: list[str], every: bool, n: int) -> DataFrame:
        low = list(dict.fromkeys(t.lower() for t in terms))
        df = index.where(F.col("term").isin(low)).groupBy("term").agg(F.count("*").alias("df"))
        s = some.where(F.col("term").isin(low)).join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        norm = F.lit(retrieval.K1) * (1 - retrieval.B + retrieval.B * F.col("len") / F.col("avg"))
        g = s.groupBy("id").agg(F.round(F.sum(idf * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + norm)), 6).alias("score"), F.count("*").alias("hits"))
        return (g.where(F.col("hits") == len(low)) if every else g).select("id", "score", F.lit(n).alias("tier")).orderBy(F.desc("score"), "id").limit(limit)

    both = tier(strict, True, 0)
    if strict != relaxed or len(strict) > 1:
        both = both.unionByName(tier(relaxed, False, 1))
    best = first_candidate(both, ["id"], ["tier"]).orderBy("tier", F.desc("score"), "id").limit(limit)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")))  # at most ``limit`` rows
    return best.join(docs.select("id", "text"), "id").select("id", "rank", "score", snippet(F.col("text"), relaxed).alias("snippet"))


def graph_list(edges: DataFrame, seeds: list, limit: int, profile: tuple[str, tuple[str, ...]] | None = None, hops: int = HOPS) -> DataFrame:
    """(id, rank) of what the seeds reach, nearest first; ``profile``: an intent's direction and edge types."""
    direction, types = profile or ("both", ())
    reach = graph.bfs(edges, [str(x) for x in seeds], hops, direction, list(types) or None)
    near = reach.orderBy("distance", "node").limit(OVER["graph"] * limit)
    return near.select(F.col("node").alias("id"), F.row_number().over(Window.orderBy("distance", "node")).alias("rank"))


def fuse(lists: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """(id, score, primary): reciprocal ranks by weight; what words or vectors found comes before what only the graph found."""
    parts = [df.select("id", (F.lit(retrieval.WEIGHTS[name]) / (retrieval.RRF_K + F.col("rank"))).alias("s"), F.lit(name != "graph").alias("p")) for name, df in lists.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    g = every.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"), F.max("p").alias("primary"))
    return g.orderBy(F.desc("primary"), F.desc("score"), "id").limit(limit)


def search(keyword: DataFrame | None, vector: DataFrame | None, edges: DataFrame | None, mode: str = "hybrid", limit: int = 20, intent: str = "general") -> DataFrame:
    """(id, score, primary) by mode: ``hybrid``, ``keyword``, ``vector`` or ``graph``.

    ``keyword(id, rank)`` and ``vector(id, rank)`` hold ``OVER`` times as many rows as asked for; the graph starts
    from the first ``SEEDS`` of each.  A mode whose list is missing raises an error.
    """
    limit = min(limit, MOST)
    if mode == "vector" and vector is None:
        raise ValueError("vector search needs vectors")
    lists = {n: d for n, d in (("keyword", keyword), ("vector", vector)) if d is not None and mode in ("hybrid", "graph", n)}
    if not lists:
        raise ValueError(f"nothing to search by {mode}")
    # a list is read more than once: its rows, OVER * MOST at most, come once and are put back as they are
    lists = {n: d.sparkSession.createDataFrame(d.where(F.col("rank") <= OVER[n] * MOST).collect(), d.schema) for n, d in lists.items()}
    if mode in ("hybrid", "graph") and edges is not None:
        seeds = list(dict.fromkeys(r.id for d in lists.values() for r in d.where(F.col("rank") <= SEEDS).orderBy("rank").collect()))  # at most 2 * SEEDS rows
        kind = next(iter(lists.values())).schema["id"].dataType
        found = graph_list(edges, seeds, limit, tx.PROFILES.get(intent)).withColumn("id", F.col("id").cast(kind))
        lists = {"graph": found} if mode == "graph" else lists | {"graph": found}
    return fuse(lists, limit)


def search_code(symbols: DataFrame, files: DataFrame, seen: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(id, score, kind): fused symbols(id, score) and, where new, files(id, rank) by keyword weight; penalised by what the
    session has seen(id, kind), sorted by score alone."""
    s = symbols.select("id", "score", F.lit("symbol").alias("kind"), F.lit(0).alias("src"))
    f = files.select("id", F.round(F.lit(retrieval.WEIGHTS["keyword"]) / (retrieval.RRF_K + F.col("rank")), 9).alias("score"), F.lit("file").alias("kind"), F.lit(1).alias("src"))
    every = first_candidate(s.unionByName(f), ["id"], ["src"]).drop("src")
    if seen is not None:
        every = retrieval.penalize(every, seen).join(every.select("id", "kind"), "id")
    return every.orderBy(F.desc("score"), "id").limit(min(limit, MOST)).select("id", "score", "kind")


def enrich(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found`` with the nodes' columns, in order (``rn``); ids that are no node keep nulls."""
    n = found.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a result's rows
    return n.join(nodes, "id", "left")
