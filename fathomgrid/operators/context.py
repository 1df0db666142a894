"""Context packs: what goes into a token budget, in which order, and how far it can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .session import first_candidate

# The kinds of a pack in order, and the least level of each.
KINDS = {"card": 0, "memory": 0, "file": 0, "symbol": 2, "snippet": 4, "chain": 0, "evidence": 0, "missing": 0}
# Kinds that are taken without a look at the budget.
FREE = ("chain", "missing")
# Most snippets, evidence, tests and files of a trust contract.
TRUST = {"snippet": 5, "evidence": 12, "test": 8, "file": 8}


def pack(items: DataFrame, budget: int, most: str = "L5") -> DataFrame:
    """(key, kind, id, tokens) that a pack of each key takes of items(key, kind, ord, id, tokens).

    Kinds come in order, each from its level on; an item that does not fit is skipped and packing goes on;
    chains and what is missing cost nothing.  A key's items are one query's results, some hundreds.
    """
    level = F.substring(tx.context_level(F.lit(budget), most), 2, 1).cast("int")
    rank = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)])[F.col("kind")]
    least = F.create_map(*[F.lit(x) for n, k in KINDS.items() for x in (n, k)])[F.col("kind")]
    i = items.where(least <= level).withColumn("rank", rank).withColumn("cost", F.when(F.col("kind").isin(*FREE), 0).otherwise(F.col("tokens")).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "ord", "id", "kind", "tokens", "cost")))
    kind = "struct<used:bigint,taken:array<struct<kind:string,id:string,tokens:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().alias("taken")).cast(kind)

    def step(s, x):
        took = F.concat(s["taken"], F.array(F.struct(x["kind"].alias("kind"), x["id"].cast("string").alias("id"), x["tokens"].cast("long").alias("tokens"))))
        return F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), took.alias("taken")).cast(kind)).otherwise(s)

    p = i.groupBy("key").agg(F.aggregate(rows, start, step).alias("p"))
    return p.select("key", F.inline("p.taken"))


def project_card(metadata: DataFrame) -> DataFrame:
    """(project, card): a map of each project's metadata(project, key, value); the last value of a key by its seq."""
    last = first_candidate(metadata, ["project", "key"], [F.desc("seq")])
    return last.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("card"))


def token_chunks(docs: DataFrame, most: int, overlap: int = 0) -> DataFrame:
    """(id, chunk, first, last, tokens): lines of docs(id, text) in chunks of about ``most`` tokens.

    A line goes to the chunk in which its first token falls; with ``overlap`` a chunk also has the lines that
    begin within so many tokens before it.  Running sums over one text's lines, no sort of the corpus.
    """
    lines = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    t = lines.withColumn("tokens", tx.token_estimate(F.col("text"))).withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    at = F.floor(F.col("before") / most).cast("long")
    again = F.when((F.lit(overlap) > 0) & (most * (at + 1) - F.col("before") <= overlap), F.sequence(at, at + 1)).otherwise(F.array(at))
    c = t.select("id", "line", "tokens", F.explode(again).alias("chunk"))
    own = t.groupBy("id").agg(F.max(at).alias("end"))
    return c.join(own, "id").where("chunk <= end").groupBy("id", "chunk").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("tokens").alias("tokens"))


def cut_tokens(text: Column, most: int) -> Column:
    """A text cut to about ``most`` tokens, by the ratio of its length and its estimate."""
    tokens = tx.token_estimate(text)
    return F.when(tokens <= most, text).otherwise(F.substr(text, F.lit(1), F.floor(F.length(text) * most / tokens).cast("int")))


def trust(items: DataFrame, stale: Column) -> DataFrame:
    """(key, confidence, reads, dropped) of items(key, kind, ord, id, score): at most ``TRUST`` of each kind may be read.

    confidence: ``stale`` if the index is, ``low`` if nothing scores .5, else ``ready``.
    """
    w = Window.partitionBy("key", "kind").orderBy("ord", "id")
    most = F.create_map(*[F.lit(x) for n, k in TRUST.items() for x in (n, k)])[F.col("kind")]
    i = items.withColumn("rank", F.row_number().over(w)).withColumn("may", F.col("rank") <= F.coalesce(most, F.lit(0)))
    g = i.groupBy("key").agg(F.max("score").alias("best"), F.count_if("may").alias("reads"), F.count_if(~F.col("may")).alias("dropped"))
    return g.select("key", F.when(stale, "stale").when(F.coalesce(F.col("best") < 0.5, F.lit(True)), "low").otherwise("ready").alias("confidence"), "reads", "dropped")


def plan(queries: DataFrame, fresh: str = "fresh") -> DataFrame:
    """(id, intent, direction, types, level, next) of queries(id, text, budget): what to ask next and how far."""
    q = queries.withColumn("intent", tx.intent(F.col("text")))
    direction = F.create_map(*[F.lit(x) for n, (way, _) in tx.PROFILES.items() for x in (n, way)])[F.col("intent")]
    types = F.create_map(*[F.lit(x) for n, (_, kinds) in tx.PROFILES.items() for x in (n, ",".join(kinds))])[F.col("intent")]
    then = F.when(F.lit(fresh) != "fresh", "sync_index").when(F.col("intent") == "general", "search_code").when(F.col("intent") == "refactor", "impact_analysis").when(F.col("intent") == "add_test", "get_related_tests").when(F.col("intent") == "route", "get_route_map").otherwise("get_context_pack")
    return q.select("id", "intent", direction.alias("direction"), types.alias("types"), tx.context_level(F.col("budget")).alias("level"), then.alias("next"))
