"""Ledger and memory life cycle.

Ledger: entries(session, seq, kind, item, tokens, feedback); kinds are file, symbol, chunk and evidence.
Memories: (id, type, content, scope array, evidence array, confidence, rules array<struct<type,target>>, validated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import first_candidate

# Penalty of a repeated item by kind, and the most of them together.
PENALTY, MOST = {"file": 0.15, "symbol": 0.35, "chunk": 0.60}, 0.85
# Least confidence that is validated, that is not stale, and that counts as relevant.
VALID, SURE, RELEVANT = 0.3, 0.6, 0.2


def mark_used(ledger: DataFrame, used: DataFrame) -> DataFrame:
    """The ledger with ``used`` appended; evidence is kept by its fingerprint ``evidence:<id>``."""
    item = F.when(F.col("kind") == "evidence", F.concat(F.lit("evidence:"), "item")).otherwise(F.col("item"))
    return ledger.unionByName(used.withColumn("item", item), allowMissingColumns=True)


def penalty_sets(ledger: DataFrame) -> DataFrame:
    """(session, files, symbols, chunks, tokens): what each session has seen, and its tokens."""
    sets = [F.size(F.collect_set(F.when(F.col("kind") == k, F.col("item")))).alias(f"{k}s") for k in PENALTY]
    return ledger.groupBy("session").agg(*sets, F.sum("tokens").alias("tokens"))


def reset(ledger: DataFrame, session: str) -> DataFrame:
    """The ledger without a session."""
    return ledger.where(~F.col("session").eqNullSafe(session))


def feedback(ledger: DataFrame, session: str, item: str, says: str) -> DataFrame:
    """The ledger with feedback on the session's latest entry of the item."""
    hit = (F.col("session") == session) & (F.col("item") == item)
    last = ledger.where(hit).agg(F.max("seq").alias("last"))  # one row
    return ledger.crossJoin(F.broadcast(last)).withColumn("feedback", F.when(hit & (F.col("seq") == F.col("last")), F.lit(says)).otherwise(F.col("feedback"))).drop("last")


def omit_repeated(pack: DataFrame, seen: DataFrame) -> DataFrame:
    """pack(session, kind, item, file) without items that the session has; evidence stays if its file is new or none."""
    s = seen.select("session", "kind", "item").distinct()
    items = pack.where("kind <> 'evidence'").join(s, ["session", "kind", "item"], "left_anti").select(pack.columns)
    old = s.where("kind = 'file'").select("session", F.col("item").alias("file"))
    return items.unionByName(pack.where("kind = 'evidence'").join(old, ["session", "file"], "left_anti").select(pack.columns))


def prune(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """The ledger without items that are one of ``gone(key)`` or begin with ``key:``."""
    keys = gone.select("key").distinct()
    head = F.transform(F.sequence(F.lit(1), F.size(F.split("item", ":"))), lambda k: F.array_join(F.slice(F.split("item", ":"), F.lit(1), k), ":"))
    hit = ledger.select("item").distinct().select("item", F.explode(head).alias("key")).join(keys, "key", "left_semi").select("item").distinct()
    return ledger.join(hit, "item", "left_anti").select(ledger.columns)


def stale_references(ledger: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, stale): distinct items of the ledger that known(kind, item) lacks."""
    return ledger.select("kind", "item").distinct().join(known.select("kind", "item").distinct(), ["kind", "item"], "left_anti").groupBy("kind").agg(F.count("*").alias("stale"))


def remember(memories: DataFrame) -> DataFrame:
    """New memories as they are kept: confidence within 0 and 1, a ``file_change`` rule for each scope, the first scope as evidence where there is none."""
    rules = F.transform("scope", lambda s: F.struct(F.lit("file_change").alias("type"), s.alias("target")))
    empty = F.coalesce(F.size("evidence") <= 0, F.lit(True))
    return memories.withColumns({"confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")), "rules": rules, "evidence": F.when(empty, F.slice("scope", 1, 1)).otherwise(F.col("evidence"))})


def decision(title: Column, context: Column, decided: Column, consequences: Column) -> Column:
    """A decision record as JSON; such memories have confidence .95."""
    return F.to_json(F.struct(title.alias("title"), context.alias("context"), decided.alias("decision"), consequences.alias("consequences")))


def expire(memories: DataFrame, commit: str) -> DataFrame:
    """Memories without those that have a ``commit`` rule and were validated at another commit."""
    ruled = F.exists("rules", lambda r: r["type"] == "commit")
    return memories.where(~(F.coalesce(ruled, F.lit(False)) & F.coalesce(F.col("validated") != commit, F.lit(False))))


def validate(memories: DataFrame, commit: str) -> DataFrame:
    """Memories that are sure enough become validated at the commit."""
    return memories.withColumn("validated", F.when(F.col("confidence") >= VALID, F.lit(commit)).otherwise(F.col("validated")))


def forget(memories: DataFrame, id_: str | None = None, type_: str | None = None, scope: str | None = None) -> DataFrame:
    """Memories without those of this id, type or exact scope."""
    hit = F.lit(False)
    for given, c in ((id_, F.col("id") == id_), (type_, F.col("type") == type_), (scope, F.array_contains("scope", F.lit(scope)))):
        if given is not None:
            hit = hit | F.coalesce(c, F.lit(False))
    return memories.where(~hit)


def stale_count(memories: DataFrame) -> DataFrame:
    """(stale): memories that are less than sure."""
    return memories.agg(F.count_if(F.col("confidence") < SURE).alias("stale"))


def _holds(path: str):
    return lambda e: F.contains(e, F.lit(path))


def _ruled_by(path: str):
    return lambda r: (r["type"] == "file_change") & ((r["target"] == "*") | F.contains(F.lit(path), r["target"]))


def relevance(memories: DataFrame, terms: list[str], paths: list[str], limit: int = 10, commit: str | None = None) -> DataFrame:
    """(id, score): ``.6 confidence + .25 share of terms + .15`` if a path is in scope or evidence; 0, and so
    left out, without any term and path.  Stale memories are left out: of confidence .2 or less, ruled by commit and
    validated at another, or ruled by a change of one of the paths.

    ``terms`` and ``paths`` are a query's: some dozens.
    """
    searchable = F.lower(F.concat_ws(" ", "content", F.array_join("scope", " "), F.array_join("evidence", " ")))
    hits = sum((F.contains(searchable, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    near = F.lit(False)
    for p in paths:
        near = near | F.array_contains("scope", F.lit(p)) | F.exists("evidence", _holds(p))
    share = hits / len(terms) if terms else F.lit(0.2)
    stale = F.col("confidence") <= RELEVANT
    if commit is not None:
        moved = F.col("validated").isNotNull() & (F.col("validated") != commit)
        changed = F.exists("rules", lambda r: (r["type"] == "commit"))
        for p in paths:
            changed = changed | F.exists("rules", _ruled_by(p))
        stale = stale | (moved & F.coalesce(changed, F.lit(False)))
    m = memories.where(~F.coalesce(stale, F.lit(False))).withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("_hits", hits)
    if terms:
        m = m.where("_hits > 0 or _near")
    return m.select("id", F.round(F.col("confidence") * 0.6 + share * 0.25 + F.col("_near").cast("int") * 0.15, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def evidence(symbols: DataFrame, snippets: DataFrame, memories: DataFrame, limit: int = 40) -> DataFrame:
    """(id, kind, confidence): a symbol's score (or .6), a snippet .8, a memory's confidence; one row for each id, the surest first."""
    parts = symbols.select("id", F.lit("symbol").alias("kind"), F.coalesce(F.col("score").cast("double"), F.lit(0.6)).alias("confidence"), F.lit(0).alias("rank"))
    parts = parts.unionByName(snippets.select("id", F.lit("snippet").alias("kind"), F.lit(0.8).alias("confidence"), F.lit(1).alias("rank")))
    parts = parts.unionByName(memories.select("id", F.lit("memory").alias("kind"), F.col("confidence").cast("double").alias("confidence"), F.lit(2).alias("rank")))
    return first_candidate(parts, ["id"], ["rank", F.desc("confidence")]).orderBy(F.desc("confidence"), "id").limit(limit).select("id", "kind", "confidence")
