"""Search, context, ledger, memory and incremental operators as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context, incremental, memory, retrieval, search
from ..sources import driver_tables as dt
from .catalog import INTENT, KNN, TOK, _probe, query

LIMIT = 20


def _bm(name: str, terms: list[str], every: bool, where: str = "true", limit: int = LIMIT) -> str:
    """CTEs ending in ``name(id, score)``: statistics of all documents, hits by ``where``."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    add = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6::DOUBLE) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avg))" for k in range(len(terms)))
    hit = (" AND " if every else " OR ").join(f"tf{k} > 0" for k in range(len(terms)))
    return f"{name}t AS (SELECT doc_id AS id, lang, source, len(w) AS l, {tf} FROM (SELECT doc_id, lang, source, {TOK} AS w FROM documents)), {name}c AS (SELECT count(*) AS n, avg(l) AS avg, {df} FROM {name}t), {name} AS (SELECT id, round({add}, 6) AS score FROM {name}t, {name}c WHERE ({hit}) AND ({where}) ORDER BY score DESC, id LIMIT {limit})"


TERMS = ["the", "and", "is"]
KEYWORD = "k0 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b)"
VECTOR = f"v0 AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT id, distance FROM k ORDER BY distance, id LIMIT {2 * LIMIT}))"
GRAPH = f"""seeds AS (SELECT id FROM k0 WHERE rank <= 5 UNION SELECT id FROM v0 WHERE rank <= 5), de AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 UNION SELECT b.doc_id, a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
w(id, distance) AS (SELECT id, 0 FROM seeds UNION SELECT de.dst, w.distance + 1 FROM w JOIN de ON de.src = w.id WHERE w.distance < 2),
g1 AS (SELECT id, min(distance) AS distance FROM w GROUP BY 1 HAVING id NOT IN (SELECT id FROM seeds)), g0 AS (SELECT id, row_number() OVER (ORDER BY distance, id::VARCHAR) AS rank FROM (SELECT * FROM g1 ORDER BY distance, id::VARCHAR LIMIT {3 * LIMIT}))"""
HYBRID = f"WITH RECURSIVE {_bm('b', TERMS, False, limit=2 * LIMIT)}, {KNN}, {KEYWORD}, {VECTOR}, {GRAPH}"
FUSED = "u AS (SELECT id, 0.20::DOUBLE / (60 + rank) AS s, true AS p FROM k0 UNION ALL SELECT id, 0.30::DOUBLE / (60 + rank), true FROM v0 UNION ALL SELECT id, 0.25::DOUBLE / (60 + rank), false FROM g0), h AS (SELECT id, round(sum(s), 9) AS score, bool_or(p) AS primary_source FROM u GROUP BY id ORDER BY primary_source DESC, score DESC, id LIMIT 20)"


def _lists(s, d):
    key = retrieval.ranked(retrieval.bm25(dt.docs(s, d), TERMS, limit=2 * LIMIT), F.desc("score"), "id")
    vec = retrieval.ranked(retrieval.knn(dt.vectors(s, d), _probe(s, d), 2 * LIMIT), "distance", "id")
    ids = dt.table(s, d, "documents").select(F.col("doc_id").alias("a"))
    e = ids.join(ids.select(F.col("a").alias("b")), F.col("b") == F.col("a") + 1)
    edges = e.select(F.col("a").cast("string").alias("from_id"), F.col("b").cast("string").alias("to_id"), F.lit("NEXT").alias("type"), F.lit(1.0).alias("confidence"))
    return key, vec, edges


@query(f"{HYBRID}, {FUSED} SELECT id, score, primary_source FROM h")
def hybrid_search(s, d):
    key, vec, edges = _lists(s, d)
    return search.search(key, vec, edges, "hybrid", LIMIT).withColumnRenamed("primary", "primary_source")


@query(f"{HYBRID} SELECT id, round(0.25::DOUBLE / (60 + rank), 9) AS score FROM g0 ORDER BY score DESC, id LIMIT 20")
def search_graph_mode(s, d):
    key, vec, edges = _lists(s, d)
    return search.search(key, vec, edges, "graph", LIMIT).select("id", "score")


@query(f"{HYBRID}, {FUSED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rn FROM h) SELECT r.id, rn, score, source || '/' || lang || '/' || doc_id AS path, lang AS language FROM r LEFT JOIN documents ON doc_id = r.id")
def search_enriched(s, d):
    key, vec, edges = _lists(s, d)
    return search.enrich(search.search(key, vec, edges, "hybrid", LIMIT), dt.files(s, d).select("id", "path", "language")).select("id", "rn", "score", "path", "language")


@query(f"WITH {_bm('b', ['thing', 'the', 'and'], True, 'lang = ' + chr(39) + 'en' + chr(39) + ' AND starts_with(source, ' + chr(39) + 'src1' + chr(39) + ')')}, {_bm('r', ['thing'], False, 'lang = ' + chr(39) + 'en' + chr(39) + ' AND starts_with(source, ' + chr(39) + 'src1' + chr(39) + ')')}, m AS (SELECT id, score, 0 AS tier FROM b UNION ALL SELECT id, score, 1 FROM r WHERE id NOT IN (SELECT id FROM b)) SELECT id, row_number() OVER (ORDER BY tier, score DESC, id)::INTEGER AS rank, score FROM m ORDER BY tier, score DESC, id LIMIT 20")
def fts_filtered(s, d):
    docs = dt.docs(s, d).select("id", "text", F.col("lang").alias("kind"), F.concat_ws("/", "source", "lang", F.col("id").cast("string")).alias("path"))
    return search.full_text(docs, "thing the and", LIMIT, kind="en", path="src1*/**").select("id", "rank", "score")


@query(f"WITH {_bm('b', ['thing', 'reat'], False)} SELECT id, score FROM b")
def bm25_postings(s, d):
    docs = dt.docs(s, d)
    return search.search_postings(search.postings(docs), search.corpus_stats(docs), ["thing", "reat"])


@query(f"WITH RECURSIVE {_bm('b', TERMS, False, limit=2 * LIMIT)}, {KNN}, {KEYWORD}, {VECTOR}, e AS (SELECT id, round(0.30::DOUBLE / (60 + rank), 9) AS score, 'symbol' AS kind FROM v0 UNION ALL SELECT id, round(0.20::DOUBLE / (60 + rank), 9), 'file' FROM k0 WHERE id NOT IN (SELECT id FROM v0)), p AS (SELECT event_id % 1000 AS id, least(sum(DISTINCT CASE WHEN event_type = 'view' THEN 0.15 WHEN event_type = 'click' THEN 0.35 ELSE 0.60 END), 0.85) AS p FROM events GROUP BY 1) SELECT id, greatest(0.0, round(score - coalesce(p, 0), 6))::DOUBLE AS score, kind FROM e LEFT JOIN p USING (id) ORDER BY score DESC, id LIMIT 20")
def search_code_union(s, d):
    key, vec, _ = _lists(s, d)
    fused = vec.select("id", F.round(F.lit(0.30) / (60 + F.col("rank")), 9).alias("score"))
    t = F.col("event_type")
    seen = dt.table(s, d, "events").select((F.col("event_id") % 1000).alias("id"), F.when(t == "view", "file").when(t == "click", "symbol").otherwise("chunk").alias("kind"))
    return search.search_code(fused, key, seen, LIMIT)


@query("SELECT id, kind, distance FROM (SELECT vec_id AS id, label AS kind, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)) WHERE kind = 1 ORDER BY distance, id LIMIT 20")
def search_symbols_kind(s, d):
    """Vector search with a kind filter: the filter holds before the limit, so nothing has to be fetched in excess."""
    v = dt.vectors(s, d)
    return retrieval.knn(v, _probe(s, d), LIMIT, "label = 1").join(v.select("id", F.col("label").alias("kind")), "id").select("id", "kind", "distance")


@query(f"SELECT id, greatest(round(1 - distance / max(distance) OVER (), 6), 0.001)::DOUBLE AS score FROM (SELECT vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY distance, id LIMIT 40) ORDER BY score DESC, id LIMIT 20")
def knn_scored(s, d):
    return retrieval.knn_scored(dt.vectors(s, d), _probe(s, d), LIMIT)


LEVEL = "CASE WHEN {b} <= 500 THEN 'L0' WHEN {b} <= 1500 THEN 'L1' WHEN {b} <= 3000 THEN 'L2' WHEN {b} <= 6000 THEN 'L3' WHEN {b} <= 12000 THEN 'L4' ELSE 'L5' END"


@query(f"SELECT o_orderkey AS id, least({LEVEL.format(b='floor(o_totalprice / 20)')}, 'L4') AS level FROM orders")
def context_level(s, d):
    return dt.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), tx.context_level(F.floor(F.col("o_totalprice") / 20), "L4").alias("level"))


def _map(values: dict[str, str], default: str = "NULL") -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


@query(f"WITH q AS (SELECT conv_id || ':' || turn AS id, length(text) * 10 AS budget, {INTENT} AS intent FROM conversations) SELECT id, intent, {_map({k: v[0] for k, v in tx.PROFILES.items()})} AS direction, {_map({k: ','.join(v[1]) for k, v in tx.PROFILES.items()})} AS types, {LEVEL.format(b='budget')} AS level, {_map({'general': 'search_code', 'refactor': 'impact_analysis', 'add_test': 'get_related_tests', 'route': 'get_route_map'}, chr(39) + 'get_context_pack' + chr(39))} AS next FROM q")
def plan_context(s, d):
    q = dt.table(s, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", (F.length("text") * 10).alias("budget"))
    return context.plan(q)


PACK_KIND = "list_extract(['memory', 'file', 'symbol', 'snippet', 'chain'], (turn % 5 + 1)::INTEGER)"


@query(f"""WITH i AS (SELECT conv_id, turn, role, (turn % 5) AS k, (ceil(length(text) / 3.5))::BIGINT AS t FROM conversations), n AS (SELECT conv_id, list({{'t': t, 'c': CASE WHEN k = 4 THEN 0 ELSE t END}} ORDER BY k, turn, role) AS l FROM i WHERE k <> 3 GROUP BY 1),
r AS (SELECT conv_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'n': 0::BIGINT, 't': 0::BIGINT, 'c': 0::BIGINT}}, list_transform(l, lambda x: {{'u': 0::BIGINT, 'n': 0::BIGINT, 't': x.t, 'c': x.c::BIGINT}})), lambda a, x: {{'u': CASE WHEN a.u + x.c <= 2500 THEN a.u + x.c ELSE a.u END, 'n': CASE WHEN a.u + x.c <= 2500 THEN a.n + 1 ELSE a.n END, 't': 0::BIGINT, 'c': 0::BIGINT}}) AS p FROM n) SELECT conv_id, p.n AS taken FROM r WHERE p.n > 0""")
def context_pack_kinds(s, d):
    """A budget of level L2 has memories, files, symbols and chains, and no snippets."""
    kind = F.element_at(F.array(*map(F.lit, ("memory", "file", "symbol", "snippet", "chain"))), (F.col("turn") % 5 + 1).cast("int"))
    c = dt.table(s, d, "conversations").select(F.col("conv_id").alias("key"), kind.alias("kind"), F.col("turn").alias("ord"), F.col("role").alias("id"), tx.token_estimate(F.col("text")).alias("tokens"))
    return context.pack(c, 2500).groupBy(F.col("key").alias("conv_id")).agg(F.count("*").alias("taken"))


@query("SELECT c_nationkey AS project, string_agg(k || '=' || v, ',' ORDER BY k) AS card FROM (SELECT c_nationkey, c_mktsegment AS k, max_by(c_name, c_custkey) AS v FROM customer GROUP BY ALL) GROUP BY 1")
def project_card(s, d):
    m = dt.table(s, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seq"))
    e = F.transform(F.map_entries("card"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return context.project_card(m).select("project", F.array_join(e, ",").alias("card"))


MEM = "mem AS (SELECT 'm' || o_orderkey AS id, o_orderpriority AS content, 'c' || o_custkey AS scope, o_orderstatus AS type, CASE WHEN o_totalprice > 250000 THEN 0.9 WHEN o_totalprice > 100000 THEN 0.6 WHEN o_totalprice > 20000 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence, CASE o_orderstatus WHEN 'F' THEN 'commit' ELSE 'file_change' END AS rule, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'now' ELSE 'then' END AS validated FROM orders)"


def _memories(s, d):
    o = dt.table(s, d, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    scope = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    rule = F.struct(F.when(status == "F", "commit").otherwise("file_change").alias("type"), scope.alias("target"))
    confidence = F.when(price > 250000, 0.9).when(price > 100000, 0.6).when(price > 20000, 0.4).otherwise(0.2)
    k = F.col("o_custkey") % 3
    return o.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("content"), F.array(scope).alias("scope"), F.array().cast("array<string>").alias("evidence"), status.alias("type"), confidence.alias("confidence"), F.array(rule).alias("rules"), F.when(k == 1, "now").when(k == 2, "then").alias("validated"))


@query(f"WITH {MEM}, x AS (SELECT id, confidence, contains(lower(content || ' ' || scope), 'urgent')::INTEGER + contains(lower(content || ' ' || scope), 'c7')::INTEGER AS hits, scope IN ('c7', 'c11') AS near FROM mem WHERE NOT (confidence <= 0.2) AND NOT (validated IS NOT NULL AND validated <> 'now' AND (rule = 'commit' OR contains('c7', scope) OR contains('c11', scope)))) SELECT id, round(confidence * 0.6 + hits / 2 * 0.25 + near::INTEGER * 0.15, 6)::DOUBLE AS score FROM x WHERE hits > 0 OR near ORDER BY score DESC, id LIMIT 10")
def memory_relevance(s, d):
    return memory.relevance(_memories(s, d), ["urgent", "c7"], ["c7", "c11"], 10, "now")


@query(f"WITH {MEM} SELECT id, confidence, validated FROM mem WHERE NOT (rule = 'commit' AND coalesce(validated <> 'now', false))")
def memory_invalidate(s, d):
    return memory.expire(_memories(s, d), "now").select("id", "confidence", "validated")


@query(f"WITH {MEM} SELECT id, CASE WHEN confidence >= 0.3 THEN 'next' ELSE validated END AS validated FROM mem")
def memory_validate(s, d):
    return memory.validate(_memories(s, d), "next").select("id", "validated")


@query(f"WITH {MEM} SELECT id, type FROM mem WHERE type <> 'P' AND scope <> 'c7' AND id <> 'm5'")
def memory_forget(s, d):
    return memory.forget(_memories(s, d), "m5", "P", "c7").select("id", "type")


@query(f"WITH {MEM} SELECT count(*) FILTER (confidence < 0.6) AS stale FROM mem")
def memory_stale_count(s, d):
    return memory.stale_count(_memories(s, d))


@query(f"WITH {MEM} SELECT id, least(1.0, greatest(0.0, confidence * 2 - 0.6))::DOUBLE AS confidence, 'file_change:' || scope AS rule, scope AS evidence FROM mem")
def memory_remember(s, d):
    m = memory.remember(_memories(s, d).withColumn("confidence", F.col("confidence") * 2 - 0.6))
    return m.select("id", "confidence", F.concat_ws(":", F.col("rules")[0]["type"], F.col("rules")[0]["target"]).alias("rule"), F.col("evidence")[0].alias("evidence"))


@query("SELECT s_suppkey AS id, 0.95::DOUBLE AS confidence, '{\"title\":\"' || s_name || '\",\"context\":\"nation ' || s_nationkey || '\",\"decision\":\"keep\",\"consequences\":\"none\"}' AS record FROM supplier")
def memory_decision(s, d):
    p = dt.table(s, d, "supplier")
    record = memory.decision(F.col("s_name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.lit("keep"), F.lit("none"))
    return p.select(F.col("s_suppkey").alias("id"), F.lit(0.95).alias("confidence"), record.alias("record"))


@query("WITH e AS (SELECT 's' || vec_id AS id, 'symbol' AS kind, CASE WHEN vec_id % 3 = 0 THEN 0.6 ELSE round(label / 20, 6) END::DOUBLE AS confidence, 0 AS r FROM embeddings UNION ALL SELECT 's' || doc_id, 'snippet', 0.8, 1 FROM documents UNION ALL SELECT 'm' || o_orderkey, 'memory', CASE WHEN o_totalprice > 250000 THEN 0.9 ELSE 0.4 END, 2 FROM orders) SELECT id, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, confidence DESC) AS k FROM e) WHERE k = 1 ORDER BY confidence DESC, id LIMIT 40")
def evidence_top(s, d):
    v = dt.vectors(s, d).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 != 0, F.round(F.col("label") / 20, 6)).alias("score"))
    snip = dt.docs(s, d).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))
    mem = dt.table(s, d, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_totalprice") > 250000, 0.9).otherwise(0.4).alias("confidence"))
    return memory.evidence(v, snip, mem)


@query("SELECT doc_id AS id, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 400) || chr(10) || chr(10) || '... (truncated, ' || (length(text) - 400) || ' more chars)...' END) AS cut FROM documents")
def output_truncate(s, d):
    return dt.docs(s, d).select("id", F.md5(tx.cut_output(F.col("text"), 400)).alias("cut"))


CJKSQL = f"(ceil((length(x) - length(regexp_replace(x, '{tx.CJK}', '', 'g'))) / 1.5) + ceil((length(regexp_replace(x, '{tx.CJK}', '', 'g')) + len(regexp_extract_all(x, '{tx.WIDE}'))) / 3.5))::BIGINT"


@query(f"WITH l AS (SELECT doc_id AS id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line, unnest(string_split(text, chr(10))) AS x FROM documents), t AS (SELECT id, line, {CJKSQL} AS tokens FROM l), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), c AS (SELECT *, (before // 200)::BIGINT AS nth FROM b), e AS (SELECT id, line, tokens, nth AS chunk FROM c UNION ALL SELECT id, line, tokens, nth + 1 FROM c x WHERE 200 * (nth + 1) - before <= 40 AND nth + 1 <= (SELECT max(nth) FROM c y WHERE y.id = x.id)) SELECT id, chunk, min(line)::INTEGER AS first, max(line)::INTEGER AS last, sum(tokens)::BIGINT AS tokens FROM e GROUP BY 1, 2")
def token_chunks(s, d):
    return context.token_chunks(dt.docs(s, d), 200, 40)


@query("WITH i AS (SELECT conv_id AS key, list_extract(['file', 'snippet', 'test', 'evidence'], (turn % 4 + 1)::INTEGER) AS kind, turn, role, length(text) / 400.0::DOUBLE AS score FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY turn, role) AS k, CASE kind WHEN 'snippet' THEN 5 WHEN 'evidence' THEN 12 ELSE 8 END AS most FROM i) SELECT key, CASE WHEN max(score) < 0.5 THEN 'low' ELSE 'ready' END AS confidence, count(*) FILTER (k <= most) AS reads, count(*) FILTER (k > most) AS dropped FROM r GROUP BY 1")
def trust_contract(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("file", "snippet", "test", "evidence"))), (F.col("turn") % 4 + 1).cast("int"))
    i = dt.table(s, d, "conversations").select(F.col("conv_id").alias("key"), kind.alias("kind"), F.col("turn").alias("ord"), F.col("role").alias("id"), (F.length("text") / 400.0).alias("score"))
    return context.trust(i, F.lit(False))


LED = "led AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'symbol' ELSE 'chunk' END AS kind, 'p' || (event_id % 40) || ':' || event_type AS item, (event_id % 7) AS tokens FROM events)"


def _ledger(s, d):
    t = F.col("event_type")
    kind = F.when(t == "view", "file").when(t == "click", "symbol").otherwise("chunk")
    return dt.table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("p"), (F.col("event_id") % 40).cast("string"), F.lit(":"), t).alias("item"), (F.col("event_id") % 7).alias("tokens"), F.lit(None).cast("string").alias("feedback"))


@query(f"WITH {LED}, n AS (SELECT session, seq, kind, item FROM led UNION ALL SELECT user_id, event_id + 1000000, 'evidence', 'evidence:' || event_type FROM events WHERE event_type = 'error') SELECT kind, count(*) AS n, count(DISTINCT item) AS items FROM n GROUP BY 1")
def ledger_mark_used(s, d):
    e = dt.table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("session"), (F.col("event_id") + 1000000).alias("seq"), F.lit("evidence").alias("kind"), F.col("event_type").alias("item"))
    return memory.mark_used(_ledger(s, d), e).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))


@query(f"WITH {LED} SELECT session, count(DISTINCT item) FILTER (kind = 'file')::INTEGER AS files, count(DISTINCT item) FILTER (kind = 'symbol')::INTEGER AS symbols, count(DISTINCT item) FILTER (kind = 'chunk')::INTEGER AS chunks, sum(tokens)::BIGINT AS tokens FROM led GROUP BY 1")
def ledger_penalty_sets(s, d):
    return memory.penalty_sets(_ledger(s, d))


@query(f"WITH {LED}, m AS (SELECT max(seq) AS m FROM led WHERE session = 8 AND item LIKE '%:view') SELECT session, count(*) AS n, count(*) FILTER (session = 8 AND seq = m) AS told FROM led, m WHERE session <> 3 GROUP BY 1")
def ledger_feedback(s, d):
    led = memory.reset(_ledger(s, d), "3")
    last = led.where("session = 8 and item like '%:view'").orderBy(F.desc("seq")).first()
    f = memory.feedback(led, "8", last.item if last else "", "useful")
    return f.groupBy("session").agg(F.count("*").alias("n"), F.count("feedback").alias("told"))


@query(f"WITH {LED}, c AS (SELECT session, kind, item, 'p' || (seq % 40) AS file FROM led WHERE seq % 2 = 1), o AS (SELECT DISTINCT session, kind, item FROM led WHERE seq % 2 = 0) SELECT session, kind, item FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session = c.session AND o.kind = c.kind AND o.item = c.item)")
def ledger_omit_repeated(s, d):
    led = _ledger(s, d)
    pack = led.where("seq % 2 = 1").select("session", "kind", "item", F.concat(F.lit("p"), (F.col("seq") % 40).cast("string")).alias("file"))
    return memory.omit_repeated(pack, led.where("seq % 2 = 0")).select("session", "kind", "item")


@query(f"WITH {LED} SELECT kind, count(*) AS n FROM led WHERE NOT (item LIKE 'p7:%' OR item LIKE 'p11:%' OR item = 'p3:view') GROUP BY 1")
def ledger_prune(s, d):
    gone = s.createDataFrame([("p7",), ("p11",), ("p3:view",)], "key string")
    return memory.prune(_ledger(s, d), gone).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {LED} SELECT kind, count(DISTINCT item) AS stale FROM led WHERE NOT (item IN (SELECT 'p' || (event_id % 40) || ':' || event_type FROM events WHERE event_id % 40 < 30)) GROUP BY 1")
def ledger_stale_references(s, d):
    led = _ledger(s, d)
    return memory.stale_references(led, led.where("seq % 40 < 30"))


@query("SELECT 'u/' || user_id AS path, max_by(event_type, event_id) AS op FROM events GROUP BY 1")
def change_coalesce(s, d):
    c = dt.table(s, d, "events").select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), "ts", F.col("event_id").alias("seq"))
    return incremental.coalesce(c).select("path", "op")


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(key, n, us, first, batch) AS (SELECT key, n, us, us, 0 FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, e.us, CASE WHEN e.us - w.us > 43200000000 OR e.us - w.first >= 86400000000 THEN e.us ELSE w.first END, CASE WHEN e.us - w.us > 43200000000 OR e.us - w.first >= 86400000000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT key, min(us)::BIGINT AS began, count(*) AS n FROM w GROUP BY key, batch""")
def change_batches(s, d):
    c = dt.table(s, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    b = incremental.batches(c, 12 * 3600, 24 * 3600)
    return b.groupBy("key", "run", "batch").agg(F.min(F.unix_micros(F.col("ts"))).alias("began"), F.count("*").alias("n")).select("key", "began", "n")


C = f"WITH {dt.CODE}"


@query(rf"{C}, c AS (SELECT path FROM code_files WHERE id <> 'f1' UNION ALL SELECT 'src/core/gone.ts' UNION ALL SELECT 'build/x.ts' UNION ALL SELECT '../out.ts' UNION ALL SELECT 'src/core/m1.ts' UNION ALL SELECT 'src/core/never.ts') SELECT path, CASE WHEN n > 500 THEN 'scan' WHEN path = 'build/x.ts' THEN 'ignored' WHEN path IN ('../out.ts', 'src/core/never.ts') THEN 'unsupported' WHEN path = 'src/core/gone.ts' THEN 'deleted' WHEN path LIKE '%.json' THEN 'unsupported' ELSE 'changed' END AS state FROM (SELECT DISTINCT path FROM c), (SELECT count(DISTINCT path) AS n FROM c)")
def dirty_plan(s, d):
    f = dt.code_files(s, d)
    more = s.createDataFrame([("src/core/gone.ts",), ("build/x.ts",), ("../out.ts",), ("src/core/m1.ts",), ("src/core/never.ts",)], "path string")
    present = f.select("path", F.lit(10).alias("size"), F.lit(False).alias("folder"))
    return incremental.dirty_plan(f.where("id <> 'f1'").select("path").unionByName(more), present, f.select("path").unionByName(more.where("path like '%gone%'")))


DIRTY = "dirty AS (SELECT id FROM code_files WHERE id IN ('f1', 'f4'))"


@query(f"{C}, {DIRTY} SELECT id FROM dirty UNION SELECT from_id FROM code_edges WHERE type = 'IMPORTS' AND to_id IN (SELECT id FROM dirty)")
def dirty_expand(s, d):
    return incremental.expand_dirty(dt.code_files(s, d).where("id in ('f1', 'f4')").select("id"), dt.code_edges(s, d).where("type = 'IMPORTS'"))


@query(f"{C}, touched AS (SELECT id FROM code_symbols WHERE file_id IN ('f1', 'f4') UNION SELECT 'f1' UNION SELECT 'f4') SELECT from_id, to_id, type FROM code_edges")
def incremental_equals_full(s, d):
    """The dirty files' edges are stale in the old index and come anew: the result is the full index."""
    e, y = dt.code_edges(s, d), dt.code_symbols(s, d)
    dirty = y.where("file_id in ('f1', 'f4')").select("id").unionByName(s.createDataFrame([("f1",), ("f4",)], "id string"))
    touches = e.join(dirty.withColumnRenamed("id", "from_id"), "from_id", "left_semi").unionByName(e.join(dirty.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(e.columns)).distinct().select(e.columns)
    old = e.withColumn("confidence", F.col("confidence") * 0)
    return incremental.rebuild_edges(old, touches, dirty).select("from_id", "to_id", "type")


@query("SELECT 'o' || l_orderkey AS from_id, 's' || l_suppkey AS to_id, max_by(l_discount, l_partkey * 10 + l_linenumber + l_discount) AS confidence, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS evidence FROM lineitem GROUP BY 1, 2")
def edge_write_buffer(s, d):
    li = dt.table(s, d, "lineitem")
    w = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_id"), F.lit("HAS").alias("type"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("evidence"), F.struct(F.col("l_partkey") * 10 + F.col("l_linenumber"), "l_discount").alias("seq"))
    return incremental.write_buffer(w).select("from_id", "to_id", "confidence", F.array_join("evidence", ",").alias("evidence"))


STATE = "list_extract(['indexing', 'committing', 'completed', 'failed'], (event_id % 4 + 1)::INTEGER)"


@query(f"WITH e AS (SELECT user_id AS run, {STATE} AS event, event_id AS seq FROM events), l AS (SELECT run, max_by(event, seq) AS event, max(seq) AS seq, min(seq) AS began FROM e GROUP BY 1) SELECT run, CASE WHEN event IN ('indexing', 'committing') AND (SELECT max(began) FROM l) > seq THEN 'interrupted' ELSE event END AS state FROM l")
def run_lifecycle(s, d):
    state = F.element_at(F.array(*map(F.lit, ("indexing", "committing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return incremental.run_state(dt.table(s, d, "events").select(F.col("user_id").alias("run"), state.alias("event"), F.col("event_id").alias("seq")))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'free' WHEN epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) > 21600 THEN 'stale' ELSE 'held' END AS lock_state FROM events")
def lock_state(s, d):
    held = F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp"))
    return dt.table(s, d, "events").select("event_id", incremental.lock_state(held, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("lock_state"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 = 0 THEN 'missing' WHEN o_custkey % 7 = 0 THEN 'rebuilding' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 3 > 0 OR o_orderpriority <> '1-URGENT' THEN 'stale' ELSE 'fresh' END AS status FROM orders")
def index_freshness(s, d):
    o = dt.table(s, d, "orders")
    i = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 11 != 0).alias("exists"), (F.col("o_custkey") % 7 == 0).alias("indexing"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("watch_status"), F.lit(None).cast("string").alias("watch_error"), (F.col("o_orderkey") % 3).alias("changed"), F.col("o_orderpriority").alias("indexed_commit"), F.lit("1-URGENT").alias("commit"))
    return incremental.freshness(i).select("id", "status")


@query("SELECT 'u/' || user_id AS path, CASE WHEN max(event_id) <= (SELECT max(event_id) - 20 FROM events) THEN 'in_flight' ELSE 'pending' END AS state FROM events GROUP BY user_id HAVING max(event_id) > (SELECT max(event_id) - 100 FROM events)")
def pending_changes(s, d):
    e = dt.table(s, d, "events")
    last = e.agg(F.max("event_id").alias("m"))
    runs = last.select((F.col("m") - 100).alias("upto"), F.lit(True).alias("done")).unionByName(last.select((F.col("m") - 20).alias("upto"), F.lit(False).alias("done")))
    return incremental.pending(e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq")), runs)


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts))::INTEGER AS days FROM events")
def json_and_dates(s, d):
    ts = F.col("ts").cast("timestamp")
    return dt.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("week"), F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("days"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parts(s, d):
    u = F.col("url")
    return dt.table(s, d, "pages").select("page_id", F.parse_url(u, F.lit("HOST")).alias("host"), F.regexp_extract(u, "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"), F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


@query("SELECT c_custkey AS id, list_sort(list_intersect(a, b))::VARCHAR AS both, len(list_distinct(list_concat(a, b)))::INTEGER AS either FROM (SELECT c_custkey, [c_nationkey, c_custkey % 25, c_custkey % 7]::BIGINT[] AS a, [c_nationkey, c_custkey % 5]::BIGINT[] AS b FROM customer)")
def set_arrays(s, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    a, b = F.array(n, k % 25, k % 7), F.array(n, k % 5)
    both = F.concat(F.lit("["), F.array_join(F.array_sort(F.array_intersect(a, b)).cast("array<string>"), ", "), F.lit("]"))
    return dt.table(s, d, "customer").select(k.alias("id"), both.alias("both"), F.size(F.array_union(a, b)).alias("either"))


@query(f"SELECT {', '.join(f'count(*) FILTER (kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('documents', 'pages', 'conversations'))}, to_json({{'documents': count(*) FILTER (kind = 'documents'), 'pages': count(*) FILTER (kind = 'pages')}})::VARCHAR AS document FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'conversations' FROM conversations)")
def wiki_document(s, d):
    parts = [dt.table(s, d, k).select(F.lit(k).alias("kind")) for k in ("documents", "pages", "conversations")]
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    g = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(n("documents"), n("pages"), n("conversations"))
    return g.select("documents", "pages", "conversations", F.to_json(F.struct("documents", "pages")).alias("document"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'pages' FROM pages WHERE html = '' UNION ALL SELECT 'conversations' FROM conversations WHERE text = '' UNION ALL SELECT 'orders' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'none') GROUP BY 1")
def invariant_union(s, d):
    t = lambda n: dt.table(s, d, n)
    kind = lambda df, n: df.select(F.lit(n).alias("kind"))
    anti = lambda a, b, x, y: kind(t(a).join(t(b), F.col(x) == F.col(y), "left_anti"), a)
    out = kind(t("documents").where("text is null or text = ''"), "documents").unionByName(kind(t("pages").where("html = ''"), "pages")).unionByName(kind(t("conversations").where("text = ''"), "conversations"))
    labels = kind(t("labels").join(t("documents").select("doc_id"), "doc_id", "left_anti"), "labels")
    out = out.unionByName(anti("orders", "customer", "o_custkey", "c_custkey")).unionByName(anti("lineitem", "orders", "l_orderkey", "o_orderkey")).unionByName(anti("customer", "nation", "c_nationkey", "n_nationkey")).unionByName(labels)
    return out.unionByName(s.createDataFrame([("none",)], "kind string")).groupBy("kind").agg(F.count("*").alias("n"))
