"""Operators of the code index as queries, each with its SQL: see ``driver_tables.CODE`` for the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code, graph, retrieval, session
from ..sources import driver_tables as dt
from .catalog import TOK, _case, query

C = f"WITH {dt.CODE}"
R = f"WITH RECURSIVE {dt.CODE}"
SYMBOL, FILE, NAME = "s7", "f3", "ring"
PLACED = "SELECT s.*, f.path FROM code_symbols s JOIN code_files f ON f.id = s.file_id"
NODES = f"nodes AS (SELECT id, name, kind, path, start_line FROM ({PLACED}) UNION ALL SELECT id, list_last(string_split(path, '/')), 'file', path, 0 FROM code_files)"


def _index(s, d):
    return dt.code_files(s, d), dt.code_symbols(s, d), dt.code_edges(s, d)


@query(f"{C} SELECT id, name, kind FROM code_symbols WHERE id = '{SYMBOL}'")
def point_lookup(s, d):
    return dt.code_symbols(s, d).where(F.col("id") == SYMBOL).select("id", "name", "kind")


@query(f"{C} SELECT id, name FROM code_symbols WHERE file_id IN (SELECT id FROM code_files WHERE role = 'test')")
def in_list_lookup(s, d):
    f, y, _ = _index(s, d)
    return y.join(f.where("role = 'test'").select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id", "name")


@query(f"{C} SELECT id, name FROM code_symbols WHERE contains(lower(name), '{NAME}')")
def substring_filter(s, d):
    return dt.code_symbols(s, d).where(F.contains(F.lower("name"), F.lit(NAME))).select("id", "name")


STOP = ", ".join(f"'{w}'" for w in sorted(retrieval.STOP))


@query(f"SELECT conv_id, turn, len(list_filter({TOK}, lambda x: x NOT IN ({STOP})))::INTEGER AS kept FROM conversations")
def stop_word_filter(s, d):
    return dt.table(s, d, "conversations").select("conv_id", "turn", F.size(F.filter(tx.tokens(F.col("text")), lambda x: ~x.isin(*sorted(retrieval.STOP)))).alias("kept"))


@query(rf"{C} SELECT id, path FROM code_files WHERE NOT regexp_matches(path, '(^|/)[^/]*\.json(/|$)') AND NOT regexp_matches(path, '^src/web/')")
def ignored_filter(s, d):
    return dt.code_files(s, d).where(~tx.ignored(F.col("path"), ("*.json", "/src/web/"))).select("id", "path")


LANG = _case(((lang, f"regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) IN ({', '.join(repr(e) for e in every)})") for lang, every in tx.LANGUAGES.items()), "'unknown'")


@query(f"{C}, l AS (SELECT *, {LANG} AS language FROM code_files) SELECT id, language, {_case(((r, f'regexp_matches(path, {chr(39)}{rule}{chr(39)})') for r, rule in tx.ROLES), chr(39) + 'source' + chr(39))} AS file_role FROM l")
def file_language_role(s, d):
    p = F.col("path")
    return dt.code_files(s, d).select("id", tx.language_of(p).alias("language"), tx.role_of(p).alias("file_role"))


SPEC = "CASE p_size % 3 WHEN 0 THEN './' || p_brand WHEN 1 THEN '@' || lower(p_type) || '/' || p_brand || '/sub' ELSE lower(p_brand) || '/x' END"


@query(f"SELECT package, count(*) AS uses, count(DISTINCT p_partkey // 20) AS files FROM (SELECT p_partkey, CASE WHEN x LIKE './%' THEN NULL WHEN x LIKE '@%' THEN string_split(x, '/')[1] || '/' || string_split(x, '/')[2] ELSE string_split(x, '/')[1] END AS package FROM (SELECT p_partkey, {SPEC} AS x FROM part)) WHERE package IS NOT NULL GROUP BY 1")
def external_dependencies(s, d):
    k = F.col("p_size") % 3
    spec = F.when(k == 0, F.concat(F.lit("./"), "p_brand")).when(k == 1, F.concat(F.lit("@"), F.lower("p_type"), F.lit("/"), "p_brand", F.lit("/sub"))).otherwise(F.concat(F.lower("p_brand"), F.lit("/x")))
    p = dt.table(s, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("file"), tx.external(spec).alias("package")).where("package is not null")
    return p.groupBy("package").agg(F.count("*").alias("uses"), F.countDistinct("file").alias("files"))


@query(f"{C} SELECT item, owner FROM (SELECT a.id AS item, b.id AS owner, row_number() OVER (PARTITION BY a.id ORDER BY b.end_line - b.start_line, b.id) AS k FROM code_symbols a JOIN code_symbols b ON a.file_id = b.file_id AND b.start_line <= a.start_line AND a.end_line <= b.end_line WHERE a.kind NOT IN ('class', 'interface') AND b.kind IN ('class', 'interface')) WHERE k = 1")
def span_owner(s, d):
    return code.owners(dt.code_symbols(s, d))


@query(f"{C} SELECT y.file_id, count(*) AS unsure FROM code_edges e JOIN code_symbols y ON y.id = e.from_id WHERE e.type = 'CALLS' AND e.confidence < 0.7 GROUP BY 1 ORDER BY unsure DESC, y.file_id LIMIT 5")
def unresolved_per_file(s, d):
    _, y, e = _index(s, d)
    return e.where("type = 'CALLS' and confidence < 0.7").join(y.select(F.col("id").alias("from_id"), "file_id"), "from_id").groupBy("file_id").agg(F.count("*").alias("unsure")).orderBy(F.desc("unsure"), "file_id").limit(5)


@query(f"{C} SELECT from_id, rank, a || ' → ' || b AS chain FROM (SELECT e.from_id, x.name AS a, y.name AS b, row_number() OVER (PARTITION BY e.from_id ORDER BY y.name, e.to_id)::INTEGER AS rank FROM code_edges e JOIN code_symbols x ON x.id = e.from_id JOIN code_symbols y ON y.id = e.to_id WHERE e.type = 'CALLS') WHERE rank <= 5")
def call_pairs(s, d):
    _, y, e = _index(s, d)
    return code.call_pairs(e, y, 5)


@query(f"{C} SELECT file_id, name, start_line, id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY start_line DESC) AS k FROM code_symbols) WHERE k = 1")
def latest_binding(s, d):
    return session.first_candidate(dt.code_symbols(s, d), ["file_id", "name"], [F.desc("start_line")]).select("file_id", "name", "start_line", "id")


@query(f"{C}, g AS (SELECT type, count(*) AS n, count(*) FILTER (confidence < 0.8) AS low FROM code_edges GROUP BY 1) SELECT type, n, low, round(low / n, 6) AS ratio, low / n > 0.3 AS poor FROM g")
def health_ratios(s, d):
    g = dt.code_edges(s, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.8).alias("low"))
    ratio = F.col("low") / F.col("n")
    return g.select("type", "n", "low", F.round(ratio, 6).alias("ratio"), (ratio > 0.3).alias("poor"))


@query(f"{C} SELECT f.role, " + ", ".join(f"count(*) FILTER (s.kind = '{k}') AS \"{k}\"" for k in ("class", "method", "function", "interface", "variable", "constant")) + " FROM code_symbols s JOIN code_files f ON f.id = s.file_id GROUP BY 1")
def counts_by_kind(s, d):
    f, y, _ = _index(s, d)
    return y.join(f.select(F.col("id").alias("file_id"), "role"), "file_id").groupBy("role").pivot("kind", ["class", "method", "function", "interface", "variable", "constant"]).count().na.fill(0)


@query("SELECT quality, count(*) AS n, round(avg(toxic), 3) AS mean_toxic, round(avg(n_chars), 3) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def benchmark_means(s, d):
    return dt.table(s, d, "labels").join(dt.table(s, d, "documents"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 3).alias("mean_toxic"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))


@query(f"{C}, {NODES}, i AS (SELECT DISTINCT to_id AS id FROM code_edges UNION SELECT 'nowhere') SELECT i.id, coalesce(n.name, i.id) AS name, coalesce(n.kind, 'unknown') AS kind, coalesce(n.path, '') AS path FROM i LEFT JOIN nodes n ON n.id = i.id")
def node_lookup(s, d):
    f, y, e = _index(s, d)
    ids = e.select(F.col("to_id").alias("id")).unionByName(s.createDataFrame([("nowhere",)], "id string")).distinct()
    return code.lookup(ids, y, f).select("id", "name", "kind", "path")


@query("SELECT (SELECT count(*) FROM documents) AS refs, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS stale")
def store_drift(s, d):
    a, b = dt.table(s, d, "documents").select(F.col("doc_id").alias("id")), dt.table(s, d, "embeddings").select(F.col("vec_id").alias("id"))
    both = a.groupBy("id").agg(F.count("*").alias("refs")).join(b.groupBy("id").agg(F.count("*").alias("vectors")), "id", "full_outer").na.fill(0)
    return both.agg(F.sum("refs").alias("refs"), F.sum("vectors").alias("vectors"), F.sum(F.when(F.col("vectors") == 0, F.col("refs")).otherwise(0)).alias("missing"), F.sum(F.when(F.col("refs") == 0, F.col("vectors")).otherwise(0)).alias("stale"))


def _path_tokens(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: regexp_replace(w, 's$', '')), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in tx.PATH_STOP)})))"


TARGET = "src/core/m8.ts"


@query(f"{C} SELECT path AS test, n AS shared, round(least(0.7, 0.45 + n * 0.1), 6)::DOUBLE AS confidence FROM (SELECT path, len(list_intersect({_path_tokens('path')}, {_path_tokens(repr(TARGET))}))::INTEGER AS n FROM code_files WHERE role = 'test') WHERE n > 0 ORDER BY n DESC, path LIMIT 5")
def related_tests_tokens(s, d):
    return code.token_tests(dt.code_files(s, d), TARGET)


IMPORTS = "i AS (SELECT DISTINCT a.path AS importer, './' || regexp_replace(list_last(string_split(b.path, '/')), '\\.ts$', '.js') AS specifier FROM code_edges e JOIN code_files a ON a.id = e.from_id JOIN code_files b ON b.id = e.to_id WHERE e.type = 'IMPORTS')"


@query(f"""{C}, {IMPORTS}, p AS (SELECT importer, specifier, regexp_replace(importer, '[^/]*$', '') || substr(specifier, 3) AS path FROM i),
t AS (SELECT importer, specifier, unnest([1, 2, 3]) AS nth, unnest([regexp_replace(path, '\\.js$', '.ts'), regexp_replace(path, '\\.js$', '.tsx'), path]) AS target FROM p WHERE path LIKE '%.js' UNION ALL SELECT importer, specifier, 1, path FROM p WHERE path NOT LIKE '%.js')
SELECT importer, specifier, target FROM (SELECT t.*, row_number() OVER (PARTITION BY importer, specifier ORDER BY nth) AS k FROM t JOIN code_files f ON f.path = t.target) WHERE k = 1""")
def import_resolution_ranked(s, d):
    f, _, e = _index(s, d)
    i = e.where("type = 'IMPORTS'").join(f.select(F.col("id").alias("from_id"), F.col("path").alias("importer")), "from_id").join(f.select(F.col("id").alias("to_id"), F.col("path").alias("other")), "to_id")
    i = i.select("importer", F.concat(F.lit("./"), F.regexp_replace(F.element_at(F.split("other", "/"), -1), r"\.ts$", ".js")).alias("specifier")).distinct()
    return code.resolve_imports(i, f)


@query("""WITH r AS (SELECT 'r' || r_regionkey AS file, r_name AS name FROM region), n AS (SELECT 'n' || n_nationkey AS file, 'r' || n_regionkey AS source FROM nation), c AS (SELECT 'c' || c_custkey AS file, 'n' || c_nationkey AS source FROM customer)
SELECT file, name, file AS origin, name AS origin_name FROM r UNION ALL SELECT n.file, r.name, r.file, r.name FROM n JOIN r ON r.file = n.source UNION ALL SELECT c.file, 'the_' || r.name, r.file, r.name FROM c JOIN n ON n.file = c.source JOIN r ON r.file = n.source""")
def reexport_closure(s, d):
    """Regions define a name, nations pass on all names of theirs, customers pass one on under another name."""
    r, n, c = (dt.table(s, d, x) for x in ("region", "nation", "customer"))
    ref = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    none = F.lit(None).cast("string")
    rows = r.select(ref("r", "r_regionkey").alias("file"), F.col("r_name").alias("name"), none.alias("source"), none.alias("source_name"))
    rows = rows.unionByName(n.select(ref("n", "n_nationkey").alias("file"), F.lit("*").alias("name"), ref("r", "n_regionkey").alias("source"), none.alias("source_name")))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return code.reexport_closure(rows.unionByName(named.select(ref("c", "c_custkey").alias("file"), F.concat(F.lit("the_"), "r_name").alias("name"), ref("n", "c_nationkey").alias("source"), F.col("r_name").alias("source_name"))))


@query(f"""{C}, calls AS (SELECT e.from_id || '>' || e.to_id AS call_id, a.file_id, b.name AS callee FROM code_edges e JOIN code_symbols a ON a.id = e.from_id JOIN code_symbols b ON b.id = e.to_id WHERE e.type = 'CALLS'),
imp AS (SELECT e.from_id AS file_id, y.name, y.id FROM code_edges e JOIN code_symbols y ON y.file_id = e.to_id WHERE e.type = 'IMPORTS'),
c AS (SELECT call_id, y.id AS target, 0.90::DOUBLE AS confidence, 5 AS rule FROM calls JOIN code_symbols y ON y.file_id = calls.file_id AND y.name = callee WHERE y.kind IN ('function', 'variable', 'constant', 'method')
UNION ALL SELECT call_id, imp.id, 0.92, 6 FROM calls JOIN imp ON imp.file_id = calls.file_id AND imp.name = callee)
SELECT call_id, target, confidence, rule FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rule, target) AS k FROM c) WHERE k = 1""")
def call_resolution_ranked(s, d):
    _, y, e = _index(s, d)
    a, b = y.select(F.col("id").alias("from_id"), "file_id"), y.select(F.col("id").alias("to_id"), F.col("name").alias("callee"))
    calls = e.where("type = 'CALLS'").join(a, "from_id").join(b, "to_id")
    calls = calls.select(F.concat_ws(">", "from_id", "to_id").alias("call_id"), "file_id", F.col("from_id").alias("caller"), "callee", F.lit(None).cast("string").alias("receiver"), F.lit(False).alias("constructs"))
    imported = e.where("type = 'IMPORTS'").select(F.col("from_id").alias("into"), F.col("to_id").alias("file_id")).join(y, "file_id").select(F.col("into").alias("file_id"), "name", F.col("id").alias("symbol_id"), "kind")
    return code.resolve_calls(calls, y, imported)


@query(f"{C}, t AS (SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, start_line, id) AS k FROM ({PLACED}) WHERE kind IN ('class', 'interface')) WHERE k = 1) SELECT e.from_id, y.name, t.id AS to_id, 0.90::DOUBLE AS confidence FROM code_edges e JOIN code_symbols y ON y.id = e.to_id JOIN t ON t.name = y.name WHERE e.type = 'EXTENDS'")
def type_relations(s, d):
    f, y, e = _index(s, d)
    rel = e.where("type = 'EXTENDS'").join(y.select(F.col("id").alias("t"), "name"), F.col("to_id") == F.col("t")).select("from_id", "name", F.lit(None).cast("string").alias("to_id"))
    return code.type_edges(rel, y, f)


ROUTES = "e AS (SELECT 'p' || p_partkey AS id, '/' || p_brand AS path, CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method FROM part), r AS (SELECT 'o' || o_orderkey AS ref_id, '/Brand#' || (o_orderkey % 40) AS path, CASE o_custkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method FROM orders)"


@query(f"WITH {ROUTES} SELECT ref_id, endpoint, CASE WHEN endpoint IS NULL THEN 0.0 WHEN other = 0 THEN 0.88 ELSE 0.72 END::DOUBLE AS confidence, CASE WHEN endpoint IS NULL THEN 'unresolved' WHEN other = 0 THEN 'resolved' ELSE 'ambiguous' END AS status FROM (SELECT ref_id, e.id AS endpoint, CASE WHEN e.method = r.method THEN 0 ELSE 1 END AS other, row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN e.method = r.method THEN 0 ELSE 1 END, e.id) AS k FROM r LEFT JOIN e ON e.path = r.path) WHERE k = 1")
def route_resolution(s, d):
    p, o = dt.table(s, d, "part"), dt.table(s, d, "orders")
    # the first endpoint of each path and method is all that a reference can mean
    e = p.groupBy(F.concat(F.lit("/"), "p_brand").alias("path"), F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("method")).agg(F.min(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("id"))
    k = F.col("o_custkey") % 3
    r = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("ref_id"), F.concat(F.lit("/Brand#"), (F.col("o_orderkey") % 40).cast("string")).alias("path"), F.when(k == 0, "GET").when(k == 1, "POST").otherwise("PUT").alias("method"))
    return code.route_edges(r, e)


@query(f"{C} SELECT a.id AS from_id, b.id AS to_id, 0.55::DOUBLE AS confidence FROM code_files a JOIN code_files b ON starts_with(b.path, regexp_replace(a.path, '[^/]*$', '')) WHERE a.role = 'config' AND b.role = 'source'")
def config_edges(s, d):
    return code.config_edges(dt.code_files(s, d))


@query(f"{C}, p AS (SELECT DISTINCT e.from_id AS f, e.to_id AS t FROM code_edges e JOIN code_files x ON x.id = e.from_id WHERE e.type = 'IMPORTS' AND x.role = 'test') SELECT a.id AS from_id, b.id AS to_id, 0.82::DOUBLE AS confidence FROM p JOIN code_symbols a ON a.file_id = p.f JOIN code_symbols b ON b.file_id = p.t")
def symbol_test_edges(s, d):
    f, y, e = _index(s, d)
    return code.test_edges(e.where("type = 'IMPORTS'"), f, y)


NAMING = "naming AS (SELECT a.path, b.path AS test FROM code_files a JOIN code_files b ON b.path IN (regexp_replace(a.path, '\\.[^.]+$', '') || '.test.ts', regexp_replace(a.path, '\\.[^.]+$', '') || '.spec.ts', regexp_replace(a.path, '\\.[^.]+$', '') || '.test.js', regexp_replace(a.path, '\\.[^.]+$', '') || '.spec.js', regexp_replace(a.path, '/?[^/]*$', '') || '/__tests__/' || list_last(string_split(a.path, '/'))) WHERE a.role = 'source')"


@query(f"{C}, {NAMING} SELECT path, test FROM naming")
def naming_tests(s, d):
    return code.naming_tests(dt.code_files(s, d))


TESTED = "t AS (SELECT e.*, coalesce(a.file_id, e.from_id) AS by_file FROM code_edges e LEFT JOIN code_symbols a ON a.id = e.from_id WHERE e.type = 'TESTS')"


@query(f"""{C}, {NAMING}, {TESTED}, m AS (SELECT by_file, 'edge to a symbol' AS method, 0.95::DOUBLE AS confidence, 0 AS rank FROM t JOIN code_symbols y ON y.id = t.to_id WHERE y.file_id = '{FILE}' UNION ALL SELECT by_file, 'edge to the file', 0.90, 1 FROM t WHERE to_id = '{FILE}'
UNION ALL SELECT b.id, 'name', 0.75, 2 FROM naming JOIN code_files a ON a.path = naming.path JOIN code_files b ON b.path = naming.test WHERE a.id = '{FILE}'
UNION ALL SELECT * FROM (SELECT e.from_id, 'imports', 0.85, 3 FROM code_edges e JOIN code_files f ON f.id = e.from_id WHERE e.type = 'IMPORTS' AND f.role = 'test' AND e.to_id = '{FILE}' ORDER BY e.from_id LIMIT 20))
SELECT test, method, confidence FROM (SELECT f.path AS test, m.*, row_number() OVER (PARTITION BY f.path ORDER BY rank, by_file) AS k FROM m JOIN code_files f ON f.id = m.by_file) WHERE k = 1""")
def related_tests(s, d):
    f, y, e = _index(s, d)
    return code.related_tests(e, y, f, FILE)


@query(f"{C}, {NAMING}, c AS (SELECT DISTINCT coalesce(y.file_id, e.to_id) AS id FROM code_edges e LEFT JOIN code_symbols y ON y.id = e.to_id WHERE e.type = 'TESTS' UNION SELECT f.id FROM naming JOIN code_files f ON f.path = naming.path) SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS files, count(c.id) AS covered, round(100 * count(c.id) / count(*))::BIGINT AS percent FROM code_files f LEFT JOIN c ON c.id = f.id WHERE role = 'source' GROUP BY 1")
def test_coverage(s, d):
    f, y, e = _index(s, d)
    return code.coverage(e, y, f)


def _walk(name: str, types: str, hops: int, inward: bool, floor: float, seed: str = SYMBOL) -> str:
    a, b = ("to_id", "from_id") if inward else ("from_id", "to_id")
    return f"{name}(node, distance) AS (SELECT '{seed}', 0 UNION SELECT e.{b}, w.distance + 1 FROM {name} w JOIN code_edges e ON e.{a} = w.node WHERE w.distance < {hops} AND e.type IN ({types}) AND e.confidence >= {floor})"


IMPACT = ", ".join([_walk("w1", "'CALLS'", 3, True, 0.8), _walk("w2", "'CALLS'", 2, False, 0.8), _walk("w3", "'REFERENCES'", 2, True, 0.0), _walk("w4", "'EXTENDS', 'IMPLEMENTS'", 2, True, 0.8), _walk("w5", "'TESTS'", 1, True, 0.8)]) + ", impact AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, node, min(distance)::INTEGER AS distance FROM w{n} GROUP BY node HAVING node <> '{SYMBOL}'" for n, k in enumerate(("caller", "callee", "reference", "implementor", "test"), 1)) + ")"


@query(f"{R}, {IMPACT} SELECT kind, node, distance FROM impact")
def impact_all(s, d):
    return code.impact(dt.code_edges(s, d), SYMBOL)


@query(f"{R}, {IMPACT}, {NODES}, a AS (SELECT kind, node, distance, CASE kind WHEN 'target' THEN 0 WHEN 'caller' THEN 1 WHEN 'callee' THEN 2 WHEN 'reference' THEN 3 WHEN 'implementor' THEN 4 ELSE 5 END AS r FROM (SELECT kind, node, distance FROM impact UNION ALL SELECT 'target', '{SYMBOL}', 0)) SELECT path, kind, distance, distance <= 1 AS direct FROM (SELECT n.path, a.*, row_number() OVER (PARTITION BY n.path ORDER BY distance, r, node) AS k FROM a JOIN nodes n ON n.id = a.node) WHERE k = 1")
def impact_files(s, d):
    f, y, e = _index(s, d)
    return code.affected_files(code.impact(e, SYMBOL), SYMBOL, y, f)


@query(f"{R}, {IMPACT}, g AS (SELECT count(*) FILTER (kind = 'caller') AS callers, count(*) FILTER (kind = 'implementor') AS implementors, coalesce(max(distance) FILTER (kind IN ('caller', 'callee')), 0) AS depth FROM impact), p AS (SELECT 'high' AS severity, 'pattern: auth' AS reason, true AS ok FROM g UNION ALL SELECT 'high', 'callers: ' || callers, callers > 10 FROM g UNION ALL SELECT 'medium', 'callers: ' || callers, callers BETWEEN 6 AND 10 FROM g UNION ALL SELECT 'medium', 'depth: ' || depth, depth >= 3 FROM g UNION ALL SELECT 'high', 'implementors: ' || implementors, implementors > 10 FROM g UNION ALL SELECT 'medium', 'implementors: ' || implementors, implementors BETWEEN 6 AND 10 FROM g) SELECT severity, reason FROM p WHERE ok")
def impact_risk_points(s, d):
    return code.risk_points(code.impact(dt.code_edges(s, d), SYMBOL), "OAuthMiddleware")


@query(f"{R}, {IMPACT} SELECT kind, rank, CASE kind WHEN 'caller' THEN name || ' → ' || own ELSE own || ' → ' || name END AS chain FROM (SELECT i.kind, y.name, (SELECT name FROM code_symbols WHERE id = '{SYMBOL}') AS own, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY distance, node)::INTEGER AS rank FROM impact WHERE kind IN ('caller', 'callee')) i JOIN code_symbols y ON y.id = i.node WHERE rank <= 5)")
def call_chains(s, d):
    _, y, e = _index(s, d)
    return code.call_chains(code.impact(e, SYMBOL), SYMBOL, y)


@query(f"{C} SELECT DISTINCT from_id AS config FROM code_edges WHERE type = 'CONFIGURES' AND to_id = '{FILE}'")
def related_configs(s, d):
    return code.related_configs(dt.code_edges(s, d), FILE)


@query(f"{C}, t(target) AS (VALUES ('src/core/m1.ts'), ('red_ring'), ('red_widget'), ('small_ring.red_widget'), ('nothing.here')), c AS (SELECT target, id, 0 AS r, '' AS p, 0 AS l FROM t JOIN code_files f ON f.path = target UNION ALL SELECT target, s.id, 1, s.path, s.start_line FROM t JOIN ({PLACED}) s ON s.name = target UNION ALL SELECT target, s.id, 2, lpad((o.end_line - o.start_line)::VARCHAR, 12, '0'), s.start_line FROM t JOIN code_symbols s ON s.name = string_split(target, '.')[2] JOIN code_symbols o ON o.file_id = s.file_id AND o.name = string_split(target, '.')[1] WHERE target LIKE '%.%' AND o.kind IN ('class', 'interface') AND o.start_line <= s.start_line AND s.end_line <= o.end_line AND NOT (o.start_line = s.start_line AND o.end_line = s.end_line)) SELECT target, id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY r, p, l, id) AS k FROM c) WHERE k = 1")
def resolve_target(s, d):
    f, y, _ = _index(s, d)
    t = s.createDataFrame([("src/core/m1.ts",), ("red_ring",), ("red_widget",), ("small_ring.red_widget",), ("nothing.here",)], "target string")
    return code.resolve_targets(t, y, f)


@query(f"{C} SELECT id, name, path, name = 'red_{NAME}' AS exact FROM ({PLACED}) WHERE contains(lower(name), 'red_{NAME}') ORDER BY CASE WHEN name = 'red_{NAME}' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 0 WHEN regexp_matches(path, '\\.jsx?$') THEN 1 ELSE 2 END, path, start_line, id LIMIT 30")
def find_definition(s, d):
    f, y, _ = _index(s, d)
    return code.find_definitions(y, f, f"red_{NAME}")


@query(f"""{C}, {NODES}, defs AS (SELECT id FROM ({PLACED}) WHERE name = 'red_{NAME}' ORDER BY CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 0 WHEN regexp_matches(path, '\\.jsx?$') THEN 1 ELSE 2 END, path, start_line, id LIMIT 5),
i AS (SELECT e.*, row_number() OVER (PARTITION BY to_id, type ORDER BY confidence DESC, from_id) AS r FROM code_edges e WHERE to_id IN (SELECT id FROM defs) AND type IN ('REFERENCES', 'CALLS', 'IMPORTS')),
b AS (SELECT i.type, i.from_id, n.path, n.start_line, i.confidence, row_number() OVER (PARTITION BY n.path, n.start_line ORDER BY i.confidence DESC, i.type, i.from_id) AS k FROM i JOIN nodes n ON n.id = i.from_id WHERE type = 'REFERENCES' OR (type = 'CALLS' AND r <= 10) OR (type = 'IMPORTS' AND r <= 5))
SELECT type AS kind, from_id AS id, path, confidence FROM b WHERE k = 1 ORDER BY confidence DESC, path, start_line, from_id LIMIT 100""")
def find_references(s, d):
    f, y, e = _index(s, d)
    return code.find_references(e, y, f, f"red_{NAME}")


@query(f"{R}, {_walk('w1', chr(39) + 'CALLS' + chr(39), 2, True, 0)}, {_walk('w2', chr(39) + 'CALLS' + chr(39), 2, False, 0)}, {_walk('w3', chr(39) + 'REFERENCES' + chr(39), 2, True, 0)}, {_walk('w4', chr(39) + 'IMPORTS' + chr(39), 1, True, 0)}, {_walk('w5', chr(39) + 'TESTS' + chr(39), 1, True, 0)} " + " UNION ALL ".join(f"SELECT '{b}' AS bucket, node, min(distance)::INTEGER AS distance FROM w{n} GROUP BY node HAVING node <> '{SYMBOL}'" for n, b in enumerate(("callers", "callees", "references", "dependents", "tests"), 1)))
def expand_context(s, d):
    return code.expand_context(dt.code_edges(s, d), SYMBOL)


@query(f"{C} SELECT DISTINCT from_id AS node FROM code_edges WHERE to_id = '{SYMBOL}' AND type = 'CALLS'")
def neighbours_in(s, d):
    return graph.neighbours(dt.code_edges(s, d), SYMBOL, "in", "CALLS")


@query(f"{C} SELECT to_id AS node FROM code_edges WHERE from_id = '{SYMBOL}' UNION SELECT from_id FROM code_edges WHERE to_id = '{SYMBOL}'")
def neighbours_both(s, d):
    return graph.neighbours(dt.code_edges(s, d), SYMBOL)


@query("SELECT 's1>n' || s_nationkey || '>r' || n_regionkey AS path, 2 AS distance, 0.3::DOUBLE AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def path_weight(s, d):
    end = dt.table(s, d, "supplier").where("s_suppkey = 1").join(dt.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()
    return graph.path_weight(dt.place_edges(s, d), "s1", f"r{end.n_regionkey}" if end else "r")


def _sub(seed: str, types: str) -> str:
    return f"{C}, e AS (SELECT * FROM code_edges WHERE type IN ({types})), n AS (SELECT '{seed}' AS node UNION SELECT to_id FROM e WHERE from_id = '{seed}' UNION SELECT from_id FROM e WHERE to_id = '{seed}') SELECT from_id, to_id, type FROM e WHERE from_id IN (SELECT node FROM n) AND to_id IN (SELECT node FROM n)"


@query(_sub(SYMBOL, "'CALLS', 'REFERENCES'"))
def subgraph_depth(s, d):
    return code.subgraph(dt.code_edges(s, d), [SYMBOL], 1, ["CALLS", "REFERENCES"]).select("from_id", "to_id", "type")


@query(_sub(SYMBOL, "'CALLS'"))
def call_graph(s, d):
    return code.subgraph(dt.code_edges(s, d), [SYMBOL], 1, ["CALLS"]).select("from_id", "to_id", "type")


@query(_sub(FILE, "'IMPORTS'"))
def dependency_graph(s, d):
    return code.subgraph(dt.code_edges(s, d), [FILE], 1, ["IMPORTS"]).select("from_id", "to_id", "type")


@query(_sub(SYMBOL, "'EXTENDS', 'IMPLEMENTS'"))
def inheritance_graph(s, d):
    return code.subgraph(dt.code_edges(s, d), [SYMBOL], 1, ["EXTENDS", "IMPLEMENTS"]).select("from_id", "to_id", "type")


SAYS = "CASE o_orderstatus WHEN 'O' THEN 'found by Route scan' WHEN 'F' THEN 'module resolver' WHEN 'P' THEN 'naming rule' ELSE o_orderpriority END"


@query(f"SELECT o_orderkey, CASE WHEN w = '' THEN 'heuristic' WHEN regexp_matches(w, 'route|framework') THEN 'framework' WHEN contains(w, 'resolve') THEN 'resolver' WHEN regexp_matches(w, 'heuristic|naming') THEN 'heuristic' ELSE 'parser' END AS provenance FROM (SELECT o_orderkey, lower({SAYS}) AS w FROM orders)")
def edge_provenance(s, d):
    c = F.col("o_orderstatus")
    says = F.when(c == "O", "found by Route scan").when(c == "F", "module resolver").when(c == "P", "naming rule").otherwise(F.col("o_orderpriority"))
    return dt.table(s, d, "orders").select("o_orderkey", code.provenance(says).alias("provenance"))


@query("SELECT 'o' || l_orderkey AS from_id, 'p' || l_partkey AS to_id, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS evidence FROM lineitem GROUP BY 1, 2")
def edge_evidence(s, d):
    li = dt.table(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_id"), F.lit("HAS").alias("type"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("col"))
    e = code.with_evidence(li.select("from_id", "to_id", "type").distinct(), li)
    return e.select("from_id", "to_id", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["line"].cast("string"), x["col"].cast("string"))), ",").alias("evidence"))


@query(f"{C} SELECT id AS symbol_id, name, 'route' AS kind FROM (SELECT y.id, CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END || ' /' || p_brand AS name, row_number() OVER (PARTITION BY p_size % 2, p_brand ORDER BY y.id) AS k FROM part JOIN code_symbols y ON y.id = 's' || p_partkey) WHERE k = 1")
def entry_points(s, d):
    f, y, _ = _index(s, d)
    routes = dt.table(s, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("symbol_id"), F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "p_brand").alias("path"))
    return code.entry_points(y, f, routes)


def _level(n: int) -> str:
    seen = " UNION ALL ".join(f"SELECT id, step FROM l{k}" for k in range(n))
    return f"a{n} AS (SELECT e.to_id AS id, p.id AS via, p.step AS parent, row_number() OVER (PARTITION BY e.to_id ORDER BY p.step) AS k FROM l{n - 1} p JOIN x e ON e.from_id = p.id WHERE e.to_id NOT IN (SELECT id FROM ({seen}))), l{n} AS (SELECT id, via, (SELECT max(step) FROM ({seen})) + row_number() OVER (ORDER BY parent, id) AS step FROM a{n} WHERE k = 1)"


@query(f"{C}, x AS (SELECT DISTINCT from_id, to_id FROM code_edges JOIN code_symbols y ON y.id = to_id WHERE type IN ('CALLS', 'IMPORTS')), l0 AS (SELECT '{SYMBOL}' AS id, NULL::VARCHAR AS via, 1 AS step), {_level(1)}, {_level(2)} " + " UNION ALL ".join(f"SELECT step::INTEGER AS step, id AS symbol_id, via, {k} AS depth FROM l{k}" for k in range(3)))
def flow_trace(s, d):
    _, y, e = _index(s, d)
    return code.trace(e, y, SYMBOL, depth=2)


ENTRY = f"SELECT id FROM code_symbols WHERE contains(lower(name), 'red_{NAME}') ORDER BY id LIMIT 100"


@query(f"{R}, {NODES}, w(node, distance) AS (SELECT id, 0 FROM ({ENTRY}) UNION SELECT e.to_id, w.distance + 1 FROM w JOIN code_edges e ON e.from_id = w.node WHERE w.distance < 2 AND e.type IN ('CALLS', 'IMPORTS', 'REFERENCES')), m AS (SELECT node, min(distance)::INTEGER AS distance FROM w GROUP BY 1) SELECT node, distance, CASE WHEN distance = 0 THEN 'entry' WHEN contains(lower(path), 'test') THEN 'test' WHEN kind IN ('class', 'interface') THEN 'model' WHEN kind = 'file' THEN 'module' ELSE 'step' END AS role FROM m JOIN nodes n ON n.id = m.node ORDER BY distance, node LIMIT 100")
def feature_trace(s, d):
    f, y, e = _index(s, d)
    return code.trace_feature(e, y, f, f"red_{NAME}")


PARTS = "n AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region), b AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)"


@query(f"WITH RECURSIVE {PARTS}, w(node, component) AS (SELECT node, node FROM n UNION SELECT b.dst, w.component FROM w JOIN b ON b.src = w.node) SELECT node, min(component) AS component FROM w GROUP BY 1")
def connected_components(s, d):
    e = dt.place_edges(s, d).where("type = 'PART_OF'")
    return graph.components(e, e.select(F.col("from_id").alias("node")).unionByName(dt.table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))).distinct())


@query()
def communities_louvain(s, d):
    """Sequential by definition: no SQL; tested on cliques and for its invariants."""
    e = dt.place_edges(s, d)
    return graph.communities(e, e.select(F.col("from_id").alias("node")).unionByName(e.select(F.col("to_id").alias("node"))).distinct())


@query("SELECT r_name AS community, n_name AS member, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY ALL")
def community_lookup(s, d):
    r = dt.table(s, d, "region")
    name = r.agg(F.min("r_name").alias("r_name"))
    n = r.join(F.broadcast(name), "r_name", "left_semi").join(dt.table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(dt.table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("community"), F.col("n_name").alias("member")).agg(F.count("c_custkey").alias("customers"))


@query(f"{C} SELECT 'file' AS section, path AS item FROM code_files WHERE id = '{FILE}' UNION ALL SELECT 'symbol', kind || ':' || name || ':' || start_line FROM code_symbols WHERE file_id = '{FILE}' UNION ALL SELECT * FROM (SELECT 'dependency', path FROM (SELECT DISTINCT to_id FROM code_edges WHERE type = 'IMPORTS' AND from_id = '{FILE}') JOIN code_files ON id = to_id ORDER BY path LIMIT 30) UNION ALL SELECT * FROM (SELECT 'dependent', path FROM (SELECT DISTINCT from_id FROM code_edges WHERE type = 'IMPORTS' AND to_id = '{FILE}') JOIN code_files ON id = from_id ORDER BY path LIMIT 30)")
def explain_module(s, d):
    f, y, e = _index(s, d)
    return code.explain_module(FILE, f, y, e)


@query("SELECT page_id, path, method, coalesce(refs, 0) AS refs, CASE WHEN refs IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM (SELECT page_id, regexp_extract(url, '//[^/]+(/[^?]*)', 1) AS path, CASE page_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method FROM pages) p LEFT JOIN (SELECT href, count(*) AS refs FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY 1) h ON h.href = p.path")
def route_endpoints(s, d):
    """Endpoints and how often pages refer to them; unresolved ones are shown too."""
    p = dt.table(s, d, "pages")
    refs = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("path")).groupBy("path").agg(F.count("*").alias("refs"))
    e = p.select("page_id", F.regexp_extract("url", "//[^/]+(/[^?]*)", 1).alias("path"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"))
    return e.join(refs, "path", "left").select("page_id", "path", "method", F.coalesce("refs", F.lit(0)).alias("refs"), F.when(F.col("refs").isNull(), "unresolved").otherwise("resolved").alias("status"))
