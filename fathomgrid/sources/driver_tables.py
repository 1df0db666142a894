"""Generic relations (docs, files, nodes, edges, vectors, ledger, changes, memories) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("hash"))


def place_edges(spark, sf_dir) -> DataFrame:
    """(from_id, to_id, type, confidence): customer and supplier in nation, nation in region."""
    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))

    def edge(df, a, b, kind, conf):
        return df.select(F.concat(F.lit(a[0]), F.col(a[1]).cast("string")).alias("from_id"), F.concat(F.lit(b[0]), F.col(b[1]).cast("string")).alias("to_id"), F.lit(kind).alias("type"), F.lit(conf).alias("confidence"))

    return (
        edge(c, ("c", "c_custkey"), ("n", "c_nationkey"), "IN", 0.95)
        .unionByName(edge(s, ("s", "s_suppkey"), ("n", "s_nationkey"), "IN", 0.75))
        .unionByName(edge(n, ("n", "n_nationkey"), ("r", "n_regionkey"), "PART_OF", 0.95))
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def changes(spark, sf_dir) -> DataFrame:
    """(path, op, ts): events read as file changes, one path per user."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), "ts", F.col("event_id").alias("seq"))


#: The code index over the driver's tables, in SQL: files are suppliers, symbols are parts, edges line items.
CODE = """code_files AS (SELECT 'f' || s_suppkey AS id, 'src/' || list_extract(['core', 'api', 'lib', 'web', 'util'], ((s_suppkey // 10) % 5 + 1)::INTEGER) || '/m' || CASE s_suppkey % 10 WHEN 9 THEN (s_suppkey - 1) || '.test.ts' WHEN 7 THEN s_suppkey || '.json' WHEN 6 THEN s_suppkey || '.py' WHEN 5 THEN s_suppkey || '.js' ELSE s_suppkey || '.ts' END AS path, CASE s_suppkey % 10 WHEN 9 THEN 'test' WHEN 7 THEN 'config' ELSE 'source' END AS role FROM supplier),
code_symbols AS (SELECT 's' || p_partkey AS id, 'f' || (p_partkey // 20) AS file_id, replace(p_name, ' ', '_') AS name, list_extract(['class', 'method', 'function', 'interface', 'variable', 'constant'], (p_partkey % 6 + 1)::INTEGER) AS kind, (p_partkey % 20 * 10 + 1)::BIGINT AS start_line, (p_partkey % 20 * 10 + CASE WHEN p_partkey % 6 = 0 THEN 28 ELSE 8 END)::BIGINT AS end_line FROM part),
code_edges AS (SELECT from_id, to_id, type, max(confidence) AS confidence FROM (SELECT CASE WHEN l_linenumber IN (2, 7) THEN 'f' || (l_partkey // 20) ELSE 's' || l_partkey END AS from_id, CASE WHEN l_linenumber IN (2, 7) THEN 'f' || l_suppkey ELSE 's' || (l_suppkey * 20 + l_orderkey % 20) END AS to_id, list_extract(['CALLS', 'IMPORTS', 'REFERENCES', 'TESTS', 'EXTENDS', 'IMPLEMENTS', 'CONFIGURES'], l_linenumber) AS type, round(1 - 4 * l_discount, 2) AS confidence FROM lineitem) GROUP BY ALL)"""


def _named(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), key.cast("long").cast("string"))


def code_files(spark, sf_dir) -> DataFrame:
    """(id, path, role): see ``CODE``."""
    k = F.col("s_suppkey")
    folder = F.element_at(F.array(*map(F.lit, ("core", "api", "lib", "web", "util"))), (F.floor(k / 10) % 5 + 1).cast("int"))
    last = k % 10
    name = F.when(last == 9, F.concat((k - 1).cast("string"), F.lit(".test.ts")))
    for digit, suffix in ((7, ".json"), (6, ".py"), (5, ".js")):
        name = name.when(last == digit, F.concat(k.cast("string"), F.lit(suffix)))
    path = F.concat(F.lit("src/"), folder, F.lit("/m"), name.otherwise(F.concat(k.cast("string"), F.lit(".ts"))))
    return table(spark, sf_dir, "supplier").select(_named("f", k).alias("id"), path.alias("path"), F.when(last == 9, "test").when(last == 7, "config").otherwise("source").alias("role"))


def code_symbols(spark, sf_dir) -> DataFrame:
    """(id, file_id, name, kind, start_line, end_line): see ``CODE``."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("class", "method", "function", "interface", "variable", "constant"))), (k % 6 + 1).cast("int"))
    at = k % 20 * 10
    return table(spark, sf_dir, "part").select(_named("s", k).alias("id"), _named("f", F.floor(k / 20)).alias("file_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), kind.alias("kind"), (at + 1).alias("start_line"), (at + F.when(k % 6 == 0, 28).otherwise(8)).alias("end_line"))


def code_edges(spark, sf_dir) -> DataFrame:
    """(from_id, to_id, type, confidence), one row for each edge: see ``CODE``."""
    n, files = F.col("l_linenumber"), F.col("l_linenumber").isin(2, 7)
    kind = F.element_at(F.array(*map(F.lit, ("CALLS", "IMPORTS", "REFERENCES", "TESTS", "EXTENDS", "IMPLEMENTS", "CONFIGURES"))), n)
    start = F.when(files, _named("f", F.floor(F.col("l_partkey") / 20))).otherwise(_named("s", F.col("l_partkey")))
    end = F.when(files, _named("f", F.col("l_suppkey"))).otherwise(_named("s", F.col("l_suppkey") * 20 + F.col("l_orderkey") % 20))
    e = table(spark, sf_dir, "lineitem").select(start.alias("from_id"), end.alias("to_id"), kind.alias("type"), F.round(1 - 4 * F.col("l_discount"), 2).alias("confidence"))
    return e.groupBy("from_id", "to_id", "type").agg(F.max("confidence").alias("confidence"))
