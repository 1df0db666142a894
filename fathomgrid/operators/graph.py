"""Graph operators over edges(from_id, to_id, type, confidence)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fathomgrid-graph-"))
    return df.checkpoint()


def directed(edges: DataFrame, direction: str = "out", types: list[str] | None = None, floor: float = 0.0) -> DataFrame:
    """(src, dst), distinct, in the direction walked."""
    e = edges.where(F.col("confidence") >= floor)
    if types:
        e = e.where(F.col("type").isin(types))
    out, back = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


#: Hops up to which a search is one plan; beyond, each hop is a job that ends the lineage.
SHORT = 3


def bfs(edges: DataFrame, seeds: list[str], hops: int, direction: str = "out", types: list[str] | None = None, floor: float = 0.0) -> DataFrame:
    """(node, distance) of every node but the seeds within ``hops``.

    A few hops are one plan of joins, each level distinct; more are a frontier with a visited anti-join,
    hop by hop.
    """
    spark = edges.sparkSession
    e = directed(edges, direction, types, floor)
    start = spark.createDataFrame([(s, 0) for s in seeds], "node string, distance int")
    if hops <= SHORT:
        level, every = start, start
        for d in range(1, hops + 1):
            level = level.select("node").join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("distance", F.lit(d))
            every = every.unionByName(level)
        return every.groupBy("node").agg(F.min("distance").alias("distance")).where("distance > 0")
    seen = front = start
    e = cut(e)
    for d in range(1, hops + 1):
        step = front.join(e, front.node == e.src).select(F.col("dst").alias("node"), F.lit(d).alias("distance")).distinct()
        front = cut(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 5) -> DataFrame:
    """(path, distance): the shortest directed path, smallest predecessor on ties."""
    spark = edges.sparkSession
    e = directed(edges)
    seen = front = spark.createDataFrame([(start, start, 0)], "node string, path string, distance int")
    for d in range(1, hops + 1):
        step = front.join(e, front.node == e.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path")).withColumn("distance", F.lit(d))
        front = cut(step.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
        if front.isEmpty() or not front.where(F.col("node") == end).isEmpty():
            break
    return seen.where(F.col("node") == end).select("path", "distance")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node)``."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(n.withColumnRenamed("node", "to_id"), "to_id", "left_semi")


def degree_risk(edges: DataFrame) -> DataFrame:
    """(node, callers, risk): more than 10 incoming high, more than 5 medium, else low."""
    n = edges.groupBy(F.col("to_id").alias("node")).agg(F.countDistinct("from_id").alias("callers"))
    return n.withColumn("risk", F.when(F.col("callers") > 10, "high").when(F.col("callers") > 5, "medium").otherwise("low"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node(id)."""
    n = nodes.select(F.col("id"))
    return edges.join(n.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(edges.columns).unionByName(edges.join(n.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(edges.columns)).distinct()


def louvain(nodes: list[str], edges: list[tuple[str, str]], passes: int = 10, resolution: float = 1.0) -> dict[str, int]:
    """Single-level local moving on one bounded component; nodes are visited in order, strict gains only."""
    near: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    m = sum(map(len, near.values())) / 2
    of = {n: k for k, n in enumerate(nodes)}
    total = {of[n]: len(near[n]) for n in nodes}
    for _ in range(passes):
        moved = False
        for n in nodes:
            k, r = len(near[n]), of[n]
            to: dict[int, int] = {}
            for x in sorted(near[n]):
                to[of[x]] = to.get(of[x], 0) + 1
            best, gain = r, 0.0
            for s, w in to.items():
                if s != r:
                    g = (w - to.get(r, 0)) / m - resolution * k * (total[s] - total[r] + k) / (2 * m * m)
                    if g > gain:
                        best, gain = s, g
            if best != r:
                total[r], total[best], of[n], moved = total[r] - k, total[best] + k, best, True
        if not moved:
            break
    return of


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable either way, by repeated minima over neighbours' labels.

    Labels of labels are followed in each round, so the rounds grow with the logarithm of the longest path.
    """
    both = directed(edges.withColumn("confidence", F.lit(1.0)), "both").where("src <> dst")
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        new = cut(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("beyond", "component")).alias("component")))
        if new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty():
            return new
        labels = new


def communities(edges: DataFrame, nodes: DataFrame, largest: int = 200_000) -> DataFrame:
    """(node, community): :func:`louvain` in each connected component, a component in one task.

    Moving is sequential by definition, so a component of more than ``largest`` nodes raises an error:
    cut it by edge type first.  A community's name is its smallest node.
    """
    of = cut(components(edges, nodes))
    if not of.groupBy("component").count().where(F.col("count") > largest).isEmpty():
        raise ValueError(f"a connected component has more than {largest} nodes")
    e = edges.select("from_id", "to_id").where("from_id <> to_id").distinct().join(of.select(F.col("node").alias("from_id"), "component"), "from_id")
    rows = of.select("component", F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(e.select("component", F.col("from_id").alias("a"), F.col("to_id").alias("b")))

    def run(f):
        import pandas as pd

        own = sorted(f.loc[f.b.isna(), "a"])
        found = louvain(own, list(f.loc[f.b.notna(), ["a", "b"]].itertuples(index=False, name=None)))
        first: dict[int, str] = {}
        for n in own:
            first.setdefault(found[n], n)
        return pd.DataFrame({"node": own, "community": [first[found[n]] for n in own]})

    from ..sources.source_tree import ship

    ship(edges.sparkSession)
    return rows.groupBy("component").applyInPandas(run, "node string, community string")


def neighbours(edges: DataFrame, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """(node) one edge away."""
    return directed(edges, direction, [kind] if kind else None).where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def path_weight(edges: DataFrame, start: str, end: str, hops: int = 5) -> DataFrame:
    """(path, distance, weight): the shortest path and the sum of one less confidence over its edges."""
    p = shortest_path(edges, start, end, hops).withColumn("n", F.split("path", ">"))
    pairs = p.select("path", "distance", F.explode(F.arrays_zip(F.slice("n", 1, F.size("n") - 1).alias("a"), F.slice("n", 2, F.size("n") - 1).alias("b"))).alias("e"))
    best = edges.groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence"))
    on = (F.col("e.a") == F.col("from_id")) & (F.col("e.b") == F.col("to_id"))
    return pairs.join(best, on).groupBy("path", "distance").agg(F.round(F.sum(1 - F.col("confidence")), 6).alias("weight"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, n, cohesion): ``2 * internal / n^2`` for members(community, node)."""
    a, b = members.select(F.col("community").alias("ca"), F.col("node").alias("from_id")), members.select(F.col("community").alias("cb"), F.col("node").alias("to_id"))
    inner = edges.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inside"))
    n = members.groupBy("community").agg(F.count("*").alias("n"))
    return n.join(inner, "community", "left").select("community", "n", F.round(2 * F.coalesce("inside", F.lit(0)) / (F.col("n") * F.col("n")), 6).alias("cohesion"))
