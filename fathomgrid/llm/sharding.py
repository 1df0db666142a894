"""Sharding by minimum-cost-flow resharding.

Documents lie in *blocks*: hash ranges of their group key inside the shard that holds them now.
From the shard sizes as they are and the capacities asked for, a minimum-cost flow (moving a byte
costs one, leaving it costs nothing) says how many bytes go from which shard to which; whole blocks
carry the flow.  Only shards that give or take a block have to be rewritten.

The driver sees block totals only (``shards * blocks`` rows, a constant), never documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, aside

#: Blocks of a shard: the grain of a transfer, 1/512 of a shard.
BLOCKS = 512
#: Rows of a part of a block that slots are counted in: a block of very many equal texts is many tasks.
ROWS = 100_000
#: Slots of a written file.
FILE = 1 << 14


def min_cost_flow(supply: list[int], demand: list[int], cost) -> list[list[int]]:
    """Cheapest way from ``supply`` to ``demand`` (of equal sum): successive shortest paths."""
    n, m = len(supply), len(demand)
    source, sink, size = n + m, n + m + 1, n + m + 2
    graph: list[list[list]] = [[] for _ in range(size)]  # [to, capacity, cost, index of the reverse edge]

    def edge(a, b, cap, price):
        graph[a].append([b, cap, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    for j, x in enumerate(demand):
        edge(n + j, sink, x, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, sum(supply), cost(i, j))
    height = [0] * size
    while True:
        far, back, heap = [float("inf")] * size, [None] * size, [(0, source)]
        far[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, cap, price, _) in enumerate(graph[a]):
                if cap > 0 and d + price + height[a] - height[b] < far[b]:
                    far[b], back[b] = d + price + height[a] - height[b], (a, k)
                    heapq.heappush(heap, (far[b], b))
        if back[sink] is None:
            break
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far)]
        push, b = float("inf"), sink
        while b != source:
            a, k = back[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = back[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, _, _, r in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] = graph[b][r][1]
    return flow


def plan_transfers(blocks: dict[tuple[int, int], int], old: int, capacity: list[int]) -> dict[tuple[int, int], int]:
    """Shard of every block ``(old shard, block)``, given the bytes of each.

    The flow says how much each old shard sends where; blocks, largest first, fill these amounts.  A
    block goes where most is still wanted, so that no shard ends further from its capacity than
    about the largest block that it has.
    """
    total, want = sum(blocks.values()), sum(capacity)
    demand = [c * total // want if want else 0 for c in capacity]
    for j in range(total - sum(demand)):
        demand[j % len(demand)] += 1
    supply = [sum(v for (s, _), v in blocks.items() if s == i) for i in range(old)]
    flow = min_cost_flow(supply, demand, lambda i, j: int(i != j))
    out = {}
    for i in range(old):
        left = flow[i][:]
        for (s, b), v in sorted(((k, v) for k, v in blocks.items() if k[0] == i), key=lambda x: (-x[1], x[0])):
            j = max(range(len(left)), key=lambda j: (left[j], j == i, -j))
            left[j] -= v
            out[s, b] = j
    return out


def reshard(docs: DataFrame, capacity: list[int], old_shards: int | None = None, shard: str | None = None, name: str = "shards") -> DataFrame:
    """``docs`` with ``size text_crc32 old_shard block shard slot`` for shards of these capacities.

    ``size``: UTF-8 bytes of the text and one for its end; null texts count as empty.  ``shard``: the
    column that says where a document lies; without it, where the hash of its text puts it.  Equal texts
    of one old shard stay together whatever their number (a group larger than a shard's capacity makes
    that shard too large: there is no other whole answer).  Repeated rows get slots of their own; slots
    of a shard are gapless from 0.  Columns of these names give way; an empty table gives no rows.
    """
    return _resharded(docs, capacity, old_shards, shard, name)[1]


def _resharded(docs: DataFrame, capacity: list[int], old_shards: int | None, shard: str | None, name: str) -> tuple[Workspace, DataFrame]:
    """The rows of :func:`reshard`, and the workspace that they are read from."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, name)
    old = old_shards or len(capacity)
    d, of = aside(docs)
    text = F.coalesce(F.col(of["text"]), F.lit(""))
    h = F.xxhash64(text)
    lies = F.col(of[shard]).cast("int") if shard else F.pmod(h, F.lit(old)).cast("int")
    base = d.select("*", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), lies.alias("old_shard"), F.pmod(F.shiftright(h, 8), F.lit(BLOCKS)).cast("int").alias("block"), F.monotonically_increasing_id().alias("row"))
    base = ws.save(base, "rows")
    got = base.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most old * BLOCKS rows
    where = plan_transfers({(r.old_shard, r.block): r.bytes for r in got}, old, capacity)
    # slots: counted in parts of about ROWS rows, then in each part
    plan = [(r.old_shard, r.block, where[r.old_shard, r.block], -(-r.n // ROWS)) for r in got]
    plan = F.broadcast(spark.createDataFrame(plan, "old_shard int, block int, shard int, parts int"))
    base = base.join(plan, ["old_shard", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    key, first, at = ["old_shard", "block", "part"], [], dict.fromkeys(range(len(capacity)), 0)
    counts = base.groupBy("shard", *key).agg(F.count("*").alias("n")).collect()  # a row for each block and each ROWS rows
    for r in sorted(counts, key=lambda r: (r.shard, r.old_shard, r.block, r.part)):
        first.append((r.old_shard, r.block, r.part, at[r.shard]))
        at[r.shard] += r.n
    places = F.broadcast(spark.createDataFrame(first, "old_shard int, block int, part int, first long"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy(of["doc_id"], "row"))
    new = ["size", "text_crc32", "old_shard", "block", "shard", "slot"]
    kept = [c for c in docs.columns if c not in new]
    out = base.withColumn("k", order - 1).join(places, key).withColumn("slot", F.col("first") + F.col("k"))
    return ws, out.select(*[of[c] for c in kept], *new).toDF(*kept, *new)


def affected(placed: DataFrame) -> DataFrame:
    """(shard) of the shards whose files change: those that give or take a document; none for no rows."""
    moved = placed.where("old_shard <> shard")
    return moved.select("old_shard").unionByName(moved.select(F.col("shard").alias("old_shard"))).distinct().withColumnRenamed("old_shard", "shard")


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Writes the affected shards of :func:`reshard`'s rows, one folder each; returns their numbers.

    Folders of other shards keep their files.  A file holds ``FILE`` slots in order; repeated rows are
    written each in its own slot; no rows, no files.
    """
    shards = sorted(r.shard for r in affected(placed).collect())  # one row for each shard
    rows = placed.where(F.col("shard").isin(shards)).drop("old_shard", "block")
    rows = rows.repartition("shard", F.floor(F.col("slot") / FILE)).sortWithinPartitions("shard", "slot")
    if shards:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return shards


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's digest: law ``bytes``, shards of equal capacity, ``grown_shard`` null.

    Rows of rewritten shards are read back from their files, the others (if any) lie where they were.
    """
    ws = Workspace(docs.sparkSession, "shard-files")
    rows, placed = _resharded(docs.select("doc_id", "text"), [1] * shards, None, None, "shards")
    placed = ws.save(placed, "placed")
    rows.drop()
    written = rewrite(placed, ws.path("files"))
    out = placed.where(~F.col("shard").isin(written)).select("doc_id", "size", "text_crc32", "text", "slot", "shard")
    if written:
        schema = placed.select("doc_id", "text", "size", "text_crc32", "slot", "shard").schema
        out = out.unionByName(docs.sparkSession.read.schema(schema).parquet(ws.path("files")))
    whole = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
