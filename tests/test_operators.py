"""Operators on literal rows."""

import random
import re

from pyspark.sql import functions as F

from fathomgrid.functions import text as tx
from fathomgrid.operators import graph, retrieval, session
from fathomgrid.plans import catalog
from fathomgrid.sources import source_tree

EDGES = "from_id string, to_id string, type string, confidence double"


def test_impact_radius_respects_confidence(spark):
    e = spark.createDataFrame([("caller2", "caller1", "CALLS", 0.95), ("caller1", "target", "CALLS", 0.95), ("low", "target", "CALLS", 0.4), ("target", "callee", "CALLS", 0.95)], EDGES)
    assert {(r.node, r.distance) for r in graph.bfs(e, ["target"], 3, "in", floor=0.8).collect()} == {("caller1", 1), ("caller2", 2)}
    assert {r.node for r in graph.bfs(e, ["target"], 2, "out").collect()} == {"callee"}
    assert graph.shortest_path(e, "caller2", "callee").first().path == "caller2>caller1>target>callee"


def test_two_cliques_are_two_communities():
    cliques = [(f"{p}{i}", f"{p}{j}") for p in "ab" for i in range(5) for j in range(i)]
    of = graph.louvain(sorted({x for e in cliques for x in e}), cliques)
    assert len(set(of.values())) == 2 and len({of[f"a{i}"] for i in range(5)}) == 1


def test_ten_clique_cohesion(spark):
    e = spark.createDataFrame([(str(i), str(j)) for i in range(10) for j in range(i)], "from_id string, to_id string")
    m = spark.createDataFrame([(1, str(i)) for i in range(10)], "community int, node string")
    assert graph.cohesion(e, m).first().cohesion == 0.9


def test_fnv_and_ids(spark):
    r = spark.createDataFrame([("foobar",)], "s string").select(tx.fnv1a(F.col("s")).alias("h"), tx.generate_id(F.col("s")).alias("id")).first()
    assert r.h == "bf9cf968" and len(r.id) == 16


def test_rrf_does_not_depend_on_input_order(spark):
    a, b = (spark.createDataFrame(x, "id int, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    one, two = retrieval.rrf({"keyword": a, "vector": b}).collect(), retrieval.rrf({"vector": b, "keyword": a}).collect()
    assert one == two and one[0].id == 2


def test_greedy_pack_skips_and_goes_on(spark):
    c = spark.createDataFrame([(1, 1, 50), (1, 2, 30), (1, 3, 10)], "k int, o int, tokens long")
    assert session.pack_greedy(c, 60, ["k"], "o", "o").first()[1:] == (2, 60)


def test_nested_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(session, "SPANS", 50)
    r = random.Random(7)
    spans = [(r.choice([None, *range(60)]), r.choice([None, 1, 2, 3, 4]), r.choice([None, float("nan"), -0.0, 0.0, 1.0, 2.0, 3.0])) for _ in range(500)]
    whole = [(f, i, float("inf") if h != h else h) for f, i, h in spans if None not in (f, i, h)]  # NaN is above all numbers
    want = {}
    for f, i, h in whole:
        want[f, i] = min([want.get((f, i), (float("inf"), 9)), *((b[2], b[1]) for b in whole if b[0] == f and b[1] != i and b[2] >= h)])
    want = sorted((f, i, owner) for (f, i), (_, owner) in want.items() if owner < 9)
    got = session.nested(spark.createDataFrame(spans, "file long, item int, hi double"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_containment_join_sorts_bounded_shares_once_and_forms_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SPANS", 10_000, raising=False)
    spark.range(30_000).selectExpr("1L as l_orderkey", "cast(id as int) as l_linenumber", "cast(id as double) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.containment_join(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange ") == 1
    assert re.search(r"hashpartitioning\(file#\d+L, 4\)", plan)
    assert got.where("owner = item + 1").count() == got.count() == 29_999  # the longest has no owner


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("import { b } from './b.js';\nexport class A {}\nexport function run() {}\n")
    (tmp_path / "src/b.ts").write_text("export const b = 1;\n")
    (tmp_path / "src/m.py").write_text("import os\n\ndef f():\n    return os.getcwd()\n")
    (tmp_path / "bin.dat").write_bytes(b"a\0b")

    files = source_tree.discover(spark, str(tmp_path)).cache()
    assert {r.path for r in files.collect()} == {"src/a.ts", "src/b.ts", "src/m.py"}
    facts = source_tree.facts(files).cache()
    assert {(r.kind, r.name) for r in facts.where("what = 'symbol'").collect()} >= {("class", "A"), ("function", "run"), ("function", "f"), ("constant", "b")}
    hit = source_tree.resolve_imports(facts.where("what = 'import'").select("path", "name"), files)
    assert [tuple(r) for r in hit.collect()] == [("src/a.ts", "./b.js", "src/b.ts")]
