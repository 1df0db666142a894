"""Held-out accuracy, recall on planted cases, and how much of the table a search looks at."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fathomgrid.llm import embeddings, registry, topk

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.score, r.predicted) for r in registry.op3_toxicity(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [s for y, s, _ in got if y], [s for y, s, _ in got if not y]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc >= 0.8 and sum(p for y, _, p in got if not y) <= 0.05 * len(good) and all(0 <= s <= 1 for _, s, _ in got)


def test_language_held_out_counting_und(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in registry.op7_language(spark, SF).collect() if r.held_out and lang[r.doc_id][0]]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in got) >= 0.9 * len(got) > 0
    assert all(not any(c.isalpha() for c in lang[r.doc_id][1] or "") for r in got if r.lang_pred == "und")


def test_a_small_language_does_not_draw_what_nobody_has_seen(spark, tmp_path):
    rows = [(k, "the quick brown fox and the dog " * 3, "en") for k in range(40)] + [(100 + k, "der schnelle braune Fuchs und der Hund " * 3, "de") for k in range(40)] + [(200 + k, "12 34", "zz") for k in range(9)]
    rows += [(300 + k, "жизнь прожить не поле перейти", None) for k in range(9)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}), tmp_path / "documents.parquet")
    got = {r.doc_id: r.lang_pred for r in registry.op7_language(spark, str(tmp_path)).collect()}
    assert all(got[k] == "en" and got[100 + k] == "de" for k in range(40)) and {got[300 + k] for k in range(9)} <= {"en", "de"} and got[200] == "und"


def test_embedding_recall_at_the_threshold(spark, tmp_path):
    r = np.random.default_rng(9)
    n, m, d = 12_000, 2000, 64
    x = embeddings.units(r.standard_normal((n, d)))
    y = r.standard_normal((m, d))
    y = embeddings.units(y - (y * x[:m]).sum(axis=1, keepdims=True) * x[:m])
    c = r.uniform(0.951, 0.97, m)[:, None]
    x[n - m :] = c * x[:m] + np.sqrt(1 - c * c) * y
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    of = {a.vec_id: a.component_id for a in embeddings.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    found = sum(of[k] == of[n - m + k] for k in range(m))
    assert found >= 0.99 * m


def test_many_equal_vectors_are_one(spark):
    v = spark.range(20_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 19_990, F.array(*[F.lit(float(k)) for k in range(1, 9)])).otherwise(F.array(*[F.lit(1.0).cast("double") * (-1) ** k * (k + 1) for k in range(8)])).alias("embedding"))
    got = embeddings.near_vectors(v).groupBy("n_links", "component_id").count().collect()
    assert {(r.n_links, r.component_id, r["count"]) for r in got} == {(19_989, 0, 19_990), (9, 19_990, 10)}


def clustered(n=6000, d=32, k=12, seed=3):
    r = np.random.default_rng(seed)
    return np.floor(64 * (3 * r.standard_normal((k, d))[r.integers(0, k, n)] + 0.2 * r.standard_normal((n, d))))


def test_bounds_leave_out_most_of_a_clustered_table():
    x = clustered()
    block = topk.Block(np.arange(len(x)), x, topk.choose_pivots(x[:1000]))
    for i in range(0, len(x), 60):
        ids, s = block.search(i, x[i], 20)
        whole = x @ x[i]
        whole[i] = -np.inf
        best = np.lexsort((np.arange(len(x)), -whole))[:20]
        order = np.lexsort((ids, -s))
        assert ids[order].tolist() == best.tolist()
    assert block.scored < 0.25 * block.asked


def test_top_k_over_many_cells_equals_brute_force(spark, tmp_path, monkeypatch):
    for name, value in (("CELL", 500), ("BLOCK", 300)):
        monkeypatch.setattr(topk, name, value)
    x = clustered(3000, 16) / 64
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    y = np.floor(64 * x)
    for q in range(0, len(x), 20):
        whole = y @ y[q]
        whole[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -whole))[:20]
        assert [got[q, k + 1] for k in range(20)] == [(int(j), int(whole[j])) for j in best]
