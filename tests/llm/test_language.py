"""The span search against brute force, and accuracy on documents that nothing was learned from."""

import itertools

import numpy as np

from fathomgrid.llm import langid, registry


def cost(s, path, penalty):
    return sum(s[k, x] for k, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_spans_are_optimal():
    r = np.random.default_rng(3)
    for _ in range(60):
        s = r.normal(0, 3, (r.integers(1, 8), 3))
        best = max(cost(s, p, 4.0) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(cost(s, langid.viterbi(s, 4.0), 4.0) - best) < 1e-9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in registry.op7_language(spark, folder).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.9 * len(got) > 0
