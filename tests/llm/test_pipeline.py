"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from fathomgrid.llm import registry, simhash, toxicity
from test_operators_llm import brute_lines, sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_stage(spark, tmp_path, rows, make_tables):
    once = list({r[0]: r for r in reversed([*rows, (90, "you moron scum trash " * 9, "en", "src1", 9)])}.values())
    folder = make_tables(tmp_path, [r for r in once if r[0] is not None])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect(), spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}").collect()
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")

    before, after = seen["toxicity"]
    fitted = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(fitted[0], fitted[1])
    stay = {r.doc_id for r in before if 1 / (1 + np.exp(-(fitted[2][0] + np.dot(scorer.text(r.text), fitted[2][1:])))) < 0.5}
    assert {r.doc_id for r in after} == stay

    before, after = seen["line_dedup"]
    gone = brute_lines([(r.doc_id, r.text) for r in before])
    want = {}
    for r in before:
        left = [x for k, x in enumerate((r.text or "").split("\n")) if k not in gone.get(r.doc_id, ())]
        if r.doc_id not in gone:
            want[r.doc_id] = r.text
        elif any(WORD.search(x) for x in left):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in after} == want and gone

    before, after = seen["simhash_dedup"]
    shingles = {r.doc_id: set(simhash.shingle_set(r.text, 5).tolist()) for r in before}
    plain = {}
    for r in before:
        w = WORD.findall((r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        plain[r.doc_id] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        assert len(plain[r.doc_id]) == len(shingles[r.doc_id])
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    of = sets(set(plain), [(a, b) for a in plain for b in plain if a < b and near(plain[a], plain[b])])
    assert {r.doc_id for r in after} == {d for d in plain if of[d] == d}

    before, after = seen["mix"]
    words = lambda t: len(WORD.findall(t or ""))
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target = dict(zip(order, [5, 2, 1] * len(order))), {}
    open_, total = set(order), float(sum(size.values()))
    while True:  # water rises until nobody is above
        level = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
        if not over or not open_:
            target |= {s: level[s] for s in open_}
            break
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)

    before, after = seen["pack"]
    assert Counter(r.doc_id for r in after if r.start == 0) == Counter(r.doc_id for r in before)
    fill = Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert all(n == 1024 for k, n in fill.items() if k < max(fill)) and sorted(fill) == list(range(len(fill)))


def test_pipeline_is_its_stages(spark, awkward):
    got = corpus_pipeline.run(spark, awkward)
    assert got.count() > 0 and got.columns == registry.op8_pack(spark, awkward).columns
