"""The pipeline's near-copy stage against exact Jaccard similarities planted around 0.8."""

import random

import numpy as np

from fathomgrid.llm import simhash


def planted(seed, changed):
    """Two texts of 90 5-word shingles each, all but ``changed`` of them shared."""
    r = random.Random(seed)
    words = [f"w{r.getrandbits(40):x}" for _ in range(94 + changed)]
    return " ".join(words[:94]), " ".join([*words[: 94 - changed], *words[94:]])


def test_pairs_around_the_threshold(spark):
    rows = []
    for k in range(100):
        for at, changed in ((0, 10), (1, 11)):  # similarities 80 / 100 and 79 / 101
            a, b = planted(2 * k + at, changed)
            rows += [(4 * k + 2 * at, a), (4 * k + 2 * at + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert not [k for k in range(100) if not {4 * k + 2, 4 * k + 3} <= kept]
    assert len([k for k in range(100) if {4 * k, 4 * k + 1} <= kept]) <= 1


def test_group_is_what_exact_similarities_link(spark):
    base, r = planted(1, 10)[0].split(), random.Random(3)
    texts = [" ".join(base)] + [" ".join([*base[: 94 - n], *(f"x{r.getrandbits(40):x}" for _ in range(n))]) for n in (2, 5, 8, 9, 10, 11, 12, 14, 18)] * 2
    texts += [("a line said again and again " * 300) + tail for tail in ("one two three four five six seven", "lamp river cloud stone engine paper")]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    of = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                of = [min(of[i], of[j]) if c in (of[i], of[j]) else c for c in of]
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(of))


def linked(texts):
    """The smallest number of the texts that exact similarities link to each."""
    sets, of = [set(simhash.shingle_set(t, 5).tolist()) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if c == high else c for c in of]
    return of


def test_unrelated_texts_do_not_meet(spark):
    """What a text is compared with does not grow with the table: of 3000 unrelated ones none shares a key."""
    r = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.getrandbits(40):x}" for _ in range(40))) for k in range(3000)], "doc_id long, text string")
    group = simhash._set_rows(docs, 5, 24, 5).selectExpr("node", "node as grp", "sketch")
    placed = group.mapInArrow(simhash._set_places(range(24), 24), "key long, node long, grp long, marks binary")
    assert placed.count() == placed.select("key").distinct().count() == 24 * 3000


def test_short_pairs_at_the_threshold(spark):
    r, rows = random.Random(5), []
    for k in range(300):  # 4 and 5 shingles, 4 of them shared
        words = [f"w{r.getrandbits(40):x}" for _ in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([k for k in range(300) if {2 * k, 2 * k + 1} <= kept]) <= 1


def test_crowded_keys(spark):
    """Families of near copies and of texts that only seem to be, many more than are compared at first."""
    r, texts = random.Random(6), []
    for changed in (4, 8, 11, 14):
        base = [f"w{r.getrandbits(40):x}" for _ in range(94)]
        for _ in range(60):
            n = r.randrange(changed // 2, changed + 1)
            texts.append(" ".join([*base[: 94 - n], *(f"x{r.getrandbits(40):x}" for _ in range(n))]))
    r.shuffle(texts)
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = linked(texts)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and 4 < len(set(want)) < 200


def test_ranges_and_ends():
    first, end = np.array([1, 2, 5, 4, 5]), np.array([4, 4, 5, 5, 5])
    pairs = [(int(a), int(b)) for i, j in simhash._ranges(first, end) for a, b in zip(i, j)]
    assert pairs == [(k, x) for k, (a, b) in enumerate(zip(first, end)) for x in range(a, b)]
    assert simhash._ends(np.array([1, 1, 2, 2, 2]), np.array([0, 0, 0, 1, 1])).tolist() == [2, 2, 3, 5, 5]
