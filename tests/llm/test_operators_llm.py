"""Every opN query against brute force or its SQL, on the awkward tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from fathomgrid.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = list(registry.queries())
UNRESTRICTED = ("op4_near_embeddings", "op5_exact_top_k")


def run(spark, name, folder):
    return [r.asDict() for r in registry.queries()[name](spark, folder).collect()]


def key(r):
    return tuple(str(x) for x in r.values())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert run(spark, name, empty) == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in UNRESTRICTED])
def test_extra_columns_change_nothing_and_each_row_counts(spark, awkward, clashing, rows, name):
    one, two = run(spark, name, awkward), run(spark, name, clashing)
    if name != "op8_pack":  # partitions, and so places, may differ
        assert sorted(map(key, one)) == sorted(map(key, two))
    if name == "op8_pack":
        one = [r for r in one if r["start"] == 0]
    assert Counter(r["doc_id"] for r in one) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", UNRESTRICTED)
def test_extra_columns_of_vectors_change_nothing(spark, awkward, clashing, name):
    one, two = run(spark, name, awkward), run(spark, name, clashing)
    assert sorted(map(key, one)) == sorted(map(key, two)) and one


def sets(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def test_op1_equals_brute_force(spark, awkward, rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    lows = {}
    for f, r in zip(fps, rows):
        if r[0] is not None:
            lows[f] = min(lows.get(f, r[0]), r[0])
    near = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2]
    of = sets(set(fps), near)
    least = {}
    for f, low in lows.items():
        least[of[f]] = min(least.get(of[f], low), low)
    want = [(str(r[0]), f"{f:016x}", str(least.get(of[f]))) for f, r in zip(fps, rows)]
    assert sorted(want) == sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in run(spark, "op1_simhash", awkward))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
@pytest.mark.parametrize("where", ["awkward", "small"])
def test_query_equals_its_sql(spark, request, sf, name, where):
    folder = sf if where == "small" else request.getfixturevalue("awkward")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    if where == "awkward" and "inner_product" in registry.oracle_sql()[name]:
        c.sql(f"create or replace view embeddings as from '{folder}/embeddings.parquet' where vec_id is not null and len(embedding) = 16")
    got, want = registry.queries()[name](spark, folder).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    plain = lambda d: sorted(tuple(-1e9 if pd.isna(x) else round(float(x), 6) for x in r) for r in d[cols].itertuples(index=False))
    assert plain(got) == plain(want)


def test_op2_takes_what_the_targets_say(spark, awkward):
    by = {}
    for r in run(spark, "op2_mix_sources", awkward):
        assert r["taken"] <= 3 * r["size"]
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["taken"]
        t[1] += r["size"]
    assert all(abs(taken - target) <= 5 for (_, target), (taken, _) in by.items())
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6 or any(t == 3 * s for s, t in by)


def test_op4_equals_brute_force(spark, awkward, vectors):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, n = set(), Counter()
    for i, x in good:
        for j, y in good:
            if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.add((i, j))
    for i, j in links:
        n[i] += 1
        n[j] += 1
    of = sets({i for i, _ in vectors if i is not None}, links)
    want = sorted((str(i), n[i], str(of.get(i)), of.get(i) == i and i is not None) for i, _ in vectors)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in run(spark, "op4_near_embeddings", awkward))
    assert got == want and links


def brute_lines(rows):
    seen, gone = [], {}
    for d, text in sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), key=lambda x: x[0]):
        for k, line in enumerate(text.split("\n")):
            s = set(WORD.findall(line.lower()))
            if s:
                if any(len(s & t) / len(s | t) >= 0.8 for _, t in seen):
                    gone.setdefault(d, set()).add(k)
                seen.append(((d, k), s))
    return gone


def test_op6_equals_brute_force(spark, tmp_path, rows, make_tables):
    once = list({r[0]: r for r in reversed(rows)}.values())
    folder = make_tables(tmp_path, once)
    want = {d: ",".join(map(str, sorted(x))) for d, x in brute_lines(once).items()}
    got = {r["doc_id"]: r for r in run(spark, "op6_line_dedup", folder)}
    assert {d: r["removed"] for d, r in got.items() if r["removed"]} == want and want
    for d, text, *_ in once:
        gone = {int(x) for x in got[d]["removed"].split(",") if x}
        left = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)
        assert got[d]["text_crc32"] == zlib.crc32(left.encode())


@pytest.mark.parametrize("name,end,tok", [("op8_pack", 0, "byte_bpe_50k.json"), ("op9_token_files", 2, "word_bpe_49k.json")])
def test_ids_equal_the_tokenizers(spark, awkward, rows, name, end, tok):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path(tok))
    ids = [np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4") for r in rows]
    got = run(spark, name, awkward)
    if name == "op9_token_files":
        want = Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order)
        return
    whole = {}
    for r, x in zip(rows, ids):
        whole.setdefault(r[0], []).append(x)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in whole[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fill = [sum(n for _, n in s) for _, s in sorted(seqs.items())]
    assert all(x == 1024 for x in fill[:-1]) and fill[-1] <= 1024
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n


def test_op10_shards_are_even_and_hold_equal_texts_together(spark, awkward, rows):
    got = run(spark, "op10_reshard", awkward)
    of, slots, total = {}, {}, Counter()
    for r in got:
        assert of.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_stages_keep_their_columns(spark, clashing):
    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, clashing)
        assert out.columns == docs.columns
        assert {r["size"] for r in out.select("size").collect()} <= {"clash"}


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
