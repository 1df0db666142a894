"""Segment files, packing, sharding: damage, single blocks, flows, rewriting."""

import itertools
import random

import numpy as np
import pytest

from fathomgrid.llm import binary, packing, rans, registry, sharding


def segment(n=5000, block=512):
    r = np.random.default_rng(2)
    ids = np.minimum(r.geometric(0.01, n), 900).astype(np.uint32)
    return ids, rans.write_segment([7, None, -3], np.array([n - 10, 4, 6]), ids, block)


def test_each_block_decodes_alone():
    ids, data = segment()
    index = rans.read_index(data)
    assert len(index["blocks"]) == 10
    for k in (0, 4, 9):
        assert (rans.read_blocks(data, index, [k]) == ids[512 * k : 512 * (k + 1)]).all()
    assert (rans.read_blocks(data, index) == ids).all()
    assert index["known"].tolist() == [1, 0, 1] and index["doc_ids"].tolist() == [7, 0, -3]


@pytest.mark.parametrize("where", ["magic", "table", "payload", "short"])
def test_damage_is_found(where):
    _, data = segment()
    index = rans.read_index(data)
    at = {"magic": 0, "table": 40, "payload": index["payload"] + 700}.get(where)
    bad = data[:-3] if where == "short" else data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    with pytest.raises(rans.Damaged):
        rans.read_blocks(bad, rans.read_index(bad))


@pytest.mark.parametrize("ids", [[], [0], [5] * 1000, list(range(300))])
def test_round_trip_of_odd_segments(ids):
    data = rans.write_segment([1], np.array([len(ids)]), np.array(ids, np.uint32))
    assert rans.read_blocks(data, rans.read_index(data)).tolist() == ids


def test_exported_files_hold_the_segments(spark, awkward, tmp_path):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    binary.write_tokens(docs, registry.tokenizer_path("word_bpe_49k.json"), str(tmp_path / "t"))
    names = binary.export_files(spark, str(tmp_path / "t"), str(tmp_path / "out"))
    n = sum(r.n_tokens for r in binary.read_tokens(spark, str(tmp_path / "t")).collect())
    assert names == sorted(names) and sum(len(rans.read_blocks(d, rans.read_index(d))) for d in (open(x, "rb").read() for x in names)) == n > 0


def test_sequences_are_padded(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    pieces = packing.pack(docs, registry.tokenizer_path("byte_bpe_50k.json"), 256)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(pieces, 256, pad_id=9).collect()}
    assert sorted(seqs) == list(range(len(seqs))) and all(len(x) == 256 for x in seqs.values())
    total = sum(r.length for r in pieces.collect())
    assert (total - 1) // 256 + 1 == len(seqs) and seqs[len(seqs) - 1][total % 256 or 256 :] == [9] * (-total % 256)


def cheapest(supply, demand):
    """Bytes that have to move, by trying every order of greedy filling."""
    n = len(supply)
    best = None
    for order in itertools.permutations([(i, j) for i in range(n) for j in range(n)]):
        s, d, moved = supply[:], demand[:], 0
        for i, j in order:
            x = min(s[i], d[j])
            s[i], d[j], moved = s[i] - x, d[j] - x, moved + x * (i != j)
        best = moved if best is None else min(best, moved)
    return best


def test_flow_moves_the_fewest_bytes():
    r = random.Random(4)
    for _ in range(30):
        supply = [r.randrange(12) for _ in range(2)]
        cut = r.randrange(sum(supply) + 1)
        demand = [cut, sum(supply) - cut]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        assert [sum(x) for x in flow] == supply and [sum(x) for x in zip(*flow)] == demand
        assert sum(x for i, row in enumerate(flow) for j, x in enumerate(row) if i != j) == cheapest(supply, demand)
    for _ in range(20):  # any number of shards: what stays is the smaller of both sides
        n = r.randrange(2, 7)
        supply = [r.randrange(100) for _ in range(n)]
        edges = sorted(r.randrange(sum(supply) + 1) for _ in range(n - 1))
        demand = [b - a for a, b in zip([0, *edges], [*edges, sum(supply)])]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        assert sum(flow[i][i] for i in range(n)) == sum(map(min, supply, demand))


def test_shards_are_even(spark, sf):
    total = {}
    for r in registry.op10_reshard(spark, sf.replace("0.001", "0.01")).collect():
        total[r.shard] = total.get(r.shard, 0) + r.size
    mean = sum(total.values()) / 8
    assert sorted(total) == list(range(8)) and all(abs(x - mean) < 0.01 * mean for x in total.values())


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(k, f"text {k % 40}", k % 4) for k in range(400)] + [(7, "text 7", 3)] * 3 + [(None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lies int")
    first = sharding.reshard(docs, [1, 1, 1, 1], shard="lies", name="a")
    # shards 2 and 3 stay as they are: the bytes of 0 and 1 are dealt anew between them
    sizes = {r.old_shard: r.b for r in first.groupBy("old_shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    first.drop("old_shard", "block").write.partitionBy("shard").parquet(path)
    placed = sharding.reshard(docs, [sizes[0] + sizes[1], 0, sizes[2], sizes[3]], shard="lies", name="b").persist()
    before = {p.name for k in (2, 3) for p in (tmp_path / "files" / f"shard={k}").iterdir()}
    assert sharding.rewrite(placed, path) == [0, 1]
    assert before <= {p.name for k in (2, 3) for p in (tmp_path / "files" / f"shard={k}").iterdir()}
    got = spark.read.parquet(path).where("shard = 0").collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and len(got) == 201
    slots = [r.slot for r in placed.where("doc_id = 7").collect()]
    assert len(slots) == 4
