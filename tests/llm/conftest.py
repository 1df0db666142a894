"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

KINDS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
#: Names that the operators use inside.
CLASHING = ("size", "h", "fp", "key", "node", "component", "component_id", "drop", "gone", "removed", "line", "at", "id", "part", "whole", "take", "n", "score", "toxic", "shard", "slot", "start", "ids", "_in_0", "y", "value", "col")
WORDS = "stone river cloud lamp winter garden copper violin paper harbor silver maple engine window thread candle market forest signal bridge".split()


def prose(seed, n=60, lines=4):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.7) for _ in range(n // lines)) for _ in range(lines))


def awkward_rows():
    base = [prose(k) for k in range(30)]
    texts = [*base, base[0], base[0], base[1] + " end", base[2].replace("stone", "STONE"), None, "", " \n\t ", "one", "One  two", "...", "\n".join([base[3]] * 3)]
    texts += [" ".join(prose(100 + k, 4000, 1) for k in range(10)), "x" * 200_000, base[4] + "\n" + base[5].split("\n")[0], "あ中 Ж naïve \U0001f600 <|endoftext|>  z", "a\x00b \x0b c"]
    rows = [(k, t, "en" if k % 2 else "de", f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base[6], None, None, None), (None, None, None, None, None), (-5, base[8], "fr", None, 3), (7, "another text under the same id as row seven", "en", "src1", 1)]
    return rows


def save(folder, name, columns, kinds):
    pq.write_table(pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()}), folder / f"{name}.parquet")


def tables(folder, rows, clash=False):
    columns = dict(zip(KINDS, ([r[k] for r in rows] for k in range(5))))
    kinds = dict(KINDS)
    if clash:
        columns |= {c: ["clash"] * len(rows) for c in CLASHING}
        kinds |= {c: pa.string() for c in CLASHING}
    save(folder, "documents", columns, kinds)
    known = [r[0] for r in rows if r[0] is not None][:40]
    save(folder, "labels", {"doc_id": [*known, None], "quality": [1] * len(known) + [None], "toxic": [k % 2 for k in range(len(known))] + [None]}, {"doc_id": pa.int64(), "quality": pa.int64(), "toxic": pa.int64()})
    r = random.Random(5)
    v = [[r.gauss(0, 1) for _ in range(16)] for _ in range(120)] if rows else []
    v += [[x + r.gauss(0, 0.02) for x in v[k % 7]] for k in range(60)] if rows else []
    v += [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], v[3], v[3], [1.0, 2.0]] if rows else []
    ids = [*range(len(v))]
    if rows:
        ids[-2] = 3  # a repeated row
        v, ids = [*v, v[0], None], [*ids, None, None]
    columns, kinds = {"vec_id": ids, "embedding": v, "label": [1] * len(v)}, {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}
    if clash:
        more = (*CLASHING, "v", "cell", "dim", "cid", "n_links", "asks", "least", "block", "rank", "query_id")
        columns |= {c: ["clash"] * len(v) for c in more}
        kinds |= {c: pa.string() for c in more}
    save(folder, "embeddings", columns, kinds)
    return str(folder)


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("awkward"), awkward_rows())


@pytest.fixture(scope="session")
def clashing(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("clashing"), awkward_rows(), clash=True)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def vectors(awkward):
    t = pq.read_table(f"{awkward}/embeddings.parquet")
    return list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))


@pytest.fixture(scope="session")
def make_tables():
    return tables
