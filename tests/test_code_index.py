"""Resolution, traces, context, memory, incremental and store operators on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx
from fathomgrid.operators import code, context, graph, incremental, memory, retrieval, search
from fathomgrid.sources import source_tree, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("path, language, role", [("src/a.ts", "typescript", "source"), ("src/a.test.ts", "typescript", "test"), ("tests/x.py", "python", "test"), ("package.json", "unknown", "config"), ("README.md", "unknown", "doc"), ("a/b.gen.ts", "typescript", "generated"), ("logo.PNG", "unknown", "asset"), ("poetry.lock", "unknown", "lock"), ("x.bin", "unknown", "asset"), ("FooTest.cs", "csharp", "test")])
def test_language_and_role(spark, path, language, role):
    r = spark.createDataFrame([(path,)], "p string").select(tx.language_of(F.col("p")).alias("l"), tx.role_of(F.col("p")).alias("r")).first()
    assert (r.l, r.r) == (language, role)


@pytest.mark.parametrize("text, want", [("why does it fail", "debug"), ("rename the class", "refactor"), ("Add some nice tests", "add_test"), ("the POST handler", "route"), ("show me", "explain"), ("jwt", "security"), ("nothing here", "general"), ("fix the route", "debug")])
def test_intents(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.intent(F.col("t")).alias("i")).first().i == want


def test_ignore_rules(spark):
    paths = ["node_modules/a.js", "src/dist/x.ts", "src/a.ts", "keep/a.log", "keep/b.log", "docs/x/y.md", "sub/docs/x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").where(~tx.ignored(F.col("p"), ("*.log", "!keep/b.log", "/docs/", "# nothing")))
    assert {r.p for r in df.collect()} == {"src/a.ts", "keep/b.log", "sub/docs/x.md"}


def test_fnv_counts_utf16_units(spark):
    def fnv(units):
        h = 2166136261
        for u in units:
            h = (h ^ u) * 16777619 % (1 << 32)
        return f"{h:08x}"

    text = "a\U0001f600é"
    units = [int.from_bytes(text.encode("utf-16-be")[k : k + 2], "big") for k in range(0, 8, 2)]
    got = spark.createDataFrame([(text,), ("",)], "s string").select(tx.fnv1a(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [fnv(units), fnv([])]


def test_import_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/app/a.ts", "src/lib/b.ts", "src/lib/index.ts", "src/lib/c.js", "packages/core/src/index.ts", "packages/core/src/x.ts", "src/gen/m.js")], "path string")
    rules = spark.createDataFrame(store.alias_rules([("tsconfig.json", json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}}})), ("packages/core/package.json", json.dumps({"name": "@org/core", "exports": {".": "./src/index.ts", "./*": "./src/*.ts"}, "imports": {"#gen": "../../src/gen/m.js"}})), ("bad/package.json", "{")]), "pattern string, target string, priority int")
    asks = [("../lib/b.js", "src/lib/b.ts"), ("../lib", "src/lib/index.ts"), ("../../src/lib/c", "src/lib/c.js"), ("@lib/b", "src/lib/b.ts"), ("@org/core", "packages/core/src/index.ts"), ("@org/core/x", "packages/core/src/x.ts"), ("react", None), ("../../../out", None), ("lib/b", "src/lib/b.ts")]
    imports = spark.createDataFrame([("src/app/a.ts", s) for s, _ in asks], "importer string, specifier string")
    got = {r.specifier: r.target for r in code.resolve_imports(imports, files, rules, "src").collect()}
    assert got == {s: t for s, t in asks if t}


def test_reexports_stop_at_rings(spark):
    e = [("a", "X", None, None), ("b", "*", "a", None), ("c", "Y", "b", "X"), ("r", "*", "s", None), ("s", "*", "r", None)]
    got = rows(code.reexport_closure(spark.createDataFrame(e, "file string, name string, source string, source_name string")))
    assert got == [("a", "X", "a", "X"), ("b", "X", "a", "X"), ("c", "Y", "a", "X")]


def test_call_rules(spark):
    symbols = spark.createDataFrame([("s1", "f1", "run", "function", None), ("s2", "f1", "go", "method", "Car"), ("s3", "f2", "go", "method", "Car"), ("s4", "f2", "Car", "class", None), ("s5", "f1", "Car", "class", None), ("s6", "f3", "go", "method", "Bus")], "id string, file_id string, name string, kind string, owner string")
    imported = spark.createDataFrame([("f1", "Car", "s4", "class"), ("f1", "run", "s9", "function"), ("f1", "far", "s8", "function")], "file_id string, name string, symbol_id string, kind string")
    bindings = spark.createDataFrame([("f1", "x", 1, "Car"), ("f1", "x", 9, "Bus")], "file_id string, name string, line int, class_name string")
    calls = spark.createDataFrame([(1, "f1", "s1", "Car", None, True), (2, "f1", "s2", "go", "this", False), (3, "f1", "s1", "go", "x", False), (4, "f1", "s1", "run", None, False), (5, "f1", "s1", "far", None, False), (6, "f1", "s1", "go", "y", False)], "call_id int, file_id string, caller string, callee string, receiver string, constructs boolean")
    got = rows(code.resolve_calls(calls, symbols, imported, bindings))
    assert got == [(1, "s4", 0.88, 1), (2, "s2", 0.96, 3), (3, "s6", 0.94, 4), (4, "s1", 0.9, 5), (5, "s8", 0.92, 6)]


def test_trace_numbers_steps_by_parent(spark):
    y = spark.createDataFrame([(x, "function") for x in "abcdef"] + [("t", "interface")], "id string, kind string")
    e = spark.createDataFrame([("a", "c", "CALLS"), ("a", "b", "CALLS"), ("b", "f", "CALLS"), ("c", "d", "IMPORTS"), ("b", "a", "CALLS"), ("c", "t", "CALLS"), ("t", "e", "CALLS"), ("a", "nowhere", "CALLS")], "from_id string, to_id string, type string")
    got = [(r.step, r.symbol_id, r.via, r.depth) for r in code.trace(e, y, "a", terminal=("interface",)).orderBy("step").collect()]
    assert got == [(1, "a", None, 0), (2, "b", "a", 1), (3, "c", "a", 1), (4, "f", "b", 2), (5, "d", "c", 2), (6, "t", "c", 2)]
    assert code.trace(e, y, "none").count() == 0


def test_communities(spark):
    cliques = [(f"{p}{i}", f"{p}{j}") for p in "ab" for i in range(5) for j in range(i)] + [("a0", "b0"), ("z", "z")]
    e = spark.createDataFrame([(a, b, "CALLS") for a, b in cliques], "from_id string, to_id string, type string")
    n = spark.createDataFrame([(x,) for x in sorted({x for c in cliques for x in c})], "node string")
    of = dict(rows(graph.communities(e, n)))
    assert len(of) == 11 and {of[f"a{i}"] for i in range(5)} == {"a0"} and {of[f"b{i}"] for i in range(5)} == {"b0"} and of["z"] == "z"
    with pytest.raises(ValueError):
        graph.communities(e, n, largest=3).count()


def test_pack_levels_and_free_chains(spark):
    items = [("k", "card", 0, "c", 100), ("k", "file", 0, "f1", 350), ("k", "file", 1, "f2", 200), ("k", "file", 2, "f3", 40), ("k", "symbol", 0, "y", 5), ("k", "chain", 0, "h", 9999)]
    i = spark.createDataFrame(items, "key string, kind string, ord int, id string, tokens long")
    assert [r.id for r in context.pack(i, 500).collect()] == ["c", "f1", "f3", "h"]
    assert {r.id for r in context.pack(i, 2000).collect()} == {"c", "f1", "f2", "f3", "y", "h"}


def test_chunks_cover_every_line(spark):
    text = "\n".join("word " * (k % 9 + 1) for k in range(60))
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    c = [(r.id, r.first, r.last) for r in context.token_chunks(d, 30).orderBy("id", "chunk").collect()]
    lines = [k for i, a, b in c if i == 1 for k in range(a, b + 1)]
    assert lines == list(range(60)) and {i for i, *_ in c} == {1, 2, 3}
    over = context.token_chunks(d.where("id = 1"), 30, 10).orderBy("chunk").collect()
    assert any(b.first <= a.last for a, b in zip(over, over[1:])) and all(b.first <= a.last + 1 for a, b in zip(over, over[1:]))


def test_memory_life_cycle(spark):
    kind = "id string, type string, content string, scope array<string>, evidence array<string>, confidence double, rules array<struct<type:string,target:string>>, validated string"
    m = spark.createDataFrame([("a", "fact", "x", ["src/a"], [], 1.4, [], None), ("b", "fact", "y", ["src/b"], ["e"], 0.1, [("commit", "")], "old"), ("c", "rule", "z", ["src/c"], [], 0.5, [("commit", "")], None)], kind)
    kept = {r.id: r for r in memory.remember(m).collect()}
    assert kept["a"].confidence == 1.0 and kept["a"].evidence == ["src/a"] and kept["b"].evidence == ["e"] and kept["a"].rules[0].target == "src/a"
    assert {r.id for r in memory.expire(m, "new").collect()} == {"a", "c"}
    assert {r.id: r.validated for r in memory.validate(m, "new").collect()} == {"a": "new", "b": "old", "c": "new"}
    assert {r.id for r in memory.forget(m, scope="src/b").collect()} == {"a", "c"} and memory.stale_count(m).first().stale == 2


def test_ledger(spark):
    led = spark.createDataFrame([("s", 1, "file", "a:x", 5, None), ("s", 2, "file", "a:x", 5, None), ("t", 3, "chunk", "b", 1, None)], "session string, seq int, kind string, item string, tokens int, feedback string")
    assert [r.feedback for r in memory.feedback(led, "s", "a:x", "good").orderBy("seq").collect()] == [None, "good", None]
    assert {r.item for r in memory.prune(led, spark.createDataFrame([("a",)], "key string")).collect()} == {"b"}
    pack = spark.createDataFrame([("s", "file", "a:x", "a"), ("s", "file", "n", "n"), ("s", "evidence", "e1", "a:x"), ("s", "evidence", "e2", None)], "session string, kind string, item string, file string")
    assert {r.item for r in memory.omit_repeated(pack, led).collect()} == {"n", "e2"}


def test_batches_have_a_longest_time(spark):
    c = spark.createDataFrame([("k", k, f"2024-01-01 00:00:0{k // 2}.{5 * (k % 2)}") for k in range(9)] + [("k", 99, "2024-01-01 01:00:00")], "key string, seq long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.run, r.batch, r.n) for r in incremental.batches(c).groupBy("key", "run", "batch").agg(F.count("*").alias("n")).collect())
    assert got == [(1, 0, 4), (1, 1, 4), (1, 2, 1), (2, 0, 1)]


def test_write_buffer_and_rebuild(spark):
    w = spark.createDataFrame([("a", "b", "CALLS", 0.5, "x", 1), ("a", "b", "CALLS", 0.9, "y", 2)], "from_id string, to_id string, type string, confidence double, evidence string, seq int")
    assert rows(incremental.write_buffer(w)) == [("a", "b", "CALLS", 0.9, ["x", "y"])]
    old = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "from_id string, to_id string")
    got = incremental.rebuild_edges(old, spark.createDataFrame([("a", "z")], "from_id string, to_id string"), spark.createDataFrame([("b",)], "id string"))
    assert rows(got) == [("a", "z"), ("c", "d")]


def test_dirty_plan_falls_back_to_a_scan(spark):
    ask = lambda changed, folder: {r.state for r in incremental.dirty_plan(spark.createDataFrame([(p,) for p in changed], "path string"), spark.createDataFrame([("src/a.ts", 1, folder)], "path string, size long, folder boolean"), spark.createDataFrame([], "path string")).collect()}
    assert ask(["src/a.ts"], False) == {"changed"} and ask(["src/a.ts"], True) == {"scan"} and ask([f"src/{k}.ts" for k in range(501)], False) == {"scan"}


def test_postings_equal_the_scan(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(["the red fox", "red red car", None, "", "the the the", "blue"])], "id int, text string")
    for terms, every in ((["the", "red"], False), (["the", "red"], True), (["none"], False)):
        assert rows(search.search_postings(search.postings(d), search.corpus_stats(d), terms, every)) == rows(retrieval.bm25(d, terms, every))


def test_full_text_tiers_and_snippets(spark):
    d = spark.createDataFrame([(1, "the handler parses the request", "a", "src/x.ts"), (2, "handler only", "a", "src/y.ts"), (3, "handler parses", "b", "lib/z.ts")], "id int, text string, kind string, path string")
    got = [(r.id, r.rank) for r in search.full_text(d, "handler the", path="src/**").orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert "<<handler>>" in search.full_text(d, "handler", kind="b").first().snippet
    assert search.fts_terms("parseFile the_x") == (["parseFile", "the_x", "parse", "file", "the", "x"], ["parseFile", "the_x", "parse", "file", "x"])


def test_search_modes(spark):
    k = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    e = spark.createDataFrame([("1", "5", "CALLS", 1.0), ("5", "6", "CALLS", 1.0)], "from_id string, to_id string, type string, confidence double")
    assert {r.id for r in search.search(k, None, e, "hybrid").collect()} == {1, 2, 5, 6} and {r.id for r in search.search(k, None, e, "graph").collect()} == {5, 6}
    assert [r.id for r in search.search(k, None, e).collect()][:2] == [1, 2]
    with pytest.raises(ValueError):
        search.search(k, None, e, "vector")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    assert s.tables() == [] and s.read("files") is None
    s.write("files", spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))
    s.replace("files", spark.createDataFrame([("b", 3), ("b", 4)], "id string, n int"), ["id"])
    assert rows(s.read("files")) == [("a", 1), ("b", 3), ("b", 4)] and rows(s.health()) == [("files", 3, 2)]
    v = lambda *x: spark.createDataFrame(list(x), "id string, vec array<double>")
    store.add_vectors(s, v(("a", [1.0, 0.0]), ("b", [0.0, 1.0])))
    store.add_vectors(s, v(("a", [2.0, 0.0])))
    store.delete_vectors(s, v(("b", [0.0])))
    assert rows(s.read("vectors")) == [("a", [2.0, 0.0])] and tuple(store.vector_stats(s).first()) == (1, 1)


def test_registry_and_results(spark):
    e = lambda *x: spark.createDataFrame(list(x), "name string, path string, seq int")
    got = [tuple(r) for r in store.register(e(("b", "/b", 1), ("a", "/a", 2)), e(("a", "/new", 3), ("c", "/b", 4))).collect()]
    assert got == [("a", "/new", 3), ("c", "/b", 4)]
    r = store.tool_result(e(("a", "/a", 1)), "demo", "stale")
    assert json.loads(r.json())["nextAction"] == "sync_index" and r.data[0]["name"] == "a"


def test_providers(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, None), (3, "bad")], "id int, text string")

    def picky(texts):
        if "bad" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    assert {r.id: r.value for r in store.provided(d, picky, "string", batch=1).collect()} == {1: "RED FOX", 2: "", 3: None}
    v = {r.id: r.value for r in store.provided(d, store.hashed, "array<double>").collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-9 and not any(v[2])


def test_ivf_finds_itself(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index, centres, books = store.ivf_index(v, 8, 4, 4)
    assert index.count() == v.count() and len(centres) == 8 and len(books) == 4
    q = v.orderBy("id").first()
    assert store.ivf_search(v, index, centres, q.vec, 2).first().id == q.id


def test_gitignore_and_git(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\nout2/\n")
    for p in ("a.ts", "x.log", "out2/b.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("export const a = 1;\n")
    assert {r.path for r in source_tree.discover(spark, str(tmp_path)).collect()} - {".gitignore"} == {"a.ts"}
    assert store.git_commits(spark, str(tmp_path)).count() == 0


def test_wiki(spark):
    f = spark.createDataFrame([("f1", "a.ts"), ("f2", "b.py")], "id string, path string")
    e = spark.createDataFrame([("f1", "f2", "IMPORTS")], "from_id string, to_id string, type string")
    d = json.loads(store.wiki(f, f, e).first().document)
    assert d["files"] == 2 and d["imported"] == [{"path": "b.py", "n": 1}] and d["languages"][0]["language"] == "python"


TS = """import { b } from './b.js';
export * from './c.js';
export { x as y, z } from './d.js';
export class Car extends Base implements Runs, Stops {
  go() { this.start(); helper(); }
}
const car = new Car();
car.go();
router.post('/api/users', handler);
fetch('/api/users', { method: 'POST' });
"""
PY = """from fastapi import FastAPI
class A(B):
    pass
@app.get("/items")
def items():
    a = A()
    return a.run()
"""


def test_facts_of_a_file():
    ts = {x[:3] for x in source_tree.parse("a.ts", "typescript", TS)}
    assert {("import", "module", "./b.js"), ("export", "./c.js", "*"), ("export", "./d.js", "y"), ("export", "./d.js", "z"), ("export", "", "Car"), ("symbol", "class", "Car"), ("extends", "Car", "Base"), ("implements", "Car", "Runs"), ("implements", "Car", "Stops"), ("call", "this", "start"), ("call", "", "helper"), ("call", "new", "Car"), ("call", "car", "go"), ("binding", "Car", "car"), ("route", "POST", "/api/users"), ("route_reference", "POST", "/api/users")} <= ts
    py = {x[:3] for x in source_tree.parse("a.py", "python", PY)}
    assert {("extends", "A", "B"), ("route", "GET", "/items"), ("binding", "A", "a"), ("call", "a", "run"), ("symbol", "function", "items")} <= py
    assert source_tree.parse("a.py", "python", "def (") == []
