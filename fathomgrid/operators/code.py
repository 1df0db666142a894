"""Operators over a code index: files(id, path, role), symbols(id, file_id, name, kind, start_line, end_line)
and edges(from_id, to_id, type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph
from .session import containment, first_candidate

# Confidence of derived edges.
CONFIDENCE = {"imports": 0.95, "file_tests": 0.80, "references": 0.75, "symbol_tests": 0.82, "types": 0.90, "route": 0.88, "route_other": 0.72, "config": 0.55}
# Extensions tried for an import without one.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
# Files whose functions are entry points where there is no route and no ``main``.
ROOT_FILES = tuple(f"{folder}{stem}.{e}" for folder, stem, every in (("", "index", ("ts", "js", "mjs", "cjs", "tsx", "jsx")), ("", "main", ("ts", "js", "mjs", "cjs", "tsx", "jsx")), ("src/", "index", ("ts", "js", "mjs", "cjs")), ("src/", "main", ("ts", "js", "mjs", "cjs"))) for e in every)


def first_n(df: DataFrame, key: list, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def named(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path of their file."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, kind, path, start_line) of symbols and files; an id that is both is the symbol."""
    s = named(symbols, files).select("id", "name", "kind", "path", "start_line", F.lit(0).alias("rank"))
    f = files.select("id", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("kind"), "path", F.lit(0).cast("long").alias("start_line"), F.lit(1).alias("rank"))
    return first_candidate(s.unionByName(f), ["id"], ["rank", "path"]).drop("rank")


def lookup(ids: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``ids(id, ...)`` with name, kind and path; an unknown id stands for itself."""
    n = nodes(symbols, files).drop("start_line")
    return ids.join(n, "id", "left").withColumns({"name": F.coalesce("name", "id"), "kind": F.coalesce("kind", F.lit("unknown")), "path": F.coalesce("path", F.lit(""))})


def call_pairs(edges: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """(from_id, rank, chain): ``a → b`` for the first calls of each symbol."""
    a, b = symbols.select(F.col("id").alias("from_id"), F.col("name").alias("a")), symbols.select(F.col("id").alias("to_id"), F.col("name").alias("b"))
    calls = edges.where("type = 'CALLS'").join(a, "from_id").join(b, "to_id")
    return first_n(calls, ["from_id"], ["b", "to_id"], limit).select("from_id", "rank", F.concat_ws(" → ", "a", "b").alias("chain"))


def resolve_targets(targets: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(target, id): a file of that path, else a symbol of that name, else ``Owner.member``; targets without any are left out."""
    s = named(symbols, files)
    by_path = targets.join(files.select(F.col("path").alias("target"), "id"), "target").select("target", "id", F.lit(0).alias("rule"), F.lit("").alias("path"), F.lit(0).cast("long").alias("line"))
    by_name = targets.join(s.select(F.col("name").alias("target"), "id", "path", F.col("start_line").alias("line")), "target").select("target", "id", F.lit(1).alias("rule"), "path", "line")
    parts = targets.where(F.col("target").contains(".")).select("target", F.regexp_extract("target", r"^(.*)\.[^.]*$", 1).alias("owner"), F.regexp_extract("target", r"\.([^.]*)$", 1).alias("name"))
    own = s.where("kind in ('class', 'interface')").select("file_id", F.col("name").alias("owner"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    inside = parts.join(s, "name").join(own, ["file_id", "owner"]).where("lo <= start_line and end_line <= hi and not (lo = start_line and hi = end_line)")
    member = inside.select("target", "id", F.lit(2).alias("rule"), F.lpad((F.col("hi") - F.col("lo")).cast("string"), 12, "0").alias("path"), F.col("start_line").alias("line"))
    return first_candidate(by_path.unionByName(by_name).unionByName(member), ["target"], ["rule", "path", "line", "id"]).select("target", "id")


def language_rank(path: Column) -> Column:
    return F.when(path.rlike(r"\.tsx?$"), 0).when(path.rlike(r"\.jsx?$"), 1).otherwise(2)


def find_definitions(symbols: DataFrame, files: DataFrame, name: str, limit: int = 30) -> DataFrame:
    """(id, name, path): symbols whose name holds the text; the exact name first, then TypeScript, JavaScript, others."""
    hit = named(symbols, files).where(F.contains(F.lower("name"), F.lit(name.lower())))
    order = [F.when(F.col("name") == name, 0).otherwise(1), language_rank(F.col("path")), "path", "start_line", "id"]
    return hit.withColumn("exact", F.col("name") == name).orderBy(*order).limit(limit).select("id", "name", "path", "exact")


def find_references(edges: DataFrame, symbols: DataFrame, files: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """(kind, id, path, confidence) of what points at the first five definitions of a name: every reference,
    ten calls and five imports of each definition; one row for each place, the surest first."""
    defs = find_definitions(symbols.where(F.col("name") == name), files, name, 5).select(F.col("id").alias("to_id"))
    inward = edges.where("type in ('REFERENCES', 'CALLS', 'IMPORTS')").join(defs, "to_id", "left_semi")
    some = first_n(inward, ["to_id", "type"], [F.desc("confidence"), "from_id"], 1 << 30)
    some = some.where("type = 'REFERENCES' or (type = 'CALLS' and rank <= 10) or (type = 'IMPORTS' and rank <= 5)")
    at = nodes(symbols, files)
    placed = some.join(at.withColumnRenamed("id", "from_id"), "from_id").select("type", "from_id", "path", "start_line", "confidence")
    best = first_candidate(placed, ["path", "start_line"], [F.desc("confidence"), "type", "from_id"])
    return best.orderBy(F.desc("confidence"), "path", "start_line", "from_id").limit(limit).select(F.col("type").alias("kind"), F.col("from_id").alias("id"), "path", "confidence")


# ---- building edges


def joined_path(importer: Column, specifier: Column) -> Column:
    """A relative specifier from its importer's folder, ``.`` and ``..`` followed to any depth."""
    parts = F.concat(F.slice(F.split(importer, "/"), 1, F.greatest(F.size(F.split(importer, "/")) - 1, F.lit(0))), F.split(specifier, "/"))
    empty = F.array().cast("array<string>")
    up = lambda a: F.when((F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(F.lit(".."))))
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.when(F.size(a) > 0, up(a)).otherwise(F.concat(a, F.array(F.lit(".."))))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def suffixed(path: Column, importer: Column) -> Column:
    """Files that a path may mean, in the order they are tried."""
    stem = F.regexp_replace(path, r"\.(jsx?|mjs|cjs)$", "")
    ts_first = [F.concat(path, F.lit(e)) for e in SUFFIXES] + [F.concat(path, F.lit("/index" + e)) for e in SUFFIXES]
    order = (2, 3, 4, 5, 0, 1)
    js_first = [F.concat(path, F.lit(SUFFIXES[k])) for k in order] + [F.concat(path, F.lit("/index" + SUFFIXES[k])) for k in order]
    bare = F.when(importer.rlike(r"\.tsx?$"), F.array(*ts_first)).otherwise(F.array(*js_first))
    return F.when(path.rlike(r"\.(jsx?|mjs|cjs)$"), F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), path)).when(path.rlike(r"\.[A-Za-z0-9]+$"), F.array(path)).otherwise(bare)


def resolve_imports(imports: DataFrame, files: DataFrame, rules: DataFrame | None = None, base: str = "") -> DataFrame:
    """(importer, specifier, target) of imports(importer, specifier): the first file that is one of the candidates.

    Relative specifiers first, then ``rules(pattern, target, priority)`` of aliases and packages (one ``*``
    stands for the rest; exact patterns have none), then the bare path, then below ``base``.
    """
    rel = imports.where(F.col("specifier").rlike(r"^\.\.?(/|$)")).select("*", F.lit(0).alias("tier"), joined_path(F.col("importer"), F.col("specifier")).alias("path"))
    other = imports.where(~F.col("specifier").rlike(r"^\.\.?(/|$)"))
    options = rel
    if rules is not None:
        star = F.contains("pattern", F.lit("*"))
        head, tail = F.regexp_extract("pattern", r"^([^*]*)\*", 1), F.regexp_extract("pattern", r"\*(.*)$", 1)
        hit = F.when(star, F.startswith("specifier", head) & F.endswith("specifier", tail) & (F.length("specifier") >= F.length(head) + F.length(tail))).otherwise(F.col("pattern") == F.col("specifier"))
        rest = F.substr("specifier", F.length(head) + 1, F.length("specifier") - F.length(head) - F.length(tail))
        aliased = other.join(F.broadcast(rules), hit)  # a manifest's rules: some dozens
        options = options.unionByName(aliased.select(*imports.columns, (F.col("priority") + 1).cast("int").alias("tier"), F.when(star, F.replace("target", F.lit("*"), rest)).otherwise(F.col("target")).alias("path")))
    options = options.unionByName(other.select("*", F.lit(1 << 20).alias("tier"), F.col("specifier").alias("path")))
    if base:
        options = options.unionByName(other.select("*", F.lit(1 << 21).alias("tier"), F.concat(F.lit(base.rstrip("/") + "/"), "specifier").alias("path")))
    tried = options.select("importer", "specifier", "tier", F.posexplode(suffixed(F.col("path"), F.col("importer"))).alias("nth", "target"))
    hit = tried.join(files.select(F.col("path").alias("target")), "target")
    return first_candidate(hit, ["importer", "specifier"], ["tier", "nth", "target"]).select("importer", "specifier", "target")


def reexport_closure(exports: DataFrame, depth: int = 16) -> DataFrame:
    """(file, name, origin, origin_name): where an exported name is defined.

    ``exports(file, name, source, source_name)``: ``source`` null for a definition; name ``*`` passes on
    every name of the source; an alias has another ``source_name``.  Chains end at ``depth`` or where they
    would visit a file again; the shortest chain wins.
    """
    known = exports.where("source is null").select("file", "name", F.col("file").alias("origin"), F.col("name").alias("origin_name"), F.lit(0).alias("hops"))
    links = exports.where("source is not null")
    front = known
    for hop in range(1, depth + 1):
        was = front.select(F.col("file").alias("source"), F.col("name").alias("given"), "origin", "origin_name")
        step = links.join(was, "source").where((F.col("name") == "*") | (F.col("source_name") == F.col("given")))
        step = step.select("file", F.when(F.col("name") == "*", F.col("given")).otherwise(F.col("name")).alias("name"), "origin", "origin_name", F.lit(hop).alias("hops"))
        step = first_candidate(step, ["file", "name"], ["origin", "origin_name"])
        front = graph.cut(step.join(known, ["file", "name"], "left_anti"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known.select("file", "name", "origin", "origin_name")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """(call_id, target, confidence, rule): what each call means, by the first rule that applies.

    ``calls(call_id, file_id, caller, callee, receiver, constructs)``; ``imported(file_id, name, symbol_id, kind)``;
    ``bindings(file_id, name, line, class_name)`` of receivers; symbols as above, with ``owner`` (class) for methods.
    Constructor: an imported class, else a local one.  ``this``: the method of the caller's class, same
    file first.  Receiver: the method of its latest bound class.  Plain: a local symbol, else an imported one.
    """
    kinds = ["file_id", "name", "id", "kind", "owner"]
    s = symbols.withColumn("owner", F.col("owner") if "owner" in symbols.columns else F.lit(None).cast("string")).select(*kinds)
    plain, new = F.col("receiver").isNull() & ~F.col("constructs"), F.col("constructs")

    def hits(c: DataFrame, rule: int, confidence: float) -> DataFrame:
        return c.select("call_id", F.col("id").alias("target"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"), F.coalesce("near", F.lit(0)).alias("near"))

    local = s.withColumnRenamed("name", "callee")
    imp = imported.select("file_id", F.col("name").alias("callee"), F.col("symbol_id").alias("id"), "kind").withColumn("near", F.lit(0))
    same = F.lit(0).alias("near")
    mine = s.where("owner is not null").select(F.col("name").alias("callee"), "id", F.col("owner").alias("class_name"), F.col("file_id").alias("in_file"))
    out = hits(calls.where(new).join(imp.where("kind = 'class'"), ["file_id", "callee"]), 1, 0.88)
    out = out.unionByName(hits(calls.where(new).join(local.where("kind = 'class'"), ["file_id", "callee"]).select("*", same), 2, 0.88))
    caller = s.select(F.col("id").alias("caller"), F.col("owner").alias("class_name")).where("class_name is not null")
    this = calls.where("receiver = 'this'").join(caller, "caller").join(mine, ["class_name", "callee"]).withColumn("near", F.when(F.col("in_file") == F.col("file_id"), 0).otherwise(1))
    out = out.unionByName(hits(this, 3, 0.96))
    if bindings is not None:
        last = first_candidate(bindings, ["file_id", "name"], [F.desc("line")]).select("file_id", F.col("name").alias("receiver"), "class_name")
        bound = calls.where("receiver <> 'this'").join(last, ["file_id", "receiver"]).join(mine, ["class_name", "callee"]).withColumn("near", F.when(F.col("in_file") == F.col("file_id"), 0).otherwise(1))
        out = out.unionByName(hits(bound, 4, 0.94))
    out = out.unionByName(hits(calls.where(plain).join(local.where("kind in ('function', 'variable', 'constant', 'method')"), ["file_id", "callee"]).select("*", same), 5, 0.90))
    out = out.unionByName(hits(calls.where(plain).join(imp, ["file_id", "callee"]), 6, 0.92))
    return first_candidate(out, ["call_id"], ["rule", "near", "target"]).select("call_id", "target", "confidence", "rule")


def type_edges(relations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(from_id, name, to_id, confidence) of relations(from_id, name, to_id): the known target, else the first class or interface of that name."""
    first = first_candidate(named(symbols, files).where("kind in ('class', 'interface')"), ["name"], ["path", "start_line", "id"]).select("name", F.col("id").alias("found"))
    return relations.join(first, "name", "left").withColumn("to_id", F.coalesce("to_id", "found")).where("to_id is not null").select("from_id", "name", "to_id", F.lit(CONFIDENCE["types"]).alias("confidence"))


def route_edges(references: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(ref_id, endpoint, confidence, status): the endpoint of a path, of the same method if there is one."""
    e = endpoints.select("path", F.col("method").alias("has"), F.col("id").alias("endpoint"))
    tried = references.join(e, "path", "left").withColumn("other", F.when(F.col("has") == F.col("method"), 0).otherwise(1))
    best = first_candidate(tried, ["ref_id"], ["other", "endpoint"])
    hit = F.col("endpoint").isNotNull()
    confidence = F.when(hit & (F.col("other") == 0), CONFIDENCE["route"]).when(hit, CONFIDENCE["route_other"]).otherwise(0.0)
    return best.select("ref_id", "endpoint", confidence.alias("confidence"), F.when(~hit, "unresolved").when(F.col("other") == 0, "resolved").otherwise("ambiguous").alias("status"))


def config_edges(files: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence): a config file configures the sources below its folder, one at the root all.

    Sources carry each of their folders, so this is an equi-join on the folder and no cross join.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    config = files.where("role = 'config'").select(F.col("id").alias("from_id"), folder.alias("folder"))
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    every = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    source = files.where("role = 'source'").select(F.col("id").alias("to_id"), F.explode(every).alias("folder"))
    return config.join(source, "folder").select("from_id", "to_id", F.lit(CONFIDENCE["config"]).alias("confidence"))


def test_edges(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence): symbols of a test file test the symbols of the files it imports; imports(from_id, to_id) are of files."""
    tests = files.where("role = 'test'").select(F.col("id").alias("f"))
    pairs = imports.select(F.col("from_id").alias("f"), F.col("to_id").alias("t")).distinct().join(tests, "f", "left_semi")
    a, b = symbols.select(F.col("file_id").alias("f"), F.col("id").alias("from_id")), symbols.select(F.col("file_id").alias("t"), F.col("id").alias("to_id"))
    return pairs.join(a, "f").join(b, "t").select("from_id", "to_id", F.lit(CONFIDENCE["symbol_tests"]).alias("confidence"))


# ---- tests


def naming_tests(files: DataFrame) -> DataFrame:
    """(path, test): test files whose name says that they test the file."""
    base, folder, name = F.regexp_replace("path", r"\.[^.]+$", ""), F.regexp_replace("path", "/?[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    tried = F.array(*[F.concat(base, F.lit(e)) for e in (".test.ts", ".spec.ts", ".test.js", ".spec.js")], F.concat(folder, F.lit("/__tests__/"), name))
    return files.where("role = 'source'").select("path", F.explode(tried).alias("test")).join(files.select(F.col("path").alias("test")), "test", "left_semi").select("path", "test")


def token_tests(files: DataFrame, target: str, limit: int = 5) -> DataFrame:
    """(test, shared, confidence): test files that share most words of their path with the target."""
    want = tx.path_tokens(F.lit(target))
    hit = files.where("role = 'test'").select(F.col("path").alias("test"), F.size(F.array_intersect(tx.path_tokens(F.col("path")), want)).alias("shared")).where("shared > 0")
    return hit.orderBy(F.desc("shared"), "test").limit(limit).withColumn("confidence", F.round(F.least(F.lit(0.7), 0.45 + F.col("shared") * 0.1), 6))


def related_tests(edges: DataFrame, symbols: DataFrame, files: DataFrame, target_file: str) -> DataFrame:
    """(test, method, confidence) for the file with this id: by edges to its symbols .95 and to itself .90, by name .75,
    by imports of test files .85; one row for each test file, the first method wins; if none, by path words."""
    path = files.where(F.col("id") == target_file).select("path")
    home = symbols.select("id", "file_id")
    test_of = edges.where("type = 'TESTS'").join(home.select(F.col("id").alias("from_id"), F.col("file_id").alias("by")), "from_id", "left").withColumn("by", F.coalesce("by", "from_id"))
    to_symbol = test_of.join(home.where(F.col("file_id") == target_file).select(F.col("id").alias("to_id")), "to_id", "left_semi").select("by", F.lit("edge to a symbol").alias("method"), F.lit(0.95).alias("confidence"), F.lit(0).alias("rank"))
    to_file = test_of.where(F.col("to_id") == target_file).select("by", F.lit("edge to the file").alias("method"), F.lit(0.90).alias("confidence"), F.lit(1).alias("rank"))
    name = naming_tests(files).join(path, "path", "left_semi").join(files.select(F.col("path").alias("test"), F.col("id").alias("by")), "test").select("by", F.lit("name").alias("method"), F.lit(0.75).alias("confidence"), F.lit(2).alias("rank"))
    tests = files.where("role = 'test'").select(F.col("id").alias("from_id"))
    imports = edges.where((F.col("type") == "IMPORTS") & (F.col("to_id") == target_file)).join(tests, "from_id", "left_semi").orderBy("from_id").limit(20).select(F.col("from_id").alias("by"), F.lit("imports").alias("method"), F.lit(0.85).alias("confidence"), F.lit(3).alias("rank"))
    every = to_symbol.unionByName(to_file).unionByName(name).unionByName(imports).join(files.select(F.col("id").alias("by"), F.col("path").alias("test")), "by")
    found = first_candidate(every, ["test"], ["rank", "by"]).select("test", "method", "confidence")
    if not found.isEmpty():
        return found
    row = path.first()
    return token_tests(files, row.path if row else "").select("test", F.lit("path words").alias("method"), "confidence")


def coverage(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, files, covered, percent) of source files; covered: a test by name, or an edge from a test to the file or a symbol of it."""
    home = symbols.select(F.col("id").alias("to_id"), "file_id")
    by_edge = edges.where("type = 'TESTS'").join(home, "to_id", "left").select(F.coalesce("file_id", "to_id").alias("id"))
    by_name = naming_tests(files).join(files.select("path", "id"), "path").select("id")
    tested = by_edge.unionByName(by_name).distinct().withColumn("hit", F.lit(1))
    f = files.where("role = 'source'").join(tested, "id", "left").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.count("hit").alias("covered"))
    return f.withColumn("percent", F.round(100 * F.col("covered") / F.col("files")).cast("long"))


# ---- impact


def impact(edges: DataFrame, target: str) -> DataFrame:
    """(kind, node, distance): callers 3 hops, callees 2, references 2 at any confidence, implementors 2, tests 1."""
    out = None
    for kind, types, hops, direction, floor in (("caller", ["CALLS"], 3, "in", 0.8), ("callee", ["CALLS"], 2, "out", 0.8), ("reference", ["REFERENCES"], 2, "in", 0.0), ("implementor", ["EXTENDS", "IMPLEMENTS"], 2, "in", 0.8), ("test", ["TESTS"], 1, "in", 0.8)):
        part = graph.bfs(edges, [target], hops, direction, types, floor).select(F.lit(kind).alias("kind"), "node", "distance")
        out = part if out is None else out.unionByName(part)
    return out


#: The order in which kinds of impact claim a file.
KINDS = ("target", "caller", "callee", "reference", "implementor", "test")


def affected_files(found: DataFrame, target: str, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kind, distance, direct): the nearest way each file is reached by :func:`impact`'s rows."""
    every = found.unionByName(found.sparkSession.createDataFrame([("target", target, 0)], "kind string, node string, distance int"))
    placed = every.join(nodes(symbols, files).select(F.col("id").alias("node"), "path"), "node")
    return first_candidate(placed.withColumn("rank", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))), ["path"], ["distance", "rank", "node"]).select("path", "kind", "distance", (F.col("distance") <= 1).alias("direct"))


def related_configs(edges: DataFrame, target_file: str) -> DataFrame:
    """(config): what configures a file."""
    return edges.where((F.col("type") == "CONFIGURES") & (F.col("to_id") == target_file)).select(F.col("from_id").alias("config")).distinct()


def risk_points(found: DataFrame, name: str) -> DataFrame:
    """(severity, reason) of a target with this name and these :func:`impact` rows."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    g = found.agg(n("caller").alias("callers"), n("implementor").alias("implementors"), F.coalesce(F.max(F.when(F.col("kind").isin("caller", "callee"), F.col("distance"))), F.lit(0)).alias("depth"))
    pattern = tx.risk_of(F.lit(name))
    point = lambda severity, reason, when: F.when(when, F.struct(F.lit(severity).alias("severity"), reason.alias("reason")))
    many = lambda c: F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))
    rows = [point("high", F.concat(F.lit("pattern: "), pattern), pattern != "none"), point("high", many("callers"), F.col("callers") > 10), point("medium", many("callers"), F.col("callers").between(6, 10)), point("medium", many("depth"), F.col("depth") >= 3), point("high", many("implementors"), F.col("implementors") > 10), point("medium", many("implementors"), F.col("implementors").between(6, 10))]
    return g.select(F.explode(F.array(*rows)).alias("p")).where("p is not null").select("p.severity", "p.reason")


def call_chains(found: DataFrame, target: str, symbols: DataFrame, each: int = 5) -> DataFrame:
    """(chain): ``caller → target`` and ``target → callee`` for the nearest ones."""
    some = first_n(found.where("kind in ('caller', 'callee')"), ["kind"], ["distance", "node"], each)
    s = symbols.select(F.col("id").alias("node"), "name")
    t = symbols.where(F.col("id") == target).select(F.col("name").alias("own"))
    two = some.join(s, "node").crossJoin(F.broadcast(t))  # one row
    return two.select("kind", "rank", F.when(F.col("kind") == "caller", F.concat_ws(" → ", "name", "own")).otherwise(F.concat_ws(" → ", "own", "name")).alias("chain"))


# ---- traces


def entry_points(symbols: DataFrame, files: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """(symbol_id, name, kind): routes(symbol_id, method, path) if there are any, else functions named main,
    else the functions of root files."""
    if routes is not None:
        r = first_candidate(routes.where("symbol_id is not null").withColumn("name", F.concat_ws(" ", "method", "path")), ["name"], ["symbol_id"]).select("symbol_id", "name", F.lit("route").alias("kind"))
        if not r.isEmpty():
            return r
    functions = symbols.where("kind = 'function'")
    main = functions.where("name = 'main'").select(F.col("id").alias("symbol_id"), "name", F.lit("main").alias("kind"))
    if not main.isEmpty():
        return main
    return functions.join(files.where(F.col("path").isin(*ROOT_FILES)).select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("symbol_id"), "name", F.lit("export_default").alias("kind"))


def trace(edges: DataFrame, symbols: DataFrame, entry: str, depth: int = 10, terminal: tuple[str, ...] = ()) -> DataFrame:
    """(step, symbol_id, via, depth): breadth-first over calls and imports, symbols only.

    Steps are numbered by depth, then by the step they were first reached from, then by id.  Symbols of a
    ``terminal`` kind are steps from which nothing goes on.
    """
    spark, s = edges.sparkSession, symbols.select("id", "kind")
    e = edges.where("type in ('CALLS', 'IMPORTS')").select("from_id", F.col("to_id").alias("id")).distinct().join(s, "id")
    front = spark.createDataFrame([(entry,)], "id string").join(s, "id").select(F.lit(1).alias("step"), "id", F.lit(None).cast("string").alias("via"), F.lit(0).alias("depth"), "kind")
    front = seen = graph.cut(front)
    for d in range(1, depth + 1):
        go = front.where(~F.col("kind").isin(*terminal)) if terminal else front
        step = e.join(go.select(F.col("id").alias("from_id"), F.col("step").alias("parent")), "from_id").join(seen, "id", "left_anti")
        step = first_candidate(step, ["id"], ["parent"])
        last = seen.agg(F.max("step")).first()[0] or 0
        # the number of a step is the place of its parent's block and its place there: no global sort
        before = Window.orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
        blocks = step.groupBy("parent").agg(F.count("*").alias("n")).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
        nth = F.row_number().over(Window.partitionBy("parent").orderBy("id"))
        step = step.withColumn("nth", nth).join(blocks.select("parent", "at"), "parent")
        front = graph.cut(step.select((F.lit(last) + F.col("at") + F.col("nth")).cast("int").alias("step"), "id", F.col("from_id").alias("via"), F.lit(d).alias("depth"), "kind"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select("step", F.col("id").alias("symbol_id"), "via", "depth")


def trace_feature(edges: DataFrame, symbols: DataFrame, files: DataFrame, name: str, hops: int = 2, limit: int = 100) -> DataFrame:
    """(node, distance, role): symbols whose name holds the feature, and what they reach; roles by kind and path."""
    entries = named(symbols, files).where(F.contains(F.lower("name"), F.lit(name.lower()))).select("id").orderBy("id").limit(limit)
    seeds = [r.id for r in entries.collect()]  # at most ``limit`` rows
    reach = graph.bfs(edges, seeds, hops, "out", ["CALLS", "IMPORTS", "REFERENCES"]).unionByName(edges.sparkSession.createDataFrame([(x, 0) for x in seeds], "node string, distance int"))
    role = F.when(F.col("distance") == 0, "entry").when(F.lower("path").rlike("test"), "test").when(F.col("kind").isin("class", "interface"), "model").when(F.col("kind") == "file", "module").otherwise("step")
    return reach.join(nodes(symbols, files).withColumnRenamed("id", "node"), "node").select("node", "distance", role.alias("role")).orderBy("distance", "node").limit(limit)


def expand_context(edges: DataFrame, node: str, hops: int = 2) -> DataFrame:
    """(bucket, node, distance): callers, callees, references within ``hops``; dependents and tests one hop away."""
    out = None
    for bucket, kind, direction, far in (("callers", "CALLS", "in", hops), ("callees", "CALLS", "out", hops), ("references", "REFERENCES", "in", hops), ("dependents", "IMPORTS", "in", 1), ("tests", "TESTS", "in", 1)):
        part = graph.bfs(edges, [node], far, direction, [kind]).select(F.lit(bucket).alias("bucket"), "node", "distance")
        out = part if out is None else out.unionByName(part)
    return out


def subgraph(edges: DataFrame, seeds: list[str], depth: int, types: list[str] | None = None) -> DataFrame:
    """The edges (of these types) among all nodes within ``depth`` of the seeds, either way."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    spark = edges.sparkSession
    reach = graph.bfs(e, seeds, depth, "both").select("node").unionByName(spark.createDataFrame([(x,) for x in seeds], "node string"))
    return graph.induced(e, reach)


def provenance(evidence: Column) -> Column:
    """framework, resolver, heuristic or parser, by what an edge's evidence says."""
    low = F.lower(evidence)
    return F.when(F.coalesce(low, F.lit("")) == "", "heuristic").when(low.rlike("route|framework"), "framework").when(low.contains("resolve"), "resolver").when(low.rlike("heuristic|naming"), "heuristic").otherwise("parser")


def with_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges with ``evidence``: an array of evidence(from_id, to_id, type, line, col), by line and column."""
    key = ["from_id", "to_id", "type"]
    return edges.join(evidence.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "col"))).alias("evidence")), key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<line:bigint,col:bigint>>")))


def explain_module(file_id: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """(section, item) of a file: its path, its symbols, what it imports and what imports it (each at most ``limit``)."""
    part = lambda df, name: df.select(F.lit(name).alias("section"), F.col("item"))
    path = files.select(F.col("id").alias("other"), F.col("path").alias("item"))
    i = edges.where("type = 'IMPORTS'")
    to = i.where(F.col("from_id") == file_id).select(F.col("to_id").alias("other")).distinct().join(path, "other").orderBy("item").limit(limit)
    back = i.where(F.col("to_id") == file_id).select(F.col("from_id").alias("other")).distinct().join(path, "other").orderBy("item").limit(limit)
    own = symbols.where(F.col("file_id") == file_id).select(F.concat_ws(":", "kind", "name", F.col("start_line").cast("string")).alias("item"))
    return part(path.where(F.col("other") == file_id), "file").unionByName(part(own, "symbol")).unionByName(part(to, "dependency")).unionByName(part(back, "dependent"))


def owners(symbols: DataFrame) -> DataFrame:
    """(item, owner): the smallest class or interface around each other symbol."""
    span = [F.col("start_line").alias("lo"), F.col("end_line").alias("hi")]
    top = F.col("kind").isin("class", "interface")
    return containment(symbols.where(~top).select(F.col("file_id").alias("file"), F.col("id").alias("item"), *span), symbols.where(top).select(F.col("file_id").alias("file"), F.col("id").alias("owner"), *span)).select("item", "owner")
