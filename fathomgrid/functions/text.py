"""Scalar text functions as Column expressions: ids, words, token estimates, globs, intents."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"
#: Characters that count as CJK for the token estimate: ideographs, kana, hangul.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
#: Characters beyond the first plane: two units of length each.
WIDE = r"[\x{10000}-\x{10ffff}]"


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, eight hex digits."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw) - 3, F.lit(4))).otherwise(F.array().cast("array<int>"))
    values = F.transform(units, lambda k: F.conv(F.substr(raw, k, F.lit(4)), 16, 10).cast("long"))
    h = F.aggregate(values, F.lit(2166136261), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def generate_id(*parts: Column) -> Column:
    """16 hex digits for the parts joined by ``::``."""
    whole = F.concat_ws("::", *parts)
    return F.concat(fnv1a(whole), fnv1a(F.concat(fnv1a(whole), F.lit(":"), whole)))


def token_estimate(text: Column) -> Column:
    """``ceil(cjk / 1.5) + ceil(other / 3.5)``; empty: 0."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(CJK))
    return (F.ceil(cjk / 1.5) + F.ceil((F.length(t) + F.regexp_count(t, F.lit(WIDE)) - cjk) / 3.5)).cast("long")


def normalize_words(text: Column) -> Column:
    """camelCase and path marks split, other marks dropped, lower case, single spaces."""
    t = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"[_\-./\\]+", " "), "[^A-Za-z0-9 ]", "")
    return F.trim(F.regexp_replace(F.lower(t), " +", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def glob_regex(pattern: str) -> str:
    """``**`` any path, ``*`` within a folder, ``?`` one character; case-insensitive."""
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", pattern))
    return f"(?i)^{out}$"


# Intents and their hints, in order; the first rule with a hint in the text wins.
INTENTS = (
    ("debug", ("debug", "bug", "error", "fix", "failing", "failure", "stack trace", "why")),
    ("refactor", ("refactor", "rename", "move", "extract", "split", "without breaking")),
    ("add_test", ("add test", "regression", "coverage", "spec", "unit test", "integration test")),
    ("route", ("route", "handler", "endpoint", "/api/", "post ", "get ", "put ", "delete ")),
    ("explain", ("explain", "how", "what does", "walkthrough", "architecture")),
    ("security", ("security", "permission", "token", "secret", "auth bypass", "jwt")),
)
# Direction and edge types by intent.
PROFILES = {
    "debug": ("both", ("CALLS", "REFERENCES", "IMPORTS", "CONFIGURES", "ROUTE_REFERENCES")),
    "refactor": ("in", ("REFERENCES", "CALLS", "IMPORTS", "TESTS")),
    "add_test": ("both", ("CALLS", "IMPORTS", "TESTS")),
    "explain": ("out", ("CONTAINS", "IMPORTS", "EXPORTS_TO")),
    "route": ("both", ("ROUTE_ENDPOINT", "ROUTE_REFERENCES", "REFERENCES", "CALLS")),
    "security": ("both", ("CALLS", "REFERENCES", "IMPORTS", "CONFIGURES")),
}
ADD_TEST = r"(?is)\badd\b.*\btests?\b"
# Patterns of risky names, in order.
RISKS = ("auth", "password", "secret", "token", "crypto", "encrypt", "permission", "security", "middleware", "guard", "interceptor")
# Extensions by language.
LANGUAGES = {
    "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py", "pyi", "pyw"), "go": ("go",), "rust": ("rs",), "java": ("java",),
    "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc", "cxx", "hxx"), "csharp": ("cs",), "ruby": ("rb", "rake"), "php": ("php",), "swift": ("swift",), "kotlin": ("kt", "kts"),
}
# Rules of a file's role, in order.
ROLES = (
    ("generated", r"(?i)\.generated?\.|(?:^|/)(?:generated|auto-generated)/"),
    ("generated", r"\.gen\."),
    ("test", r"\.test\.[jt]sx?$|\.spec\.[jt]sx?$|\.test\.py$|_test\.go$|_test\.rs$|Test\.cs$|_test\.java$|__tests__/"),
    ("test", r"(?i)tests?/|spec/"),
    ("config", r"\.json$|\.yaml$|\.yml$|\.toml$|\.ini$|\.env|^\.editorconfig$|^\.eslintrc|^\.prettierrc|^tsconfig|^jsconfig|^webpack\.config|^vite\.config|^rollup\.config|^jest\.config|^vitest\.config|^Dockerfile|^docker-compose|^Makefile$|^Cargo\.toml$|^go\.mod$|^pyproject\.toml$|^setup\.(cfg|py)$|^requirements\.txt$"),
    ("doc", r"\.md$|\.rst$|\.adoc$|\.txt$"),
    ("doc", r"(?i)^README|^CHANGELOG|^CONTRIBUTING|^LICENSE|^CODE_OF_CONDUCT|^ADR"),
    ("asset", r"(?i)\.(png|jpe?g|gif|svg|ico|webp|bmp|tiff?|avif|woff2?|ttf|eot|otf|mp3|mp4|wav|ogg|flac|webm|zip|tar|gz|rar|7z|pdf|docx?|xlsx?|pptx?)$"),
    ("lock", r"(?i)\.lock$|(?:^|/)(?:package-lock|yarn\.lock|pnpm-lock)\b"),
)
# Files that tests and stand-ins are in.
LOW_VALUE = r"\.(test|spec)\.[^./]+$|(^|/)__tests__/|(^|/)__mocks__/|(^|/)(mock|fixture|stub)([-./]|$)"
# Names and name patterns that are ignored by default.
IGNORED = (
    "node_modules", "dist", "build", "out", ".git", ".svn", ".hg", "coverage", "__pycache__", ".venv", "venv", ".env", ".tox", "target", "bin", "obj", "*.lock", "*.min.js", "*.min.css",
    "*.gen.ts", "*.gen.js", "*.pb.go", "*.pyc", "*.pyo", "*.so", "*.dll", "*.dylib", "*.exe", "*.wasm", ".DS_Store", "Thumbs.db",
)
# Words of paths that say nothing of what a test tests.
PATH_STOP = ("src", "lib", "test", "tests", "__tests__", "spec", "e2e", "unit", "module", "index", "js", "jsx", "ts", "tsx", "py")
# Largest budgets of the context levels L0 to L4.
LEVELS = (500, 1500, 3000, 6000, 12000)
# Nodes below which a tier holds, and its output characters, files, characters a file, whether low-value files go, whether relations come.
TIERS = (("tiny", 500, 13000, 4, 3800, True, False), ("small", 2000, 18000, 5, 3800, True, False), ("medium", 10000, 28000, 10, 6500, False, True), ("large", 50000, 35000, 12, 7000, False, True), ("huge", None, 38000, 14, 7000, False, True))


def _first(rules, otherwise: Column) -> Column:
    """The value of the first (value, condition) that holds."""
    out = otherwise
    for value, condition in reversed(list(rules)):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def intent(text: Column) -> Column:
    """The intent of a query; ``general`` without a hint."""
    low = F.lower(text)

    def hit(name: str, hints: tuple[str, ...]) -> Column:
        out = text.rlike(ADD_TEST) if name == "add_test" else F.lit(False)
        for h in hints:
            out = out | F.contains(low, F.lit(h))
        return out

    return _first(((name, hit(name, hints)) for name, hints in INTENTS), F.lit("general"))


def risk_of(text: Column) -> Column:
    """The first risky pattern in the text, else ``none``."""
    return _first(((r, F.contains(F.lower(text), F.lit(r))) for r in RISKS), F.lit("none"))


def language_of(path: Column) -> Column:
    """Language by extension, else ``unknown``."""
    pairs = [F.lit(x) for language, every in LANGUAGES.items() for e in every for x in (e, language)]
    return F.coalesce(F.create_map(*pairs)[F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)], F.lit("unknown"))


def role_of(path: Column) -> Column:
    """generated, test, config, doc, asset, lock or source, by the first rule that holds."""
    return _first(((role, path.rlike(rule)) for role, rule in ROLES), F.when(language_of(path) == "unknown", "asset").otherwise("source"))


def low_value(path: Column) -> Column:
    return F.lower(path).rlike(LOW_VALUE)


def ignored(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a name or pattern of ``IGNORED`` or ``more`` (lines of an ignore file) rules a path out.

    A pattern with an inner slash holds from the root, any other for a name anywhere; a trailing slash
    means folders; ``!`` takes a path in again; later patterns win.
    """
    out = F.lit(False)
    for line in (*IGNORED, *more):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        take, line = not line.startswith("!"), line.lstrip("!")
        folder, inner = line.endswith("/"), line.strip("/")
        body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", inner))
        rule = ("^" if "/" in inner or line.startswith("/") else "(^|/)") + body + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(rule), F.lit(take)).otherwise(out)
    return out


def external(specifier: Column, folded: bool = True) -> Column:
    """The package an import names, null for a relative one; ``folded``: ``@scope/pkg/x`` to ``@scope/pkg``,
    ``pkg/x`` to ``pkg``; else only specifiers that start with a letter count, whole."""
    if not folded:
        return F.when(specifier.rlike("^[A-Za-z]"), specifier)
    parts = F.split(specifier, "/")
    return F.when(specifier.rlike("^[^./]"), F.when(F.startswith(specifier, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0]))


def path_tokens(path: Column) -> Column:
    """Distinct words of a path: no plural s, longer than two letters, none of ``PATH_STOP``."""
    words = F.transform(F.split(F.lower(path), "[^a-z0-9]+"), lambda w: F.regexp_replace(w, "s$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*PATH_STOP)))


def context_level(budget: Column, most: str = "L5") -> Column:
    """L0 to L5 by token budget, at most ``most``."""
    return F.least(_first(((f"L{k}", budget <= x) for k, x in enumerate(LEVELS)), F.lit("L5")), F.lit(most))


def tier(nodes: Column) -> Column:
    """The budget tier of an index of so many nodes, with its five parameters."""
    out = None
    for name, below, chars, files, each, low, relations in reversed(TIERS):
        row = F.struct(F.lit(name).alias("tier"), F.lit(chars).alias("max_output_chars"), F.lit(files).alias("max_files"), F.lit(each).alias("max_chars_per_file"), F.lit(low).alias("exclude_low_value"), F.lit(relations).alias("relationships"))
        out = row if out is None else F.when(nodes < below, row).otherwise(out)
    return out


def cut_output(text: Column, most: int) -> Column:
    """At most ``most`` characters, and how many more there were."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n\n... (truncated, "), (F.length(text) - most).cast("string"), F.lit(" more chars)...")))
