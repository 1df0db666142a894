"""Toxicity by noisy-channel deobfuscation.

A written word is taken as a noisy form of an intended one: letters turned into look-alike digits and
signs, letters repeated, letters set apart by spaces or marks.  Each suspicious word spans a lattice
of readings; Viterbi decoding under a character trigram model of the whole corpus picks the likeliest.
Restored words are then scored by what labelled documents say of the word and of its beginnings.

The character model is counted over every document: its counts grow with the corpus, its size is
bounded by its alphabet (64 cubed).  The classifier is fitted on at most ``LABELLED`` labelled rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

#: Labelled rows that the classifier is fitted on (those with the smallest hashes of doc_id).
LABELLED = 30_000
#: Documents a feature must be toxic in at least, its least log-likelihood ratio, and its least evidence in
#: logarithms of the number n of features tried: at 1.4 the chance of any false one is about n ** -0.4.
SEEN, RATIO, SURE = 2, 2.0, 1.4
#: Largest log-odds of a text that says nothing toxic: it is never rejected, however many labels are toxic.
SILENT = -0.1
#: Letters and signs of a token that may be part of a word set apart by spaces: two parts of a word of
#: five letters are always this short.
SHORT = 4
#: Words that a worker keeps, and letters of the longest of them: together some 50 MB.
CACHE, LONGEST = 150_000, 64

_OUTER = ".,;:!?\"'()[]{}<>*#%&|~`^=/\\-_“”‘’«»…"
_LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c"}
_JOINED = "\x01"
_REPEATED = re.compile(r"(.)\1")
#: Look-alikes that are no digits: at a word's edge they are letters or punctuation.  Marks are punctuation only.
_SIGNS = "".join(c for c in _LOOKS if not c.isalnum())
_MARKS = "".join(c for c in _OUTER if c not in _LOOKS)


class _Alphabet(dict):
    """Code points to one of 64 symbols: 0 end, 1-26 a-z, 27-59 the letters after ß, 60 any other letter."""

    def __missing__(self, c: int):
        ch = chr(c)
        v = c - 96 if 97 <= c <= 122 else c - 223 + 27 if 223 <= c <= 255 and c != 247 else 60 if ch.isalpha() else None
        self[c] = None if v is None else chr(v)
        return self[c]


_ALPHABET = _Alphabet()
_ALPHABET[0] = "\0"


def codes(word: str) -> list[int]:
    return [ord(c) for c in word.translate(_ALPHABET)]


def count_trigrams(words: dict[str, int]) -> np.ndarray:
    """Counts of the 64 cubed trigrams of these words, ends included."""
    if not words:
        return np.zeros(64**3, np.int64)
    plain = [w.translate(_ALPHABET) for w in words]
    x = np.frombuffer(("\0\0" + "\0\0".join(plain) + "\0").encode("latin-1"), np.uint8).astype(np.int64)
    weight = np.repeat(np.fromiter(words.values(), np.int64), [len(w) + 2 for w in plain])[: len(x) - 2]
    grams = x[:-2] * 4096 + x[1:-1] * 64 + x[2:]
    keep = (x[1:-1] != 0) | (x[2:] != 0)
    return np.bincount(grams[keep], weights=weight[keep], minlength=64**3).astype(np.int64)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of c after a and b, counted over all words of letters of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, np.int64)
        for b in batches:
            words: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                for w in (text or "").lower().split():
                    words[w] = words.get(w, 0) + 1
            total += _letters(words)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    n = np.zeros(64**3)
    got = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 64 ** 3 rows
    n[got["gram"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape(64, 64, 64)
    two = (n.sum(axis=0) + 0.5) / (n.sum(axis=0) + 0.5).sum(axis=1, keepdims=True)
    return np.log((n + 4 * two[None]) / (n.sum(axis=2, keepdims=True) + 4)).astype(np.float32)


def _letters(words: dict[str, int]) -> np.ndarray:
    plain: dict[str, int] = {}
    for w, n in words.items():
        w = w.strip(_OUTER)
        if w.isalpha():
            plain[w] = plain.get(w, 0) + n
    return count_trigrams(plain)


def decode(word: str, table: list[float], edges: bool = False) -> str:
    """Likeliest letters behind ``word``: Viterbi over its lattice, states being the last two letters.

    Single spaces part the tokens of a run: each is an arc that joins, or one that ends a word; joined
    tokens come out with ``_JOINED`` between them.  ``table``: the character model, flat.  Look-alike signs at the word's edges may also say nothing;
    with ``edges`` they say letters, as many as there are signs.
    """
    edge = set()
    for m in re.finditer(r"\S+", word):
        t = m[0]
        edge.update(range(m.start(), m.end() - len(t.lstrip(_SIGNS))), range(m.start() + len(t.rstrip(_SIGNS)), m.end()))
    best: dict = {0: (0.0, None)}
    k = 0
    while k < len(word):
        c, n = word[k], 1
        while k + n < len(word) and word[k + n] == c:
            n += 1
        after: dict = {}
        if c == " ":  # the word goes on, or ends and another begins
            for state, (cost, said) in best.items():
                for at, letters, total in ((state, _JOINED, cost + 0.5), (0, " ", cost - table[state * 64])):
                    if at not in after or total < after[at][0]:
                        after[at] = total, (said, letters)
            best, k = after, k + n
            continue
        arcs = _arcs(c, min(n, 3), (k in edge) and (2 if edges else 1))
        for state, (cost, said) in best.items():
            for letters, price, symbols in arcs:
                at, total = state, cost + price
                for x in symbols:
                    total -= table[at * 64 + x]
                    at = at % 64 * 64 + x
                if at not in after or total < after[at][0]:
                    after[at] = total, ((said, letters) if letters else said)
        best, k = after, k + n
    said = min(((cost - table[at * 64], k, said) for k, (at, (cost, said)) in enumerate(best.items())), key=lambda x: x[:2])[2]
    out = []
    while said:
        said, letters = said
        out.append(letters)
    return "".join(reversed(out))


@functools.cache
def _arcs(c: str, n: int, edge: int) -> list[tuple[str, float, list[int]]]:
    """(letters, price, their symbols) of ``c`` written ``n`` times, 3 standing for more.

    ``edge``: 1 for a sign that may also say nothing, 2 for one that is a letter each time.
    """
    if c.isalpha():
        arcs = [(c * m, 0.0 if m == n else 1.5) for m in ({1, 2} if n > 2 else {n, 1})]
    elif c in _LOOKS:
        arcs = [(x * m, 0.5) for x in _LOOKS[c] for m in ({n} if n <= 2 and edge == 2 else {1, n} if n <= 2 else {1, 2})]
        arcs += [("", 0.5)] if edge == 1 else []
    else:
        arcs = [("", 0.5)]
    return [(letters, price, codes(letters)) for letters, price in arcs]


class _Folded(dict):
    """Code points to the letter that stands for all their readings; what says nothing goes."""

    def __missing__(self, c: int):
        ch = chr(c)
        v = ch if ch.isalpha() or ch == " " else _LOOKS[ch][0] if ch in _LOOKS else None
        self[c] = None if v is None else {"l": "i", "g": "b"}.get(v, v)
        return self[c]


_FOLDED = _Folded()


def may_say(features: Iterable[str]):
    """A test of words and runs: false only if no decoding of the word has one of these features.

    Decoding changes how often a letter is repeated and which look-alike it is, so a feature can only
    come out where its letters, folded, stand in this order from the start of a token.
    """
    trie: dict = {}
    for f in features:
        at = trie
        for c in re.sub(r"(.)\1+", r"\1", f[1:].translate(_FOLDED)):
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at or not at:
            return ""  # shorter features settle it
        return "(?:" + "|".join(f"{re.escape(c)}[{re.escape(c)} ]*{pattern(x)}" for c, x in at.items()) + ")"

    if not trie:
        return lambda word: False
    if "" in trie:
        return lambda word: True
    found = re.compile("(?:^| )" + pattern(trie)).search

    def test(word: str) -> bool:
        if found(word.translate(_FOLDED)):
            return True
        if " " in word:
            return any(c in word for c in _SIGNS)  # signs may say nothing in the midst
        rest = word.lstrip(_SIGNS)
        signs = word[: len(word) - len(rest)]
        return len(set(signs)) > 1 or bool(signs and found(rest.translate(_FOLDED)))

    return test


def readings(word: str, table: list[float], may=None) -> list[str]:
    """What a lower-cased word of the text may say: its letters, and its decodings if it looks disguised.

    ``may``: a test of :func:`may_say`; decodings that it rules out are left out.
    """
    if " " in word:
        if may and not may(word):
            return []
        said = [decode(word, table)]
        if any(c in _SIGNS for c in word):
            said.append(decode(word, table, True))
        joined = {w.replace(_JOINED, ""): None for run in said for w in run.split(" ") if _JOINED in w.strip(_JOINED)}
        return list(dict.fromkeys(r for w in joined for r in readings(w, table, may)))
    inner = word.strip(_OUTER)
    plain = inner if inner.isalpha() else "".join(filter(str.isalpha, inner))
    out = [plain] if plain else []
    whole = word.strip(_MARKS)
    if whole and (len(plain) != len(whole) or _REPEATED.search(whole)) and (not may or may(whole)):
        out.append(decode(whole, table))
        if whole[0] in _SIGNS or whole[-1] in _SIGNS:
            out.append(decode(whole, table, True))
    return list(dict.fromkeys(filter(None, out)))


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in range(3, 1 + min(6, len(word))))]


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words, and the runs of two or more short ones, with single spaces."""
    tokens = (text or "").lower().split()
    words, run = set(tokens), []
    for t in tokens:
        if len(t) > SHORT:
            t = t.strip(_MARKS)
        if len(t) <= SHORT:
            t = t.strip(_MARKS)
            if t:
                run.append(t)
            continue
        if len(run) > 1:
            words.add(" ".join(run))
        run = []
    if len(run) > 1:
        words.add(" ".join(run))
    return words


def _folded_bytes() -> tuple[bytes, bytes]:
    """A translation of Latin-1 bytes of lower-cased text, and the bytes that it drops.

    A letter becomes the one that stands for all its readings, a look-alike that letter in upper case,
    white space a space, and what is beyond Latin-1 (``?`` by then) a star; the rest says nothing.
    """
    table, drop = bytearray(256), bytearray()
    for c in range(256):
        ch = chr(c)
        fold = lambda x: {"l": "i", "b": "g"}.get(x, x)
        if ch == "?":
            table[c] = ord("*")
        elif ch in _LOOKS:
            table[c] = ord(fold(_LOOKS[ch][0]).upper())
        elif ch.isspace():
            table[c] = 32
        elif ch.isalpha() and ch.lower() == ch:
            table[c] = ord(fold(ch))
        elif ch.isalpha():
            table[c] = ord("*")
        else:
            drop.append(c)
    return bytes(table), bytes(drop)


_FOLD, _DROP = _folded_bytes()


def folded(text: str) -> bytes:
    return text.encode("latin-1", "replace").translate(_FOLD, _DROP)


def may_hold(features: Iterable[str]):
    """The numbers of the tokens of a text at which a word or run may begin that has one of these features.

    Like :func:`may_say`, on all of a text's bytes at once: look-alikes and characters beyond Latin-1 may
    be any letter they stand for or nothing.  No other token begins one.
    """
    trie: dict = {}
    for f in features:
        at = trie
        for c in re.sub(rb"(.)\1+", rb"\1", folded(f[1:])).decode("latin-1"):
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at or not at:
            return ""
        return "(?:" + "|".join((f"[{re.escape(c)}{c.upper() if 'a' <= c <= 'z' else ''}*]" if c != "*" else "[*]") + f"[{re.escape(c)}A-Z* ]*{pattern(x)}" for c, x in at.items()) + ")"

    if not trie:
        return lambda tokens: []
    found = re.compile(("(?:^|(?<= ))(?=[A-Z* ]*" + pattern(trie) + ")").encode("latin-1")).finditer

    def places(tokens: list[str]) -> list[int]:
        raw, out, at, n = folded(" ".join(tokens)), [], 0, 0
        for m in found(raw):
            n += raw.count(b" ", at, m.start())
            at = m.start()
            out.append(n)
        return out

    return places


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.table, self.weights, self.cache = model.ravel().tolist(), weights, {}
        self.may, self.places = may_say(weights), may_hold(weights)

    def word(self, w: str) -> float:
        return max((self.weights.get(f, 0.0) for r in readings(w, self.table, self.may) for f in features(r)), default=0.0)

    def words(self, text: str | None) -> set[str]:
        """The words and runs of :func:`words_of` that may have a weight."""
        tokens = (text or "").lower().split()
        out, upto = set(), -1
        for k in self.places(tokens):
            out.add(tokens[k])
            if k <= upto or len(tokens[k].strip(_MARKS)) > SHORT:
                continue
            first = k  # the run around it
            while first and len(tokens[first - 1].strip(_MARKS)) <= SHORT:
                first -= 1
            upto = k
            while upto + 1 < len(tokens) and len(tokens[upto + 1].strip(_MARKS)) <= SHORT:
                upto += 1
            run = [t for t in (t.strip(_MARKS) for t in tokens[first : upto + 1]) if t]
            if len(run) > 1:
                out.add(" ".join(run))
        return out

    def text(self, text: str | None) -> tuple[float, float]:
        """Weight of the worst word, and the logarithm of one and the weights of the others together."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        top = rest = 0.0
        get = self.cache.get
        for w in self.words(text):
            x = get(w)
            if x is None:
                x = self.word(w)
                if len(w) <= LONGEST:
                    self.cache[w] = x
            if x > top:
                top, x = x, top
            rest += x
        return top, math.log1p(rest)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and weights; ridge-penalised Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame):
    """(character model, feature weights, logistic weights) from the rows whose label may be learned.

    Null labels and null doc_ids teach nothing; rows that repeat a doc_id count once, with the smallest
    of its texts and the largest of its labels; null and empty texts have no features; without labels of
    both kinds every text gets one score.  Of documents whose words have the same least hash (copies and
    most near copies) only one teaches, or their rare words would look like evidence.
    """
    spark = docs.sparkSession
    tune(spark)
    model = character_model(docs)
    may = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where("toxic is not null and doc_id is not null").where(may).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # LABELLED rows of two numbers
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    # copies and near copies say no more than one of them: they share the least hash of a word
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\s]+", "")
    words = F.transform(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 4), lambda w: F.xxhash64(w))
    sample = sample.groupBy("toxic", F.coalesce(F.array_min(words), F.xxhash64("doc_id")).alias("least")).agg(F.min_by("text", "doc_id").alias("text")).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, int], int] = {}
        table, read = model.ravel().tolist(), {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in n], pa.string()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["f", "y", "n"])
            n.clear()
            return out

        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = {""}
                if len(read) > CACHE:
                    read.clear()
                for w in words_of(text):
                    got = read.get(w)
                    if got is None:
                        got = readings(w, table)
                        if len(w) <= LONGEST:
                            read[w] = got
                    for r in got:
                        seen.update(features(r))
                for f in seen:
                    n[f, y] = n.get((f, y), 0) + 1
            if len(n) > CACHE:
                yield flush()
        yield flush()

    got = sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).mapInArrow(run, "f string, y int, n long")
    got = got.groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    got = got.where(f"f = '' or (bad >= {SEEN} and bad > good)").collect()  # bounded by the labelled rows
    bad, good = next(((r.bad, r.good) for r in got if r.f == ""), (0, 0))
    weights, evidence = {}, SURE * math.log(max(1, len(got)))
    for r in got:
        if r.f and bad and good:
            ratio = math.log((r.bad + 0.5) / (bad + 1)) - math.log((r.good + 0.5) / (good + 1))
            if ratio >= RATIO and r.bad * math.log((r.bad / (r.bad + r.good)) * (bad + good) / bad) >= evidence:
                weights[r.f] = ratio

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model, weights)
        for b in batches:
            x = [s.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([a for _, a in x], pa.float64())], ["y", "a", "b"])

    if not bad or not good:
        return model, weights, np.array([-4.0 if not bad else SILENT, 0.0, 0.0])
    p = sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).mapInArrow(points, "y int, a double, b double").toPandas()  # at most LABELLED rows
    line = fit_logistic(p[["a", "b"]].to_numpy(), p["y"].to_numpy(dtype=float))
    return model, weights, np.array([min(line[0], SILENT), *line[1:]])


def score(docs: DataFrame, fitted, keep: bool = False) -> DataFrame:
    """``docs`` with ``score`` (in the place of a column of that name); with ``keep``, only the columns
    and rows of documents below 0.5.

    Null, empty and blank texts have the score of a text without toxic words; repeated rows score alike.
    """
    model, weights, line = fitted
    tune(docs.sparkSession)
    if not keep:
        docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model, weights)
        for b in batches:
            x = np.array([s.text(t) for t in b.column(at).to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(line[0] + x @ line[1:], -30, 30)))
            if keep:
                yield b.filter(pa.array(p < 0.5))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "score"])

    schema = docs.schema if keep else T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest."""
    s = score(docs.select("doc_id", "text"), fit(docs, labels))
    return s.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic.

    Null, empty and blank texts say nothing toxic and stay; repeated rows stay or go together; an empty
    table gives no rows; other columns pass through, whatever their names.  A text without any weighted
    word stays, whatever the share of toxic labels.
    """
    return score(docs, fit(docs, labels), keep=True)
