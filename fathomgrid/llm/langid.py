"""Language identification with spans.

The script of a word's letters narrows the languages it may be in; each of them scores the word by its
character n-grams.  Viterbi with a switching penalty over the words then labels spans, so that a mixed
text keeps its parts and a foreign-looking word in a text does not.  Where no stretch of words speaks
for another language by more than the penalty, one label is optimal and the search is not run.

The words of a batch are found at once on its code points, and equal ones are scored once.  N-grams
are counted in a table of hashed slots whose size is bounded whatever the number of languages.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Labelled documents that are learned from (those with the smallest hashes of doc_id); n-grams; penalty in nats.
LABELLED, GRAMS, PENALTY = 6_000, 4, 12.0
#: Numbers that the model holds at most, over all languages; slots of a language at most.
NUMBERS, SLOTS = 1 << 23, 1 << 20
#: Characters handled at a time.
PART = 1 << 20
#: First code points of script ranges.
_FROM = [0x41, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3400, 0xAC00, 0xD7B0]
_SCRIPT = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "indic", "thai", "georgian", "hangul", "latin", "greek", "other", "kana", "han", "hangul", "other"]
_NAMES = sorted(set(_SCRIPT))
_OF = np.array([_NAMES.index(x) for x in _SCRIPT])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def scripts(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point."""
    return _OF[np.maximum(0, np.searchsorted(_FROM, points, "right") - 1)]


@functools.cache
def _kinds() -> np.ndarray:
    """1 for a letter, 2 for white space, else 0, of every code point."""
    every = [chr(c) for c in range(0x110000)]
    return np.fromiter((1 if c.isalpha() else 2 if c.isspace() else 0 for c in every), np.uint8, len(every))


class Words:
    """The words with letters of some texts: ``unique`` code points, 0 after each word; ``code``: the
    word of each token; ``size``: letters of each word; ``tokens``: number of tokens of each text."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        a = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum([0, *(len(t) + 1 for t in lower)])[:-1]
        kind = _kinds()[a]
        at = np.flatnonzero(kind)
        a, letter = np.where(kind[at] == 1, a[at], 0).astype("<u4"), kind[at] == 1
        keep = letter.copy()  # and one separator after each run of letters
        keep[1:] |= letter[:-1]
        if len(a) and letter[-1]:
            a, keep, letter, at = np.append(a, np.uint32(0)).astype("<u4"), np.append(keep, True), np.append(letter, False), np.append(at, at[-1])
        a, at = a[keep], at[keep]
        ends = np.flatnonzero(a == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
        bounds = np.append(starts, len(a)).astype(np.int32) * np.int32(4)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(a.tobytes())]).dictionary_encode()
        data = coded.dictionary
        self.code = coded.indices.to_numpy()
        self.unique = np.frombuffer(b"".join(data.to_pylist()), "<u4")
        stop = np.flatnonzero(self.unique == 0)
        self.size = np.diff(np.concatenate([[-1], stop])) - 1
        self.tokens = np.diff(np.append(np.searchsorted(at[starts], begin), len(starts)))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the n-grams of every unique word, in the order of words for each length."""
        u = np.concatenate([np.zeros(1, np.uint64), self.unique.astype(np.uint64)])
        inside = u != 0
        word = np.concatenate([[0], np.repeat(np.arange(len(self.size)), self.size + 1)])
        word[:-1] = word[1:]  # a separator opens the word that follows
        out_w, out_h = [word[inside]], [_mixed(u[inside])]
        h, ok = u.copy(), np.ones(len(u), bool)
        out_w[0] = np.concatenate([[0], np.repeat(np.arange(len(self.size)), self.size + 1)])[inside]
        for n in range(2, GRAMS + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + u[n - 1 :]
            ok = np.ones(len(h), bool) if n == 2 else ok[:-1] & inside[n - 2 : len(u) - 1]
            out_w.append(word[: len(h)][ok]), out_h.append(_mixed(h[ok] + np.uint64(n * int(_ODD) & 0xFFFFFFFFFFFFFFFF)))
        return np.concatenate(out_w), np.concatenate(out_h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


class Model:
    """Log-probabilities of n-gram slots by language, and the scripts of each language.

    What a language has not seen gets one floor, the same for all; a language without n-grams is none.
    """

    def __init__(self, counts: dict[str, np.ndarray], letters: dict[str, np.ndarray]):
        self.langs = sorted(x for x in counts if counts[x].any())
        n = len(self.langs)
        slots = len(counts[self.langs[0]]) if n else 1
        seen = np.stack([counts[x] for x in self.langs], axis=1).astype(float) if n else np.zeros((slots, 0))
        total = seen.sum(axis=0)
        self.table = (np.log(seen / np.maximum(total, 1) + 0.1 / total.max(initial=1)) / GRAMS).astype(np.float32)
        self.ruled_out = np.zeros((len(_NAMES), n), np.float32)
        for s in range(len(_NAMES)):
            may = np.array([letters[x][s] >= 0.02 * letters[x].sum() and letters[x][s] > 0 for x in self.langs], bool)
            if may.any():
                self.ruled_out[s, ~may] = -100.0

    def score(self, words: Words) -> np.ndarray:
        """Scores of the unique words; a language that its script rules out is far behind."""
        of, h = words.grams()
        out = np.zeros((len(words.size), len(self.langs)))
        value = self.table[(h & np.uint64(len(self.table) - 1)).astype(np.int64)]
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(of, weights=value[:, j], minlength=len(out))
        first = words.unique[np.cumsum(words.size + 1) - words.size - 1] if len(out) else words.unique
        return out + self.ruled_out[scripts(first)]

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label of every word with letters, its letters, words of each text)."""
        tokens, rows, sizes = np.zeros(len(texts), np.int64), [], []
        for some in _groups(texts):
            w = Words([t for _, t in some])
            s = self.score(w)
            rows.append(s[w.code])
            sizes.append(w.size[w.code])
            np.add.at(tokens, [k for k, _ in some], w.tokens)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), tokens
        return best_labels(np.concatenate(rows), tokens), np.concatenate(sizes), tokens


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(number, text) in order, about ``PART`` characters at a time; longer texts in parts, cut at spaces."""
    some, size = [], 0
    for k, t in enumerate(texts):
        at, t = 0, t or ""
        while at < len(t):
            end = len(t) if len(t) - at <= PART else t.find(" ", at + PART)
            end = len(t) if end < 0 else end
            some.append((k, t[at:end]))
            size, at = size + end - at, end
            if size >= PART:
                yield some
                some, size = [], 0
    if some:
        yield some


def best_labels(s: np.ndarray, tokens: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """:func:`viterbi` of every text, the texts being runs of ``tokens`` rows."""
    out = np.zeros(len(s), np.int64)
    tokens = tokens[tokens > 0]
    if not len(tokens):
        return out
    start = np.cumsum(tokens) - tokens
    one = np.add.reduceat(s, start, axis=0).argmax(axis=1)
    doc = np.repeat(np.arange(len(tokens)), tokens)
    out[:] = one[doc]
    gain = np.insert(s - s[np.arange(len(s)), out][:, None], start, 0.0, axis=0)
    begin = start + np.arange(len(start))  # with a row of zeros before each text
    gain = np.cumsum(gain, axis=0)
    long = np.append(tokens + 1, 0)[:-1]
    gain -= np.repeat(gain[begin], long, axis=0)
    gain -= np.repeat(np.arange(len(tokens)), long)[:, None] * (2 * np.abs(gain).max() + 1)  # the least so far starts anew with each text
    most = np.maximum.reduceat((gain - np.minimum.accumulate(gain, axis=0)).max(axis=1), begin)
    for k in np.flatnonzero(most > penalty).tolist():
        out[start[k] : start[k] + tokens[k]] = viterbi(s[start[k] : start[k] + tokens[k]], penalty)
    return out


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each row: sums of scores, less the penalty for every change."""
    if not len(s):
        return np.zeros(0, np.int64)
    one = int(s.sum(axis=0).argmax())
    gain = np.vstack([np.zeros(s.shape[1]), np.cumsum(s - s[:, [one]], axis=0)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(len(s), one)
    # a few labels: plain lists beat arrays; a label's jumps are kept by time, with where they came from
    rows = s.tolist()
    v, times, came = rows[0], [[] for _ in rows[0]], [[] for _ in rows[0]]
    for t in range(1, len(rows)):
        best = max(v)
        floor = best - penalty
        if min(v) < floor:
            top = v.index(best)
            for i, x in enumerate(v):
                if x < floor:
                    v[i] = floor
                    times[i].append(t)
                    came[i].append(top)
        v = [x + y for x, y in zip(v, rows[t])]
    out, end, i = np.empty(len(s), np.int64), len(s), v.index(max(v))
    while True:
        k = bisect.bisect_left(times[i], end) - 1
        t = times[i][k] if k >= 0 else 0
        out[t:end] = i
        if k < 0:
            return out
        end, i = t, came[i][k]


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang of the documents that may be learned from; at most ``LABELLED`` of them.

    Rows that repeat a doc_id are one document, with the smallest of its languages and that one's
    smallest text; null and empty texts teach nothing.
    """
    tune(docs.sparkSession)
    may = docs.where("lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    ids = may.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    sample = may.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).groupBy("doc_id").agg(F.min_by("text", "lang").alias("text"), F.min("lang").alias("lang"))
    langs = max(1, may.select("lang").distinct().count())
    slots = min(SLOTS, 1 << max(12, (NUMBERS // langs).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                n = total.setdefault(lang, np.zeros(slots + len(_NAMES), np.int64))
                for some in _groups(texts):
                    w = Words([t for _, t in some])
                    times = np.bincount(w.code, minlength=len(w.size))
                    of, h = w.grams()
                    np.add.at(n, (h & np.uint64(slots - 1)).astype(np.int64), times[of])
                    letter = w.unique != 0
                    n[slots:] += np.bincount(scripts(w.unique[letter]), weights=np.repeat(times, w.size), minlength=len(_NAMES)).astype(np.int64)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "slot", "n"])

    found = sample.select("lang", "text").repartition(8).mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most NUMBERS rows
    counts: dict[str, np.ndarray] = {}
    lang = found["lang"].combine_chunks().dictionary_encode() if len(found) else None
    for k, name in enumerate(lang.dictionary.to_pylist() if lang is not None else ()):
        at = np.flatnonzero(lang.indices.to_numpy() == k)
        n = counts[name] = np.zeros(slots + len(_NAMES), np.int64)
        n[found["slot"].to_numpy()[at]] = found["n"].to_numpy()[at]
    return Model({x: n[:slots] for x, n in counts.items()}, {x: n[slots:] for x, n in counts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans): the language of most letters, their share, and the spans
    (``lang``, ``first`` word and number of ``words``, counting words that have letters).

    A text that is null or has no letter is ``und`` with score 0 and no spans, as is every text where
    nothing was learned.  Repeated rows get equal results.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # NUMBERS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names, n = pa.array([*m.langs, "und"], pa.string()), len(m.langs)
        for b in batches:
            path, size, tokens = m.label(b.column(1).to_pylist()) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(b), np.int64))
            doc = np.repeat(np.arange(len(b)), tokens)
            share = np.bincount(doc * n + path, weights=size, minlength=len(b) * n).reshape(len(b), n) if n else np.zeros((len(b), 1))
            whole = share.sum(axis=1)
            pred = np.where(whole > 0, share.argmax(axis=1), n)
            score = share.max(axis=1) / np.maximum(whole, 1)
            # spans: where the label or the text changes
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(path) != 0) | (np.diff(doc) != 0)])) if len(path) else np.zeros(0, np.int64)
            first = edge - (np.cumsum(tokens) - tokens)[doc[edge]]
            spans = pa.StructArray.from_arrays([names.take(pa.array(path[edge])), pa.array(first), pa.array(np.diff(np.append(edge, len(path))))], ["lang", "first", "words"])
            upto = np.searchsorted(doc[edge], np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(pred)), pa.array(score), pa.ListArray.from_arrays(pa.array(upto), spans)], ["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,first:bigint,words:bigint>>")


def language_documents(docs: DataFrame) -> DataFrame:
    """The contract's digest, with the spans."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")
