"""Tokenizing whole texts with the tokenizers library, many at a time.

A tokenizer splits a text into pieces and merges inside each piece, so a piece has the same ids
wherever it stands.  The pieces of all texts of a batch are found at once, on their bytes; equal pieces
collapse, and the library's own merging model is asked once for each new one.  Texts with characters
whose treatment is not plain (unassigned in old Unicode, controls, what normalization changes) and
texts that may hold special tokens go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of pieces and ids that a worker keeps between batches; a longer piece is never kept.
CACHE, LONGEST = 48 << 20, 64
#: Characters of a text handled at a time.
PART = 1 << 20
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSAFE = range(5)
_CONTRACTIONS = {b"s": 2, b"t": 2, b"m": 2, b"d": 2, b"re": 3, b"ve": 3, b"ll": 3}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = re.compile("(?<=[a-z]) (?=[a-z])")

_KEPT: dict[int, Encoder] = {}


@functools.cache
def classes(words: bool) -> np.ndarray:
    """Class of each code point below 65,536 for the pieces; ``words``: for texts that are normalized."""
    out, old = np.full(1 << 16, _UNSAFE, np.uint8), unicodedata.ucd_3_2_0
    for c in [9, 10, 11, 12, 13, *range(32, 127), *range(0xA0, 0xD800), *range(0xF900, 0xFFF0)]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if c < 32:
            out[c] = _SPACE
        elif kind != old.category(ch) or kind[0] == "C":
            continue
        elif words and (kind[0] == "M" or c == 0x3C2 or unicodedata.normalize("NFC", ch) != ch or 0x1100 <= c < 0x1200):
            continue
        else:
            out[c] = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}.get(kind[0], _OTHER)
    return out


def _shown() -> list[str]:
    """The character by which byte-level vocabularies show each byte."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of whole texts."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_str(spec)
        j = json.loads(spec)
        pre, norm, model = j.get("pre_tokenizer") or {}, j.get("normalizer"), j.get("model") or {}
        self.words = self.plain = False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.plain = True
        elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and (pre.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex") == _WORD_PATTERN:
            self.plain = self.words = True
        self.plain &= model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        self.special = [x["content"] for x in j.get("added_tokens") or []]
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.shown = dict(enumerate(_shown()))
        vocab, end = model.get("vocab") or {}, model.get("end_of_word_suffix")
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.ends, self.size = np.zeros(size, bool), np.zeros(size, np.int64)
        for token, k in vocab.items() if isinstance(vocab, dict) else ():
            self.ends[k], self.size[k] = bool(end) and token.endswith(end), len(token)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.kept = self.pieces = 0

    @property
    def width(self) -> int:
        """Bytes that hold any id."""
        return 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else 4

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Number of the first of these pieces."""
        n, k = self.used + len(ids), self.pieces + len(counts)
        while n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : n] = ids
        self.start[self.pieces : k] = self.used + np.cumsum(counts) - counts
        self.count[self.pieces : k] = counts
        at, self.used, self.pieces = self.pieces, n, k
        return at

    def _learn(self, new: list[bytes]) -> list[int]:
        """Numbers of these pieces, asked of the library."""
        out = []
        for lo in range(0, len(new), 8192):
            each = new[lo : lo + 8192]
            ids = np.asarray(self.bare.encode("\n".join([p.decode("latin-1").translate(self.shown) for p in each]), add_special_tokens=False).ids, np.int64)
            if self.words:
                last = np.flatnonzero(self.ends[ids])
            else:
                last = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p) for p in each]))
            if len(last) != len(each):
                raise ValueError("pieces and ids do not agree")
            at = self._add(ids, np.diff(np.concatenate([[-1], last])))
            out += range(at, at + len(each))
        return out

    def _classes(self, a: np.ndarray) -> np.ndarray:
        """The class of every byte's character."""
        table = classes(self.words)
        cls = table[:128].take(a, mode="clip")
        high = np.flatnonzero(a >= 0x80)
        if len(high):
            b = a[high].astype(np.int64)
            lead, b = high[b >= 0xC0], b[b >= 0xC0]
            one, two = (a[np.minimum(lead + k, len(a) - 1)].astype(np.int64) & 63 for k in (1, 2))
            point = np.where(b < 0xE0, (b & 31) << 6 | one, (b & 15) << 12 | one << 6 | two)
            kind = np.where(b < 0xF0, table[point & 0xFFFF], _UNSAFE).astype(np.uint8)
            cls[lead] = kind
            for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
                cls[lead[b >= least] + k] = kind[b >= least]
        return cls

    def _bounds(self, a: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each piece, and which of these are spaces that the tokenizer drops; ``starts``: of the texts."""
        n = len(a)
        new, begins = np.empty(n, bool), np.zeros(n, bool)
        begins[starts] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:])
        new[starts] = True
        # contractions: an apostrophe alone, where a piece begins
        mark = np.flatnonzero((a[:-1] == 39) & new[:-1] & new[1:] & (cls[1:] == _LETTER) & ~begins[1:])
        if not self.words:
            mark = mark[begins[mark] | (a[np.maximum(mark - 1, 0)] != 32)]
        ends = np.append(starts[1:], n)[np.searchsorted(starts, mark, "right") - 1]
        for m, end in zip(mark.tolist(), ends.tolist()):
            for size in (2, 3):
                if _CONTRACTIONS.get(a[m + 1 : min(m + size, end)].tobytes()) == size:
                    new[m + 1] = False
                    if m + size < end:
                        new[m + size] = True
                    break
        if self.words:
            new |= (cls == _NUMBER) & ((a & 0xC0) != 0x80)
            first = np.flatnonzero(new)
            return first, cls[first] == _SPACE
        # the last space before other characters begins their piece, or is one if it is no plain space
        first = np.flatnonzero(new)
        after = first[1:][(cls[first[:-1]] == _SPACE) & ~begins[first[1:]]]
        space = after - 1
        for _ in range(2):
            space = np.where((a[space] & 0xC0) == 0x80, space - 1, space)
        new[after[a[space] == 32]] = False
        new[space] = True
        first = np.flatnonzero(new)
        return first, np.zeros(len(first), bool)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null texts count as empty."""
        if CACHE < self.kept + 4 * self.used + 120 * self.pieces:
            self._clear()
        odd = {k for k, t in enumerate(texts) if t and (not self.plain or any(s in t for s in self.special))}
        while True:
            parts = [(k, (p.lower() if self.words else p).encode("utf-8", "replace")) for k, t in enumerate(texts) if t and k not in odd for p in _parts(t)]
            if not parts:
                ids, each = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
                break
            size = np.array([len(p) for _, p in parts])
            starts, blob = np.cumsum(size) - size, b"".join([p for _, p in parts])
            a = np.frombuffer(blob, np.uint8)
            cls = self._classes(a)
            unsafe = np.flatnonzero(cls == _UNSAFE)
            if not len(unsafe):
                ids, counts = self._ids(blob, a, cls, starts)
                each = np.bincount([k for k, _ in parts], weights=counts, minlength=len(texts)).astype(np.int64)
                break
            odd.update(parts[k][0] for k in np.unique(np.searchsorted(starts, unsafe, "right") - 1).tolist())
        if odd:
            own = np.split(ids, np.cumsum(each)[:-1])
            for k in odd:
                own[k] = np.asarray(self.tok.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                each[k] = len(own[k])
            ids = np.concatenate(own)
        return ids, each

    def _ids(self, blob: bytes, a: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that are plain throughout."""
        first, drop = self._bounds(a, cls, starts)
        bounds = np.append(first, len(blob)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(blob)])
        if drop.any():
            pieces, first = pieces.filter(pa.array(~drop)), first[~drop]
        coded = pieces.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        number = list(map(self.known.get, unique))
        if missing := [k for k, x in enumerate(number) if x is None]:
            for k, x in zip(missing, self._learn([unique[k] for k in missing])):
                number[k] = x
                if len(unique[k]) <= LONGEST:
                    self.known[unique[k]] = x
                    self.kept += len(unique[k])
        number = np.array(number, np.int64)[coded.indices.to_numpy()]
        count = self.count[number]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[number] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(first, np.append(starts, len(blob)))])


def _parts(text: str) -> Iterator[str]:
    """The text, cut between plain words if it is very long: a piece ends there whatever stands around."""
    at = 0
    while len(text) - at > PART and (m := _CUT.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def as_binary(ids: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """A binary value for each text: its ids as little-endian integers of ``width`` bytes."""
    bounds = np.concatenate([[0], np.cumsum(counts) * width])
    data = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
    if bounds[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), data])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), data]).cast(pa.binary())


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def encoder(spec: str) -> Encoder:
    """The worker's encoder for this tokenizer file's content."""
    key = hash(spec)
    if key not in _KEPT:
        _KEPT.clear()  # one tokenizer's pieces at a time
        _KEPT[key] = Encoder(spec)
    return _KEPT[key]


def load(path: str) -> str:
    """The tokenizer file's content, which goes to the executors with the code (some MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
