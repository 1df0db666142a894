"""A static range asymmetric numeral system over token ids, many lanes at a time.

A *segment* holds whole documents in order: their ids and lengths, one shared frequency table, and
independent blocks.  A block interleaves up to ``LANES`` coder states over its ids (lane ``k`` has ids
``k, k + lanes, ...``), so numpy steps all lanes at once in both directions.  The block index is the
list of checkpoints: where a block starts in the payload and in the ids, its lanes, and checksums of
its bytes and of its ids; any block can be decoded alone.

Layout (little-endian): magic, header (7 x u32), crc32 of header and tables, tables (zlib), payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, BITS, LANES, BLOCK = b"FGR1", 18, 512, 1 << 17
_LOW, _MASK = np.uint64(1 << 31), np.uint64(0xFFFFFFFF)


class Damaged(ValueError):
    """A checksum or length of a file does not hold."""


def quantize(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to ``2 ** bits``, at least 1 where there is a count."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size // total), 0).astype(np.int64)
    gap = size - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if gap >= 0:
        f[order[0]] += gap
    k = 0
    while gap < 0:
        cut = min(-gap, max(0, int(f[order[k]]) // 2))
        f[order[k]] -= cut
        gap, k = gap + cut, (k + 1) % len(order)
    return f.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int = BITS) -> tuple[bytes, int]:
    """Payload and number of lanes."""
    lanes = int(max(1, min(LANES, len(ids) // 64)))
    s = np.pad(ids, (0, -len(ids) % lanes), mode="edge").reshape(-1, lanes)
    f, c = freq[s], cum[s]
    limit, b = f << np.uint64(63 - bits), np.uint64(bits)
    x, words = np.full(lanes, _LOW, np.uint64), []
    for t in range(len(s) - 1, -1, -1):
        over = x >= limit[t]
        if over.any():
            words.append((x[over] & _MASK).astype("<u4"))
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f[t]
        x = (q << b) + (x - q * f[t]) + c[t]
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words)), lanes


def decode_block(payload: bytes, n: int, lanes: int, freq: np.ndarray, cum: np.ndarray, symbol: np.ndarray, bits: int = BITS) -> np.ndarray:
    x = np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
    words, at = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.uint64), 0
    steps, b, mask = -(-n // lanes), np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.empty((steps, lanes), symbol.dtype)
    for t in range(steps):
        slot = x & mask
        s = symbol[slot]
        out[t] = s
        x = freq[s] * (x >> b) + slot - cum[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
    if at != len(words):
        raise Damaged("a block has words left over")
    return out.reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment's file bytes."""
    vocab = int(ids.max()) + 1 if len(ids) else 1
    freq = quantize(np.bincount(ids, minlength=vocab))
    cum = (np.cumsum(freq) - freq).astype(np.uint64)
    index, body, at = [], [], 0
    for k in range(0, len(ids), block):
        some = ids[k : k + block]
        data, lanes = encode_block(some, freq, cum)
        index.append((at, len(data), k, len(some), lanes, zlib.crc32(data), zlib.crc32(some.astype("<u4").tobytes())))
        body.append(data)
        at += len(data)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = zlib.compress(
        freq.astype("<u4").tobytes() + known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes() + np.array(index, "<u8").reshape(-1, 7).tobytes(), 6
    )
    head = struct.pack("<7I", BITS, vocab, len(doc_ids), len(index), len(table), len(ids) & 0xFFFFFFFF, len(ids) >> 32)
    return MAGIC + head + struct.pack("<I", zlib.crc32(head + table)) + table + b"".join(body)


def read_index(data: bytes) -> dict:
    """Everything but the payload: documents, frequencies and the blocks' checkpoints."""
    if data[:4] != MAGIC:
        raise Damaged("not a segment")
    bits, vocab, docs, blocks, size, low, high = struct.unpack_from("<7I", data, 4)
    table = data[36 : 36 + size]
    if zlib.crc32(data[4:32] + table) != struct.unpack_from("<I", data, 32)[0]:
        raise Damaged("the tables' checksum does not hold")
    raw, at, out = zlib.decompress(table), 0, {"bits": bits, "n": low | high << 32, "payload": 36 + size}
    for name, kind, n in (("freq", "<u4", vocab), ("known", "u1", docs), ("doc_ids", "<i8", docs), ("lengths", "<u4", docs), ("blocks", "<u8", 7 * blocks)):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    out["blocks"] = out["blocks"].reshape(-1, 7)
    return out


def read_blocks(data: bytes, index: dict, which: list[int] | None = None) -> np.ndarray:
    """Ids of these blocks (all of them by default), with every checksum verified."""
    freq = index["freq"].astype(np.uint64)
    cum, out = (np.cumsum(freq) - freq).astype(np.uint64), []
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), index["freq"])
    for k in range(len(index["blocks"])) if which is None else which:
        at, size, _, n, lanes, crc, ids_crc = (int(v) for v in index["blocks"][k])
        some = data[index["payload"] + at : index["payload"] + at + size]
        if len(some) != size or zlib.crc32(some) != crc:
            raise Damaged(f"block {k}: the payload's checksum does not hold")
        ids = decode_block(some, n, lanes, freq, cum, symbol, index["bits"])
        if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise Damaged(f"block {k}: the ids' checksum does not hold")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
