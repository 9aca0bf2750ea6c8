"""Vectorised text kernels over chunks of documents: bytes, words, rolling hashes, per-document sums.

A chunk is one byte buffer of several whole texts with their offsets; it holds about CHUNK bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64
#: Word separators: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.Philox(20240501))
#: Random value of a byte, and the odd base of the polynomial with its inverse modulo 2^64.
BYTE_VALUE = _rng.integers(1 << 63, size=256, dtype=np.int64).astype(U64) << U64(1) | U64(1)
BASE = (int(_rng.integers(1 << 62)) << 3 | 5) % (1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling; kept for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK + 4096), U64)
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        if len(out) <= 4 * CHUNK:
            _powers[base] = out
        have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """prefix[i] is the polynomial hash of the first i bytes."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUE[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


INVERSE = pow(BASE, -1, 1 << 64)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: equal bytes have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start] + (end - start).astype(U64))


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a batch, a null text being empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of its document."""
    n = len(buf)
    word = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; empty segments sum to 0."""
    if not len(values):
        return np.zeros(len(off) - 1, values.dtype)
    total = np.add.reduceat(np.append(values, values.dtype.type(0)), off[:-1])
    total[off[:-1] == off[1:]] = 0
    return total


def segment_count(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true values in each segment."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a UTF-8 buffer as numbers, and the offsets of the documents in them."""
    lead = (buf & 0xC0) != 0x80
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return chars, before[off]


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, value) without repeats, sorted by doc, then value."""
    if not len(doc):
        return doc, value
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n documents in an array sorted by document."""
    return np.searchsorted(doc, np.arange(n + 1))
