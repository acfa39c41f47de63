"""Vectorised text kernels shared by the llm operators.

Every function works on one *block*: the UTF-8 bytes of several whole texts laid end to end in a
``uint8`` array plus an offsets array (``offs[i]:offs[i+1]`` is text i).  Words never cross a text
boundary.  A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; as those are ASCII, byte
runs and character runs are the same.  Blocks come from :func:`blocks`, which slices an Arrow column
so that a task holds a few megabytes of numpy state whatever the batch size; a text larger than the
block limit forms a block by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_ROWS = 512
_SEGMENT = 1 << 20
_MASK64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    pow = _powers(_P, 1 << 12)
    inv = _powers(_PINV, 1 << 12)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.pow) < n:
            size = 1 << int(n - 1).bit_length()
            cls.pow, cls.inv = _powers(_P, size), _powers(_PINV, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix form): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, row after the last, bytes, offsets)`` over a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        at = 0
        for chunk in column.chunks:
            for i, j, buf, offs in blocks(chunk, limit):
                yield at + i, at + j, buf, offs
            at += len(chunk)
        return
    for at in range(0, len(column), _ROWS):
        part = column.slice(at, _ROWS)
        if part.null_count:
            part = part.fill_null("")
        n = len(part)
        wide = pa.types.is_large_string(part.type)
        _, raw_offs, raw = part.buffers()
        offs = np.frombuffer(raw_offs, dtype=np.int64 if wide else np.int32)[part.offset : part.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1))
            yield at + i, at + j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[buf]


def spans(is_gap: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-gap bytes inside each text: start, end (exclusive), text index."""
    n = len(is_gap)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, dtype=bool)
    first[offs[:-1]] = True
    first[n] = True
    full = ~is_gap
    begin = full.copy()
    begin[1:] &= is_gap[:-1] | first[1:n]
    finish = full.copy()
    finish[:-1] &= is_gap[1:] | first[1:n]
    s = np.flatnonzero(begin)
    e = np.flatnonzero(finish) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(_SPACE[buf], offs)


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte span (a function of the bytes alone).  Spans sorted by start."""
    out = np.empty(len(s), dtype=np.uint64)
    i, n = 0, len(s)
    while i < n:
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(s, base + _SEGMENT, side="left")))
        top = int(e[i:j].max())
        if top - base > 8 * _SEGMENT:  # a giant span: hash it on its own, in constant memory
            for k in range(i, j):
                out[k] = int.from_bytes(hashlib.blake2b(buf[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little") if e[k] - s[k] > _SEGMENT else span_hash(buf[s[k] : e[k]], np.zeros(1, np.int64), np.array([e[k] - s[k]]))[0]
            i = j
            continue
        m = top - base
        _Tables.upto(m + 1)
        acc = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[buf[base:top]] * _Tables.pow[:m], out=acc[1:])
        a, b = s[i:j] - base, e[i:j] - base
        out[i:j] = mix((acc[b] - acc[a]) * _Tables.inv[a] + (b - a).astype(np.uint64))
        long = np.flatnonzero(b - a > _SEGMENT)
        for k in long:
            out[i + k] = int.from_bytes(hashlib.blake2b(buf[s[i + k] : e[i + k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return out


def word_counts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs).astype(np.int64)


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words inside one text, and the index of its first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        acc *= np.uint64(_P)
        acc += h[k : k + n]
    return mix(acc[first] + np.uint64(width)), first


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, sorted by (text, hash): hashes and offsets per text.

    A text with fewer than ``width`` words gives its whole word sequence as one shingle; a text
    without words gives none.
    """
    n_docs = len(offs) - 1
    low = lower(buf)
    s, e, doc = words(low, offs)
    h = span_hash(low, s, e)
    wh, first = windows(h, doc, width)
    wdoc = doc[first]
    n_words = word_counts(doc, n_docs)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(n_words)))
        extra = np.array([_sequence(h[begin[d] : begin[d + 1]]) for d in short], dtype=np.uint64)
        wh, wdoc = np.concatenate((wh, extra)), np.concatenate((wdoc, short))
    order = np.lexsort((wh, wdoc))
    wh, wdoc = wh[order], wdoc[order]
    keep = np.ones(len(wh), dtype=bool)
    keep[1:] = (wh[1:] != wh[:-1]) | (wdoc[1:] != wdoc[:-1])
    wh, wdoc = wh[keep], wdoc[keep]
    return wh, np.concatenate(([0], np.cumsum(np.bincount(wdoc, minlength=n_docs)))).astype(np.int64)


def _sequence(h: np.ndarray) -> int:
    acc = len(h)
    for x in h.tolist():
        acc = (acc * _P + x) & _MASK64
    return int(mix(np.array([acc], dtype=np.uint64))[0])
