"""External induced suffix sorting with common-prefix values, for one shard of bytes.

The shard is a symbol array that ends in a unique smallest symbol 0.  A suffix is of type S if it is smaller than the
next suffix, else of type L; an S suffix after an L suffix is *leftmost* (LMS).  Induction sorts all suffixes from the sorted
leftmost ones in two passes: from the smallest symbol up, each sorted suffix ``i`` pushes ``i - 1`` if that is of type L;
from the largest symbol down, each pushes ``i - 1`` if that is of type S.  Pushes arrive in sorted order, so the priority
queue over (first symbol, arrival) is a set of first-in-first-out runs, one per symbol.  :class:`RunQueue` keeps these
runs as arrays and moves them to files of the shared folder when they outgrow its memory.

Every queued tuple carries the length of the common prefix with the tuple before it in its run, capped at ``depth``:
if two neighbours of a run were induced by suffixes between which the smallest carried value is v, it is 1 + v.

The leftmost suffixes are sorted by the same induction (which sorts leftmost substrings when it starts from an
arbitrary order), then named; the string of names is put in order by rank doubling, which ends as soon as ``depth``
symbols are covered: callers ask which suffixes share their first ``depth`` symbols, and the order beyond is not needed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs

CHUNK = 1 << 17


class RunQueue:
    """First-in-first-out runs of (position, common prefix), one per symbol; beyond ``memory`` bytes they go to a file of ``folder``."""

    def __init__(self, sigma: int, memory: int, folder: str):
        self.runs: list[list] = [[] for _ in range(sigma)]
        self.memory, self.held, self.folder = memory, 0, folder
        self.files: list = []

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[symbol].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """All that is held becomes one file."""
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        path, at = f"{base}/{uuid.uuid4().hex}", 0
        with fs.open_output_stream(path, compression=None) as out:
            for run in self.runs:
                for k, x in enumerate(run):
                    if len(x) == 2:
                        out.write(x[0].tobytes())
                        out.write(x[1].tobytes())
                        run[k] = (len(self.files), at, len(x[0]))
                        at += 5 * len(x[0])
        self.files.append((fs, path, fs.open_input_file(path)))
        self.held = 0

    def take(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Remove and return what is pending for a symbol, in order of arrival."""
        run, self.runs[symbol] = self.runs[symbol], []
        out = []
        for x in run:
            if len(x) == 3:
                file, at, n = x
                data = self.files[file][2].read_at(5 * n, at)
                x = (np.frombuffer(data, np.int32, n), np.frombuffer(data, np.uint8, n, 4 * n))
            else:
                self.held -= x[0].nbytes + x[1].nbytes
            out.append(x)
        return out

    def close(self) -> None:
        for fs, path, file in self.files:
            file.close()
            fs.delete_file(path)
        self.files = []


class _Induce:
    """Carries the smallest common prefix since each symbol's last push across the chunks of a pass."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, memory: int, folder: str):
        self.text, self.depth, self.carry = text, depth, depth > 0
        self.queue = RunQueue(sigma, memory, folder)
        self.low = np.full(sigma, 255, dtype=np.uint8)
        self.seen = np.zeros(sigma, dtype=bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray, accept) -> None:
        """Push the predecessors of the suffixes ``pos`` (in the order of the pass) that ``accept`` takes."""
        for at in range(0, len(pos), CHUNK):
            self._chunk(pos[at : at + CHUNK], lcp[at : at + CHUNK], accept)

    def _chunk(self, pos: np.ndarray, lcp: np.ndarray, accept) -> None:
        before = pos - 1
        c = self.text[before]  # text[-1] is the end symbol 0
        ok = accept(c) & (pos > 0)
        k = np.flatnonzero(ok)
        if not len(k):
            if self.carry:
                np.minimum(self.low, lcp.min(), out=self.low)
            return
        target = c[k]
        order = np.argsort(target, kind="stable")
        k, target = k[order], target[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        new, edge = before[k], np.append(first[1:], len(k))
        value = self._values(lcp, k, target, first) if self.carry else np.zeros(len(k), np.uint8)
        for a, b, s in zip(first.tolist(), edge.tolist(), target[first].tolist(), strict=True):
            self.queue.push(s, new[a:b], value[a:b])

    def _values(self, lcp: np.ndarray, k: np.ndarray, target: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The common prefix of each push (sources ``k`` of the chunk, grouped by target) with the push before it."""
        table = self._table(lcp)
        prev = np.concatenate(([-1], k[:-1]))
        prev[first] = -1
        value = _range_min(table, prev + 1, k)
        who = target[first]
        value[first] = np.minimum(value[first], self.low[who])
        value = np.minimum(value.astype(np.int64) + 1, self.depth).astype(np.uint8)
        value[first[~self.seen[who]]] = 0
        self.seen[who] = True
        last = np.append(first[1:], len(k)) - 1
        np.minimum(self.low, lcp.min(), out=self.low)
        tail = k[last] + 1
        open_ = tail < len(lcp)
        self.low[who] = 255
        self.low[who[open_]] = _range_min(table, tail[open_], np.full(open_.sum(), len(lcp) - 1))
        return value

    @staticmethod
    def _table(x: np.ndarray) -> list[np.ndarray]:
        out, w = [x], 1
        while 2 * w <= len(x):
            out.append(np.minimum(out[-1][: len(out[-1]) - w], out[-1][w:]))
            w *= 2
        return out


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def _range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo..hi] (inclusive) for each query; ``table`` as of :meth:`_Induce._table`."""
    out = np.empty(len(lo), dtype=np.uint8)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for v in np.unique(level).tolist():
        m = level == v
        t = table[v]
        out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << v) + 1])
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """Four symbols from each position in one 64-bit word (symbols are below 2**16; zeros follow the end)."""
    t = np.concatenate((text, np.zeros(3, text.dtype))).astype(np.uint64)
    n = len(text)
    return (t[:n] << np.uint64(48)) | (t[1 : n + 1] << np.uint64(32)) | (t[2 : n + 2] << np.uint64(16)) | t[3 : n + 3]


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffix pairs, capped at ``depth``, four symbols at a time."""
    out = np.zeros(len(a), dtype=np.int64)
    live, n = np.arange(len(a)), len(word)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) < n
        if not inside.all():
            live, x, y = live[inside], x[inside], y[inside]
        d = word[x] ^ word[y]
        out[live] += 4
        odd = np.flatnonzero(d)
        e = d[odd]
        out[live[odd]] -= 4 - ((e < (1 << 48)).astype(np.int64) + (e < (1 << 32)) + (e < (1 << 16)))
        live = live[d == 0]
        live = live[out[live] < depth]
    return np.minimum(out, depth)


def _seam(text: np.ndarray, a: int, b: int, depth: int) -> int:
    """Common prefix of the last L suffix and the first S suffix of a symbol: the shorter of their leading runs."""
    k, c = 0, text[a]
    while k < depth and text[a + k] == c == text[b + k]:
        k += 1
    return k


def _both_passes(text: np.ndarray, sigma: int, lms: np.ndarray, lms_lcp: np.ndarray, depth: int, memory: int, folder: str):
    """Induce from leftmost suffixes (in order, with common prefixes; none are carried if ``depth`` is 0); yields (positions, common prefixes) from the
    largest suffixes down: per symbol the S run (descending), then the L run (ascending, reversed by the caller)."""
    head = text[lms]
    begin = np.searchsorted(head, np.arange(sigma + 1))
    up = _Induce(text, sigma, depth, memory, folder)
    l_runs: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(sigma):
        pos_parts, lcp_parts = [], []
        while pending := up.queue.take(c):
            pos, lcp = _joined(pending)
            up.feed(pos, lcp, lambda x, c=c: x >= c)
            pos_parts.append(pos)
            lcp_parts.append(lcp)
        l_pos = np.concatenate(pos_parts) if pos_parts else np.zeros(0, np.int32)
        l_lcp = np.concatenate(lcp_parts) if lcp_parts else np.zeros(0, np.uint8)
        l_runs.append((l_pos, l_lcp))
        s, s_lcp = lms[begin[c] : begin[c + 1]], lms_lcp[begin[c] : begin[c + 1]].copy()
        if len(s):
            s_lcp[0] = _seam(text, int(l_pos[-1]), int(s[0]), depth) if len(l_pos) else 0
            up.feed(s, s_lcp, lambda x, c=c: x > c)
    up.queue.close()
    down = _Induce(text, sigma, depth, memory, folder)
    for c in range(sigma - 1, -1, -1):
        pos_parts, lcp_parts = [], []
        while pending := down.queue.take(c):
            pos, lcp = _joined(pending)
            down.feed(pos, lcp, lambda x, c=c: x <= c)
            pos_parts.append(pos)
            lcp_parts.append(lcp)
        s_pos = np.concatenate(pos_parts) if pos_parts else np.zeros(0, np.int32)
        s_lcp = np.concatenate(lcp_parts) if lcp_parts else np.zeros(0, np.uint8)
        l_pos, l_lcp = l_runs[c]
        l_runs[c] = None
        if c == 0:  # the end symbol
            l_pos, l_lcp = np.array([len(text) - 1], np.int32), np.zeros(1, np.uint8)
            s_pos, s_lcp = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        seam = _seam(text, int(s_pos[-1]), int(l_pos[-1]), depth) if len(s_pos) and len(l_pos) else 0
        if len(l_pos):
            turned = np.concatenate(([seam], l_lcp[:0:-1])).astype(np.uint8)
            down.feed(l_pos[::-1], turned, lambda x, c=c: x < c)
        yield c, l_pos, l_lcp, s_pos, s_lcp, seam
    down.queue.close()


def suffix_order(text: np.ndarray, sigma: int, depth: int, folder: str, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` (``uint16``, symbols < sigma, the last one 0 and unique) by its first ``depth`` symbols, and the common
    prefix (capped at ``depth``) of each suffix with the one before it.  ``folder`` takes what the queues spill."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    word = _words(text)
    differ = np.flatnonzero(text[:-1] != text[1:])
    nxt = differ[np.searchsorted(differ, np.arange(n - 1), side="left").clip(max=len(differ) - 1)]
    is_s = np.append(text[nxt] < text[nxt + 1], True)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)

    # leftmost substrings in order: induction from leftmost suffixes by first symbol alone
    start = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    parts = []
    for _, l_pos, _, s_pos, _, _ in _both_passes(text, sigma, start, np.zeros(len(start), np.uint8), 0, memory, folder):  # depth 0: order only
        s_pos = s_pos[is_lms[s_pos]]
        parts.append(s_pos)
        if len(l_pos) and l_pos[-1] == n - 1:
            parts.append(l_pos[-1:])
    order = np.concatenate(parts)[::-1]
    index = np.empty(n, dtype=np.int32)
    index[lms] = np.arange(len(lms), dtype=np.int32)
    end = np.append(lms[1:], n - 1)
    length = (end - lms + 1).astype(np.int64)
    o = index[order]
    same = np.zeros(len(o), dtype=bool)
    if len(o) > 1:
        a, b = o[:-1], o[1:]
        equal = np.flatnonzero(length[a] == length[b])
        got = _common(word, lms[a[equal]].astype(np.int64), lms[b[equal]].astype(np.int64), int(length.max()))
        same[1:][equal] = got >= length[a[equal]]
    rank = np.empty(len(lms), dtype=np.int64)
    rank[o] = np.cumsum(~same)

    # the string of names, by doubling until depth symbols are covered (names span two symbols at least)
    w = 1
    while 2 * w < depth + 2 and rank.max() < len(rank):
        key = rank * (len(rank) + 2)
        key[: len(rank) - w] += rank[w:] if w < len(rank) else 0
        u, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        w *= 2
    o = np.argsort(rank, kind="stable")
    sorted_lms = lms[o]
    lms_lcp = np.zeros(len(o), dtype=np.uint8)
    if len(o) > 1:
        tied = rank[o[1:]] == rank[o[:-1]]
        got = np.full(len(o) - 1, depth, dtype=np.int64)
        free = np.flatnonzero(~tied)
        got[free] = _common(word, sorted_lms[:-1][free].astype(np.int64), sorted_lms[1:][free].astype(np.int64), depth)
        lms_lcp[1:] = got

    sa, lcp = [], []
    for _, l_pos, l_lcp, s_pos, s_lcp, seam in _both_passes(text, sigma, sorted_lms, lms_lcp, depth, memory, folder):
        if len(s_pos):  # descending: each value belongs to the pair with the larger neighbour
            up = np.empty(len(s_pos), np.uint8)
            up[:-1] = s_lcp[1:]
            up[-1] = seam if len(l_pos) else 0
            sa.append(s_pos)
            lcp.append(up)
        if len(l_pos):
            sa.append(l_pos[::-1])
            lcp.append(l_lcp[::-1])
    return np.concatenate(sa)[::-1], np.concatenate(lcp)[::-1]
