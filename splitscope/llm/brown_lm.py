"""Operator 2 - language-model scores from Brown classes.

Model: ``p(w | v) = (1 - u) * p(class(w) | class(v)) * p(w | class(w))`` for words seen in training; an unseen word is one event of
probability ``u``, the share of training tokens that are words seen once (half a token where there is none).  Every word, frequent or rare, has a class, and its class is the
history of what follows; the end of a text has a class of its own, and after an unseen word the class frequencies alone count.  Transitions are smoothed
towards the class frequencies; emissions are relative frequencies within the class.  Each history's probabilities add up to 1 over the known words
and the unseen event.

Classes come from exchange clustering: a word moves to the class that raises the likelihood of the class bigrams most, given all other words.

* *Frequent words*, at least 1 / ``HEAD`` of the training tokens (so at most ``HEAD`` of them at any size), are exchanged in up to ``ROUNDS`` rounds over
  their bigram counts.  They are dealt to ``GROUPS`` groups; a group moves its words one after the other, seeing its own moves, ``1 / PARTS`` of the groups
  work at once, and the counts are taken anew after each part.  The rarer words are one neighbour to them.
* *All other words* are exchanged once, given the classes of the frequent ones.  Every occurrence goes, with its place and the classes on both sides,
  to the hash range of the word, where the word's counts are summed and its class is chosen; the occurrences return to their texts, where
  rare words next to each other learn each other's class.  A rare word holds at most 1 / ``HEAD`` of the tokens, so no hash range outgrows its peers.

The driver sees counts per class pair and the frequent words with their classes, both bounded; the rare words' classes stay with their hash ranges.

Tokens of a text: its lower-cased words and one end.  Defined results: null text is empty (one token, the end); rows with
a null id are left out; rows that share an id are scored together as one document; with an empty training set every word is
unseen (u = 0.5); an empty table gives an empty result; extra columns are ignored.  Results do not depend on partitions or on the size of Arrow batches (but
for the last bits of sums).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lean, packed
from . import textops as T
from .common import cut, shuffle_width

HEAD = 100_000
CLASSES = 64
ROUNDS, PARTS, GROUPS = 3, 4, 64
KAPPA = 20.0
_SEGMENT, _TASK, _TOKENS = 30, 43, 1 << 17  # places: bits below the segment and below the task, and tokens from which a new segment begins
_END, _TAIL = CLASSES, CLASSES + 1  # histories beyond the word classes; the second one is a rare word while its class is not known, and an unseen one
_N = CLASSES + 2
_ROW = "bucket int, kind int, base int, a binary, b binary, c binary, d binary, e binary, f binary"
_WIDTH = 9


def is_training(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


def _rows(rows: list[tuple]) -> pa.Table:
    rows = [r + (b"",) * (_WIDTH - len(r)) for r in rows]
    cols = list(zip(*rows, strict=True)) or [[]] * _WIDTH
    kinds = [pa.int32()] * 3 + [pa.binary()] * (_WIDTH - 3)
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])


def _texts(batches: Iterator[pa.RecordBatch]):
    """Per block: ids, training flags, word hashes, text index of each word."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        train = np.array([is_training(x) for x in ids.tolist()], dtype=bool)
        for i, j, buf, offs in T.blocks(batch.column(1)):
            low = T.lower(buf)
            s, e, doc = T.words(low, offs)
            yield ids[i:j], train[i:j], T.span_hash(low, s, e), doc


def _with_ends(x: np.ndarray, doc: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``x`` with ``end`` after the words of each text, and the text index of each token."""
    after = np.searchsorted(doc, np.arange(n), side="right")
    return np.insert(x, after, end), np.insert(doc, after, np.arange(n))


def _vocabulary(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Per hash range: word hashes (a) and counts in training (b)."""

    def emit(h: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, inverse = np.unique(h, return_inverse=True)
        k = np.bincount(inverse, weights=k).astype(np.int64)
        at = packed.edges(u, n_buckets)
        yield from _rows([(b, 0, 0, packed.planes(u[at[b] : at[b + 1]]), packed.small(k[at[b] : at[b + 1]])) for b in range(n_buckets) if at[b + 1] > at[b]]).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ks, size = [], [], 0
        for _, train, h, doc in _texts(batches):
            u, k = np.unique(h[train[doc]], return_counts=True)
            hs.append(u)
            ks.append(k)
            size += len(u)
            if size >= packed.FLUSH:
                yield from emit(np.concatenate(hs), np.concatenate(ks))
                hs, ks, size = [], [], 0
        if size:
            yield from emit(np.concatenate(hs), np.concatenate(ks))

    def total(group: pa.Table) -> pa.Table:
        h = np.concatenate([packed.unplanes(x) for x in group.column("a").to_pylist()])
        k = np.concatenate([packed.unsmall(x) for x in group.column("b").to_pylist()])
        u, inverse = np.unique(h, return_inverse=True)
        return _rows([(group.column("bucket")[0].as_py(), 0, 0, packed.planes(u), packed.small(np.bincount(inverse, weights=k).astype(np.int64)))])

    return cut(docs.mapInArrow(lean.batches(scan), _ROW).groupBy("bucket").applyInArrow(lean.group(total), _ROW), "lm-vocabulary")


class Head:
    """The frequent words, sorted by hash; ids are places in that order."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 for words of the tail."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _statistics(vocabulary: DataFrame, n_docs: int) -> tuple[int, int, int, Head]:
    """Training tokens, types, words seen once, and the head."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                k = packed.unsmall(b.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([int(k.sum())]), pa.array([len(k)]), pa.array([int((k == 1).sum())])], names=["n", "v", "once"])

    r = vocabulary.select("b").mapInArrow(lean.batches(sums), "n long, v long, once long").agg(F.sum("n"), F.sum("v"), F.sum("once")).first()
    n, v, once = (x or 0 for x in r)
    n, v = n + n_docs, v + (n_docs > 0)
    least = max(2, -(-n // HEAD))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                k = packed.unsmall(b.as_py())
                m = k >= least
                yield pa.RecordBatch.from_arrays([pa.array(packed.unplanes(a.as_py())[m].view(np.int64)), pa.array(k[m])], names=["h", "k"])

    rows = vocabulary.select("a", "b").mapInArrow(lean.batches(frequent), "h long, k long").collect()  # at most HEAD rows
    return n, v, once, Head(np.array([x[0] for x in rows], dtype=np.int64).view(np.uint64), np.array([x[1] for x in rows], dtype=np.int64))


def _bigrams(docs: DataFrame, head: Head) -> DataFrame:
    """One row per group of head ids: word (a), neighbour (b), count (c) for neighbours on the right, and d, e, f for those on the left.
    The end (id = len(head)) and the tail (id = len(head) + 1) are neighbours too."""
    n_head = len(head.hashes)
    n_ids = n_head + 2

    def pairs(key: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, inverse = np.unique(key, return_inverse=True)
        k = np.bincount(inverse, weights=k).astype(np.int64)
        v, w = u // n_ids, u % n_ids
        rows = []
        for kind, word, other in ((0, v, w), (1, w, v)):
            g = word % GROUPS
            for b in np.unique(g).tolist():
                m = g == b
                rows.append((b, kind, 0, packed.small(word[m]), packed.small(other[m]), packed.small(k[m])))
        yield from _rows(rows).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ks, size = [], [], 0
        for ids, train, h, doc in _texts(batches):
            hid = head.ids(h)
            x, d = _with_ends(np.where(hid < 0, n_head + 1, hid), doc, len(ids), n_head)
            before = np.concatenate(([n_head], x[:-1]))
            before[1:][d[1:] != d[:-1]] = n_head
            u, k = np.unique((before * n_ids + x)[train[d]], return_counts=True)
            keys.append(u)
            ks.append(k)
            size += len(u)
            if size >= packed.FLUSH:  # merge first: pairs repeat across blocks
                u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                k = np.bincount(inverse, weights=np.concatenate(ks)).astype(np.int64)
                keys, ks, size = [u], [k], len(u)
                if size >= packed.FLUSH:
                    yield from pairs(u, k)
                    keys, ks, size = [], [], 0
        if size:
            yield from pairs(np.concatenate(keys), np.concatenate(ks))

    def merge(group: pa.Table) -> pa.Table:
        out: list = []
        kinds = group.column("kind").to_pylist()
        for kind in (0, 1):
            got = [[packed.unsmall(x) for x, y in zip(group.column(col).to_pylist(), kinds, strict=True) if y == kind] for col in "abc"]
            x, y, z = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in got)
            u, inverse = np.unique(x * n_ids + y, return_inverse=True)
            out += [packed.small(u // n_ids), packed.small(u % n_ids), packed.small(np.bincount(inverse, weights=z, minlength=len(u)).astype(np.int64))]
        return _rows([(group.column("bucket")[0].as_py(), 0, 0, *out)])

    return cut(docs.mapInArrow(lean.batches(scan), _ROW).groupBy("bucket").applyInArrow(lean.group(merge), _ROW), "lm-bigrams")


def _g(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _context_counts(batch: pa.RecordBatch, classes: np.ndarray):
    """Per row of the bigram table: words, and their counts with each class on the right and on the left."""
    for row in zip(*(batch.column(c).to_pylist() for c in "abcdef"), strict=True):
        word, other, k, word_l, other_l, k_l = map(packed.unsmall, row)
        u = np.union1d(word, word_l)
        right, left = np.zeros((len(u), _N)), np.zeros((len(u), _N))
        np.add.at(right, (np.searchsorted(u, word), classes[other]), k)
        np.add.at(left, (np.searchsorted(u, word_l), classes[other_l]), k_l)
        yield u, right, left


def _matrix(bigrams: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Bigram counts between classes (with end and tail), from the right neighbours of every id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_N, _N))
        for batch in batches:
            for u, right, _ in _context_counts(batch, classes):
                np.add.at(total, classes[u], right)
        i = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel()[i])], names=["i", "n"])

    return _summed(bigrams.mapInArrow(lean.batches(run), "i long, n double"))


def _summed(cells: DataFrame) -> np.ndarray:
    """The matrix of summed cells: one row per class pair at most."""
    out = np.zeros(_N * _N)
    for i, n in cells.groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out.reshape(_N, _N)


def exchange(bigrams: DataFrame, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the head ids (then of end and tail), and the class bigram counts."""
    n_head = len(head.hashes)
    classes = np.full(n_head + 2, _TAIL, dtype=np.int64)
    classes[n_head] = _END
    classes[np.argsort(-head.counts, kind="stable")] = np.minimum(np.arange(n_head), CLASSES - 1)  # the most frequent words alone, all others together
    moved = n_head
    for turn in range(ROUNDS * PARTS):
        now, m = classes, _matrix(bigrams, classes)

        def moves(batches: Iterator[pa.RecordBatch], now=now, m=m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in "abcdef"), strict=True):
                    words, best = _one_by_one(m.copy(), now.copy(), n_head, *map(packed.unsmall, row))
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int64())], names=["w", "c"])

        if turn % PARTS == 0:
            if turn and moved * 200 < n_head:
                break
            moved = 0
        part = bigrams.where(F.col("bucket") % PARTS == turn % PARTS)
        got = part.mapInArrow(lean.batches(moves), "w long, c long").collect()  # at most the head
        classes = classes.copy()
        for w, c in got:
            moved += classes[w] != c
            classes[w] = c
    return classes, _matrix(bigrams, classes)


def _one_by_one(m: np.ndarray, classes: np.ndarray, n_head: int, word, other, k, word_l, other_l, k_l) -> tuple[list[int], list[int]]:
    """The words of a group and their new classes; every move shows in the counts before the next one."""
    words = [w for w in np.union1d(word, word_l).tolist() if w < n_head]
    spans = lambda at: (np.searchsorted(at, words, side="left"), np.searchsorted(at, words, side="right"))
    (a, b), (a_l, b_l) = spans(word), spans(word_l)
    best = []
    for i, w in enumerate(words):
        r = np.bincount(classes[other[a[i] : b[i]]], weights=k[a[i] : b[i]], minlength=_N)
        le = np.bincount(classes[other_l[a_l[i] : b_l[i]]], weights=k_l[a_l[i] : b_l[i]], minlength=_N)
        own = classes[w]
        m[own] -= r
        m[:, own] -= le
        np.maximum(m, 0, out=m)
        classes[w] = _best_class(m, r, le)
        m[classes[w]] += r
        m[:, classes[w]] += le
        best.append(int(classes[w]))
    return words, best


def _best_class(x: np.ndarray, r: np.ndarray, le: np.ndarray) -> int:
    """The class that raises the likelihood most for a word with these counts on the right and on the left; ``x`` holds all other words."""
    rows, cols = x.sum(1)[:CLASSES], x.sum(0)[:CLASSES]
    i, j = np.flatnonzero(r), np.flatnonzero(le)
    gain = (_g(x[:CLASSES, i] + r[i]) - _g(x[:CLASSES, i])).sum(1) + (_g(x[j, :CLASSES] + le[j, None]) - _g(x[j, :CLASSES])).sum(0)
    gain -= _g(rows + r.sum()) - _g(rows) + _g(cols + le.sum()) - _g(cols)
    return int(gain.argmax())


def _best_classes(m: np.ndarray, n: int, word: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for ``n`` rare words at once: ``word`` numbers the occurrences, ``left`` and ``right`` are the classes beside them.  Neighbours whose
    class is not known do not count, and rare words are not in ``m`` yet but as one neighbour."""
    gain = np.zeros((n, CLASSES))
    for beside, table in ((right, m[:CLASSES].T), (left, m[:, :CLASSES])):  # table[j, c]: counts of class c with j on that side
        known = beside != _TAIL
        pair, k = np.unique(word[known] * _N + beside[known], return_counts=True)
        w, j = pair // _N, pair % _N
        total = np.bincount(w, weights=k, minlength=n)
        sums = table.sum(0)
        for at in range(0, len(pair), 1 << 14):
            o = slice(at, at + (1 << 14))
            base = table[j[o]]
            first = np.flatnonzero(np.concatenate(([True], np.diff(w[o]) > 0)))
            gain[w[o][first]] += np.add.reduceat(_g(base + k[o, None]) - _g(base), first, axis=0)
        for at in range(0, n, 1 << 13):
            o = slice(at, at + (1 << 13))
            gain[o] -= _g(sums + total[o, None]) - _g(sums)
    return gain.argmax(1)


def _smooth(m: np.ndarray) -> np.ndarray:
    prior = (m.sum(0) + 1e-3) / (m.sum() + 1e-3 * m.shape[1])
    return (m + KAPPA * prior) / (m.sum(1, keepdims=True) + KAPPA)


def _u2(x: np.ndarray) -> bytes:
    return x.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _from_u2(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64)


def _gathered(group: pa.Table, kind: int, columns: str, read: tuple) -> list[np.ndarray]:
    """The packed columns of the group's rows of a kind, end to end."""
    kinds = group.column("kind").to_pylist()
    rows = [i for i, x in enumerate(kinds) if x == kind]
    return [np.concatenate([f(group.column(c)[i].as_py()) for i in rows]) if rows else np.zeros(0, np.int64) for c, f in zip(columns, read, strict=True)]


def _segment_group(place: np.ndarray, n: int) -> np.ndarray:
    return (T.mix((place >> _SEGMENT).astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).astype(np.int64)


def _contexts(docs: DataFrame, head: Head, classes: np.ndarray, n_buckets: int, n_groups: int) -> DataFrame:
    """Occurrences of rare words at the hash ranges of the words (kind 0): hash (a), place (b), sides (c: left | right << 7 | training << 14).

    A place is the number of the task's partition, of a segment of whole texts, and of the token in it, ends included: neighbours in a text have
    places that differ by one, and no others have.  Where texts begin (a) and their ids (b) go ahead to the groups of segments (kind 3)."""

    def emit(parts: list, texts: list) -> Iterator[pa.RecordBatch]:
        h, place, sides = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, place, sides = h[order], place[order], sides[order]
        at = packed.edges(h, n_buckets)
        for b in range(n_buckets):
            o = slice(at[b], at[b + 1])
            if at[b + 1] > at[b]:
                yield from _rows([(b, 0, 0, packed.planes(h[o]), packed.small(place[o]), _u2(sides[o]))]).to_batches()
        start, ids = (np.concatenate(x) for x in zip(*texts, strict=True))
        group = _segment_group(start, n_groups)
        for g in np.unique(group).tolist():
            yield from _rows([(n_buckets + g, 3, 0, packed.small(start[group == g]), packed.small(ids[group == g]))]).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, size, task, segment, first = [], [], 0, TaskContext.get().partitionId() << _TASK, 0, 0
        for ids, train, h, doc in _texts(batches):
            if first >= _TOKENS:
                segment, first = segment + 1, 0
                if segment >> _TASK - _SEGMENT:
                    raise OverflowError("a task holds more texts than places: read the table in smaller parts")
            base = task | segment << _SEGMENT
            start, first = base + first, first + len(h) + len(ids)
            if not len(h):
                continue
            hid = head.ids(h)
            c = classes[hid]  # hid -1 is the last id, the tail
            edge = doc[1:] != doc[:-1]
            left = np.concatenate(([_END], np.where(edge, _END, c[:-1])))
            right = np.concatenate((np.where(edge, _END, c[1:]), [_END]))
            t = np.flatnonzero(hid < 0)
            parts.append((h[t], start + t + doc[t], left[t] | right[t] << 7 | train[doc[t]].astype(np.int64) << 14))
            texts.append((start + np.searchsorted(doc, np.arange(len(ids))) + np.arange(len(ids)), ids))
            size += len(t)
            if size >= packed.FLUSH:
                yield from emit(parts, texts)
                parts, texts, size = [], [], 0
        if parts:
            yield from emit(parts, texts)

    return docs.mapInArrow(lean.batches(scan), _ROW)


def _exchanged(occurrences: DataFrame, m: np.ndarray, n_buckets: int, n_groups: int) -> DataFrame:
    """Rare words with their classes: occurrences at the groups of their segments (kind 0: place, sides, class, count in training), and the words
    themselves (kind 2: hash, count, class)."""

    def words(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket >= n_buckets:
            return group.set_column(0, "bucket", pa.array([bucket - n_buckets] * group.num_rows, pa.int32()))
        h, place, sides = _gathered(group, 0, "abc", (packed.unplanes, packed.unsmall, _from_u2))
        order = np.argsort(h, kind="stable")
        h, place, sides = h[order], place[order], sides[order]
        start, length = packed.runs(h)
        names, number = h[start], np.repeat(np.arange(len(start)), length)
        train = (sides >> 14).astype(bool)
        count = np.bincount(number[train], minlength=len(names)).astype(np.int64)
        best = _best_classes(m, len(names), number[train], sides[train] & 127, sides[train] >> 7 & 127)
        best = np.where(count > 0, best, _TAIL)  # unseen words have none
        rows = [(-2 - bucket, 2, 0, packed.planes(names), packed.small(count), packed.small(best))]
        by = _segment_group(place, n_groups)
        order = np.lexsort((place, by))
        first, length = packed.runs(by[order])
        for f, n in zip(first.tolist(), length.tolist(), strict=True):
            o = order[f : f + n]
            rows.append((int(by[o[0]]), 0, 0, packed.planes(place[o].astype(np.uint64)), _u2(sides[o]), best[number[o]].astype(np.uint8).tobytes(), packed.small(count[number[o]])))
        return _rows(rows)

    return occurrences.groupBy("bucket").applyInArrow(lean.group(words), _ROW)


def _by_group(doc: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The groups of documents that occur, with the places of their members."""
    g = doc_group(doc, n)
    order = np.argsort(g, kind="stable")
    first, length = packed.runs(g[order])
    for f, k in zip(first.tolist(), length.tolist(), strict=True):
        yield int(g[order[f]]), order[f : f + k]


def _settled(placed: DataFrame) -> DataFrame:
    """The occurrences of each group of segments with the classes of rare neighbours filled in (kind 0: document (a), sides (b), whether the word on the
    right is frequent or the end (c), class (d), count (e)), the class bigrams of rare words in training (kind 1), and the words (kind 2) as they come."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group
        place, sides, c, k = _gathered(group, 0, "abcd", (lambda b: packed.unplanes(b).view(np.int64), _from_u2, _bytes, packed.unsmall))
        start, ids = _gathered(group, 3, "ab", (packed.unsmall, packed.unsmall))
        order = np.argsort(place)
        place, sides, c, k = place[order], sides[order], c[order], k[order]
        order = np.argsort(start)
        doc = ids[order][np.searchsorted(start[order], place, side="right") - 1]
        left, right, train = sides & 127, sides >> 7 & 127, (sides >> 14).astype(bool)
        beside = place[1:] == place[:-1] + 1
        left[1:][beside], right[:-1][beside] = c[:-1][beside], c[1:][beside]
        closed = np.append(beside, False)[: len(place)]
        sums = np.bincount((left * _N + c)[train], minlength=_N * _N) + np.bincount((c * _N + right)[train & ~closed], minlength=_N * _N)
        return _rows([(0, 1, 0, sums.astype(np.int64).tobytes()), (0, 0, 0, packed.small(doc), _u2(left | right << 7), (~closed).astype(np.uint8).tobytes(), c.astype(np.uint8).tobytes(), packed.small(k))])

    return placed.groupBy("bucket").applyInArrow(lean.group(run), _ROW)


def _tail_sums(settled: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N * _N, dtype=np.int64)
        for batch in batches:
            for a in batch.column(0):
                total += np.frombuffer(a.as_py(), np.int64)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i].astype(float))], names=["i", "n"])

    return _summed(settled.where("kind = 1").select("a").mapInArrow(lean.batches(add), "i long, n double"))


@dataclass
class Model:
    """What the driver holds: frequent words with classes, sums, and the counts of class pairs; and the rare words where they are."""

    head: Head
    classes: np.ndarray  # of the frequent words, the end, the tail
    pairs: np.ndarray  # class bigrams of all words
    tokens: int
    types: int
    once: int
    ends: int
    settled: DataFrame  # occurrences of rare words, and these words by hash range

    @property
    def unseen(self) -> float:
        n = self.tokens
        return 0.5 if not n else min(0.5, max(self.once, 0.5) / n)


def fit(plain: DataFrame, n_groups: int) -> Model:
    """``plain``: doc_id, text without null ids."""
    width = shuffle_width(plain.sparkSession)
    n_buckets = 4 * width
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1
    n_docs = plain.where(train).count()
    n, v, once, head = _statistics(_vocabulary(plain, n_buckets), n_docs)
    classes, m = exchange(_bigrams(plain, head), head)
    known = m.copy()
    known[_TAIL], known[:, _TAIL] = 0, 0
    settled = cut(_settled(_exchanged(_contexts(plain, head, classes, n_buckets, n_groups), m, n_buckets, n_groups)), "lm-settled")
    return Model(head, classes, known + _tail_sums(settled), n, v, once, n_docs, settled)


def word_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word_hash, n, class`` of every word of training: frequent and rare ones."""
    spark = docs.sparkSession
    model = fit(_plain(docs, doc_id, text), 4 * shuffle_width(spark))
    head = model.head

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                k, cls = packed.unsmall(b), packed.unsmall(c)
                m = k > 0
                yield pa.RecordBatch.from_arrays([pa.array(packed.unplanes(a)[m].view(np.int64)), pa.array(k[m]), pa.array(cls[m].astype(np.int32))], names=["word_hash", "n", "class"])

    rare = model.settled.where("kind = 2").select("a", "b", "c").mapInArrow(lean.batches(unpack), "word_hash long, n long, class int")
    rows = list(zip(head.hashes.view(np.int64).tolist(), head.counts.tolist(), model.classes[: len(head.hashes)].tolist(), strict=True))
    return rare.unionByName(spark.createDataFrame(rows, "word_hash long, n long, class int"))


def doc_group(doc: np.ndarray, n: int) -> np.ndarray:
    return ((doc ^ (doc >> 7) ^ (doc >> 17) ^ (doc >> 31)) % n).astype(np.int64)


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every document."""
    n_groups = 4 * shuffle_width(docs.sparkSession)
    plain = _plain(docs, doc_id, text)
    model = fit(plain, n_groups)
    head, classes, n, settled = model.head, model.classes, model.tokens, model.settled
    move = np.log10(_smooth(model.pairs[:, : CLASSES + 1])) + np.log10(1 - model.unseen)
    mass = model.pairs.sum(0)
    n_head = len(head.hashes)
    counts = np.append(head.counts, model.ends)
    known_classes = np.append(classes[:n_head], _END)
    emission = np.log10(np.maximum(counts, 1)) - np.log10(np.maximum(mass[known_classes], 1))
    log_mass = np.append(np.log10(np.maximum(mass[: CLASSES + 1], 1)), 0.0)
    norm = np.log10(n + 0.5 * (model.types + 1))
    log_unseen = float(np.log10(model.unseen))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, h, doc in _texts(batches):
            hid = head.ids(h)
            x, d = _with_ends(hid, doc, len(ids), n_head)
            c = classes[x]
            before = np.concatenate(([_END], c[:-1]))
            before[1:][d[1:] != d[:-1]] = _END
            k = x >= 0
            logp, base = np.zeros(len(x)), np.zeros(len(x))
            known = k & (counts[np.maximum(x, 0)] > 0)
            logp[known] = emission[x[known]]
            after = known & (before != _TAIL)  # transitions out of rare words come with these
            logp[after] += move[before[after], c[after]]
            logp[k & ~known] = log_unseen
            base[k] = np.log10(counts[x[k]] + 0.5) - norm
            tokens, seen = np.bincount(d, minlength=len(ids)), np.bincount(d, weights=known, minlength=len(ids)).astype(np.int64)
            b, s = (np.bincount(d, weights=y, minlength=len(ids)) for y in (base, logp))
            yield from _rows([(g, 2, 0, packed.small(ids[o]), np.stack((tokens[o], seen[o])).tobytes(), b[o].tobytes(), s[o].tobytes()) for g, o in _by_group(ids, n_groups)]).to_batches()

    ends_known = model.ends > 0

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c, d, e in zip(*(batch.column(x).to_pylist() for x in range(5)), strict=True):
                doc, sides, frequent, cls, k = packed.unsmall(a), _from_u2(b), _bytes(c).astype(bool), _bytes(d), packed.unsmall(e)
                left, right, seen = sides & 127, sides >> 7 & 127, k > 0
                own = np.where(seen, cls, 0)
                logp = np.where(seen, move[left, own] + np.log10(np.maximum(k, 1)) - log_mass[own], log_unseen)
                out = frequent & (ends_known | (right != _END))
                logp += np.where(out, move[cls, np.minimum(right, CLASSES)], 0.0)
                u, at = np.unique(doc, return_inverse=True)
                seen, base, logp = (np.bincount(at, weights=y, minlength=len(u)) for y in (seen, np.log10(k + 0.5) - norm, logp))
                counts = np.stack((np.zeros(len(u), np.int64), seen.astype(np.int64)))
                yield from _rows([(g, 2, 0, packed.small(u[o]), counts[:, o].tobytes(), base[o].tobytes(), logp[o].tobytes()) for g, o in _by_group(u, n_groups)]).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        parts = []
        for a, b, c, d in zip(*(group.column(x).to_pylist() for x in "abcd"), strict=True):
            tokens, seen = np.frombuffer(b, np.int64).reshape(2, -1)
            parts.append((packed.unsmall(a), tokens, seen, np.frombuffer(c), np.frombuffer(d)))
        doc, tokens, seen, base, logp = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, at = np.unique(doc, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(u))
        tokens = add(tokens).astype(np.int64)
        score = add(logp)
        return pa.table({
            "doc_id": pa.array(u), "held_out": pa.array([not is_training(x) for x in u.tolist()]), "n_tokens": pa.array(tokens), "n_known": pa.array(add(seen).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(u), n)), "base_score": pa.array(add(base)), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(300, -score / np.maximum(tokens, 1))),
        })

    both = plain.mapInArrow(lean.batches(heads), _ROW).unionByName(settled.where("kind = 0").select(*"abcde").mapInArrow(lean.batches(rare), _ROW))
    return both.groupBy("bucket").applyInArrow(lean.group(merge), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
