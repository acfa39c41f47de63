"""Operator 9 - exact byte deduplication over suffix arrays of shards.

Remove each byte covered by a ``SPAN``-byte string that also starts in a document with a smaller id.  Whole-corpus
suffix tuples would not fit the disk, so strings are *routed* before they are sorted:

1. Texts equal to that of a smaller id are removed whole and leave the stage (short ones stay untouched).
2. Every ``SPAN``-byte string is owned by the least hash among its ``K``-byte substrings (leftmost on ties), its *anchor*:
   equal strings have equal anchors at the same offset.  A packed exchange finds the anchors that two documents hold;
   a string whose anchor occurs in one document only cannot repeat elsewhere.
3. Around each shared anchor the text of the strings it owns (at most ``2 * SPAN - K`` bytes) goes, once per group of
   documents, to the shard of the anchor's hash range.  A shard sorts the suffixes of its texts by external induced
   sorting (:mod:`.induced`); runs of suffixes whose common prefix is at least ``SPAN`` are equal strings, and the least
   id of a run tells which of its strings are removed.  An anchor with more than ``HOT`` occurrences is split: each of its strings goes by
   itself to the shard of the hash of all its bytes, which equal strings share.  The number of shards follows the counted contexts.
4. The verdicts return to the groups, where they become spans of documents, and the spans meet the texts.

Broadcast: only the spans, and only while their measured size is below ``BROADCAST_BYTES``; beyond it they are joined by a shuffle.

Defined results: rows with a null id are left out; null text is the empty text; texts below ``SPAN`` bytes keep all bytes; rows that repeat an
id are texts of one document, each judged by itself against all texts of smaller ids (strings shared by two texts of the same id are no
duplicates); an empty table gives an empty result; extra columns are ignored; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lean, packed
from . import textops as T
from .common import cut, scratch_path, shuffle_width
from .induced import suffix_order

SPAN = 50
K = 20
BROADCAST_BYTES = 64 << 20
SHARDS = 4  # per shuffle partition, at least: sorting holds some hundred bytes for each byte of a shard
SHARD_BYTES = 8 << 20  # bytes of contexts for which a further shard is made
HOT = 1 << 14
MANY = 4  # occurrences within a flush from which they are counted
CHUNK = 1 << 22  # bytes of contexts that are cut out at once
_NONE = np.iinfo(np.int64).min
_ROW = "bucket int, kind int, base long, a binary, b binary, c binary, d binary"
_TEXTS, _HITS, _FLAGS, _HOT = 0, 1, 2, 3


def _row(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])


def group_of(doc_id: Column, n: int) -> Column:
    x = doc_id.bitwiseXOR(F.shiftright(doc_id, 7)).bitwiseXOR(F.shiftright(doc_id, 17)).bitwiseXOR(F.shiftright(doc_id, 31))
    return F.pmod(x, F.lit(n)).cast("int")


def _group(doc_id: np.ndarray, n: int) -> np.ndarray:
    return (doc_id ^ (doc_id >> 7) ^ (doc_id >> 17) ^ (doc_id >> 31)) % n


def anchors(buf: np.ndarray, offs: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a block: hash, text index, first string owned, number of strings owned."""
    z = np.zeros(0, np.int64)
    if len(buf) < span:
        return np.zeros(0, np.uint64), z, z, z
    if len(buf) > 1 << 23:
        return _long_anchors(buf, offs, span, k)
    m = len(buf) - k + 1
    load = lambda at: np.ndarray((m,), "<u8", buf, at, (1,))
    buf = np.ascontiguousarray(buf)
    x = load(0) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        x += load(at)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    low = (x & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
    width, w = span - k + 1, 1
    while 2 * w <= width:
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    if w < width:
        low = np.minimum(low[: len(low) - (width - w)], low[width - w :])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    change = np.concatenate(([True], at[1:] != at[:-1]))
    change[offs[:-1][offs[:-1] < len(at)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(at))
    doc = np.searchsorted(offs, start, side="right") - 1
    end = np.minimum(end, offs[doc + 1] - span + 1)  # strings that would leave the text
    ok = end > start
    start, end, doc = start[ok], end[ok], doc[ok]
    return T.mix(x[at[start]]), doc, start, end - start  # least hashes are low ones: mixed again, they fill all ranges evenly


def _long_anchors(buf, offs, span, k):
    """A block beyond the packed position: overlapping slices of single texts.  A run of strings cut in two by a slice
    border is reported as two runs of the same anchor, which changes no result."""
    parts, step = [], 1 << 22
    for d in range(len(offs) - 1):
        for s in range(int(offs[d]), int(offs[d + 1]), step):
            e = min(int(offs[d + 1]), s + step + span - 1)
            h, _, start, n = anchors(buf[s:e], np.array([0, e - s]), span, k)
            parts.append((h, np.full(len(h), d), start + s, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shared_anchors(docs: DataFrame, n_buckets: int, n_groups: int) -> DataFrame:
    """Rows ``bucket (= group of documents), a: ids, b: hashes`` of the anchors that several documents hold, and rows of the kind ``_HOT``
    (a: hashes, b: occurrences) of those with more than ``HOT`` occurrences."""
    hot = HOT

    def emit(h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first, length = packed.runs(h)
        many, times = h[first[length >= MANY]], length[length >= MANY]
        at = packed.edges(many, n_buckets)
        counts = [(n_buckets + n_groups + b, _HOT, 0, packed.planes(many[at[b] : at[b + 1]]), packed.small(times[at[b] : at[b + 1]]), b"", b"") for b in range(n_buckets) if at[b + 1] > at[b]]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[new], doc[new]
        first, length = packed.runs(h)
        own = np.repeat(length > 1, length)
        rows = list(_by_group(doc[own], h[own], n_groups, n_buckets))
        h, doc = h[first], np.where(length > 1, _NONE, doc[first])
        at = packed.edges(h, n_buckets)
        rows += [(b, _TEXTS, 0, packed.planes(h[at[b] : at[b + 1]]), packed.small(doc[at[b] : at[b + 1]]), b"", b"") for b in range(n_buckets) if at[b + 1] > at[b]]
        yield from _row(rows + counts).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, size = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, offs in T.blocks(batch.column(1)):
                h, d, _, _ = anchors(buf, offs)
                hashes.append(h)
                owners.append(ids[i + d])
                size += len(h)
                if size >= packed.FLUSH:
                    yield from emit(np.concatenate(hashes), np.concatenate(owners))
                    hashes, owners, size = [], [], 0
        if size:
            yield from emit(np.concatenate(hashes), np.concatenate(owners))

    def gather(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket >= n_buckets + n_groups:
            h, place = np.unique(np.concatenate([packed.unplanes(x) for x in group.column("a").to_pylist()]), return_inverse=True)
            times = np.zeros(len(h), np.int64)
            np.add.at(times, place, np.concatenate([packed.unsmall(x) for x in group.column("b").to_pylist()]))
            return _row([(bucket, _HOT, 0, packed.planes(h[times > hot]), packed.small(times[times > hot]), b"", b"")] if (times > hot).any() else [])
        if bucket >= n_buckets:
            return group
        h = np.concatenate([packed.unplanes(x) for x in group.column("a").to_pylist()])
        doc = np.concatenate([packed.unsmall(x) for x in group.column("b").to_pylist()])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first, length = packed.runs(h)
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        keep = np.repeat(low != high, length) & (doc != _NONE)
        return _row(list(_by_group(doc[keep], h[keep], n_groups, n_buckets)))

    return docs.select("doc_id", "text").mapInArrow(lean.batches(scan), _ROW).groupBy("bucket").applyInArrow(lean.group(gather), _ROW).withColumn("bucket", F.col("bucket") - n_buckets)


def _by_group(doc: np.ndarray, h: np.ndarray, n_groups: int, offset: int) -> Iterator[tuple]:
    g = _group(doc, n_groups)
    order = np.argsort(g.astype(np.uint16) if n_groups < 1 << 16 else g, kind="stable")
    g, doc, h = g[order], doc[order], h[order]
    first, length = packed.runs(g)
    for f, n in zip(first.tolist(), length.tolist(), strict=True):
        o = np.argsort(h[f : f + n])
        yield (offset + int(g[f]), _FLAGS, 0, packed.small(doc[f : f + n][o]), packed.planes(h[f : f + n][o]), b"", b"")


def _cut_out(buf: np.ndarray, h: np.ndarray, start: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
    """The contexts of anchors in chunks: number of the anchor, hash that routes it, hash of the context, start, size, where its text begins
    in the chunk's distinct texts, and these."""
    if not len(h):
        return
    heated = np.isin(h, hot)
    cost = np.cumsum(np.where(heated, n * SPAN, n + SPAN - 1))
    edge = np.flatnonzero(np.concatenate(([True], np.diff((cost - 1) // CHUNK) > 0)))
    for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(h)).tolist(), strict=True):
        which, route, s, size = np.arange(lo, hi), h[lo:hi], start[lo:hi], n[lo:hi] + SPAN - 1
        if heated[lo:hi].any():  # every string of a hot anchor is a context of its own
            own = np.where(heated[lo:hi], n[lo:hi], 1)
            step = np.arange(own.sum()) - np.repeat(np.concatenate(([0], np.cumsum(own)[:-1])), own)
            which, s = np.repeat(which, own), np.repeat(s, own) + step
            one = heated[which]
            route, size = h[which], np.where(one, SPAN, n[which] + SPAN - 1)
            route[one] = T.mix(T.span_hash(buf, s[one], s[one] + SPAN))
        content = T.span_hash(buf, s, s + size)
        _, first, copy = np.unique(content, return_index=True, return_inverse=True)
        width = size[first]
        begin = np.concatenate(([0], np.cumsum(width)[:-1]))
        yield which, route, content, s, size, begin[copy], buf[np.repeat(s[first] - begin, width) + np.arange(width.sum())]


def _contexts(docs: DataFrame, flags: DataFrame, hot: np.ndarray, n_buckets: int, n_groups: int) -> DataFrame:
    """Per group of documents: the distinct texts around its shared anchors, by shard, and where they stand."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _row([])
        shared = np.unique(np.concatenate([packed.unplanes(x) for x in right.column("b").to_pylist()]))
        gid = left.column("gid")[0].as_py()
        ids, tags = left.column("doc_id").to_numpy(), left.column("tag").to_numpy()
        parts, room = [], 0
        for i, _, buf, offs in T.blocks(left.column("text")):
            h, d, start, n = anchors(buf, offs)
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            hit = shared[at] == h
            h, d, start, n = h[hit], d[hit], start[hit], n[hit]
            for which, route, content, s, size, begin, data in _cut_out(buf, h, start, n, hot):
                parts.append((route, content, ids[i + d[which]], s - offs[d[which]], size, begin + room, data, tags[i + d[which]]))
                room += len(data)
        if not parts:
            return _row([])
        h, content, doc, start, size, begin, data, tag = (np.concatenate([p[k] for p in parts]) for k in range(8))
        order = np.lexsort((content, h))  # by anchor, then content: shards are slices
        hs, cs = h[order], content[order]
        new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])))
        first = np.flatnonzero(new)
        low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        index = np.empty(len(h), dtype=np.int64)
        index[order] = np.cumsum(new) - 1
        rep = order[first]
        at = packed.edges(hs[first], n_buckets)
        rows = []
        for b in range(n_buckets):
            r = rep[at[b] : at[b + 1]]
            if len(r):
                s = size[r]
                pick = np.repeat(begin[r] - np.concatenate(([0], np.cumsum(s)[:-1])), s) + np.arange(s.sum())
                rows.append((b, gid, int(at[b]), packed.small(low[at[b] : at[b + 1]]), packed.small(high[at[b] : at[b + 1]]), s.astype(np.uint8).tobytes(), data[pick].tobytes()))
        o = np.argsort(index, kind="stable")
        rows.append((n_buckets + gid, _HITS, 0, packed.small(index[o]), packed.small(doc[o]), packed.small(start[o]), packed.small(tag[o])))
        return _row(rows)

    grouped = docs.withColumn("gid", group_of(F.col("doc_id"), n_groups)).groupBy("gid")
    return grouped.cogroup(flags.groupBy("bucket")).applyInArrow(lean.groups(run), _ROW)


def _sort_shard(group: pa.Table, memory: int, folder: str) -> list[tuple]:
    """Equal strings of one shard: rows (group of documents, text index, first string, strings, least id)."""
    gid = np.repeat(group.column("kind").to_numpy(), [len(x) for x in group.column("c").to_pylist()])
    index, low, high, size = [], [], [], []
    for base, a, b, c in zip(*(group.column(x).to_pylist() for x in ("base", "a", "b", "c")), strict=True):
        size.append(np.frombuffer(c, np.uint8).astype(np.int64))
        index.append(base + np.arange(len(size[-1])))
        low.append(packed.unsmall(a))
        high.append(packed.unsmall(b))
    index, low, high, size = map(np.concatenate, (index, low, high, size))
    # groups of documents hold the same texts: each distinct one is sorted once
    data = np.frombuffer(b"".join(group.column("d").to_pylist()), np.uint8)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    _, rep, copy = np.unique(T.span_hash(data, start, start + size), return_index=True, return_inverse=True)
    by_text = np.argsort(copy, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(copy, minlength=len(rep)))))
    one_low, one_high = np.minimum.reduceat(low[by_text], edge[:-1]), np.maximum.reduceat(high[by_text], edge[:-1])
    length = size[rep]
    n = int(length.sum()) + len(rep)
    text = np.ones(n + 1, dtype=np.uint16)  # 1 ends a text, 0 the shard
    text[n] = 0
    begin = np.concatenate(([0], np.cumsum(length + 1)[:-1])).astype(np.int32)
    owner = np.repeat(np.arange(len(rep), dtype=np.int32), length + 1)
    place = np.arange(n, dtype=np.int32) - begin[owner]
    inner = place < length[owner]
    text[:n][inner] = data[(start[rep][owner] + place)[inner]].astype(np.uint16) + 2
    del data
    room = np.zeros(n + 1, dtype=bool)  # strings that end inside their text
    room[:n] = place <= length[owner] - SPAN
    del place, inner
    sa, lcp = suffix_order(text, 258, SPAN, folder, memory)
    run = np.cumsum(lcp < SPAN, dtype=np.int32)
    ok = room[sa]
    sa, run = sa[ok], run[ok]
    first, many = packed.runs(run)
    if not len(first):
        return []
    least = np.empty(n + 1, dtype=np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(one_low[owner[sa]], first), many)
    at = np.flatnonzero(room)
    who, least = owner[at], least[at]
    hit = least < one_high[who]
    at, who, least = at[hit], who[hit], least[hit]
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (who[1:] != who[:-1]))))
    count = np.diff(np.append(new, len(at)))
    at, who, least = at[new] - begin[who[new]], who[new], least[new]
    # back to every copy that has a document after the least
    times = edge[who + 1] - edge[who]
    which = np.repeat(np.arange(len(who)), times)
    who = by_text[np.repeat(edge[who] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
    at, count, least = at[which], count[which], least[which]
    hit = least < high[who]
    at, who, least, count = at[hit], who[hit], least[hit], count[hit]
    out = []
    for g in np.unique(gid[who]).tolist():
        m = gid[who] == g
        w = who[m]
        out.append((int(g), packed.small(index[w]), at[m].astype(np.uint8).tobytes(), count[m].astype(np.uint8).tobytes(), packed.small(least[m])))
    return out


def duplicate_spans(docs: DataFrame, memory: int = 64 << 20) -> DataFrame:
    """``doc_id, tag, n_removed, n_spans, spans``: maximal removed runs of each text that has any (spans: int64 starts, then
    ends).  ``docs``: ``doc_id, tag, text`` without nulls and without copies of whole texts; ``tag`` tells the texts of an id apart."""
    width = shuffle_width(docs.sparkSession)
    n_buckets, n_groups = SHARDS * width, width
    found = cut(_shared_anchors(docs, n_buckets, n_groups), "suffix-anchors")
    flags = found.where(F.col("kind") == _FLAGS)
    heated = found.where(F.col("kind") == _HOT).select("a", "b").collect()  # one anchor of more than HOT
    hot = np.concatenate([np.zeros(0, np.uint64), *(packed.unplanes(r["a"]) for r in heated)])
    shared = (flags.agg(F.sum(F.octet_length("a"))).first()[0] or 0) // 8
    n_bytes = shared * (2 * SPAN - K) + sum(int(packed.unsmall(r["b"]).sum()) for r in heated) * SPAN * (SPAN - K + 1)
    n_buckets = max(n_buckets, -(-n_bytes // SHARD_BYTES))
    rows = _contexts(docs, flags, hot, n_buckets, n_groups)
    spill = scratch_path(docs.sparkSession, "suffix-spill")

    def shard(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py()
        if b >= n_buckets:
            return group.set_column(0, "bucket", pa.array([b - n_buckets] * group.num_rows, pa.int32()))
        return _row([(g, _TEXTS, 0, a, o, c, m) for g, a, o, c, m in _sort_shard(group, memory, spill)])

    def spans(group: pa.Table) -> pa.Table:
        none = pa.table({"doc_id": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        kind = group.column("kind").to_pylist()
        part = lambda k, col, f: [f(x) for x, y in zip(group.column(col).to_pylist(), kind, strict=True) if y == k]
        byte = lambda x: np.frombuffer(x, np.uint8).astype(np.int64)
        if _TEXTS not in kind or _HITS not in kind:
            return none
        index, doc, start, tag = (np.concatenate(part(_HITS, c, packed.unsmall)) for c in "abcd")
        r_index, r_least = (np.concatenate(part(_TEXTS, c, packed.unsmall)) for c in "ad")
        r_off, r_count = (np.concatenate(part(_TEXTS, c, byte)) for c in "bc")
        order = np.argsort(r_index, kind="stable")
        r_index, r_least, r_off, r_count = (x[order] for x in (r_index, r_least, r_off, r_count))
        lo, hi = np.searchsorted(r_index, index, side="left"), np.searchsorted(r_index, index, side="right")
        n = hi - lo
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        hit = np.repeat(np.arange(len(index)), n)
        ok = r_least[which] < doc[hit]
        which, hit = which[ok], hit[ok]
        if not len(hit):
            return none
        return _merge(doc[hit], tag[hit], start[hit] + r_off[which], start[hit] + r_off[which] + r_count[which] - 1 + SPAN)

    done = rows.groupBy("bucket").applyInArrow(lean.group(shard), _ROW).groupBy("bucket").applyInArrow(lean.group(spans), "doc_id long, tag long, n_removed long, n_spans long, spans binary")
    return cut(done, "suffix-spans")


def _merge(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    order = np.lexsort((begin, tag, doc))
    doc, tag, begin, end = doc[order], tag[order], begin[order], end[order]
    text = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))).astype(np.int64)
    rank = text << 40
    far = np.maximum.accumulate(rank + end)
    new = np.flatnonzero(np.concatenate(([True], (rank + begin)[1:] > far[:-1])))
    b, e = begin[new], np.append(far[new[1:] - 1], far[-1]) & ((1 << 40) - 1)
    d, g = doc[new], tag[new]
    first, length = packed.runs(text[new])
    last = first + length
    return pa.table({
        "doc_id": pa.array(d[first]), "tag": pa.array(g[first]), "n_removed": pa.array(np.add.reduceat(e - b, first)), "n_spans": pa.array(length.astype(np.int64)),
        "spans": pa.array([np.concatenate((b[i:j], e[i:j])).tobytes() for i, j in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
    })


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    plain, spans = _prepared(docs, doc_id, text)
    return _apply(plain, spans, lambda b: b, "kept binary")


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    plain, spans = _prepared(docs, doc_id, text)
    return _apply(plain, spans, lambda b: hashlib.sha256(b).hexdigest(), "kept_sha256 string")


def _prepared(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    plain = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    plain = plain.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    keyed = cut(plain.select("doc_id", "tag", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), F.octet_length("text").cast("long").alias("n")), "suffix-keys")
    twice = cut(keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("h").alias("hh"), "first"), "suffix-twice")
    copies = cut(keyed.join(twice, F.col("h") == F.col("hh")).where("doc_id > first").select("doc_id", "tag", "n").distinct(), "suffix-copies")
    few = copies.count() * 16 <= BROADCAST_BYTES
    ids = copies.select("doc_id", "tag")
    distinct = plain.join(F.broadcast(ids) if few else ids, ["doc_id", "tag"], "left_anti").where(F.octet_length("text") >= SPAN)
    spans = duplicate_spans(distinct)
    whole = copies.where(F.col("n") >= SPAN).select("doc_id", "tag", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("spans"))
    return plain, spans.unionByName(whole)


def _apply(plain: DataFrame, spans: DataFrame, of, column: str) -> DataFrame:
    size = spans.agg(F.sum(F.coalesce(F.octet_length("spans"), F.lit(0)) + 48)).first()[0] or 0
    right = spans.select("doc_id", "tag", F.lit(True).alias("hit"), "spans")
    joined = plain.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, ["doc_id", "tag"], "left")
    kind = pa.string() if column.endswith("string") else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, held = batch.column(2), batch.column(3)
            for i, j, buf, offs in T.blocks(batch.column(1)):
                removed, count, out = [], [], []
                for k in range(j - i):
                    b = buf[offs[k] : offs[k + 1]]
                    n = len(b)
                    if hit[i + k].is_valid and not held[i + k].is_valid:
                        edges = [(0, n)] if n else []
                    elif hit[i + k].is_valid:
                        v = np.frombuffer(held[i + k].as_py(), np.int64)
                        edges = [(s, min(e, n)) for s, e in zip(v[: len(v) // 2].tolist(), v[len(v) // 2 :].tolist(), strict=True) if s < n]
                    else:
                        edges = []
                    at, parts = 0, []
                    for s, e in edges:
                        parts.append(b[at:s].tobytes())
                        at = e
                    parts.append(b[at:].tobytes())
                    removed.append(sum(e - s for s, e in edges))
                    count.append(len(edges))
                    out.append(of(b"".join(parts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(out, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", column.split()[0]])

    return joined.select("doc_id", "text", "hit", "spans").mapInArrow(lean.batches(run), f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")
