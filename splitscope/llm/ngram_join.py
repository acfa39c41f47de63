"""Operator 1 - n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct word 5-grams.  Two sets x, y with Jaccard similarity of at least t share at
least ``ceil(t * |x|)`` and ``ceil(t * |y|)`` elements, so under any one order of all elements the prefixes of
length ``|x| - ceil(t * |x|) + l`` and ``|y| - ceil(t * |y|) + l`` share at least ``l`` elements.  A longer prefix (larger l)
costs more postings but demands more matches before a pair is verified.

1. *Hash order, one level for all.*  Prefixes in hash order with ``l = 10 %`` of the set go through a packed
   exchange that finds elements held by two documents or more.  A document with fewer shared prefix elements than the
   smallest l of a possible partner has no link; most of a corpus ends here, after one scan of the texts.
2. *Equal sets collapse* to the smallest id; the sets of what remains are built and each element gets its document
   frequency.  Documents with fewer than ``ceil(t * n)`` shared elements end here.
3. *Rare-first order, adaptive level.*  Each document takes the l whose estimated cost is least: postings of its
   prefix plus the verifications that survive l matches.
4. *Links.*  First every document is verified with the leader of the posting lists that most of its prefix elements
   vote for: a star, not all pairs, so a group of thousands of copies costs one verification each.  Components of these
   links contract the postings; what is left are pairs of *different* components that share at least
   l = min(l_x, l_y) prefix elements.  Where few pairs meet in an element they are joined, counted and verified; pairs that
   meet in a hot element (many sets, several components) are counted and verified by the same rule in tiles of sets, where only links leave the
   task.  So no link between components is lost, and a group's failed pairs are never rows.

Links inside a component change nothing in the result (component and set sizes), hence are not spelled out.

Defined results: rows with a null id are left out; null, empty and white-space texts have no set, no link and are their own
component; short texts have one shingle; repeated rows of an id count once (of different texts the one with the larger (size, signature)
stands for the id in every step, the others link nothing); equal texts are one group, whatever their number; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lean, packed
from . import textops as T
from .common import cut, shuffle_width
from .components import components

WIDTH = 5
FIRST_LEVEL = 10  # l is this per cent of the set in the first pass
BROADCAST_IDS = 1_000_000  # 24 MB of ids, sizes and signatures
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
HOT_PAIRS = 2048  # an element at which more pairs meet is counted in tiles
TILE = 1 << 16  # elements on each side of a tile
VERIFY_COST = 4.0  # of one verification, in postings read, per 16 elements of the set
_SHARED = np.iinfo(np.int64).min  # in place of the id of an element that its task knows to be shared
_PACK = "bucket int, kind int, a binary, b binary, c binary"


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(t * n) in integers."""
    return (n * percent + 99) // 100


def first_level(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (n * FIRST_LEVEL + 99) // 100)


def _first_pass(docs: DataFrame, width: int, percent: int, n_buckets: int, n_groups: int) -> DataFrame:
    """``doc_id, n, sig, shared, demand``: set size, signature, shared prefix elements, and how many a link demands."""

    def emit(tok: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tok, kind="stable")
        tok, doc = tok[order], doc[order]
        first, length = packed.runs(tok)
        own = np.repeat(length > 1, length)
        rows = []
        d, k = np.unique(doc[own], return_counts=True)
        if len(d):
            rows.append((int(d[0]) % n_buckets, 2, packed.small(d), packed.small(k), b""))
        tok, doc = tok[first], np.where(length > 1, _SHARED, doc[first])
        at = packed.edges(tok, n_buckets)
        rows += [(b, 0, packed.planes(tok[at[b] : at[b + 1]]), packed.small(doc[at[b] : at[b + 1]]), b"") for b in range(n_buckets) if at[b + 1] > at[b]]
        yield _pack(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, owners, size, turn = [], [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in T.blocks(batch.column(1)):
                h, at = T.shingle_sets(buf, offs, width)
                n, sig = _signatures(h, at)
                take = np.where(n > 0, np.minimum(n, n - _need(n, percent) + first_level(n)), 0)
                mask = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(take, n)
                turn += 1
                yield _pack([(turn % n_buckets, 1, packed.small(ids[i:j]), packed.small(n), packed.small(sig.view(np.int64)))])
                toks.append(h[mask])
                owners.append(np.repeat(ids[i:j], take))
                size += len(toks[-1])
                if size >= packed.FLUSH:
                    yield from emit(np.concatenate(toks), np.concatenate(owners))
                    toks, owners, size = [], [], 0
        if size:
            yield from emit(np.concatenate(toks), np.concatenate(owners))

    def gather(group: pa.Table) -> pa.Table:
        toks, owners, ids, counts, info = [], [], [], [], []
        for kind, a, b, c in zip(*(group.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
            if kind == 0:
                toks.append(packed.unplanes(a))
                owners.append(packed.unsmall(b))
            elif kind == 1:
                info.append((packed.unsmall(a), packed.unsmall(b), packed.unsmall(c)))
            else:
                ids.append(packed.unsmall(a))
                counts.append(packed.unsmall(b))
        if toks:
            tok, doc = np.concatenate(toks), np.concatenate(owners)
            order = np.argsort(tok, kind="stable")
            tok, doc = tok[order], doc[order]
            _, length = packed.runs(tok)
            d, k = np.unique(doc[np.repeat(length > 1, length) & (doc != _SHARED)], return_counts=True)
            ids.append(d)
            counts.append(k)
        out = []
        if ids:
            d, k = np.concatenate(ids), np.concatenate(counts)
            out += [(g, 0, packed.small(d[m]), packed.small(k[m]), b"") for g, m in _by_group(d, n_groups)]
        if info:
            d, n, sig = (np.concatenate([x[c] for x in info]) for c in range(3))
            out += [(g, 1, packed.small(d[m]), packed.small(n[m]), packed.small(sig[m])) for g, m in _by_group(d, n_groups)]
        return pa.Table.from_batches([_pack(out)])

    def add(group: pa.Table) -> pa.Table:
        parts: dict[int, list] = {0: [], 1: []}
        for kind, a, b, c in zip(*(group.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
            parts[kind].append((packed.unsmall(a), packed.unsmall(b), packed.unsmall(c)))
        d, n, sig = (np.concatenate([x[c] for x in parts[1]]) if parts[1] else np.zeros(0, np.int64) for c in range(3))
        order = np.lexsort((sig, n, d))  # of rows that share an id the largest (size, signature) stands for it
        d, n, sig = d[order], n[order], sig[order]
        last = np.flatnonzero(np.append(d[1:] != d[:-1], True)) if len(d) else np.zeros(0, np.int64)
        d, n, sig = d[last], n[last], sig[last]
        shared = np.zeros(len(d), dtype=np.int64)
        for x, k, _ in parts[0]:
            np.add.at(shared, np.searchsorted(d, x), k)
        return pa.table({"doc_id": pa.array(d), "n": pa.array(n), "sig": pa.array(sig), "shared": pa.array(shared)})

    rows = docs.where("doc_id is not null").mapInArrow(lean.batches(scan), _PACK)
    found = rows.groupBy("bucket").applyInArrow(lean.group(gather), _PACK)
    out = found.groupBy("bucket").applyInArrow(lean.group(add), "doc_id long, n long, sig long, shared long")
    least = F.ceil(F.col("n") * percent / 100)
    return cut(out.withColumn("demand", F.greatest(F.lit(1), F.ceil(least * FIRST_LEVEL / 100))), "ngram-docs")


def _by_group(doc: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The hash groups of documents that occur, with the places of their members."""
    g = ((doc ^ (doc >> 7) ^ (doc >> 17) ^ (doc >> 31)) % n).astype(np.int64)
    order = np.argsort(g, kind="stable")
    first, length = packed.runs(g[order])
    for f, k in zip(first.tolist(), length.tolist(), strict=True):
        yield int(g[order[f]]), order[f : f + k]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "kind", "a", "b", "c"])


def _sets(docs: DataFrame, reps: DataFrame, width: int, n_groups: int) -> DataFrame:
    """``ent, gid, tokens`` of the chosen texts.  ``reps``: ``ent, n, sig``; of the texts of an id only the one with this set is taken.  The broadcast
    is used only when the counted number of ids is small."""
    ids = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    chosen = docs.join(ids, docs.doc_id == reps.ent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sign = (batch.column(c).to_numpy() for c in (2, 3))
            for i, j, buf, offs in T.blocks(batch.column(1)):
                h, at = T.shingle_sets(buf, offs, width)
                n, sig = _signatures(h, at)
                own = pa.array((n == size[i:j]) & (sig.view(np.int64) == sign[i:j]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=["ent", "tokens"]).filter(own)

    sets = chosen.select("doc_id", "text", "n", "sig").mapInArrow(lean.batches(run), "ent long, tokens array<long>")
    gid = F.pmod(F.xxhash64("ent"), F.lit(n_groups)).cast("int")
    return cut(sets.withColumn("gid", gid).repartition(n_groups, "gid"), "ngram-sets")


def _signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and signature of each set."""
    n = np.diff(at)
    sig = np.zeros(len(n), dtype=np.uint64)
    some = n > 0
    if some.any():
        sig[some] = np.add.reduceat(T.mix(h), at[:-1][some])
    return n, sig


def _frequencies(sets: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """``ent, n, level, tokens, df``: elements in rare-first order with their frequency (elements of one document only are
    left out but counted in n), and the adaptive level."""

    def local(group: pa.Table) -> pa.Table:
        tok, length, _ = _flat(group)
        u, k = np.unique(tok, return_counts=True)
        at = packed.edges(u, n_buckets)
        gid = group.column("gid")[0].as_py()
        rows = [(b, gid, packed.planes(u[at[b] : at[b + 1]]), packed.small(k[at[b] : at[b + 1]]), b"") for b in range(n_buckets) if at[b + 1] > at[b]]
        return pa.Table.from_batches([_pack(rows)])

    def total(group: pa.Table) -> pa.Table:
        gids = group.column("kind").to_pylist()
        toks = [packed.unplanes(x) for x in group.column("a").to_pylist()]
        ks = [packed.unsmall(x) for x in group.column("b").to_pylist()]
        tok, k = np.concatenate(toks), np.concatenate(ks)
        order = np.argsort(tok, kind="stable")
        first, length = packed.runs(tok[order])
        df = np.empty(len(tok), dtype=np.int64)
        df[order] = np.repeat(np.add.reduceat(k[order], first), length) if len(first) else 0
        out, at = [], 0
        for gid, t in zip(gids, toks, strict=True):
            d = df[at : at + len(t)]
            at += len(t)
            if (d > 1).any():
                out.append((0, gid, packed.planes(t[d > 1]), packed.small(d[d > 1]), b""))
        return pa.Table.from_batches([_pack(out)])

    def rank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("ent", pa.int64()), ("n", pa.int64()), ("level", pa.int64()), ("tokens", pa.list_(pa.int64())), ("df", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        known = np.concatenate([packed.unplanes(x) for x in right.column("a").to_pylist()])
        df = np.concatenate([packed.unsmall(x) for x in right.column("b").to_pylist()])
        order = np.argsort(known)
        known, df = known[order], df[order]
        tok, length, ents = _flat(left)
        owner = np.repeat(np.arange(len(length)), length)
        at = np.minimum(np.searchsorted(known, tok), len(known) - 1)
        f = np.where(known[at] == tok, df[at], 1)
        order = np.lexsort((tok, f, owner))
        tok, f, owner = tok[order], f[order], owner[order]
        shared = np.bincount(owner, weights=f > 1, minlength=len(length)).astype(np.int64)
        good = shared >= _need(length, percent)
        level = _levels(f, length, percent)
        keep = (f > 1) & good[owner]
        offs = np.concatenate(([0], np.cumsum(shared[good])))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(x))
        return pa.table({"ent": pa.array(ents[good]), "n": pa.array(length[good]), "level": pa.array(level[good]), "tokens": lists(tok[keep].view(np.int64)), "df": lists(f[keep])}, schema=schema)

    counts = sets.groupBy("gid").applyInArrow(lean.group(local), _PACK)
    shared = counts.groupBy("bucket").applyInArrow(lean.group(total), _PACK)
    ranked = sets.groupBy("gid").cogroup(shared.groupBy("kind")).applyInArrow(lean.groups(rank), "ent long, n long, level long, tokens array<long>, df array<long>")
    return cut(ranked, "ngram-ranked")


def _flat(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = group.column("tokens").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    length = np.diff(col.offsets.to_numpy()).astype(np.int64)
    return col.flatten().to_numpy().view(np.uint64), length, group.column("ent").to_numpy()


def _levels(f: np.ndarray, length: np.ndarray, percent: int) -> np.ndarray:
    """The level of least estimated cost of each set (f: frequencies, set after set, ascending in each)."""
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    total = np.concatenate(([0], np.cumsum(f - 1)))
    best, out = np.full(len(length), np.inf), np.ones(len(length), dtype=np.int64)
    base = length - _need(length, percent)
    for lv in LEVELS:
        fits = lv <= np.maximum(1, _need(length, percent))
        end = np.minimum(begin + base + lv, begin + length)
        postings = (total[end] - total[begin]).astype(float)
        cost = np.where(fits, postings + postings / lv * VERIFY_COST * np.maximum(1.0, length / 16), np.inf)
        better = cost < best
        best[better], out[better] = cost[better], lv
    return out


def _postings(ranked: DataFrame, percent: int) -> DataFrame:
    """``token, ent, n, level, lv, at, s``: lv is the level from which the element is in the prefix, at its place in the order, s
    the number of the set's elements that other sets hold.

    Elements of one document only come first in the order and are not in the list: they take prefix places."""
    base = F.col("n") - F.ceil(F.col("n") * percent / 100)
    alone = F.col("n") - F.size("tokens")
    take = F.greatest(F.lit(0), F.least(F.size("tokens").cast("long"), base + F.col("level") - alone)).cast("int")
    rows = ranked.select("ent", "n", "level", F.size("tokens").cast("long").alias("s"), alone.alias("alone"), base.alias("base"), F.posexplode(F.slice("tokens", F.lit(1), take)).alias("pos", "token"))
    at = (F.col("alone") + F.col("pos") + 1).cast("long")
    return rows.select("token", "ent", "n", "level", F.greatest(F.lit(1), at - F.col("base")).cast("long").alias("lv"), at.alias("at"), "s")


def _met(left: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of different labels that share as many prefix elements as their level demands.

    A pair that links shares at least ``need`` elements, so it does within the first ``n - need + l`` places of both sets, and
    each of the two has that many elements that are not its own alone."""
    cols = ("ent", "n", "level", "lv", "at", "label", "s")
    minor = left.where("label <> major").select("token", *(F.col(c).alias(f"{c}_x") for c in cols))
    rival = left.select("token", "major", *(F.col(c).alias(f"{c}_y") for c in cols))
    level = F.least("level_x", "level_y")
    both = F.col("n_x") + F.col("n_y")
    need = F.ceil(both * percent / (100 + percent))
    fits = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (F.least("s_x", "s_y") >= need)
    inside = (F.greatest("lv_x", "lv_y") <= level) & (F.greatest(F.col("at_x") - F.col("n_x"), F.col("at_y") - F.col("n_y")) + need <= level)
    met = minor.join(rival, "token").where("label_x <> label_y and (label_y = major or ent_x < ent_y)").where(fits & inside)
    pairs = met.groupBy(F.least("ent_x", "ent_y").alias("a"), F.greatest("ent_x", "ent_y").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.max(level).alias("l"))
    return pairs.where("k >= l").select("a", "b")


def _hot_links(left: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Links between labels among the sets that meet in a hot element.

    Every set outside the element's largest component is a query against all sets that hold an element of that kind.  Both sides are
    dealt to tiles of at most about ``TILE`` elements each; a tile counts the common prefix elements of its pairs, verifies those that share as
    many as their level demands, and returns a spanning forest of the labels that it found linked, so no more rows than labels."""
    met = left.groupBy(F.col("major").alias("g"), "ent", "label").agg(F.max(F.col("label") != F.col("major")).alias("asks"), F.first("n").alias("n"), F.first("s").alias("s"))
    # a set none of whose partners can reach the need (even the smallest allowed) asks nothing
    asks = F.col("asks") & (F.col("s") >= F.ceil((F.col("n") + F.ceil(F.col("n") * percent / 100)) * percent / (100 + percent)))
    met = cut(met.withColumn("asks", asks), "ngram-hot")
    size = met.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.sum("s") / TILE)).cast("int").alias("tiles_y"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("asks"), F.col("s")).otherwise(0)) / TILE)).cast("int").alias("tiles_x"), F.max("asks").alias("any")).where("any")
    dealt = met.join(size, "g")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64("ent", F.lit(salt)), F.col(n)).cast("int")
    x = dealt.where("asks").select("g", mine("tiles_x", 1).alias("tx"), every("tiles_y").alias("ty"), F.lit(True).alias("asks"), "ent", "label", "n")
    y = dealt.select("g", every("tiles_x").alias("tx"), mine("tiles_y", 2).alias("ty"), F.lit(False).alias("asks"), "ent", "label", "n")
    rows = x.unionByName(y).join(ranked.select("ent", "level", "tokens"), "ent")

    def tile(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        found = _tile_links(group.filter(pa.array(asks)), group.filter(pa.array(~asks)), percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return cut(rows.groupBy("g", "tx", "ty").applyInArrow(lean.group(tile), "a long, b long"), "ngram-hot-links")


def _tile_links(x: pa.Table, y: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked labels, as pairs of sets."""
    if not x.num_rows or not y.num_rows:
        return []
    tx, lx, ex = _flat(x)
    ty, ly, ey = _flat(y)
    nx, ny = x.column("n").to_numpy(), y.column("n").to_numpy()
    vx, vy = x.column("level").to_numpy(), y.column("level").to_numpy()
    px, py = _prefix(lx, nx, vx, percent), _prefix(ly, ny, vy, percent)
    starts = np.intersect1d(tx[_first_of(lx, px)], ty[_first_of(ly, py)])
    if not len(starts):
        return []
    vocabulary = np.intersect1d(tx, ty)
    gx, gy = x.column("label").to_numpy(), y.column("label").to_numpy()
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    step = max(1, (1 << 22) // max(1, len(vocabulary)))
    out = []
    for i in range(0, len(ex), step):
        a, head = _matrix(tx, lx, lx, i, i + step, vocabulary), _matrix(tx, lx, px, i, i + step, starts)
        for j in range(0, len(ey), step):
            met = np.rint(head @ _matrix(ty, ly, py, j, j + step, starts).T)
            wanted = met >= np.minimum(vx[i : i + step, None], vy[None, j : j + step])
            if not wanted.any():
                continue
            common = np.where(wanted, np.rint(a @ _matrix(ty, ly, ly, j, j + step, vocabulary).T), 0).astype(np.int64)
            linked = (common * 100 >= (nx[i : i + step, None] + ny[None, j : j + step] - common) * percent) & (gx[i : i + step, None] != gy[None, j : j + step])
            r, c = np.nonzero(linked)
            _, first = np.unique(np.stack((gx[i + r], gy[j + c])), axis=1, return_index=True)
            for k in first.tolist():
                u, v = find(int(gx[i + r[k]])), find(int(gy[j + c[k]]))
                if u != v:
                    root[u] = v
                    out.append((int(ex[i + r[k]]), int(ey[j + c[k]])))
    return out


def _prefix(length: np.ndarray, n: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """How many of the shared elements of each set its prefix holds: those of one document only come first in it."""
    return np.clip(n - _need(n, percent) + level - (n - length), 0, length)


def _first_of(length: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Places of the first ``take`` elements of each set."""
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    return np.arange(take.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(take)[:-1])), take)


def _matrix(tok: np.ndarray, length: np.ndarray, take: np.ndarray, i: int, j: int, vocabulary: np.ndarray) -> np.ndarray:
    """The first ``take`` elements of sets i to j as rows of zeros and ones over the vocabulary."""
    begin = np.concatenate(([0], np.cumsum(length)))
    j = min(j, len(length))
    t = tok[begin[i] : begin[j]][_first_of(length[i:j], take[i:j])]
    row = np.repeat(np.arange(j - i), take[i:j])
    at = np.minimum(np.searchsorted(vocabulary, t), len(vocabulary) - 1) if len(vocabulary) else np.zeros(0, np.int64)
    out = np.zeros((j - i, len(vocabulary)), dtype=np.float32)
    if len(vocabulary):
        hit = vocabulary[at] == t
        out[row[hit], at[hit]] = 1
    return out


def _verify(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    left = ranked.select(F.col("ent").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = ranked.select(F.col("ent").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "na", "nb", common.alias("i")).where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: see the module's text."""
    spark = docs.sparkSession
    width_of = shuffle_width(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = _first_pass(plain, width, percent, 4 * width_of, width_of)
    copies = cut(scanned.where("n > 0").groupBy("n", "sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k"), F.max("shared").alias("shared"), F.max("demand").alias("demand")).select("rep", "n", "sig", "k", (F.col("shared") >= F.col("demand")).alias("alive")), "ngram-copies")
    sets = _sets(plain, copies.where("alive").select(F.col("rep").alias("ent"), "n", "sig"), width, 2 * width_of)
    ranked = _frequencies(sets, 2 * width_of, percent)
    posts = cut(_postings(ranked, percent), "ngram-postings")

    # stars: the leader of a posting list is its member with most shared elements
    heads = posts.groupBy("token").agg(F.max_by("ent", F.struct("s", -F.col("ent"))).alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "a")
    heads = cut(heads, "ngram-heads")
    votes = posts.join(heads, "token").where("a <> ent").groupBy("ent", "a").agg(F.count(F.lit(1)).alias("votes"))
    star = votes.groupBy("ent").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", F.col("ent").alias("b"))
    links = cut(_verify(star, ranked, percent), "ngram-links")
    labels = cut(components(links), "ngram-labels")

    # the rest: pairs of different components with enough common prefix elements
    lab = posts.join(labels, posts.ent == labels.node, "left").select("token", "ent", "n", "level", "lv", "at", "s", F.coalesce("root", "ent").alias("label"))
    lab = cut(lab, "ngram-labelled")
    by_label = lab.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_label.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", -F.col("label"))).alias("major"), F.sum("k").alias("k"), F.max("k").alias("most")).where("labels > 1")
    mixed = cut(mixed.select("token", "major", (F.col("k") * (F.col("k") - F.col("most")) > HOT_PAIRS).alias("hot")), "ngram-mixed")
    left = cut(lab.join(mixed, "token"), "ngram-meeting")
    met = _met(left.where("not hot"), percent)
    more = _verify(cut(met, "ngram-pairs"), ranked, percent).unionByName(_hot_links(left.where("hot"), ranked, percent))
    roots = cut(components(links.unionByName(more)), "ngram-roots")

    again = copies.where("k > 1").select(F.col("n").alias("n2"), F.col("sig").alias("s2"), "rep")
    out = scanned.join(again, (F.col("n") == F.col("n2")) & (F.col("sig") == F.col("s2")), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return out.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked, directly or through others, with an earlier one.

    Rows are judged by (id, text): different texts of one id are documents of their own, and the earlier one has the smaller id or, within an id,
    the smaller digest.  Of rows that repeat both one stays; rows with a null id stay.  Where no id has different texts, only ids take part in
    shuffles while their counted number allows a broadcast; otherwise documents are numbered in that order, which shuffles them once."""
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    key, body = names[cols.index(doc_id)], names[cols.index(text)]
    plain = docs.toDF(*names)
    digest = F.sha2(F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary"), 256)
    named = plain.where(F.col(key).isNotNull())
    twice = cut(named.groupBy(F.col(key).alias("twice")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("twice"), "ngram-repeated")
    if twice.isEmpty():
        return _first_of_groups(plain, key, body, width, percent).toDF(*cols)
    again = named.join(twice, F.col(key) == F.col("twice"), "left_semi")
    if again.groupBy(key).agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").isEmpty():
        numbered, number = plain, key
    else:
        # in order of (id, digest), so are the numbers; they are written before they are used
        order = cut(named.select(F.col(key).alias("i"), digest.alias("d")).distinct().orderBy("i", "d").withColumn("number", F.monotonically_increasing_id()), "ngram-numbers")
        numbered, number = plain.join(order, (F.col(key) == F.col("i")) & (digest == F.col("d")), "left").drop("i", "d"), "number"
        numbered = cut(numbered, "ngram-numbered")
        twice = cut(numbered.where("number is not null").groupBy(F.col("number").alias("twice")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("twice"), "ngram-repeated")
    kept = _first_of_groups(numbered, number, body, width, percent)
    nth = Window.partitionBy(number).orderBy(F.to_json(F.struct(*names)))
    once = kept.join(twice, F.col(number) == F.col("twice"), "left_semi").withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("nth")
    return kept.join(twice, F.col(number) == F.col("twice"), "left_anti").unionByName(once).select(*names).toDF(*cols)


def _first_of_groups(plain: DataFrame, key: str, body: str, width: int, percent: int) -> DataFrame:
    """The rows whose key is the smallest of its group, or null."""
    found = cut(similar_components(plain, key, body, width, percent), "ngram-groups")
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias("lost"))
    ids = F.broadcast(losers) if losers.count() <= BROADCAST_IDS else losers
    return plain.join(ids, F.col(key) == F.col("lost"), "left_anti")
