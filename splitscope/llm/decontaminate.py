"""Operator 10 - benchmark decontamination by pigeonhole edit matching.

A test item of m normalised bytes may occur with up to ``e = percent * m / 100`` edits.  Cut into e + 1 pieces, at least
one piece of every such occurrence is unchanged, so the exact hits of all pieces (one pass of an Aho-Corasick
automaton over each text) find every place worth a look.  A hit is verified upwards: pieces are joined two by two, a
node of k pieces may hold k - 1 edits, and an occurrence of the item passes at every node above one of its unchanged
pieces; distances are Myers' bit-parallel ones.  Chance hits end at the first node.

Normalised: A-Z lower-cased, every run of ASCII bytes that are neither letters nor digits is one space, none at the ends; other bytes stay.

The items are written to the shared folder in blocks of about ``BLOCK_BYTES``.  A task gathers the texts of about ``TEXT_BYTES`` and takes the blocks in
turn, so it holds one block's automaton beside them, however large the benchmark is (with one block the automaton stays); the driver
sees no item, and documents are not shuffled.

Defined results: null texts hold nothing; items that are null or empty once normalised are ignored; an item too short for an edit (below 100 / ``PERCENT``
bytes) must stand between word borders; rows of one id are judged each by itself; items that repeat an id are one item with several texts, the nearest
counts; empty tables give empty or clean results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lean
from . import textops as T
from .common import scratch_path

PERCENT = 9
BLOCK_BYTES = 4 << 20
TEXT_BYTES = 32 << 20

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)]


def normalise_block(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of a block and their offsets (a text may keep one space at its end)."""
    x = _PLAIN[buf]
    space = x == 0x20
    before = np.ones(len(x), dtype=bool)
    before[1:] = space[:-1]
    before[offs[:-1][offs[:-1] < len(x)]] = True
    keep = ~(space & before)
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def normalise(text: str) -> str:
    """The normalised form, one character for each byte."""
    b = np.frombuffer(text.encode(), np.uint8)
    return normalise_block(b, np.array([0, len(b)]))[0].tobytes().decode("latin-1").strip()


class _Pattern:
    """Myers' search for one pattern with at most ``budget`` edits."""

    def __init__(self, pattern: str, budget: int):
        self.m, self.budget = len(pattern), budget
        self.ones, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance to a substring, and where the first such substring ends."""
        pv, mv, score, eq, ones, top = self.ones, 0, self.m, self.eq.get, self.ones, self.top
        least, end = score, 0
        for i, c in enumerate(text):
            e = eq(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, end = score, i + 1
            ph <<= 1
            pv = (mh << 1 | ~(xv | ph)) & ones
            mv = ph & xv & ones
        return least, end


class _Item:
    def __init__(self, item_id: int, text: str, percent: int):
        self.item_id, self.text = item_id, text
        self.edits = len(text) * percent // 100
        k = self.edits + 1
        self.at = [len(text) * i // k for i in range(k + 1)]
        self.nodes: dict[tuple[int, int], _Pattern] = {}

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """The nodes above a piece, smallest first."""
        lo, hi, out = 0, len(self.at) - 1, []
        while hi - lo > 1:
            out.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if leaf < mid else (mid, hi)
        return out[::-1]

    def verify(self, leaf: int, text: str, start: int, lo: int, hi: int) -> int | None:
        """Distance of the occurrence around a piece that begins at ``text[start]``, within ``text[lo:hi]``."""
        least = 0
        for x, y in self.path(leaf):
            node = self.nodes.get((x, y))
            if node is None:
                node = self.nodes[x, y] = _Pattern(self.text[self.at[x] : self.at[y]], y - x - 1)
            a = max(lo, start - (self.at[leaf] - self.at[x]) - node.budget)
            b = min(hi, start + self.at[y] - self.at[leaf] + node.budget)
            least, _ = node.best(text[a:b])
            if least > node.budget:
                return None
        if self.edits == 0:
            end = start + len(self.text)
            if (start > lo and text[start - 1] != " ") or (end < hi and text[end] != " "):
                return None
        return least


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        import ahocorasick

        self.items = [_Item(i, t, percent) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for k in range(len(item.at) - 1):
                pieces.setdefault(item.text[item.at[k] : item.at[k + 1]], []).append((n, k))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def block(self, buf: np.ndarray, offs: np.ndarray) -> dict[int, dict[int, int]]:
        """Text index -> item id -> least distance found."""
        found: dict[int, dict[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        if not self.items:
            return found
        x, at = normalise_block(buf, offs)
        text = x.tobytes().decode("latin-1")
        hits = [(end, size, owners) for end, (size, owners) in self.automaton.iter(text)]
        docs = np.searchsorted(at, [h[0] for h in hits], side="right") - 1 if hits else []
        for (end, size, owners), doc in zip(hits, docs, strict=True):
            start, lo, hi = end + 1 - size, int(at[doc]), int(at[doc + 1])
            if start < lo:
                continue
            for n, leaf in owners:
                item = self.items[n]
                known = found.setdefault(int(doc), {})
                diagonal = (doc, n, start - item.at[leaf])
                if known.get(item.item_id) == 0 or diagonal in seen:
                    continue
                distance = item.verify(leaf, text, start, lo, hi)
                if distance is not None:
                    seen.add(diagonal)
                    known[item.item_id] = min(distance, known.get(item.item_id, distance))
        return {doc: ids for doc, ids in found.items() if ids}


def write_blocks(items: DataFrame, item_id: str, text: str) -> tuple[str, int]:
    """The folder of the items' blocks and the number of these."""
    plain = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    n = max(1, -(-(plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    path = scratch_path(items.sparkSession, "benchmark-blocks")
    plain.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")).repartition(n, "block").write.partitionBy("block").parquet(path)
    return path, n


def _read_block(path: str, block: int, percent: int) -> Matcher:
    fs, base = pafs.FileSystem.from_uri(path)
    files = fs.get_file_info(pafs.FileSelector(f"{base}/block={block}", allow_not_found=True))
    rows = [r for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet") for r in pq.ParquetFile(fs.open_input_file(f.path)).read(["i", "t"]).to_pylist()]
    return Matcher(sorted({(r["i"], t) for r in rows if (t := normalise(r["t"]))}), percent)


def _findings(path: str, n_blocks: int, percent: int, at: int):
    """For ``mapInArrow``: batches with the items that each row holds (id -> least distance)."""

    def judged(held: list[pa.RecordBatch], matcher: Matcher | None) -> Iterator[tuple[pa.RecordBatch, list[dict[int, int]]]]:
        found: list[list[dict[int, int]]] = [[{} for _ in range(b.num_rows)] for b in held]
        for block in range(n_blocks):
            one = matcher or _read_block(path, block, percent)
            for batch, rows in zip(held, found, strict=True):
                for i, _, buf, offs in T.blocks(batch.column(at)):
                    for k, ids in one.block(buf, offs).items():
                        for item, distance in ids.items():
                            rows[i + k][item] = min(distance, rows[i + k].get(item, distance))
        yield from zip(held, found, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict[int, int]]]]:
        matcher = _read_block(path, 0, percent) if n_blocks == 1 else None
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if matcher or size >= TEXT_BYTES:
                yield from judged(held, matcher)
                held, size = [], 0
        if held:
            yield from judged(held, matcher)

    return run


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, contaminated, item_ids, distances`` of every row: the items found, by id, with their least edit distance."""
    find = _findings(*write_blocks(items, item_id, item_text), percent, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in find(batches):
            rows = [sorted(x.items()) for x in found]
            ids, distances = (pa.array([[x[c] for x in r] for r in rows], pa.list_(pa.int64())) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(r) for r in rows]), ids, distances], names=["doc_id", "contaminated", "item_ids", "distances"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(lean.batches(run), "doc_id long, contaminated boolean, item_ids array<long>, distances array<long>")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents in which no item occurs, with the columns they came with; nothing is shuffled."""
    cols = docs.columns
    out = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    find = _findings(*write_blocks(items, item_id, item_text), percent, cols.index(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in find(batches):
            yield batch.filter(pa.array([not x for x in found])) if any(found) else batch

    return out.mapInArrow(lean.batches(run), out.schema).toDF(*cols)
