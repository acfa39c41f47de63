"""Operator 11 - alignment of two tokenizers by per-byte labels.

Every byte of a text gets a label: 0 none, 1 a token of A ends here, 2 a token of B ends here, 3 both.  A regular expression scans the
label string for spans up to each 3; the labels in a span say how many tokens of A and of B form the group.  Each pair of an A and a B token of
one group is a link.

1. *Labels and groups.*  Byte-level and piece vocabularies both break before a space that follows a visible character, so a label string is the
   concatenation of those of its segments, and each distinct segment is encoded once for as long as a task remembers it.  Label strings are
   built and scanned for a block of texts at a time.  A vocabulary with entries across such a place is applied to whole texts.
2. *Counts.*  In how many documents a pair of ids is linked: a task adds up the distinct pairs of its documents, Spark adds these.  The highest
   count of an A id is a table of at most the vocabulary of A, which is broadcast.
3. *Scores.*  The counts lie in the shared folder in slices of about ``SLICE`` pairs.  A task gathers documents with about ``HELD`` pairs and
   takes the slices in turn, so it holds one slice beside them, however many pairs there are (with one slice it stays).

Documents are never shuffled, and neither the driver nor a task sees the links of all of them.

Defined results: null and empty texts, and those whose tokens of either kind do not spell the text, have no tokens (zeros, and the empty text in
place of the digest); special tokens are plain text; rows that repeat an id, a text or have a null id are judged each by itself and each counts as a
document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lean, packed
from . import textops as T
from .common import cut, scratch_path

SLICE = 4_000_000  # 96 MB of keys, counts and marks
HELD = 4_000_000
MEMO = 300_000  # segments whose ids a task remembers
WIDE = 1 << 16  # links of a group from which its distinct ids are multiplied
_SETTLED = "ɐ"  # below it, libraries do not differ in what is a letter
# Fixed value: how byte-level vocabularies break texts.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPAN = re.compile(rb"[^3]*3")
_LABEL = bytes.maketrans(bytes(range(4)), b"0123")
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Encodes segments that begin with a space, and knows the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        letters = byte_level_alphabet()
        vocabulary = a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        apart_a = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        apart_b = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not (b.is_control(i) or b.is_unknown(i) or b.is_byte(i)))
        self.apart = bool(apart_a and apart_b)
        encode = getattr(a, "encode_batch_fast", a.encode_batch)
        self.encode_a = lambda texts: [x.ids for x in encode(texts, add_special_tokens=False)]
        self.ranked = _ranked(spec, vocabulary, letters) if apart_a else None
        self.encode_b = lambda texts: b.encode([t[1:] for t in texts], num_threads=1)  # B adds the space itself
        self.shift = max(1, (len(self.bytes_b) - 1).bit_length())


def _ranked(spec: dict, vocabulary: dict[str, int], letters: dict[str, int]):
    """The vocabulary as ranks, which a faster library applies alike, or None where ids are not in the order of the merges."""
    model = spec["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    own = [vocabulary.get(x + y, -1) for x, y in merges]
    known = {bytes(letters[c] for c in t): i for t, i in model.get("vocab", {}).items() if all(c in letters for c in t)}
    plain = not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if model.get("type") != "BPE" or not plain or sorted(own) != own or len(set(own)) < len(own) or any(bytes([b]) not in known for b in range(256)):
        return None
    made = set(own) | {known[bytes([b])] for b in range(256)}
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks={t: i for t, i in known.items() if i in made}, special_tokens={})


def label_string(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """The label of each byte; ``ends``: places after the last byte of each token."""
    labels = np.zeros(size, np.uint8)
    labels[ends_a - 1] += 1
    labels[ends_b - 1] += 2
    return labels.tobytes().translate(_LABEL)


class _Ids:
    """Lists of ids end to end, which grow."""

    def __init__(self):
        self.flat, self.at = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def add(self, new: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.at[-1])
        if used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat[:used], new, np.zeros(max(len(self.flat), len(new)), np.int32)))
        self.flat[used : used + len(new)] = new
        self.at = np.append(self.at, used + np.cumsum(sizes))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists end to end, and how many each has."""
        size = self.at[which + 1] - self.at[which]
        return self.flat[_places(self.at[which], size)].astype(np.int64), size


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists end to end, and how long each is."""
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


class _Spans(dict):
    """Numbers of the different spans, with the tokens of A and of B that each holds."""

    def __init__(self):
        self.sizes: list[tuple[int, int]] = []

    def __missing__(self, span: bytes) -> int:
        self[span] = len(self.sizes)
        self.sizes.append((span.count(b"1") + 1, span.count(b"2") + 1))
        return self[span]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for as many as ``size`` says, run after run."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Aligner:
    """Aligns blocks of texts; the ids of segments are remembered."""

    def __init__(self, path_a: str, path_b: str):
        self.t = Tokenizers(path_a, path_b)
        self.length = tuple(np.array([len(x) for x in side] or [0]) for side in (self.t.bytes_a, self.t.bytes_b))
        # an id with what follows it in a group's text
        self.spelt = tuple({c: np.array([f"{i}{c}".encode() for i in range(len(side))], dtype=object) for c in ends} for side, ends in ((self.t.bytes_a, ",|"), (self.t.bytes_b, ",;")))
        self.forget()

    def forget(self) -> None:
        self.kinds = _Spans()
        self.memo: dict[int, int] = {}
        self.ids = _Ids(), _Ids()
        self.good = np.zeros(0, bool)

    def _spaced(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with a space before each."""
        n = len(offs) - 1
        out = np.empty(len(buf) + n, np.uint8)
        at = offs + np.arange(n + 1)
        head = np.zeros(len(out), bool)
        head[at[:-1]] = True
        out[head], out[~head] = 0x20, buf
        return out, at

    def _segments(self, full: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment its text, its bytes' number, and its place in the memory."""
        begin = np.zeros(len(full), bool)
        if self.t.apart and len(full) > 1:
            begin[1:] = (full[1:] == 0x20) & (full[:-1] > 0x20) & (full[:-1] < 0x7F)
            begin[at[1:] - 1] = False  # a lone space at the end is no segment: B adds none to nothing
        begin[at[:-1]] = True
        s = np.flatnonzero(begin)
        e = np.append(s[1:], len(full))
        key, first, inverse = np.unique(T.span_hash(full, s, e), return_index=True, return_inverse=True)
        if len(self.memo) + len(key) > MEMO:
            self.forget()
        miss = [k for k, h in enumerate(key.tolist()) if h not in self.memo]
        if miss:
            raw = full.tobytes()
            spelt = [raw[s[k] : e[k]] for k in first[miss].tolist()]
            self.memo.update(zip(key[miss].tolist(), range(len(self.good), len(self.good) + len(miss)), strict=True))
            self._encode(spelt)
        place = np.array([self.memo[h] for h in key.tolist()], np.int64)
        return np.searchsorted(at, s, side="right") - 1, e - s, place[inverse]

    def _encode(self, spelt: list[bytes]) -> None:
        """Remember the ids of these segments, and whether they spell them."""
        texts = [x.decode() for x in spelt]
        sides = self._ids_a(spelt, texts), _flat(self.t.encode_b(texts))
        size = np.array([len(x) for x in spelt])
        good = np.ones(len(spelt), bool)
        for ids, length, table, (flat, counts) in zip(self.ids, self.length, (self.t.bytes_a, self.t.bytes_b), sides, strict=True):
            ids.add(flat, counts)
            end = np.cumsum(counts)
            up = np.concatenate(([0], np.cumsum(length[flat])))
            good &= up[end] - up[end - counts] == size
            if b"".join([table[i] for i in flat.tolist()]) != b"".join(spelt):
                good &= [b"".join([table[i] for i in flat[e - k : e].tolist()]) == x for e, k, x in zip(end.tolist(), counts.tolist(), spelt, strict=True)]
        self.good = np.append(self.good, good)

    def _ids_a(self, spelt: list[bytes], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, segment after segment, and how many each has.  Segments that end with a visible character are encoded as one text."""
        fast = np.array([self.t.ranked is not None and 0x20 < x[-1] < 0x7F and (t.isascii() or max(t) < _SETTLED) for x, t in zip(spelt, texts, strict=True)])
        slow = np.flatnonzero(~fast).tolist()
        flat, counts = _flat(self.t.encode_a([texts[k] for k in slow]))
        if len(slow) == len(texts):
            return flat, counts
        many = np.array(self.t.ranked.encode_ordinary("".join(itertools.compress(texts, fast))), np.int32)
        end = np.cumsum(np.array([len(x) for x in itertools.compress(spelt, fast)]))
        each = np.diff(np.searchsorted(np.cumsum(self.length[0][many]), end, side="right"), prepend=0)
        size = np.zeros(len(texts), np.int64)
        size[fast], size[~fast] = each, counts
        start = np.zeros(len(texts), np.int64)
        start[fast], start[~fast] = np.cumsum(each) - each, len(many) + np.cumsum(counts) - counts
        return np.concatenate((many, flat))[_places(start, size)], size

    def _groups(self, ends: list[np.ndarray], size: int) -> np.ndarray:
        """Tokens of A and of B in each group, by scanning the label string."""
        spans = _SPAN.findall(label_string(*ends, size).translate(None, b"0"))  # bytes without an end say nothing
        kind = np.fromiter(map(self.kinds.__getitem__, spans), np.int64, len(spans))
        return np.array(self.kinds.sizes, np.int64).reshape(-1, 2)[kind]

    def block(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple]:
        """For each text ``n_a, n_b, n_groups, n_links, digest, distinct pairs, times``."""
        n = len(offs) - 1
        full, at = self._spaced(buf, offs)
        doc, size, place = self._segments(full, at)
        bad = np.diff(offs) == 0
        bad[doc[~self.good[place]]] = True
        keep = ~bad[doc]
        doc, size, place = doc[keep], size[keep], place[keep]
        ids, counts = zip(*(side.take(place) for side in self.ids), strict=True)
        ends = [np.cumsum(length[x]) for length, x in zip(self.length, ids, strict=True)]
        m = self._groups(ends, int(size.sum()))
        owner = [np.repeat(doc, k) for k in counts]
        n_tokens = [np.bincount(o, minlength=n) for o in owner]
        start = np.cumsum(m, axis=0) - m
        group_doc = owner[0][start[:, 0]] if len(m) else np.zeros(0, np.int64)
        n_groups = np.bincount(group_doc, minlength=n)
        pairs, times, pair_doc = self._links(ids, m, start, group_doc)
        edge = np.searchsorted(pair_doc, np.arange(n + 1))
        text = self._text(ids, m)
        word = np.concatenate(([0], np.cumsum(n_tokens[0] + n_tokens[1])))
        for d in range(n):
            if bad[d]:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            own = slice(edge[d], edge[d + 1])
            digest = hashlib.sha256(b"".join(text[word[d] : word[d + 1]])[:-1]).hexdigest()
            yield int(n_tokens[0][d]), int(n_tokens[1][d]), int(n_groups[d]), int(times[own].sum()), digest, pairs[own], times[own]

    def _links(self, ids: tuple, m: np.ndarray, start: np.ndarray, group_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids of each text in order, how often each occurs, and the text."""
        k = m[:, 0] * m[:, 1]
        wide = k > WIDE
        many = np.where(wide, 0, k)
        g = np.repeat(np.arange(len(m)), many)
        nth = _places(np.zeros(len(m), np.int64), many)
        bits = self.t.shift + max(1, (len(self.t.bytes_a) - 1).bit_length())
        key = group_doc[g] << bits | ids[0][start[g, 0] + nth // m[g, 1]] << self.t.shift | ids[1][start[g, 1] + nth % m[g, 1]]
        if not wide.any():
            key.sort()
            first, times = packed.runs(key)
            return key[first] & ((1 << bits) - 1), times, key[first] >> bits
        keys, counts = [key], [np.ones(len(key), np.int64)]
        for w in np.flatnonzero(wide).tolist():  # by distinct ids: a long group costs no more than its pairs of ids
            (a, x), (b, y) = (np.unique(i[f : f + c], return_counts=True) for i, f, c in zip(ids, start[w], m[w], strict=True))
            keys.append((group_doc[w] << bits | a[:, None] << self.t.shift | b).ravel())
            counts.append((x[:, None] * y).ravel())
        key, times = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        first, _ = packed.runs(key[order])
        return key[order][first] & ((1 << bits) - 1), np.add.reduceat(times[order], first), key[order][first] >> bits

    def _text(self, ids: tuple, m: np.ndarray) -> list[bytes]:
        """The ids of each group, A before B, each with what follows it."""
        out = np.empty(len(ids[0]) + len(ids[1]), dtype=object)
        before = np.cumsum(m.sum(1)) - m.sum(1)
        for c, inner, last in ((0, ",", "|"), (1, ",", ";")):
            where = _places(before + (m[:, 0] if c else 0), m[:, c])
            end = np.zeros(len(where), bool)
            end[np.cumsum(m[:, c]) - 1] = True
            spelt = self.spelt[c][inner][ids[c]]
            spelt[end] = self.spelt[c][last][ids[c][end]]
            out[where] = spelt
        return out.tolist()


@functools.cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One pair of models per Python worker: workers outlive tasks."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (doc_id, text) with the counts and the digest of their groups, distinct linked pairs of ids (packed) and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        aligner.forget()
        for batch in batches:
            for i, j, buf, offs in T.blocks(batch.column(1)):
                rows = list(aligner.block(buf, offs))
                cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
                digest = pa.array([r[4] for r in rows], pa.string())
                pairs = pa.array([packed.planes(r[5].view(np.uint64)) for r in rows], pa.binary())
                times = pa.array([packed.small(r[6]) for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols, digest, pairs, times], names=[c.split()[0] for c in _ALIGNED.split(", ")])
        aligner.forget()

    return docs.mapInArrow(lean.batches(run), _ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, k``: in how many rows of :func:`aligned` each pair of ids occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def settle() -> None:
            nonlocal keys, counts, held, size
            if held:
                new, k = np.unique(np.concatenate(held), return_counts=True)
                every, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
                keys, counts = every, np.bincount(back, weights=np.concatenate((counts, k)), minlength=len(every)).astype(np.int64)
                held, size = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["pair", "k"])

        for batch in batches:
            for x in batch.column(0):
                held.append(packed.unplanes(x.as_py()).view(np.int64))
                size += len(held[-1])
                if size >= packed.FLUSH:
                    settle()
                    if len(keys) >= packed.FLUSH:
                        yield from emit()
                        keys, counts = keys[:0], counts[:0]
        settle()
        yield from emit()

    return found.select("pairs").mapInArrow(lean.batches(run), "pair long, k long").groupBy("pair").agg(F.sum("k").alias("k"))


def _slices(counts: DataFrame, shift: int, size: int) -> tuple[str, int]:
    """The folder of the slices of ``pair, k, best`` and their number; ``best``: no pair of the same A id counts more."""
    n = max(1, -(-counts.count() // size))
    a = F.shiftright("pair", shift)
    most = counts.groupBy(a.alias("a")).agg(F.max("k").alias("most"))  # at most the vocabulary of A
    rows = counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "k", (F.col("k") == F.col("most")).alias("best"))
    path = scratch_path(counts.sparkSession, "alignment-slices")
    rows.withColumn("slice", F.pmod(F.xxhash64("pair"), F.lit(n)).cast("int")).write.partitionBy("slice").parquet(path)
    return path, n


def _read_slice(path: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, their counts and marks."""
    fs, base = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/slice={k}", allow_not_found=True)) if f.path.endswith(".parquet"))
    parts = [pq.ParquetFile(fs.open_input_file(f)).read(["pair", "k", "best"]) for f in files]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    pair, count, best = (pa.concat_tables(parts).column(c).to_numpy() for c in range(3))
    order = np.argsort(pair)
    return pair[order], count[order], best[order].astype(bool)


def _scores(path: str, n_slices: int, held_pairs: int):
    """For ``mapInArrow``: rows of :func:`aligned` with ``n_best`` and ``count_sum`` in place of their pairs."""

    def judged(held: list[pa.RecordBatch], one: tuple | None) -> Iterator[pa.RecordBatch]:
        pairs = [[packed.unplanes(x.as_py()).view(np.int64) for x in b.column(6)] for b in held]
        flat = np.concatenate([x for p in pairs for x in p]) if held else np.zeros(0, np.int64)
        times = np.concatenate([packed.unsmall(x.as_py()) for b in held for x in b.column(7)])
        row = np.repeat(np.arange(sum(map(len, pairs))), [len(x) for p in pairs for x in p])
        n_rows = sum(map(len, pairs))
        best, total = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
        for k in range(n_slices):
            known, count, mark = one or _read_slice(path, k)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = np.flatnonzero(known[at] == flat)
            at, m = at[hit], times[hit]
            np.add.at(best, row[hit], np.where(mark[at], m, 0))
            np.add.at(total, row[hit], m * count[at])
        done = 0
        for b in held:
            cols = [pa.array(x[done : done + b.num_rows]) for x in (best, total)]
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), *cols, b.column(5)], names=[c.split()[0] for c in _SCORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _read_slice(path, 0) if n_slices == 1 else None
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(6).nbytes // 8
            if size >= held_pairs:
                yield from judged(held, one)
                held, size = [], 0
        if held:
            yield from judged(held, one)

    return run


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text", slice_pairs: int = SLICE, held_pairs: int = HELD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = cut(aligned(plain, tokenizer_a, tokenizer_b), "alignment")
    counts = cut(pair_counts(found), "alignment-pairs")
    shift = _shift(tokenizer_b)
    path, n = _slices(counts, shift, slice_pairs)
    return found.mapInArrow(lean.batches(_scores(path, n, held_pairs)), _SCORED)


def links(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b, n_docs``: the linked pairs of ids and in how many documents each occurs."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shift = _shift(tokenizer_b)
    return pair_counts(aligned(plain, tokenizer_a, tokenizer_b)).select(F.shiftright("pair", shift).alias("a"), F.col("pair").bitwiseAND((1 << shift) - 1).alias("b"), F.col("k").alias("n_docs"))


def _shift(tokenizer_b: str) -> int:
    """Bits of an id of B."""
    import sentencepiece

    return max(1, (sentencepiece.SentencePieceProcessor(model_file=tokenizer_b).get_piece_size() - 1).bit_length())
