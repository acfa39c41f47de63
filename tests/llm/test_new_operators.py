"""Alignment, whitening and top-k search against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from splitscope.llm import alignment, maxscore, oracles, whitening

KINDS = "doc_id long, text string, n_a string, pairs int"


def plain_alignment(texts, a, b):
    """For each text the columns of the report, from whole encodings."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(a)
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=b)
    letters, named = alignment.byte_level_alphabet(), {i: t for t, i in one.get_vocab().items()}
    bytes_a = lambda i: bytes(letters[c] for c in named[i])
    bytes_b = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        found.append(None)
        if not t:
            continue
        sides = [[(i, bytes_a(i)) for i in one.encode(" " + t, add_special_tokens=False).ids], [(i, bytes_b(i)) for i in two.encode(t)]]
        if any(b"".join(x for _, x in s) != (" " + t).encode() for s in sides):
            continue
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in sides]
        groups, done = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            now = [at.index(cut, first) + 1 for at, first in zip(ends, done, strict=True)]
            groups.append(tuple([i for i, _ in s[x:y]] for s, x, y in zip(sides, done, now, strict=True)))
            done = now
        found[-1] = len(sides[0]), len(sides[1]), groups, [(x, y) for g in groups for x in g[0] for y in g[1]]
    k = Counter(p for r in found if r for p in set(r[3]))
    top = {}
    for (x, _), n in k.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for r in found:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in r[2]).encode()).hexdigest()
        out.append((r[0], r[1], len(r[2]), len(r[3]), sum(k[p] == top[p[0]] for p in r[3]), sum(k[p] for p in r[3]), digest))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def hostile(seed, n):
    r = random.Random(seed)
    parts = ["a", "th", "e", " ", "  ", "\n", "\t", "é", "ß", "日", "本", "😀", "́", " ", "▁", "<s>", "<|endoftext|>", "<0x41>", "'s", "'ll", "23", "!", "?!", "\r", "　", "\x00", "ﬁ", "½", "Ab", "_", "word", "tion"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize(("limit", "wide"), [(1 << 22, 1 << 16), (1500, 3)])  # the second reads several slices for groups of few documents
def test_alignment(spark, paths, monkeypatch, limit, wide):
    monkeypatch.setattr(alignment, "WIDE", wide)
    texts = [None, "", " ", "   ", "a ", "a  ", "Same text here.", "Same text here.", *hostile(4, 300), "word " * 20_000, "ab" * 30_000, "日本" * 3_000]
    rows = [(i if i != 7 else 6, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "nameless row", "clash", 1)]
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    got = alignment.align(docs, *paths, slice_pairs=limit, held_pairs=limit).collect()
    want = plain_alignment([r[1] for r in rows], *paths)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)


def test_alignment_of_nothing(spark, paths):
    assert alignment.align(spark.createDataFrame([], KINDS), *paths).collect() == []
    only = alignment.align(spark.createDataFrame([(1, None, "", 1), (2, "", "", 1)], KINDS), *paths).collect()
    assert sorted((r.doc_id, r.n_links, r.groups_sha256) for r in only) == [(1, 0, ""), (2, 0, "")]


def test_alignment_links(spark, paths):
    docs = spark.createDataFrame([(1, "the cat", "", 1), (2, "the dog", "", 1)], KINDS)
    assert alignment.links(docs, *paths).agg(F.max("n_docs")).first()[0] == 2


def test_alignment_labels():
    assert alignment.label_string(np.array([2, 5]), np.array([3, 5]), 5) == b"01203"
    import public_tokenizers as p

    one = alignment.Aligner(p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
    assert one._groups([np.array([2, 3, 7, 8]), np.array([3, 5, 7, 8])], 8).tolist() == [[2, 1], [1, 2], [1, 1]]


def test_alignment_on_the_table(spark, paths):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, *paths).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, plain_alignment([r.text for r in rows], *paths), strict=True)}


VECTORS = "vec_id long, embedding array<float>, x string, n int"


def vectors(seed, n, d, copies=0):
    r = np.random.Generator(np.random.PCG64(seed))
    x = r.normal(size=(n, d)).astype(np.float32) * np.linspace(0.5, 2, d, dtype=np.float32)
    x[:copies] = x[0]
    return [(i, [float(v) for v in row], "clash", 1) for i, row in enumerate(x)]


BAD = [(900, None, "", 1), (901, [None, 1.0, 2.0], "", 1), (902, [float("nan"), 1.0, 2.0], "", 1), (903, [float("inf"), 1.0, 2.0], "", 1), (904, [], "", 1), (905, [1.0], "", 1)]


def plain_whitening(rows):
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 1024).astype(object) + 100_000
    n = len(x)
    y = (x * n - x.sum(0)).astype(object)
    z = y.astype(float) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)
    return z, e[order], u[:, order], [sum(int(c) ** 2 for c in row) for row in y], v


@pytest.mark.parametrize(("n", "d", "copies"), [(400, 24, 150), (40, 3, 0), (300, 64, 0)])
def test_whitening(spark, n, d, copies):
    rows = vectors(n, n, d, copies)
    bad = BAD if d == 3 else [BAD[0], *BAD[4:]]
    frame = spark.createDataFrame([*rows, (None, rows[3][1], "", 1), rows[4], *bad], VECTORS).repartition(3)
    fit = [*rows, (None, rows[3][1]), rows[4]]
    z, e, u, dev, _ = plain_whitening(fit)
    k = min(8, d)
    got = whitening.whiten(frame).collect()
    assert len(got) == len(fit) * k and {r.n for r in got} == {len(fit)} and {r.component for r in got} == set(range(1, k + 1))
    assert max(r.identity_error for r in got) < 1e-10 and max(r.residual for r in got) < 1e-11
    assert {(r.vec_id, r.deviation) for r in got} == {(r[0], s) for r, s in zip(fit, dev, strict=True)}
    for c in range(k):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        want = z @ u[:, c] / np.sqrt(e[c])
        sign = np.sign(mine[5] * want[5])
        assert max(abs(sign * mine[r[0]] - w) for r, w in zip(fit, want, strict=True)) < 1e-9
        assert next(r.explained for r in got if r.component == c + 1) == pytest.approx(e[c] / e.sum(), rel=1e-10)


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame(BAD[:1], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)], VECTORS)).collect() == []  # no variance
    line = [(i, [float(i), float(2 * i)], "", 1) for i in range(9)]  # one component
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0], "", 1), (2, [-1e30, 2.0], "", 1), (3, [0.5, 7.0], "", 1)], VECTORS)).collect()
    assert huge and any(r.deviation is None for r in huge)


def test_lobpcg_on_close_eigenvalues():
    r = np.random.Generator(np.random.PCG64(3))
    d = 120
    u = np.linalg.qr(r.normal(size=(d, d)))[0]
    e = np.concatenate(([5.0, 5.0, 4.999999, 3.0], np.linspace(2, 1e-6, d - 4)))
    v = u * e @ u.T
    value, vector, size, trace, rounds = whitening.lobpcg(lambda b: (v @ b, float(e.sum())), d, 8)
    assert np.allclose(value, e[:8], rtol=1e-12) and np.linalg.norm(v @ vector - vector * value) < 1e-11 and rounds < 120 and size.max() < 1e-11


def plain_top(rows, k=5, every=50):
    x = {i: np.floor(np.array(v, dtype=np.float64) * 256).astype(int) for i, v in rows}
    out = []
    for q in x:
        if q % every == 0:
            s = sorted(((-int(x[q] @ x[i]), i) for i in x if i != q))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "growth"), [(4096, 16), (40, 4)])
def test_top_k(spark, monkeypatch, shard, growth):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "GROWTH", growth)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 3)
    rows = vectors(6, 420, 12, copies=140)
    frame = spark.createDataFrame([*rows, rows[50], (None, rows[1][1], "", 1), *[b for b in BAD if b[1] is None or len(b[1]) < 3]], VECTORS).repartition(3)
    whole = frame.where("vec_id is not null and size(embedding) = 12").dropDuplicates(["vec_id"])
    x = whole.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("x"))
    got = maxscore.search(x, x.where("vec_id % 50 = 0"), shard=shard).collect()
    want = plain_top([r[:2] for r in rows])
    assert sorted(tuple(r) for r in got) == want
    assert sorted(tuple(r) for r in maxscore.top_k(frame).collect()) == want


def test_top_k_edges(spark):
    few = [(0, [1.0, -1.0], "", 1), (50, [1.0, -1.0], "", 1), (7, [0.0, 0.0], "", 1)]
    assert sorted(tuple(r) for r in maxscore.top_k(spark.createDataFrame(few, VECTORS)).collect()) == plain_top([r[:2] for r in few])
    assert maxscore.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    assert maxscore.top_k(spark.createDataFrame([(0, [1.0], "", 1)], VECTORS)).collect() == []
    assert maxscore.top_k(spark.createDataFrame(few[2:], VECTORS)).collect() == []


def test_top_k_prunes():
    r = np.random.Generator(np.random.PCG64(8))
    centres = r.normal(size=(8, 32)) * 200
    x = np.floor(centres[r.integers(0, 8, 4000)] + r.normal(size=(4000, 32)) * 20).astype(np.int64)
    index = maxscore.Shard(np.arange(4000), x)
    ids = np.array([3, 77, 900])
    score = x[ids] @ x.T
    want = [sorted(((-int(s), i) for i, s in enumerate(row) if i != q))[:5] for q, row in zip(ids, score, strict=True)]
    who, found, got = index.search(ids, x[ids], 5, np.full(3, -np.inf), np.full(3, -1))
    assert [sorted((-int(s), int(i)) for w, i, s in zip(who, found, got, strict=True) if w == n) for n in range(3)] == want
    beat, beat_id = np.array([-w[4][0] for w in want], float), np.array([w[4][1] for w in want])
    who, found, got = index.search(ids, x[ids], 5, beat, beat_id)
    assert [sorted((-int(s), int(i)) for w, i, s in zip(who, found, got, strict=True) if w == n) for n in range(3)] == [w[:4] for w in want]
    read = [(np.maximum(x[ids] * low, x[ids] * high).sum(1) >= beat).sum() for low, high in zip(index.low, index.high, strict=True)]
    assert sum(read) < len(read) * 3 / 2  # most blocks are left out


def test_top_k_on_many_shapes():
    r = np.random.Generator(np.random.PCG64(18))
    for n, d, spread, big in [(1, 1, 3, 1), (5, 2, 2, 1), (700, 6, 2, 1), (600, 20, 100, 1), (300, 4, 3, 1 << 28), (900, 12, 1, 1)]:
        x = r.integers(-spread, spread + 1, (n, d)) * big
        ids = np.sort(r.choice(5 * n, n, replace=False))
        index, take = maxscore.Shard(ids, x), np.sort(r.permutation(n)[: max(1, n // 3)])
        who, found, got = index.search(ids[take], x[take], 5, np.full(len(take), -np.inf), np.full(len(take), -1))
        for w, t in enumerate(take):
            want = sorted(((-int(x[t] @ x[i]), int(ids[i])) for i in range(n) if i != t))[:5]
            assert sorted((-int(s), int(i)) for v, i, s in zip(who, found, got, strict=True) if v == w) == want


def test_top_k_sql_twin(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(oracles.TOP_K).fetchall())
    got = maxscore.top_k(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    assert sorted(tuple(r) for r in got) == want
