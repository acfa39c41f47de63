"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import base64
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitscope.llm import brown_lm, decontaminate, induced, license_scan, mixing, ngram_join, quality, secret_scan, suffix_dedup, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ka lo mi tu re sa vo ne pi du gar thel"
KINDS = "doc_id long, text string, source string, bucket string, n long"


def make_texts(seed=1, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(SYLLABLES.split()) for _ in range(r.randint(1, 3))) for _ in range(300)]
    some = lambda k: [r.choice(vocabulary) for _ in range(k)]
    shared = some(60)
    out = []
    for i in range(n):
        if out and i % 4 == 1:  # near copy: some words changed
            w = WORD.findall(out[-1] or "") or some(30)
            for _ in range(r.choice([0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif i % 7 == 3:
            w = some(20) + shared + some(10)
        else:
            w = some(r.randint(3, 120))
        out.append(" ".join(w).capitalize())
    out[5:5] = [None, "", " \n ", "Kurz", "kurz", "é ñ ü ÄÖ ß 漢字 " * 30]
    out.append(" ".join(some(20000)))
    return out


@pytest.fixture(scope="module")
def texts():
    t = make_texts()
    return [(i * 3 + 1, x, f"s{i % 3}" if i % 5 else None) for i, x in enumerate(t)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, s, "clash", 7) for i, t, s in texts], KINDS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t):
    w = WORD.findall(lowered(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(sets):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k) and find(a) != find(b):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in sets}


def test_ngram_join(docs, texts, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    sets = {i: shingles(t) for i, t, _ in texts}
    want = components(sets)
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}
    assert any(v[1] != k for k, v in got.items())
    assert ngram_join.similar_components(empty).count() == 0


def test_ngram_join_hot_group(spark, monkeypatch):
    """Many near copies that do not all link: verified in tiles, with the same components."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "s", "c", 1))
    monkeypatch.setattr(ngram_join, "HOT_PAIRS", 4)
    monkeypatch.setattr(ngram_join, "TILE", 200)
    got = {x.doc_id: x.component_id for x in ngram_join.similar_components(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == components({i: shingles(t) for i, t, *_ in rows})


def test_one_of_each_group(docs, texts):
    twice = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = [r.doc_id for r in ngram_join.one_of_each_group(twice).collect()]
    want = components({i: shingles(t) for i, t, _ in texts})
    assert sorted(x for x in got if x is not None) == sorted(k for k, v in want.items() if k == v) and got.count(None) == 1


def test_ngram_join_different_texts_of_an_id(spark, texts):
    """Another text of an id links nothing: neither its own id nor a third document through it."""
    r = random.Random(11)
    words = lambda k: " ".join("".join(r.choice(SYLLABLES.split()) for _ in range(3)) + str(r.randrange(99)) for _ in range(k))
    long, short = words(200), words(80)
    rows = [(5, long), (5, short), (9, short), (7, long + " x"), (11, words(50)), (None, long)]
    frame = spark.createDataFrame([(i, t, "s", "clash", 7) for i, t in rows], KINDS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_components(frame).collect()}
    assert got == {5: (196, 5), 7: (197, 5), 9: (76, 9), 11: (46, 11)}


def test_one_of_each_group_by_text(spark, texts):
    """Every text that is no near copy stays, whatever the ids."""
    r = random.Random(12)
    rows = [(r.randrange(8) if i % 9 else None, t) for i, (_, t, _) in enumerate(texts)] + [(3, texts[0][1]), (3, texts[0][1])]
    frame = spark.createDataFrame([(i, t, f"row {k}", "clash", 7) for k, (i, t) in enumerate(rows)], KINDS).repartition(3)
    entities = sorted({(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows if i is not None})
    text = {(i, hashlib.sha256((t or "").encode()).hexdigest()): t for i, t in rows}
    root = components({k: shingles(text[e]) for k, e in enumerate(entities)})
    want = sorted(e for k, e in enumerate(entities) if root[k] == k)
    got = ngram_join.one_of_each_group(frame).collect()
    assert sorted((x.doc_id, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in got if x.doc_id is not None) == want
    assert sum(x.doc_id is None for x in got) == sum(i is None for i, _ in rows) and got[0].asDict().keys() == set(frame.columns)


def test_brown_lm(docs, texts, empty):
    got = {r.doc_id: r for r in brown_lm.score_documents(docs).collect()}
    counts, held = Counter(), {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in texts}
    toks = {i: [*WORD.findall(lowered(t)), None] for i, t, _ in texts}
    for i, w in toks.items():
        if not held[i]:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert np.isfinite(r.score) and r.score < 0
    assert brown_lm.score_documents(empty).count() == 0


def span_hash(w):
    b = np.frombuffer(w.encode(), np.uint8)
    return int(brown_lm.T.span_hash(b, np.array([0]), np.array([len(b)]))[0])


@pytest.mark.parametrize("head", [200_000, 60])  # the second leaves most words rare, next to each other too
def test_brown_lm_against_plain_sums(spark, docs, texts, monkeypatch, head):
    """Given the classes, the score is recomputed from its definition; classes and scores do not depend on partitions or Arrow batches."""
    monkeypatch.setattr(brown_lm, "HEAD", head)
    cls = {r.word_hash % 2**64: (r["class"], r.n) for r in brown_lm.word_classes(docs).collect()}
    toks = {i: [span_hash(w) for w in WORD.findall(lowered(t))] + [None] for i, t, _ in texts}
    train = {i: w for i, w in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(x for w in train.values() for x in w)
    assert {h: n for h, (_, n) in cls.items()} == {h: n for h, n in counts.items() if h is not None}
    kind = lambda x: brown_lm._END if x is None else cls[x][0] if x in cls else brown_lm._TAIL
    pairs = np.zeros((brown_lm.CLASSES + 2, brown_lm.CLASSES + 1))
    for w in train.values():
        for v, x in zip([None, *w], w, strict=False):
            pairs[kind(v), kind(x)] += 1
    move = brown_lm._smooth(pairs)
    assert np.allclose(move.sum(1), 1)
    n = sum(counts.values())
    u = max(0.5, sum(k == 1 for k in counts.values())) / n
    mass = pairs.sum(0)
    want = {i: sum(np.log10((1 - u) * move[kind(v), kind(x)] * counts[x] / mass[kind(x)]) if counts[x] else np.log10(u) for v, x in zip([None, *w], w, strict=False)) for i, w in toks.items()}
    scores = lambda d: {r.doc_id: r.score for r in brown_lm.score_documents(d).collect()}
    got = scores(docs)
    assert got == pytest.approx(want)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, width = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(key, "1")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert scores(docs.repartition(5)) == pytest.approx(got)
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_brown_lm_beats_base_on_held_out_texts(spark):
    """Texts that go round twelve kinds of words: the classes learn the round, and unseen pairs of words profit from it."""
    r = random.Random(9)
    rows = [(i, " ".join(f"k{(i + k) % 12}w{r.randrange(20)}" for k in range(40))) for i in range(300)] + [(1, None), (2, "again"), (2, "again"), (None, "k1w1 k2w2")]
    got = [x for x in brown_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out and x.n_tokens > 9]
    assert got and sum(x.score for x in got) > sum(x.base_score for x in got) + 0.5 * sum(x.n_tokens for x in got)


def test_token_counts(docs, texts, empty, spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, cache = public.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    t = Tokenizer.from_file(path)
    for _ in range(2):  # the second run finds all counts in the cache
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path, cache).collect()}
        for i, x, _ in texts:
            n = len(t.encode(x or "", add_special_tokens=False))
            assert got[i] == (len((x or "").encode()), n, n > 512)
        rows = spark.read.parquet(cache).count()
        assert rows == len({x or "" for _, x, _ in texts})
    assert tokens.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("branch", ["broadcast", "anti", "shuffle"])
def test_token_counts_without_ids(spark, tmp_path, monkeypatch, branch):
    """Null and repeated ids count alike, whichever join picks the rows to encode."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, cache = public.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    rows = [(None, "no id here"), (None, "no id here"), (None, "with and without"), (1, "with and without"), (2, "one"), (2, "two words"), (None, None), (3, "one")]
    if branch == "shuffle":
        rows += [(k, "one") for k in range(10, 14)]
    monkeypatch.setattr(tokens, "BROADCAST_IDS", {"broadcast": 100, "anti": 4, "shuffle": 4}[branch])
    t = Tokenizer.from_file(path)
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, cache)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == Counter(want)
    stored = spark.read.parquet(cache)
    assert stored.select("digest").distinct().count() == len({x or "" for _, x in rows}) == stored.count()


def test_warc(spark, tmp_path):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "kurz", "kurz", "<p>lang</p>" * 20, "<p>lang</p>" * 20, "é" * 60, "é" * 60, "z" * 100000])]
    rows += [(4, "http://x/4", "<p>lang</p>" * 20), (None, None, "x")]
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, shard int").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, 2000, 5000).collect())
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and d in first
        want.append((str(i), len(b), d, "revisit" if again else "response", first[d] if again else None))
        first.setdefault(d, i)
    assert got == sorted(want)
    roots = [f"file://{tmp_path}/{k}" for k in "ab"]
    names = [sorted((r.name, r.sha256) for r in warc.write_warc(p, x, 2000, 5000).collect()) for x, p in zip(roots, (pages, pages.repartition(5)), strict=True)]
    assert names[0] == names[1] and len(names[0]) > 1  # the same bytes, wherever tasks run
    assert warc.round_trip(pages.where("false")).count() == 0


def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat)


def test_quality(spark, docs, texts, empty):
    more = spark.createDataFrame([(900, "a b\n" * 30, "s0", "x", 1), (901, "# | < " * 30, "s1", "x", 1), (902, "Zeile eins\nZeile\nZeile eins\n" + " ".join(f"w{i}" for i in range(40)), "s1", "x", 1)], KINDS)
    every = docs.unionByName(more)
    got = {r.doc_id: r for r in quality.judge(quality.measure(every, ["doc_id", "source"]), "source").collect()}
    for r in every.collect():
        g, want = got[r.doc_id], plain_measures(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not g.base_failed or not g.kept)
    assert quality.quality_filter(every).columns == every.columns
    assert {r.doc_id for r in quality.quality_filter(every).collect()} == {k for k, r in got.items() if r.kept}
    assert quality.quality_filter(empty).count() == 0


def test_quality_texts_stay_where_they_are(spark, docs):
    """No exchange carries a text while the condemned hosts are few."""
    plan = quality.quality_filter(docs.limit(5).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    physical = quality.quality_filter(spark.range(5).selectExpr("id doc_id", "'x y' text", "'h' source"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "BroadcastHashJoin" in physical and "Exchange hashpartitioning" not in physical


@pytest.mark.parametrize("limit", [quality.BROADCAST_BYTES, 0])
def test_quality_condemns_a_bad_host(spark, monkeypatch, limit):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, words(i) + " ###### ||||||" * (i % 10 != 0), "bad", "", 1) for i in range(40)] + [(100 + h * 20 + i, words(i + 99) + (" ######" if i == 0 else ""), f"good{h}", "", 1) for h in range(8) for i in range(20)]
    monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame(rows, KINDS).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    kept = [r.doc_id for r in quality.quality_filter(pages).collect()]
    assert len(kept) == len(set(kept)) and [i for i in range(40) if i in kept] == [0, 10, 20, 30]  # clean pages of a bad host stay
    assert {r[0] for r in rows if r[0] >= 100} <= set(kept)  # a noisy page of a good host stays
    assert {r.doc_id for r in quality.quality_report(pages).where("kept").collect()} == set(kept)


def test_mixing(spark, docs, texts, empty):
    rows = mixing.mix(docs).collect()
    words = {i: len(WORD.findall(t or "")) for i, t, _ in texts}
    assert {r.doc_id for r in rows if r.n_tokens} == {i for i, k in words.items() if k}
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.n_tokens
    total = Counter()
    for i, _, s in texts:
        total[s or ""] += words[i]
    assert max(taken[s] / total[s] for s in total) <= 2 + 1e-6
    one = mixing.mix(docs, budget=300).collect()
    assert sum(r.n_tokens for r in one) <= 300
    assert mixing.mix(empty).count() == 0
    p = {s: k / sum(total.values()) for s, k in total.items()}
    entropy = lambda d: -sum(x * np.log(x) for x in d.values() if x)
    assert entropy(weight) >= entropy(p) - 1e-9


def plain_mix(rows, budget, gain, repeats, seed, block_docs):
    """The mix from its definition: weights by bisection of the exponent, epochs of permuted blocks, the last one cut at its budget."""
    by = defaultdict(list)
    for i, t, s in rows:
        by[s or ""].append((i, len(WORD.findall(t or ""))))
    tokens = {s: sum(k for _, k in d) for s, d in by.items()}
    tokens = {s: k for s, k in tokens.items() if k}
    total = sum(tokens.values())

    def at(a):
        x = {s: (k / total) ** a for s, k in tokens.items()}
        z = sum(x.values())
        w = {s: v / z for s, v in x.items()}
        size = budget if budget is not None else max(k / x[s] for s, k in tokens.items()) * z
        return w, size, -sum(v * np.log(v) for v in w.values()), max(w[s] * size / k for s, k in tokens.items())

    low, high = at(1.0)[2], at(0.0)[2]

    def turn(holds):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(at(mid)) else (lo, mid)
        return hi

    a = max(turn(lambda x: x[2] >= low + gain * (high - low)), turn(lambda x: x[3] > repeats))
    w, size, _, _ = at(np.ceil(a * 1e6 - 1e-3) / 1e6)
    order = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    out = []
    for s, n in tokens.items():
        blocks = max(1, -(-len(by[s]) // block_docs))
        quota = int(w[s] * size + 1e-6)
        held = defaultdict(list)
        for i, k in by[s]:
            held[int(order(seed, i)[:8], 16) % blocks].append((i, k))
        for epoch in range(quota // n + 1):
            limit, before = n if epoch < quota // n else quota % n, 0
            for b in sorted(held, key=lambda b: (order(seed, epoch, "block", b), b)):  # noqa: B023
                if before >= limit:
                    break
                end = before
                for i, k in sorted(held[b], key=lambda x: (order(seed, epoch, x[0]), x)):  # noqa: B023
                    end += k
                    if end <= limit:
                        out.append((i, s, epoch, b, k))
                before += sum(k for _, k in held[b])
    return sorted(out), w


@pytest.mark.parametrize(("budget", "repeats"), [(None, 2.0), (None, 1.2), (900, 1.5), (30_000, 3.0)])
def test_mixing_against_plain_blocks(spark, docs, texts, monkeypatch, budget, repeats):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    got = mixing.mix(docs, budget=budget, max_repeats=repeats).collect()
    want, weights = plain_mix([(i, t, s) for i, t, s in texts], budget, 0.5, repeats, 17, 4)
    assert {r.source: r.weight for r in got} == pytest.approx({s: w for s, w in weights.items() if any(x[1] == s for x in want)}, abs=1e-5)
    assert sorted((r.doc_id, r.source, r.epoch, r.block, r.n_tokens) for r in got) == want
    assert all(0 <= r.position <= 1 for r in got)


def test_mixing_limits_and_clashes(spark, docs, texts):
    words = sum(len(WORD.findall(t or "")) for _, t, _ in texts)
    with pytest.raises(ValueError, match="budget"):
        mixing.mix(docs, budget=3 * words, max_repeats=2.0)
    clash = docs.withColumns({"weight": F.lit("x"), "epoch": F.lit("y"), "tokens": F.lit(1), "blocks": F.lit(2)})
    key = lambda d: sorted((r.doc_id, r.epoch, r.block) for r in mixing.mix(d).collect())
    assert key(clash) == key(docs)
    twice = docs.unionByName(docs)  # ties: rows that repeat an id are each taken
    assert Counter(r.doc_id for r in mixing.mix(twice).where("epoch = 0").collect()) == {i: 2 for i, t, s in texts}


def plain_dedup(rows, span=50):
    """The result of each row; rows that repeat an id give lists."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(data):
        for k in range(len(b) - span + 1):
            first.setdefault(b[k : k + span], i)
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                gone[k : k + span] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.setdefault(i, []).append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def dedup_rows(df):
    out = {}
    for r in suffix_dedup.dedup_report(df).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {i: sorted(x) for i, x in out.items()}


def test_suffix_dedup(spark, docs, texts, empty):
    rows = [(i, t) for i, t, _ in texts if t is None or len(t) < 20000]
    some = spark.createDataFrame([(i, t, None, "c", 1) for i, t in rows], KINDS)
    got = dedup_rows(some)
    assert got == plain_dedup(rows) and any(v[0][1] for v in got.values())
    assert suffix_dedup.dedup_report(empty).count() == 0


@pytest.mark.parametrize("limit", [suffix_dedup.BROADCAST_BYTES, 0])
def test_suffix_dedup_repeated_ids(spark, monkeypatch, limit):
    """Rows of one id are judged one by one, with broadcast spans and with shuffled ones; ``deduplicate`` returns the bytes that stay."""
    r = random.Random(12)
    some = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    a, b = some(200), some(204)
    rows = [(1, a), (5, a), (5, b), (5, b), (9, some(20) + b + some(20)), (9, a[:60] + b[50:150]), (5, None), (5, "kurz"), (7, "kurz"), (1, b[:70]), (None, a)]
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", limit)
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_dedup([x for x in rows if x[0] is not None])
    assert dedup_rows(some) == want
    kept = Counter((x.doc_id, hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.deduplicate(some).collect())
    assert kept == Counter((i, x[3]) for i, xs in want.items() for x in xs)


def _phrase_rows():
    """A phrase of 45 bytes between differing neighbours, some of them alike, and a long run of one byte."""
    r = random.Random(6)
    phrase = "all rights to this text are with its authors."
    some = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    rows = [(i, some(r.randint(40, 90)) + phrase + some(r.randint(40, 90))) for i in range(200)]
    rows += [(200 + i, some(30) + t[20:] + some(9)) for i, t in rows[::9]] + [(300, "=" * 4000), (301, some(20) + "=" * 300), (302, (some(40) + phrase) * 9)]
    return rows


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    """The strings of a hot anchor are dealt to all shards, and the result is the same."""
    rows = _phrase_rows()
    some = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.xxhash64("text")).coalesce(1)
    flags = suffix_dedup._shared_anchors(some, 8, 2).where(f"kind = {suffix_dedup._FLAGS}")

    def largest(hot):
        load = Counter()
        for r in suffix_dedup._contexts(some, flags, hot, 8, 2).where("bucket < 8").collect():
            load[r.bucket] += len(r.d)
        return max(load.values()) / sum(load.values())

    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    found = suffix_dedup._shared_anchors(some, 8, 2).where(f"kind = {suffix_dedup._HOT}").collect()
    hot = np.concatenate([suffix_dedup.packed.unplanes(r.a) for r in found])
    assert largest(np.zeros(0, np.uint64)) > 0.4 and largest(hot) < 0.25
    got = dedup_rows(some)
    assert got == plain_dedup(rows) and any(v[0][1] for v in got.values())


def test_suffix_dedup_shards_follow_the_data(spark, monkeypatch):
    """More contexts make more shards at the same shuffle width."""
    rows, counts = _phrase_rows(), []
    plain = suffix_dedup._contexts
    monkeypatch.setattr(suffix_dedup, "_contexts", lambda docs, flags, hot, n, groups: counts.append(n) or plain(docs, flags, hot, n, groups))
    some = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (8 << 20, 1000):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
        assert dedup_rows(some) == plain_dedup(rows)
    assert counts[0] == 8 and counts[1] > 16


@pytest.mark.parametrize("memory", [1 << 20, 64])  # the second spills every queue
def test_induced_order(memory, tmp_path):
    r = np.random.default_rng(2)
    text = np.concatenate((r.integers(1, 4, 300), np.tile([1, 2, 3, 2], 40), r.integers(1, 4, 50), [0])).astype(np.uint16)
    sa, lcp = induced.suffix_order(text, 258, 50, f"file://{tmp_path}/spill", memory)
    assert memory > 64 or (tmp_path / "spill").exists() and not list((tmp_path / "spill").iterdir())
    suffixes = [tuple(text[i : i + 50]) for i in range(len(text))]
    assert [suffixes[i] for i in sa.tolist()] == sorted(suffixes)
    for a, b, k in zip(sa[:-1].tolist(), sa[1:].tolist(), lcp[1:].tolist(), strict=True):
        x, y = suffixes[a], suffixes[b]
        assert k == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))


def least_distance(p, t):
    """Edits from p to the nearest substring of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for j, x in enumerate(p):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination(spark, docs, empty, monkeypatch):
    r = random.Random(8)
    item = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(12))
    broken = list(item)
    for k in range(5, 5 * (len(item) * 9 // 100), 5):
        broken[k] = "q"
    far = list(item)
    for k in range(0, len(item), 6):
        far[k] = "Q"
    texts = [(1, f"vor {item.upper()}! nach"), (2, "vor " + "".join(broken) + " nach"), (3, "vor " + "".join(far) + " nach"), (4, None), (5, ""), (6, "kurz und gut."), (7, "kurzundgut"), (8, item[:40])]
    items = spark.createDataFrame([(10, item, 1), (11, "Kurz und gut", 1), (12, None, 1), (13, " ", 1)], "item_id long, text string, doc_id int")
    found = {x.doc_id: (x.item_ids, x.distances) for x in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    norm = decontaminate.normalise
    for i, t in texts:
        want = []
        m = norm(item)
        for k, x in ((10, m), (11, norm("Kurz und gut"))):
            if t and (d := least_distance(x, norm(t))) <= len(x) * 9 // 100:
                want.append((k, d))
        assert list(zip(*found[i], strict=True)) == want
    assert found[1] == ([10], [0])
    kept = decontaminate.clean_documents(spark.createDataFrame(texts, "doc_id long, text string"), items)
    assert sorted(x.doc_id for x in kept.collect()) == [3, 4, 5, 7, 8]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # several blocks, taken in turn over parts of the texts
    monkeypatch.setattr(decontaminate, "TEXT_BYTES", 200)
    more = items.unionByName(spark.createDataFrame([(10, "x" * 50, 1), (11, "Kurz und gut", 1)], items.schema))
    assert decontaminate.write_blocks(more, "item_id", "text")[1] > 2
    again = {x.doc_id: (x.item_ids, x.distances) for x in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), more).collect()}
    assert again == found
    assert decontaminate.clean_documents(docs, items.where("false")).count() == docs.count() and decontaminate.clean_documents(empty, items).count() == 0


def test_secrets(spark, docs, texts, empty):
    scanner = secret_scan.default_scanner(docs)
    words = [w.decode() for w in scanner.corpus.words]
    test = secret_scan.labelled_findings(words, 600, seed=77)
    x = np.array([secret_scan.features(b.encode(), w.encode(), a.encode(), p.encode(), scanner.corpus, scanner.odds) for b, w, a, p, _ in test])
    v, y = scanner.forest.score(x) >= 0.5, np.array([r[4] for r in test]) > 0.5
    assert (v == y).mean() > 0.97
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'ka lo token = "{key}" mi', "app.py"), (2, "commit " + key + " fixes", "log"), (3, "Karte 4785380592391139 und 12.34@mail7.example.com", "s"), (4, None, None), (5, "", "s"), (6, f"Secret: '{key.upper()}'", "s")]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: [s.value for s in r.secrets] for r in secret_scan.find_secrets(t, scanner).collect()}
    assert got == {1: [key], 2: [], 3: [], 4: [], 5: [], 6: [key.upper()]}
    clean = {r.doc_id: r for r in secret_scan.redact(t, scanner).collect()}
    assert clean[1].text == f'ka lo token = "{secret_scan.MARK}" mi' and clean[1].n_chars == len(clean[1].text) and clean[4].text is None and len(clean) == 6
    assert secret_scan.find_secrets(empty).count() == 0


def held_out_findings(seed=21):
    """Findings from formats and contexts that the training generator does not make."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = upper + lower + digits
    yes, no = [], []
    for _ in range(12):
        yes += [  # the text, and how the secret in it begins, where that is fixed
            (f"const stripe = new Stripe('sk_live_{pick(word, 24)}');", "sk_live_"), (f"GOOGLE_MAPS_KEY=AIza{pick(word + '_-', 35)}", "AIza"), (f"git clone with glpat-{pick(word, 20)} from the mirror", "glpat-"),
            (f"//registry.example.org/:_authToken=npm_{pick(word, 36)}", "npm_"), (f"SENDGRID_API_KEY: SG.{pick(word, 22)}.{pick(word, 43)}", "SG."), (f"login with hf_{pick(word, 34)} to pull the weights", "hf_"),
            (f"aws_secret_access_key = {pick(word + '/+', 40)}", None), (f"export DB_PASSWORD='{pick(word + '#!%', 18)}'", None), (f'"client_secret": "{pick(word + "_-", 32)}",', None), (f"Authorization: Bearer {pick(word + '-_', 48)}", None),
        ]
        no += [
            f"see https://docs.example.net/guide/{pick(lower, 7)}/{pick(lower, 9)}-{pick(lower, 6)}.html#section-{r.randrange(99)}", f"Subproject commit {pick('0123456789abcdef', 40)}", f'"integrity": "sha512-{pick(word + "+/", 86)}=="', f"ISBN 978-{pick(digits, 1)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 1)} in print",
            f"request id {pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}-a{pick('0123456789abcdef', 3)}-{pick('0123456789abcdef', 12)} failed", f"call +49-30-{pick(digits, 4)}-{pick(digits, 6)} after nine", f"built at 2023-0{r.randint(1, 9)}-1{r.randrange(9)}T0{r.randrange(9)}:12:4{r.randrange(9)}.{pick(digits, 6)}Z",
            f"the file IMG_2023{pick(digits, 4)}_{pick(digits, 6)}.jpeg is blurred", f"version 1.{r.randrange(20)}.{r.randrange(20)}-beta.{r.randrange(9)}+build.{pick(digits, 5)}", f"order number {pick(digits, 18)} was shipped", f"class MyVeryLongAbstract{pick(upper, 1)}{pick(lower, 6)}FactoryBean2 implements", "password = get_password_from_env(user)", "api_key: ${API_KEY_FROM_VAULT}",
        ]
    return yes, no


def test_secrets_on_held_out_formats(spark, docs):
    scanner = secret_scan.default_scanner(docs)
    yes, no = held_out_findings()

    def secrets(t):
        b = t.encode()
        return [b[a:z].decode() for _, a, z, v in scanner.scan(np.frombuffer(b, np.uint8), np.array([0, len(b)]), ["notes.txt"]) if v >= secret_scan.THRESHOLD]

    missed = [t for t, start in yes if not any(g.startswith(start or "") for g in secrets(t))]
    false = [(t, g) for t in no if (g := secrets(t))]
    hits = len(yes) - len(missed)
    assert hits >= 0.9 * len(yes) and hits >= 0.9 * (hits + len(false)), (missed, false)


def test_secrets_in_urls_and_data_uris(spark, docs):
    scanner = secret_scan.default_scanner(docs)
    r = random.Random(5)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"

    def found(t):
        b = t.encode()
        return [b[a:z].decode() for _, a, z, v in scanner.scan(np.frombuffer(b, np.uint8), np.array([0, len(b)]), ["notes.txt"]) if v >= secret_scan.THRESHOLD]

    keys = [pick(word, 14) for _ in range(12)]
    hits = [k in found(f"{lead}{scheme}://{user}:{k}@db-3.internal/main rest of the line") for k, (lead, scheme, user) in zip(keys, [("connect to ", "postgres", "admin"), ("", "mongodb", "svc"), ("url = ", "amqp", "guest")] * 4, strict=True)]
    assert sum(hits) >= 0.9 * len(hits), hits
    false = [t for t in [f'<img src="data:image/{kind};base64,{base64.b64encode(r.randbytes(n)).decode()}" alt="x">' for kind, n in [("png", 60), ("gif", 300), ("jpeg", 3000), ("webp", 90), ("svg+xml", 700)]] + ["see http://localhost:8080/path@2x", "postgres://user:password@host/db", "mysql://root:${DB_PASSWORD}@db", "password: required field"] if found(t)]
    assert not false, false


def test_secrets_assigned_values_are_whole(spark, docs):
    """A value with other signs than a run's, with or without spaces and quotes, is one candidate without its name, and goes whole."""

    def candidates(t):
        b = t.encode()
        return [b[a:z].decode() for _, a, z in secret_scan.block_candidates(np.frombuffer(b, np.uint8), np.array([0, len(b)]))]

    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    values = ["Ab3!kT9#mQ2$", "s3cr!etPartWith16charsX1", "q7@Zk%4*Lm?9&Xt!", key, "aB3" * 8 + "#x!Y2"]
    forms = ["client_secret={}", "password = \"{}\"", "api_key='{}'", "auth_token: {}", "token:{}"]
    for form in forms:
        for v in values:
            assert candidates("ka lo " + form.format(v) + " mi") == [v], (form, v)
    assert candidates(f"sha256={key} mi") == [key] and candidates(f"x={key[:12]}Abcd") == [f"x={key[:12]}Abcd"[2:]]
    assert candidates(f"{key}token=abcdefgh!1") == [key + "token", "abcdefgh!1"]  # nothing before a value is lost
    scanner = secret_scan.default_scanner(docs)
    rows = [(i, f"ka lo mi {f.format(v)} tu re sa", "config/prod.env") for i, (f, v) in enumerate((f, v) for f in forms for v in values)]
    clean = [r.text for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, source string"), scanner).orderBy("doc_id").collect()]
    want = [f"ka lo mi {f.format(secret_scan.MARK)} tu re sa" for f in forms for _ in values]
    for got, right, (_, t, _) in zip(clean, want, rows, strict=True):
        assert got in (right, t)  # all of the value or nothing
    assert sum(g == w for g, w in zip(clean, want, strict=True)) >= 0.9 * len(want)


# Notices and sentences written by hand, not by the generator that the classifier learns from.
NOTICES = [
    ("mit", "This project is distributed under the MIT License."), ("mit", "Copyright 2019 Jane Roe. Licensed under the MIT license, see LICENSE.txt for details."), ("mit", "License: released under the terms of the MIT License"),
    ("apache", "Copyright 2021 The Authors. Licensed under the Apache License, Version 2.0 (the License)"), ("apache", "All code here is released under the Apache License 2.0 unless noted"), ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("bsd", "The library is licensed under the BSD license"), ("gpl", "This is licensed under the GNU General Public License version 2 or later"),
    ("gpl", "foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF"), ("agpl", "The server is licensed under the GNU Affero General Public License, version 3"), ("lgpl", "The bindings are licensed under the GNU Lesser General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"), ("isc", "It is released under the ISC license"), ("cc-by", "Photos in this article are licensed under CC BY 4.0"), ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply"),
    ("cc-by-nc", "The dataset is licensed under CC BY-NC 4.0"), ("cc0", "The data is released under CC0 1.0 Universal"), ("unlicense", "This is free and unencumbered software released into the public domain. Have fun"), ("proprietary", "This software is proprietary and confidential. Do not share."),
]
SENTENCES = [
    "You need a licence to fish in this river", "The MIT press published a history of computing", "Apache tribes lived in the south west", "The new driver must carry a license at all times", "General audiences and the public liked the film", "The foundation was created under the law of the state",
    "Source code reviews are done every week", "Creative people like common rooms", "Use of the pool is permitted to guests of the hotel", "He wrote software for the school", "Copyright law changed twice in the last century", "The mozilla browser was popular then",
    "All rights were sold to a publisher in Rome", "The permission of the owner is needed to enter", "A free bus runs to the public beach", "Berkeley is a city in the east bay", "The court granted the licence for the new bar", "Redistribution of income was the main theme of the talk",
    "The terms of the loan were modified in version two of the plan", "Domain names are cheap in that country",
]

PROBES = [  # families that look alike, and notices that the words of another family nearly fill
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"), ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the site"),
    ("wtfpl", "This work is free. It comes under the WTFPL, Version 2; licensed under the WTFPL, see COPYING"), ("", "All rights reserved seats were sold out"), ("proprietary", "Copyright 2020 Example Ltd. All rights reserved."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("", "Licensed under the Foobar License, Version 2.0"), ("", "Released under the Acme License"), ("zlib", "The codec is released under the zlib license"), ("eupl", "Licensed under the EUPL, Version 1.2 or later"),
]


def licence_families(c, text):
    b = np.frombuffer(text.encode(), np.uint8)
    return sorted({f[3] for f in license_scan.block_findings(c, b, np.array([0, len(b)]))[1] if f[5] >= license_scan.COVER})


def test_licences(spark, docs, empty):
    c = license_scan.default_classifier(docs)
    right = [licence_families(c, t) for _, t in NOTICES]
    wrong = [licence_families(c, t) for t in SENTENCES]
    hits = sum(f in got for (f, _), got in zip(NOTICES, right, strict=True))
    false = sum(len(set(got) - {f}) for (f, _), got in zip(NOTICES, right, strict=True)) + sum(map(len, wrong))
    for f, t in PROBES:
        assert licence_families(c, t) == ([f] if f else []), t
    assert hits >= 0.9 * len(NOTICES) and hits >= 0.9 * (hits + false), [(f, g) for (f, _), g in zip(NOTICES, right, strict=True) if [f] != g] + [w for w in wrong if w]
    filler = "ka lo mi tu re sa vo ne pi du gar thel " * 30
    wrap = lambda t, w: re.sub(rf"(.{{1,{w}}})(?: |$)", r"\1\n", t)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"
    for w in (40, 72, 80):  # wrapped notices, alone and between other paragraphs
        assert licence_families(c, wrap(mit, w)) == ["mit"] and licence_families(c, wrap(agpl, w)) == ["agpl"]
        assert licence_families(c, f"{wrap(filler, w)}\n{wrap(mit, w)}\n\n{filler}") == ["mit"]
    assert licence_families(c, filler + mit + " " + filler) == ["mit"] and licence_families(c, filler * 5 + "Released under the MIT License. " + filler) == ["mit"]  # inside one long line
    assert licence_families(c, "Licensed under the MIT license. " + filler + "Licensed under the Apache License, Version 2.0") == ["apache", "mit"]
    rows = [(1, "ka lo\nReleased under the MIT License.\nmi"), (2, "He lost his fishing license last year"), (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "ka lo mi " * 3000 + "\n\n \n\nlo"), (1, "ka lo\nReleased under the MIT License.\nmi")]
    got = [(r.doc_id, r.families, r.n_paragraphs) for r in license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), c).collect()]
    assert sorted(got) == [(1, ["mit"], 1), (1, ["mit"], 1), (2, [], 1), (3, [], 0), (4, [], 0), (5, ["gpl"], 1), (6, [], 2)]
    assert license_scan.scan_licences(empty, c).count() == 0


def test_pipeline(spark, tmp_path, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    long = lambda: " ".join("".join(r.choice(SYLLABLES.split()) for _ in range(3)) + str(r.randrange(99)) for _ in range(60))
    item = " ".join(WORD.findall(long())[:20])
    a = long()
    rows = [(1, a, "x"), (2, a, "y"), (3, "zu kurz", "x"), (4, long() + " " + item, "x"), (5, long() + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "y"), (6, long(), None), (7, None, "x")]
    d = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rest, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rest.columns
        rest = stage(spark, rest, d)
        assert rest.columns == before, name
        kept.append(sorted(x.doc_id for x in rest.collect()))
    assert kept == [[1, 2, 4, 5, 6], [1, 4, 5, 6], [1, 5, 6], [1, 5, 6]]
    assert secret_scan.MARK in rest.where("doc_id = 5").first().text
    assert {x.doc_id for x in corpus_pipeline.run(spark, d).collect()} == {1, 5, 6}


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, repeated rows, null values and columns with the operators' own names pass all stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    long = lambda: " ".join("".join(r.choice(SYLLABLES.split()) for _ in range(3)) + str(r.randrange(99)) for _ in range(50))
    a, b = long(), long()
    rows = [(1, a, "x"), (1, a, "x"), (2, a, None), (None, b, "y"), (3, None, None), (4, b + " " + long(), "y"), (4, long(), "y")]
    kinds = "doc_id long, text string, source string, lang string, n_chars long, n_words long, __host string, epoch int, tokens map<string,int>"
    d = f"file://{tmp_path}/edges"
    spark.createDataFrame([(i, t, s, "en", len(t or ""), 7, "h", 1, {"k": 1}) for i, t, s in rows], kinds).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = rest = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rest = stage(spark, rest, d)
        assert rest.columns == docs.columns, name
    assert sorted(x.doc_id or 0 for x in rest.collect()) == [0, 1, 4, 4]
    assert Counter(x.doc_id or 0 for x in corpus_pipeline.run(spark, d).where("epoch = 0").collect()) == {0: 1, 1: 1, 4: 2}
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0, name


def test_repeated_rows(spark, docs):
    """Rows that repeat, with and without an id, are each judged alike."""
    public = pytest.importorskip("public_tokenizers")
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'ka lo token = "{key}" mi', "app.py")] * 3 + [(None, f'ka lo token = "{key}" mi', "app.py"), (2, "Released under the MIT License.", "s"), (2, "Released under the MIT License.", "s"), (2, None, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.find_secrets(t, secret_scan.default_scanner(docs)).collect()
    assert Counter((r.doc_id, r.n_secrets) for r in found) == {(1, 1): 3, (None, 1): 1, (2, 0): 3}
    licences = license_scan.scan_licences(t, license_scan.default_classifier(docs)).collect()
    assert Counter((r.doc_id, tuple(r.families)) for r in licences) == {(1, ()): 3, (None, ()): 1, (2, ("mit",)): 2, (2, ()): 1}
    items = spark.createDataFrame([(7, "released under the mit license"), (7, "released under the mit license")], "item_id long, text string")
    assert Counter((r.doc_id, tuple(r.item_ids)) for r in decontaminate.contamination(t, items).collect()) == {(1, ()): 3, (None, ()): 1, (2, (7,)): 2, (2, ()): 1}
    assert decontaminate.clean_documents(t, items).count() == 5
    counts = Counter((r.doc_id, r.n_tokens > 0) for r in tokens.count_tokens(t, public.path("byte_bpe_50k.json")).collect())
    assert counts == {(1, True): 3, (None, True): 1, (2, True): 2, (2, False): 1}
    scores = brown_lm.score_documents(t).collect()  # rows that share an id are one document
    assert {r.doc_id: r.n_tokens for r in scores} == {1: 3 * 7, 2: 6 + 6 + 1}


def test_very_long_texts(spark, docs, tmp_path):
    """A text of millions of bytes: what stands at its end is found, and anchors do not hang on how it is cut."""
    r = np.random.default_rng(3)
    buf = r.integers(97, 123, 9 << 20).astype(np.uint8)
    offs = np.array([0, 3 << 20, (3 << 20) + 30, 9 << 20])

    def owners(h, doc, start, n):
        out = np.zeros(len(buf), np.uint64)
        out[np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] = np.repeat(h, n)
        return out

    parts = []
    for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        h, d, start, n = suffix_dedup.anchors(buf[a:z], np.array([0, z - a]))
        parts.append((h, d, start + a, n))
    assert (owners(*suffix_dedup.anchors(buf, offs)) == owners(*(np.concatenate(x) for x in zip(*parts, strict=True)))).all()
    body = buf[: 8_500_000].tobytes().decode()
    passage, key = buf[8_600_000:8_600_300].tobytes().decode(), "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, "X" + passage + "Y"), (2, body + " " + passage + f'. token = "{key}". Released under the MIT License.')]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.dedup_report(t).collect()}
    assert got == {1: (0, 0), 2: (300, 1)}
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert [x.item_ids for x in decontaminate.contamination(t, items).orderBy("doc_id").collect()] == [[7], [7]]
    assert [s.value for s in secret_scan.find_secrets(t, secret_scan.default_scanner(docs)).where("doc_id = 2").first().secrets] == [key]
    assert license_scan.scan_licences(t, license_scan.default_classifier(docs)).where("doc_id = 2").first().families == ["mit"]
    pages = t.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {x.page_id: x.payload_digest for x in warc.round_trip(pages).collect()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in rows}
