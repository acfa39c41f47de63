"""Operator 5 - secret scanning: candidates by shape, false positives removed by a random forest.

1. *Corpus statistics*, one scan of all texts: byte transitions inside words (a 256 x 256 table) and the words that make up at least
   1 / ``DICTIONARY`` of the corpus (so at most ``DICTIONARY`` words, whatever its size).
2. *Forest*: labelled findings (text before, candidate, text after, path, label) become features - length, character
   transitions, dictionary coverage, path and neighbouring words - and Spark's random forest is fitted on at most
   ``MAX_FINDINGS`` of them.  Its nodes are read back from the saved model as arrays.
3. *Scan*, one pass over the texts: every candidate gets its features and the forest's vote where the text is read.
   Nothing is shuffled.

A candidate is a run of ``[A-Za-z0-9+/_=.-]`` of at least ``MIN_LENGTH`` characters that has a digit or mixed case, or the value (8 characters
at least) of an assignment whose name speaks of a secret, or the password (6 at least) of a URL, ``scheme://user:password@``.  Runs of any length are one candidate, but for a name and ``=`` before a value.  An
assigned value wins over the runs that it overlaps: it is one candidate to its end, whatever signs it holds, scored as the likeliest
of itself and the runs and values inside it.

The corpus holds no labelled findings; :func:`labelled_findings` makes them from public token formats and from shapes that are
often mistaken for secrets, with neighbouring words from the corpus dictionary.  Real findings can be passed instead.

Defined results: null and empty texts have no candidates; a null path is the empty path; repeated rows are judged each; an empty table
gives an empty result and an empty dictionary; extra columns pass through :func:`redact` untouched.
"""

from __future__ import annotations

import base64
import bisect
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lean, packed
from . import textops as T
from .common import cut, scratch_path

MIN_LENGTH = 16
DICTIONARY = 20_000
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 40, 8, 11
THRESHOLD = 0.5
MARK = "[secret removed]"
_NEAR = 80  # bytes of text kept on each side of a candidate
_FINDING = "before string, candidate string, after string, path string, label double"

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOW = np.zeros(256, dtype=bool)
_LOW[97:123] = True
_LETTER = _UPPER | _LOW
_LETTER[128:] = True

# Names and words that speak for or against a secret.
SECRET_WORDS = ("key", "secret", "token", "password", "passwd", "pwd", "auth", "bearer", "credential", "private", "apikey")
DIGEST_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "integrity", "etag", "revision", "hash")
PLACEHOLDER_WORDS = ("example", "sample", "dummy", "changeme", "your", "placeholder", "xxxx", "fake", "test", "redacted", "todo")
PATH_WORDS = ("test", "spec", "example", "mock", "fixture", "doc", "sample")
CONFIG_ENDS = (".env", ".yml", ".yaml", ".json", ".cfg", ".ini", ".pem", ".toml", ".properties", ".tfvars")

_NAME = re.compile(rb"(?:key|secret|token|password|passwd|pwd|auth|credential)[\w.-]{0,24}[\"']?[ \t]{0,3}$", re.I)
_VALUE = re.compile(rb"[:=>]{0,2}[ \t]{0,3}[\"']?([^\s\"'<>,;]{8,})")
_LOGIN = re.compile(rb"://[^\s/:@\"'<>]{0,64}:([^\s/\"'<>]{6,})@")
_HEAD = re.compile(rb"[A-Za-z_][\w.-]{0,39}=+")
_UUID = re.compile(rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_RUN = re.compile(rb"[A-Z]?[a-z]{3,}")  # as in spoken words, alone or in camel case
_REFERENCE = re.compile(rb"^[$<%{]|[({\[]|\benv\b|environ")  # a value that stands elsewhere
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+[0-9]*")


# --- corpus statistics ----------------------------------------------------------------------------------------


@dataclass
class Corpus:
    transitions: np.ndarray  # log10 probability of the second byte after the first
    words: frozenset[bytes]
    longest: int


def corpus_statistics(texts: DataFrame, dictionary: int = DICTIONARY) -> Corpus:
    """Statistics of the only column of ``texts``, over all rows."""

    def emit(words: dict[bytes, int], pairs: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(pairs)
        keys = list(words) + [bytes((p >> 8, p & 255)) for p in at.tolist()]
        kinds = np.concatenate((np.ones(len(words), np.int32), np.zeros(len(at), np.int32)))
        counts = np.concatenate((np.fromiter(words.values(), np.int64, len(words)), pairs[at]))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.binary()), pa.array(counts)], names=["kind", "key", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        pairs = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for _, _, buf, offs in T.blocks(batch.column(0)):
                if len(buf) < 2:
                    continue
                low = T.lower(buf)
                inside = _TOKEN[buf] | (buf > 127)
                both = inside[:-1] & inside[1:]
                both[offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(buf))] - 1] = False
                pairs += np.bincount((low[:-1].astype(np.int64) << 8 | low[1:])[both], minlength=1 << 16)
                s, e, _ = T.spans(~_LETTER[buf], offs)
                fit = (e - s >= 3) & (e - s <= 16)
                s, e = s[fit], e[fit]
                _, first, k = np.unique(T.span_hash(low, s, e), return_index=True, return_counts=True)
                raw = low.tobytes()
                for a, n in zip(first.tolist(), k.tolist(), strict=True):
                    w = raw[s[a] : e[a]]
                    words[w] = words.get(w, 0) + n
            if len(words) > packed.FLUSH >> 2:
                yield emit(words, pairs)
                words, pairs = {}, np.zeros(1 << 16, dtype=np.int64)
        yield emit(words, pairs)

    counted = cut(texts.mapInArrow(lean.batches(scan), "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "secret-corpus")
    total = counted.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // dictionary))
    words = [bytes(r["key"]) for r in counted.where((F.col("kind") == 1) & (F.col("n") >= least)).collect()]  # at most `dictionary`
    table = np.ones((256, 256))
    for r in counted.where("kind = 0").collect():  # at most one row per pair of bytes
        table[r["key"][0], r["key"][1]] += r["n"]
    return Corpus(np.log10(table / table.sum(1, keepdims=True)).astype(np.float32), frozenset(words), max(map(len, words), default=0))


# --- features -------------------------------------------------------------------------------------------------


FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "class_changes", "transition_mean", "transition_low", "entropy", "distinct", "longest_run",
    "longest_sequence", "hex", "uuid", "dots", "coverage", "digits_only", "quoted", "assigned", "secret_words", "digest_words", "placeholder", "path_words", "config_path", "neighbours", "letter_runs", "reference", "data_uri", "login",
)


def _coverage(word: bytes, corpus: Corpus) -> float:
    """Share of the letters that dictionary words cover (longest words first, from left to right)."""
    covered = total = 0
    for m in re.finditer(rb"[a-z\x80-\xff]+", word):
        w, i = m.group(), 0
        total += len(w)
        while i < len(w):
            size = next((k for k in range(min(corpus.longest, len(w) - i), 2, -1) if w[i : i + k] in corpus.words), 0)
            covered += size
            i += size or 1
    return covered / total if total else 0.0


def _has(text: bytes, words: tuple[str, ...]) -> float:
    return float(sum(w.encode() in text for w in words))


def neighbour_words(before: bytes, after: bytes) -> list[bytes]:
    return _WORD.findall(before.lower())[-4:] + _WORD.findall(after.lower())[:2]


def features(before: bytes, word: bytes, after: bytes, path: bytes, corpus: Corpus, odds: dict[bytes, float]) -> list[float]:
    """The features of one candidate, in the order of ``FEATURES``."""
    b = np.frombuffer(word, np.uint8)
    low = T.lower(b)
    n = len(b)
    kind = _DIGIT[b] * 1 + _UPPER[b] * 2 + _LOW[b] * 3
    steps = corpus.transitions[low[:-1], low[1:]] if n > 1 else np.zeros(1, np.float32)
    _, k = np.unique(b, return_counts=True)
    p = k / n
    d = np.diff(b.astype(np.int16))
    longest = lambda m: int(np.diff(np.concatenate(([-1], np.flatnonzero(~m), [len(m)]))).max()) / n if len(m) else 0.0
    text, lw = before.lower(), word.lower()
    near = neighbour_words(before, after)
    window = np.convolve(steps, np.ones(min(8, len(steps))) / min(8, len(steps)), "valid")
    stripped = before.rstrip(b" \t\"'")
    return [
        math.log2(n), (kind == 1).mean(), (kind == 2).mean(), (kind == 3).mean(), (kind == 0).mean(), (np.diff(kind) != 0).mean() if n > 1 else 0.0, float(steps.mean()), float(window.min()),
        float(-(p * np.log2(p)).sum()), len(k) / n, longest(d == 0), max(longest(d == 1), longest(d == -1)), float(re.fullmatch(rb"[0-9a-fA-F]+", word) is not None), float(_UUID.fullmatch(word) is not None), float(min(4, word.count(b"."))),
        _coverage(lw, corpus), float(word.isdigit()), float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")), float(stripped[-1:] in (b"=", b":")), _has(text[-40:], SECRET_WORDS), _has(text[-40:] + b" " + lw[:12], DIGEST_WORDS),
        _has(text[-40:] + b" " + lw + b" " + after.lower()[:20], PLACEHOLDER_WORDS), _has(path.lower(), PATH_WORDS), float(path.lower().endswith(tuple(x.encode() for x in CONFIG_ENDS))), sum(odds.get(w, 0.0) for w in near),
        sum(map(len, _RUN.findall(word))) / n, float(_REFERENCE.search(word) is not None or before[-2:] in (b"${", b"{{", b"$(")),
        float(before[-8:].lower() in (b";base64,", b" base64,")), float(after[:1] == b"@" and b"://" in before[-80:]),
    ]


# --- candidates -----------------------------------------------------------------------------------------------


def block_candidates(buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """``(text index, start, end)`` of the candidates of a block, in order, without overlaps."""
    return [c for c, _ in _with_parts(buf, offs)]


def _with_parts(buf: np.ndarray, offs: np.ndarray) -> list[tuple[tuple[int, int, int], list[tuple[int, int, int]]]]:
    """The candidates, each with the shaped runs and values that lie inside an assigned value: they are judged too, and any of them speaks
    for the whole value."""
    raw = buf.tobytes()
    out = _assigned(buf, offs, raw)
    begins = [v[1] for v, _ in out]
    s, e, doc = T.spans(~_TOKEN[buf], offs)
    fit = e - s >= MIN_LENGTH
    for a, z, d in zip(s[fit].tolist(), e[fit].tolist(), doc[fit].tolist(), strict=True):
        k = bisect.bisect_left(begins, z) - 1  # a value ends at no byte of a run, so the last one that begins before the run's end decides
        if k >= 0 and out[k][0][2] > a:
            value, parts = out[k]
            parts += [c for c in _shaped(buf, raw, d, max(a, value[1]), z) if c != value]
            edge = value[1]
        else:
            m = _HEAD.match(raw, a, z)
            edge = m.end() if m and _shaped(buf, raw, d, m.end(), z) else a
            out += [(c, []) for c in _shaped(buf, raw, d, edge, z)]
        if edge > a:  # a name is judged by itself if it has the shape of a secret
            out += [(c, []) for c in _shaped(buf, raw, d, a, a + len(raw[a:edge].rstrip(b"=")))]
    return sorted(out)


def _shaped(buf: np.ndarray, raw: bytes, d: int, a: int, z: int) -> list[tuple[int, int, int]]:
    """The run as a candidate, if it is long enough and has a digit or mixed case."""
    a += len(raw[a:z]) - len(raw[a:z].lstrip(b"./_-="))
    z = a + len(raw[a:z].rstrip(b"./_-"))
    x = buf[a:z]
    return [(d, a, z)] if z - a >= MIN_LENGTH and (_DIGIT[x].any() or (_UPPER[x[1:]].any() and _LOW[x].any())) else []


def _assigned(buf: np.ndarray, offs: np.ndarray, raw: bytes) -> list[tuple[tuple[int, int, int], list[tuple[int, int, int]]]]:
    """The values of assignments in order, each with the values of assignments inside it."""
    at = np.flatnonzero((buf == 0x3D) | (buf == 0x3A))
    held = np.searchsorted(offs, at, side="right") - 1
    edges = set()
    for p, d in zip(at.tolist(), held.tolist(), strict=True):
        lo, hi = int(offs[d]), int(offs[d + 1])
        if _NAME.search(raw[max(lo, p - 40) : p]):
            m = _VALUE.match(raw, p + 1, hi)
            if m:
                edges.add((d, m.start(1), m.end(1)))
    for p in [m.start() for m in re.finditer(b"://", raw)]:
        d = int(np.searchsorted(offs, p, side="right")) - 1
        m = _LOGIN.match(raw, p, int(offs[d + 1]))
        if m:
            edges.add((d, m.start(1), m.end(1)))
    out: list = []
    for v in sorted(edges):
        if out and v[1] < out[-1][0][2]:
            out[-1][1].append(v)
        else:
            out.append((v, []))
    return out


# --- labelled findings ----------------------------------------------------------------------------------------


def labelled_findings(words: list[str], n: int = 12_000, seed: int = SEED) -> list[tuple[str, str, str, str, float]]:
    """``(before, candidate, after, path, label)``: half secrets in public token formats, half look-alikes."""
    r = random.Random(seed)
    words = sorted(words) or ["the", "and", "value", "text", "line"]
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    spoken = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "", "n", "r", "st"]) for _ in range(r.randint(2, 4)))
    name = lambda: r.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "apikey", "private_key", "credential"])

    def phrase() -> tuple[str, bool]:
        """A password that people make: spoken syllables with digits and signs."""
        word = (spoken().capitalize() if r.random() < 0.5 else spoken()) + pick(string.digits, r.randint(1, 4)) + pick("!@#$%&*?", r.randint(1, 2)) + pick(alnum, r.randint(0, 4))
        return word.ljust(8, r.choice(string.digits)), False

    def login() -> tuple[str, str]:
        user = r.choice(["admin", "root", "app", "svc", "", spoken()])
        return f"{r.choice(['postgres', 'postgresql', 'mysql', 'mongodb', 'redis', 'amqp', 'https', 'ftp'])}://{user}:", f"@{r.choice(['db', 'host', 'cache', 'localhost', spoken()])}{r.choice(['', ':5432', '.internal', '/main'])}"

    def secret() -> tuple[str, bool]:
        return r.choice([
            lambda: (pick(hexa, r.choice([32, 40, 40, 64])), False),
            lambda: (base64.b64encode(r.randbytes(r.choice([24, 30, 32]))).decode(), False),
            lambda: ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), True),
            lambda: ("ghp_" + pick(alnum, 36), True),
            lambda: ("sk-" + pick(alnum, 48), True),
            lambda: (f"xoxb-{pick(string.digits, 12)}-{pick(alnum, 24)}", True),
            lambda: (f"eyJhbGciOiJIUzI1NiJ9.{pick(alnum, 40)}.{pick(alnum + '-_', 43)}", True),
            lambda: (pick(alnum + "!@#%&*?", r.randint(12, 24)), False),
        ])()

    def assignment() -> tuple[str, str]:
        n, q = name(), r.choice(['"', '"', "'", ""])
        sep = r.choice([" = ", " = ", "=", ": ", ":"])
        return n + sep + q, q

    def positive():
        if r.random() < 0.08:
            head, tail = login()
            word = pick(alnum + "!#%&*_-", r.randint(8, 24)) if r.random() < 0.6 else phrase()[0].replace("@", "!")
            return f"{some(4)} {r.choice(['', 'DATABASE_URL=', 'url: '])}{head}", word, f"{tail} {some(3)}", r.choice(["config/prod.env", "notes.txt", "", "crawl"]), 1.0
        word, known = secret()
        if known and r.random() < 0.3:
            head, q = some(2) + " ", " "
        else:
            head, q = assignment()
        path = r.choice(["src/app.py", "config/prod.env", "deploy.yml", "notes.txt", "", "crawl", "settings.json"])
        if r.random() < 0.15:
            head, word = head.upper(), word.upper()
        return f"{some(4)} {head}", word, f"{q} {some(3)}", path, 1.0

    def negative():
        q = ""
        kind = r.randrange(20)
        head, path = " ", r.choice(["src/app.py", "README.md", "docs/index.md", "notes.txt", "", "crawl", "test/fixture.json"])
        if kind == 0:
            word = pick(string.digits, r.choice([16, 16, 18, 20]))
        elif kind == 1:
            word, head = f"{r.choice(['mail', 'www', 'host'])}{r.randint(1, 99)}.{r.choice(words)}.example.com", r.choice([" ", "@", "http://"])
        elif kind == 2:
            word, head = pick(hexa, 40), r.choice([" commit ", " revision ", " sha1: ", " commit: "])
        elif kind == 3:
            word, head = pick(hexa, r.choice([32, 64])), r.choice([" sha256: ", ' checksum = "', " md5 ", ' integrity: "', " etag: "])
            q = '"' if head.endswith('"') else ""
        elif kind == 4:
            word = "-".join(r.choice(words) for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2030)}"
        elif kind == 5:
            word = "".join(r.choice(words).capitalize() for _ in range(r.randint(2, 5)))
        elif kind == 6:
            head, q = assignment()
            word = r.choice(["YOUR_API_KEY_HERE", "changeme-changeme-1", "xxxxxxxxxxxxxxxxxxxx1", "your-token-here-123", "example_secret_value_1", "REPLACE_WITH_TOKEN_1", "<your-password-here>", "dummy-password-0000", "test_token_example_1"])
        elif kind == 7:
            word = f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}.{r.randint(0, 59):02d}.{r.randint(0, 59):02d}Z"
        elif kind == 8:
            word = f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}"
            head = r.choice([" id ", " request ", "/", ' uuid = "'])
            q = '"' if head.endswith('"') else ""
        elif kind == 9:
            word = "/".join(r.choice(words) for _ in range(r.randint(3, 5))) + f"/{r.choice(words)}{r.randint(1, 9)}.html"
        elif kind == 10:
            word = r.choice("a0A=x-_1") * r.randint(18, 60) + r.choice("1a0B")
        elif kind == 11:
            head, q = assignment()
            word = r.choice(["0123456789abcdef0123456789abcdef", "abcdefghijklmnopqrstuvwxyz123456", "1234567890123456", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA1"])
        elif kind == 12:
            word = ".".join(r.choice(words) for _ in range(r.randint(3, 5))) + str(r.randint(0, 9))
        elif kind == 13:
            word = r.choice(["", "get", "Set"]) + "".join(spoken().capitalize() for _ in range(r.randint(3, 6))) + r.choice(["", "", str(r.randrange(9)), "V2"])
            word, head = word if any(c.isupper() for c in word[1:]) else word + "X1", r.choice([" class ", " extends ", " ", " import "])
        elif kind == 14:
            head, q = assignment()
            word = r.choice(["$" + "_".join(r.choice(words) for _ in range(2)).upper() + "_KEY", "{{" + r.choice(words) + "_value_1}}", f"process.env.{r.choice(words).upper()}_TOKEN", f"os.environ[{r.choice(words).upper()}1]", f"$({r.choice(words)}.read1)", f"%{r.choice(words)}_VALUE_1%"])
        elif kind == 15:
            word, head = f"{r.choice(['sha256', 'sha384', 'md5'])}{r.choice('-:=')}{base64.b64encode(r.randbytes(r.choice([16, 32, 48]))).decode()}", r.choice([' integrity="', ' hash: "', " checksum ", " "])
            q = '"' if head.endswith('"') else ""
        elif kind == 16:
            head, q = assignment()
            word = "_".join(r.choice(words) for _ in range(r.randint(2, 4))) + r.choice(["", "_id", "()", "1"])
            word = word if len(word) >= 8 else word + "_setting"
        elif kind == 17:  # an embedded picture or font
            word, q = base64.b64encode(r.randbytes(int(2 ** r.uniform(4, 11)))).decode(), r.choice(['"', "'", ")", ""])
            head = f" {r.choice(['src=', 'url(', '', 'href='])}{q if q != ')' else ''}data:{r.choice(['image/png', 'image/jpeg', 'image/gif', 'font/woff2', 'application/pdf'])};base64,"
        elif kind == 18:
            head, tail = login()
            word = r.choice(["password", "${DB_PASSWORD}", "<password>", "changeme", "your-password", "$PASSWORD", "{{password}}", "example1"])
            return f"{some(4)} {head}", word, f"{tail} {some(3)}", path, 0.0
        else:
            word, q = "_".join(r.choice(words) for _ in range(r.randint(3, 5))).upper() + f"_{r.randint(0, 99)}", ""
        if r.random() < 0.1:
            head, word = head.upper(), word.upper()
        return f"{some(4)}{head if head[:1] in ' @/' else ' ' + head}", word, f"{q} {some(3)}", path, 0.0

    return [(positive if k % 2 else negative)() for k in range(n)]


# --- the forest -----------------------------------------------------------------------------------------------


@dataclass
class Forest:
    """The trees of a fitted forest as arrays: a node is a leaf if its feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    vote: np.ndarray
    roots: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of the trees' probability for a secret, for each row of features."""
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                f = np.maximum(self.feature[node], 0)
                node = np.where(inner, np.where(x[rows, f] <= self.threshold[node], self.left[node], self.right[node]), node)
            out += self.vote[node]
        return out / max(1, len(self.roots))


@dataclass
class Scanner:
    corpus: Corpus
    odds: dict[bytes, float]
    forest: Forest

    def scan(self, buf: np.ndarray, offs: np.ndarray, paths: list[str | None]) -> list[tuple[int, int, int, float]]:
        """``(text index, start, end, score)`` of every candidate of a block."""
        found = _with_parts(buf, offs)
        judged = [(k, c) for k, (whole, parts) in enumerate(found) for c in (whole, *parts)]
        best = [0.0] * len(found)
        for at in range(0, len(judged), 1024):
            part = judged[at : at + 1024]
            x = np.array([self._features(buf, offs, *c, paths[c[0]]) for _, c in part])
            for (k, _), v in zip(part, self.forest.score(x).tolist(), strict=True):
                best[k] = max(best[k], v)
        return [(*c, v) for (c, _), v in zip(found, best, strict=True)]

    def _features(self, buf: np.ndarray, offs: np.ndarray, d: int, a: int, z: int, path: str | None) -> list[float]:
        lo, hi = max(int(offs[d]), a - _NEAR), min(int(offs[d + 1]), z + _NEAR)
        return features(buf[lo:a].tobytes(), buf[a:z].tobytes(), buf[z:hi].tobytes(), (path or "").encode(), self.corpus, self.odds)


def train(spark: SparkSession, findings: DataFrame, corpus: Corpus) -> Scanner:
    """Fit the forest on labelled findings (columns ``before, candidate, after, path, label``).  At most ``MAX_FINDINGS`` of them, chosen
    by hash, take part: this is the only bounded sample of the operator."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    held = findings.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "candidate", "after", "path")), F.col("label").cast("double").alias("label")).where("length(candidate) > 0 and label is not null")
    rows = held.orderBy(F.md5(F.concat_ws("|", *held.columns)), *held.columns).limit(MAX_FINDINGS).collect()
    odds = neighbour_odds(rows)
    data = [(r["label"], Vectors.dense(features(r["before"].encode(), r["candidate"].encode(), r["after"].encode(), r["path"].encode(), corpus, odds))) for r in rows]
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(spark.createDataFrame(data, ["label", "features"]).coalesce(1))
    path = scratch_path(spark, "secret-forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # at most TREES * 2 ** (DEPTH + 1)
    place = {(n["treeID"], n["id"]): k for k, n in enumerate(nodes)}
    leaf = [n["split"]["featureIndex"] < 0 for n in nodes]
    to = lambda n, side, is_leaf: 0 if is_leaf else place[n["treeID"], n[side]]
    forest = Forest(
        np.array([-1 if x else n["split"]["featureIndex"] for n, x in zip(nodes, leaf, strict=True)]),
        np.array([0.0 if x else n["split"]["leftCategoriesOrThreshold"][0] for n, x in zip(nodes, leaf, strict=True)]),
        np.array([to(n, "leftChild", x) for n, x in zip(nodes, leaf, strict=True)]),
        np.array([to(n, "rightChild", x) for n, x in zip(nodes, leaf, strict=True)]),
        np.array([n["impurityStats"][1] / max(1e-9, sum(n["impurityStats"])) if len(n["impurityStats"]) > 1 else 0.0 for n in nodes]),
        np.array([k for k, n in enumerate(nodes) if n["id"] == 0]),
    )
    return Scanner(corpus, odds, forest)


def neighbour_odds(rows: list) -> dict[bytes, float]:
    """Smoothed log odds of the words beside the findings: at least five findings must have the word."""
    yes: dict[bytes, int] = {}
    no: dict[bytes, int] = {}
    for r in rows:
        side = yes if r["label"] > 0.5 else no
        for w in set(neighbour_words(r["before"].encode(), r["after"].encode())):
            side[w] = side.get(w, 0) + 1
    return {w: math.log((yes.get(w, 0) + 5) / (no.get(w, 0) + 5)) for w in {*yes, *no} if yes.get(w, 0) + no.get(w, 0) >= 5}


def default_scanner(docs: DataFrame, text: str = "text") -> Scanner:
    """A scanner for this corpus from the built-in labelled findings."""
    spark = docs.sparkSession
    corpus = corpus_statistics(docs.select(F.col(text).cast("string").alias("text")))
    rows = labelled_findings([w for w in (b.decode(errors="ignore") for b in corpus.words) if w])
    return train(spark, spark.createDataFrame(rows, _FINDING), corpus)


# --- the operator ---------------------------------------------------------------------------------------------


def find_secrets(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_candidates, n_secrets, secrets`` of every row; a secret is ``(start, end, score, value)`` with byte offsets."""
    scanner = scanner or default_scanner(docs, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in T.blocks(batch.column(1)):
                n = j - i
                total, held = np.zeros(n, np.int64), [[] for _ in range(n)]
                for d, a, z, score in scanner.scan(buf, offs, batch.column(2).slice(i, n).to_pylist()):
                    total[d] += 1
                    if score >= threshold:
                        held[d].append({"start": a - int(offs[d]), "end": z - int(offs[d]), "score": score, "value": buf[a:z].tobytes().decode(errors="replace")})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(total), pa.array([len(x) for x in held], pa.int64()), pa.array(held, pa.list_(item))], names=["doc_id", "n_candidates", "n_secrets", "secrets"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(lean.batches(run), f"doc_id {kind}, n_candidates long, n_secrets long, secrets array<struct<start:bigint,end:bigint,score:double,value:string>>")


def redact(docs: DataFrame, scanner: Scanner | None = None, text: str = "text", path: str = "source", n_chars: str | None = "n_chars", threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; the column ``n_chars``, where there is one, follows the new text."""
    scanner = scanner or default_scanner(docs, text)
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    plain = docs.toDF(*names)
    at, where = cols.index(text), cols.index(path)
    size = cols.index(n_chars) if n_chars in cols else None
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for i, j, buf, offs in T.blocks(batch.column(at)):
                spans: dict[int, list[tuple[int, int]]] = {}
                for d, a, z, score in scanner.scan(buf, offs, batch.column(where).slice(i, j - i).to_pylist()):
                    if score >= threshold:
                        spans.setdefault(d, []).append((a, z))
                for d, edges in spans.items():
                    parts, last = [], int(offs[d])
                    for a, z in edges:
                        parts += [buf[last:a].tobytes().decode(), mark]
                        last = z
                    new[i + d] = "".join([*parts, buf[last : offs[d + 1]].tobytes().decode()])
            if not new:
                yield batch
                continue
            columns = list(batch.columns)
            columns[at] = _replaced(batch.column(at), new)
            if size is not None:
                columns[size] = _replaced(batch.column(size), {k: len(v) for k, v in new.items()})
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return plain.mapInArrow(lean.batches(run), schema).toDF(*cols)


def _replaced(column: pa.Array, new: dict) -> pa.Array:
    """``column`` with some of its values replaced."""
    import pyarrow.compute as pc

    mask = np.zeros(len(column), dtype=bool)
    mask[list(new)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[k] for k in sorted(new)], column.type))
