"""Operator 3 - token counts through a digest cache.

A document's key is the digest of its content and the digest of the tokenizer (library, version, vocabulary
file).  Keys are looked up in a stored table of counts; only distinct keys that miss are encoded, one document for
each, and their counts are appended to the store.

Encoding happens where the document is read: the ids that must be encoded (or, if they are fewer, those that must
not) are broadcast when their measured number is at most ``BROADCAST_IDS``; beyond it a shuffle join picks
the documents.  Texts that only rows without an id hold are picked by their digest, one row for each.  Within a task a byte-level vocabulary is applied to distinct pieces of text: such a
tokenizer splits before every space that follows a visible character, so the counts of the pieces add up to the
count of the text.  Other tokenizers get whole texts.

Normalisation must not change the count, so it is the identity here, but for null, which is the empty text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows, repeated ids and rows with a
null id each get the count of their text; equal texts are encoded once (or once for each row that repeats the chosen id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lean
from . import textops as T
from .common import cut, scratch_path

BROADCAST_IDS = 1_000_000  # 8 MB of ids
MEMO = 200_000
ENCODE_AT_ONCE = 4096  # an encoding holds some kilobytes until its ids are counted
_CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, the library that reads it and that library's version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        data = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)} {data}".encode()).hexdigest()


class Counter:
    """Counts tokens of whole texts, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.memo: dict[int, int] = {}
        self.pieces = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            added = "".join(x["content"] for x in spec.get("added_tokens", []))
            self.pieces = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and " " not in added
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            batch = getattr(model, "encode_batch_fast", model.encode_batch)
            count = lambda texts: [len(x) for x in batch(texts, add_special_tokens=False)]
        self.encode = lambda texts: [k for i in range(0, len(texts), ENCODE_AT_ONCE) for k in count(texts[i : i + ENCODE_AT_ONCE])]

    def block(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if not self.pieces:
            return np.array(self.encode([bytes(buf[offs[k] : offs[k + 1]]).decode() for k in range(n)]), dtype=np.int64)
        if not len(buf):
            return np.zeros(n, np.int64)
        start = np.zeros(len(buf), dtype=bool)
        start[1:] = (buf[1:] == 0x20) & (buf[:-1] > 0x20) & (buf[:-1] < 0x7F)
        start[offs[:-1][offs[:-1] < len(buf)]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(buf))
        doc = np.searchsorted(offs, s, side="right") - 1
        key, at, inverse = np.unique(T.span_hash(buf, s, e), return_index=True, return_inverse=True)
        counts = np.array([self.memo.get(k, -1) for k in key.tolist()], dtype=np.int64)
        miss = np.flatnonzero(counts < 0)
        if len(miss):
            raw = buf.tobytes()
            counts[miss] = self.encode([raw[s[a] : e[a]].decode() for a in at[miss]])
            if len(self.memo) + len(miss) > MEMO:
                self.memo.clear()
            self.memo.update(zip(key[miss].tolist(), counts[miss].tolist(), strict=True))
        return np.bincount(doc, weights=counts[inverse], minlength=n).astype(np.int64)


@functools.cache
def _counter(path: str) -> Counter:
    """One model per Python worker: workers outlive tasks, and a model is tens of megabytes."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``cache`` is the folder of the stored counts (created
    when missing; a fresh one in the shared scratch space by default)."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache = cache or scratch_path(spark, "token-cache")
    empty = spark.createDataFrame([], _CACHE)
    empty.write.mode("append").parquet(cache)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = cut(plain.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")

    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version)
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    misses = cut(wanted.join(stored.select("digest"), "digest", "left_anti"), "token-misses")

    n_rows, n_miss = keyed.count(), misses.count()
    if n_miss:
        ids = misses.select("doc_id").where("doc_id is not null")
        named = plain.where("doc_id is not null")
        if n_miss <= BROADCAST_IDS:
            chosen = named.join(F.broadcast(ids), "doc_id", "left_semi")
        elif n_rows - n_miss <= BROADCAST_IDS:
            chosen = named.join(F.broadcast(keyed.select("doc_id").join(ids, "doc_id", "left_anti")), "doc_id", "left_anti")
        else:
            chosen = named.join(ids, "doc_id", "left_semi")
        nameless = misses.where("doc_id is null").select("digest")
        if not nameless.isEmpty():
            digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
            rest = plain.where("doc_id is null").withColumn("digest", digest).join(nameless, "digest", "left_semi")
            chosen = chosen.select("text").unionByName(rest.dropDuplicates(["digest"]).select("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = _counter(tokenizer)
            counter.memo.clear()
            for batch in batches:
                column = batch.column(0)
                for i, j, buf, offs in T.blocks(column):
                    counts = counter.block(buf, offs)
                    raw = buf.tobytes()
                    digests = [hashlib.sha256(raw[offs[k] : offs[k + 1]]).digest() for k in range(j - i)]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * (j - i)), pa.array(counts)], names=["digest", "tokenizer", "n_tokens"])

        chosen.select("text").mapInArrow(lean.batches(run), _CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = cut(counts, "token-counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
