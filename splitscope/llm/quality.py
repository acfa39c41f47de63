"""Operator 7 - quality rules with host-level verdicts.

Every document is measured once (:func:`measure`), each rule marks failures, and failures are
aggregated by host.  A host's failure rate for a rule is shrunk towards the corpus with an empirical
beta prior: the prior's mean is the corpus rate and its strength comes from the spread between hosts
(beta-binomial moments).  A host is condemned for a rule when the lower 95 % bound of its posterior rate is
above the rule's limit.  Joined back to documents:

* a document that fails a *base* rule is rejected, whatever its host;
* a document that fails a *soft* rule is rejected only if its host is condemned for that rule, so one
  noisy page of a good site stays and a clean page of a bad site stays.

Defined results: null text counts as no text (all measures 0, rejected as too short); a null host has
no verdict of its own, its documents are judged by the base rules alone; repeated rows are each measured and each
count as a row; an empty table gives an empty result; extra columns of the input, whatever their names, pass
through :func:`quality_filter` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lean
from . import textops as T
from .common import cut

WINDOW_WORDS = 8
BROADCAST_BYTES = 16 << 20
SALTS = 32
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def base_rules() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    }


def soft_rules() -> dict[str, Column]:
    """Milder signs of junk that condemn a document only together with its host."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }


def block_measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of one block."""
    n = len(offs) - 1
    s, e, doc = T.words(buf, offs)
    n_words = T.word_counts(doc, n)
    per_text = lambda mask: _between(mask, offs)
    word_chars = per_text(~T._SPACE[buf] & ((buf & 0xC0) != 0x80))
    n_symbols = per_text(_IS_SYMBOL[buf])

    # lines that hold a word; a line equal to an earlier one of its text is a duplicate
    ls, le, ldoc = T.spans(buf == 0x0A, offs)
    has_word = np.searchsorted(s, le, side="left") > np.searchsorted(s, ls, side="left") if len(ls) else np.zeros(0, bool)
    ls, le, ldoc = ls[has_word], le[has_word], ldoc[has_word]
    n_lines = T.word_counts(ldoc, n)
    distinct = _distinct_by_doc(T.span_hash(buf, ls, le), ldoc, n)

    wh, first = T.windows(T.span_hash(buf, s, e), doc, WINDOW_WORDS)
    keys = T.mix(wh ^ T.mix(doc[first].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + WINDOW_WORDS, -1)
    covered = np.cumsum(edge)[:-1] > 0 if len(s) else np.zeros(0, bool)
    n_repeat = np.bincount(doc[covered], minlength=n).astype(np.int64)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_lines - distinct, "n_repeat_words": n_repeat}


def _between(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def _distinct_by_doc(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n).astype(np.int64)


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: the columns ``keep`` and the measures.  One scan, nothing shuffled."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(i) for i in range(len(keep))]
            for i, j, buf, offs in T.blocks(batch.column(len(keep))):
                got = block_measures(buf, offs)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in held), *(pa.array(got[m]) for m in MEASURES)], names=[*keep, *MEASURES])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(lean.batches(run), schema)


def host_verdicts(measured: DataFrame, host: str, limit: float = 0.3, z: float = 1.645) -> DataFrame:
    """One row per host: documents, and per rule the shrunk failure rate and the verdict.

    Hosts are aggregated with partial sums, so one host may hold most rows.  The prior of each rule needs
    six sums over hosts; they are joined back as a single row.
    """
    rules = base_rules() | soft_rules()
    n = F.col("n_docs")
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(f.cast("long")).alias(f"f_{r}") for r, f in rules.items()))
    spread = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n_all"), F.sum((n * n).cast("double")).alias("n_sq"),
        *(F.sum(f"f_{r}").alias(f"t_{r}") for r in rules),
        *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"q_{r}") for r in rules),
    )
    out = hosts.crossJoin(F.broadcast(spread))  # one row
    for r in rules:
        m = F.col(f"t_{r}") / F.col("n_all")
        between = F.col(f"q_{r}") - m * F.col(f"t_{r}")
        within = m * (1 - m)
        size = F.col("n_all") - F.try_divide(F.col("n_sq"), F.col("n_all"))
        rho = F.coalesce(F.try_divide(between - (F.col("k") - 1) * within, within * (size - (F.col("k") - 1))), F.lit(0.0))
        strength = 1 / F.greatest(F.lit(1e-4), F.least(F.lit(0.5), rho)) - 1
        total = n + strength
        rate = (F.col(f"f_{r}") + m * strength) / total
        low = rate - z * F.sqrt(rate * (1 - rate) / (total + 1))
        out = out.withColumns({f"rate_{r}": rate, f"bad_{r}": low > limit})
    return out.select(host, "n_docs", *(f"rate_{r}" for r in rules), *(f"bad_{r}" for r in rules))


def condemned(measured: DataFrame, host: str, limit: float = 0.3) -> tuple[DataFrame, bool]:
    """``__host, bad_...`` of the hosts that a soft rule condemns, written once, and whether their counted bytes allow a broadcast."""
    bad = [f"bad_{r}" for r in soft_rules()]
    hosts = cut(host_verdicts(measured, host, limit).where(" or ".join(bad)).select(F.col(host).alias("__host"), *bad), "quality-hosts")
    size = hosts.agg(F.sum(F.octet_length(F.col("__host").cast("string")) + 16)).first()[0] or 0
    return hosts, size <= BROADCAST_BYTES


def _by_host(measured: DataFrame, host: str, hosts: DataFrame, small: bool) -> DataFrame:
    """``measured`` with the column ``__condemned``: a soft rule fails and its host is condemned for that rule.

    A broadcast where the condemned hosts are small.  Beyond it only documents that fail a soft rule look for their host, by a join on
    host and salt: every condemned host comes ``SALTS`` times and its documents are dealt over the salts, so a hot host is no
    task's work; the other documents pass by without a shuffle."""
    soft = soft_rules()
    fails, found = F.lit(False), F.lit(False)
    for r, f in soft.items():
        fails = fails | F.coalesce(f, F.lit(False))
        found = found | (f & F.coalesce(F.col(f"bad_{r}"), F.lit(False)))
    drop = ["__host", "__salt", *(f"bad_{r}" for r in soft)]
    if small:
        return measured.join(F.broadcast(hosts), F.col(host) == F.col("__host"), "left").withColumn("__condemned", found).drop(*drop)
    salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told_apart = [f.name for f in measured.schema.fields if f.name != host and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    deal = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in told_apart)), F.lit(SALTS)).cast("int")  # of the row alone: the same in every attempt
    doubt = measured.where(fails).withColumn("__deal", deal)
    joined = doubt.join(salted, (F.col(host) == F.col("__host")) & (F.col("__deal") == F.col("__salt")), "left").withColumn("__condemned", found).drop("__deal", *drop)
    return measured.where(~fails).withColumn("__condemned", F.lit(False)).unionByName(joined)


def judge(measured: DataFrame, host: str, limit: float = 0.3) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.  ``measured`` is read twice: write it first where it is costly."""
    base = F.lit(False)
    for f in base_rules().values():
        base = base | f
    joined = _by_host(measured, host, *condemned(measured, host, limit))
    return joined.withColumn("base_failed", base).withColumn("kept", ~(F.col("base_failed") | F.col("__condemned"))).drop("__condemned")


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdict of every document.  The texts are scanned once; only measures are written and read again."""
    return judge(cut(measure(docs, [doc_id, host], text), "quality-measures"), host)


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with.

    Only (host, measures) take part in the host statistics.  The texts are scanned twice; they are not shuffled as long as the condemned hosts
    are small enough for a broadcast, and beyond that only the texts that fail a soft rule are."""
    found = condemned(measure(docs, [host], text), host)
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    measured = _with_measures(docs.toDF(*names), names[cols.index(text)])
    for f in base_rules().values():
        measured = measured.where(~f)
    return _by_host(measured, names[cols.index(host)], *found).where(~F.col("__condemned")).select(*names).toDF(*cols)


def _with_measures(docs: DataFrame, text: str) -> DataFrame:
    at = docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in T.blocks(batch.column(at)):
                got = block_measures(buf, offs)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), *(pa.array(got[m]) for m in MEASURES)], names=[*batch.schema.names, *MEASURES])

    return docs.mapInArrow(lean.batches(run), schema)
