"""Corpus preparation as stages over ``documents``.

Every stage works on all that its predecessor kept and is written to the shared folder before the next one reads it, so a lost
executor costs at most the stage at work.

Defined results, stage by stage.  Quality rules: null, empty and short texts go; a null source has no host verdict.  N-gram join: rows with a null id
stay, different texts of one id are judged each by itself, of rows that repeat id and text one stays.  Decontamination: rows are judged each by itself; an empty benchmark keeps all.  Secret scans: every
row stays, ``n_chars`` follows the text.  Mixing: a row for each time a document is taken, a null source is the source ''; documents without
tokens come with their block.  An empty table gives an empty table in every stage; columns beyond those of documents pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitscope.llm import decontaminate, lean, mixing, ngram_join, quality, secret_scan
from splitscope.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    lean.small_batches(spark)
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    lean.small_batches(spark)
    return ngram_join.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    lean.small_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    lean.small_batches(spark)
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they are taken, epoch by epoch, to meet the sources' weights."""
    lean.small_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_removal),
    ("mixing sources", source_mixing),
]
# Edit distances and a trained forest are beyond SQL: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
