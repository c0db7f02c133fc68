"""The corpus pipeline: quality rules, toxicity, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns the columns of documents; the last returns
a row of digests for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftnet.llm import bpe, decontaminate, near_dup, quality, toxicity
from driftnet.llm.common import spool, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the fertility bands go."""
    return quality.keep_good(docs)


def toxic_severity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go; it is fitted on labelled documents among those that are left."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays."""
    return near_dup.keep_one(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also re-parameterised ones, go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encode_decode(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_severity), ("near_dedup", near_dedup), ("decontamination", benchmark_leaks), ("bpe", encoding)]
#: SQL has no tokenisers and no fitted models. tests/llm/test_pipeline.py compares each stage with plain Python or a library, over null, empty, long and
#: repeated rows and clashing columns; the toxicity model is taken as fitted there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs
