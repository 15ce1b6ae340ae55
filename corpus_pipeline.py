"""Corpus pipeline: reject, strip, deduplicate, decontaminate, mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All but the last
return the columns of ``documents``; the last returns the documents that the mix takes, with ``copies``.

Defined cases, each as its operator's docstring says: documents without words (null, empty or blank text) are
rejected by the first stage; rows without a ``doc_id`` are rows of their own, keep their lines, and of near duplicates
the one with a real id stays; rows of one id and text count as copies; an empty table, or tables without labels or
benchmark items, go through; extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.decontaminate import decontaminate
from sievework.llm.jaccard import keep_one
from sievework.llm.lines import drop_recurring
from sievework.llm.mixing import mix
from sievework.llm.quality import keep_good
from sievework.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; ``n_chars`` follows the text."""
    kept = drop_recurring(docs)
    length = F.length("text").cast("long")
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources want it; the rest goes."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing),
]

# The classifier's fit and the random rounding are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
