"""A training-corpus pipeline: toxicity, quality, near-duplicates, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return rows
of ``documents`` with its columns; the last returns the pieces of the documents in packed sequences.

Defined cases, alike in all stages: a null text counts as empty; rows with a null id are judged like others
and never near-duplicates; of rows that repeat an id near-duplicate removal leaves one; ties keep the
smallest id; an empty table gives an empty result; extra columns, whatever their names, are kept up to the
last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outcomelake.llm.minhash import one_of_each
from outcomelake.llm.mixing import mixed
from outcomelake.llm.packing import pack
from outcomelake.llm.queries import MIXTURE
from outcomelake.sources.storage import new_path, remove, scratch, written
from outcomelake.llm.subword import without_low_quality
from outcomelake.llm.weak_supervision import without_toxic
from outcomelake.packaging import ship_package


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    ship_package(spark)
    return without_toxic(docs, _labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted of low quality go."""
    ship_package(spark)
    return without_low_quality(docs, _labels(spark, sf_dir))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) one document stays."""
    ship_package(spark)
    return one_of_each(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as their rates say, so that languages have their target parts of the tokens."""
    ship_package(spark)
    return mixed(docs, _labels(spark, sf_dir), weights=MIXTURE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, copies too, packed into sequences of at most 1024 tokens."""
    ship_package(spark)
    return pack(docs, capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted classifiers and tokenizers are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written to the shared folder and read again.

    Of each stage but the last only what it returned stays, until the next one has read it.
    """
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if kept:
            remove(spark, kept)
        kept = path
    return STAGES[-1][1](spark, docs, sf_dir)
