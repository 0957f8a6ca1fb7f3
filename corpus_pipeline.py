"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from pyspark.sql import DataFrame, SparkSession

from driftpool.llm import decontaminate as benchmark
from driftpool.llm import pii, sentencepieces, simhash, toxicity as toxic
from driftpool.session import ship, staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the calibrated trees, fitted on the labelled documents still here, score as toxic."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxic.fit(docs, labels)
    score = toxic.unused(docs, "toxic_score")
    kept = model.score(docs, "text", score)
    return kept.filter(kept[score] < toxic.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    ship(spark)
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ten words of a benchmark item occurs."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark.cleaned(docs, items)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; every document stays."""
    ship(spark)
    return pii.redacted(docs, pii.spans(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the pieces of every text under merge-dropout as ``token_ids``."""
    ship(spark)
    return sentencepieces.encoded(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("encoding", encoding)]

# trees, fingerprints and merges are no SQL; tests compare the stages with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
