"""The cleaning pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetally.llm import bpe, decontamination, near_duplicates, personal_data, toxicity
from scenetally.llm.common import discard, prepare, read, shared_folder, unused
from scenetally.llm.plans import vocabulary

THRESHOLD = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < THRESHOLD).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays, so do those without words."""
    return near_duplicates.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in the text is replaced by its kind."""
    hidden = personal_data.masked(docs, personal_data.sampled_model(docs))
    if "n_chars" not in docs.columns:
        return hidden
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to the digests of the query."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", encoded),
]

# SQL can't express the learned stages; tests/llm compares each stage with plain loops over its own input
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
