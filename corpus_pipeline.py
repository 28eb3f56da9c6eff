"""The corpus pipeline: five stages that turn documents into a clean, mixed training set.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the folder
that driver and executors share and reads it back as the next stage's documents, so a lost executor costs at most
one stage. All stages but the last keep the columns of documents; n_chars follows the text where a stage edits it.

Null and empty texts are scored like others and, if kept, pass the later stages unchanged. Empty tables give empty
results. Extra columns pass through.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.llm import decontamination, mixing, near_duplicates, quality, secrets
from logspark.llm.frames import bounded_batches, table
from logspark.session import shared_folder


def _with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """Brings n_chars up to date, where the documents have it."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.length("text").cast(kind))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    bounded_batches(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of at least 0.8."""
    bounded_batches(spark)
    return near_duplicates.representatives(docs, rule=near_duplicates.Similarity(words=5, percent=80))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of ten words of a benchmark item; mostly covered documents go."""
    bounded_batches(spark)
    return _with_length(docs, decontamination.clean(docs, table(spark, sf_dir, "benchmark"), window=10, coverage=0.5))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secret values replaced."""
    bounded_batches(spark)
    return _with_length(docs, secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    bounded_batches(spark)
    return mixing.repeated(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_of_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL expresses neither a trained ranking nor inferred formats; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
