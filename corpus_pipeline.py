"""A training corpus from raw documents: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import byte_bpe, decontaminate, ngram_join, pii, toxicity
from strataloom.llm.common import drop_folder, table
from strataloom.session import work_folder

#: An example; a real key comes from where secrets are kept.
KEY = b"an example key of the pipeline"

#: Rows that cross to Python at a time. Of whole texts Spark's 10,000 take buffers of some 64 MB in each task.
CROSSING = 1000


def few_at_a_time(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session whose Arrow batches are short from then on; a stage runs only when its result is written."""

    @wraps(stage)
    def own(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CROSSING))
        return stage(spark, docs, sf_dir)

    return own


@few_at_a_time
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers call toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


@few_at_a_time
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return ngram_join.one_of_each(docs)


@few_at_a_time
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@few_at_a_time
def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and mail names become pseudonyms."""
    return pii.pseudonymise(docs, KEY, counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@few_at_a_time
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    return byte_bpe.encode_and_check(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", replace_personal),
    ("byte_bpe", encode),
]

#: Learning, components and token ids are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again, the one before it then deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last is not None:
            drop_folder(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
