"""Sinks: artifacts, triples, metric records, lineage, run exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of the run export.
EXPORT_COLUMNS = (
    "source", "run_id", "name", "status", "quality_score", "confidence_score", "retrieval_readiness_score", "trust_score",
    "total_records", "total_columns", "missing_pct", "anomaly_count", "entities_extracted", "relationships_extracted",
    "processing_time_ms", "supports_correlation", "supports_time_series", "supports_kg_metrics", "supports_feature_importance",
)


def lineage_events(df: DataFrame, stage: str, detail=None, source: str = "source_id") -> DataFrame:
    """``source_id, stage, at, detail`` rows to append to a lineage table."""
    return df.select(
        F.col(source).cast("string").alias("source_id"), F.lit(stage).alias("stage"), F.current_timestamp().alias("at"),
        (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def _replace(df: DataFrame, path: str, by: tuple[str, ...], fmt: str = "parquet") -> None:
    """Write ``df`` and replace only those partitions of ``by`` that it holds.

    Rows are brought together by partition first, few files each; a large
    partition is split over tasks by its size.
    """
    dealt = df.hint("rebalance", *by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def append_lineage(df: DataFrame, stage: str, path: str, batch: str, detail=None, source: str = "source_id") -> None:
    """Append the events of a batch; the same batch written again, as by a retry, replaces itself."""
    _replace(lineage_events(df, stage, detail, source).withColumn("batch", F.lit(batch)), path, ("stage", "batch"))


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, stage, batch, at, detail`` of all batches."""
    schema = "source_id string, at timestamp, detail string, stage string, batch string"
    return spark.read.schema(schema).parquet(path).select("source_id", "stage", "batch", "at", "detail")


def write_artifact(df: DataFrame, path: str, stage: str, source: str = "source_id", fmt: str = "json") -> None:
    """One folder per stage and source; rewriting a source replaces only its folder.

    A null source has a folder of its own; an empty source name is read back as null.
    """
    _replace(df.withColumn("stage", F.lit(stage)), path, ("stage", source), fmt)


def read_artifact(spark: SparkSession, path: str, schema: str, stage: str, source: str = "source_id", fmt: str = "json") -> DataFrame:
    """Rows of one stage; ``schema`` names the columns beside stage and source, which are text."""
    full = f"{schema}, stage string, `{source}` string"
    return spark.read.schema(full).format(fmt).load(path).where(F.col("stage") == stage)


def triples(edges: DataFrame, subject: str = "source", predicate: str = "relation", target: str = "target") -> DataFrame:
    return edges.select(F.col(subject).alias("s"), F.col(predicate).alias("p"), F.col(target).alias("o"))


def write_triples(edges: DataFrame, path: str, by: str = "source_id", **names) -> None:
    """Triples in one folder per source ``by``; rewriting a source replaces only its triples."""
    named = {"subject": "source", "predicate": "relation", "target": "target", **names}
    out = edges.select(F.col(named["subject"]).alias("s"), F.col(named["predicate"]).alias("p"), F.col(named["target"]).alias("o"), F.col(by))
    _replace(out, path, (by,))


def read_triples(spark: SparkSession, path: str, by: str = "source_id") -> DataFrame:
    return spark.read.schema(f"s string, p string, o string, `{by}` string").parquet(path)


def write_metrics(df: DataFrame, path: str, batch: str) -> None:
    """Append metric records ``run_id, stage, family, metric, value``; the same batch written again replaces itself."""
    cols = [F.col(c).cast("string").alias(c) for c in ("run_id", "stage", "family", "metric")]
    _replace(df.select(*cols, F.col("value").cast("double").alias("value"), F.lit(batch).alias("batch")), path, ("stage", "batch"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    schema = "run_id string, family string, metric string, value double, stage string, batch string"
    return spark.read.schema(schema).parquet(path)


def metrics_by_stage(records: DataFrame) -> DataFrame:
    """Metric means and record counts per stage, family and metric."""
    return records.groupBy("stage", "family", "metric").agg(
        F.count("*").alias("records"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def run_export(db_runs: DataFrame, file_runs: DataFrame) -> DataFrame:
    """Database rows then file rows in the export layout; file runs trust their confidence."""
    def shape(df, kind):
        have = set(df.columns)
        missing = {"trust_score": F.col("confidence_score")} if kind == "file" else {}
        cols = [
            F.lit(kind).alias(c) if c == "source" else
            F.lit("completed").alias(c) if c == "status" and c not in have else
            missing[c].alias(c) if c in missing and c not in have else
            F.col(c) if c in have else F.lit(None).alias(c)
            for c in EXPORT_COLUMNS
        ]
        return df.select(*cols)

    both = shape(db_runs, "db").unionByName(shape(file_runs, "file"))
    # A column that neither side has is text without values.
    return both.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in both.schema])


def export_runs(db_runs: DataFrame, file_runs: DataFrame, path: str) -> None:
    run_export(db_runs, file_runs).write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """An export read back; ``schema`` is that of :func:`run_export`. Empty cells are null."""
    return spark.read.options(header=True, escape='"').schema(schema).csv(path)
