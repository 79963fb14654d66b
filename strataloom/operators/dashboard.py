"""Roll-ups over run tables: scores, KPIs, section picks, ingestion and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.numeric import count_if, rnd
from strataloom.operators.profile import side_by_side

SCORES = ("overall_kg_quality_score", "confidence_score", "retrieval_readiness_score", "graph_trust_score")
SUMS = ("total_records", "total_columns", "duplicate_rows", "anomaly_count", "entities_extracted", "relationships_extracted", "schema_drift_count", "orphan_relationships", "processing_time_ms")
FLAGS = ("supports_time_series", "supports_correlation", "supports_kg_metrics", "supports_feature_importance")


def _mean(df: DataFrame, c: str, digits: int = 4):
    return rnd(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(f"avg_{c}") if c in df.columns else F.lit(0.0).alias(f"avg_{c}")


def db_runs(runs: DataFrame) -> DataFrame:
    """Run count, average scores and joinability totals of database runs."""
    joins = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("strong", "medium", "weak") if c in runs.columns]
    return runs.agg(F.count("*").alias("run_count"), *[_mean(runs, c) for c in SCORES], *joins)


def file_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("run_count"), _mean(runs, "graph_density", 6), *[_mean(runs, c) for c in SCORES[:3]])


def combined(db: DataFrame, files: DataFrame) -> DataFrame:
    """Both run tables as one row: run-weighted means, summed KPIs, any() flags. File runs trust their confidence."""
    files = files if "graph_trust_score" in files.columns else files.withColumn("graph_trust_score", F.col("confidence_score"))
    both = db.withColumn("kind", F.lit("db")).unionByName(files.withColumn("kind", F.lit("file")), allowMissingColumns=True)
    means = [_mean(both, c) for c in SCORES] + [_mean(both, c, 2) for c in ("missing_pct", "timestamp_coverage_pct")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS if c in both.columns]
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in FLAGS if c in both.columns]
    return both.agg(count_if(F.col("kind") == "db").alias("db_runs"), count_if(F.col("kind") == "file").alias("file_runs"), *means, *sums, *flags)


def warnings(row: DataFrame) -> DataFrame:
    """Sections no run supports."""
    named = {"correlation": "supports_correlation", "time_series": "supports_time_series"}
    cells = [F.when(~F.col(c), F.lit(s)) for s, c in named.items() if c in row.columns]
    return row.select(F.explode(F.array_compact(F.array(*cells))).alias("section"))


def best_run(sections: DataFrame) -> DataFrame:
    """Per section the newest run with usable data, else the newest; ``run_id, section, usable, completed_at``."""
    order = W.partitionBy("section").orderBy(F.desc("usable"), F.desc("completed_at"), "run_id")
    return sections.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def ingestion_report(status: DataFrame) -> DataFrame:
    """Counts by state, duplicates by checksum and totals; duplicates are counted without listing a group."""
    done = F.col("status") == "completed"
    twins = status.where(F.col("checksum").isNotNull()).groupBy("checksum").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates_detected"))
    one = status.agg(
        F.count("*").alias("total_files"), count_if(done).alias("completed"), count_if(F.col("status") == "failed").alias("failed"),
        count_if(~F.col("status").isin("completed", "failed", "uploaded")).alias("processing"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(f"total_{c}") for c in ("chunks", "entities", "relations")],
    )
    return side_by_side(one, twins)


def quality_metrics(status: DataFrame, pages: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Completion, schema validity, citation coverage, trust and effectiveness in one row.

    ``accuracy`` has one row per database run: ``high_risk_edge_ratio,
    contradiction_ratio, calibration_proxy_error, evidence_count``.
    """
    done = F.col("status") == "completed"
    one = side_by_side(
        status.agg(
            F.count("*").alias("total_files"), count_if(done).alias("completed_files"), count_if(F.col("status") == "failed").alias("failed_files"),
            count_if(done & F.col("schema_valid")).alias("schema_valid_files"), count_if(done & F.col("schema_valid").isNotNull()).alias("checked"),
        ),
        pages.agg(F.count("*").alias("page_count"), F.coalesce(F.sum("facts_with_citations"), F.lit(0)).alias("cited"), F.coalesce(F.sum("total_facts"), F.lit(0)).alias("facts")),
        accuracy.agg(
            F.count("*").alias("runs"), *[rnd(F.coalesce(F.avg(c), F.lit(0.0))).alias(c) for c in ("high_risk_edge_ratio", "contradiction_ratio", "calibration_proxy_error")],
            F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence"),
        ),
    )
    least = lambda c: F.greatest(F.lit(1), F.col(c))
    return one.select(
        "total_files", "completed_files", "failed_files", rnd(100.0 * F.col("completed_files") / least("total_files"), 2).alias("completion_rate_pct"),
        rnd(100.0 * F.col("schema_valid_files") / least("checked"), 2).alias("schema_valid_rate_pct"), "page_count", rnd(100.0 * F.col("cited") / least("facts"), 2).alias("citation_coverage_pct"),
        "high_risk_edge_ratio", "contradiction_ratio", "calibration_proxy_error",
        rnd(F.greatest(F.lit(0.0), 1.0 - (F.col("high_risk_edge_ratio") + F.col("contradiction_ratio")) / 2.0)).alias("knowledge_graph_effectiveness_score"),
        rnd(F.least(F.lit(1.0), F.col("evidence") / F.greatest(F.lit(1), F.col("runs") * 10))).alias("relationship_effectiveness_score"),
    )


def by_source(ents: DataFrame, rels: DataFrame, chunks: DataFrame, source: str = "source_id") -> DataFrame:
    """Chunks, entities, relations and mean confidence per source."""
    e = ents.groupBy(source).agg(F.count("*").alias("entities"), F.avg("confidence").alias("mean_confidence"))
    r = rels.groupBy(source).agg(F.count("*").alias("relations"))
    c = chunks.groupBy(source).agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))
    return c.join(e, source, "full_outer").join(r, source, "full_outer").fillna(0, ["entities", "relations", "chunks", "words"])


def status_list(files: DataFrame, dbs: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """Newest first; database rows get the columns files have."""
    out = files if dbs is None else files.unionByName(dbs, allowMissingColumns=True)
    return out.withColumn("status", F.coalesce("status", F.lit("unknown"))).orderBy(F.desc("uploaded_at"), "file_id").limit(limit)
