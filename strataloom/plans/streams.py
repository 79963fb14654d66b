"""Streaming jobs run to the end of the given tables, compared with the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.plans.extraction import MENTIONS
from strataloom.plans.graphs import REL
from strataloom.plans.registry import query
from strataloom.session import load, work_folder
from strataloom.streaming import jobs


def stream(spark, sf_dir, table):
    return jobs.read_folder(spark, f"{sf_dir}/{table}*.parquet", load(spark, sf_dir, table).schema)


@query(
    "stream_duplicates",
    "SELECT doc_id, sha256(text) AS sha, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents",
)
def stream_duplicates(spark, sf_dir):
    folder = work_folder(spark, "stream-dedup")
    jobs.dedup(stream(spark, sf_dir, "documents"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


@query(
    "stream_graph_nodes",
    f"WITH {MENTIONS} SELECT lower(text) AS id, round(0.5 + 0.01 * least(20, count(*)), 4)::DOUBLE AS confidence FROM m GROUP BY 1",
)
def stream_graph_nodes(spark, sf_dir):
    folder = work_folder(spark, "stream-graph")
    jobs.graph_upsert(stream(spark, sf_dir, "documents"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return jobs.read_graph(spark, f"{folder}/out")[0].select("id", "confidence")


@query(
    "stream_graph_edges",
    f"WITH {REL} SELECT lower(source) AS source, lower(target) AS target, relation, round(0.4 + 0.01 * least(20, count(*)), 4)::DOUBLE AS confidence FROM r WHERE lower(source) <> lower(target) GROUP BY 1, 2, 3",
)
def stream_graph_edges(spark, sf_dir):
    folder = work_folder(spark, "stream-graph")
    jobs.graph_upsert(stream(spark, sf_dir, "documents"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return jobs.read_graph(spark, f"{folder}/out")[1].select("source", "target", "relation", "confidence")


@query("stream_memory", f"WITH {MENTIONS} SELECT lower(text) AS term, count(*) AS observations, round(least(0.95, 0.5 + 0.05 * count(*)), 4)::DOUBLE AS prior FROM m GROUP BY 1")
def stream_memory(spark, sf_dir):
    folder = work_folder(spark, "stream-memory")
    jobs.memory(stream(spark, sf_dir, "documents"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return jobs.latest(spark, f"{folder}/out", ["term"])


@query("stream_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    folder = work_folder(spark, "stream-daily")
    jobs.daily_counts(stream(spark, sf_dir, "events"), "ts", f"{folder}/out", f"{folder}/ck", by=["event_type"]).awaitTermination()
    return jobs.latest(spark, f"{folder}/out", ["date", "event_type"]).withColumn("date", F.col("date").cast("string"))
