"""Databases and files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.numeric import rnd
from strataloom.operators import vectors
from strataloom.plans import base, reports
from strataloom.plans.graphs import REL
from strataloom.plans.registry import query
from strataloom.plans.vectors import HASH_SQL
from strataloom.session import load, work_folder
from strataloom.sources import index, sinks, sqlite


@query("sqlite_orders", "SELECT * FROM orders")
def sqlite_orders(spark, sf_dir):
    """``orders`` written into SQLite databases and read back in ranges of its key."""
    folder = work_folder(spark, "sqlite-orders")
    sqlite.write_table(load(spark, sf_dir, "orders"), folder, "orders")
    return sqlite.read_table(spark, folder, "orders", key="o_orderkey")


@query(
    "sqlite_open_orders",
    """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice > 50000 AND o_custkey IS NOT NULL GROUP BY o_orderpriority""",
)
def sqlite_open_orders(spark, sf_dir):
    """Open orders by priority; the comparisons run in the databases."""
    folder = work_folder(spark, "sqlite-open")
    sqlite.write_table(load(spark, sf_dir, "orders"), folder, "orders")
    found = sqlite.read_table(spark, folder, "orders").where("o_orderstatus = 'O' AND o_totalprice > 50000 AND o_custkey IS NOT NULL")
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,6)")), 2).cast("double").alias("total"))


@query(
    "sqlite_databases",
    "SELECT 'customer' AS \"table\", count(*) AS row_count, 5::BIGINT AS columns, true AS reachable, true AS sound FROM customer UNION ALL SELECT 'orders', count(*), 6, true, true FROM orders",
)
def sqlite_databases(spark, sf_dir):
    """Two tables as databases: can executors reach them, are they sound, what do they hold."""
    folder, out = work_folder(spark, "sqlite-two"), None
    for name in ("customer", "orders"):
        path = f"{folder}/{name}"
        sqlite.write_table(load(spark, sf_dir, name), path, name)
        rows = sqlite.read_table(spark, path, name).agg(F.count("*").alias("row_count"))
        shape = sqlite.catalog(spark, path).groupBy("table").agg(F.count("*").alias("columns"))
        state = sqlite.check(spark, path).agg(F.bool_and("reachable").alias("reachable"), F.bool_and("sound").alias("sound"))
        one = shape.crossJoin(rows).crossJoin(state)  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("table", "row_count", "columns", "reachable", "sound")


def _first_source(docs):
    """Rows of the source that comes first by name; one row of another frame decides."""
    first = docs.agg(F.min("source").alias("first"))
    return docs.join(F.broadcast(first), F.col("source") == F.col("first"), "left_semi")


@query(
    "artifact_rewrite",
    """SELECT 'upload' AS stage, source AS source_id, doc_id, n_chars, coalesce(CASE WHEN source = (SELECT min(source) FROM documents) THEN 2 END, 1)::INTEGER AS revision FROM documents""",
)
def artifact_rewrite(spark, sf_dir):
    """JSON artifacts of all documents, one source written again in a second revision, all read back."""
    folder, docs = work_folder(spark, "artifacts"), load(spark, sf_dir, "documents")
    for revision, rows in ((1, docs), (2, _first_source(docs))):
        shaped = rows.select(F.col("source").alias("source_id"), "doc_id", "n_chars", F.lit(revision).alias("revision"))
        sinks.write_artifact(shaped, folder, "upload")
    back = sinks.read_artifact(spark, folder, "doc_id long, n_chars long, revision int", "upload")
    return back.select("stage", "source_id", "doc_id", "n_chars", "revision")


@query(
    "lineage_log",
    """SELECT CAST(doc_id AS VARCHAR) AS source_id, 'upload' AS stage, source AS detail FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'clean', lang FROM documents""",
)
def lineage_log(spark, sf_dir):
    """Events of two stages appended, the first batch twice as after a failure, all read back."""
    folder, docs = work_folder(spark, "lineage"), load(spark, sf_dir, "documents")
    for stage, detail in (("upload", "source"), ("clean", "lang"), ("upload", "source")):
        sinks.append_lineage(docs, stage, folder, "first", F.col(detail), "doc_id")
    return sinks.read_lineage(spark, folder).select("source_id", "stage", "detail")


@query("triples_by_source", f"WITH {REL} SELECT src AS source_id, source AS s, relation AS p, target AS o FROM r")
def triples_by_source(spark, sf_dir):
    """Triples of all relations in a folder per source, one source written again, all read back."""
    folder, rows = work_folder(spark, "triples"), base.relations(spark, sf_dir)
    sinks.write_triples(rows, folder)
    first = rows.agg(F.min("source_id").alias("first"))
    sinks.write_triples(rows.join(F.broadcast(first), F.col("source_id") == F.col("first"), "left_semi"), folder)
    return sinks.read_triples(spark, folder).select("source_id", "s", "p", "o")


@query(
    "metrics_log",
    """WITH m AS (SELECT 'documents' AS stage, 'size' AS family, unnest(['rows', 'characters']) AS metric, unnest([n, c])::DOUBLE AS value FROM (SELECT count(*) AS n, coalesce(sum(n_chars), 0) AS c FROM documents GROUP BY source)
UNION ALL SELECT 'events', 'size', 'rows', count(*)::DOUBLE FROM events GROUP BY event_type)
SELECT stage, family, metric, count(*) AS records, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM m GROUP BY 1, 2, 3""",
)
def metrics_log(spark, sf_dir):
    """Metric records of two stages appended, the first batch twice as after a failure, read back and grouped."""
    folder = work_folder(spark, "metrics")
    sizes = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg(
        F.count("*").cast("double").alias("rows"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("double").alias("characters")
    ).unpivot(["run_id"], ["rows", "characters"], "metric", "value").withColumn("stage", F.lit("documents"))
    kinds = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.count("*").cast("double").alias("value"))
    kinds = kinds.select("run_id", F.lit("rows").alias("metric"), "value", F.lit("events").alias("stage"))
    for records in (sizes, kinds, sizes):
        sinks.write_metrics(records.withColumn("family", F.lit("size")), folder, "first")
    return sinks.metrics_by_stage(sinks.read_metrics(spark, folder)).select("stage", "family", "metric", "records", rnd("mean").alias("mean"), "low", "high")


@query("run_export_csv")
def run_export_csv(spark, sf_dir):
    """The run export, all of its columns, written as CSV and read back."""
    folder, name = work_folder(spark, "runs"), ("overall_kg_quality_score", "quality_score")
    tables, files = (runs(spark, sf_dir).withColumnRenamed(*name) for runs in (reports.table_runs, reports.source_runs))
    sinks.export_runs(tables, files, folder)
    return sinks.read_runs(spark, folder, sinks.run_export(tables, files).schema)


@query("vector_index", f"{HASH_SQL} SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM s")
def vector_index(spark, sf_dir):
    """Hash vectors of one source appended, then those of all documents: each is there once."""
    folder, docs = work_folder(spark, "index"), load(spark, sf_dir, "documents")
    for rows in (_first_source(docs), docs):
        index.append_index(rows, folder, "doc_id")
    found = vectors.sparsify(index.read_index(spark, folder, "doc_id"), "doc_id")
    return found.select("doc_id", "bucket", rnd("weight", 6).alias("weight"))
