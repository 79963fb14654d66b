"""Schema introspection: tables, columns, keys, and the schema as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table string, column string, type string, nullable boolean, ordinal int"


def columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, from the frames' schemas (metadata only, no scan)."""
    rows = [
        (name, f.name, f.dataType.simpleString(), f.nullable, i)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def tables(spark: SparkSession, frames: Mapping[str, DataFrame], constraints: DataFrame | None = None) -> DataFrame:
    """``table, column_count, row_count, pk_columns, fk_count`` per table."""
    counts = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    width = columns(spark, frames).groupBy("table").agg(F.count("*").alias("column_count"))
    out = counts.join(F.broadcast(width), "table")
    if constraints is not None:
        keys = constraints.groupBy("table").agg(
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "PK", F.col("column")))), ",").alias("pk_columns"),
            F.count(F.when(F.col("kind") == "FK", 1)).alias("fk_count"),
        )
        out = out.join(F.broadcast(keys), "table", "left").withColumn("fk_count", F.coalesce("fk_count", F.lit(0)))
    return out


def from_session(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Frames of the session catalog's tables, system schemas left out."""
    skip = {"information_schema", "pg_catalog", "sys", "mysql", "performance_schema"}
    databases = [database] if database else [d.name for d in spark.catalog.listDatabases()]
    return {
        f"{d}.{t.name}" if not database else t.name: spark.table(f"{d}.{t.name}")
        for d in databases
        if d.lower() not in skip
        for t in spark.catalog.listTables(d)
        if not t.isTemporary
    }


def schema_text(catalog: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """``table, text``: one text block per table, a line per column and key."""
    lines = catalog.select(
        "table",
        F.col("ordinal").cast("long").alias("position"),
        F.concat(
            F.lit("- "), F.col("column"), F.lit(" ("), F.col("type"),
            F.when(F.col("nullable"), ", nullable").otherwise(", not null"), F.lit(")"),
        ).alias("line"),
    )
    if constraints is not None:
        lines = lines.unionByName(
            constraints.select(
                "table",
                F.lit(1_000_000).cast("long").alias("position"),
                F.concat(F.lit("* "), "kind", F.lit(" "), "column", F.coalesce(F.concat(F.lit(" -> "), "refers"), F.lit(""))).alias("line"),
            )
        )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("table").agg(F.concat(F.lit("Table "), F.col("table"), F.lit("\n"), body).alias("text"))


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds=None, parts: int = 64, **options) -> DataFrame:
    """JDBC scan, split by a numeric column when its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        low, high = bounds
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
