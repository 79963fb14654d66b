"""Tables several plans share: entity and relation rows of the documents, kept for the session.

The extraction is read by many reports; it is persisted once per session and
folder (spilling to disk, rebuilt from its lineage if an executor is lost).
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import chunking, extract
from strataloom.session import cut_lineage, load

_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
    return _KEPT[key]


def settled(spark: SparkSession, sf_dir: str, name: str, tables, make) -> DataFrame:
    """Rows of a report on columns, ``make(t)`` for each of ``tables``; kept per table.

    Those not kept yet are worked out in one job and written once: a report that reads them several times then plans a
    few rows, not the scans of all tables each time.
    """
    held = lambda t: (spark.sparkContext.applicationId, id(spark), sf_dir, f"{name} {t}") in _KEPT
    if missing := [t for t in tables if not held(t)]:
        rows = cut_lineage(reduce(DataFrame.unionByName, [make(t) for t in missing]).coalesce(1))
        for t in missing:
            kept(spark, sf_dir, f"{name} {t}", lambda t=t: rows.where(F.col("table") == t))
    return reduce(DataFrame.unionByName, [_KEPT[(spark.sparkContext.applicationId, id(spark), sf_dir, f"{name} {t}")] for t in tables])


def forget(spark: SparkSession) -> None:
    """Free what :func:`kept` holds."""
    for df in _KEPT.values():
        df.unpersist()
    _KEPT.clear()
    spark.catalog.clearCache()


def chunks(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumnRenamed("source", "source_id")
    return chunking.chunk(docs, keep=("source_id",))


def extracted(spark, sf_dir) -> DataFrame:
    """Entities and sentences of the chunks, read once for both tables below."""
    return kept(spark, sf_dir, "extracted", lambda: extract.extracted(chunks(spark, sf_dir), keep=("source_id",)))


def mentions(spark, sf_dir) -> DataFrame:
    """``doc_id, source_id, chunk_idx, pos, text, label, type``."""
    return extract.mentioned(extracted(spark, sf_dir), keep=("source_id",))


def relations(spark, sf_dir) -> DataFrame:
    """``doc_id, source_id, chunk_idx, sentence, i, j, source, target, relation, context`` and types."""
    return extract.related(extracted(spark, sf_dir), keep=("source_id",))


def entities(spark, sf_dir) -> DataFrame:
    """Deduplicated entities per source, the documents taken as its chunks."""
    def make():
        rows = mentions(spark, sf_dir).withColumn("chunk_idx", F.col("doc_id").cast("int"))
        return extract.dedupe_entities(rows, "source_id")

    return kept(spark, sf_dir, "entities", make)
