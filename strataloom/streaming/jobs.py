"""Streaming jobs: duplicate screening, graph upsert, term memory, daily counts.

Every ``foreachBatch`` writes to a folder named by its batch id and overwrites
it, so a batch that is run again after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.functions.ids import edge_key
from strataloom.functions.numeric import rnd
from strataloom.operators import chunking, extract, graph


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files under a folder or glob."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _start(df: DataFrame, each, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Batch folders of a table; no folder yet gives an empty frame."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _mark(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one checksum: the first of all batches, by (null, key) within its batch, is the original.

    Only the least row so far is held back, so a checksum with very many rows streams through.
    """
    fresh, held = not state.exists, None
    for frame in frames:
        flags = np.ones(len(frame), bool)
        if fresh:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
                flags = np.ones(len(frame), bool)
            at = _least(frame)
            held = frame.iloc[at : at + 1]
            if len(frame) == 1:
                continue
            frame, flags = frame.drop(index=frame.index[at]), flags[1:]
        frame["duplicate"] = flags
        yield frame
    if held is not None:
        state.update((True,))
        held = held.copy()
        held["duplicate"] = False
        yield held


def _least(frame: pd.DataFrame) -> int:
    """Place of the row with the smallest key, null keys last."""
    if len(frame) == 1:
        return 0
    known = np.flatnonzero(~frame["no_key"].to_numpy())
    return int(known[frame["k"].to_numpy()[known].argmin()]) if len(known) else 0


def dedup(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Mark arriving texts that were seen before, against the whole history.

    Writes ``key, sha, duplicate``; the first batch's smallest key of a checksum is
    the original, a null key comes last, null texts are copies of each other. The
    history is one bit of keyed state per checksum: a batch looks up its own
    checksums and reads nothing that earlier batches wrote. Where it lives is the
    session's choice; for a history beyond memory set its state store to RocksDB.
    """
    kind = docs.schema[key].dataType.simpleString()
    sums = docs.select(
        F.coalesce(F.sha2(F.encode(text, "UTF-8"), 256), F.lit("")).alias("sha"), F.col(key).isNull().alias("no_key"),
        F.coalesce(F.col(key), F.lit("0").cast(kind)).alias("k"),
    )
    marked = sums.groupBy("sha").applyInPandasWithState(_mark, f"sha string, no_key boolean, k {kind}, duplicate boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    rows = marked.select(F.when(~F.col("no_key"), F.col("k")).alias(key), F.nullif("sha", F.lit("")).alias("sha"), "duplicate")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start(rows, each, checkpoint)


def dedup_within(docs: DataFrame, stamp: str, delay: str = "7 days", text: str = "text") -> DataFrame:
    """Texts not seen within the watermark; the state is bounded by ``delay``."""
    return docs.withColumn("sha", F.sha2(F.encode(text, "UTF-8"), 256)).withWatermark(stamp, delay).dropDuplicatesWithinWatermark(["sha"])


NODE_SCHEMA = "id string, label string, entity_type string, confidence double"
EDGE_SCHEMA = "source string, target string, relation string, confidence double"


def graph_upsert(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Extract each arriving batch and merge its graph into the stored one.

    A batch writes its own nodes and edges and reads nothing of earlier ones. As
    merging is associative (the oldest label, the largest confidence),
    :func:`read_graph` merges what was written, and :func:`compact_graph` does so
    now and then for good.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        pieces = chunking.chunk(batch, key)
        nodes, edges = graph.build(extract.entities(pieces, key), extract.relations(pieces, key))
        nodes = nodes.withColumn("confidence", rnd(0.5 + 0.01 * F.least(F.lit(20), F.col("mentions"))))
        edges = edges.withColumn("confidence", rnd(0.4 + 0.01 * F.least(F.lit(20), F.col("mentions"))))
        nodes.select("id", "label", "entity_type", "confidence").write.mode("overwrite").parquet(f"{out}/nodes/batch_id={batch_id}")
        edges.select("source", "target", "relation", "confidence").write.mode("overwrite").parquet(f"{out}/edges/batch_id={batch_id}")

    return _start(docs, each, checkpoint)


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Last batches of the complete compactions of a table, the newest at the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/base_*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("base_")) for f in found)


def _merged(spark: SparkSession, path: str, schema: str, upto: int = 1 << 62) -> DataFrame:
    """Newest compaction and the batches after it, up to one, as rows of one graph table."""
    bases = [b for b in _bases(spark, f"{path}_base") if b <= upto]
    rows = _read(spark, path, f"{schema}, batch_id long").where(F.col("batch_id") <= upto)
    if bases:
        base = spark.read.schema(schema).parquet(f"{path}_base/base_{bases[-1]}").withColumn("batch_id", F.lit(-1).cast("long"))
        rows = rows.where(F.col("batch_id") > bases[-1]).unionByName(base)
    return rows


def _node_rows(rows: DataFrame) -> DataFrame:
    age = lambda c: F.struct("batch_id", c)
    return rows.groupBy("id").agg(
        F.min_by("label", age("label")).alias("label"), F.min_by("entity_type", age("entity_type")).alias("entity_type"), rnd(F.max("confidence")).alias("confidence")
    )


def _edge_rows(rows: DataFrame) -> DataFrame:
    return rows.where("source <> target").groupBy("source", "target", "relation").agg(rnd(F.max("confidence")).alias("confidence"))


def read_graph(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of all batches so far, with edge keys."""
    edges = _edge_rows(_merged(spark, f"{out}/edges", EDGE_SCHEMA))
    return _node_rows(_merged(spark, f"{out}/nodes", NODE_SCHEMA)), edges.withColumn("edge_key", edge_key("source", "relation", "target"))


def compact_graph(spark: SparkSession, out: str, upto: int) -> None:
    """Merge all batches up to ``upto`` (a finished one) into one version of each table.

    Readers take the newest complete version, so a run that breaks off changes
    nothing. Earlier versions and the merged batches may be deleted afterwards.
    """
    for name, schema, merge in (("nodes", NODE_SCHEMA, _node_rows), ("edges", EDGE_SCHEMA, _edge_rows)):
        merge(_merged(spark, f"{out}/{name}", schema, upto)).write.mode("overwrite").parquet(f"{out}/{name}_base/base_{upto}")


def memory(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Term observations with a saturating prior, kept as streaming state; an observation is a term in a chunk."""
    found = extract.entities(chunking.chunk(docs, key), key).select(F.lower("text").alias("term"))
    counts = found.groupBy("term").agg(F.count("*").alias("observations"))

    def each(batch: DataFrame, batch_id: int) -> None:
        prior = rnd(F.least(F.lit(0.95), 0.5 + 0.05 * F.col("observations")))
        batch.withColumn("prior", prior).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start(counts, each, checkpoint, "update")


def daily_counts(events: DataFrame, stamp: str, out: str, checkpoint: str, delay: str | None = None, by=()) -> StreamingQuery:
    """Events per day. The state is one count per day and key, and no event is too late.

    With a ``delay`` days are closed, and their state is freed, once the
    watermark passes them; later events are then left out.
    """
    dated = events.withColumn("_at", F.col(stamp).cast("timestamp"))
    dated = dated.withWatermark("_at", delay) if delay else dated
    counts = dated.groupBy(F.window("_at", "1 day").alias("w"), *by).agg(F.count("*").alias("count"))
    rows = counts.select(F.to_date("w.start").alias("date"), *by, "count")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start(rows, each, checkpoint, "update")


def latest(spark: SparkSession, out: str, keys) -> DataFrame:
    """Newest row per key of a table written in update mode."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("r")).select(*keys, "r.*")
