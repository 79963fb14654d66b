"""A vectors table that grows by appends: rows known by their content, batches that count once a manifest names them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.vectors import DIMENSION, hash_vectors

MANIFEST = "batch string, vectors long, gen int, dim int"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed batch; none where nothing was committed yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest") if there else spark.createDataFrame([], MANIFEST)


def read_index(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> DataFrame:
    """``key, digest, vector`` of all committed batches; what a failed append left behind is not read.

    The batch is a partition column: folders that the manifest does not name are pruned.
    """
    committed = _manifest(spark, path)
    schema = f"`{key}` {kind}, digest string, vector array<double>, batch string"
    if committed.isEmpty():
        return spark.createDataFrame([], schema).drop("batch")
    return spark.read.schema(schema).parquet(f"{path}/vectors").join(committed.select("batch"), "batch", "left_semi").drop("batch")


def append_index(df: DataFrame, path: str, key: str, text: str = "text", gen: int = 1, dim: int = DIMENSION) -> int:
    """Embed the texts that the index does not hold yet and append them; gives the number of new vectors.

    A row is known by its key and the digest of its text, so an append that is
    run again, or overlaps with an earlier one, adds nothing twice; a changed
    text of a known key is a new row. Of the index only keys and digests are
    read, and only the rows of this append's digests are moved on. Vectors are
    written to a folder of their own; then one manifest row, a single file that
    appears by a rename, makes the batch count. A failure before that leaves
    the index as it was. One writer at a time. A null text is an empty one; a
    null key is a key like others. Other columns are left out.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    if not _manifest(spark, path).where((F.col("gen") != gen) | (F.col("dim") != dim)).isEmpty():
        raise ValueError(f"{path} holds vectors of another rule set or length")
    words = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), words.alias("t"), F.sha2(F.encode(words, "UTF-8"), 256).alias("digest")).dropDuplicates(["k", "digest"])
    held = read_index(spark, path, key, kind).select(F.col(key).alias("known"), F.col("digest").alias("seen"))
    same = F.col("k").eqNullSafe(F.col("known")) & (F.col("digest") == F.col("seen"))
    here = held.join(rows.select("k", "digest"), same, "left_semi")
    fresh = rows.join(here, same, "left_anti").select(F.struct("k", "digest").alias("id"), "t")
    # A letter first: a name of digits alone would be read back as a number.
    batch = f"b{uuid.uuid4().hex}"
    folder = f"{path}/vectors/batch={batch}"
    hash_vectors(fresh, "id", "t", gen, dim).select(F.col("id.k").alias(key), "id.digest", "vector").write.parquet(folder)
    added = spark.read.parquet(folder).count()
    if added:
        named = spark.range(1, numPartitions=1).select(F.lit(batch).alias("batch"), F.lit(added).cast("long").alias("vectors"), F.lit(gen).alias("gen"), F.lit(dim).alias("dim"))
        named.write.mode("append").json(f"{path}/manifest")
    return added
