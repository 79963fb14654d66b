"""File scans: reader by extension, table rows as typed cells and text, block confidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numeric import as_col, clamp, ratio, rnd

CORPUS = ("source_id", "source_type", "block_id", "kind", "text")
# Extensions read as tables; every other extension is read as text.
TABLE_FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text, undecodable bytes left out: ``source_id, text, bytes``."""
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.translate(F.make_valid_utf8(raw), "\ufffd", ""))
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("source_id"), text.alias("text"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("fingerprint"),
    )


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An array of objects (or JSON lines) as a table."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_shape(texts: DataFrame) -> DataFrame:
    """Mark each JSON text: a non-empty array of objects is a table, the rest is text."""
    items = F.from_json("text", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    table = F.col("text").rlike(r"^\s*\[") & (F.size(items) > 0) & ~F.exists(items, lambda m: m.isNull())
    return texts.withColumn("as_table", F.coalesce(table, F.lit(False))).withColumn(
        "record_count", F.when(F.col("text").rlike(r"^\s*\["), F.coalesce(F.json_array_length("text"), F.lit(0))).otherwise(F.lit(1))
    )


def _blocks(df: DataFrame, fmt: str) -> DataFrame:
    return df.select(
        F.input_file_name().alias("source_id"), F.lit(fmt).alias("source_type"),
        F.sha1(F.to_json(F.struct(*df.columns))).alias("block_id"), F.lit("row").alias("kind"), row_text(df).alias("text"),
    )


def _json_blocks(texts: DataFrame) -> DataFrame:
    """A file that holds a non-empty array of objects gives a block per object, any other its text."""
    shaped = json_shape(texts)
    items = F.from_json("text", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    pairs = F.transform(F.map_entries("item"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    rows = shaped.where("as_table").select("source_id", F.explode(items).alias("item")).select(
        "source_id", F.sha1(F.to_json("item")).alias("block_id"), F.lit("row").alias("kind"), F.array_join(pairs, "; ").alias("text")
    )
    rest = shaped.where("NOT as_table").select("source_id", F.lit("0").alias("block_id"), F.lit("text").alias("kind"), "text")
    return rows.unionByName(rest).select("source_id", F.lit("json").alias("source_type"), "block_id", "kind", "text")


def _either_case(kind: str) -> str:
    """Glob of the extension ``kind`` in any case."""
    return "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in kind)


def _csv_frames(spark: SparkSession, path: str, glob: str) -> list[DataFrame]:
    """A frame per header line (the first that is not blank), so that no file is read under another's header.

    The paths of the CSV files reach the driver, as for any list of files to read.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), "value",
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"),
    ).where("start = 0 AND trim(value) <> ''")
    heads = lines.groupBy("path").agg(F.min_by("value", "line").alias("header"))
    found = heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    one_file = any(p.endswith(path.rstrip("/")) for r in found for p in r["paths"])
    # Columns of partition folders are kept.
    base = {} if one_file or re.search(r"[*?\[\]{}]", path) else {"basePath": path}
    reader = spark.read.options(header=True, inferSchema=True, **base)
    return [reader.csv([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in r["paths"]]) for r in found]


def read_corpus(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Corpus blocks ``source_id, source_type, block_id, kind, text``, each file of ``path`` by its extension (all by ``fmt`` if given).

    Tables give one block per row, everything else one block per file. A table
    reader that finds no columns falls back to the text scan. CSV files are read
    per header line. The set of extensions and the CSV paths reach the driver.
    """
    listed = spark.read.format("binaryFile").load(path).select(extension(F.col("path")).alias("kind")).distinct()
    kinds = [fmt.lower()] if fmt else sorted(r["kind"] for r in listed.collect())
    parts, read_as_text = [], []
    for kind in kinds:
        glob = _either_case(kind) if not fmt and kind else "*"
        files = spark.read.option("pathGlobFilter", glob)
        if kind == "json":
            parts.append(_json_blocks(read_text(spark, path).where(F.lit(fmt is not None) | (extension(F.col("source_id")) == kind))))
        elif kind in TABLE_FORMATS:
            frames = _csv_frames(spark, path, glob) if kind == "csv" else [files.format(kind).load(path)]
            tables = [df for df in frames if df.columns and "_corrupt_record" not in df.columns]
            parts += [_blocks(df, kind) for df in tables]
            if not tables:
                read_as_text.append(kind)
        else:
            read_as_text.append(kind)
    if read_as_text:
        texts = read_text(spark, path).withColumn("source_type", extension(F.col("source_id"))).where(F.lit(fmt is not None) | F.col("source_type").isin(read_as_text))
        parts.append(texts.select("source_id", "source_type", F.lit("0").alias("block_id"), F.lit("text").alias("kind"), "text"))
    if not parts:
        raise ValueError(f"no files in {path}")
    return reduce(DataFrame.unionByName, parts)


def cell_type(df: DataFrame, c: str) -> Column:
    """Cell type name: null, bool, int, float or string."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.BooleanType):
        name = "bool"
    elif isinstance(kind, T.IntegralType):
        name = "int"
    elif isinstance(kind, T.FractionalType):
        name = "float"
    else:
        name = "string"
    return F.when(F.col(c).isNull(), "null").otherwise(name)


def typed_cells(df: DataFrame, key: str, cols=None) -> DataFrame:
    """Long typed cells: ``key, column, value, value_type``."""
    cols = list(cols or [c for c in df.columns if c != key])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), cell_type(df, c).alias("value_type")) for c in cols
    ]
    return df.select(key, F.explode(F.array(*cells)).alias("cell")).select(key, "cell.*")


def row_text(df: DataFrame, cols=None) -> Column:
    """``a=1; b=2`` without null cells."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in (cols or df.columns)]
    return F.concat_ws("; ", *parts)


def rows_to_text(df: DataFrame, table: str, row_idx: str, cols=None) -> DataFrame:
    """``row_idx, text`` with text ``table T row i: a=1; b=2``."""
    cols = list(cols or [c for c in df.columns if c != row_idx])
    head = F.concat(F.lit(f"table {table} row "), F.col(row_idx).cast("string"), F.lit(": "))
    return df.select(row_idx, F.concat(head, row_text(df, cols)).alias("text"))


def alnum_ratio(c) -> Column:
    """Share of letters, digits and white space."""
    text = as_col(c)
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return ratio(kept, F.greatest(F.lit(1), F.length(text)))


def block_confidence(blocks: DataFrame, gen: int = 1, digits: int = 4) -> DataFrame:
    """Parser confidence per block; low ones are noise regions, and ``needs_ocr`` follows the second rule set."""
    share = alnum_ratio("text")
    size = F.least(F.lit(1.0), F.length("text") / 1200.0)
    score = F.least(F.lit(1.0), 0.55 * size + 0.45 * share) if gen == 1 else share
    return blocks.withColumn("confidence", rnd(clamp(score), digits)).withColumn("noise_region", F.col("confidence") < 0.45)


def needs_ocr(scored: DataFrame, source: str = "source_id") -> DataFrame:
    """Mean block confidence per source and whether a scan needs OCR (below .4)."""
    return scored.groupBy(source).agg(rnd(F.avg("confidence")).alias("parser_confidence"), F.count("*").alias("blocks")).withColumn(
        "needs_ocr", F.col("parser_confidence") < 0.4
    )


def fingerprints(df: DataFrame, content: str, key: str) -> DataFrame:
    """``key, fingerprint, size_bytes`` from the content bytes."""
    data = F.encode(F.col(content), "UTF-8") if isinstance(df.schema[content].dataType, T.StringType) else F.col(content)
    return df.select(key, F.sha2(data, 256).alias("fingerprint"), F.octet_length(data).cast("long").alias("size_bytes"))
