"""Daily series: counts, smoothing, spikes, change points.

Windows here run over one row per calendar day (and series), so the sorted
side stays a few thousand rows however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numeric import as_col, count_if, ratio, rnd
from strataloom.functions.text import strip

# The date layouts tried after ISO, in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss")


def parse_datetime(c) -> Column:
    """ISO text first, then five layouts; null when nothing fits."""
    text = strip(as_col(c).cast("string"))
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def daily(df: DataFrame, cols=None, by=()) -> DataFrame:
    """``[by], date, count`` over all datetime columns taken together."""
    cols = list(cols or datetime_columns(df))
    days = F.array_compact(F.array(*[F.to_date(F.col(c)) for c in cols]))
    return df.select(*by, F.explode(days).alias("date")).groupBy(*by, "date").agg(F.count("*").alias("count"))


def smooth(series: DataFrame, window: int = 3, by=()) -> DataFrame:
    """Trailing mean and population deviation over the last ``window`` days present."""
    frame = W.partitionBy(*by).orderBy("date").rowsBetween(-(window - 1), 0)
    return series.withColumn("moving_average", F.avg("count").over(frame)).withColumn(
        "volatility", F.stddev_pop("count").over(frame)
    )


def spikes(series: DataFrame, window: int = 3, k: float = 2.0, by=()) -> DataFrame:
    """Days at least ``k`` deviations away from their trailing mean."""
    gap = F.abs(F.col("count") - F.col("moving_average"))
    return (
        smooth(series, window, by)
        .where((F.col("volatility") > 0) & (gap >= k * F.col("volatility")))
        .withColumn("z_proxy", rnd(gap / F.col("volatility")))
        .select(*by, "date", "count", "z_proxy")
    )


def change_points(series: DataFrame, least: int = 3, by=()) -> DataFrame:
    """Days whose count moved by ``least`` or more against the day before."""
    delta = F.col("count") - F.lag("count").over(W.partitionBy(*by).orderBy("date"))
    return series.withColumn("delta", delta).where(F.abs("delta") >= least).select(*by, "date", "count", "delta")


def coverage(labelled: DataFrame) -> DataFrame:
    """Share of datetime-like columns; needs ``column`` and ``label``."""
    like = (F.col("label") == "datetime") | F.lower("column").rlike("date|time|timestamp")
    return labelled.agg(
        count_if(like).alias("datetime_columns"),
        F.count("*").alias("columns"),
        rnd(100.0 * ratio(count_if(like), F.count("*")), 2).alias("timestamp_coverage_pct"),
    )
