"""Distributions and outliers of numeric columns."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numeric import count_if, ratio, rnd
from strataloom.operators.ranks import SORT_LIMIT, number, order_statistics

QUANTILES = {"p10": 0.10, "q1": 0.25, "median": 0.50, "q3": 0.75, "p90": 0.90}
Z_BANDS = ("<-3", "-3..-2", "-2..2", "2..3", ">3")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def one_row_to_long(row: DataFrame, cols, fields: dict[str, str]) -> DataFrame:
    """Turn a one-row frame with ``{field}__{i}`` columns into one row per column."""
    cells = [
        F.struct(
            F.lit(c).alias("column"), *[F.col(f"{name}__{i}").cast(t).alias(name) for name, t in fields.items()]
        )
        for i, c in enumerate(cols)
    ]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def moments(df: DataFrame, cols) -> DataFrame:
    """One scan, one row per column: n, min, max, mean, variance, std, skewness, kurtosis."""
    aggs = []
    for i, c in enumerate(cols):
        v = number(c)
        aggs += [
            F.count(v).alias(f"n__{i}"),
            F.min(v).alias(f"min__{i}"),
            F.max(v).alias(f"max__{i}"),
            F.avg(v).alias(f"mean__{i}"),
            F.var_pop(v).alias(f"variance__{i}"),
            F.stddev_pop(v).alias(f"std__{i}"),
            F.coalesce(F.skewness(v), F.lit(0.0)).alias(f"skewness__{i}"),
            F.coalesce(F.kurtosis(v), F.lit(0.0)).alias(f"kurtosis__{i}"),
        ]
    fields = {"n": "long", **{k: "double" for k in ("min", "max", "mean", "variance", "std", "skewness", "kurtosis")}}
    return one_row_to_long(df.agg(*aggs), cols, fields)


def _counts(df: DataFrame, cols) -> dict[str, int]:
    row = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: row[i] for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols, points: dict[str, float] | None = None, sort_limit: int = SORT_LIMIT) -> DataFrame:
    """Exact linear-interpolation quantiles at ``(n - 1) * p``, one row per column."""
    points = points or QUANTILES
    n = _counts(df, cols)
    ranks, plan = {}, []
    for c in cols:
        for name, p in points.items():
            if not n[c]:
                continue
            k = (n[c] - 1) * p
            low = int(k)
            high = min(low + 1, n[c] - 1)
            ranks.setdefault(c, set()).update((low, high))
            plan += [(c, name, low, 1.0 - (k - low)), (c, name, high, k - low)]
    if not plan:
        return df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{p} double" for p in points))
    values = order_statistics(df, ranks, n, sort_limit)
    weights = df.sparkSession.createDataFrame(plan, "column string, name string, rank long, weight double")
    return (
        values.join(F.broadcast(weights), ["column", "rank"])
        .groupBy("column")
        .agg(*[F.sum(F.when(F.col("name") == p, F.col("value") * F.col("weight"))).alias(p) for p in points])
    )


def describe(df: DataFrame, cols=None, sort_limit: int = SORT_LIMIT) -> DataFrame:
    """Moments, quantiles, IQR and fences per numeric column."""
    cols = list(cols or numeric_columns(df))
    iqr = F.greatest(F.lit(0.0), F.col("q3") - F.col("q1"))
    return (
        moments(df, cols)
        .join(F.broadcast(quantiles(df, cols, sort_limit=sort_limit)), "column", "left")
        .withColumn("iqr", iqr)
        .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
        .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))
    )


def column_facts(df: DataFrame, cols) -> dict[str, Row]:
    """``describe`` as driver-side parameters: one row per column of the schema."""
    return {r["column"]: r for r in describe(df, cols).collect()}


def outliers(df: DataFrame, cols=None, z: float = 3.0, strict: bool = False, facts=None) -> DataFrame:
    """Outlier counts per column by IQR fences and by \\|z\\| >= ``z`` (> when ``strict``)."""
    cols = list(cols or numeric_columns(df))
    facts = facts or column_facts(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        f, v = facts[c], number(c)
        fenced = (v < f["lower_fence"]) | (v > f["upper_fence"]) if f["n"] else F.lit(False)
        aggs.append(count_if(fenced).alias(f"iqr_outliers__{i}"))
        if f["std"]:
            score = F.abs((v - f["mean"]) / f["std"])
            hit = score > z if strict else score >= z
        else:
            hit = F.lit(False)
        aggs.append(count_if(hit).alias(f"zscore_outliers__{i}"))
        aggs.append(F.count(v).alias(f"n__{i}"))
    return one_row_to_long(df.agg(*aggs), cols, {"n": "long", "iqr_outliers": "long", "zscore_outliers": "long"})


def z_outliers(df: DataFrame, cols=None, z: float = 3.0) -> DataFrame:
    """The z-score part of :func:`outliers`: ``column, n, zscore_outliers`` by two scans of one job, without quantiles."""
    cols = list(cols or numeric_columns(df))
    facts = df.agg(*[f(number(c)).alias(f"{name}__{i}") for i, c in enumerate(cols) for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    cells = df.select(*[number(c).alias(f"v__{i}") for i, c in enumerate(cols)]).crossJoin(F.broadcast(facts))
    aggs = []
    for i in range(len(cols)):
        v, mean, std = F.col(f"v__{i}"), F.col(f"mean__{i}"), F.col(f"std__{i}")
        aggs += [count_if(F.when(std != 0, F.abs((v - mean) / std) >= z)).alias(f"zscore_outliers__{i}"), F.count(v).alias(f"n__{i}")]
    return one_row_to_long(cells.agg(*aggs), cols, {"n": "long", "zscore_outliers": "long"})


def outlier_values(df: DataFrame, cols=None, z: float = 3.0, strict: bool = False, keep: int = 25) -> DataFrame:
    """Smallest ``keep`` distinct outlying values per column: ``column, position, value``."""
    cols = list(cols or numeric_columns(df))
    facts = column_facts(df, cols)
    cells = []
    for c in cols:
        f, v = facts[c], number(c)
        if f["std"]:
            score = F.abs((v - f["mean"]) / f["std"])
            hit = score > z if strict else score >= z
            cells.append(F.when(hit, F.struct(F.lit(c).alias("column"), F.round(v, 6).alias("value"))))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, position int, value double")
    found = df.select(F.explode(F.array_compact(F.array(*cells))).alias("r")).select("r.*").distinct()
    rank = F.row_number().over(W.partitionBy("column").orderBy("value"))
    return found.withColumn("position", rank).where(F.col("position") <= keep).select("column", "position", "value")


def z_bands(df: DataFrame, cols=None) -> DataFrame:
    """Counts in five z-score bands: ``column, band, count``."""
    cols = list(cols or numeric_columns(df))
    facts = {r["column"]: r for r in moments(df, cols).collect()}
    aggs = []
    for i, c in enumerate(cols):
        f, v = facts[c], number(c)
        score = (v - f["mean"]) / f["std"] if f["std"] else F.when(v.isNotNull(), F.lit(0.0))
        tests = (score < -3, (score >= -3) & (score < -2), (score >= -2) & (score <= 2), (score > 2) & (score <= 3), score > 3)
        aggs += [count_if(t).alias(f"b{k}__{i}") for k, t in enumerate(tests)]
    wide = one_row_to_long(df.agg(*aggs), cols, {f"b{k}": "long" for k in range(5)})
    cells = [F.struct(F.lit(name).alias("band"), F.col(f"b{k}").alias("count")) for k, name in enumerate(Z_BANDS)]
    return wide.select("column", F.explode(F.array(*cells)).alias("b")).select("column", "b.band", "b.count")


def box(df: DataFrame, cols=None, whiskers: str = "fence") -> DataFrame:
    """Box summary; whiskers reach the extreme values inside the fences, or min/max."""
    cols = list(cols or numeric_columns(df))
    facts = column_facts(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        f, v = facts[c], number(c)
        inside_low = v >= f["lower_fence"] if whiskers == "fence" and f["n"] else F.lit(True)
        inside_high = v <= f["upper_fence"] if whiskers == "fence" and f["n"] else F.lit(True)
        aggs += [
            F.min(F.when(inside_low, v)).alias(f"lower_whisker__{i}"),
            F.max(F.when(inside_high, v)).alias(f"upper_whisker__{i}"),
            *[F.lit(f[q]).cast("double").alias(f"{q}__{i}") for q in ("q1", "median", "q3")],
        ]
    order = ("lower_whisker", "q1", "median", "q3", "upper_whisker")
    return one_row_to_long(df.agg(*aggs), cols, {k: "double" for k in order})


def histogram(df: DataFrame, cols=None, bins: int = 8, mode: str = "width") -> DataFrame:
    """``column, bin, low, high, count``: equal-width bins or equal-frequency runs."""
    cols = list(cols or numeric_columns(df))
    return _equal_width(df, cols, bins) if mode == "width" else _equal_frequency(df, cols, bins)


def _equal_width(df: DataFrame, cols, bins: int) -> DataFrame:
    row = df.agg(*[f(number(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(cols) for f in (F.min, F.max)]).first()
    aggs, frame = [], []
    for i, c in enumerate(cols):
        low, high = row[f"min{i}"], row[f"max{i}"]
        if low is None:
            continue
        width = (high - low) / bins or 1.0
        v = number(c)
        for b in range(bins):
            left, right = low + b * width, low + b * width + width
            inside = (v >= left) & (v < right)
            if b == bins - 1:
                inside = inside | (v == high)
            aggs.append(count_if(inside).alias(f"h{len(frame)}"))
            frame.append((c, b, left, right))
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(b).alias("bin"), F.lit(left).alias("low"), F.lit(right).alias("high"),
            F.col(f"h{k}").alias("count"),
        )
        for k, (c, b, left, right) in enumerate(frame)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _equal_frequency(df: DataFrame, cols, bins: int) -> DataFrame:
    """Sorted runs of ``max(1, n // bins)`` values; the edges are order statistics."""
    n = _counts(df, cols)
    ranks, plan = {}, []
    for c in cols:
        size = max(1, n[c] // bins)
        for b, start in enumerate(range(0, n[c], size)):
            stop = min(start + size, n[c]) - 1
            ranks.setdefault(c, set()).update((start, stop))
            plan.append((c, b, start, stop, stop - start + 1))
    edges = order_statistics(df, ranks, n)
    runs = df.sparkSession.createDataFrame(plan, "column string, bin int, start long, stop long, count long")
    low = edges.select("column", F.col("rank").alias("start"), F.col("value").alias("low"))
    high = edges.select("column", F.col("rank").alias("stop"), F.col("value").alias("high"))
    return (
        F.broadcast(runs).join(low, ["column", "start"]).join(high, ["column", "stop"])
        .select("column", "bin", "low", "high", "count")
    )


@F.pandas_udf(T.DoubleType())
def _normal_inverse(q: pd.Series) -> pd.Series:
    return q.map(NormalDist().inv_cdf)


def qq_points(df: DataFrame, cols=None, points: int = 40) -> DataFrame:
    """Sample quantiles against a fitted normal: ``column, rank, expected, actual``."""
    cols = list(cols or numeric_columns(df))
    n = _counts(df, cols)
    ranks = {}
    for c in cols:
        if not n[c]:
            continue
        picks = list(range(n[c])) if n[c] <= points else list(range(0, n[c], max(1, n[c] // points)))[:points]
        picks[-1] = n[c] - 1
        ranks[c] = picks
    actual = order_statistics(df, ranks, n)
    q = F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), (F.col("rank") + 0.5) / F.col("n")))
    return (
        actual.join(F.broadcast(moments(df, cols).select("column", "n", "mean", "std")), "column")
        .withColumn("expected", F.col("mean") + F.col("std") * _normal_inverse(q))
        .select("column", "rank", rnd("expected", 6).alias("expected"), rnd("value", 6).alias("actual"))
    )


def outlier_summary(counts: DataFrame) -> DataFrame:
    """One row over ``outliers``: affected columns and totals by method."""
    hit = (F.col("iqr_outliers") > 0) | (F.col("zscore_outliers") > 0)
    return counts.agg(
        count_if(hit).alias("affected_columns"),
        F.coalesce(F.sum("zscore_outliers"), F.lit(0)).alias("zscore_anomaly_count"),
        F.coalesce(F.sum("iqr_outliers"), F.lit(0)).alias("iqr_outlier_count"),
    )


def null_bands(profile: DataFrame) -> DataFrame:
    """Columns by null rate: >= .5, .2 to .5, < .2."""
    rate = ratio(F.col("nulls"), F.col("rows"))
    return profile.agg(
        count_if(rate >= 0.5).alias("high_null_columns"),
        count_if((rate >= 0.2) & (rate < 0.5)).alias("medium_null_columns"),
        count_if(rate < 0.2).alias("low_null_columns"),
    )
