"""Correlation of numeric columns within one table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.numeric import clamp, count_if, rnd
from strataloom.operators.ranks import number, rank_rows
from strataloom.operators.stats import moments, numeric_columns


def rank_columns(df: DataFrame, cols=None, keep: int = 10) -> list[str]:
    """Columns by (non-null count, variance, fewest nulls); a driver list bounded by the schema."""
    cols = list(cols or numeric_columns(df))
    best = moments(df, cols).orderBy(F.desc("n"), F.desc(F.coalesce("variance", F.lit(0.0))), "column")
    return [r["column"] for r in best.limit(keep).collect()]


def rank_table(profile: DataFrame, keep: int = 10) -> DataFrame:
    """Top numeric columns of a moments frame: ``column, position``."""
    order = W.partitionBy().orderBy(F.desc("n"), F.desc(F.coalesce("variance", F.lit(0.0))), "column")
    return profile.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)


def _pair_aggregates(df: DataFrame, cols, prefix: str):
    for k, (a, b) in enumerate(combinations(cols, 2)):
        x, y = number(a), number(b)
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        yield from (
            F.covar_pop(x, y).alias(f"{prefix}c{k}"),
            F.stddev_pop(x).alias(f"{prefix}x{k}"),
            F.stddev_pop(y).alias(f"{prefix}y{k}"),
            count_if(both).alias(f"{prefix}n{k}"),
        )


def _pearson(prefix: str, k: int):
    spread = F.col(f"{prefix}x{k}") * F.col(f"{prefix}y{k}")
    r = F.when(spread > 0, F.try_divide(F.col(f"{prefix}c{k}"), spread))
    return F.when(F.col(f"{prefix}n{k}") > 1, clamp(F.coalesce(r, F.lit(0.0)), -1.0, 1.0)).otherwise(F.lit(0.0))


def pairs(df: DataFrame, cols=None, spearman: bool = True) -> DataFrame:
    """``left, right, n, pearson, covariance[, spearman]`` for every column pair.

    Pearson and covariance come from one aggregate pass; nulls are dropped
    per pair. Spearman ranks are taken over rows complete in all ``cols``.
    """
    cols = list(cols or rank_columns(df))
    names = list(combinations(cols, 2))
    row = df.agg(*_pair_aggregates(df, cols, "p"))
    cells = [
        F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"pn{k}").alias("n"),
            rnd(_pearson("p", k)).alias("pearson"), rnd(F.coalesce(F.col(f"pc{k}"), F.lit(0.0))).alias("covariance"),
        )
        for k, (a, b) in enumerate(names)
    ]
    out = row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    return out.join(F.broadcast(spearman_pairs(df, cols)), ["left", "right"]) if spearman else out


def spearman_pairs(df: DataFrame, cols) -> DataFrame:
    """``left, right, spearman``: Pearson over average ranks."""
    names = list(combinations(cols, 2))
    ranked = df.select(*[number(c).alias(f"r{i}") for i, c in enumerate(cols)]).dropna()
    ranked = rank_rows(ranked, ranked.columns)
    row = ranked.agg(*_pair_aggregates(ranked, [f"r{i}" for i in range(len(cols))], "s"))
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), rnd(_pearson("s", k)).alias("spearman"))
        for k, (a, b) in enumerate(names)
    ]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def strongest(pair_table: DataFrame) -> DataFrame:
    """Strongest positive and negative pair as one row."""
    name = F.concat_ws("~", "left", "right")
    return pair_table.agg(
        F.max_by(name, F.struct("pearson", "left", "right")).alias("positive_pair"),
        F.max("pearson").alias("positive_value"),
        F.min_by(name, F.struct("pearson", "left", "right")).alias("negative_pair"),
        F.min("pearson").alias("negative_value"),
    )


def top_pairs(pair_table: DataFrame, keep: int = 40) -> DataFrame:
    return pair_table.orderBy(F.desc(F.abs("pearson")), "left", "right").limit(keep)


def vif(pair_table: DataFrame, high: float = 5.0) -> DataFrame:
    """``feature, vif, status`` from the largest squared correlation of a column."""
    sides = pair_table.select(
        F.explode(F.array("left", "right")).alias("feature"), (F.col("pearson") * F.col("pearson")).alias("r2")
    )
    score = rnd(1.0 / F.greatest(F.lit(1e-6), 1.0 - F.max("r2")))
    return sides.groupBy("feature").agg(score.alias("vif")).withColumn(
        "status", F.when(F.col("vif") > high, "high").otherwise("ok")
    )


def pair_gap(pair_table: DataFrame, cut: float = 0.18) -> DataFrame:
    """Gap between Pearson and Spearman; a wide gap hints at a nonlinear link."""
    gap = F.abs(F.col("pearson") - F.col("spearman"))
    return pair_table.select("left", "right", rnd(gap).alias("gap"), (gap > cut).alias("nonlinear"))
