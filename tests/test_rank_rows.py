"""Ranks in the place of values: against pandas, with hot values, signed zeros and few rows."""

import numpy as np
import pandas as pd
import pytest

from strataloom.operators import correlation
from strataloom.operators.ranks import rank_rows


def ranked(spark, frame, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # runs end and go on at batch ends
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(frame).repartition(parts)
        return rank_rows(df, ["a", "b"]).toPandas().sort_values("k").reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 2, 40, 2000])
def test_like_pandas_with_a_hot_value(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"k": np.arange(n), "a": np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 3, n).round(1)), "b": rng.integers(0, 3, n) * 1.0})
    got = ranked(spark, frame, 3)
    for c in "ab":
        assert got[c].tolist() == frame[c].rank().tolist()


def test_one_value_signed_zeros_and_infinities(spark):
    frame = pd.DataFrame({"k": np.arange(300), "a": [7.0] * 300, "b": [0.0, -0.0, np.inf, -np.inf, 1e-300, -1e-300] * 50})
    got = ranked(spark, frame, 4)
    assert got["a"].tolist() == [150.5] * 300 and got["b"].tolist() == frame["b"].rank().tolist()


def test_no_rows(spark):
    assert rank_rows(spark.createDataFrame([], "a double"), ["a"]).count() == 0


def test_spearman_with_a_third_of_one_value_and_no_join_on_it(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(900) < 0.34, 1.0, rng.normal(size=900))
    frame = pd.DataFrame({"x": x, "y": x**3 + rng.normal(size=900), "z": rng.integers(0, 4, 900)})
    frame.loc[::50, "y"] = np.nan
    got = {(r["left"], r["right"]): r["spearman"] for r in correlation.spearman_pairs(spark.createDataFrame(frame), ["x", "y", "z"]).collect()}
    want = frame.dropna().corr("spearman")
    assert got == {p: pytest.approx(want.loc[p], abs=1e-4) for p in got} and len(got) == 3
    plan = correlation.spearman_pairs(spark.createDataFrame(frame), ["x", "y", "z"])._jdf.queryExecution().toString()
    assert "Join" not in plan
