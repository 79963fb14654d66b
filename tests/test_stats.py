"""Hand-worked values for distributions, ranks, correlation and series."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import correlation, profile, stats, timeseries, validate
from strataloom.operators.ranks import average_ranks, order_statistics, row_index


def one(df):
    return df.first().asDict()


def frame(spark, values, name="v"):
    return spark.createDataFrame([(x,) for x in values], f"{name} double")


def test_six_numbers(spark):
    d = one(stats.describe(frame(spark, [1.0, 2.0, 4.0, 8.0, 16.0, 100.0])))
    want = {"p10": 1.5, "q1": 2.5, "median": 6.0, "q3": 14.0, "p90": 58.0, "std": 35.310134, "skewness": 1.712060, "kurtosis": 1.054239}
    for k, v in want.items():
        assert d[k] == pytest.approx(v, abs=1e-5), k


def test_sales_example(spark):
    rows = [("North", 4200000.0, 120), ("South", 5300000.0, 95), ("East", 2800000.0, 210), ("West", 9100000.0, 60)]
    df = spark.createDataFrame(rows, "region string, revenue double, units int")
    d = one(stats.describe(df, ["revenue"]))
    want = {"mean": 5350000, "median": 4750000, "std": 2339337.513058, "skewness": 0.676299, "kurtosis": -0.981640, "p10": 3220000, "q1": 3850000, "q3": 6250000, "p90": 7960000}
    for k, v in want.items():
        assert d[k] == pytest.approx(v, rel=1e-6), k
    assert one(stats.outliers(df, ["revenue"]))["iqr_outliers"] == 0
    p = one(correlation.pairs(df, ["revenue", "units"]))
    assert (p["pearson"], p["spearman"]) == (-0.8728, -1.0)


def test_constant_and_empty(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    d = one(stats.describe(df, ["a"]))
    assert (d["skewness"], d["kurtosis"], d["std"]) == (0.0, 0.0, 0.0)
    assert one(correlation.pairs(df, ["a", "b"]))["pearson"] == 0.0
    empty = df.limit(0)
    assert one(stats.moments(empty, ["a"]))["n"] == 0
    assert stats.quantiles(empty, ["a"]).count() == 0
    assert one(profile.columns(spark.createDataFrame([(None,), (None,)], "x string"), "t"))["null_pct"] == 100.0


def test_order_statistics_brackets_match_sorting(spark):
    rng = random.Random(3)
    values = [rng.choice([7.0, 7.0, rng.gauss(0, 50)]) for _ in range(6000)]  # one value is a third and more of the rows
    df = frame(spark, values).repartition(5)
    ranks = [0, 1, 599, 1500, 2999, 3000, 4500, 5998, 5999]
    got = {r["rank"]: r["value"] for r in order_statistics(df, {"v": ranks}, {"v": len(values)}, sort_limit=50).collect()}
    ordered = sorted(values)
    assert got == {r: ordered[r] for r in ranks}


def test_quantiles_equal_interpolation(spark):
    rng = random.Random(5)
    values = [rng.expovariate(0.1) for _ in range(3001)]
    row = one(stats.quantiles(frame(spark, values), ["v"], sort_limit=100))
    ordered = sorted(values)
    for name, p in stats.QUANTILES.items():
        k = (len(values) - 1) * p
        low = int(k)
        want = ordered[low] * (1 - (k - low)) + ordered[min(low + 1, len(values) - 1)] * (k - low)
        assert row[name] == pytest.approx(want, rel=1e-12)


def test_average_ranks_with_ties(spark):
    got = {r["value"]: r["avg_rank"] for r in average_ranks(frame(spark, [1.0, 2.0, 2.0, 3.0]), "v", buckets=3).collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}
    values = [float(x % 97) for x in range(1000)]
    many = {r["value"]: r["avg_rank"] for r in average_ranks(frame(spark, values), "v", buckets=7).collect()}
    ordered = sorted(values)
    for v in set(values):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert many[v] == sum(places) / len(places)


def test_row_index_is_dense(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7 % 503).alias("k"))
    rows = row_index(df, "k", by=["g"], buckets=6).collect()
    for g in ("hot", "cold"):
        mine = sorted((r["k"], r["row_idx"]) for r in rows if r["g"] == g)
        assert [i for _, i in mine] == list(range(len(mine)))


def test_histograms_keep_every_row(spark):
    df = frame(spark, [float(x) for x in range(15)] + [3.0, 3.0])
    for mode in ("width", "frequency"):
        assert sum(r["count"] for r in stats.histogram(df, ["v"], mode=mode).collect()) == 17


def test_spikes_need_a_longer_window(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}", c) for d, c in enumerate([1, 1, 1, 1, 1, 1, 1, 50], 1)], "date string, count long")
    assert timeseries.spikes(days).count() == 0
    assert [r["count"] for r in timeseries.spikes(days, window=8).collect()] == [50]


def test_dates_parse_in_all_layouts(spark):
    texts = ["2024-02-03", "2024/02/03", "02/03/2024", "03-02-2024", "2024-02-03 10:00:00", "2024-02-03T10:00:00Z", "soon", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.to_date(timeseries.parse_datetime("t")).cast("string")).collect()]
    assert got == ["2024-02-03"] * 6 + [None, None]


def test_validation_rules_fire(spark):
    rows = [("2024-01-01", "a", "1", "x1"), ("soon", "a", "2", "x2"), ("later", "b", "z", None)] + [("2024-01-02", "a", "q", "x3")] * 6 + [("2024-01-03", "c", "w", "x4")]
    df = spark.createDataFrame(rows, "order_date string, kind_type string, unit_count string, item_id string")
    counts = profile.value_counts(df)
    labels = profile.label_columns(spark.createDataFrame([("t", c) for c in df.columns], "table string, column string"))
    found = {(r["column"], r["check"]): r["count"] for r in validate.run(counts, profile.columns(df, "t", counts=counts), labels).collect()}
    assert found[("order_date", "invalid_dates")] == 2
    assert found[("item_id", "null_key_violations")] == 1
    assert found[("kind_type", "enum_violations")] == 2
    assert found[("unit_count", "type_mismatches")] == 8


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert one(validate.duplicate_rows(df)) == {"duplicates": 2, "rows": 4}
