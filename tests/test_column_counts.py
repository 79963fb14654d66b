"""Cells counted column by column: the rows of the grouping of texts, with only distinct cells spelled out."""

from decimal import Decimal

from pyspark.sql import functions as F

from strataloom.operators import profile
from strataloom.plans import base, rules

NAN, INF = float("nan"), float("inf")


def odd(spark):
    rows = [(1, 0.0, "a ", True, Decimal("1.10"), [1]), (1, -0.0, " a", None, Decimal("1.10"), [1]), (None, NAN, "", False, None, None), (3, INF, None, True, Decimal("2.00"), []), (3, 1e21, "A", None, None, [1]), (2, None, "\t", None, None, None), (2, 0.1, "a", None, None, None)]
    df = spark.createDataFrame(rows, "i long, d double, s string, b boolean, m decimal(10,2), l array<int>")
    at = F.element_at(F.array(*[F.lit(v) for v in ("2024-03-31 01:30:00", "2024-03-31 01:30:00.5", "1900-01-01 00:00:00")]), (F.coalesce("i", F.lit(1))).cast("int"))
    return df.select("*", at.cast("timestamp_ntz").alias("n"), at.cast("timestamp").alias("t"), at.cast("date").alias("day"), F.col("d").cast("float").alias("f"))


def test_counts_by_column_are_value_counts(spark):
    df = odd(spark)
    order = lambda counts: sorted(map(tuple, counts.collect()))
    assert order(profile.counts_by_column(df)) == order(profile.value_counts(df))
    assert order(profile.counts_by_column(df, ["s", "d"])) == order(profile.value_counts(df, ["s", "d"]))
    assert profile.counts_by_column(df, []).collect() == []


def test_numbers_are_not_spelled_out_per_row(spark):
    """Before, each cell of a table was a row of its column's name and its text."""
    df = spark.range(50).select("id", (F.col("id") / 7).alias("x"))
    plan = profile.columns(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "value, cast(" not in plan


def test_findings_read_only_the_columns_of_a_rule(spark):
    folder = "/root/testdata/sf0.001"
    base.forget(spark)
    rows = {tuple(r) for r in rules.findings(spark, folder, ("orders", "events")).collect()}
    from strataloom.operators import validate
    from strataloom.session import load

    labels = rules.labelled(spark, folder, ("orders", "events"))
    want = {tuple(r) for t in ("orders", "events") for r in validate.run(profile.value_counts(load(spark, folder, t)), rules.profiled(spark, folder, (t,)), labels).collect()}
    base.forget(spark)
    assert rows == want
