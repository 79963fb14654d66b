"""Reports over the tables: quantiles are not worked out for z-scores, dates parsed only where asked for."""

from strataloom.operators import profile, stats, validate
from strataloom.plans import base, rules


def test_z_outliers_are_those_of_the_full_report(spark):
    df = spark.createDataFrame([(i, float(i % 5), None, 7) for i in range(60)] + [(900, 99.0, None, 7)], "a long, b double, c double, d int")
    full = stats.outliers(df).select("column", "n", "zscore_outliers")
    assert sorted(map(tuple, stats.z_outliers(df).collect())) == sorted(map(tuple, full.collect()))
    assert dict((r["column"], r["zscore_outliers"]) for r in stats.z_outliers(df).collect()) == {"a": 1, "b": 1, "c": 0, "d": 0}


def test_values_are_parsed_only_for_their_rules(spark):
    df = spark.createDataFrame([(str(i), f"x{i}", "bad" if i < 4 else "2024-01-02", "n" if i < 8 else str(i)) for i in range(12)], "k string, note string, order_date string, total_count string")
    labels = profile.label_columns(spark.createDataFrame([("t", c) for c in df.columns], "table string, column string"))
    got = validate.run(profile.value_counts(df), profile.columns(df, "t"), labels)
    assert "isnotnull(cast(value" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["column"], r["check"]): (r["count"], r["severity"]) for r in got.collect()}
    assert found[("order_date", "invalid_dates")] == (4, "high") and ("note", "invalid_dates") not in found
    assert any(c == "type_mismatches" for _, c in found)


def test_profile_of_a_table_is_worked_out_once(spark):
    folder = "/root/testdata/sf0.001"
    base.forget(spark)
    plan = rules.kpis(spark, folder, ("orders", "customer"))._jdf.queryExecution().withCachedData().toString()
    assert {n for (_, _, f, n) in base._KEPT if f == folder} >= {"profile orders", "findings orders", "flags orders"} and "InMemoryRelation" in plan
    base.forget(spark)
