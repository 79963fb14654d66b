"""Queries over all tables: no relational table is left out, numeric columns are those of the schema."""

import shutil

from pyspark.sql import functions as F

from strataloom.operators import stats
from strataloom.plans import load_all
from strataloom.plans.registry import ALL_TABLES, COLUMNS, NUMERIC, PLANS
from strataloom.plans.reports import table_runs
from strataloom.session import load

SMALL = "/root/testdata/sf0.001"


def test_columns_are_those_of_the_schema(spark):
    for t in ALL_TABLES:
        df = load(spark, SMALL, t)
        assert df.columns == COLUMNS[t]
        assert stats.numeric_columns(df) == NUMERIC[t]


def test_null_keys_of_lineitem_are_reported(spark, tmp_path):
    load_all()
    for t in ALL_TABLES:
        if t != "lineitem":
            shutil.copy(f"{SMALL}/{t}.parquet", tmp_path)
    key = F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("l_orderkey")
    rows = load(spark, SMALL, "lineitem")
    rows.select(key, *rows.columns[1:]).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {(r["table"], r["column"], r["check"]): r["count"] for r in PLANS["validation_checks_all"](spark, str(tmp_path)).collect()}
    assert found["lineitem", "l_orderkey", "null_key_violations"] == rows.where("l_linenumber = 1").count()


def test_every_table_has_a_run(spark):
    runs = {r["run_id"]: r["supports_time_series"] for r in table_runs(spark, SMALL).collect()}
    assert set(runs) == set(ALL_TABLES)
    assert {t for t, timed in runs.items() if timed} == {"orders", "lineitem", "events"}
