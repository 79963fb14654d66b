"""SQLite as source and sink: ranges, pushed filters, types, overwriting, broken files, keys and indexes."""

import datetime as dt
import os
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strataloom.sources import sqlite

SCHEMA = "k long, b boolean, i int, f double, d decimal(20,3), t string, day date, at timestamp, local timestamp_ntz, raw binary"


def rows(n=50):
    at = dt.datetime(2024, 2, 29, 23, 59, 59, 123456)
    out = [
        (k, k % 2 == 0, -k, k / 7, Decimal(k) / 8 * 1000, f"Text é {k}\n'\"", dt.date(1999, 1, 1) + dt.timedelta(k), at + dt.timedelta(hours=k), dt.datetime(1, 1, 1, 0, 0, k), bytes([k, 0]))
        for k in range(n)
    ]
    return [*out, (10**15, None, None, float("nan"), None, None, None, None, None, None), (10**15 + 1, None, None, float("inf"), None, "", None, None, None, b"")]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_round_trip_of_all_types(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    sqlite.write_table(df, str(tmp_path), "all kinds")
    back = sqlite.read_table(spark, str(tmp_path), "all kinds", ranges=4)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    assert same(back.collect(), df.collect())
    assert same(back.select("t").collect(), df.select("t").collect()) and back.count() == 52
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".db")]) == 3 and not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


@pytest.mark.parametrize("where", [
    "k = 7", "k > 10 AND k <= 13", "t = 'Text é 5\n''\"'", "t IN ('', 'x')", "i IS NULL", "i IS NOT NULL AND f >= 3.5", "day < DATE'1999-01-04'", "f > 6", "f = double('NaN')",
    "d > 5000", "at > TIMESTAMP'2024-03-01 20:00:00'", "k = 3 OR i = -4", "NOT b", "t LIKE '%9%' AND k < 30",
])
def test_filters_give_what_spark_gives(spark, tmp_path, where):
    df = spark.createDataFrame(rows(), SCHEMA)
    sqlite.write_table(df, str(tmp_path), "x")
    assert same(sqlite.read_table(spark, str(tmp_path), "x").where(where).collect(), df.where(where).collect())


def test_filters_run_in_the_database():
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, StringContains

    reader = sqlite.SqliteReader(T.StructType.fromDDL("k long, t string, a timestamp"), {"table": "x", "path": "p"})
    late, part = GreaterThan(("a",), dt.datetime(2024, 1, 1)), StringContains(("t",), "q")
    left = list(reader.pushFilters([EqualTo(("k",), 1), IsNull(("t",)), late, part]))
    assert left == [late, part] and reader.terms == [('"k" = ?', [1]), ('"t" IS NULL', [])]


def test_a_plain_database_in_ranges(spark, tmp_path):
    """A file made elsewhere: sparse keys, keys that are null, loose types."""
    file = str(tmp_path / "shop.db")
    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE goods (id INTEGER PRIMARY KEY, other INT, price DECIMAL(8,2), name VARCHAR(20))")
        db.execute("CREATE TABLE sold (id INTEGER PRIMARY KEY, good INTEGER NOT NULL REFERENCES goods(id), day DATE)")
        db.execute("CREATE INDEX by_good ON sold (good, day)")
        db.executemany("INSERT INTO goods VALUES (?, ?, ?, ?)", [(k * 1000, None if k % 5 == 0 else k, k + 0.5, k if k == 3 else f"n{k}") for k in range(40)])
        db.execute("INSERT INTO sold VALUES (1, 1000, '2024-05-06')")
    for key in (None, "id", "other"):
        df = sqlite.read_table(spark, file, "goods", key=key, ranges=7)
        assert df.rdd.getNumPartitions() >= 6
        got = sorted(tuple(r) for r in df.collect())
        assert got == [(k * 1000, None if k % 5 == 0 else k, Decimal(f"{k}.50"), "3" if k == 3 else f"n{k}") for k in range(40)]
    found = {(r.table, r.column): (r.type, r.key_place, r.refers, r.indexes) for r in sqlite.catalog(spark, file).collect()}
    assert found["sold", "good"] == ("bigint", 0, "goods.id", ["by_good"]) and found["goods", "id"][1] == 1
    assert sqlite.read_table(spark, file, "sold").first().day == dt.date(2024, 5, 6)


def test_overwrite_append_and_empty(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a")], "k long, t string"), spark.createDataFrame([(2, "b"), (3, None)], "k long, t string").repartition(2)
    path = str(tmp_path / "new")
    for df, mode, want in ((one, "overwrite", {1}), (two, "append", {1, 2, 3}), (two, "overwrite", {2, 3}), (one.limit(0), "append", {2, 3}), (one.limit(0), "overwrite", set())):
        sqlite.write_table(df, path, "x", mode)
        assert {r.k for r in sqlite.read_table(spark, path, "x").collect()} == want
    with pytest.raises(Exception, match="no table y"):
        sqlite.read_table(spark, path, "y")


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    sqlite.write_table(spark.range(5), str(tmp_path), "x")
    with pytest.raises(Exception):  # noqa: B017
        sqlite.write_table(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), str(tmp_path), "x")
    assert sqlite.read_table(spark, str(tmp_path), "x").count() == 5


def test_check_finds_broken_and_missing_files(spark, tmp_path):
    sqlite.write_table(spark.range(5), str(tmp_path), "x")
    (tmp_path / "bad.db").write_bytes(b"no database at all" * 100)
    found = {os.path.basename(r.file): (r.reachable, r.sound) for r in sqlite.check(spark, str(tmp_path)).collect()}
    assert found.pop("bad.db") == (True, False) and set(found.values()) == {(True, True)}
    assert sqlite.check(spark, str(tmp_path / "none.db")).first().reachable is False
    with pytest.raises(ValueError, match="mounted"):
        sqlite.local_path("s3://bucket/x.db")
