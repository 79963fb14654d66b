"""Writers: a source or batch written again replaces itself, a failed append leaves the index as it was."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import vectors
from strataloom.sources import index, sinks

TEXTS = "k long, text string"


def test_one_source_is_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "a"), "source_id string, n long, extra string"
    sinks.write_artifact(spark.createDataFrame([("01", 1, None), ("b", 2, "x"), (None, 3, "y")], schema), path, "upload")
    sinks.write_artifact(spark.createDataFrame([("01", 9, "z")], schema), path, "upload")
    sinks.write_artifact(spark.createDataFrame([("01", 7, "z")], schema), path, "clean")
    sinks.write_artifact(spark.createDataFrame([], schema), path, "upload")
    read = lambda stage: {tuple(r) for r in sinks.read_artifact(spark, path, "n long, extra string", stage).select("source_id", "n", "extra").collect()}
    # Source names that look like numbers stay text.
    assert read("upload") == {("01", 9, "z"), ("b", 2, "x"), (None, 3, "y")}
    assert read("clean") == {("01", 7, "z")}


def test_lineage_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "source_id long, note string")
    for batch in ("1", "1", "2"):
        sinks.append_lineage(rows, "upload", path, batch, F.col("note"))
    got = sorted(tuple(r) for r in sinks.read_lineage(spark, path).select("source_id", "batch", F.coalesce("detail", F.lit("-"))).collect())
    assert got == [(s, b, d) for s, b, d in sorted([("1", "1", "x"), ("2", "1", "-"), ("2", "1", "-"), ("1", "2", "x"), ("2", "2", "-"), ("2", "2", "-")])]


def test_triples_and_metrics(spark, tmp_path):
    edges = spark.createDataFrame([("a", "r", "b", "1"), ("b", "r", "c", "2")], "source string, relation string, target string, source_id string")
    path = str(tmp_path / "t")
    sinks.write_triples(edges, path)
    sinks.write_triples(edges.where("source_id = '2'").withColumn("target", F.lit("d")), path)
    assert {tuple(r) for r in sinks.read_triples(spark, path).select("source_id", "s", "p", "o").collect()} == {("1", "a", "r", "b"), ("2", "b", "r", "d")}
    records = spark.createDataFrame([("r", "s", "f", "m", 1.5), ("r", "s", "f", "m", 2.5)], "run_id string, stage string, family string, metric string, value double")
    path = str(tmp_path / "m")
    for batch in ("x", "x"):
        sinks.write_metrics(records, path, batch)
    assert [tuple(r) for r in sinks.metrics_by_stage(sinks.read_metrics(spark, path)).collect()] == [("s", "f", "m", 2, 2.0, 1.5, 2.5)]


def test_run_export_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("r,1", 'say "x"', 0.1 + 0.2, None), ("r2", "a\\b", None, 5)], "run_id string, name string, confidence_score double, total_records long")
    made = sinks.run_export(runs, runs)
    sinks.export_runs(runs, runs, str(tmp_path / "runs"))
    back = sinks.read_runs(spark, str(tmp_path / "runs"), made.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect())) and back.columns == list(sinks.EXPORT_COLUMNS)


def held(spark, path):
    return {(r["k"], tuple(r["vector"])) for r in index.read_index(spark, path, "k").collect()}


def test_appends_that_overlap(spark, tmp_path):
    path = str(tmp_path / "i")
    one = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (2, None), (None, "x")], TEXTS)
    two = spark.createDataFrame([(1, "red fox"), (2, ""), (3, "blue"), (1, "red hen"), (None, "x")], TEXTS)
    assert held(spark, path) == set()
    assert index.append_index(one.where("false"), path, "k") == 0
    assert (index.append_index(one, path, "k"), index.append_index(two, path, "k"), index.append_index(two, path, "k")) == (3, 2, 0)
    want = spark.createDataFrame([(1, "red fox"), (2, ""), (None, "x"), (3, "blue"), (1, "red hen")], TEXTS)
    assert held(spark, path) == {(r["k"], tuple(r["vector"])) for r in vectors.hash_vectors(want, "k").collect()}
    assert index.read_index(spark, path, "k").count() == 5
    with pytest.raises(ValueError):
        index.append_index(two, path, "k", gen=2)


def test_a_failed_append_is_not_read(spark, tmp_path):
    path = str(tmp_path / "i")
    index.append_index(spark.createDataFrame([(1, "red fox")], TEXTS), path, "k")
    before = held(spark, path)
    # Vectors of a batch that stopped before its manifest row.
    index.read_index(spark, path, "k").withColumn("k", F.lit(2).cast("long")).write.parquet(f"{path}/vectors/batch=bfailed")
    assert held(spark, path) == before
    assert index.append_index(spark.createDataFrame([(1, "red fox"), (2, "blue")], TEXTS), path, "k") == 1
    assert sorted(k for k, _ in held(spark, path)) == [1, 2]
