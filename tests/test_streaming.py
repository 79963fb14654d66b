"""Streams over several small batches end where the batch operators end."""

from pyspark.sql import functions as F

from strataloom.operators import chunking, extract, graph
from strataloom.streaming import jobs


def write_parts(spark, tmp_path, rows, schema, parts=3):
    folder = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


DOCS = [
    (0, "Acme Corp owns Globex Inc. IBM pays $5."), (1, "Acme Corp likes IBM."), (2, "Acme Corp owns Globex Inc. IBM pays $5."),
    (3, "nothing here"), (4, "Ada Lovelace met Acme Corp."), (5, "nothing here"),
]


def test_dedup(spark, tmp_path):
    folder = write_parts(spark, tmp_path, DOCS, "doc_id long, text string")
    stream = jobs.read_folder(spark, folder, "doc_id long, text string", files_per_batch=1)
    jobs.dedup(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == len(DOCS)
    assert rows.where("NOT duplicate").select("sha").distinct().count() == rows.where("NOT duplicate").count() == 4


def test_graph_upsert(spark, tmp_path):
    folder = write_parts(spark, tmp_path, DOCS, "doc_id long, text string")
    stream = jobs.read_folder(spark, folder, "doc_id long, text string", files_per_batch=1)
    jobs.graph_upsert(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    nodes, edges = jobs.read_graph(spark, str(tmp_path / "out"))
    pieces = chunking.chunk(spark.createDataFrame(DOCS, "doc_id long, text string"))
    want_n, want_e = graph.build(extract.entities(pieces), extract.relations(pieces))
    assert {r["id"] for r in nodes.collect()} == {r["id"] for r in want_n.collect()}
    key = ("source", "relation", "target")
    assert {tuple(r[k] for k in key) for r in edges.collect()} == {tuple(r[k] for k in key) for r in want_e.collect()}


def test_memory_and_daily(spark, tmp_path):
    folder = write_parts(spark, tmp_path, DOCS, "doc_id long, text string")
    stream = jobs.read_folder(spark, folder, "doc_id long, text string", files_per_batch=1)
    jobs.memory(stream, str(tmp_path / "m"), str(tmp_path / "mck")).awaitTermination()
    got = {r["term"]: r["observations"] for r in jobs.latest(spark, str(tmp_path / "m"), ["term"]).collect()}
    assert got["acme corp"] == 4 and got["ibm"] == 3
    events = [(i, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(9)]
    schema = "event_id long, at string"
    (tmp_path / "e").mkdir()
    folder = write_parts(spark, tmp_path / "e", events, schema)
    ev = jobs.read_folder(spark, folder, schema, files_per_batch=1).withColumn("ts", F.to_timestamp("at"))
    jobs.daily_counts(ev, "ts", str(tmp_path / "d"), str(tmp_path / "dck"), delay="10 days").awaitTermination()
    assert {str(r["date"]): r["count"] for r in jobs.latest(spark, str(tmp_path / "d"), ["date"]).collect()} == {f"2024-01-0{d}": 3 for d in (1, 2, 3)}
