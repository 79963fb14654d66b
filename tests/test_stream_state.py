"""Streams over ten batches with a restart between: work per batch does not follow the history."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from strataloom.operators import chunking, extract, graph
from strataloom.streaming import jobs

SCHEMA = "doc_id long, text string"


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def sizes(path):
    return {p.name: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in path.iterdir() if p.is_dir()}


def batches(seed, n=10):
    rnd = random.Random(seed)
    texts = [f"Text {k} of Acme{k % 7} Corp owns Globex Inc." for k in range(40)]
    rows = [[(100 * b + k, rnd.choice(texts)) for k in range(30)] for b in range(n)]
    rows[2] += [(None, texts[0]), (250, None), (251, None), (252, ""), (253, "")]
    rows[7] += [(-5, texts[0])] * 200  # one text holds most of a batch
    return rows


def run(spark, folder, start):
    """Batches 0 to 4, then the others with a new query."""
    rows = batches(1)
    for part in (range(5), range(5, 10)):
        for b in part:
            put(spark, folder, rows[b], f"b{b:02}")
        stream = jobs.read_folder(spark, f"{folder}/*", SCHEMA, files_per_batch=1)
        start(stream).awaitTermination()
        yield rows


@pytest.mark.parametrize("store", ["HDFSBackedStateStoreProvider", "RocksDBStateStoreProvider"])
def test_duplicates_need_no_history(spark, tmp_path, store):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, f"org.apache.spark.sql.execution.streaming.state.{store}")
    try:
        _duplicates_need_no_history(spark, tmp_path)
    finally:
        spark.conf.unset(name)


def _duplicates_need_no_history(spark, tmp_path):
    out, flags = tmp_path / "out", []
    for rows in run(spark, str(tmp_path / "in"), lambda s: jobs.dedup(s, str(out), str(tmp_path / "ck"))):
        flags += spark.read.parquet(str(out)).collect()
        shutil.rmtree(out)  # the second query never reads what the first wrote
    arrived = [(b, r) for b, batch in enumerate(rows) for r in batch]
    assert len(flags) == len(arrived)
    first = {}
    for b, (doc, text) in sorted(arrived, key=lambda a: (a[0], a[1][0] is None, a[1][0] or 0)):
        first.setdefault(text, (b, doc))
    originals = [(r.doc_id, r.sha) for r in flags if not r.duplicate]
    assert len(originals) == len(set(s for _, s in originals)) == len(first)
    assert {d for d, _ in originals} == {d for _, d in first.values()}


def test_graph_batches_write_their_own_rows_only(spark, tmp_path):
    out = tmp_path / "out"
    for k, rows in enumerate(run(spark, str(tmp_path / "in"), lambda s: jobs.graph_upsert(s, str(out), str(tmp_path / "ck")))):
        if k == 0:
            jobs.compact_graph(spark, str(out), 4)
            for name in ("nodes", "edges"):
                for b in range(5):
                    shutil.rmtree(out / name / f"batch_id={b}")  # merged for good
    written = sizes(out / "nodes")
    assert len(written) == 5 and max(written.values()) < 2 * min(written.values())
    nodes, edges = jobs.read_graph(spark, str(out))
    docs = spark.createDataFrame([r for batch in rows for r in batch], SCHEMA)
    pieces = chunking.chunk(docs)
    want_n, want_e = graph.build(extract.entities(pieces), extract.relations(pieces))
    assert {r.id for r in nodes.collect()} == {r.id for r in want_n.collect()}
    by = ("source", "relation", "target")
    assert {tuple(r[c] for c in by) for r in edges.collect()} == {tuple(r[c] for c in by) for r in want_e.collect()}


def test_the_oldest_label_and_the_largest_confidence_stay(spark, tmp_path):
    for b, rows in enumerate([[("a", "A one", "entity", 0.5)], [("a", "A", "organization", 0.9), ("b", "B", "value", 0.6)], [("a", "a", "time", 0.7)]]):
        spark.createDataFrame(rows, jobs.NODE_SCHEMA).write.parquet(str(tmp_path / "nodes" / f"batch_id={b}"))
        spark.createDataFrame([("a", "b", "owns", 0.1 * b), ("a", "a", "owns", 1.0)], jobs.EDGE_SCHEMA).write.parquet(str(tmp_path / "edges" / f"batch_id={b}"))
    for _ in range(2):
        nodes, edges = jobs.read_graph(spark, str(tmp_path))
        assert {tuple(r) for r in nodes.collect()} == {("a", "A one", "entity", 0.9), ("b", "B", "value", 0.6)}
        assert [tuple(r) for r in edges.select("source", "target", F.round("confidence", 4)).collect()] == [("a", "b", 0.2)]
        jobs.compact_graph(spark, str(tmp_path), 1)
