"""What a Python worker keeps between the stages of the pipeline."""

import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline
from strataloom.llm import byte_bpe
from strataloom.llm.common import lean


def test_stage_of_another_operator_frees_the_encoder():
    path, batch = P.path("byte_bpe_50k.tiktoken"), pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two"]})
    encode = byte_bpe.encode_batches(path, P.PATTERN)
    byte_bpe.encoder.cache_clear()
    first = list(lean(encode, keeps="byte_bpe")(iter([batch])))
    held = byte_bpe.encoder(path, P.PATTERN)
    assert list(lean(encode, keeps="byte_bpe")(iter([batch]))) == first
    assert byte_bpe.encoder(path, P.PATTERN) is held
    list(lean(lambda batches: batches)(iter([batch])))
    assert byte_bpe.encoder.cache_info().currsize == 0


def test_few_texts_cross_to_python_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        corpus_pipeline.encode(spark, spark.createDataFrame([(1, "one two")], "doc_id long, text string"), "")
        sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r["n"] for r in sizes) == 3000 and max(r["n"] for r in sizes) <= 1000


def test_kept_results_are_bounded():
    kept = byte_bpe._Kept()
    for k in range(200_000):
        kept.keep(f"piece {k}", b"1234")
    held = sum(byte_bpe.ENTRY + len(k) + len(v) for part in (kept.younger, kept.older) for k, v in part.items())
    assert held <= 21 << 20 and kept.find("piece 199999") == b"1234"
