"""Cleaning, chunking and extraction on small texts."""

from pyspark.sql import functions as F

from strataloom.functions import text as ft
from strataloom.operators import chunking, extract
from strataloom.sources import files, html


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_clean(spark):
    got = docs(spark, " a\n\n\n\nb   c\x07 ").select(ft.clean("text")).first()[0]
    assert got == "a\n\nb c"


def test_normalize_smoke_text(spark):
    out = chunking.normalize(docs(spark, "Acme paid $4,200,000 on 12/31/2023 and 1/2/69.  ﬁne", "plain")).orderBy("doc_id").collect()
    assert out[0]["text"] == "Acme paid 4200000 USD on 2023-12-31 and 2069-01-02. fine"
    assert out[0]["applied"] == ["encoding_nfkc", "whitespace_collapse", "currency_iso", "temporal_iso"]
    assert out[1]["applied"] == ["whitespace_collapse"]


def test_chunk_tail(spark):
    d = docs(spark, " ".join(f"w{i}" for i in range(400)))
    assert [(r["start_word"], r["end_word"]) for r in chunking.chunk(d, tail=True).collect()] == [(0, 400), (340, 400)]
    assert [(r["start_word"], r["end_word"]) for r in chunking.chunk(d).collect()] == [(0, 400)]
    report = chunking.validate_chunks(chunking.chunk(d, tail=True), d).first()
    assert (report["coverage_pct"], report["correct_pairs"], report["data_loss"]) == (100.0, 1, False)


def test_chunks_cover_any_length(spark):
    d = docs(spark, *[" ".join("w" for _ in range(n)) for n in (1, 5, 9, 10, 11, 23, 57)])
    report = chunking.validate_chunks(chunking.chunk(d, size=10, overlap=3), d, overlap=3).collect()
    assert all(r["coverage_pct"] == 100.0 and not r["data_loss"] for r in report)


def test_numbers_and_years(spark):
    d = docs(spark, "$1,200 million", "12", "1,20", "in 1999 and 2004", "none")
    got = d.select(ft.to_number("text").alias("n"), ft.year("text").alias("y")).collect()
    assert [r["n"] for r in got] == [1.2e9, 12.0, None, None, None]
    assert [r["y"] for r in got] == [-1, -1, -1, 1999, -1]


def test_entities_keep_first_label(spark):
    d = chunking.chunk(docs(spark, "Acme Corp bought IBM for $5M on Jan 5, 2020. Acme Corp owns IBM."))
    got = [(r["text"], r["label"]) for r in extract.entities(d).orderBy("pos").collect()]
    assert got == [("$5M", "MONEY"), ("5", "MONEY"), ("2020", "MONEY"), ("Jan 5, 2020", "DATE"), ("Acme Corp", "ENTITY"), ("IBM", "ORG")]
    rels = extract.relations(d).collect()
    assert ("Acme Corp", "IBM", "owns") in {(r["source"], r["target"], r["relation"]) for r in rels}
    assert all(r["j"] - r["i"] <= 3 for r in rels)


def test_second_rule_set_skips_money_runs(spark):
    d = chunking.chunk(docs(spark, "Acme Holdings Ltd paid 900 USD Foo Bar to Ada Lovelace in Berlin"))
    got = [(r["text"], r["label"]) for r in extract.entities(d, gen=2).orderBy("pos").collect()]
    assert got == [("900 USD", "MONEY"), ("Acme Holdings Ltd", "ORG"), ("Ada Lovelace", "PERSON"), ("Berlin", "GPE")]


def test_html_text(spark):
    page = "<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body><nav>x</nav>a<!-- c -->b<p> c&nbsp;</p></body></html>"
    assert spark.createDataFrame([(1, page)], "page_id int, html string").select(html.page_text("html")).first()[0] == "T & U\na\nb\nc"


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,one\n2,\n")
    (tmp_path / "b.txt").write_text("hello")
    rows = files.read_corpus(spark, str(tmp_path / "a.csv")).select("kind", "text").collect()
    assert sorted((r["kind"], r["text"]) for r in rows) == [("row", "x=1; y=one"), ("row", "x=2")]
    assert files.read_corpus(spark, str(tmp_path / "b.txt")).select("kind", "text").first().asDict() == {"kind": "text", "text": "hello"}


def test_json_shape(spark):
    d = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"a":1}',), ("[1,2,3]",)], "text string")
    assert [(r["as_table"], r["record_count"]) for r in files.json_shape(d).collect()] == [(True, 2), (False, 1), (False, 3)]


def test_memory_adds_up(spark):
    rows = spark.createDataFrame([("Acme", "organization"), ("ACME", "organization"), ("Bob", "person")], "text string, type string")
    first = extract.update_memory(None, rows)
    again = {r["term"]: (r["observations"], r["prior"]) for r in extract.update_memory(first, rows).collect()}
    assert again == {"acme": (4, 0.7), "bob": (2, 0.6)}
    assert first.where(F.col("term") == "acme").first()["prior"] == 0.6


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.json").write_text('{"a": 1, "b": {"c": 2}}')
    (tmp_path / "c.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    (tmp_path / "d.txt").write_bytes(b"ok \xff bad")
    rows = files.read_corpus(spark, str(tmp_path)).select("source_type", "kind", "text").collect()
    assert sorted(map(tuple, rows)) == [
        ("csv", "row", "x=1; y=2"), ("json", "row", "a=1; b=x"), ("json", "row", "a=2"), ("json", "text", '{"a": 1, "b": {"c": 2}}'), ("txt", "text", "ok  bad"),
    ]


def test_second_rule_set_pairs_whole_sentences(spark):
    text = "Anna Berg met Carl Dorn and Eva Frank and Gus Holt and Ida Jung and Kim Lund."
    chunks = spark.createDataFrame([(1, 0, text)], "doc_id int, idx int, text string")
    n = extract.entities(chunks, gen=2).count()
    assert n > 4
    assert extract.relations(chunks, gen=2).count() == n * (n - 1) // 2
    assert extract.relations(chunks, gen=2, reach=1).count() == n - 1
