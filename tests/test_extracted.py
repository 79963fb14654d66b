"""Mentions and relations of a folder come from one pass over its chunks."""

from strataloom.operators import chunking, extract
from strataloom.plans import base

TEXT = "Acme Holdings owns NASA Labs and pays $5 to Jane Doe. Jane Doe met IBM on 1/2/2024! Nobody Here. Alone."


def test_one_pass_gives_what_two_gave(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "IBM."), (3, "none at all"), (4, (TEXT + " ") * 40), (5, None)], "doc_id long, text string")
    chunks = chunking.chunk(docs)
    found = extract.extracted(chunks)
    assert sorted(map(tuple, extract.mentioned(found).collect())) == sorted(map(tuple, extract.entities(chunks).drop("chunk_preview").collect()))
    got = sorted(map(tuple, extract.related(found).collect()))
    assert got == sorted(map(tuple, extract.relations(chunks).collect())) and len(got) > 10
    first = [r for r in got if r[0] == 1 and r[2] == 0]
    assert {r[8] if isinstance(r[8], str) and r[8] == "owns" else r[9] for r in first} == {"owns"}


def test_mentions_and_relations_share_the_extraction(spark):
    folder = "/root/testdata/sf0.001"
    both = [base.mentions(spark, folder), base.relations(spark, folder)]
    plans = [df._jdf.queryExecution().withCachedData().toString() for df in both]
    assert all("InMemoryRelation" in p for p in plans)
    assert [n for (_, _, f, n) in base._KEPT if f == folder and n in ("mentions", "relations")] == []
    base.forget(spark)
