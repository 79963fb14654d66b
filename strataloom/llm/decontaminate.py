"""Benchmark decontamination by a prefix-filtered set join of word windows, in DataFrame operations only.

Every window of an item is a set of words that a document has to contain whole.
With the words in one global order, rare ones first, a containing document must
hold the first word of that order, so only this one is joined. Where it stands
in the window and in the document gives the only possible start (positional
bound); the window must end inside the document (length bound); what is left is
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import free_names, row_key
from strataloom.session import cut_lineage

WINDOW = 10
SENT = 1_000_000  # rows of an id and a hash that may be sent to all tasks
BLOCK = 50_000  # windows that are sent to all tasks at a time, about 10 MB

# Letters that are lowered, and what parts words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """Words of a text; none of a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), GAPS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id, need``: every run of ``size`` words of an item, or all its words if there are fewer."""
    own = items.select(F.col("item_id").cast("long"), words().alias("w")).where(F.size("w") > 0).distinct()
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size)), lambda i: F.slice("w", i + 1, size))
    return own.select("item_id", F.explode(runs).alias("need")).distinct()


def with_rarest(needed: DataFrame, docs_words: DataFrame, block: int) -> DataFrame:
    """``need, word, at``: the word of each distinct window that the fewest documents' words are, and where it stands.

    Counts are of all documents; only words of the benchmark are counted.
    """
    distinct = needed.select("need").distinct()
    vocabulary = distinct.select(F.explode("need").alias("word")).distinct()
    listed = vocabulary.agg(F.count("*").alias("n")).first()["n"]
    spread = docs_words.select(F.explode("w").alias("word"))
    counted = spread.join(F.broadcast(vocabulary) if listed <= 20 * block else vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    placed = distinct.select("need", F.posexplode("need").alias("at", "word")).join(counted, "word", "left")
    first = placed.groupBy("need").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word", "at")).alias("first"))
    return first.select("need", "first.word", "first.at")


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document row and window found: ``doc_id, key, n_words, start, need``; and one with null ``start`` per document row.

    The windows are met block by block, each block a broadcast of at most
    ``block`` windows of ``size`` words; one pass over the documents per block.
    No word of a document is shuffled. A window that occurs in a third of all
    documents, or a rarest word that does, is no key of a shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), words().alias("w"))
    needed = cut_lineage(with_rarest(windows(items, size), texts, block))
    n = needed.count()
    parts = max(1, -(-n // block))
    end = F.lit("")  # no word is empty: this last element stands for the document itself
    spread = texts.select("doc_id", "key", "w", F.posexplode(F.concat("w", F.array(end))).alias("pos", "word"))
    whole = needed.limit(0).unionByName(needed.sparkSession.createDataFrame([(None, "", 0)], "need array<string>, word string, at int"))
    found = None
    for k in range(parts):
        some = needed if parts == 1 else needed.where(F.pmod(F.xxhash64("need"), F.lit(parts)) == k)
        some = some.unionByName(whole) if k == 0 else some
        start = F.col("pos") - F.col("at")
        fits = (start >= 0) & (start + F.size("need") <= F.size("w"))
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("need"), F.lit(0))) == F.col("need")
        hits = spread.join(F.broadcast(some), "word").where(F.col("need").isNull() | (fits & same))
        hits = hits.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.when(F.col("need").isNotNull(), start).alias("start"), "need")
        found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key`` (hash of the text) for every row of ``docs(doc_id, text)``.

    ``items(item_id, text)`` with null or empty texts have no windows. A null
    document text has no words; rows with one id and different texts are told
    apart by their text; equal rows are reported alike, each once; other
    columns are not looked at. Empty tables give no rows or no hits.
    """
    found = cut_lineage(matches(docs, items, size, block))
    rows = found.where("start IS NULL").select("doc_id", "key", "n_words")
    hits = found.where("start IS NOT NULL").select("doc_id", "key", "start", "need").distinct()
    # windows of one document in order: each adds the words behind the furthest end so far
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("doc_id", "key", "start").agg(F.max(F.col("start") + F.size("need")).alias("stop"))
    added = spans.withColumn("covered", F.coalesce(F.max("stop").over(before), F.lit(0)))
    n_hit = added.groupBy("doc_id", "key").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "covered"))).alias("n_hit"))
    of_items = (
        hits.select("doc_id", "key", "need").distinct().join(windows(items, size), "need").select("doc_id", "key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id", "key").agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    )
    per_doc = n_hit.join(of_items, (n_hit["doc_id"].eqNullSafe(of_items["doc_id"])) & (n_hit["key"] == of_items["key"]), "left").select(
        n_hit["doc_id"].alias("d"), n_hit["key"].alias("k"), "n_hit", "n_items", "items"
    )
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["d"]) & (rows["key"] == per_doc["k"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "key",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item.

    Null and empty texts hold none and stay; repeated rows go or stay together;
    rows of one id, null too, are judged each by its text. Columns of any name
    pass through; without items or rows nothing changes.
    """
    doc, key = free_names(docs, "_d", "_k")
    found = decontaminate(docs.select("doc_id", "text"), items).where("contaminated")
    hit = cut_lineage(found.select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct())
    gone = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key))
    return docs.join(F.broadcast(hit) if hit.count() <= SENT else hit, gone, "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS need, least(len(w), 10) AS size
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM n),
p AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS need
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT DISTINCT doc_id, i, p.size, item_id FROM p JOIN n USING (need, size)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(0, 10) AS t(k) WHERE k < size GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
