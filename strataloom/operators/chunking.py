"""Normalisation, chunks and their validation, page quality."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numeric import as_col, clamp, count_if, flags, ratio, rnd
from strataloom.functions.text import SPACE, strip, words
from strataloom.operators.ranks import row_index

# Currency signs and codes.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compose(c) -> Column:
    """Unicode NFKC; ASCII text takes no trip through Python values it does not need."""
    text = as_col(c)
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _dates(text: Column) -> Column:
    """``a/b/yyyy`` to ``yyyy-aa-bb``, one rewrite per digit layout (longest first)."""
    edge_l, edge_r = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    pad = {1: "0", 2: ""}
    for digits, year in ((r"(\d{4})", "$3"), (r"(\d{3})", "$3"), (r"([0-6]\d)", "20$3"), (r"([7-9]\d)", "19$3")):
        for first in (2, 1):
            for second in (2, 1):
                pattern = rf"{edge_l}(\d{{{first}}})[/-](\d{{{second}}})[/-]{digits}{edge_r}"
                text = F.regexp_replace(text, pattern, f"{year}-{pad[first]}$1-{pad[second]}$2")
    return text


def normalize(df: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """Rewrite ``text`` and list the steps that changed it in ``applied``."""
    raw = F.col(text)
    composed = compose(raw) if nfkc else raw
    out = df.withColumn("_a", composed)
    out = out.withColumn("_b", F.regexp_replace("_a", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    out = out.withColumn("_c", F.regexp_replace(F.regexp_replace("_b", r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    money = F.col("_c")
    for sign, code in CURRENCIES.items():
        # Commas inside the amount are removed with a look-behind for the sign and digits.
        amount = rf"[{sign}]\s?([\d,]+(?:\.\d+)?)"
        money = F.regexp_replace(money, amount, f"\u0001$1\u0002 {code}")
    for _ in range(1):
        money = F.regexp_replace(money, r",(?=[\d,]*(?:\.\d+)?\u0002)", "")
    money = F.regexp_replace(money, r"[\u0001\u0002]", "")
    out = out.withColumn("_d", money).withColumn("_e", _dates(F.col("_d")))
    steps = flags(
        (F.col("_a") != raw, "encoding_nfkc"), (F.col("_b") != F.col("_a"), "strip_control_chars"), (F.lit(True), "whitespace_collapse"),
        (F.col("_c").rlike(r"[$€£₹]\s?[\d,]+"), "currency_iso"), (F.col("_e") != F.col("_d"), "temporal_iso"),
    )
    return (
        out.withColumn("applied", steps).withColumn(text, strip("_e")).withColumn("char_count", F.length(text).cast("long"))
        .drop("_a", "_b", "_c", "_d", "_e")
    )


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 400, overlap: int = 60, tail: bool = False, keep=()) -> DataFrame:
    """Word-window chunks ``key, idx, text, start_word, end_word, word_count, strategy``.

    ``tail`` also emits windows that start inside the last full window.
    """
    step = max(1, size - overlap)
    n = F.size("_w")
    count = F.ceil(n / step) if tail else F.greatest(F.lit(1), F.ceil((n - size) / step) + 1)
    starts = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: i * F.lit(step))
    out = docs.select(key, *keep, words(text).alias("_w")).where(F.size("_w") > 0)
    out = out.select(key, *keep, "_w", F.posexplode(starts).alias("idx", "start_word"))
    window = F.slice("_w", F.col("start_word") + 1, F.lit(size))
    return out.select(
        key, *keep, "idx", F.array_join(window, " ").alias("text"), "start_word",
        (F.col("start_word") + F.size(window)).alias("end_word"), F.size(window).alias("word_count"), F.lit("word_window").alias("strategy"),
    )


def chunk_rows(rows: DataFrame, key: str, text: str = "text", source: str = "source_id", per_chunk: int = 25) -> DataFrame:
    """Table-aware chunks of ``per_chunk`` rows in ``key`` order, per source."""
    numbered = row_index(rows.select(source, key, text), key, by=[source], name="_row")
    line = F.struct("_row", F.col(text).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n")
    return (
        numbered.withColumn("idx", F.floor(F.col("_row") / per_chunk).cast("int"))
        .groupBy(source, "idx")
        .agg(body.alias("text"), F.min("_row").alias("start_word"), (F.max("_row") + 1).alias("end_word"))
        .withColumn("word_count", F.size(words("text"))).withColumn("strategy", F.lit("table_aware"))
    )


def validate_chunks(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", overlap: int = 60) -> DataFrame:
    """Interval-union coverage and overlap correctness per document."""
    order = W.partitionBy(key).orderBy("start_word", "idx")
    reach = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    prev_end, prev_start = F.lag("end_word").over(order), F.lag("start_word").over(order)
    fresh = F.greatest(F.lit(0), F.col("end_word") - F.greatest(F.coalesce(reach, F.lit(0)), F.col("start_word")))
    actual = F.when(prev_end.isNotNull(), F.greatest(F.lit(0), prev_end - F.col("start_word")))
    expected = F.least(F.lit(overlap), prev_end - prev_start, F.col("end_word") - F.col("start_word"))
    per_chunk = chunks.select(key, fresh.alias("fresh"), actual.alias("shared"), (actual == expected).alias("right"))
    measured = per_chunk.groupBy(key).agg(
        F.count("*").alias("chunk_count"), F.sum("fresh").alias("covered_words"), F.count("shared").alias("pairs"),
        count_if(F.col("right")).alias("correct_pairs"), F.coalesce(F.min("shared"), F.lit(0)).alias("min_overlap"),
        F.coalesce(F.max("shared"), F.lit(0)).alias("max_overlap"),
    )
    total = docs.select(key, F.size(words(text)).cast("long").alias("total_words"))
    zero = ["chunk_count", "covered_words", "pairs", "correct_pairs", "min_overlap", "max_overlap"]
    return total.join(measured, key, "left").fillna(0, zero).select(
        key, "total_words", "chunk_count", "covered_words", rnd(100.0 * ratio("covered_words", "total_words"), 2).alias("coverage_pct"), "pairs", "correct_pairs",
        F.when(F.col("total_words") == 0, F.lit(0.0)).when(F.col("pairs") == 0, F.lit(100.0))
        .otherwise(rnd(100.0 * ratio("correct_pairs", "pairs"), 2)).alias("overlap_correctness_pct"),
        "min_overlap", "max_overlap", (F.col("covered_words") < F.col("total_words")).alias("data_loss"),
    )


def lines_of(text) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(as_col(text), r"\r\n|\n|\r"), lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")), lambda s: s != "")


def page_noise(pages: DataFrame, key: str = "page_id", text: str = "text", cut: float = 0.35) -> DataFrame:
    """Lines per page and how many are mostly symbols."""
    noise = lambda s: F.length(F.regexp_replace(s, r"[\p{L}\p{N} .,:;\-_()/]", "")) / F.greatest(F.lit(1), F.length(s))
    lines = lines_of(text)
    return pages.select(
        key, F.size(lines).alias("line_count"), F.size(F.filter(lines, lambda s: noise(s) > cut)).alias("noisy_lines")
    )


def repeated_lines(pages: DataFrame, source: str = "source", text: str = "text", keep: int | None = None) -> DataFrame:
    """First and last lines that repeat over the pages of a source."""
    ends = F.array(
        F.struct(F.lit("header").alias("place"), F.lower(F.try_element_at("_l", F.lit(1))).alias("line")),
        F.struct(F.lit("footer").alias("place"), F.lower(F.try_element_at("_l", F.lit(-1))).alias("line")),
    )
    found = (
        pages.select(source, lines_of(text).alias("_l")).where(F.size("_l") > 0)
        .select(source, F.explode(ends).alias("e")).groupBy(source, "e.place", "e.line").agg(F.count("*").alias("pages"))
        .where((F.col("pages") > 1) & (F.length("line") > 3))
    )
    if keep is None:
        return found
    rank = F.row_number().over(W.partitionBy(source, "place").orderBy(F.desc("pages"), "line"))
    return found.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r")


def malformed_rows(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """Table-like lines that split into no columns, counted per page.

    Two separators always split a line into three parts, so the second count
    stays 0 as in the original rule; it is kept for the report's shape.
    """
    pipes = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    tabs = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\t"), F.lit("")))
    table_like = F.filter(lines_of(text), lambda s: (pipes(s) >= 2) | (tabs(s) >= 2))
    broken = F.filter(table_like, lambda s: (pipes(s) <= 1) & (tabs(s) <= 1))
    return pages.select(key, F.size(table_like).alias("table_lines"), F.size(broken).alias("malformed_rows"))


def page_continuity(pages: DataFrame, mentions: DataFrame, source: str = "source", page: str = "page_id") -> DataFrame:
    """Entity overlap of neighbouring pages: ``source, position, overlap, fragmented, continuous``.

    ``mentions`` holds ``source, page, entity``. Neighbours meet by an equi-join
    on (source, position, entity), so no task holds all pages of a source.
    """
    placed = row_index(pages.select(source, page).distinct(), page, by=[source], name="position")
    found = mentions.select(source, page, F.lower(F.trim("entity")).alias("entity")).distinct().join(placed, [source, page])
    sizes = placed.join(found.groupBy(source, "position").agg(F.count("*").alias("n")), [source, "position"], "left").select(
        source, "position", F.coalesce("n", F.lit(0)).alias("n")
    )
    ahead = found.select(source, (F.col("position") + 1).alias("position"), "entity")
    common = found.join(ahead, [source, "position", "entity"]).groupBy(source, "position").agg(F.count("*").alias("common"))
    before = sizes.select(source, (F.col("position") + 1).alias("position"), F.col("n").alias("before"))
    both = sizes.join(before, [source, "position"]).join(common, [source, "position"], "left").fillna(0, ["common"])
    union = F.col("n") + F.col("before") - F.col("common")
    overlap = F.when(union == 0, F.lit(1.0)).otherwise(F.col("common") / union)
    return both.select(
        source, "position", rnd(overlap).alias("overlap"), (overlap < 0.1).alias("fragmented"), (overlap >= 0.15).alias("continuous")
    )


def continuity_score(continuity: DataFrame, source: str = "source") -> DataFrame:
    return continuity.groupBy(source).agg(
        count_if(F.col("continuous")).alias("continuity_pairs"), F.count("*").alias("adjacent_page_pairs"), count_if(F.col("fragmented")).alias("fragmented_pairs"),
    ).withColumn("continuity_score", rnd(ratio("continuity_pairs", "adjacent_page_pairs")))


def chunk_lineage(chunks: DataFrame, mentions: DataFrame, confidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per chunk: confidence, distinct entities and warnings. ``confidence`` is ``key, parser_confidence``."""
    counted = mentions.groupBy(key, "chunk_idx").agg(F.count_distinct("text", "label").alias("entity_count"))
    out = (
        chunks.join(counted, (chunks[key] == counted[key]) & (chunks["idx"] == counted["chunk_idx"]), "left")
        .drop(counted[key]).drop("chunk_idx").join(confidence, key, "left")
    )
    table = F.col("strategy") == "table_aware"
    score = F.when(table, F.lit(1.0)).otherwise(F.coalesce("parser_confidence", F.lit(1.0)))
    count = F.coalesce("entity_count", F.lit(0))
    span = F.concat(F.when(table, "rows ").otherwise("words "), F.col("start_word"), F.lit("-"), F.col("end_word"))
    warnings = flags((score < 0.6, "low_parser_confidence"), (count == 0, "no_entities_extracted"))
    return out.select(
        key, "idx", rnd(clamp(score)).alias("confidence"), span.alias("page_or_row"), count.alias("entity_count"), warnings.alias("warnings")
    )
