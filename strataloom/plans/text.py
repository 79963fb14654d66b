"""Cleaning, chunks, page quality, sources over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import text as ft
from strataloom.operators import chunking, profile
from strataloom.plans.registry import COLUMNS, query
from strataloom.session import load
from strataloom.sources import files, html, sinks

# SQL fragments. Fixed value: the ASCII white-space class both engines share.
WS = r"[ \t\n\r\f\x0B]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(c: str = "text") -> str:
    c = f"regexp_replace({c}, '\\n{{3,}}', E'\\n\\n', 'g')"
    c = f"regexp_replace({c}, ' {{2,}}', ' ', 'g')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    return strip_sql(c)


def words_sql(c: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def chunks_sql(table: str = "documents", key: str = "doc_id", size: int = 400, overlap: int = 60, keep: str = "", tail: bool = False) -> str:
    """SQL twin of the word-window chunker."""
    step = size - overlap
    count = f"CAST(ceil(n / {step}.0) AS BIGINT)" if tail else f"greatest(1, CAST(ceil((n - {size}) / {step}.0) AS BIGINT) + 1)"
    return f"""SELECT {key}, {keep} i AS idx, i * {step} AS start_word, least(n, i * {step} + {size}) AS end_word,
  array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text FROM (SELECT *, unnest(range({count})) AS i FROM (
  SELECT *, len(w) AS n FROM (SELECT {key}, {keep} {words_sql()} AS w FROM {table})) WHERE n > 0)"""


@query("clean_text", f"SELECT doc_id, length({clean_sql()}) AS chars, sha256({clean_sql()}) AS sha FROM documents")
def clean_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", ft.clean("text").alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("sha"))


@query("normalize_corpus")
def normalize_corpus(spark, sf_dir):
    out = chunking.normalize(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2("text", 256).alias("sha"), "char_count", F.array_join("applied", ",").alias("applied"))


@query(
    "normalize_steps",
    f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS t1 FROM documents),
b AS (SELECT *, regexp_replace(regexp_replace(t1, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g') AS t2 FROM a)
SELECT doc_id, concat_ws(',', CASE WHEN t1 <> t0 THEN 'strip_control_chars' END, 'whitespace_collapse',
  CASE WHEN regexp_matches(t2, '[$€£₹]{WS}?[0-9,]+') THEN 'currency_iso' END,
  CASE WHEN regexp_matches(t2, '(^|[^\\pL\\pN_])[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}($|[^\\pL\\pN_])') THEN 'temporal_iso' END) AS applied FROM b""",
)
def normalize_steps(spark, sf_dir):
    out = chunking.normalize(load(spark, sf_dir, "documents").select("doc_id", "text"), nfkc=False)
    return out.select("doc_id", F.array_join("applied", ",").alias("applied"))


@query("chunk_words", f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, sha256(text) AS sha FROM ({chunks_sql()})")
def chunk_words(spark, sf_dir):
    out = chunking.chunk(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "idx", "start_word", "end_word", F.sha2("text", 256).alias("sha"))


@query(
    "chunk_coverage",
    f"""WITH c AS ({chunks_sql(tail=True)}), g AS (SELECT doc_id, idx, start_word, end_word, lag(end_word) OVER w AS pe, lag(start_word) OVER w AS ps,
  max(end_word) OVER (PARTITION BY doc_id ORDER BY start_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY start_word)),
m AS (SELECT doc_id, count(*) AS chunk_count, sum(greatest(0, end_word - greatest(coalesce(reach, 0), start_word))) AS covered, count(pe) AS pairs,
  count(*) FILTER (greatest(0, pe - start_word) = least(60, pe - ps, end_word - start_word)) AS correct, coalesce(min(greatest(0, pe - start_word)) FILTER (pe IS NOT NULL), 0) AS mn, coalesce(max(greatest(0, pe - start_word)) FILTER (pe IS NOT NULL), 0) AS mx FROM g GROUP BY 1)
SELECT d.doc_id, len({words_sql()}) AS total_words, coalesce(chunk_count, 0) AS chunk_count, CAST(coalesce(covered, 0) AS BIGINT) AS covered_words,
  round(coalesce(100.0 * covered / nullif(len({words_sql()}), 0), 0), 2) AS coverage_pct, coalesce(pairs, 0) AS pairs, coalesce(correct, 0) AS correct_pairs,
  CASE WHEN len({words_sql()}) = 0 THEN 0.0::DOUBLE WHEN pairs = 0 THEN 100.0::DOUBLE ELSE round(100.0 * correct / pairs, 2) END AS overlap_correctness_pct,
  CAST(coalesce(mn, 0) AS INTEGER) AS min_overlap, CAST(coalesce(mx, 0) AS INTEGER) AS max_overlap, coalesce(covered, 0) < len({words_sql()}) AS data_loss
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""",
)
def chunk_coverage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return chunking.validate_chunks(chunking.chunk(docs, tail=True), docs)


ROW_TEXT = "concat_ws('; ', " + ", ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in COLUMNS["orders"][:3]) + ")"


@query(
    "chunk_table_rows",
    f"""SELECT o_orderpriority AS source_id, CAST(rn // 25 AS INTEGER) AS idx, min(rn) AS start_word, max(rn) + 1 AS end_word, sha256(string_agg(t, E'\\n' ORDER BY rn)) AS sha FROM (
  SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS rn, {ROW_TEXT} AS t FROM orders) GROUP BY 1, 2""",
)
def chunk_table_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source_id"), "o_orderkey", files.row_text(None, COLUMNS["orders"][:3]).alias("text")
    )
    return chunking.chunk_rows(rows, "o_orderkey").select("source_id", "idx", "start_word", "end_word", F.sha2("text", 256).alias("sha"))


@query(
    "token_sets",
    "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS INTEGER) AS distinct_tokens, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS INTEGER) AS tokens FROM documents",
)
def token_sets(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(ft.tokens("text")).alias("distinct_tokens"), F.size(ft.token_list("text")).alias("tokens"))


@query(
    "normalized_labels",
    """SELECT label, spaced, joined, count(*) AS parts FROM (SELECT p_brand || ' / ' || p_type AS label, trim(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS spaced,
  regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '', 'g') AS joined FROM part) GROUP BY ALL""",
)
def normalized_labels(spark, sf_dir):
    label = F.concat("p_brand", F.lit(" / "), "p_type")
    return load(spark, sf_dir, "part").select(label.alias("label")).groupBy(
        "label", ft.norm_label("label").alias("spaced"), ft.norm_label("label", spaced=False).alias("joined")
    ).agg(F.count("*").alias("parts"))


@query(
    "number_text",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN CAST(o_custkey AS DOUBLE) * 1000000.0 END AS amount FROM orders""",
)
def number_text(spark, sf_dir):
    price, key = F.format_number("o_totalprice", 2), F.format_number("o_custkey", 0)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), price)).when(
        F.col("o_orderkey") % 3 == 1, F.concat(key, F.lit(" million"))
    ).otherwise(F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select("o_orderkey", ft.to_number(text).alias("amount"))


@query(
    "first_year",
    "SELECT doc_id, CAST(CASE WHEN y = '' THEN '-1' ELSE y END AS INTEGER) AS year FROM (SELECT doc_id, regexp_extract(text, '(19[0-9]{2}|20[0-9]{2}|21[0-9]{2})', 1) AS y FROM documents)",
)
def first_year(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", ft.year("text").alias("year"))


LINES = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda s: {strip_sql('s')}), lambda s: s <> '')"


@query(
    "line_noise",
    f"""SELECT doc_id, CAST(len(l) AS INTEGER) AS line_count, CAST(len(list_filter(l, lambda s: length(regexp_replace(s, '[\\pL\\pN .,:;\\-_()/]', '', 'g')) / CAST(greatest(1, length(s)) AS DOUBLE) > 0.35)) AS INTEGER) AS noisy_lines
FROM (SELECT doc_id, {LINES} AS l FROM documents)""",
)
def line_noise(spark, sf_dir):
    return chunking.page_noise(load(spark, sf_dir, "documents"), "doc_id")


@query(
    "repeated_lines",
    f"""WITH l AS (SELECT source, {LINES} AS l FROM documents), e AS (SELECT source, 'header' AS place, lower(l[1]) AS line FROM l WHERE len(l) > 0 UNION ALL SELECT source, 'footer', lower(l[-1]) FROM l WHERE len(l) > 0)
SELECT source, place, line, count(*) AS pages FROM e GROUP BY ALL HAVING count(*) > 1 AND length(line) > 3""",
)
def repeated_lines(spark, sf_dir):
    return chunking.repeated_lines(load(spark, sf_dir, "documents"))


@query(
    "malformed_table_rows",
    f"""SELECT doc_id, CAST(len(list_filter(l, lambda s: length(s) - length(replace(s, '|', '')) >= 2 OR length(s) - length(replace(s, chr(9), '')) >= 2)) AS INTEGER) AS table_lines,
  CAST(0 AS INTEGER) AS malformed_rows FROM (SELECT doc_id, {LINES} AS l FROM documents)""",
)
def malformed_table_rows(spark, sf_dir):
    return chunking.malformed_rows(load(spark, sf_dir, "documents"), "doc_id")


@query(
    "page_confidence",
    r"""SELECT doc_id, round(c, 6) AS confidence, round(c, 6) < 0.45 AS noise_region FROM (SELECT doc_id, least(1.0, 0.55::DOUBLE * least(1.0, length(text) / 1200.0) +
  0.45::DOUBLE * (length(regexp_replace(text, '[^\pL\pN\s]', '', 'g')) / CAST(greatest(1, length(text)) AS DOUBLE))) AS c FROM documents)""",
)
def page_confidence(spark, sf_dir):
    return files.block_confidence(load(spark, sf_dir, "documents"), digits=6).select("doc_id", "confidence", "noise_region")


@query(
    "parser_confidence",
    r"""SELECT source, round(avg(c), 4) AS parser_confidence, count(*) AS blocks, round(avg(c), 4) < 0.4 AS needs_ocr FROM (
  SELECT source, round(length(regexp_replace(text, '[^\pL\pN\s]', '', 'g')) / CAST(greatest(1, length(text)) AS DOUBLE), 4) AS c FROM documents) GROUP BY source""",
)
def parser_confidence(spark, sf_dir):
    return files.needs_ocr(files.block_confidence(load(spark, sf_dir, "documents"), gen=2), "source")


def html_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', '<x>', 'g')"
    for tag in html.DROPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '<x>', 'g')"
    run = "t"
    for name, plain in html.ENTITIES.items():
        run = f"replace({run}, '&{name};', chr({ord(plain)}))"
    run = f"regexp_replace({run}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({out}, '<[^>]*>'), lambda t: {run}), lambda t: t <> ''), chr(10))"


@query("html_text", f"SELECT page_id, {html_sql()} AS text, sha256({html_sql()}) AS sha FROM pages")
def html_text(spark, sf_dir):
    return html.html_text(load(spark, sf_dir, "pages"))


@query(
    "source_fingerprints",
    "SELECT doc_id, sha256(text) AS fingerprint, octet_length(encode(text)) AS size_bytes FROM documents",
)
def source_fingerprints(spark, sf_dir):
    return files.fingerprints(load(spark, sf_dir, "documents"), "text", "doc_id")


@query("corpus_profile", "SELECT source AS source_id, count(*) AS text_block_count, CAST(0 AS BIGINT) AS table_row_count FROM documents GROUP BY 1")
def corpus_profile(spark, sf_dir):
    return profile.corpus_profile(load(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.lit("text").alias("kind")))


CELLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "typed_cells",
    " UNION ALL ".join(
        f"""SELECT c_custkey, '{c}' AS "column", CAST({c} AS VARCHAR) AS value, '{t}' AS value_type FROM customer"""
        for c, t in zip(CELLS[1:], ("string", "int", "float", "string"), strict=True)
    ),
)
def typed_cells(spark, sf_dir):
    return files.typed_cells(load(spark, sf_dir, "customer"), "c_custkey")


@query(
    "rows_to_text",
    "SELECT c_custkey, 'table customer row ' || c_custkey || ': ' || concat_ws('; ', " + ", ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in CELLS[1:]) + ") AS text FROM customer",
)
def rows_to_text(spark, sf_dir):
    return files.rows_to_text(load(spark, sf_dir, "customer"), "customer", "c_custkey")


@query("lineage_events", "SELECT CAST(doc_id AS VARCHAR) AS source_id, 'upload' AS stage, source AS detail FROM documents")
def lineage_events(spark, sf_dir):
    return sinks.lineage_events(load(spark, sf_dir, "documents"), "upload", F.col("source"), "doc_id").drop("at")


@query(
    "json_shape",
    "SELECT event_id, CAST(FALSE AS BOOLEAN) AS as_table, 1 AS record_count FROM events",
)
def json_shape(spark, sf_dir):
    return files.json_shape(load(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"))).drop("text")
