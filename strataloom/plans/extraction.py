"""Entities, relations and term memory over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import chunking, extract
from strataloom.plans.registry import query
from strataloom.plans.text import chunks_sql
from strataloom.session import load
from strataloom.sources import files

# SQL twins. RE2 takes only ASCII letters as word characters, Java also accented
# ones; the twins therefore read the text with Latin letters masked as "_".
MASK = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
CHUNKS = chunks_sql(keep="source,")
TYPE_CASE = "CASE label WHEN 'MONEY' THEN 'value' WHEN 'DATE' THEN 'time' WHEN 'ORG' THEN 'organization' ELSE 'entity' END"


def mentions_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, chunk_idx, {p} AS p, '{label}' AS label, unnest(list_transform(regexp_extract_all(t, '{pattern}'), lambda x: trim(x))) AS x, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS o FROM a"
        for p, (label, pattern) in enumerate(extract.PATTERNS)
    )
    return f"""SELECT doc_id, source, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY p, o) - 1 AS INTEGER) AS pos, x AS text, label, {TYPE_CASE} AS type FROM (
  SELECT * FROM ({parts}) WHERE p <> 2 OR length(x) > 3 QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx, x ORDER BY p, o) = 1)"""


MASKED = f"c AS ({CHUNKS}), a AS (SELECT doc_id, source, idx AS chunk_idx, regexp_replace(text, '{MASK}', '_', 'g') AS t FROM c)"
MENTIONS = f"{MASKED}, m AS ({mentions_sql()})"


def relations_sql() -> str:
    return f"""{MENTIONS}, s AS (SELECT doc_id, source, idx AS chunk_idx, unnest(regexp_split_to_array(text, '[.!?]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]'), 1) - 1 AS sentence FROM c),
f AS (SELECT s.*, m.text, m.type, row_number() OVER (PARTITION BY s.doc_id, s.chunk_idx, s.sentence ORDER BY m.pos) AS i FROM s JOIN m ON s.doc_id = m.doc_id AND s.chunk_idx = m.chunk_idx AND contains(s.s, m.text)),
r AS (SELECT l.doc_id, l.source AS src, CAST(l.chunk_idx AS INTEGER) AS chunk_idx, CAST(l.sentence AS INTEGER) AS sentence, CAST(l.i AS INTEGER) AS i, CAST(r.i AS INTEGER) AS j, l.text AS source, l.type AS source_type, r.text AS target, r.type AS target_type,
  CASE WHEN regexp_matches(lower(l.s), 'revenue|sales|profit|income') THEN 'has_revenue' WHEN regexp_matches(lower(l.s), 'employ|hire|staff') THEN 'employs' WHEN regexp_matches(lower(l.s), 'own|acquir|subsidiar') THEN 'owns'
    WHEN regexp_matches(lower(l.s), 'located|based|headquarter') THEN 'located_in' WHEN l.type = 'time' OR r.type = 'time' THEN 'occurred_at' ELSE 'related_to' END AS relation, substr(trim(l.s), 1, 120) AS context
  FROM f l JOIN f r ON l.doc_id = r.doc_id AND l.chunk_idx = r.chunk_idx AND l.sentence = r.sentence AND r.i BETWEEN l.i + 1 AND l.i + 3)"""


def chunks(spark, sf_dir, keep=()):
    return chunking.chunk(load(spark, sf_dir, "documents"), keep=keep)


def mentions(spark, sf_dir, keep=("source",)):
    return extract.entities(chunks(spark, sf_dir, keep), keep=keep)


@query("regex_entities", f"WITH {MENTIONS} SELECT doc_id, chunk_idx, pos, text, label, type FROM m")
def regex_entities(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", "chunk_idx", "pos", "text", "label", "type")


@query(
    "entity_dedupe",
    f"""WITH {MENTIONS}, d AS (SELECT DISTINCT source, text, label, type, doc_id FROM m)
SELECT source, text, label, type, min(doc_id) AS chunk_idx, array_to_string(CASE WHEN count(*) > 1 THEN list_sort(list(doc_id ORDER BY doc_id)[1:3]) ELSE [] END, ',') AS occurrences FROM d GROUP BY ALL""",
)
def entity_dedupe(spark, sf_dir):
    """Documents of a source taken as its chunks."""
    found = mentions(spark, sf_dir).select("source", "text", "label", "type", F.col("doc_id").cast("int").alias("chunk_idx"))
    out = extract.dedupe_entities(found, "source")
    joined = F.array_join(F.transform("chunk_occurrences", lambda x: x.cast("string")), ",")
    return out.select("source", "text", "label", "type", F.col("chunk_idx").cast("long").alias("chunk_idx"), joined.alias("occurrences"))


@query(
    "cooccurrence_relations",
    f"WITH {relations_sql()} SELECT doc_id, chunk_idx, sentence, i, j, source, source_type, target, target_type, relation, context FROM r",
)
def cooccurrence_relations(spark, sf_dir):
    return extract.relations(chunks(spark, sf_dir))


@query("relation_classes", f"WITH {relations_sql()} SELECT relation, source_type, target_type, count(*) AS count FROM r GROUP BY ALL")
def relation_classes(spark, sf_dir):
    found = extract.relations(chunks(spark, sf_dir))
    return found.groupBy("relation", "source_type", "target_type").agg(F.count("*").alias("count"))


def mentions_2_sql() -> str:
    """Second rule set: one proper-name list per chunk after blanking the money runs."""
    rest = f"regexp_replace(t, '{extract.MONEY_2}(\\s+[A-Z][a-zA-Z]+){{0,3}}', ' 0 ', 'g')"
    lists = (
        (0, f"regexp_extract_all(t, '{extract.MONEY_2}')", "'MONEY'"), (1, f"regexp_extract_all(t, '{extract.DATE_2}')", "'DATE'"),
        (2, f"regexp_extract_all({rest}, '{extract.PROPER_2}', 1)", "NULL"),
    )
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, chunk_idx, {p} AS p, {label} AS lab, unnest({found}) AS x, generate_subscripts({found}, 1) AS o FROM a" for p, found, label in lists
    )
    cities = ", ".join(f"'{c}'" for c in extract.CITIES)
    label = f"""coalesce(lab, CASE WHEN regexp_matches(x, '{extract.ORG_SUFFIX}') THEN 'ORG' WHEN lower(x) IN ({cities}) THEN 'GPE' WHEN len(regexp_split_to_array(x, '\\s+')) = 2 THEN 'PERSON' ELSE 'ENTITY' END)"""
    return f"""SELECT *, CASE label WHEN 'ORG' THEN 'organization' WHEN 'PERSON' THEN 'person' WHEN 'GPE' THEN 'location' WHEN 'MONEY' THEN 'monetary' WHEN 'DATE' THEN 'temporal' ELSE 'concept' END AS type FROM (
  SELECT doc_id, source, chunk_idx, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY p, o) - 1 AS pos, x AS text, {label} AS label FROM ({parts}) WHERE length(x) >= 2)"""


FREQUENCY = f"""WITH {MASKED}, m AS ({mentions_2_sql()}), f AS (SELECT source, lower(text) AS norm, label, arg_min(text, (doc_id, chunk_idx, pos)) AS text, any_value(type) AS type,
  count(*) AS frequency, count(DISTINCT doc_id) AS chunk_count, min(doc_id) AS first_chunk FROM m GROUP BY 1, 2, 3)"""


def frequencies(spark, sf_dir):
    found = extract.entities(chunks(spark, sf_dir, ("source",)), gen=2, keep=("source",))
    found = found.withColumn("pos", F.struct("chunk_idx", "pos")).withColumn("chunk_idx", F.col("doc_id"))
    return extract.frequency(found, "source")


@query("entity_frequency", f"{FREQUENCY} SELECT * FROM f")
def entity_frequency(spark, sf_dir):
    return frequencies(spark, sf_dir)


@query(
    "entity_confidence",
    f"""{FREQUENCY}, s AS (SELECT source, norm, label, round(0.4::DOUBLE * least(1.0, frequency / 5.0) + 0.35::DOUBLE * CASE WHEN type = 'concept' THEN 0.0 ELSE 0.5 END + 0.25::DOUBLE * least(1.0, length(text) / 25.0), 4) AS confidence FROM f)
SELECT *, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM s""",
)
def entity_confidence(spark, sf_dir):
    return extract.entity_confidence(frequencies(spark, sf_dir)).select("source", "norm", "label", "confidence", "band")


ALLOWED = ("owns", "located_in", "occurred_at")


@query(
    "constrained_relations",
    f"""WITH c AS ({chunks_sql()}), s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]')) AS s FROM c), k AS (SELECT doc_id, regexp_replace(lower(s), '{MASK}', '_', 'g') AS s FROM s)
SELECT relation, count(*) AS count FROM (SELECT CASE WHEN regexp_matches(s, '\\b(owns|acquired|subsidiary|parent of)\\b') THEN 'owns' WHEN regexp_matches(s, '\\b(located in|based in|headquartered|in the city)\\b') THEN 'located_in'
  WHEN regexp_matches(s, '\\b(on|during|dated)\\b') THEN 'occurred_at' ELSE 'related_to' END AS relation FROM k) GROUP BY relation""",
)
def constrained_relations(spark, sf_dir):
    sentences = chunks(spark, sf_dir).select(F.explode(F.split("text", "[.!?]")).alias("s"))
    return sentences.groupBy(extract.classify_relation("s", ALLOWED).alias("relation")).agg(F.count("*").alias("count"))


@query("second_rule_relations")
def second_rule_relations(spark, sf_dir):
    return extract.relation_counts(chunks(spark, sf_dir))


@query(
    "semantic_memory",
    f"""WITH {MENTIONS}, d AS (SELECT DISTINCT source, text, label, type FROM m) SELECT lower(text) AS term, min(text) AS text, min(type) AS type, count(*) AS observations,
  round(least(0.95, 0.5 + 0.05 * count(*)), 4)::DOUBLE AS prior FROM d GROUP BY 1""",
)
def semantic_memory(spark, sf_dir):
    return extract.update_memory(None, mentions(spark, sf_dir).select("source", "text", "label", "type").distinct())


@query(
    "pair_counts",
    f"""WITH {relations_sql()} SELECT least(lower(source), lower(target)) AS "left", greatest(lower(source), lower(target)) AS "right", count(*) AS count FROM r GROUP BY 1, 2""",
)
def pair_counts(spark, sf_dir):
    return extract.pair_counts(extract.relations(chunks(spark, sf_dir)))


@query(
    "chunk_lineage",
    rf"""WITH {MENTIONS}, e AS (SELECT doc_id, chunk_idx, count(DISTINCT (text, label)) AS n FROM m GROUP BY 1, 2),
p AS (SELECT doc_id, round(length(regexp_replace(text, '[^\pL\pN\s]', '', 'g')) / CAST(greatest(1, length(text)) AS DOUBLE), 4) AS conf FROM documents)
SELECT c.doc_id, CAST(c.idx AS INTEGER) AS idx, p.conf AS confidence, 'words ' || c.start_word || '-' || c.end_word AS page_or_row, coalesce(e.n, 0) AS entity_count,
  concat_ws(',', CASE WHEN p.conf < 0.6 THEN 'low_parser_confidence' END, CASE WHEN e.n IS NULL THEN 'no_entities_extracted' END) AS warnings
FROM c JOIN p USING (doc_id) LEFT JOIN e ON e.doc_id = c.doc_id AND e.chunk_idx = c.idx""",
)
def chunk_lineage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    conf = files.needs_ocr(files.block_confidence(docs, gen=2), "doc_id").select("doc_id", "parser_confidence")
    out = chunking.chunk_lineage(chunks(spark, sf_dir), mentions(spark, sf_dir), conf)
    return out.withColumn("warnings", F.array_join("warnings", ","))


CONTINUITY = f"""WITH {MENTIONS}, p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents),
e AS (SELECT DISTINCT m.source, p.position, lower(text) AS entity FROM m JOIN p ON m.source = p.source AND m.doc_id = p.doc_id), n AS (SELECT source, position, count(*) AS n FROM e GROUP BY 1, 2),
k AS (SELECT b.source, b.position, count(*) AS common FROM e a JOIN e b ON a.source = b.source AND a.position + 1 = b.position AND a.entity = b.entity GROUP BY 1, 2),
o AS (SELECT p.source, p.position, coalesce(k.common, 0) / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(k.common, 0), 0) AS raw FROM p LEFT JOIN n x ON x.source = p.source AND x.position = p.position
  LEFT JOIN n y ON y.source = p.source AND y.position = p.position - 1 LEFT JOIN k ON k.source = p.source AND k.position = p.position WHERE p.position > 0),
v AS (SELECT source, position, coalesce(raw, 1.0) AS overlap FROM o)"""


def continuity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id")
    found = mentions(spark, sf_dir).select("source", "doc_id", F.col("text").alias("entity"))
    return chunking.page_continuity(docs, found, "source", "doc_id")


@query("page_continuity", f"{CONTINUITY} SELECT source, position, round(overlap, 4) AS overlap, overlap < 0.1 AS fragmented, overlap >= 0.15 AS continuous FROM v")
def page_continuity(spark, sf_dir):
    return continuity(spark, sf_dir)


@query(
    "page_continuity_score",
    f"""{CONTINUITY} SELECT source, count(*) FILTER (overlap >= 0.15) AS continuity_pairs, count(*) AS adjacent_page_pairs, count(*) FILTER (overlap < 0.1) AS fragmented_pairs,
  round(count(*) FILTER (overlap >= 0.15) / CAST(count(*) AS DOUBLE), 4) AS continuity_score FROM v GROUP BY source""",
)
def page_continuity_score(spark, sf_dir):
    return chunking.continuity_score(continuity(spark, sf_dir))
