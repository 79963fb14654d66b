"""Confidence scores, quality, evaluation against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import entity_id
from strataloom.functions.numeric import rnd
from strataloom.operators import chunking, evaluate, extract, graph, ontology, score
from strataloom.operators.profile import side_by_side
from strataloom.plans import base, graphs
from strataloom.plans.extraction import relations_sql
from strataloom.plans.registry import query
from strataloom.session import load
from strataloom.sources import files

ORDER = ["doc_id", "chunk_idx", "sentence", "i", "j"]

# SQL twins of the scores.
REL_SQL = relations_sql()
ES = f"""{REL_SQL}, d AS (SELECT source AS source_id, text, label, type, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1, 2, 3, 4),
d2 AS (SELECT *, lower(text) AS norm, CASE WHEN docs > 1 THEN 1 + least(3, docs) ELSE 1 END AS mentions, count(*) OVER (PARTITION BY source_id, lower(text)) AS same, length(regexp_replace(text, '[\\pL\\pN \\-_]', '', 'g')) AS odd FROM d),
es AS (SELECT source_id, text, label, type, norm, mentions, CASE WHEN odd > greatest(1, length(text) // 3) THEN 0.25 ELSE 0.0 END::DOUBLE AS noisy_penalty,
  round(greatest(0.0, least(1.0, 0.35::DOUBLE * least(1.0, mentions / 4.0) + 0.35::DOUBLE * CASE WHEN length(text) >= 4 THEN 1.0 WHEN length(text) >= 2 THEN 0.6 WHEN length(text) >= 1 THEN 0.3 ELSE 0.0 END + 0.3::DOUBLE * CASE WHEN label = 'ENTITY' THEN 0.65 ELSE 0.85 END
    - CASE WHEN same > 1 THEN least(0.35, (same - 1) * 0.1) ELSE 0.0 END - CASE WHEN odd > greatest(1, length(text) // 3) THEN 0.25 ELSE 0.0 END)), 4) AS confidence FROM d2)"""
PRIOR = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in score.RELATION_PRIOR.items()) + " ELSE 0.55 END"
RS = f"""{ES}, mx AS (SELECT source_id, norm, max(confidence) AS c FROM es GROUP BY 1, 2),
rn AS (SELECT *, row_number() OVER (PARTITION BY src, lower(source), relation, lower(target) ORDER BY doc_id, chunk_idx, sentence, i, j) AS nth FROM r),
rs AS (SELECT rn.*, 0.32::DOUBLE * {PRIOR} + 0.28::DOUBLE * least(1.0, length(trim(context)) / 90.0) + 0.2::DOUBLE * coalesce(a.c, 0.55) + 0.2::DOUBLE * coalesce(b.c, 0.55)
    - CASE WHEN nth > 3 THEN 0.3 ELSE (nth - 1) * 0.12 END::DOUBLE - CASE WHEN lower(source) = lower(target) THEN 0.2 ELSE 0 END::DOUBLE AS raw
  FROM rn LEFT JOIN mx a ON a.source_id = src AND a.norm = lower(source) LEFT JOIN mx b ON b.source_id = src AND b.norm = lower(target))"""


def entity_rows(spark, sf_dir):
    return base.kept(spark, sf_dir, "entity_scores", lambda: score.entities(base.entities(spark, sf_dir)))


def relation_rows(spark, sf_dir):
    return base.kept(spark, sf_dir, "relation_scores", lambda: score.relations(base.relations(spark, sf_dir), entity_rows(spark, sf_dir), ORDER))


@query("entity_scores", f"WITH {ES} SELECT source_id, text, label, CAST(mentions AS INTEGER) AS mentions, noisy_penalty, confidence FROM es")
def entity_scores(spark, sf_dir):
    return entity_rows(spark, sf_dir).select("source_id", "text", "label", "mentions", "noisy_penalty", "confidence")


@query("relation_scores", f"WITH {RS} SELECT doc_id, chunk_idx, sentence, i, j, round(greatest(0.0, least(1.0, raw)), 3) AS confidence FROM rs")
def relation_scores(spark, sf_dir):
    rows = base.relations(spark, sf_dir)
    # Three digits keep clear of rounding ties between the engines.
    out = score.relations(rows, entity_rows(spark, sf_dir), ORDER)
    return out.select(*ORDER, rnd("confidence", 3).alias("confidence"))


@query(
    "entity_confidence_summary",
    f"WITH {ES} SELECT count(*) AS \"rows\", count(*) FILTER (confidence < 0.5) AS low_confidence_count, round(avg(confidence), 4) AS mean_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM es",
)
def entity_confidence_summary(spark, sf_dir):
    return score.confidence_summary(entity_rows(spark, sf_dir))


@query(
    "confidence_histogram",
    f"WITH {ES}, b AS (SELECT least(9, floor(confidence * 10)) AS b, count(*) AS n FROM es GROUP BY 1) SELECT round(i / 10.0, 2)::DOUBLE AS bin_start, round((i + 1) / 10.0, 2)::DOUBLE AS bin_end, coalesce(n, 0) AS count FROM (SELECT unnest(range(10)) AS i) LEFT JOIN b ON b.b = i",
)
def confidence_histogram(spark, sf_dir):
    return score.histogram(entity_rows(spark, sf_dir))


def quality_rows(spark, sf_dir):
    return score.entity_quality(entity_rows(spark, sf_dir), base.relations(spark, sf_dir))


@query(
    "entity_quality",
    f"""WITH {ES}, g AS (SELECT source_id, norm, count(*) AS n, count(DISTINCT type) AS k FROM es GROUP BY 1, 2), l AS (SELECT src AS source_id, lower(source) AS norm FROM r UNION SELECT src, lower(target) FROM r)
SELECT 'duplicate' AS finding, source_id AS file, norm AS entity FROM g WHERE n > 1 UNION ALL SELECT 'type_conflict', source_id, norm FROM g WHERE k > 1
UNION ALL SELECT 'orphan', source_id, norm FROM es WHERE (source_id, norm) NOT IN (SELECT (source_id, norm) FROM l) UNION ALL SELECT 'ambiguous', source_id, norm FROM es WHERE type IN ('entity', 'unknown') OR length(text) <= 2
UNION ALL SELECT 'noisy', source_id, norm FROM es WHERE noisy_penalty > 0 UNION ALL SELECT 'low_confidence', source_id, norm FROM es WHERE confidence < 0.5""",
)
def entity_quality(spark, sf_dir):
    return quality_rows(spark, sf_dir).select("finding", "file", "entity")


@query("mention_spread", f"WITH {ES} SELECT CAST(min(mentions) AS INTEGER) AS \"min\", CAST(list_sort(list(mentions))[count(*) // 2 + 1] AS INTEGER) AS median, CAST(max(mentions) AS INTEGER) AS \"max\" FROM es")
def mention_spread(spark, sf_dir):
    return score.mention_spread(entity_rows(spark, sf_dir))


@query("type_and_relation_counts", f"WITH {ES} SELECT 'entity' AS kind, type AS name, count(*) AS count FROM es GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM r GROUP BY 2")
def type_and_relation_counts(spark, sf_dir):
    return score.distributions(entity_rows(spark, sf_dir), base.relations(spark, sf_dir))


def scorecard_parts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    ents, rels = entity_rows(spark, sf_dir), relation_rows(spark, sf_dir)
    nodes, edges = graphs.parts(spark, sf_dir)
    report = chunking.validate_chunks(chunking.chunk(docs), docs)
    pages = files.block_confidence(docs)
    orphans = quality_rows(spark, sf_dir).where("finding = 'orphan'")
    done = score.completeness(orphans, graph.isolated(nodes, edges), nodes, report, pages)
    findings = ontology.semantic_findings(base.entities(spark, sf_dir), rels, 2026)
    consistent = ontology.semantic_score(findings, ents, rels)
    return side_by_side(
        ents.agg(F.avg("confidence").alias("entity_mean")), rels.agg(F.avg("confidence").alias("relation_mean")), graph.density(nodes, edges).select("density"),
        consistent.select(F.col("consistency_score").alias("consistency")), done,
    )


@query("scorecard")
def scorecard(spark, sf_dir):
    return score.scorecard(scorecard_parts(spark, sf_dir))


@query("completeness_and_reliability")
def completeness_and_reliability(spark, sf_dir):
    return scorecard_parts(spark, sf_dir).select("completeness", "reliability")


@query("reprocess_hooks")
def reprocess_hooks(spark, sf_dir):
    card = score.scorecard(scorecard_parts(spark, sf_dir)).select("confidence_score")
    return score.hooks(entity_rows(spark, sf_dir), relation_rows(spark, sf_dir), card)


@query("graph_validation_report")
def graph_validation_report(spark, sf_dir):
    """Counts per finding over entity, edge and semantic findings."""
    semantic = ontology.semantic_findings(base.entities(spark, sf_dir), base.relations(spark, sf_dir), 2026)
    return score.finding_counts(score.report(quality_rows(spark, sf_dir), graphs.quality_rows(spark, sf_dir), semantic))


def priors(spark, sf_dir):
    return extract.update_memory(None, base.entities(spark, sf_dir))


@query("confidence_ledger")
def confidence_ledger(spark, sf_dir):
    ents = entity_rows(spark, sf_dir).withColumn("canonical_id", entity_id("type", "text"))
    nodes = ents.groupBy("canonical_id").agg(F.min("text").alias("label"), F.lit(0.65).alias("confidence"))
    rels = relation_rows(spark, sf_dir)
    edges = rels.select(entity_id("source_type", "source").alias("source"), entity_id("target_type", "target").alias("target"), "confidence")
    return score.ledger(ents, priors(spark, sf_dir), nodes, edges, 0.5)


@query("confidence_ledger_layers")
def confidence_ledger_layers(spark, sf_dir):
    long = score.ledger_long(confidence_ledger(spark, sf_dir))
    return long.groupBy("layer").agg(F.count("score").alias("scored"), rnd(F.avg("score")).alias("mean_score"))


@query(
    "semantic_eda",
    f"""WITH {ES}, e AS (SELECT text, arg_max(confidence, (confidence, source_id)) AS confidence, count(*) AS obs FROM es GROUP BY 1), t AS (SELECT lower(text) AS term, least(0.95, 0.5 + 0.05 * count(*)) AS prior FROM es GROUP BY 1),
k AS (SELECT (SELECT count(*) FROM e) AS node_count, (SELECT count(*) FROM r) AS edge_count, (SELECT count(*) FROM e WHERE text NOT IN (SELECT source FROM r UNION SELECT target FROM r)) AS orphan_node_count,
  (SELECT count(*) FROM e JOIN t ON t.term = lower(text) WHERE abs(prior - confidence) > 0.3) AS drift_count)
SELECT *, round(edge_count / (CAST(node_count AS DOUBLE) * (node_count - 1) / 2), 4) AS density FROM k""",
)
def semantic_eda(spark, sf_dir):
    ents = entity_rows(spark, sf_dir).groupBy("text").agg(F.max("confidence").alias("confidence"))
    out = score.semantic_eda(ents, base.relations(spark, sf_dir), priors(spark, sf_dir))
    return out.select("node_count", "edge_count", "orphan_node_count", "drift_count", "density")


@query("run_scores")
def run_scores(spark, sf_dir):
    from strataloom.plans import rules

    return score.run_scores(rules.profile_accuracy(spark, sf_dir))


# --- evaluation --------------------------------------------------------------------------

# A document is guessed good when it is long; a fixed cut keeps both engines on the same guess.
GUESS = "least(1.0, n_chars / 2000.0)"


def guessed(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("score"))
    return docs.join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "score", F.col("quality").alias("outcome"), "toxic")


PRF = """round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS "precision", round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS recall,
  round(coalesce(2 * (tp / nullif(CAST(tp + fp AS DOUBLE), 0)) * (tp / nullif(CAST(tp + fn AS DOUBLE), 0)) / nullif(tp / nullif(CAST(tp + fp AS DOUBLE), 0) + tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 0), 4) AS f1"""


@query(
    "label_metrics",
    f"""WITH s AS (SELECT {GUESS} AS s, quality AS o FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(9, floor(s * 10)) AS b, count(*) AS n, avg(s) AS ms, avg(o) AS acc FROM s GROUP BY 1),
k AS (SELECT count(*) FILTER (s >= 0.5 AND o = 1) AS tp, count(*) FILTER (s >= 0.5 AND o <> 1) AS fp, count(*) FILTER (s < 0.5 AND o = 1) AS fn, count(*) FILTER (s < 0.5 AND o <> 1) AS tn, round(avg((s - o) * (s - o)), 4) AS brier_score FROM s)
SELECT tp, fp, fn, tn, brier_score, {PRF}, (SELECT round(sum(n * abs(ms - acc)) / sum(n), 4) FROM b) AS ece FROM k""",
)
def label_metrics(spark, sf_dir):
    return evaluate.binary_metrics(guessed(spark, sf_dir))


@query(
    "calibration_bins",
    f"""SELECT CAST(least(9, floor(s * 10)) AS INTEGER) AS bin, count(*) AS count, round(avg(s), 4) AS mean_score, round(avg(o), 4) AS accuracy FROM (SELECT {GUESS} AS s, quality AS o FROM documents JOIN labels USING (doc_id)) GROUP BY 1""",
)
def calibration_bins(spark, sf_dir):
    out = evaluate.reliability_bins(guessed(spark, sf_dir))
    return out.select("bin", "count", rnd("mean_score").alias("mean_score"), rnd("accuracy").alias("accuracy"))


@query(
    "label_set_prf",
    f"""WITH p AS (SELECT doc_id, source FROM documents WHERE {GUESS} >= 0.5), g AS (SELECT doc_id, source FROM labels JOIN documents USING (doc_id) WHERE quality = 1), u AS (SELECT source, doc_id FROM p UNION SELECT source, doc_id FROM g),
k AS (SELECT u.source, count(*) FILTER (u.doc_id IN (SELECT doc_id FROM p) AND u.doc_id IN (SELECT doc_id FROM g)) AS tp, count(*) FILTER (u.doc_id IN (SELECT doc_id FROM p) AND u.doc_id NOT IN (SELECT doc_id FROM g)) AS fp,
  count(*) FILTER (u.doc_id NOT IN (SELECT doc_id FROM p)) AS fn FROM u GROUP BY 1)
SELECT source, tp, fp, fn, {PRF} FROM k""",
)
def label_set_prf(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    pred = docs.where(F.least(F.lit(1.0), F.col("n_chars") / 2000.0) >= 0.5).select("source", "doc_id")
    gold = load(spark, sf_dir, "labels").where("quality = 1").join(docs, "doc_id").select("source", "doc_id")
    return evaluate.prf(evaluate.confusion(evaluate.matches(pred, gold, ["doc_id"], ["source"]), ["source"]))


@query(
    "recall_and_mrr",
    f"""WITH s AS (SELECT source, doc_id AS item, {GUESS} AS c, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS hit FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, item) AS rn FROM s)
SELECT source, count(*) FILTER (hit) AS gold_items, round(count(*) FILTER (hit AND rn <= 5) / CAST(least(5, count(*) FILTER (hit)) AS DOUBLE), 4) AS recall_at_5, round(1.0 / min(rn) FILTER (hit), 4)::DOUBLE AS mrr FROM k GROUP BY 1 HAVING count(*) FILTER (hit) > 0""",
)
def recall_and_mrr(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    ranked = docs.select("source", F.col("doc_id").alias("item"), F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("confidence"))
    gold = load(spark, sf_dir, "labels").where("quality = 1").join(docs.select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("item"))
    return evaluate.ranking(ranked, gold, by=["source"])


@query(
    "retrieval_metrics",
    """WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, (q.label = i.label)::INTEGER AS rel, list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS s FROM embeddings q, embeddings i WHERE q.vec_id <> i.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rn FROM p), g AS (SELECT query_id, sum(rel) AS n FROM p GROUP BY 1),
t AS (SELECT query_id, sum(rel) AS hits, sum(rel / log2(rn + 1)) AS dcg, min(rn) FILTER (rel > 0) AS first FROM k WHERE rn <= 5 GROUP BY 1)
SELECT query_id, round(coalesce(hits / nullif(CAST(n AS DOUBLE), 0), 0), 4) AS recall_at_k, round(hits / 5.0, 4)::DOUBLE AS precision_at_k, round(coalesce(1.0 / first, 0), 4)::DOUBLE AS mrr,
  round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, 1 + CAST(least(5, n) AS BIGINT)), lambda i: 1 / log2(i + 1))) ELSE 0 END, 4) AS ndcg FROM g LEFT JOIN t USING (query_id)""",
)
def retrieval_metrics(spark, sf_dir):
    """Neighbours with the same label count as relevant."""
    from strataloom.operators import vectors

    e = load(spark, sf_dir, "embeddings")
    found = vectors.top_k(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "item_id"), 5, vector="embedding", skip_self=True)
    q, i = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("il"))
    ranked = found.join(q, "query_id").join(i, "item_id").select("query_id", "rank", (F.col("ql") == F.col("il")).cast("int").alias("relevance"))
    same = e.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    return evaluate.retrieval_metrics(ranked, e.select(F.col("vec_id").alias("query_id"), "label").join(same, "label").select("query_id", "relevant"), 5)


@query("entity_calibration", f"WITH {ES} SELECT source_id, round(abs(avg(confidence) - avg((confidence >= 0.75)::INTEGER)), 4) AS calibration_error, count(*) AS \"rows\" FROM es GROUP BY 1")
def entity_calibration(spark, sf_dir):
    return evaluate.calibration(entity_rows(spark, sf_dir), ["source_id"])


def gold_parts(spark, sf_dir):
    """Gold taken from the English documents, predictions from all."""
    lang = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    m, r = base.mentions(spark, sf_dir), base.relations(spark, sf_dir)
    gold_nodes = m.join(lang, "doc_id", "left_semi").select(F.col("text").alias("label"), "type").distinct()
    gold_edges = r.join(lang, "doc_id", "left_semi").select("source", "relation", "target").distinct().withColumn("expected_confidence_min", F.lit(0.6))
    pred_edges = relation_rows(spark, sf_dir).select("source", "relation", "target", "confidence", "context")
    return m.select(F.col("text").alias("label"), "type").distinct(), pred_edges, gold_nodes, gold_edges


GOLD = f"""{relations_sql()}, pn AS (SELECT DISTINCT lower(trim(text)) AS l, type AS t FROM m), gn AS (SELECT DISTINCT lower(trim(text)) AS l, type AS t FROM m WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
pt AS (SELECT DISTINCT l, CASE WHEN l IN (SELECT l FROM gn WHERE t = 'entity') THEN 'entity' ELSE t END AS t FROM pn),
pr AS (SELECT DISTINCT lower(trim(source)) AS s, relation AS r, lower(trim(target)) AS t FROM r), gr AS (SELECT DISTINCT lower(trim(source)) AS s, relation AS r, lower(trim(target)) AS t FROM r WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))"""


def _prf_of(p: str, g: str) -> str:
    return f"SELECT tp, fp, fn, {PRF} FROM (SELECT (SELECT count(*) FROM (FROM {p} INTERSECT FROM {g})) AS tp, (SELECT count(*) FROM (FROM {p} EXCEPT FROM {g})) AS fp, (SELECT count(*) FROM (FROM {g} EXCEPT FROM {p})) AS fn)"


@query("gold_entity_prf", f"WITH {GOLD} {_prf_of('pt', 'gn')}")
def gold_entity_prf(spark, sf_dir):
    nodes, _, gold_nodes, _ = gold_parts(spark, sf_dir)
    return evaluate.entities(nodes, gold_nodes)


@query("gold_relation_prf", f"WITH {GOLD} {_prf_of('pr', 'gr')}")
def gold_relation_prf(spark, sf_dir):
    _, edges, _, gold_edges = gold_parts(spark, sf_dir)
    return evaluate.relations(edges, gold_edges)


@query("kg_evaluation")
def kg_evaluation(spark, sf_dir):
    return evaluate.kg(*gold_parts(spark, sf_dir))


@query("gold_bootstrap")
def gold_bootstrap(spark, sf_dir):
    _, edges, _, gold_edges = gold_parts(spark, sf_dir)
    return evaluate.gold_bootstrap(edges, gold_edges, least=0.65)


@query("gold_upsert_delete", f"WITH {REL_SQL} SELECT DISTINCT text AS label, type FROM m WHERE type <> 'value'")
def gold_upsert_delete(spark, sf_dir):
    """Gold entities of English documents, renewed by those of all documents, amounts deleted."""
    nodes, _, gold_nodes, _ = gold_parts(spark, sf_dir)
    merged = evaluate.gold_upsert(gold_nodes, nodes, ["label", "type"])
    return evaluate.gold_delete(merged, nodes.where("type = 'value'"), ["label", "type"])


@query("trust_score")
def trust_score(spark, sf_dir):
    nodes, edges, gold_nodes, gold_edges = gold_parts(spark, sf_dir)
    drift = semantic_eda(spark, sf_dir).select("drift_count")
    calibrated = evaluate.calibration(entity_rows(spark, sf_dir)).select("calibration_error")
    return evaluate.trust(evaluate.entities(nodes, gold_nodes), evaluate.relations(edges, gold_edges), base.relations(spark, sf_dir), drift, calibrated)
