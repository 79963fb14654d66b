"""Wiki pages, dictionary, dashboards, insights and exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numeric import rnd
from strataloom.operators import correlation, dashboard, dictionary, extract, insights, link, profile, stats, wiki
from strataloom.plans import base, graphs, rules, scores
from strataloom.plans.graphs import GRAPH
from strataloom.plans.registry import ALL_TABLES, query
from strataloom.plans.rules import CLASS_SQL, LABEL_SQL
from strataloom.plans.tabular import _with_facts
from strataloom.session import load
from strataloom.sources import sinks

# --- wiki --------------------------------------------------------------------------------

ENDS = "x AS (SELECT source AS id, target AS other, 'out' AS direction, source, relation, target, confidence FROM e UNION ALL SELECT target, source, 'in', source, relation, target, confidence FROM e WHERE source <> target)"


@query(
    "wiki_facts",
    f"""WITH {GRAPH}, {ENDS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, source, relation, target) AS rn FROM x)
SELECT k.id AS canonical_id, CAST(rn AS INTEGER) AS fact_no, a.label || ' ' || k.relation || ' ' || b.label || '.' AS claim, k.relation, k.confidence FROM k JOIN n a ON a.id = k.source JOIN n b ON b.id = k.target WHERE rn <= 40""",
)
def wiki_facts(spark, sf_dir):
    return wiki.facts(*graphs.parts(spark, sf_dir))


@query(
    "wiki_related",
    f"""WITH {GRAPH}, {ENDS}, b AS (SELECT id, other, max((confidence, relation)) AS b FROM x WHERE id <> other GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b[1] DESC, other) AS rn FROM b)
SELECT id AS canonical_id, CAST(rn AS INTEGER) AS place, other, b[2] AS relation FROM k WHERE rn <= 30""",
)
def wiki_related(spark, sf_dir):
    return wiki.related(graphs.parts(spark, sf_dir)[1])


@query(
    "wiki_directional_facts",
    f"""WITH {GRAPH}, {ENDS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, direction, relation, other) AS rn FROM x)
SELECT k.id AS canonical_id, CAST(rn AS INTEGER) AS fact_no, a.label || CASE direction WHEN 'out' THEN ' -> [' || relation || '] -> ' ELSE ' <- [' || relation || '] <- ' END || b.label AS fact, k.confidence,
  CASE WHEN k.confidence >= 0.75 THEN 'high' WHEN k.confidence >= 0.45 THEN 'medium' ELSE 'low' END AS confidence_band FROM k JOIN n a ON a.id = k.id JOIN n b ON b.id = k.other WHERE rn <= 25""",
)
def wiki_directional_facts(spark, sf_dir):
    return wiki.directional_facts(*graphs.parts(spark, sf_dir))


@query("wiki_timeline")
def wiki_timeline(spark, sf_dir):
    return wiki.timeline(*graphs.parts(spark, sf_dir))


def page_rows(spark, sf_dir):
    def make():
        src = base.mentions(spark, sf_dir).select(F.lower("text").alias("canonical_id"), "source_id", "chunk_idx").distinct()
        return wiki.pages(*graphs.parts(spark, sf_dir), src)

    return base.kept(spark, sf_dir, "pages", make)


@query(
    "wiki_pages",
    f"""WITH {GRAPH}, {ENDS}, k AS (SELECT id, least(40, count(*)) AS f FROM x GROUP BY 1), wc AS (SELECT lower(text) AS id, least(100, count(DISTINCT (source, chunk_idx))) AS c FROM m GROUP BY 1)
SELECT n.id AS canonical_id, n.label AS title, n.entity_type, CAST(coalesce(f, 0) AS INTEGER) AS total_facts, CAST(CASE WHEN c > 0 THEN coalesce(f, 0) ELSE 0 END AS INTEGER) AS facts_with_citations, CAST(c AS INTEGER) AS sources, 1 AS version FROM n LEFT JOIN k USING (id) LEFT JOIN wc USING (id)""",
)
def wiki_pages(spark, sf_dir):
    return page_rows(spark, sf_dir).select("canonical_id", "title", "entity_type", "total_facts", "facts_with_citations", F.size("sources").alias("sources"), "version")


@query("wiki_page_list", f"WITH {GRAPH} SELECT id AS canonical_id, label AS title FROM n WHERE contains(lower(label), 'license') OR contains(entity_type, 'license') ORDER BY label, id LIMIT 100")
def wiki_page_list(spark, sf_dir):
    return wiki.list_pages(page_rows(spark, sf_dir), "license").select("canonical_id", "title")


@query(
    "citation_coverage",
    f"""WITH {GRAPH}, {ENDS}, k AS (SELECT id, least(40, count(*)) AS f FROM x GROUP BY 1) SELECT (SELECT count(*) FROM n) AS page_count, CAST(sum(f) AS BIGINT) AS facts_with_citations, CAST(sum(f) AS BIGINT) AS total_facts, 100.0::DOUBLE AS citation_coverage_pct FROM k""",
)
def citation_coverage(spark, sf_dir):
    return wiki.citation_coverage(page_rows(spark, sf_dir))


# --- dictionary ----------------------------------------------------------------------------

DICT_TABLES = tuple(rules.FLAG_TABLES)


def entry_sql(names) -> str:
    listed = ", ".join(f"'{t}'" for t in names)
    return f"""en AS (SELECT "table" AS key, 'table' AS entry_type, table_label AS label FROM ({CLASS_SQL}) WHERE "table" IN ({listed}) UNION ALL SELECT t || '.' || c, 'column', label FROM ({LABEL_SQL}) WHERE t IN ({listed}))"""


def entry_rows(spark, sf_dir, names):
    labels = rules.labelled(spark, sf_dir, names)
    prof = profile.tables(rules.frames(spark, sf_dir, names))
    return dictionary.entries(prof, labels, profile.classify_tables(labels))


def stored_entries(rows):
    """An earlier dictionary: column entries only, approved, identifiers once labelled otherwise."""
    old = rows.where("entry_type = 'column'")
    label = F.when(F.col("label") == "identifier", F.lit("quantity")).otherwise(F.col("label"))
    return old.select("key", "entry_type", label.alias("label"), F.lit("approved").alias("status"), F.lit(1).alias("version"))


def upserted_sql(names) -> str:
    return f"""{entry_sql(names)}, up AS (SELECT key, entry_type, label, CASE WHEN entry_type = 'table' THEN 'draft' WHEN label = 'identifier' THEN 'reviewed' ELSE 'approved' END AS status, CASE WHEN entry_type = 'table' THEN 1 ELSE 2 END AS version,
  CASE WHEN entry_type = 'table' THEN 'created' ELSE 'updated' END AS change FROM en)"""


def upserted(spark, sf_dir, names):
    rows = base.kept(spark, sf_dir, f"entries of {', '.join(names)}", lambda: entry_rows(spark, sf_dir, names))
    return dictionary.upsert(stored_entries(rows), rows)


def reviewed(spark, sf_dir, names):
    rows = upserted(spark, sf_dir, names)
    made = rows.select("key", F.when(F.col("label") == "unknown", "deprecate").otherwise("approve").alias("decision"), F.lit("steward").alias("decided_by"))
    return dictionary.review(rows, made)


def dictionary_queries(suffix: str, names) -> None:
    """Register the dictionary queries over the tables ``names``."""
    up = upserted_sql(names)

    @query(f"dictionary_upsert{suffix}", f"WITH {up} SELECT * FROM up")
    def dictionary_upsert(spark, sf_dir):
        return upserted(spark, sf_dir, names)

    @query(f"dictionary_upsert_counts{suffix}", f"WITH {up} SELECT entry_type, count(*) FILTER (change = 'created') AS created, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'kept') AS kept, count(*) AS total FROM up GROUP BY 1")
    def dictionary_upsert_counts(spark, sf_dir):
        return dictionary.upsert_counts(upserted(spark, sf_dir, names))

    @query(f"dictionary_search{suffix}", f"WITH {up} SELECT key, label, status FROM up WHERE status = 'reviewed' AND contains(lower(key || ' ' || label), 'id') ORDER BY key LIMIT 200")
    def dictionary_search(spark, sf_dir):
        return dictionary.search(upserted(spark, sf_dir, names), "id", "reviewed").select("key", "label", "status")

    @query(f"dictionary_review{suffix}", f"WITH {up} SELECT key, CASE WHEN label = 'unknown' THEN 'deprecated' ELSE 'approved' END AS status, version + 1 AS version FROM up")
    def dictionary_review(spark, sf_dir):
        return reviewed(spark, sf_dir, names)[0].select("key", "status", "version")

    @query(f"dictionary_history{suffix}", f"WITH {up} SELECT key, status AS before_status, CASE WHEN label = 'unknown' THEN 'deprecated' ELSE 'approved' END AS after_status, 'steward' AS decided_by FROM up")
    def dictionary_history(spark, sf_dir):
        h = reviewed(spark, sf_dir, names)[1]
        return h.select("key", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"), "decided_by")

    @query(
        f"dictionary_metrics{suffix}",
        f"""WITH {up} SELECT entry_type, count(*) AS entries, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'deprecated') AS deprecated,
  round(100.0 * count(*) FILTER (status = 'approved') / count(*), 2)::DOUBLE AS approved_pct FROM up GROUP BY 1""",
    )
    def dictionary_metrics(spark, sf_dir):
        return dictionary.metrics(upserted(spark, sf_dir, names))


dictionary_queries("", DICT_TABLES)
dictionary_queries("_all", ALL_TABLES)


# --- runs: one per relational table and one per document source -------------------------------

def table_runs(spark, sf_dir):
    """A profile run per table, scored by label confidence and missing cells."""
    tables = rules.frames(spark, sf_dir, ALL_TABLES)
    prof = profile.tables(tables)
    labels = rules.labelled(spark, sf_dir)
    timed = [t for t, df in tables.items() if any(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema.fields)]
    conf = labels.groupBy("table").agg(F.avg("confidence").alias("c"))
    runs = prof.groupBy("table").agg(F.max("rows").alias("total_records"), F.count("*").alias("total_columns"), rnd(100.0 * F.avg(F.col("nulls") / F.col("rows")), 2).alias("missing_pct"))
    return runs.join(conf, "table").select(
        F.col("table").alias("run_id"), rnd("c").alias("confidence_score"), rnd(F.col("c") * 0.9).alias("graph_trust_score"), rnd(F.col("c") * 0.8).alias("retrieval_readiness_score"), rnd(F.col("c") * 0.7).alias("overall_kg_quality_score"),
        "total_records", "total_columns", "missing_pct", F.lit(True).alias("supports_correlation"), F.col("table").isin(timed).alias("supports_time_series"),
        F.lit(True).alias("supports_kg_metrics"), F.lit(False).alias("supports_feature_importance"),
    )


def source_runs(spark, sf_dir):
    """A run per document source, scored by its entities."""
    ents, rels = scores.entity_rows(spark, sf_dir), base.relations(spark, sf_dir)
    e = ents.groupBy("source_id").agg(F.avg("confidence").alias("c"), F.count("*").alias("entities_extracted"))
    r = rels.groupBy("source_id").agg(F.count("*").alias("relationships_extracted"))
    docs = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("total_records"))
    out = docs.join(e, "source_id", "left").join(r, "source_id", "left").fillna(0, ["c", "entities_extracted", "relationships_extracted"])
    return out.select(
        F.col("source_id").alias("run_id"), rnd("c").alias("confidence_score"), rnd(F.col("c") * 0.8).alias("retrieval_readiness_score"), rnd(F.col("c") * 0.7).alias("overall_kg_quality_score"), "total_records",
        "entities_extracted", "relationships_extracted", F.lit(0.0).alias("missing_pct"), F.lit(False).alias("supports_correlation"), F.lit(False).alias("supports_time_series"), F.lit(True).alias("supports_kg_metrics"), F.lit(False).alias("supports_feature_importance"),
    )


@query("db_runs")
def db_runs(spark, sf_dir):
    return dashboard.db_runs(table_runs(spark, sf_dir))


@query("file_runs")
def file_runs(spark, sf_dir):
    return dashboard.file_runs(source_runs(spark, sf_dir))


@query("run_dashboard")
def run_dashboard(spark, sf_dir):
    return dashboard.combined(table_runs(spark, sf_dir), source_runs(spark, sf_dir))


@query("dashboard_warnings")
def dashboard_warnings(spark, sf_dir):
    return dashboard.warnings(dashboard.combined(source_runs(spark, sf_dir), source_runs(spark, sf_dir)))


@query("run_export")
def run_export(spark, sf_dir):
    return sinks.run_export(table_runs(spark, sf_dir).withColumnRenamed("overall_kg_quality_score", "quality_score"), source_runs(spark, sf_dir).withColumnRenamed("overall_kg_quality_score", "quality_score")).select(
        "source", "run_id", "status", "quality_score", "confidence_score", "trust_score", "total_records", "entities_extracted"
    )


@query("richest_run", "SELECT source AS run_id, count(*) AS documents FROM documents GROUP BY 1 ORDER BY sum(n_chars) DESC, source DESC LIMIT 1")
def richest_run(spark, sf_dir):
    runs = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg(F.sum("n_chars").alias("total_records"), F.count("*").alias("documents"))
    return insights.richest_run(runs).select("run_id", "documents")


@query(
    "best_run_per_section",
    "SELECT lang AS section, CAST(doc_id AS VARCHAR) AS run_id, n_chars >= 2000 AS usable, n_chars AS completed_at FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars >= 2000 DESC, n_chars DESC, CAST(doc_id AS VARCHAR)) = 1",
)
def best_run_per_section(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    rows = d.select(F.col("lang").alias("section"), F.col("doc_id").cast("string").alias("run_id"), (F.col("n_chars") >= 2000).alias("usable"), F.col("n_chars").alias("completed_at"))
    return dashboard.best_run(rows)


def status_rows(spark, sf_dir):
    """Documents as an ingest log: empty ones failed, copies share a checksum."""
    docs = load(spark, sf_dir, "documents")
    n_ents = base.mentions(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("entities"))
    n_rels = base.relations(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("relations"))
    n_chunks = base.chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    out = docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"), F.when(F.col("n_chars") < 50, "failed").otherwise("completed").alias("status"), (F.col("n_chars") > 200).alias("schema_valid"), F.col("doc_id").alias("uploaded_at"))
    for df in (n_chunks, n_ents, n_rels):
        out = out.join(df, "doc_id", "left")
    return out.fillna(0, ["chunks", "entities", "relations"]).withColumn("file_id", F.col("doc_id").cast("string"))


@query(
    "ingestion_report",
    f"""WITH {scores.REL_SQL}, sd AS (SELECT doc_id, n_chars >= 50 AS ok FROM documents)
SELECT (SELECT count(*) FROM sd) AS total_files, (SELECT count(*) FROM sd WHERE ok) AS completed, (SELECT count(*) FROM sd WHERE NOT ok) AS failed, CAST(0 AS BIGINT) AS processing, (SELECT count(*) FROM c JOIN sd USING (doc_id) WHERE ok) AS total_chunks,
  (SELECT count(*) FROM m JOIN sd USING (doc_id) WHERE ok) AS total_entities, (SELECT count(*) FROM r JOIN sd USING (doc_id) WHERE ok) AS total_relations, (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicates_detected""",
)
def ingestion_report(spark, sf_dir):
    return dashboard.ingestion_report(status_rows(spark, sf_dir))


@query("status_list", "SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN n_chars < 50 THEN 'failed' ELSE 'completed' END AS status FROM documents ORDER BY doc_id DESC LIMIT 500")
def status_list(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("file_id"), F.when(F.col("n_chars") < 50, "failed").otherwise("completed").alias("status"), F.col("doc_id").alias("uploaded_at"))
    return dashboard.status_list(rows).select("file_id", "status")


@query("quality_metrics")
def quality_metrics(spark, sf_dir):
    return dashboard.quality_metrics(status_rows(spark, sf_dir), page_rows(spark, sf_dir), rules.profile_accuracy(spark, sf_dir))


@query(
    "source_aggregates",
    f"""WITH {scores.ES}, sa AS (SELECT source AS source_id, count(*) AS chunks FROM c GROUP BY 1), sb AS (SELECT source_id, count(*) AS entities, round(avg(confidence), 6) AS mean_confidence FROM es GROUP BY 1), g AS (SELECT src AS source_id, count(*) AS relations FROM r GROUP BY 1)
SELECT source_id, chunks, coalesce(entities, 0) AS entities, mean_confidence, coalesce(relations, 0) AS relations FROM sa LEFT JOIN sb USING (source_id) LEFT JOIN g USING (source_id)""",
)
def source_aggregates(spark, sf_dir):
    out = dashboard.by_source(scores.entity_rows(spark, sf_dir), base.relations(spark, sf_dir), base.chunks(spark, sf_dir))
    return out.drop("words").withColumn("mean_confidence", rnd("mean_confidence", 6))


@query("metrics_by_stage")
def metrics_by_stage(spark, sf_dir):
    """Scores of both run tables as metric records, grouped by stage."""
    records = None
    for stage, df in (("profile", table_runs(spark, sf_dir)), ("extraction", source_runs(spark, sf_dir))):
        long = df.unpivot(["run_id"], ["confidence_score", "retrieval_readiness_score", "overall_kg_quality_score"], "metric", "value")
        one = long.withColumn("stage", F.lit(stage)).withColumn("family", F.lit("scores"))
        records = one if records is None else records.unionByName(one)
    return sinks.metrics_by_stage(records).select("stage", "family", "metric", "records", rnd("mean").alias("mean"), "low", "high")


# --- insights ---------------------------------------------------------------------------------

EVENT_OUT = f"""{_with_facts('events', ['value', 'user_id'])}, oc AS (SELECT f.col AS "column", count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (abs((v - mean) / std) >= 3) AS zscore_outliers FROM cells JOIN facts f USING (col) GROUP BY 1),
ot AS (SELECT *, iqr_outliers + zscore_outliers AS total FROM oc)"""


def event_outliers(spark, sf_dir):
    return stats.outliers(load(spark, sf_dir, "events"), ["value", "user_id"])


@query(
    "outlier_burden",
    f"""{EVENT_OUT} SELECT "column", iqr_outliers, zscore_outliers, total, CASE WHEN sum(total) OVER () > 0 THEN round(100.0 * total / sum(total) OVER (), 2)::DOUBLE ELSE 0.0::DOUBLE END AS share_pct, abs(iqr_outliers - zscore_outliers) AS imbalance,
  CASE WHEN iqr_outliers >= zscore_outliers THEN 'IQR' ELSE 'Z-score' END AS dominant_method FROM ot ORDER BY total DESC, "column" LIMIT 12""",
)
def outlier_burden(spark, sf_dir):
    return insights.outlier_burden(event_outliers(spark, sf_dir))


@query("outlier_burden_shares", f"""{EVENT_OUT} SELECT "column" AS name, total AS value FROM ot""")
def outlier_burden_shares(spark, sf_dir):
    return insights.burden_shares(insights.outlier_burden(event_outliers(spark, sf_dir)))


@query("outlier_severity", f"""{EVENT_OUT} SELECT "column", total, CASE WHEN total / CAST(greatest(1, max(total) OVER ()) AS DOUBLE) >= 0.66 THEN 'High' WHEN total / CAST(greatest(1, max(total) OVER ()) AS DOUBLE) >= 0.33 THEN 'Medium' ELSE 'Low' END AS severity FROM ot""")
def outlier_severity(spark, sf_dir):
    return insights.severity(event_outliers(spark, sf_dir))


SHAPES = f"""{_with_facts('events', ['value', 'user_id'])}, mo AS (SELECT f.col, avg(((v - mean) / std) ** 3) AS sk, avg(((v - mean) / std) ** 4) - 3 AS ku FROM cells JOIN facts f USING (col) GROUP BY 1),
sh AS (SELECT f.*, sk, ku, round(greatest(0, least(1, (abs(sk) / 2 + abs(ku) / 6) / 2)), 4) AS shape_risk FROM facts f JOIN mo USING (col))"""


@query(
    "shape_metrics",
    f"""{SHAPES} SELECT col AS "column", round(std / abs(mean), 4) AS cv, round(median - p10, 4) AS left_tail, round(p90 - median, 4) AS right_tail, round(mean - median, 4) AS center_delta, round(hi - lo, 4) AS range, round((hi - lo) / (q3 - q1), 4) AS range_to_iqr,
  round(p90 - p10, 4) AS tail_spread, shape_risk, CASE WHEN shape_risk >= 0.6 THEN 'high' WHEN shape_risk >= 0.35 THEN 'medium' ELSE 'low' END AS shape_band FROM sh""",
)
def shape_metrics(spark, sf_dir):
    return insights.shape_metrics(stats.describe(load(spark, sf_dir, "events"), ["value", "user_id"]))


@query("shape_buckets", f"{SHAPES} SELECT count(*) FILTER (shape_risk >= 0.6) AS high, count(*) FILTER (shape_risk >= 0.35 AND shape_risk < 0.6) AS medium, count(*) FILTER (shape_risk < 0.35) AS low FROM sh")
def shape_buckets(spark, sf_dir):
    return insights.shape_buckets(shape_metrics(spark, sf_dir))


@query(
    "distribution_notes",
    f"""{SHAPES}, oc AS (SELECT f.col, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) + count(*) FILTER (abs((v - mean) / std) >= 3) AS o FROM cells JOIN facts f USING (col) GROUP BY 1),
nt AS (SELECT col, 'skewed' AS title, 'high' AS severity, 0.89 AS confidence FROM sh WHERE abs(sk) >= 1 UNION ALL SELECT col, 'heavy tails or outliers', 'medium', 0.82 FROM sh JOIN oc USING (col) WHERE ku >= 1.5 OR o > 0
UNION ALL SELECT col, 'hardly varies', 'low', 0.80 FROM sh WHERE std / greatest(abs(mean), 0.0001) < 0.08 UNION ALL SELECT col, 'wide tails', 'medium', 0.77 FROM sh WHERE p90 - p10 > greatest(0.0001, q3 - q1) * 1.8)
SELECT col AS "column", title, severity, confidence::DOUBLE AS confidence FROM nt UNION ALL SELECT col, 'nothing stands out', 'low', 0.76::DOUBLE FROM sh WHERE col NOT IN (SELECT col FROM nt)""",
)
def distribution_notes(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    gap = correlation.pair_gap(correlation.pairs(df, ["value", "user_id"]))
    return insights.distribution_notes(stats.describe(df, ["value", "user_id"]), event_outliers(spark, sf_dir), gap)


@query("schema_entities")
def schema_entities(spark, sf_dir):
    return extract.schema_entities(*rules.canonical_schema(spark, sf_dir))[1]


@query("folder_summary")
def folder_summary(spark, sf_dir):
    """Documents, clusters and overlapping pairs of the sources."""
    from strataloom.operators.profile import side_by_side
    from strataloom.plans import knowledge

    rows = knowledge.per_file(spark, sf_dir)
    c = link.clusters(rows)
    return side_by_side(
        c.agg(F.count("*").alias("document_count"), F.count_distinct("cluster").alias("cluster_count")), link.document_overlap(rows).agg(F.count("*").alias("overlap_pairs"))
    )

