"""Semantic labels, keys, validation rules, health and join discovery over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators import joins, profile, stats, timeseries, validate
from strataloom.plans import base
from strataloom.plans.registry import ALL_TABLES, COLUMNS, RELATIONAL, query, union_sql
from strataloom.plans.tabular import _profile_sql, _with_facts, text_cell
from strataloom.session import load
from strataloom.sources import catalog

KEY_NAMES = {
    "c_custkey": "customer_id", "o_custkey": "customer_id", "o_orderkey": "order_id", "l_orderkey": "order_id",
    "p_partkey": "part_id", "l_partkey": "part_id", "s_suppkey": "supplier_id", "l_suppkey": "supplier_id",
    "n_nationkey": "nation_id", "c_nationkey": "nation_id", "s_nationkey": "nation_id",
    "r_regionkey": "region_id", "n_regionkey": "region_id",
}
LINKS = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]


def frames(spark, sf_dir, names=RELATIONAL):
    return {t: load(spark, sf_dir, t) for t in names}


def profiled(spark, sf_dir, names):
    """``profile.tables`` of the named tables; the row of each column is kept for the session."""
    return base.settled(spark, sf_dir, "profile", names, lambda t: profile.columns(load(spark, sf_dir, t), t))


def _names_sql(pattern_case: str) -> str:
    tables = ", ".join(f"'{t}'" for t in (*RELATIONAL, "events"))
    return f"SELECT table_name AS t, column_name AS c, {pattern_case} FROM information_schema.columns WHERE table_name IN ({tables})"


LABEL_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(column_name), '{p}') THEN '{v}'" for p, v in profile.NAME_PATTERNS) + " ELSE 'unknown' END AS label"
LABEL_SQL = _names_sql(LABEL_CASE)


def labelled(spark, sf_dir, names=(*RELATIONAL, "events")):
    return profile.label_columns(catalog.columns(spark, frames(spark, sf_dir, names)))


@query(
    "semantic_labels",
    f"""SELECT t AS "table", c AS "column", label, CASE WHEN label = 'unknown' THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.72 AS DOUBLE) END AS confidence FROM ({LABEL_SQL})""",
)
def semantic_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("table", "column", "label", "confidence")


@query("semantic_label_distribution", f"SELECT label, count(*) AS count FROM ({LABEL_SQL}) GROUP BY label")
def semantic_label_distribution(spark, sf_dir):
    return validate.label_distribution(labelled(spark, sf_dir))


@query(
    "datetime_coverage",
    f"""SELECT count(*) FILTER (label = 'datetime' OR regexp_matches(lower(c), 'date|time|timestamp')) AS datetime_columns, count(*) AS columns,
  round(100.0 * count(*) FILTER (label = 'datetime' OR regexp_matches(lower(c), 'date|time|timestamp')) / count(*), 2) AS timestamp_coverage_pct FROM ({LABEL_SQL})""",
)
def datetime_coverage(spark, sf_dir):
    return timeseries.coverage(labelled(spark, sf_dir))


def _typed_sql(table: str) -> str:
    def shape(c):
        tests = " ".join(f"WHEN bool_and(regexp_matches({text_cell(c)}, '{p}')) THEN '{n}'" for n, p in profile.VALUE_SHAPES)
        return f"SELECT '{table}' AS t, '{c}' AS c, CASE WHEN count({text_cell(c)}) = 0 THEN 'unknown' {tests} ELSE 'text' END AS datatype FROM {table}"

    return union_sql(shape(c) for c in COLUMNS[table])


def _hint_sql(typed: str) -> str:
    hints = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profile.TOKEN_HINTS.items())
    keys = ", ".join(f"'{k}'" for k in profile.TOKEN_HINTS)
    first = f"list_filter(string_split(trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w IN ({keys}))[1]"
    return f"""SELECT t, c, datatype, coalesce(CASE {first} {hints} END, CASE datatype WHEN 'email' THEN 'email' WHEN 'date' THEN 'temporal' WHEN 'numeric' THEN 'quantity' ELSE 'free_text' END) AS label,
  CAST(CASE WHEN {first} IS NOT NULL THEN 0.78 WHEN datatype = 'email' THEN 0.82 WHEN datatype = 'date' THEN 0.80 WHEN datatype = 'numeric' THEN 0.55 ELSE 0.40 END AS DOUBLE) AS confidence FROM ({typed})"""


TYPED = ("customer", "orders", "events")


def datatypes_sql(names) -> str:
    return f"""SELECT t AS "table", c AS "column", datatype FROM ({union_sql(_typed_sql(t) for t in names)})"""


def datatypes(spark, sf_dir, names):
    out = None
    for t in names:
        one = profile.infer_types(profile.value_counts(load(spark, sf_dir, t))).select(F.lit(t).alias("table"), "column", "datatype")
        out = one if out is None else out.unionByName(one)
    return out


@query("datatype_inference", datatypes_sql(TYPED))
def datatype_inference(spark, sf_dir):
    return datatypes(spark, sf_dir, TYPED)


@query(
    "column_metadata",
    f"""SELECT p."table", p."column", datatype, label, confidence, null_pct, cardinality,
  CASE WHEN confidence >= 0.6 THEN 'auto_accept' ELSE 'review_required' END AS action,
  CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS band
FROM ({union_sql(_profile_sql('events', c) for c in COLUMNS['events'])}) p JOIN ({_hint_sql(_typed_sql('events'))}) h ON p."column" = h.c""",
)
def column_metadata(spark, sf_dir):
    meta = profile.metadata(load(spark, sf_dir, "events"), "events")
    return meta.withColumn("band", F.col("audit.confidence.band")).drop("audit")


ALL_PROFILE_SQL = union_sql(_profile_sql(t, c) for t in RELATIONAL for c in COLUMNS[t])
KEYS_SQL = f"""SELECT "table", "column", kind, uniqueness, score FROM (SELECT *, row_number() OVER (PARTITION BY "table", kind ORDER BY score DESC, "column") AS rn FROM (
  SELECT "table", "column", kind, round(u, 3) AS uniqueness, round(CASE WHEN kind = 'FK' THEN 0.6 WHEN regexp_matches(lower("column"), '(^id$|_id$|key|code)') THEN 0.9 ELSE 0.6 END, 3) AS score FROM (
    SELECT *, CASE WHEN u >= 0.98 AND filled >= greatest(1, floor(0.95 * "rows")) THEN 'PK'
      WHEN regexp_matches(lower("column"), '(_id$|_ref$|_key$|_code$|key$)') AND u < 0.9 THEN 'FK' END AS kind
    FROM (SELECT *, cardinality / CAST(filled AS DOUBLE) AS u FROM ({ALL_PROFILE_SQL}) WHERE filled > 0)) WHERE kind IS NOT NULL)) WHERE kind = 'FK' OR rn = 1"""


@query("key_prediction", f"SELECT \"table\", \"column\", kind, CAST(uniqueness AS DOUBLE) AS uniqueness, CAST(score AS DOUBLE) AS score FROM ({KEYS_SQL})")
def key_prediction(spark, sf_dir):
    return profile.predict_keys(profile.tables(frames(spark, sf_dir)))


CLASS_SQL = f"""SELECT t AS "table", CASE WHEN regexp_matches(t, '_dim$|^dim_') THEN 'reference_dimension' WHEN regexp_matches(t, '_fact$|^fact_') THEN 'transaction_fact'
  WHEN regexp_matches(t, 'audit|history') THEN 'audit_history' WHEN regexp_matches(t, 'config|setting') THEN 'configuration'
  WHEN count(*) FILTER (label = 'identifier') >= 2 AND count(*) FILTER (label IN ('monetary_value', 'datetime')) > 0 THEN 'transaction_fact' ELSE 'unknown' END AS table_label FROM ({LABEL_SQL}) GROUP BY t"""


@query("table_classes", CLASS_SQL)
def table_classes(spark, sf_dir):
    return profile.classify_tables(labelled(spark, sf_dir)).select("table", "table_label")


def content_classes_sql(names) -> str:
    return f"""SELECT t AS "table", CASE WHEN count(*) FILTER (label = 'monetary') >= 1 AND count(*) FILTER (label = 'temporal') >= 1 THEN 'transactional'
  WHEN count(*) FILTER (label = 'identifier') >= 2 THEN 'reference/dimension' WHEN count(*) FILTER (label = 'person_or_org_name') >= 1 THEN 'entity_master' ELSE 'generic' END AS table_label,
  CAST(CASE WHEN count(*) FILTER (label = 'monetary') >= 1 AND count(*) FILTER (label = 'temporal') >= 1 THEN 0.7
  WHEN count(*) FILTER (label = 'identifier') >= 2 THEN 0.65 WHEN count(*) FILTER (label = 'person_or_org_name') >= 1 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS table_confidence
FROM ({_hint_sql(union_sql(_typed_sql(t) for t in names))}) GROUP BY t"""


def content_classes(spark, sf_dir, names):
    out = None
    for t in names:
        typed = profile.infer_types(profile.value_counts(load(spark, sf_dir, t)))
        one = profile.label_by_tokens(typed).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return profile.classify_by_content(out)


@query("table_classes_by_content", content_classes_sql(TYPED))
def table_classes_by_content(spark, sf_dir):
    return content_classes(spark, sf_dir, TYPED)


FLAG_TABLES = {"events": ["event_id", "user_id", "value"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"]}


def flags_sql(scope) -> str:
    return union_sql(
        f"""SELECT p."table", p."column", concat_ws(',', CASE WHEN p.nulls / CAST(p."rows" AS DOUBLE) >= 0.5 THEN 'high_null_rate' END,
  CASE WHEN p.filled >= 5 AND p.cardinality / CAST(p.filled AS DOUBLE) <= 0.2 THEN 'low_sample_uniqueness' END, CASE WHEN coalesce(z.n, 0) > 0 THEN 'numeric_outliers' END) AS flags
FROM ({union_sql(_profile_sql(t, c) for c in COLUMNS[t])}) p LEFT JOIN ({_with_facts(t, cols)}
  SELECT col, count(*) FILTER (abs((v - mean) / std) >= 3) AS n FROM cells JOIN facts USING (col) GROUP BY col) z ON z.col = p."column\""""
        for t, cols in scope.items()
    )


FLAGS_SQL = flags_sql(FLAG_TABLES)


def flagged(spark, sf_dir, names=tuple(FLAG_TABLES)):
    profiled(spark, sf_dir, names)
    return base.settled(spark, sf_dir, "flags", names, lambda t: profile.anomalies(profiled(spark, sf_dir, (t,)), stats.z_outliers(load(spark, sf_dir, t))))


@query("anomaly_flags", FLAGS_SQL)
def anomaly_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("table", "column", "flags")


def rollup_sql(scope) -> str:
    return f"""SELECT "table", count(*) AS column_count, count(*) FILTER (flags <> '') AS high_risk_column_count,
  round(count(*) FILTER (flags <> '') / CAST(count(*) AS DOUBLE), 4) AS high_risk_ratio FROM ({flags_sql(scope)}) GROUP BY "table\""""


def risky_sql(scope) -> str:
    return f"SELECT * FROM ({rollup_sql(scope)}) ORDER BY high_risk_ratio DESC, high_risk_column_count DESC, \"table\" LIMIT 10"


ROLLUP_SQL = rollup_sql(FLAG_TABLES)


@query("table_rollup", ROLLUP_SQL)
def table_rollup(spark, sf_dir):
    return profile.rollup(flagged(spark, sf_dir))


@query("ranked_risky_tables", risky_sql(FLAG_TABLES))
def ranked_risky_tables(spark, sf_dir):
    return joins.rank_tables(profile.rollup(flagged(spark, sf_dir)))


# --- validation ----------------------------------------------------------------------

CHECKED = ("events", "orders", "customer")


def findings(spark, sf_dir, names=CHECKED):
    labels, numeric = labelled(spark, sf_dir, names), F.col("label").isin(*validate.NUMERIC_LABELS)
    # One row per column: which values a rule looks at.
    looks = profiled(spark, sf_dir, names).join(F.broadcast(labels), ["table", "column"]).select("table", "column", validate.is_dated().alias("dated"), numeric.alias("numeric"), (F.col("cardinality") <= 10).alias("small"))
    asked = looks.collect()
    return base.settled(spark, sf_dir, "findings", names, lambda t: _checked(spark, sf_dir, t, [r for r in asked if r["table"] == t], labels))


def _checked(spark, sf_dir, t, asked, labels):
    df, prof = load(spark, sf_dir, t), profiled(spark, sf_dir, (t,))
    # The text of a number is a number: such a column needs its count only.
    sure = [r["column"] for r in asked if r["numeric"] and not r["dated"] and isinstance(df.schema[r["column"]].dataType, T.NumericType)]
    parsed = prof.where(F.col("column").isin(sure)).select("column", F.lit("0").alias("value"), F.col("filled").alias("copies"))
    counts = profile.counts_by_column(df, [r["column"] for r in asked if (r["dated"] or r["numeric"]) and r["column"] not in sure]).unionByName(parsed)
    return validate.run(counts, prof, labels, profile.counts_by_column(df, [r["column"] for r in asked if r["small"]]))


def _findings_sql(t: str) -> str:
    def one(c):
        v = text_cell(c)
        return f"""SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count({v}) AS filled, count(DISTINCT {v}) AS card, count(TRY_CAST({v} AS DOUBLE)) AS parsed,
  count({v}) - count(TRY_CAST({v} AS TIMESTAMP)) AS bad_dates, (SELECT count(*) FILTER (k = 1) FROM (SELECT count(*) AS k FROM {t} WHERE {v} IS NOT NULL GROUP BY lower({v}))) AS rare FROM {t}"""

    base = f"SELECT f.*, l.label FROM ({union_sql(one(c) for c in COLUMNS[t])}) f JOIN ({LABEL_SQL}) l USING (t, c)"
    return f"""WITH b AS ({base})
SELECT t AS "table", c AS "column", 'invalid_dates' AS "check", bad_dates AS count, CASE WHEN bad_dates <= 3 THEN 'medium' ELSE 'high' END AS severity
  FROM b WHERE bad_dates > 0 AND (label = 'datetime' OR regexp_matches(c, 'date|time|timestamp'))
UNION ALL SELECT t, c, 'null_key_violations', n - filled, CASE WHEN (n - filled) / n >= 0.1 THEN 'high' ELSE 'medium' END FROM b WHERE label IN ('identifier', 'unknown') AND filled < n
UNION ALL SELECT t, c, 'enum_violations', rare, 'medium' FROM b WHERE filled >= 8 AND card <= 10 AND rare >= 2
UNION ALL SELECT t, c, 'type_mismatches', filled - parsed, 'medium' FROM b WHERE filled >= 6 AND label IN ('quantity', 'score', 'age', 'monetary_value') AND parsed / filled < 0.8"""


def checks_sql(names) -> str:
    return union_sql(f"SELECT * FROM ({_findings_sql(t)})" for t in names)


@query("validation_checks", checks_sql(CHECKED))
def validation_checks(spark, sf_dir):
    return findings(spark, sf_dir)


@query(
    "validation_cell_checks",
    f"""WITH b AS ({union_sql(f"SELECT h.c, h.label, h.datatype, (SELECT count({text_cell(c)}) - count(TRY_CAST({text_cell(c)} AS TIMESTAMP)) FROM events) AS bad_dates, (SELECT count({text_cell(c)}) - count(TRY_CAST({text_cell(c)} AS DOUBLE)) FROM events) AS bad_numbers, (SELECT count(*) - count({text_cell(c)}) FROM events) AS nulls FROM ({_hint_sql(_typed_sql('events'))}) h WHERE h.c = '{c}'" for c in COLUMNS['events'])})
SELECT CAST(sum(CASE WHEN label = 'temporal' OR datatype = 'date' THEN bad_dates ELSE 0 END) AS BIGINT) AS invalid_dates,
  CAST(sum(CASE WHEN datatype = 'numeric' THEN bad_numbers ELSE 0 END) AS BIGINT) AS type_mismatches,
  CAST(sum(CASE WHEN label = 'identifier' AND contains(c, 'id') THEN nulls ELSE 0 END) AS BIGINT) AS null_key_violations FROM b""",
)
def validation_cell_checks(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    counts = profile.value_counts(df)
    typed = profile.label_by_tokens(profile.infer_types(counts))
    return validate.cell_checks(counts, profile.columns(df, "events", counts=counts), typed)


@query(
    "duplicate_rows",
    union_sql(
        f"SELECT '{t}' AS \"table\", CAST(sum(k - 1) AS BIGINT) AS duplicates, CAST(sum(k) AS BIGINT) AS \"rows\" FROM (SELECT count(*) AS k FROM {t} GROUP BY {', '.join(cs)})"
        for t, cs in (("events", ["user_id", "event_type"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", COLUMNS["orders"]))
    ),
)
def duplicate_rows(spark, sf_dir):
    out = None
    for t, cs in (("events", ["user_id", "event_type"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", COLUMNS["orders"])):
        one = validate.duplicate_rows(load(spark, sf_dir, t), cs).select(F.lit(t).alias("table"), "duplicates", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def implied(spark, sf_dir):
    cat = joins.with_key_names(catalog.columns(spark, frames(spark, sf_dir)), KEY_NAMES)
    return joins.implicit(cat)


def _overlap_sql() -> str:
    def one(st, sc, tt, tc):
        return f"""SELECT '{st}' AS source_table, '{sc}' AS source_col, '{tt}' AS target_table, '{tc}' AS target_col, '{st}.{sc}->{tt}.{tc}' AS evidence_key,
  (SELECT count(DISTINCT {sc}) FROM {st}) AS left_count, (SELECT count(DISTINCT {tc}) FROM {tt}) AS right_count,
  (SELECT count(DISTINCT {sc}) FROM {st} WHERE {sc} IN (SELECT {tc} FROM {tt})) AS overlap_count"""

    share = "round(overlap_count / CAST(least(left_count, right_count) AS DOUBLE), 4)"
    return f"""SELECT *, {share} AS overlap_pct, CASE WHEN {share} >= 0.7 THEN 'strong' WHEN {share} >= 0.35 THEN 'medium' ELSE 'weak' END AS signal FROM ({union_sql(one(*link) for link in LINKS)})"""


IMPLIED_SQL = union_sql(
    f"SELECT '{a}' AS source_table, '{b}' AS source_col, '{c}' AS target_table, '{d}' AS target_col, CAST(0.75 AS DOUBLE) AS confidence, 'naming_rule:_id' AS basis" for a, b, c, d in LINKS
)


@query("implicit_fk", IMPLIED_SQL)
def implicit_fk(spark, sf_dir):
    return implied(spark, sf_dir)


def evidence(spark, sf_dir):
    return joins.joinability(frames(spark, sf_dir), implied(spark, sf_dir))


@query("joinability", _overlap_sql())
def joinability(spark, sf_dir):
    return evidence(spark, sf_dir)


@query("joinability_distribution", f"SELECT signal, count(*) AS count FROM ({_overlap_sql()}) GROUP BY signal")
def joinability_distribution(spark, sf_dir):
    return joins.signal_counts(evidence(spark, sf_dir))


@query("ranked_evidence", f"SELECT evidence_key, overlap_pct, overlap_count FROM ({_overlap_sql()}) ORDER BY overlap_pct DESC, evidence_key LIMIT 12")
def ranked_evidence(spark, sf_dir):
    return joins.rank_evidence(evidence(spark, sf_dir)).select("evidence_key", "overlap_pct", "overlap_count")


@query("weak_evidence_keys", f"SELECT evidence_key, overlap_pct FROM ({_overlap_sql()}) WHERE overlap_pct < 0.2 ORDER BY evidence_key LIMIT 25")
def weak_evidence_keys(spark, sf_dir):
    return joins.weak_evidence(evidence(spark, sf_dir))


_TABLES = ", ".join(f"'{t}'" for t in RELATIONAL)
EDGES_SQL = f"""SELECT 'table:' || table_name AS source, 'column:' || table_name || '.' || column_name AS target, 'has_column' AS relation, 'EXTRACTED' AS edge_type
  FROM information_schema.columns WHERE table_name IN ({_TABLES})
UNION ALL SELECT 'table:' || source_table, 'table:' || target_table, 'implicit_' || source_col, 'INFERRED' FROM ({IMPLIED_SQL})"""


@query("schema_graph_edges", EDGES_SQL)
def schema_graph_edges(spark, sf_dir):
    return joins.schema_graph(catalog.columns(spark, frames(spark, sf_dir)), implied(spark, sf_dir))[1]


@query(
    "schema_graph_nodes",
    f"""SELECT 'column:' || table_name || '.' || column_name AS id, table_name || '.' || column_name AS label, 'column' AS type FROM information_schema.columns WHERE table_name IN ({_TABLES})
UNION SELECT 'table:' || table_name, table_name, 'table' FROM information_schema.columns WHERE table_name IN ({_TABLES})""",
)
def schema_graph_nodes(spark, sf_dir):
    return joins.schema_graph(catalog.columns(spark, frames(spark, sf_dir)), implied(spark, sf_dir))[0]


def canonical_schema(spark, sf_dir):
    nodes, edges = joins.schema_graph(catalog.columns(spark, frames(spark, sf_dir)), implied(spark, sf_dir))
    return joins.to_canonical(nodes, edges, "warehouse", evidence=evidence(spark, sf_dir))


@query(
    "schema_canonical_edges",
    f"""WITH ev AS ({_overlap_sql()}), e AS ({EDGES_SQL}), n AS (SELECT *, regexp_replace(source, '^[a-z]+:', '') AS sl, regexp_replace(target, '^[a-z]+:', '') AS tl FROM e),
cand AS (SELECT n.source, n.target, n.relation, ev.evidence_key,
  CASE WHEN n.tl IN (source_table, target_table, source_table || '.' || source_col, target_table || '.' || target_col) THEN least(0.08, 0.08 * overlap_pct) ELSE least(0.05, 0.05 * overlap_pct) END AS gain
  FROM n JOIN ev ON n.sl IN (source_table, target_table)),
g AS (SELECT source, target, relation, arg_min(gain, evidence_key) AS bonus FROM cand GROUP BY ALL)
SELECT 'ce_' || substr(sha1(split_part(source, ':', 1) || ':' || sl), 1, 16) AS source_canonical_id, 'ce_' || substr(sha1(split_part(target, ':', 1) || ':' || tl), 1, 16) AS target_canonical_id,
  relation, round(CAST(least(0.99, CASE edge_type WHEN 'EXTRACTED' THEN 1.0 ELSE 0.7 END + coalesce(bonus, 0)) AS DOUBLE), 4) AS confidence, edge_type, 'warehouse' AS source_id
FROM n LEFT JOIN g USING (source, target, relation)""",
)
def schema_canonical_edges(spark, sf_dir):
    return canonical_schema(spark, sf_dir)[1]


@query(
    "schema_canonical_nodes",
    f"""SELECT 'ce_' || substr(sha1(type || ':' || label), 1, 16) AS canonical_id, label, type AS entity_type, CAST(0.8 AS DOUBLE) AS confidence FROM (
SELECT table_name || '.' || column_name AS label, 'column' AS type FROM information_schema.columns WHERE table_name IN ({_TABLES})
UNION SELECT table_name, 'table' FROM information_schema.columns WHERE table_name IN ({_TABLES}))""",
)
def schema_canonical_nodes(spark, sf_dir):
    return canonical_schema(spark, sf_dir)[0].select("canonical_id", "label", "entity_type", "confidence")


# --- report, quality and health --------------------------------------------------------

def report_sql(names) -> str:
    return f"""WITH f AS ({checks_sql(names)})
SELECT {', '.join(f"CAST(coalesce(sum(count) FILTER (\"check\" = '{c}'), 0) AS BIGINT) AS {c}" for c in validate.CHECKS)}, count(*) AS findings,
  (SELECT count(*) FROM ({_overlap_sql()}) WHERE signal = 'weak') AS orphan_relationships,
  (SELECT count(*) FROM ({CLASS_SQL}) WHERE table_label = 'unknown') AS schema_drift,
  (SELECT count(*) FROM ({_overlap_sql()}) WHERE signal = 'weak') AS foreign_key_issues FROM f"""


def reported(spark, sf_dir, names=CHECKED):
    return validate.report(findings(spark, sf_dir, names), evidence(spark, sf_dir), profile.classify_tables(labelled(spark, sf_dir)))


@query("consistency_report", report_sql(CHECKED))
def consistency_report(spark, sf_dir):
    return reported(spark, sf_dir)


HEALTHY = tuple(FLAG_TABLES)


def quality_parts(spark, sf_dir, names=HEALTHY):
    prof = profiled(spark, sf_dir, names)
    return validate.quality(prof, findings(spark, sf_dir, names), flagged(spark, sf_dir, names), labelled(spark, sf_dir, names))


def quality_sql(scope) -> str:
    listed = ", ".join(f"'{t}'" for t in scope)
    return f"""WITH p AS ({union_sql(_profile_sql(t, c) for t in scope for c in COLUMNS[t])}), f AS ({checks_sql(scope)}),
q AS (SELECT 1 - avg(nulls / CAST("rows" AS DOUBLE)) AS completeness, 1 - (SELECT count(*) FROM f) / CAST(count(*) AS DOUBLE) AS consistency,
  1 - sum(duplicate_proxy) / CAST(sum(filled) AS DOUBLE) AS uniqueness,
  1 - coalesce((SELECT sum(count) FROM f WHERE "check" = 'invalid_dates'), 0) / greatest(1, (SELECT count(*) FROM ({LABEL_SQL}) WHERE t IN ({listed}) AND (label = 'datetime' OR regexp_matches(c, 'date|time|timestamp')))) AS validity,
  (SELECT count(*) FROM ({flags_sql(scope)}) WHERE flags <> '') / CAST(count(*) AS DOUBLE) AS anomaly_ratio FROM p)"""


def health_sql(scope) -> str:
    return f"""{quality_sql(scope)}
SELECT round(completeness, 4) AS completeness, round(consistency, 4) AS consistency, round(uniqueness, 4) AS uniqueness, round(validity, 4) AS validity, round(anomaly_ratio, 4) AS anomaly_ratio,
  round(0.30 * completeness + 0.22 * consistency + 0.20 * uniqueness + 0.18 * validity + 0.10 * (1 - anomaly_ratio), 4) AS health_score FROM q"""


@query("health_score", health_sql(FLAG_TABLES))
def health_score(spark, sf_dir):
    return validate.health(quality_parts(spark, sf_dir))


def missing_sql(names) -> str:
    return f"""SELECT "table", round(100.0 * avg(nulls / CAST("rows" AS DOUBLE)), 2) AS avg_missing_pct, CAST(sum(duplicate_proxy) AS BIGINT) AS duplicate_proxy
FROM ({union_sql(_profile_sql(t, c) for t in names for c in COLUMNS[t])}) GROUP BY "table\""""


@query("table_missing_and_duplicates", missing_sql(HEALTHY))
def table_missing_and_duplicates(spark, sf_dir):
    return validate.table_missing(profile.tables(frames(spark, sf_dir, HEALTHY)))


@query("schema_tree")
def schema_tree(spark, sf_dir):
    labels = labelled(spark, sf_dir)
    return validate.schema_tree(profile.tables(frames(spark, sf_dir, ALL_TABLES)), labels, profile.classify_tables(labels))


@query("executive_summary")
def executive_summary(spark, sf_dir):
    spikes = timeseries.spikes(timeseries.daily(load(spark, sf_dir, "orders")), window=30).agg(F.count("*").alias("spikes"))
    return validate.summary(quality_parts(spark, sf_dir, ALL_TABLES), reported(spark, sf_dir, ALL_TABLES), spikes)


def kpis_sql(scope) -> str:
    return f"""{quality_sql(scope)}
SELECT (SELECT CAST(sum(filled) AS BIGINT) FROM p) AS total_records, (SELECT count(*) FROM p) AS total_columns, (SELECT CAST(sum(duplicate_proxy) AS BIGINT) FROM p) AS duplicate_cells,
  round(100.0 * (1 - completeness), 2) AS missing_pct, (SELECT count(*) FROM ({flags_sql(scope)}) WHERE flags <> '') AS anomaly_count, {len(LINKS)}::BIGINT AS relationships,
  (SELECT count(*) FROM ({_overlap_sql()}) WHERE signal = 'weak') AS orphan_relationships, (SELECT count(*) FROM ({CLASS_SQL}) WHERE table_label = 'unknown') AS schema_drift_count,
  (SELECT round(100.0 * count(*) FILTER (label = 'datetime' OR regexp_matches(lower(c), 'date|time|timestamp')) / count(*), 2) FROM ({LABEL_SQL})) AS timestamp_coverage_pct,
  TRUE AS supports_time_series FROM q"""


def kpis(spark, sf_dir, names):
    labels = labelled(spark, sf_dir)
    return validate.kpis(
        profiled(spark, sf_dir, names), quality_parts(spark, sf_dir, names), flagged(spark, sf_dir, names), evidence(spark, sf_dir),
        profile.classify_tables(labels), timeseries.coverage(labels),
    )


@query("core_kpis", kpis_sql(FLAG_TABLES))
def core_kpis(spark, sf_dir):
    return kpis(spark, sf_dir, HEALTHY)


@query(
    "profile_accuracy",
    f"""WITH l AS (SELECT CASE WHEN label = 'unknown' THEN 0.35 ELSE 0.72 END AS conf FROM ({LABEL_SQL})), ev AS ({_overlap_sql()}), e AS ({EDGES_SQL}), k AS ({KEYS_SQL}),
d(t, c) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b, _, _ in LINKS)}),
o AS (SELECT (SELECT count(*) FROM l) AS column_count, (SELECT round(CAST(avg(conf) AS DOUBLE), 4) FROM l) AS mean_confidence, (SELECT count(*) FILTER (conf < 0.5) FROM l) AS low_band,
  (SELECT count(*) FILTER (conf >= 0.5 AND conf < 0.75) FROM l) AS medium_band, (SELECT count(*) FILTER (conf >= 0.75) FROM l) AS high_band,
  (SELECT count(*) FROM ev) AS evidence_count, (SELECT count(*) FILTER (overlap_pct >= 0.7) FROM ev) AS strong_evidence, (SELECT count(*) FILTER (overlap_pct < 0.35) FROM ev) AS weak_evidence,
  (SELECT count(*) FILTER (edge_type = 'EXTRACTED') FROM e) AS extracted, (SELECT count(*) FILTER (edge_type = 'INFERRED') FROM e) AS inferred, CAST(0 AS BIGINT) AS ambiguous,
  (SELECT count(*) FROM d) AS declared_fks, (SELECT count(*) FROM d WHERE (t, c) IN (SELECT ("table", "column") FROM k WHERE kind = 'FK')) AS detected_fks)
SELECT *, round(detected_fks / CAST(declared_fks AS DOUBLE), 4) AS fk_detection_rate, round(strong_evidence / CAST(evidence_count AS DOUBLE), 4) AS evidence_success_rate,
  round(abs(high_band - strong_evidence) / CAST(greatest(1, high_band + strong_evidence) AS DOUBLE), 4) AS calibration_proxy_error,
  round((ambiguous + weak_evidence) / CAST(extracted + inferred AS DOUBLE), 4) AS high_risk_edge_ratio, round(weak_evidence / CAST(evidence_count AS DOUBLE), 4) AS contradiction_ratio FROM o""",
)
def profile_accuracy(spark, sf_dir):
    labels = labelled(spark, sf_dir)
    predicted = profile.predict_keys(profile.tables(frames(spark, sf_dir))).where("kind = 'FK'")
    declared = spark.createDataFrame([(a, b) for a, b, _, _ in LINKS], "table string, column string")
    edges = joins.schema_graph(catalog.columns(spark, frames(spark, sf_dir)), implied(spark, sf_dir))[1]
    out = profile.accuracy(labels, profile.classify_tables(labels), evidence(spark, sf_dir), edges, predicted, declared)
    return out.drop("table_count", "table_mean_confidence")


# --- catalog ---------------------------------------------------------------------------


@query(
    "catalog_tables",
    union_sql(f"SELECT '{t}' AS \"table\", count(*) AS row_count, CAST({len(COLUMNS[t])} AS BIGINT) AS column_count FROM {t}" for t in RELATIONAL),
)
def catalog_tables(spark, sf_dir):
    return catalog.tables(spark, frames(spark, sf_dir))


@query("schema_text")
def schema_text(spark, sf_dir):
    return catalog.schema_text(catalog.columns(spark, frames(spark, sf_dir)))
