"""Validation rules, consistency report, health score and KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numeric import clamp, count_if, ratio, rnd
from strataloom.operators.profile import side_by_side
from strataloom.operators.timeseries import parse_datetime

# Weights of the health score.
HEALTH_WEIGHTS = {"completeness": 0.30, "consistency": 0.22, "uniqueness": 0.20, "validity": 0.18, "calm": 0.10}
NUMERIC_LABELS = ("quantity", "score", "age", "monetary_value")
CHECKS = ("invalid_dates", "null_key_violations", "enum_violations", "type_mismatches")


def is_dated() -> Column:
    """Whether a labelled column is asked for dates."""
    return (F.col("label") == "datetime") | F.lower("column").rlike("date|time|timestamp")


def run(counts: DataFrame, profile: DataFrame, labelled: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """``table, column, check, count, severity`` for the four column rules.

    Works on value counts (``column, value, copies``), so each distinct value
    is tested once and weighted by its copies. ``few`` holds those of the
    columns of at most ten values, if ``counts`` does not.
    """
    copies = F.col("copies")
    dated = is_dated()
    # Dates and numbers are parsed only where a rule asks for them: a value that is no date costs six failed parses.
    asked = labelled.join(profile.select("table").distinct(), "table", "left_semi").select("column", dated.alias("dated"), F.col("label").isin(*NUMERIC_LABELS).alias("numeric"))
    asked = asked.where(F.col("dated") | F.col("numeric"))
    per_column = counts.join(F.broadcast(asked), "column").groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("dated"), F.when(parse_datetime("value").isNull(), copies))), F.lit(0)).alias("bad_dates"),
        F.coalesce(F.sum(F.when(F.col("numeric"), F.when(F.col("value").try_cast("double").isNotNull(), copies))), F.lit(0)).alias("parsed"),
    )
    # A low-cardinality column has at most ten values; only those are folded to lower case.
    small = profile.where(F.col("cardinality") <= 10).select("column")
    rare = (
        (counts if few is None else few).join(F.broadcast(small), "column", "left_semi")
        .groupBy("column", F.lower("value").alias("low")).agg(F.sum("copies").alias("c"))
        .groupBy("column").agg(F.count("*").alias("kinds"), count_if(F.col("c") == 1).alias("rare"))
    )
    base = (
        profile.join(F.broadcast(labelled.select("table", "column", "label")), ["table", "column"])
        .join(F.broadcast(per_column), "column", "left").join(F.broadcast(rare), "column", "left")
        .fillna(0, ["bad_dates", "parsed", "kinds", "rare"])
    )
    rate = ratio("nulls", "rows")
    parse_rate = ratio("parsed", "filled")

    def found(check, test, count, severity):
        return F.when(test, F.struct(F.lit(check).alias("check"), count.cast("long").alias("count"), severity.alias("severity")))

    rules = F.array(
        found("invalid_dates", dated & (F.col("bad_dates") > 0), F.col("bad_dates"), F.when(F.col("bad_dates") <= 3, "medium").otherwise("high")),
        found("null_key_violations", F.col("label").isin("identifier", "unknown") & (rate > 0), F.col("nulls"), F.when(rate >= 0.1, "high").otherwise("medium")),
        found("enum_violations", (F.col("filled") >= 8) & (F.col("cardinality") <= 10) & (F.col("kinds") >= 2) & (F.col("rare") >= 2), F.col("rare"), F.lit("medium")),
        found("type_mismatches", (F.col("filled") >= 6) & F.col("label").isin(*NUMERIC_LABELS) & (parse_rate < 0.8), F.col("filled") - F.col("parsed"), F.lit("medium")),
    )
    return base.select("table", "column", F.explode(F.array_compact(rules)).alias("f")).select("table", "column", "f.check", "f.count", "f.severity")


def cell_checks(counts: DataFrame, profile: DataFrame, typed: DataFrame) -> DataFrame:
    """Second rule set, one row: invalid dates, unparsable numbers, empty keys."""
    bad = counts.groupBy("column").agg(
        F.sum(F.when(parse_datetime("value").isNull(), F.col("copies")).otherwise(F.lit(0))).alias("bad_dates"),
        F.sum(F.when(F.regexp_replace("value", ",", "").try_cast("double").isNull(), F.col("copies")).otherwise(F.lit(0))).alias("bad_numbers"),
    )
    base = profile.join(F.broadcast(typed.select("column", "label", "datatype")), "column").join(F.broadcast(bad), "column", "left")
    zero = F.lit(0)
    return base.agg(
        F.sum(F.when((F.col("label") == "temporal") | (F.col("datatype") == "date"), F.coalesce("bad_dates", zero)).otherwise(zero)).alias("invalid_dates"),
        F.sum(F.when(F.col("datatype") == "numeric", F.coalesce("bad_numbers", zero)).otherwise(zero)).alias("type_mismatches"),
        F.sum(F.when((F.col("label") == "identifier") & F.lower("column").contains("id"), F.col("nulls")).otherwise(zero)).alias("null_key_violations"),
    )


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Rows that repeat an earlier full row."""
    cols = list(cols or df.columns)
    return df.groupBy(*cols).agg(F.count("*").alias("copies")).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")
    )


def report(findings: DataFrame, evidence: DataFrame, classed: DataFrame) -> DataFrame:
    """One-row consistency report: counts per check, weak joins and unlabelled tables."""
    sums = [F.coalesce(F.sum(F.when(F.col("check") == c, F.col("count"))), F.lit(0)).alias(c) for c in CHECKS]
    left = findings.agg(*sums, F.count("*").alias("findings"))
    weak = evidence.agg(count_if(F.col("signal") == "weak").alias("orphan_relationships"))
    drift = classed.agg(count_if(F.col("table_label") == "unknown").alias("schema_drift"))
    return side_by_side(left, weak, drift).withColumn("foreign_key_issues", F.col("orphan_relationships"))


def quality(profile: DataFrame, findings: DataFrame, flagged: DataFrame, labelled: DataFrame) -> DataFrame:
    """Completeness, consistency, uniqueness, validity and anomaly ratio in one row."""
    one = side_by_side(
        profile.agg(
            F.count("*").alias("columns"), F.avg(ratio("nulls", "rows")).alias("missing"),
            F.sum("duplicate_proxy").alias("duplicates"), F.sum("filled").alias("filled_cells"),
        ),
        findings.agg(
            F.count("*").alias("findings"),
            F.coalesce(F.sum(F.when(F.col("check") == "invalid_dates", F.col("count"))), F.lit(0)).alias("invalid_dates"),
        ),
        flagged.agg(count_if(F.size("anomalies") > 0).alias("anomalous")),
        labelled.agg(count_if((F.col("label") == "datetime") | F.lower("column").rlike("date|time|timestamp")).alias("dated_columns")),
    )
    columns = F.greatest(F.lit(1), F.col("columns"))
    return one.select(
        clamp(1.0 - F.coalesce("missing", F.lit(0.0))).alias("completeness"),
        clamp(1.0 - F.col("findings") / columns).alias("consistency"),
        clamp(1.0 - ratio("duplicates", F.greatest(F.lit(1), F.col("filled_cells")))).alias("uniqueness"),
        clamp(1.0 - F.col("invalid_dates") / F.greatest(F.lit(1), F.col("dated_columns"))).alias("validity"),
        (F.col("anomalous") / columns).alias("anomaly_ratio"),
    )


def health(parts: DataFrame) -> DataFrame:
    """Weighted health score in [0, 1] over a quality row."""
    w = HEALTH_WEIGHTS
    score = (
        w["completeness"] * F.col("completeness") + w["consistency"] * F.col("consistency") + w["uniqueness"] * F.col("uniqueness")
        + w["validity"] * F.col("validity") + w["calm"] * F.greatest(F.lit(0.0), 1.0 - F.col("anomaly_ratio"))
    )
    return parts.select(*[rnd(c).alias(c) for c in parts.columns], clamp(rnd(score)).alias("health_score"))


def label_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("count"))


def table_missing(profile: DataFrame) -> DataFrame:
    """Average missing share and duplicate proxy per table."""
    return profile.groupBy("table").agg(
        rnd(100.0 * F.avg(ratio("nulls", "rows")), 2).alias("avg_missing_pct"), F.sum("duplicate_proxy").alias("duplicate_proxy")
    )


def schema_tree(profile: DataFrame, labelled: DataFrame, classed: DataFrame) -> DataFrame:
    """One row per table with an array of its columns (bounded by the schema)."""
    leaf = F.struct(F.col("column").alias("name"), "label", "null_pct", "cardinality")
    return (
        profile.join(labelled.select("table", "column", "label"), ["table", "column"])
        .groupBy("table").agg(F.array_sort(F.collect_list(leaf)).alias("columns"))
        .join(classed.select("table", "table_label"), "table", "left")
    )


def summary(parts: DataFrame, reported: DataFrame, spike_count: DataFrame) -> DataFrame:
    """Executive summary: one row per rule that fires."""
    missing = 1.0 - F.col("completeness")
    one = side_by_side(parts, reported, spike_count)

    def rule(test, message, severity, advice, confidence):
        return F.when(test, F.struct(
            message.alias("message"), severity.alias("severity"), F.lit(advice).alias("recommendation"), F.lit(confidence).alias("confidence")
        ))

    pct = F.format_number(100.0 * missing, 1)
    rules = F.array(
        rule(missing > 0.1, F.concat(pct, F.lit("% of the cells are empty")), F.when(missing < 0.25, "medium").otherwise("high"), "repair the emptiest columns first", 0.9),
        rule(F.col("orphan_relationships") > 0, F.concat(F.col("orphan_relationships").cast("string"), F.lit(" implied joins overlap weakly")), F.lit("medium"), "check key mappings and naming rules", 0.86),
        rule(F.col("spikes") > 0, F.concat(F.col("spikes").cast("string"), F.lit(" days stand out in the daily counts")), F.lit("low"), "compare the days with known events", 0.78),
        rule(F.col("schema_drift") > 0, F.concat(F.col("schema_drift").cast("string"), F.lit(" tables have no known role")), F.lit("medium"), "label the tables and update mappings", 0.8),
    )
    return one.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def kpis(profile: DataFrame, parts: DataFrame, flagged: DataFrame, evidence: DataFrame, classed: DataFrame, coverage: DataFrame) -> DataFrame:
    """Core KPI row with capability flags."""
    one = side_by_side(
        profile.agg(F.sum("filled").alias("total_records"), F.count("*").alias("total_columns"), F.sum("duplicate_proxy").alias("duplicate_cells")),
        parts.select(rnd(100.0 * (1.0 - F.col("completeness")), 2).alias("missing_pct")),
        flagged.agg(count_if(F.size("anomalies") > 0).alias("anomaly_count")),
        evidence.agg(F.count("*").alias("relationships"), count_if(F.col("signal") == "weak").alias("orphan_relationships")),
        classed.agg(count_if(F.col("table_label") == "unknown").alias("schema_drift_count")),
        coverage.select("datetime_columns", "timestamp_coverage_pct"),
    )
    return one.withColumn("supports_time_series", F.col("datetime_columns") > 0).drop("datetime_columns")


def document_health(chunks: DataFrame, entities: DataFrame, relations: DataFrame, semantic: DataFrame) -> DataFrame:
    """File counterpart of ``quality`` and ``health``: one row over one-row aggregates.

    ``chunks`` has ``coverage_pct``; ``entities`` has ``entity_count,
    duplicate_count, orphan_count``; ``relations`` has ``relation_count``;
    ``semantic`` has ``consistency_score, anomaly_count, type_conflicts``.
    """
    one = side_by_side(chunks, entities, relations, semantic)
    missing = clamp(100.0 - F.col("coverage_pct"), 0.0, 100.0)
    total = F.greatest(F.lit(1.0), (F.col("entity_count") + F.col("relation_count")).cast("double"))
    anomalies = F.least(F.lit(1.0), F.col("anomaly_count") / total)
    uniqueness = clamp(1.0 - ratio("duplicate_count", F.greatest(F.lit(1), F.col("entity_count"))))
    validity = clamp(1.0 - F.col("anomaly_count") / F.greatest(F.lit(1), F.col("entity_count")))
    w = HEALTH_WEIGHTS
    score = (
        w["completeness"] * F.col("coverage_pct") / 100.0 + w["consistency"] * F.col("consistency_score")
        + w["uniqueness"] * uniqueness + w["validity"] * validity + w["calm"] * (1.0 - anomalies)
    )
    return one.select(
        rnd(missing, 2).alias("missing_pct"), F.col("duplicate_count").alias("duplicate_rows"), "anomaly_count", "entity_count", "relation_count",
        F.col("type_conflicts").alias("schema_drift_count"), F.col("orphan_count").alias("orphan_relationships"), clamp(rnd(score)).alias("health_score"),
    )
