"""The scoped queries of ``tabular`` and ``rules`` over every relational table and ``events``, as ``NAME_all``."""

from __future__ import annotations

from strataloom.operators import joins, profile, validate
from strataloom.plans import rules, tabular
from strataloom.plans.registry import ALL_TABLES, NUMERIC, query


@query("column_profile_all", tabular.profile_sql(ALL_TABLES))
def column_profile_all(spark, sf_dir):
    return tabular.profiles(spark, sf_dir, ALL_TABLES)


@query("null_bands_all", tabular.bands_sql(ALL_TABLES))
def null_bands_all(spark, sf_dir):
    return tabular.bands(spark, sf_dir, ALL_TABLES)


@query("datatype_inference_all", rules.datatypes_sql(ALL_TABLES))
def datatype_inference_all(spark, sf_dir):
    return rules.datatypes(spark, sf_dir, ALL_TABLES)


@query("table_classes_by_content_all", rules.content_classes_sql(ALL_TABLES))
def table_classes_by_content_all(spark, sf_dir):
    return rules.content_classes(spark, sf_dir, ALL_TABLES)


@query("anomaly_flags_all", rules.flags_sql(NUMERIC))
def anomaly_flags_all(spark, sf_dir):
    return rules.flagged(spark, sf_dir, ALL_TABLES).select("table", "column", "flags")


@query("table_rollup_all", rules.rollup_sql(NUMERIC))
def table_rollup_all(spark, sf_dir):
    return profile.rollup(rules.flagged(spark, sf_dir, ALL_TABLES))


@query("ranked_risky_tables_all", rules.risky_sql(NUMERIC))
def ranked_risky_tables_all(spark, sf_dir):
    return joins.rank_tables(profile.rollup(rules.flagged(spark, sf_dir, ALL_TABLES)))


@query("validation_checks_all", rules.checks_sql(ALL_TABLES))
def validation_checks_all(spark, sf_dir):
    return rules.findings(spark, sf_dir, ALL_TABLES)


@query("consistency_report_all", rules.report_sql(ALL_TABLES))
def consistency_report_all(spark, sf_dir):
    return rules.reported(spark, sf_dir, ALL_TABLES)


@query("health_score_all", rules.health_sql(NUMERIC))
def health_score_all(spark, sf_dir):
    return validate.health(rules.quality_parts(spark, sf_dir, ALL_TABLES))


@query("table_missing_and_duplicates_all", rules.missing_sql(ALL_TABLES))
def table_missing_and_duplicates_all(spark, sf_dir):
    return validate.table_missing(profile.tables(rules.frames(spark, sf_dir, ALL_TABLES)))


@query("core_kpis_all", rules.kpis_sql(NUMERIC))
def core_kpis_all(spark, sf_dir):
    return rules.kpis(spark, sf_dir, ALL_TABLES)
