"""Join discovery: implied foreign keys, joinability, schema graph."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.numeric import clamp, first_match, ratio, rnd
from strataloom.operators.profile import counts_by_column

RELATION_KEYS = ["source_table", "source_col", "target_table", "target_col"]


def with_key_names(catalog: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``key_name``: the lower-case column name, mapped through ``names``.

    ``names`` lets prefixed schemas say that, for instance, ``o_custkey``
    stands for ``customer_id``.
    """
    low = F.lower("column")
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        low = F.coalesce(F.try_element_at(table, low), low)
    return catalog.withColumn("key_name", low)


def implicit(catalog: DataFrame) -> DataFrame:
    """``x_id`` columns that point to table ``x`` or ``xs``; the first target wins.

    Needs ``table, column, ordinal, key_name``. A table's own key is no link.
    """
    source = catalog.where(F.col("key_name").endswith("_id")).select(
        F.col("table").alias("source_table"), F.col("column").alias("source_col"), "key_name",
        F.expr("substring(key_name, 1, length(key_name) - 3)").alias("stem"),
    )
    source = source.select(
        "*", F.posexplode(F.array(F.col("stem"), F.concat("stem", F.lit("s")))).alias("choice", "target_table")
    )
    target = catalog.select(
        F.col("table").alias("target_table"), F.col("column").alias("target_col"), "ordinal", F.col("key_name").alias("target_key")
    )
    fits = F.col("target_key").isin("id") | (F.col("target_key") == F.concat("target_table", F.lit("_id"))) | (
        F.col("target_key") == F.col("key_name")
    )
    first = F.row_number().over(W.partitionBy("source_table", "source_col").orderBy("choice", "ordinal"))
    return (
        source.join(F.broadcast(target), "target_table")
        .where(fits & (F.col("source_table") != F.col("target_table")))
        .withColumn("pick", first).where("pick = 1")
        .select(*RELATION_KEYS, F.lit(0.75).alias("confidence"), F.lit("naming_rule:_id").alias("basis"))
    )


def joinability(frames: Mapping[str, DataFrame], relations: DataFrame) -> DataFrame:
    """Distinct-value overlap over the smaller side, with a signal, per relation.

    ``relations`` is schema-sized and read once to know which columns to scan.
    Both sides meet in one grouped aggregate (no join), so hot values are
    combined before the shuffle.
    """
    rels = [(i, *r) for i, r in enumerate(sorted(tuple(r[k] for k in RELATION_KEYS) for r in relations.select(*RELATION_KEYS).collect()))]
    spark = relations.sparkSession
    sides: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for i, st, sc, tt, tc in rels:
        sides.setdefault((st, sc), []).append((i, 1))
        sides.setdefault((tt, tc), []).append((i, 2))
    values = None
    for (table, c), marks in sides.items():
        # Distinct cells of a column are found before they are spelled out and marked for each of its relations.
        cells = counts_by_column(frames[table], [c]).select("value", F.explode(F.array(*[F.struct(F.lit(i).alias("rel"), F.lit(side).alias("side")) for i, side in marks])).alias("u"))
        one = cells.select("u.rel", "u.side", "value")
        values = one if values is None else values.unionByName(one)
    schema = "rel int, source_table string, source_col string, target_table string, target_col string"
    names = spark.createDataFrame(rels, schema)
    if values is None:
        return names.select(*RELATION_KEYS).withColumn("overlap_pct", F.lit(0.0)).limit(0)
    seen = values.groupBy("rel", "value").agg(
        F.max(F.when(F.col("side") == 1, 1)).alias("l"), F.max(F.when(F.col("side") == 2, 1)).alias("r")
    )
    counted = seen.groupBy("rel").agg(
        F.count("l").alias("left_count"), F.count("r").alias("right_count"),
        F.count(F.col("l") + F.col("r")).alias("overlap_count"),
    )
    share = rnd(ratio("overlap_count", F.least("left_count", "right_count")))
    return (
        F.broadcast(names).join(counted, "rel", "left").fillna(0, ["left_count", "right_count", "overlap_count"])
        .withColumn("overlap_pct", share)
        .select(
            *RELATION_KEYS,
            F.concat("source_table", F.lit("."), "source_col", F.lit("->"), "target_table", F.lit("."), "target_col").alias("evidence_key"),
            "left_count", "right_count", "overlap_count", "overlap_pct",
            first_match((F.col("overlap_pct") >= 0.7, "strong"), (F.col("overlap_pct") >= 0.35, "medium"), other="weak").alias("signal"),
        )
    )


def signal_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("signal").agg(F.count("*").alias("count"))


def weak_evidence(evidence: DataFrame, below: float = 0.2, keep: int = 25) -> DataFrame:
    return evidence.where(F.col("overlap_pct") < below).select("evidence_key", "overlap_pct").orderBy("evidence_key").limit(keep)


def schema_graph(catalog: DataFrame, implied: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, type`` and edges ``source, target, relation, edge_type``."""
    table_id = F.concat(F.lit("table:"), F.col("table"))
    column_name = F.concat("table", F.lit("."), "column")
    column_id = F.concat(F.lit("column:"), column_name)
    nodes = catalog.select(table_id.alias("id"), F.col("table").alias("label"), F.lit("table").alias("type")).unionByName(
        catalog.select(column_id.alias("id"), column_name.alias("label"), F.lit("column").alias("type"))
    ).distinct()
    edges = catalog.select(
        table_id.alias("source"), column_id.alias("target"), F.lit("has_column").alias("relation"), F.lit("EXTRACTED").alias("edge_type")
    )
    if declared is not None:
        edges = edges.unionByName(declared.select(
            table_id.alias("source"), F.concat(F.lit("table:"), "refers").alias("target"),
            F.lit("foreign_key_to").alias("relation"), F.lit("EXTRACTED").alias("edge_type"),
        ))
    edges = edges.unionByName(implied.select(
        F.concat(F.lit("table:"), "source_table").alias("source"), F.concat(F.lit("table:"), "target_table").alias("target"),
        F.concat(F.lit("implicit_"), "source_col").alias("relation"), F.lit("INFERRED").alias("edge_type"),
    ))
    return nodes, edges


def rank_tables(rollup: DataFrame, keep: int = 10) -> DataFrame:
    return rollup.orderBy(F.desc("high_risk_ratio"), F.desc("high_risk_column_count"), "table").limit(keep)


def rank_evidence(evidence: DataFrame, keep: int = 12) -> DataFrame:
    return evidence.orderBy(F.desc("overlap_pct"), "evidence_key").limit(keep)


# Confidence of a schema edge by how it was found.
EDGE_CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}


def to_canonical(
    nodes: DataFrame, edges: DataFrame, db_id: str, rollup: DataFrame | None = None, evidence: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Schema graph as canonical nodes and edges with confidences.

    A table loses up to .18 for risky columns. An edge gains from the first
    evidence row (by key) that names both ends (up to .08) or a column of the
    source (up to .05). Labels are matched with the parts of the evidence key
    by equality, where a plain substring test would also accept look-alikes.
    """
    cid = F.concat(F.lit("ce_"), F.substring(F.sha1(F.lower(F.concat("type", F.lit(":"), "label"))), 1, 16))
    base = nodes.withColumn("canonical_id", cid)
    risk = F.lit(0.0)
    if rollup is not None:
        base = base.join(F.broadcast(rollup.select(F.col("table").alias("label"), "high_risk_ratio")), "label", "left")
        risk = F.when(F.col("type") == "table", F.least(F.lit(0.18), 0.18 * F.coalesce("high_risk_ratio", F.lit(0.0)))).otherwise(F.lit(0.0))
    canonical = base.select(
        "id", "canonical_id", "label", F.col("type").alias("entity_type"),
        rnd(clamp(0.8 - risk, 0.45, 0.95)).alias("confidence"), F.lit(db_id).alias("source_id"),
    )
    ends = canonical.select("id", "canonical_id", "label")
    kind = F.upper("edge_type")
    prior = first_match(*[(kind == k, v) for k, v in EDGE_CONFIDENCE.items()], other=0.6)
    linked = (
        edges.join(ends.select(F.col("id").alias("source"), F.col("canonical_id").alias("source_canonical_id"), F.col("label").alias("source_label")), "source")
        .join(ends.select(F.col("id").alias("target"), F.col("canonical_id").alias("target_canonical_id"), F.col("label").alias("target_label")), "target")
        .withColumn("prior", prior)
    )
    bonus = F.lit(0.0)
    if evidence is not None:
        parts = F.array(
            "source_table", "target_table", F.concat("source_table", F.lit("."), "source_col"), F.concat("target_table", F.lit("."), "target_col")
        )
        named = evidence.select("evidence_key", "overlap_pct", parts.alias("parts"), F.explode(F.array_distinct(parts)).alias("source_label"))
        both = F.array_contains("parts", F.col("target_label"))
        usable = both | (F.instr("source_label", ".") == 0)
        gain = F.when(both, F.least(F.lit(0.08), 0.08 * F.col("overlap_pct"))).otherwise(F.least(F.lit(0.05), 0.05 * F.col("overlap_pct")))
        keys = ["source", "target", "relation"]
        gains = (
            linked.join(F.broadcast(named), "source_label").where(usable)
            .groupBy(*keys).agg(F.min_by(gain, F.col("evidence_key")).alias("bonus"))
        )
        linked = linked.join(gains, keys, "left")
        bonus = F.coalesce("bonus", F.lit(0.0))
    out = linked.select(
        "source_canonical_id", "target_canonical_id", F.lower(F.trim("relation")).alias("relation"),
        rnd(F.least(F.lit(0.99), F.col("prior") + bonus)).alias("confidence"), kind.alias("edge_type"), F.lit(db_id).alias("source_id"),
    )
    return canonical, out
