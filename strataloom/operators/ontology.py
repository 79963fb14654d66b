"""Ontology closure, governance of relations, semantic consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.numeric import clamp, count_if, first_match, ratio, rnd
from strataloom.functions.text import is_number, strip, to_number, year
from strataloom.operators.profile import side_by_side

# The seed taxonomy (type, parent).
TAXONOMY = (
    ("organization", "agent"), ("person", "agent"), ("location", "place"), ("monetary", "value"), ("temporal", "value"),
    ("concept", None), ("agent", None), ("place", None), ("value", None),
)
# Allowed (source type, target type) per predicate; ANY admits all pairs.
CONSTRAINTS = (
    ("has_revenue", "organization", "monetary"), ("employs", "organization", "person"), ("owns", "organization", "organization"), ("owns", "person", "organization"),
    ("located_in", "organization", "location"), ("located_in", "person", "location"), ("occurred_at", "concept", "temporal"), ("occurred_at", "organization", "temporal"),
    ("related_to", "ANY", "ANY"),
)


def taxonomy(spark: SparkSession, rows=TAXONOMY) -> DataFrame:
    return spark.createDataFrame(list(rows), "type string, parent string")


def constraints(spark: SparkSession, rows=CONSTRAINTS) -> DataFrame:
    return spark.createDataFrame(list(rows), "relation string, source_type string, target_type string")


def closure(tax: DataFrame) -> DataFrame:
    """``type, ancestor`` pairs including the type itself, by a recursive query."""
    tax.createOrReplaceTempView("_taxonomy")
    return tax.sparkSession.sql("""
        WITH RECURSIVE up(type, ancestor) AS (
          SELECT type, type FROM _taxonomy
          UNION ALL
          SELECT up.type, t.parent FROM up JOIN _taxonomy t ON up.ancestor = t.type WHERE t.parent IS NOT NULL)
        SELECT DISTINCT type, ancestor FROM up""")


def allowed_pairs(rules: DataFrame, up: DataFrame) -> DataFrame:
    """Concrete ``relation, source_type, target_type`` rows allowed through the closure."""
    named = rules.where("source_type <> 'ANY'")
    s = up.select(F.col("type").alias("s"), F.col("ancestor").alias("source_type"))
    t = up.select(F.col("type").alias("t"), F.col("ancestor").alias("target_type"))
    return named.join(s, "source_type").join(t, "target_type").select("relation", F.col("s").alias("source_type"), F.col("t").alias("target_type")).distinct()


def govern(relations: DataFrame, rules: DataFrame, tax: DataFrame) -> DataFrame:
    """Add ``action`` and ``reason`` to relations (``source_type, target_type, relation``).

    The ontology is a small, hand-kept table; its expansion is broadcast.
    """
    pairs = allowed_pairs(rules, closure(tax)).withColumn("fits", F.lit(True))
    known = rules.groupBy("relation").agg(F.max(F.col("source_type") == "ANY").alias("any"))
    types = tax.select("type", F.lit(True).alias("known"))
    out = relations.join(F.broadcast(known), "relation", "left")
    for side in ("source", "target"):
        out = out.join(F.broadcast(types.select(F.col("type").alias(f"{side}_type"), F.col("known").alias(f"_{side}"))), f"{side}_type", "left")
    out = out.join(F.broadcast(pairs), ["relation", "source_type", "target_type"], "left")
    strange = F.col("_source").isNull() | F.col("_target").isNull()
    action = first_match((F.col("any").isNull(), "review_required"), (strange, "review_required"), (F.col("any") | F.col("fits").isNotNull(), "auto_accept"), other="reject")
    reason = first_match(
        (F.col("any").isNull(), "predicate not in ontology"), (strange, "unknown entity type"), (F.col("any") | F.col("fits").isNotNull(), "ontology-valid"), other="type pair not allowed"
    )
    return out.withColumn("action", action).withColumn("reason", reason).drop("any", "_source", "_target", "fits")


def gate(governed: DataFrame, mode: str = "observe_only") -> DataFrame:
    """``observe_only`` lets all relations through, ``enforce`` only the accepted ones."""
    return governed if mode == "observe_only" else governed.where("action = 'auto_accept'")


def verdicts(governed: DataFrame) -> DataFrame:
    one = governed.agg(*[count_if(F.col("action") == a).alias(a) for a in ("auto_accept", "review_required", "reject")], F.count("*").alias("total"))
    return one.withColumn("ontology_consistency", rnd(1.0 - ratio("reject", F.greatest(F.lit(1), F.col("total"))))).drop("total")


def violations(edges: DataFrame, node_types: DataFrame, rules: DataFrame, tax: DataFrame) -> DataFrame:
    """Edges whose predicate is unknown or whose end types are not allowed; ``node_types`` is ``id, entity_type``."""
    typed = edges.join(node_types.select(F.col("id").alias("source"), F.col("entity_type").alias("source_type")), "source", "left").join(
        node_types.select(F.col("id").alias("target"), F.col("entity_type").alias("target_type")), "target", "left"
    )
    pairs = allowed_pairs(rules, closure(tax)).withColumn("fits", F.lit(True))
    known = rules.groupBy("relation").agg(F.max(F.col("source_type") == "ANY").alias("any"))
    out = typed.join(F.broadcast(known), "relation", "left").join(F.broadcast(pairs), ["relation", "source_type", "target_type"], "left")
    reason = first_match((F.col("any").isNull(), "unknown predicate"), (~F.col("any") & F.col("fits").isNull(), "type-constraint violation"), other=None)
    return out.withColumn("reason", reason).where("reason IS NOT NULL").select("source", "target", "relation", "reason")


def add_predicate(rules: DataFrame, new: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace or add the pairs of predicates; the version rises by one."""
    kept = rules.join(new.select("relation").distinct(), "relation", "left_anti")
    return kept.unionByName(new), versions.agg((F.max("version") + 1).alias("version"))


def semantic_findings(entities: DataFrame, relations: DataFrame, this_year: int, z: float = 3.0) -> DataFrame:
    """Findings ``finding, subject, object, detail`` over entity and relation rows.

    Type conflicts, odd years, numeric outliers, self relations, mutual
    ownership and direction issues. Entity types are a bounded set per label.
    """
    named = entities.select(F.lower(strip("text")).alias("entity"), F.lower("type").alias("type"), strip("text").alias("text")).where("entity <> ''")
    types = named.groupBy("entity").agg(F.array_sort(F.collect_set("type")).alias("types"))
    null = F.lit(None).cast("string")

    def rows(df, finding, subject, obj, detail):
        return df.select(F.lit(finding).alias("finding"), subject.cast("string").alias("subject"), obj.cast("string").alias("object"), detail.cast("string").alias("detail"))

    out = rows(types.where(F.size("types") > 1), "type_conflict", F.col("entity"), null, F.array_join("types", ","))
    years = named.withColumn("year", year("text")).where(F.col("type").isin("time", "date") & (F.col("year") > 0) & ((F.col("year") < 1900) | (F.col("year") > this_year + 2)))
    out = out.unionByName(rows(years, "temporal_inconsistency", F.col("text"), null, F.col("year")))
    numbers = named.where(is_number("text")).withColumn("value", to_number("text"))
    spread = numbers.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("one", F.lit(1))
    far = numbers.withColumn("one", F.lit(1)).join(F.broadcast(spread), "one").where((F.col("std") > 0) & (F.abs(F.col("value") - F.col("mean")) / F.col("std") >= z))
    out = out.unionByName(rows(far, "numeric_anomaly", F.col("text"), null, F.round("value", 4)))
    rel = relations.select(F.lower(strip("source")).alias("s"), F.lower(strip("target")).alias("t"), F.lower(strip("relation")).alias("r")).where("s <> '' AND t <> ''")
    out = out.unionByName(rows(rel.where("r IN ('owns', 'employs') AND s = t"), "ontology_violation", F.col("s"), F.col("t"), F.lit("self_relation")))
    owns = rel.where("r = 'owns'").select("s", "t").distinct()
    both = owns.join(owns.select(F.col("t").alias("s"), F.col("s").alias("t")), ["s", "t"])
    out = out.unionByName(rows(both, "contradiction", F.col("s"), F.col("t"), F.lit("mutual_ownership_cycle")))
    placed = rel.where("r = 'located_in'").join(types.select(F.col("entity").alias("s"), F.col("types").alias("st")), "s", "left").join(
        types.select(F.col("entity").alias("t"), F.col("types").alias("tt")), "t", "left"
    )
    default = F.array(F.lit("entity"))
    st, tt = F.coalesce("st", default), F.coalesce("tt", default)
    nowhere = ~F.arrays_overlap(tt, F.array(F.lit("location"), F.lit("gpe")))
    turned = F.array_contains(st, "location") & F.array_contains(tt, "organization")
    out = out.unionByName(rows(placed.where(nowhere), "direction_issue", F.col("s"), F.col("t"), F.lit("target_not_location_like")))
    return out.unionByName(rows(placed.where(turned), "direction_issue", F.col("s"), F.col("t"), F.lit("likely_direction_reversed")))


def semantic_score(findings: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Finding counts and ``1 - findings / (entities + relations)``."""
    one = side_by_side(
        findings.agg(
            *[count_if(F.col("finding") == f).alias(f) for f in ("type_conflict", "temporal_inconsistency", "numeric_anomaly", "ontology_violation", "contradiction", "direction_issue")],
            F.count("*").alias("findings"),
        ),
        entities.agg(F.count("*").alias("entity_rows")), relations.agg(F.count("*").alias("relation_rows")),
    )
    volume = F.greatest(F.lit(1), F.col("entity_rows") + F.col("relation_rows"))
    return one.withColumn("consistency_score", rnd(clamp(1.0 - F.col("findings") / volume)))
