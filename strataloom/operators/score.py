"""Confidence scores, scorecards, entity quality and the confidence ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.numeric import band, clamp, count_if, first_match, ratio, rnd
from strataloom.functions.text import strip
from strataloom.operators.profile import side_by_side

# Prior confidence of a relation, .55 for others.
RELATION_PRIOR = {
    "has_revenue": 0.9, "owns": 0.85, "employs": 0.8, "located_in": 0.78, "occurred_at": 0.75, "related_to": 0.6, "cross_source_related": 0.8,
}


def entities(rows: DataFrame, file: str = "source_id") -> DataFrame:
    """Add ``mentions`` and ``confidence`` to deduplicated entities ``file, text, label, chunk_occurrences``.

    An entity seen in several chunks lists its first chunk too, so two
    occurrences count as three mentions; this is kept from the original rule.
    """
    text = strip("text")
    base = rows.withColumn("norm", F.lower(text))
    same = base.groupBy(file, "norm").agg(F.count("*").alias("_same"))
    base = base.join(same, [file, "norm"])
    mentions = 1 + F.size("chunk_occurrences")
    length = first_match((F.length(text) >= 4, 1.0), (F.length(text) >= 2, 0.6), (F.length(text) >= 1, 0.3), other=0.0)
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N} \-_]", ""))
    noisy = F.when(odd > F.greatest(F.lit(1), F.floor(F.length(text) / 3)), F.lit(0.25)).otherwise(F.lit(0.0))
    repeat = F.when(F.col("_same") > 1, F.least(F.lit(0.35), (F.col("_same") - 1) * 0.1)).otherwise(F.lit(0.0))
    kind = F.when(F.col("label") == "ENTITY", F.lit(0.65)).otherwise(F.lit(0.85))
    total = 0.35 * F.least(F.lit(1.0), mentions / 4.0) + 0.35 * length + 0.3 * kind - repeat - noisy
    return base.withColumn("mentions", mentions).withColumn("noisy_penalty", noisy).withColumn("confidence", rnd(clamp(total))).drop("_same")


def relations(rows: DataFrame, entity_scores: DataFrame, order, file: str = "source_id") -> DataFrame:
    """Add ``confidence`` to relations; ``order`` names the columns that make a row unique within its file.

    The penalty grows with the ordinal among equal relations and is flat from
    the fourth on, so only the first three of a key are ranked (a limited
    window); all others take the flat penalty.
    """
    key = [file, "_s", "_r", "_t"]
    base = rows.withColumn("_s", F.lower(strip("source"))).withColumn("_t", F.lower(strip("target"))).withColumn("_r", F.lower(strip("relation")))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    early = base.select(*key, *order).withColumn("_n", rank).where(F.col("_n") <= 3).select(file, *order, "_n")
    known = entity_scores.groupBy(file, "norm").agg(F.max("confidence").alias("c"))
    out = base.join(early, [file, *order], "left")
    for side in ("_s", "_t"):
        out = out.join(known.select(file, F.col("norm").alias(side), F.col("c").alias(f"{side}c")), [file, side], "left")
    prior = first_match(*[(F.col("relation") == k, v) for k, v in RELATION_PRIOR.items()], other=0.55)
    again = F.coalesce((F.col("_n") - 1) * 0.12, F.lit(0.3))
    own = F.when(F.col("_s") == F.col("_t"), F.lit(0.2)).otherwise(F.lit(0.0))
    context = F.least(F.lit(1.0), F.length(strip("context")) / 90.0)
    total = 0.32 * prior + 0.28 * context + 0.2 * F.coalesce("_sc", F.lit(0.55)) + 0.2 * F.coalesce("_tc", F.lit(0.55)) - again - own
    return out.withColumn("confidence", rnd(clamp(total))).drop("_s", "_t", "_r", "_n", "_sc", "_tc")


def confidence_summary(scored: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return scored.agg(
        F.count("*").alias("rows"), count_if(c < 0.5).alias("low_confidence_count"), rnd(F.coalesce(F.avg(c), F.lit(0.0))).alias("mean_confidence"),
        F.coalesce(F.min(c), F.lit(0.0)).alias("min_confidence"), F.coalesce(F.max(c), F.lit(0.0)).alias("max_confidence"),
    )


def scorecard(parts: DataFrame) -> DataFrame:
    """Nine scores from ``entity_mean, relation_mean, density, consistency, completeness, reliability``."""
    consistency, completeness, reliability = (F.col(c) for c in ("consistency", "completeness", "reliability"))
    confidence = clamp((F.col("entity_mean") + F.col("relation_mean")) / 2.0)
    dense = lambda k: F.least(F.lit(1.0), F.col("density") * k)
    trust = clamp(0.35 * confidence + 0.2 * consistency + 0.2 * completeness + 0.15 * reliability + 0.1 * dense(3.0))
    ready = clamp(0.4 * confidence + 0.25 * consistency + 0.2 * completeness + 0.15 * dense(2.0))
    overall = clamp(0.45 * trust + 0.3 * consistency + 0.25 * completeness)
    scores = {
        "overall_kg_quality_score": overall, "completeness_score": clamp(completeness), "consistency_score": clamp(consistency), "confidence_score": confidence,
        "graph_trust_score": trust, "retrieval_readiness_score": ready, "semantic_coherence_score": clamp((consistency + confidence) / 2.0),
        "canonical_resolution_score": clamp(0.6 * confidence + 0.4 * consistency), "extraction_reliability_score": clamp(reliability),
    }
    return parts.select(*[rnd(v).alias(k) for k, v in scores.items()])


def histogram(scored: DataFrame, col: str = "confidence", bins: int = 10) -> DataFrame:
    """``bin_start, bin_end, count`` on [0, 1]; empty bins are kept."""
    place = F.least(F.lit(bins - 1), F.floor(clamp(col) * bins)).cast("int")
    counted = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    frame = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counted), "bin", "left").select(
        F.round(F.col("bin") / bins, 2).alias("bin_start"), F.round((F.col("bin") + 1) / bins, 2).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count")
    )


def entity_quality(scored: DataFrame, rels: DataFrame, file: str = "source_id") -> DataFrame:
    """Findings ``finding, file, entity, detail``: duplicates, orphans, type conflicts, ambiguous, noisy, low confidence."""
    kind = F.lower("type")
    pick = lambda df, name, detail: df.select(F.lit(name).alias("finding"), F.col(file).alias("file"), F.col("norm").alias("entity"), detail.cast("string").alias("detail"))
    grouped = scored.where("norm <> ''").groupBy(file, "norm").agg(F.count("*").alias("n"), F.count_distinct(kind).alias("kinds"))
    linked = rels.select(file, F.explode(F.array(F.lower(strip("source")), F.lower(strip("target")))).alias("norm")).distinct()
    weak = kind.isin("entity", "unknown") | (F.length(strip("text")) <= 2)
    parts = [
        pick(grouped.where("n > 1"), "duplicate", F.col("n")), pick(grouped.where("kinds > 1"), "type_conflict", F.col("kinds")),
        pick(scored.join(linked, [file, "norm"], "left_anti"), "orphan", F.lit("no_relationships_detected")),
        pick(scored.where(weak), "ambiguous", kind), pick(scored.where("noisy_penalty > 0"), "noisy", F.col("noisy_penalty")),
        pick(scored.where("confidence < 0.5"), "low_confidence", F.col("confidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finding_counts(findings: DataFrame) -> DataFrame:
    """The report's view of any findings table."""
    return findings.groupBy("finding").agg(F.count("*").alias("count"))


def mention_spread(scored: DataFrame) -> DataFrame:
    """Minimum, upper median and maximum of the mention counts."""
    counts = scored.groupBy("mentions").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("mentions"))
    total = F.sum("n").over(W.partitionBy())
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    middle = F.floor(F.col("total") / 2)
    return ranked.agg(
        F.min("mentions").alias("min"), F.min(F.when(F.col("upto") > middle, F.col("mentions"))).alias("median"), F.max("mentions").alias("max")
    )


def completeness(orphans: DataFrame, isolated: DataFrame, nodes: DataFrame, chunk_report: DataFrame, pages: DataFrame) -> DataFrame:
    """``completeness`` from orphan and isolated counts, ``reliability`` from coverage, overlap and page confidence."""
    one = side_by_side(
        orphans.agg(F.count("*").alias("o")), isolated.agg(F.count("*").alias("i")), nodes.agg(F.count("*").alias("n")),
        chunk_report.agg(F.avg("coverage_pct").alias("c"), F.avg("overlap_correctness_pct").alias("v")), pages.agg(F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("p")),
    )
    full = clamp(1.0 - (0.6 * F.col("o") + 0.4 * F.col("i")) / F.greatest(F.lit(1), F.col("n")))
    return one.select(rnd(full, 6).alias("completeness"), rnd(clamp(0.45 * F.col("c") / 100.0 + 0.35 * F.col("v") / 100.0 + 0.2 * F.col("p")), 6).alias("reliability"))


def report(*findings: DataFrame) -> DataFrame:
    """Union of finding tables reduced to ``finding, subject, detail``."""
    out = None
    for df in findings:
        subject = F.col("entity") if "entity" in df.columns else F.col("subject") if "subject" in df.columns else F.concat_ws("|", "source", "relation", "target")
        detail = F.col("detail") if "detail" in df.columns else F.col("value").cast("string") if "value" in df.columns else F.lit(None).cast("string")
        part = df.select("finding", subject.alias("subject"), detail.alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def hooks(ents: DataFrame, rels: DataFrame, confidence: DataFrame, low: float = 0.45, audit_below: float = 0.6) -> DataFrame:
    """Reprocessing counts and whether an audit is due; ``confidence`` is ``confidence_score`` in one row."""
    one = side_by_side(
        ents.agg(count_if(F.col("confidence") < low).alias("low_confidence_entities")), rels.agg(count_if(F.col("confidence") < low).alias("low_confidence_relationships")), confidence.select("confidence_score")
    )
    some = (F.col("low_confidence_entities") > 0) | (F.col("low_confidence_relationships") > 0)
    return one.select(
        "low_confidence_entities", "low_confidence_relationships", some.alias("retry_recommended"), (F.col("confidence_score") < audit_below).alias("audit_required")
    )


def distributions(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """``kind, name, count`` of entity types and relations."""
    return ents.groupBy(F.lit("entity").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("count")).unionByName(
        rels.groupBy(F.lit("relation").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias("count"))
    )


LAYERS = ("extraction", "resolution", "canonicalization", "graph_insert", "eda_validation")


def ledger(ents: DataFrame, priors: DataFrame, nodes: DataFrame, edges: DataFrame, trust: Column | float, drift_over: float = 0.3) -> DataFrame:
    """One row per canonical id with a score per layer, null where a layer has none.

    ``ents``: ``canonical_id, text, type, confidence``; ``priors``: ``term,
    prior``; ``nodes``: ``canonical_id, label, confidence``; ``edges``: ``source, target, confidence``.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("canonical_id"), "confidence").groupBy("canonical_id").agg(rnd(F.avg("confidence")).alias("graph_insert"))
    first = ents.groupBy("canonical_id").agg(F.min_by(F.struct("text", "type", "confidence"), F.struct("text", "confidence")).alias("e"))
    out = (
        first.withColumn("term", F.lower("e.text")).join(priors.select("term", "prior"), "term", "left")
        .join(nodes.select("canonical_id", "label", F.col("confidence").alias("canonicalization")), "canonical_id", "left").join(ends, "canonical_id", "left")
    )
    prior = F.coalesce("prior", F.lit(0.5))
    gap = F.abs(prior - F.col("e.confidence"))
    trust = trust if isinstance(trust, Column) else F.lit(trust)
    return out.select(
        "canonical_id", F.coalesce("label", "e.text").alias("label"), F.col("e.type").alias("entity_type"), F.col("e.confidence").alias("extraction"),
        rnd(prior).alias("resolution"), "canonicalization", "graph_insert", rnd(F.when(gap > drift_over, 1.0 - gap).otherwise(trust)).alias("eda_validation"),
    )


def ledger_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newer row of a canonical id wins."""
    return old.join(new.select("canonical_id"), "canonical_id", "left_anti").unionByName(new)


def ledger_long(rows: DataFrame) -> DataFrame:
    """``canonical_id, layer, score``."""
    return rows.unpivot(["canonical_id"], list(LAYERS), "layer", "score")


def semantic_eda(ents: DataFrame, rels: DataFrame, priors: DataFrame, drift_over: float = 0.3) -> DataFrame:
    """Undirected density, orphans, confidence bands and drift against the learned priors in one row."""
    names = ents.select("text").distinct()
    used = rels.select(F.explode(F.array("source", "target")).alias("text")).distinct()
    drift = ents.withColumn("term", F.lower("text")).join(priors.select("term", "prior"), "term", "left")
    gap = F.abs(F.coalesce("prior", F.lit(0.5)) - F.col("confidence"))
    level = band("confidence", ((0.75, "high"), (0.45, "medium")), "low")
    one = side_by_side(
        names.agg(F.count("*").alias("node_count")), rels.agg(F.count("*").alias("edge_count")),
        ents.join(used, "text", "left_anti").agg(F.count("*").alias("orphan_node_count")),
        ents.agg(rnd(F.coalesce(F.avg("confidence"), F.lit(0.0))).alias("avg_confidence"), *[count_if(level == b).alias(f"band_{b}") for b in ("high", "medium", "low")]),
        drift.agg(count_if(gap > drift_over).alias("drift_count")),
    )
    n = F.col("node_count").cast("double")
    return one.withColumn("density", F.when(n > 1, rnd(F.col("edge_count") / (n * (n - 1) / 2.0))).otherwise(rnd("edge_count"))).withColumn(
        "avg_degree", rnd(ratio(2 * F.col("edge_count"), n), 3)
    )


def run_scores(accuracy: DataFrame) -> DataFrame:
    """Trust, readiness and overall quality of a database run from its accuracy row."""
    conf, good = F.col("mean_confidence"), F.col("evidence_success_rate")
    trust = clamp(0.45 * (1.0 - F.col("high_risk_edge_ratio")) + 0.35 * good + 0.2 * (1.0 - F.col("calibration_proxy_error")))
    ready = clamp(0.5 * conf + 0.35 * good + 0.15 * (1.0 - F.col("contradiction_ratio")))
    return accuracy.select(
        rnd(conf).alias("confidence_score"), rnd(trust).alias("graph_trust_score"), rnd(ready).alias("retrieval_readiness_score"),
        rnd(clamp(0.45 * trust + 0.3 * conf + 0.25 * ready)).alias("overall_kg_quality_score"),
    )
