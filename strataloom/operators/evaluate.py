"""Evaluation against gold sets: P/R/F1, calibration, ranking, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.numeric import band, clamp, count_if, ratio, rnd
from strataloom.functions.text import strip
from strataloom.operators.profile import side_by_side


def norm(c) -> Column:
    return F.lower(strip(c))


def prf(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Add precision, recall and F1 to rows with ``tp, fp, fn``; 0 where undefined."""
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", rnd(p, digits)).withColumn("recall", rnd(r, digits)).withColumn("f1", rnd(ratio(2 * p * r, p + r), digits))


def matches(predicted: DataFrame, gold: DataFrame, keys, by=()) -> DataFrame:
    """Distinct keys of both sides with ``in_pred, in_gold`` flags: one grouped pass, no join."""
    cols = [*by, *keys]
    rows = predicted.select(*cols, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*cols, F.lit(0).alias("p"), F.lit(1).alias("g")))
    return rows.groupBy(*cols).agg((F.max("p") == 1).alias("in_pred"), (F.max("g") == 1).alias("in_gold"))


def confusion(matched: DataFrame, by=()) -> DataFrame:
    p, g = F.col("in_pred"), F.col("in_gold")
    return matched.groupBy(*by).agg(count_if(p & g).alias("tp"), count_if(p & ~g).alias("fp"), count_if(~p & g).alias("fn"))


def entities(predicted: DataFrame, gold: DataFrame, by=()) -> DataFrame:
    """TP/FP/FN by (label, type); a gold entity of type ``entity`` matches any type, one match per node."""
    shape = lambda df: df.select(*by, norm("label").alias("label"), norm("type").alias("type")).where("label <> ''").distinct()
    pred, ref = shape(predicted), shape(gold)
    keys = [*by, "label"]
    loose = ref.where("type = 'entity'").select(*keys).distinct().withColumn("loose", F.lit(True))
    typed = pred.join(loose, keys, "left").withColumn("type", F.when(F.col("loose"), F.lit("entity")).otherwise(F.col("type"))).drop("loose").distinct()
    return prf(confusion(matches(typed, ref, ["label", "type"], by), by))


def relations(predicted: DataFrame, gold: DataFrame, by=()) -> DataFrame:
    """TP/FP/FN by lower (source label, relation, target label)."""
    shape = lambda df: df.select(*by, norm("source").alias("source"), norm("relation").alias("relation"), norm("target").alias("target"))
    return prf(confusion(matches(shape(predicted), shape(gold), ["source", "relation", "target"], by), by))


def kg(pred_nodes: DataFrame, pred_edges: DataFrame, gold_nodes: DataFrame, gold_edges: DataFrame, high: float = 0.7) -> DataFrame:
    """One-row evaluation: both F1 scores, false relation rate, evidence and high-confidence accuracy, calibration, overall."""
    keys = ["source", "relation", "target"]
    shape = lambda df, *more: df.select(*[norm(k).alias(k) for k in keys], *more)
    edges = shape(pred_edges, "confidence", "context")
    gold = shape(gold_edges, "expected_confidence_min").groupBy(*keys).agg(F.max("expected_confidence_min").alias("want"))
    flagged = edges.join(gold.withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    per_key = flagged.where("hit").groupBy(*keys).agg(
        F.max("confidence").alias("conf"), F.first("want").alias("want"), F.max((F.trim(F.coalesce("context", F.lit(""))) != "").cast("int")).alias("evident")
    )
    one = side_by_side(
        entities(pred_nodes, gold_nodes).select(*[F.col(c).alias(f"entity_{c}") for c in ("tp", "fp", "fn", "f1")]),
        relations(pred_edges, gold_edges).select(*[F.col(c).alias(f"relation_{c}") for c in ("tp", "fp", "fn", "f1")]),
        flagged.agg(F.count("*").alias("edges"), count_if(F.col("confidence") >= high).alias("sure"), count_if(F.col("hit") & (F.col("confidence") >= high)).alias("sure_right")),
        per_key.agg(F.count("*").alias("matched"), F.coalesce(F.sum("evident"), F.lit(0)).alias("evident"), F.avg(F.when(F.col("want") > 0, F.greatest(F.lit(0.0), F.col("want") - F.col("conf")))).alias("calibration")),
    )
    false_rate = rnd(F.col("relation_fp") / F.greatest(F.lit(1), F.col("edges")))
    evidence = rnd(ratio("evident", F.greatest(F.lit(1), F.col("matched"))))
    sure = rnd(ratio("sure_right", F.greatest(F.lit(1), F.col("sure"))))
    out = one.withColumn("false_relation_rate", false_rate).withColumn("evidence_accuracy", evidence).withColumn("high_confidence_accuracy", sure).withColumn(
        "calibration_error", rnd(F.coalesce("calibration", F.lit(0.0)))
    )
    total = 0.3 * F.col("entity_f1") + 0.3 * F.col("relation_f1") + 0.15 * (1.0 - F.col("false_relation_rate")) + 0.15 * F.col("evidence_accuracy") + 0.1 * F.col("high_confidence_accuracy")
    return out.withColumn("eval_score", rnd(total)).drop("edges", "sure", "sure_right", "matched", "evident", "calibration")


def gold_upsert(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Newer rows replace older ones with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)), allowMissingColumns=True)


def gold_delete(old: DataFrame, gone: DataFrame, keys) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def gold_bootstrap(edges: DataFrame, existing: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """Gold relations from confident edges, with .8 of their confidence as the expected minimum."""
    keys = ["source", "relation", "target"]
    new = edges.where(F.col("confidence") >= least).groupBy(*[norm(k).alias(k) for k in keys]).agg(rnd(0.8 * F.max("confidence")).alias("expected_confidence_min"))
    if existing is not None:
        new = new.join(existing.select(*[norm(k).alias(k) for k in keys]).distinct(), keys, "left_anti")
    return new.withColumn("added_by", F.lit("auto"))


def calibration(scored: DataFrame, by=()) -> DataFrame:
    """``|mean confidence - share of the high band|``."""
    return scored.groupBy(*by).agg(rnd(F.abs(F.avg("confidence") - F.avg((F.col("confidence") >= 0.75).cast("double")))).alias("calibration_error"), F.count("*").alias("rows"))


def ranking(scored: DataFrame, gold: DataFrame, k: int = 5, item: str = "item", by=()) -> DataFrame:
    """Recall@k and MRR of gold items in the confidence order (ties by item).

    The first hit's rank is one plus the number of rows before it, so the
    whole order is never sorted in one place.
    """
    by = list(by) or ["_all"]
    base = scored if by != ["_all"] else scored.withColumn("_all", F.lit(1))
    ref = (gold if by != ["_all"] else gold.withColumn("_all", F.lit(1))).select(*by, item).distinct()
    place = F.struct((-F.col("confidence")).alias("c"), F.col(item).alias("i"))
    marked = base.join(ref.withColumn("hit", F.lit(True)), [*by, item], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("place", place)
    first = marked.where("hit").groupBy(*by).agg(F.min("place").alias("best"))
    ahead = marked.join(F.broadcast(first) if by == ["_all"] else first, by).groupBy(*by).agg((1 + count_if(F.col("place") < F.col("best"))).alias("rank"))
    top = marked.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("place"))).where(F.col("_r") <= k).groupBy(*by).agg(count_if(F.col("hit")).alias("hits"))
    size = ref.groupBy(*by).agg(F.count("*").alias("gold_items"))
    out = size.join(top, by, "left").join(ahead, by, "left")
    return out.select(
        *[c for c in by if c != "_all"], "gold_items", rnd(ratio(F.coalesce("hits", F.lit(0)), F.least(F.lit(k), F.col("gold_items")))).alias(f"recall_at_{k}"),
        rnd(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def trust(entity_f1: DataFrame, relation_f1: DataFrame, rels: DataFrame, drift: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Hallucination risk and trust score with its band, from one-row frames and the relation rows."""
    one = side_by_side(
        entity_f1.select(F.col("f1").alias("entity_f1")), relation_f1.select(F.col("f1").alias("relation_f1")),
        rels.agg(rnd(ratio(count_if(F.col("relation") == "related_to"), F.greatest(F.lit(1), F.count("*"))), 6).alias("generic_share")), drift.select("drift_count"), calibrated.select("calibration_error"),
    )
    risk = rnd(0.6 * F.col("generic_share") + 0.4 * F.least(F.lit(1.0), F.col("drift_count") / 10.0))
    out = one.withColumn("hallucination_risk", risk)
    score = rnd(0.30 * F.col("entity_f1") + 0.30 * F.col("relation_f1") + 0.20 * (1.0 - F.col("hallucination_risk")) + 0.20 * (1.0 - F.col("calibration_error")))
    return out.withColumn("graph_trust_score", score).withColumn("trust_band", band("graph_trust_score", ((0.75, "high"), (0.45, "medium")), "low"))


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, count, mean_score, accuracy`` of binary outcomes ``score, outcome``."""
    place = F.least(F.lit(bins - 1), F.floor(clamp("score") * bins)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"), F.avg(F.col("outcome").cast("double")).alias("accuracy"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """Confusion counts, P/R/F1, ECE and Brier score of ``score, outcome`` rows."""
    guess, truth = F.col("score") >= threshold, F.col("outcome") == 1
    counts = scored.agg(
        count_if(guess & truth).alias("tp"), count_if(guess & ~truth).alias("fp"), count_if(~guess & truth).alias("fn"), count_if(~guess & ~truth).alias("tn"),
        rnd(F.avg(F.pow(F.col("score") - F.col("outcome"), F.lit(2.0)))).alias("brier_score"),
    )
    gap = F.sum(F.col("count") * F.abs(F.col("mean_score") - F.col("accuracy"))) / F.sum("count")
    return side_by_side(prf(counts), reliability_bins(scored, bins).agg(rnd(gap).alias("ece")))


def retrieval_metrics(ranked: DataFrame, gold_counts: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Recall@k, precision@k, MRR and nDCG@k per query; ``ranked`` is ``query, rank, relevance``."""
    top = ranked.where(F.col("rank") <= k)
    gain = F.col("relevance") / F.log2(F.col("rank") + 1.0)
    found = top.groupBy(query).agg(
        F.sum("relevance").alias("hits"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"), F.count("*").alias("shown")
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.col("relevant"))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = gold_counts.join(found, query, "left").fillna(0, ["hits", "dcg", "shown"])
    return out.select(
        query, rnd(ratio("hits", "relevant")).alias("recall_at_k"), rnd(F.col("hits") / F.lit(k)).alias("precision_at_k"),
        rnd(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), rnd(F.when(F.col("relevant") > 0, F.col("dcg") / best).otherwise(F.lit(0.0))).alias("ndcg"),
    )


def hallucination(checked: DataFrame) -> DataFrame:
    """Unsupported and grounded shares from sentence counts ``supported, total``."""
    return checked.agg(
        rnd(1.0 - ratio(F.sum("supported"), F.sum("total"))).alias("unsupported_claim_rate"),
        rnd(F.avg((F.col("supported") == F.col("total")).cast("double"))).alias("grounded_answer_rate"),
    )
