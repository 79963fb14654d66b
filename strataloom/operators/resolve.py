"""Canonical nodes and edges, entity resolution, reviews and the registry.

Aliases and provenance grow with the data, so they are child tables
(``canonical_id, alias`` and ``canonical_id, source_id, chunk_idx``), never
arrays inside a node row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.ids import entity_id, norm_label_2, relation_id
from strataloom.functions.numeric import clamp, count_if, ratio, rnd
from strataloom.functions.text import norm_label, strip, tokens
from strataloom.operators import vectors
from strataloom.session import cut_lineage

MERGE, REVIEW = 0.72, 0.58
# Weights of (embedding, jaccard, exact) in the two rule sets.
WEIGHTS = {1: (0.45, 0.35, 0.20), 2: (0.20, 0.35, 0.45)}
HINT_LIMIT = 0.12

Embed = Callable[[DataFrame, str, str], DataFrame]


def nodes(entities: DataFrame, source: str = "source_id") -> DataFrame:
    """Canonical nodes from entity rows ``source, text, type, label[, chunk_idx]``.

    The label, NER label and first source come from the smallest
    (source, chunk, text); only counts and firsts are kept per node.
    """
    named = entities.withColumn("text", strip("text")).where("text <> ''")
    place = F.struct(F.col(source), F.col("chunk_idx"), F.col("text"))
    return named.groupBy(entity_id("type", "text").alias("canonical_id")).agg(
        F.min_by("text", place).alias("label"), F.first("type").alias("entity_type"), F.min_by("label", place).alias("ner_label"),
        F.lit(0.65).alias("confidence"), F.min(source).alias("first_source"), F.count("*").alias("mentions"),
        F.count_distinct("text").alias("alias_count"),
    )


def aliases(entities: DataFrame) -> DataFrame:
    """Child table ``canonical_id, alias``."""
    return entities.select(entity_id("type", "text").alias("canonical_id"), strip("text").alias("alias")).where("alias <> ''").distinct()


def provenance(entities: DataFrame, source: str = "source_id") -> DataFrame:
    """Child table ``canonical_id, source_id, chunk_idx``."""
    return entities.select(entity_id("type", "text").alias("canonical_id"), F.col(source).alias("source_id"), "chunk_idx").distinct()


def edges(relations: DataFrame, entities: DataFrame, source: str = "source_id") -> DataFrame:
    """Canonical edges: blank and self pairs dropped, labels looked up per source, typed entities preferred.

    A label without an entity gets the id of an untyped entity.
    """
    if source == "source":
        raise ValueError("name the file column differently from the relation's source label")
    place = F.struct((F.col("type") == "entity").cast("int"), F.col("type"))
    known = entities.groupBy(F.col(source), strip("text").alias("name")).agg(F.min_by(entity_id("type", "text"), place).alias("id"))
    rel = relations.withColumn("source", strip("source")).withColumn("target", strip("target")).where(
        (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    )
    for side in ("source", "target"):
        look = known.select(F.col(source), F.col("name").alias(side), F.col("id").alias(f"{side}_known"))
        rel = rel.join(look, [source, side], "left").withColumn(
            f"{side}_canonical_id", F.coalesce(f"{side}_known", entity_id(F.lit("entity"), side))
        )
    return rel.select(
        relation_id("source_canonical_id", "relation", "target_canonical_id", "chunk_idx").alias("canonical_relation_id"),
        "source_canonical_id", "target_canonical_id", "relation", F.lit(0.55).alias("confidence"), source, "chunk_idx", "context",
    )


NODE_FIELDS = ("canonical_id", "label", "entity_type", "confidence")
EDGE_FIELDS = ("canonical_relation_id", "source_canonical_id", "target_canonical_id", "relation", "confidence")


def check(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Schema findings ``finding, subject, detail``: missing fields, duplicate ids, dangling ends."""
    def missing(df, fields, subject):
        lost = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
        return df.where(F.size(lost) > 0).select(F.lit("missing_fields").alias("finding"), F.col(subject).alias("subject"), F.array_join(lost, ",").alias("detail"))

    twice = node_rows.groupBy("canonical_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicate_id").alias("finding"), F.col("canonical_id").alias("subject"), F.col("n").cast("string").alias("detail")
    )
    ids = node_rows.select("canonical_id").distinct()
    out = missing(node_rows, NODE_FIELDS, "canonical_id").unionByName(missing(edge_rows, EDGE_FIELDS, "canonical_relation_id")).unionByName(twice)
    for side in ("source", "target"):
        end = f"{side}_canonical_id"
        lost = edge_rows.join(ids.withColumnRenamed("canonical_id", end), end, "left_anti")
        out = out.unionByName(lost.select(F.lit(f"{side}_not_found").alias("finding"), F.col("canonical_relation_id").alias("subject"), F.col(end).alias("detail")))
    return out


def check_report(findings: DataFrame, node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    from strataloom.operators.profile import side_by_side

    one = side_by_side(
        node_rows.agg(F.count("*").alias("node_count")), edge_rows.agg(F.count("*").alias("edge_count")), findings.agg(F.count("*").alias("error_count"))
    )
    return one.withColumn("valid", F.col("error_count") == 0)


def _pool(node_rows: DataFrame, registry: DataFrame | None, registry_aliases: DataFrame | None, gen: int) -> DataFrame:
    """Everything a node may merge into: registry entries (order -1) and batch nodes, one row per name."""
    cols = ["canonical_id", "entity_type", "label", "order"]
    pool = node_rows.select(*cols).withColumn("name", F.col("label"))
    if registry is not None:
        old = registry.select("canonical_id", "entity_type", "label", F.lit(-1).cast("long").alias("order"))
        names = old.withColumn("name", F.col("label"))
        if registry_aliases is not None:
            more = old.join(registry_aliases.withColumnRenamed("alias", "name"), "canonical_id").select(*names.columns)
            names = names.unionByName(more).distinct()
        pool = pool.unionByName(names)
    norm = norm_label("name") if gen == 1 else norm_label_2("name")
    words = F.array_sort(tokens("name")) if gen == 1 else F.array_sort(F.array_distinct(F.split(norm, " ")))
    return pool.withColumn("norm", norm).withColumn("tokens", words).withColumn("set_id", F.sha2(F.concat_ws("\u0001", "tokens"), 256))


def candidates(node_rows: DataFrame, registry: DataFrame | None = None, registry_aliases: DataFrame | None = None, gen: int = 1, hinted: bool = False) -> DataFrame:
    """Blocked candidate pairs ``source_id, target_id, exact, lexical``; targets come earlier in the order.

    Below the review score nothing matters, and the embedding alone cannot
    reach it, so a pair needs the same normal form or a token overlap the
    weights imply. Names with the same normal form (or token set) and type are
    represented by their first node, so a hot name gives a star of pairs, not
    all pairs; every member still reaches the same root.
    """
    emb, lex, _ = WEIGHTS[gen]
    slack = HINT_LIMIT if hinted else 0.0
    least = (REVIEW - emb - slack - (0.05 if gen == 2 else 0.0)) / lex
    threshold = max(0.02, least - 1e-6)
    pool = _pool(node_rows, registry, registry_aliases, gen)
    fresh = _pool(node_rows, None, None, gen)
    first = F.min(F.struct("order", "canonical_id")).alias("head")
    me = fresh.select(F.col("canonical_id").alias("source_id"), F.col("entity_type").alias("source_type"), F.col("order").alias("source_order"), "norm", "set_id")

    def compatible(df):
        same = F.col("source_type") == F.col("target_type")
        fits = same if gen == 2 else same | (F.col("source_type") == "entity") | (F.col("target_type") == "entity")
        return df.where(fits & (F.col("head.order") < F.col("source_order")) & (F.col("head.canonical_id") != F.col("source_id")))

    by_norm = pool.where("norm <> ''").groupBy("norm", F.col("entity_type").alias("target_type")).agg(first)
    exact = compatible(me.join(by_norm, "norm")).select("source_id", F.col("head.canonical_id").alias("target_id"), F.lit(1.0).alias("exact"))
    sets = set_scores(fresh, pool, threshold)
    by_set = pool.groupBy(F.col("set_id").alias("right_set"), F.col("entity_type").alias("target_type")).agg(first)
    lexical = compatible(me.join(sets.withColumnRenamed("left_set", "set_id"), "set_id").join(by_set, "right_set")).select(
        "source_id", F.col("head.canonical_id").alias("target_id"), F.col("score").alias("lexical")
    )
    both = exact.withColumn("lexical", F.lit(None).cast("double")).unionByName(lexical.withColumn("exact", F.lit(0.0)))
    return both.groupBy("source_id", "target_id").agg(F.max("exact").alias("exact"), F.coalesce(F.max("lexical"), F.lit(0.0)).alias("lexical"))


def set_scores(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Jaccard of token sets with at least one token."""
    some = F.size("tokens") > 0
    return vectors.set_pairs(left.where(some), right.where(some), threshold)


def score(pairs: DataFrame, labels: DataFrame, embed: Embed, gen: int = 1, hints: DataFrame | None = None, priors: DataFrame | None = None) -> DataFrame:
    """Add ``embedding`` and ``score`` to candidate pairs. ``labels`` is ``canonical_id, label``."""
    sparse = embed(labels, "canonical_id", "label")
    out = vectors.sparse_cosine(pairs, sparse, sparse, "source_id", "target_id")
    emb, lex, exact = WEIGHTS[gen]
    near = clamp((F.col("dot") + 1.0) / 2.0) if gen == 1 else clamp(F.col("dot"))
    total = emb * near + lex * F.col("lexical") + exact * F.col("exact")
    if hints is not None:
        for side in ("source", "target"):
            h = hints.select(F.col("canonical_id").alias(f"{side}_id"), F.col("hint").alias(f"{side}_hint"))
            out = out.join(h, f"{side}_id", "left").fillna(0.0, [f"{side}_hint"])
        total = total + clamp((F.col("source_hint") + F.col("target_hint")) / 2.0, -HINT_LIMIT, HINT_LIMIT)
    if priors is not None:
        out = out.join(priors.select(F.col("canonical_id").alias("source_id"), "prior"), "source_id", "left")
        total = F.least(F.lit(1.0), total + 0.1 * (F.coalesce("prior", F.lit(0.5)) - 0.5))
    return out.select("source_id", "target_id", "exact", "lexical", near.alias("embedding"), clamp(total).alias("score"))


def decide(scored: DataFrame, order: DataFrame) -> DataFrame:
    """Best candidate per node (ties to the earlier target) and the decision by threshold."""
    ranked = scored.join(order.select(F.col("canonical_id").alias("target_id"), F.col("order").alias("target_order")), "target_id", "left").fillna(-1, ["target_order"])
    best = F.max(F.struct(F.round("score", 9).alias("rank"), (-F.col("target_order")).alias("early"), "target_id", "score", "exact", "lexical", "embedding"))
    decision = F.when(F.col("score") >= MERGE, "merge_similarity").when(F.col("score") >= REVIEW, "new_pending_review").otherwise("new_entity")
    return ranked.groupBy("source_id").agg(best.alias("b")).select(
        "source_id", F.col("b.target_id").alias("candidate_id"), F.col("b.score").alias("score"), F.col("b.exact").alias("exact"),
        F.col("b.lexical").alias("lexical"), F.col("b.embedding").alias("embedding"),
    ).withColumn("decision", decision)


def follow(pointers: DataFrame, rounds: int = 40) -> DataFrame:
    """Roots of a pointer forest ``source_id, target_id`` by pointer jumping."""
    now = cut_lineage(pointers)
    for _ in range(rounds):
        ahead = now.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("next"))
        step = now.join(ahead, "target_id", "left").select("source_id", F.coalesce("next", "target_id").alias("target_id"), F.col("next").isNotNull().alias("moved"))
        step = cut_lineage(step)
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError("pointer chains longer than 2^rounds: the pointers hold a cycle")


def resolve(
    node_rows: DataFrame, registry: DataFrame | None = None, registry_aliases: DataFrame | None = None, embed: Embed | None = None, gen: int = 1,
    hints: DataFrame | None = None, priors: DataFrame | None = None,
) -> DataFrame:
    """Decisions ``source_id, target_id, decision, score, candidate_id, ...`` for every node.

    ``node_rows`` has ``canonical_id, label, entity_type, order`` (unique
    order). A known id merges; other nodes point to their best earlier target,
    and pointers are followed to the root, which is what a one-by-one scan of
    the batch gives except where aliases gained on the way would change a
    later score.
    """
    embed = embed or (lambda df, key, text: vectors.hash_embed(df, key, text, gen=gen))
    rest, same = node_rows, None
    if registry is not None:
        ids = registry.select("canonical_id").distinct()
        same = node_rows.join(ids, "canonical_id", "left_semi").select(F.col("canonical_id").alias("source_id"))
        rest = node_rows.join(ids, "canonical_id", "left_anti")
    pairs = cut_lineage(candidates(rest, registry, registry_aliases, gen, hints is not None))
    labels = rest.select("canonical_id", "label")
    if registry is not None:
        labels = labels.unionByName(registry.select("canonical_id", "label"))
    used = pairs.select(F.explode(F.array("source_id", "target_id")).alias("canonical_id")).distinct()
    decided = decide(score(pairs, labels.join(used, "canonical_id", "left_semi"), embed, gen, hints, priors), rest)
    decided = cut_lineage(decided)
    merges = decided.where("decision = 'merge_similarity'").select("source_id", F.col("candidate_id").alias("target_id"))
    roots = follow(merges)
    out = rest.select(F.col("canonical_id").alias("source_id")).join(decided, "source_id", "left").join(roots, "source_id", "left").select(
        "source_id", F.coalesce("target_id", "source_id").alias("target_id"), F.coalesce("decision", F.lit("new_entity")).alias("decision"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "candidate_id", "exact", "lexical", "embedding",
    )
    if same is not None:
        out = out.unionByName(
            same.select("source_id", F.col("source_id").alias("target_id"), F.lit("merge_id").alias("decision"), F.lit(1.0).alias("score")), allowMissingColumns=True
        )
    return out


def merge_confidence(members: DataFrame) -> DataFrame:
    """Fold confidences of merged nodes in order: ``min(.98, .8 old + .2 new)``.

    ``members`` is ``canonical_id, order, confidence``. The fold is a weighted
    sum (weights .8^k from the last member back) over all members, computed as
    an aggregate with positions that several tasks number.
    """
    from strataloom.operators.ranks import row_index

    total = members.groupBy("canonical_id").agg(F.count("*").alias("members"))
    weight = F.when(F.col("k") == F.col("members") - 1, F.pow(F.lit(0.8), F.col("k"))).otherwise(0.2 * F.pow(F.lit(0.8), F.col("k")))
    placed = row_index(members, "order", by=["canonical_id"], name="nth").join(total, "canonical_id").withColumn("k", F.col("members") - 1 - F.col("nth"))
    return placed.groupBy("canonical_id", "members").agg(
        rnd(F.least(F.lit(0.98), F.sum(weight * F.col("confidence")))).alias("confidence")
    )


def merge(node_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Registry rows after a batch: one row per root with folded confidence and member count."""
    placed = node_rows.join(decisions.select(F.col("source_id").alias("canonical_id"), F.col("target_id").alias("root")), "canonical_id")
    first = F.struct((F.col("canonical_id") != F.col("root")).cast("int"), "order")
    heads = placed.groupBy("root").agg(F.min_by("label", first).alias("label"), F.min_by("entity_type", first).alias("entity_type"))
    folded = merge_confidence(placed.select(F.col("root").alias("canonical_id"), "order", "confidence"))
    return heads.withColumnRenamed("root", "canonical_id").join(folded, "canonical_id")


def remap(edge_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edge ends replaced by their roots."""
    out = edge_rows
    for side in ("source", "target"):
        end = f"{side}_canonical_id"
        to = decisions.select(F.col("source_id").alias(end), F.col("target_id").alias("_to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out


def resolution_report(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("nodes_input"), count_if(F.col("decision").startswith("merge")).alias("merged_count"),
        count_if(F.col("decision").startswith("new")).alias("created_count"), count_if(F.col("decision") == "new_pending_review").alias("pending_review_count"),
    )


def reviews(table: DataFrame, status: str | None = "pending", limit: int = 100) -> DataFrame:
    """Newest reviews of a status; ``limit`` stays within 1 and 500."""
    out = table.where(F.lower("status") == status.strip().lower()) if status else table
    return out.orderBy(F.desc("created_at"), "review_id").limit(max(1, min(limit, 500)))


def apply_reviews(table: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews after decisions (``review_id, decision``) and the approved merges ``source_id, target_id``."""
    valid = decisions.where(F.lower("decision").isin("approve", "reject")).select("review_id", F.lower("decision").alias("_d"))
    joined = table.join(valid, "review_id", "left")
    open_ = (F.col("status") == "pending") & F.col("_d").isNotNull()
    status = F.when(open_, F.when(F.col("_d") == "approve", "approved").otherwise("rejected")).otherwise(F.col("status"))
    merges = joined.where(open_ & (F.col("_d") == "approve") & (F.col("source_id") != F.col("target_id"))).select("source_id", "target_id")
    return joined.withColumn("status", status).drop("_d"), merges


def split_alias(node_rows: DataFrame, alias_rows: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split aliases off their nodes.

    ``splits`` is ``canonical_id, alias[, entity_type]``. Gives nodes, alias
    rows and history ``canonical_id, new_id, alias``; unknown aliases and
    taken ids are left alone, and a node keeps its last alias.
    """
    kind = F.coalesce("new_type", "entity_type") if "entity_type" in splits.columns else F.col("entity_type")
    wanted = splits.withColumnRenamed("entity_type", "new_type") if "entity_type" in splits.columns else splits
    found = alias_rows.join(wanted, ["canonical_id", "alias"]).join(node_rows.select("canonical_id", "entity_type", "confidence"), "canonical_id")
    made = found.withColumn("new_id", entity_id(kind, "alias")).withColumn("new_type", kind)
    made = made.join(node_rows.select(F.col("canonical_id").alias("new_id")), "new_id", "left_anti")
    fresh = made.select(
        F.col("new_id").alias("canonical_id"), F.col("alias").alias("label"), F.lower("new_type").alias("entity_type"), F.least(F.lit(0.9), F.col("confidence")).alias("confidence")
    )
    count = alias_rows.groupBy("canonical_id").agg(F.count("*").alias("n"))
    gone = made.join(count, "canonical_id").where("n > 1").select("canonical_id", "alias")
    kept = alias_rows.join(gone, ["canonical_id", "alias"], "left_anti")
    new_aliases = made.select(F.col("new_id").alias("canonical_id"), "alias")
    nodes_out = node_rows.select("canonical_id", "label", "entity_type", "confidence").unionByName(fresh)
    return nodes_out, kept.select("canonical_id", "alias").unionByName(new_aliases), made.select("canonical_id", "new_id", "alias")


def metrics(node_rows: DataFrame, alias_rows: DataFrame, review_rows: DataFrame | None = None) -> DataFrame:
    """Registry totals in one row; the type list is bounded by the type system."""
    from strataloom.operators.profile import side_by_side

    parts = [
        node_rows.agg(F.count("*").alias("canonical_node_count"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("entity_types")),
        alias_rows.agg(F.count("*").alias("total_alias_count")),
    ]
    if review_rows is not None:
        parts.append(review_rows.agg(
            count_if(F.col("status") == "pending").alias("pending_review_count"), count_if(F.col("status") != "pending").alias("resolved_review_count")
        ))
    return side_by_side(*parts).withColumn("avg_aliases_per_node", rnd(ratio("total_alias_count", F.greatest(F.lit(1), F.col("canonical_node_count"))), 2))

