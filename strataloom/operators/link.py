"""Links between database and text entities, across files, and between documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.numeric import as_col, clamp, count_if, first_match, flags, ratio, rnd
from strataloom.functions.text import norm_label, strip, tokens
from strataloom.operators import vectors
from strataloom.operators.graph import components
from strataloom.session import cut_lineage

LEXICAL_GATE, SEMANTIC_GATE, EMBEDDING_GATE = 0.55, 0.5, 0.68
ACCEPT, REVIEW = 0.84, 0.72
# Label words and the semantic label they stand for.
KEYWORDS = (
    ("identifier", ("id", "key", "identifier")),
    ("time", ("date", "time", "timestamp")),
    ("measure", ("price", "amount", "cost", "revenue", "total")),
    ("descriptor", ("name", "title", "description", "category", "type", "status")),
)


def semantic_labels(label, kind, hints=None) -> Column:
    """Distinct semantic labels of a node: hints, type and keyword groups."""
    norm = norm_label(label)
    low = F.lower(strip(as_col(kind)))
    groups = flags((low != "", low), *[(norm.rlike("|".join(words)), name) for name, words in KEYWORDS])
    return F.array_distinct(F.concat(F.coalesce(as_col(hints), F.array().cast("array<string>")), groups)) if hints is not None else F.array_distinct(groups)


def compatibility(left, right) -> Column:
    """1 on a shared label, .65 when a side is unknown, .6 when a side has none, else .25."""
    left, right = as_col(left), as_col(right)
    return first_match(
        ((F.size(left) == 0) | (F.size(right) == 0), 0.6), (F.arrays_overlap(left, right), 1.0),
        (F.array_contains(left, "unknown") | F.array_contains(right, "unknown"), 0.65), other=0.25,
    )


def db_hints(labelled: DataFrame, classed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``canonical_id, hints``: table or column labels for schema nodes, by equality on the lower label."""
    tables = classed.select(F.lower("table").alias("name"), F.array(F.lower("table_label"), F.lit("table")).alias("hints"), F.lit(0).alias("rank"))
    cols = labelled.select(
        F.lower(F.concat("table", F.lit("."), "column")).alias("name"), F.array(F.lower("label"), F.lit("column")).alias("hints"), F.lit(1).alias("rank")
    )
    named = nodes.select("canonical_id", F.lower(strip("label")).alias("name"))
    return named.join(tables.unionByName(cols), "name").groupBy("canonical_id").agg(F.min_by("hints", "rank").alias("hints"))


def evidence_boost(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``canonical_id, boost``: up to .08 by the mean overlap of evidence keys that hold the label.

    The label must equal a run of words of the key; keys are schema-sized, so
    their word runs are exploded and joined by equality.
    """
    norm = F.split(norm_label("evidence_key"), " ")
    size = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, size), lambda j: F.array_join(F.slice(F.col("w"), i, j - i + 1), " "))))
    keys = evidence.select("evidence_key", "overlap_pct", norm.alias("w")).select("evidence_key", "overlap_pct", F.explode(F.array_distinct(runs)).alias("norm"))
    hits = nodes.select("canonical_id", norm_label("label").alias("norm")).where("norm <> ''").join(F.broadcast(keys), "norm")
    return hits.groupBy("canonical_id").agg(F.least(F.lit(0.08), 0.08 * F.avg(clamp("overlap_pct"))).alias("boost"))


GRAM = 3


def _grams(c, q: int) -> Column:
    text = as_col(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, F.lit(q))))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs ``short, long`` of distinct texts where the first is part of the second.

    A text is looked up under its rarest gram (its own length up to 3), so the
    join is by equality and common grams are keys only for texts that hold
    nothing rarer. Exploded grams are many times the file they come from, which
    Spark's estimate does not show: these joins are never broadcast. Texts of
    one or two characters are few and are sent to the grams.
    """
    out = None
    for q in range(1, GRAM + 1):
        mine = short.where(F.length("text") >= q if q == GRAM else F.length("text") == q)
        base = long.where(F.length("text") >= q).select(F.col("text").alias("long"), F.explode(_grams("text", q)).alias("gram"))
        if q == GRAM:
            df = base.groupBy("gram").agg(F.count("*").alias("df"))
            grams = mine.select("text", F.explode(_grams("text", q)).alias("gram")).join(df.hint("merge"), "gram")
            # A gram no long text has rules the text out: an inner join would hide it, so all grams must be found.
            need = mine.select("text", F.size(_grams("text", q)).alias("need"))
            keyed = grams.groupBy("text").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count("*").alias("have")).join(need.hint("merge"), "text").where("have = need")
            keyed = keyed.select(F.col("text").alias("short"), "gram").hint("merge")
        else:
            keyed = F.broadcast(mine.select(F.col("text").alias("short"), F.col("text").alias("gram")))
        hit = keyed.join(base, "gram").where(F.col("long").contains(F.col("short"))).select("short", "long")
        out = hit if out is None else out.unionByName(hit)
    return out


def lexical_pairs(source: DataFrame, target: DataFrame, gate: float = LEXICAL_GATE) -> DataFrame:
    """Candidate pairs with lexical score ``max(exact, containment, jaccard)`` at or above the gate.

    Both sides have ``canonical_id, label`` and optionally ``alias_text``
    (label and aliases joined by blanks).
    """
    def shape(df, side):
        text = F.concat_ws(" ", "label", "alias_text") if "alias_text" in df.columns else F.concat_ws(" ", "label", "label")
        words = F.array_sort(tokens(text))
        return df.select(
            F.col("canonical_id").alias(f"{side}_id"), norm_label("label").alias(f"{side}_norm"), words.alias("tokens"), F.sha2(F.concat_ws("\u0001", words), 256).alias("set_id")
        )

    s, t = shape(source, "source"), shape(target, "target")
    some = F.size("tokens") > 0
    sets = vectors.set_pairs(s.where(some), t.where(some), gate)
    by_tokens = (
        s.select("source_id", F.col("set_id").alias("left_set")).join(sets.hint("merge"), "left_set").join(t.select("target_id", F.col("set_id").alias("right_set")).hint("merge"), "right_set")
        .select("source_id", "target_id", F.lit(0.0).alias("containment"), F.col("score").alias("jaccard"))
    )
    sn = s.select(F.col("source_norm").alias("text")).where("text <> ''").distinct()
    tn = t.select(F.col("target_norm").alias("text")).where("text <> ''").distinct()
    within = contained(sn, tn).toDF("source_norm", "target_norm").unionByName(contained(tn, sn).toDF("target_norm", "source_norm").select("source_norm", "target_norm")).distinct()
    by_part = within.join(s.select("source_id", "source_norm").hint("merge"), "source_norm").join(t.select("target_id", "target_norm").hint("merge"), "target_norm").select(
        "source_id", "target_id", F.lit(1.0).alias("containment"), F.lit(0.0).alias("jaccard")
    )
    return (
        by_tokens.unionByName(by_part).where("source_id <> target_id").groupBy("source_id", "target_id")
        .agg(F.max("containment").alias("containment"), F.max("jaccard").alias("jaccard"))
        .withColumn("lexical", F.greatest("containment", "jaccard"))
    )


def cross_source(source: DataFrame, target: DataFrame, edges: DataFrame | None = None, evidence: DataFrame | None = None, hints: DataFrame | None = None, embed=None) -> DataFrame:
    """One decision row per source node, and one row per pair stopped at a gate.

    ``source_id, target_id, lexical, semantic, embedding, boost, score, state,
    reason``. Gates run from cheap to dear: token and gram joins, then labels,
    then vectors for the pairs that are left. The best target (earlier id on
    ties) decides the state; existing edges are skipped.
    """
    embed = embed or (lambda df, key, text: vectors.hash_vectors(df, key, text))
    pairs = cut_lineage(lexical_pairs(source, target))

    def side(df, name, h=None):
        text = F.concat_ws(" ", "label", "alias_text") if "alias_text" in df.columns else F.concat_ws(" ", "label", "label")
        base = df.select("canonical_id", text.alias("text"), "label", "entity_type")
        if h is not None:
            base = base.join(h, "canonical_id", "left")
        labels = semantic_labels("label", "entity_type", "hints" if h is not None else None)
        return base.select(F.col("canonical_id").alias(f"{name}_id"), labels.alias(f"{name}_labels"), "text")

    s, t = side(source, "source", hints), side(target, "target")
    gated = (
        pairs.join(s.drop("text").hint("merge"), "source_id").join(t.drop("text").hint("merge"), "target_id")
        .withColumn("semantic", compatibility("source_labels", "target_labels")).drop("source_labels", "target_labels")
    )
    passed = gated.where(F.col("semantic") >= SEMANTIC_GATE)
    scored = vectors.pair_dots(passed, embed(s, "source_id", "text"), embed(t, "target_id", "text"), "source_id", "target_id").withColumn(
        "embedding", clamp((F.col("dot") + 1.0) / 2.0)
    ).drop("dot")
    boost = F.lit(0.0)
    if evidence is not None:
        scored = scored.join(evidence_boost(source, evidence).withColumnRenamed("canonical_id", "source_id"), "source_id", "left")
        boost = F.coalesce("boost", F.lit(0.0))
    base = clamp(0.45 * F.col("lexical") + 0.20 * F.col("semantic") + 0.35 * F.col("embedding"))
    # Three outputs read the scored pairs; they are computed once.
    scored = cut_lineage(scored.withColumn("boost", boost).withColumn("score", rnd(clamp(base + F.col("boost")))))
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    best = scored.where(F.col("embedding") >= EMBEDDING_GATE).withColumn("_r", rank).where("_r = 1").drop("_r")
    known = F.lit(False)
    if edges is not None:
        have = edges.where("relation = 'cross_source_related'").select(
            F.col("source_canonical_id").alias("source_id"), F.col("target_canonical_id").alias("target_id"), F.lit(True).alias("known")
        ).distinct()
        best = best.join(have.hint("merge"), ["source_id", "target_id"], "left")
        known = F.coalesce("known", F.lit(False))
    state = first_match((known, "rejected"), (F.col("score") >= ACCEPT, "accepted"), (F.col("score") >= REVIEW, "review"), other="rejected")
    reason = first_match((known, "edge_already_exists"), (F.col("score") >= REVIEW, None), other="score_below_review_threshold")
    cols = ["source_id", "target_id", "lexical", "semantic", "embedding", "boost", "score", "state", "reason"]
    best = best.withColumn("state", state).withColumn("reason", reason).select(*cols)
    null = F.lit(None).cast("double")
    stopped = gated.where(F.col("semantic") < SEMANTIC_GATE).select(
        "source_id", "target_id", "lexical", "semantic", null.alias("embedding"), null.alias("boost"), null.alias("score"), F.lit("rejected").alias("state"), F.lit("semantic_gate_failed").alias("reason")
    ).unionByName(scored.where(F.col("embedding") < EMBEDDING_GATE).select(
        "source_id", "target_id", "lexical", "semantic", "embedding", null.alias("boost"), null.alias("score"), F.lit("rejected").alias("state"), F.lit("embedding_gate_failed").alias("reason")
    ))
    alone = source.select(F.col("canonical_id").alias("source_id")).distinct().join(best.select("source_id").hint("merge"), "source_id", "left_anti").select(
        "source_id", F.lit("rejected").alias("state"), F.lit("no_candidate_passing_gates").alias("reason")
    )
    return best.unionByName(stopped).unionByName(alone, allowMissingColumns=True)


def link_stats(decisions: DataFrame, source: DataFrame) -> DataFrame:
    from strataloom.operators.profile import side_by_side

    one = side_by_side(
        decisions.agg(*[count_if(F.col("state") == s).alias(f"{s}_count") for s in ("accepted", "review", "rejected")]),
        source.agg(F.count_distinct("canonical_id").alias("source_node_count")),
    )
    return one.withColumn("linked_source_coverage_pct", rnd(100.0 * ratio("accepted_count", F.greatest(F.lit(1), F.col("source_node_count"))), 2))


def accepted_edges(decisions: DataFrame) -> DataFrame:
    return decisions.where("state = 'accepted'").select(
        F.col("source_id").alias("source_canonical_id"), F.col("target_id").alias("target_canonical_id"), F.lit("cross_source_related").alias("relation"),
        F.col("score").alias("confidence"), F.lit("CROSS_SOURCE").alias("edge_type"),
    )


def apply_review(reviews: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link reviews after decisions, and the approved edges."""
    from strataloom.operators.resolve import apply_reviews

    updated, merges = apply_reviews(reviews, decisions)
    approved = updated.join(merges, ["source_id", "target_id"], "left_semi").where("status = 'approved'")
    return updated, approved.select(
        F.col("source_id").alias("source_canonical_id"), F.col("target_id").alias("target_canonical_id"), F.lit("cross_source_related").alias("relation"), F.col("score").alias("confidence")
    )


def metrics(decisions: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Link counts, their shares and the review backlog in one row."""
    from strataloom.operators.profile import side_by_side

    names = {"accepted": "accepted_links", "review": "pending_links", "rejected": "rejected_links"}
    one = decisions.agg(*[count_if(F.col("state") == s).alias(n) for s, n in names.items()])
    if reviews is not None:
        one = side_by_side(one, reviews.agg(*[count_if(F.col("status") == s).alias(f"reviews_{s}") for s in ("pending", "approved", "rejected")]))
    total = F.greatest(F.lit(1), F.col("accepted_links") + F.col("pending_links") + F.col("rejected_links"))
    for kind in ("accepted", "pending", "rejected"):
        one = one.withColumn(f"{kind}_ratio_pct", rnd(100.0 * F.col(f"{kind}_links") / total, 2))
    return one


# --- across files ------------------------------------------------------------------------


def shared_aliases(nodes: DataFrame, file: str = "source_id") -> DataFrame:
    """Aliases found in more than one file: ``alias, files, canonical_ids, kind``.

    One id means the same entity; several ids mean canonical drift. The files
    of an alias stay rows of the input (``alias, file``): a name that a third
    of all files hold is one output row, not a list of file pairs.
    """
    rows = nodes.select(F.col(file).alias("file"), F.lower(strip("alias")).alias("alias"), "canonical_id").where("alias <> ''").distinct()
    return rows.groupBy("alias").agg(
        F.count_distinct("file").alias("files"), F.count_distinct("canonical_id").alias("canonical_ids"), F.min("canonical_id").alias("first_id")
    ).where("files > 1").withColumn("kind", F.when(F.col("canonical_ids") == 1, "same_entity").otherwise("canonical_drift"))


def shared_ids(nodes: DataFrame, file: str = "source_id") -> DataFrame:
    """Canonical ids held by more than one file, with the number of files."""
    rows = nodes.select(F.col(file).alias("file"), "canonical_id").distinct()
    return rows.groupBy("canonical_id").agg(F.count("*").alias("files")).where("files > 1")


def synonym_conflicts(nodes: DataFrame, more_than: int = 8, file: str = "source_id") -> DataFrame:
    """Ids linked over more than eight shared aliases."""
    shared = shared_aliases(nodes, file).where("kind = 'same_entity'")
    return shared.groupBy(F.col("first_id").alias("canonical_id")).agg(F.count("*").alias("alias_count")).where(F.col("alias_count") > more_than)


LARGE_FILE = 10_000


def _file_names(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.select(F.col(file).cast("string").alias("file"), F.lower(strip("alias")).alias("alias")).where("alias <> ''").distinct()


def document_overlap(nodes: DataFrame, threshold: float = 0.1, file: str = "source_id", large: int = LARGE_FILE, more_than: int = 0) -> DataFrame:
    """File pairs where at least ``threshold`` of the first file's aliases are shared.

    Files of up to ``large`` aliases are compared as sets by a containment join
    (rare aliases index them), so a name in a third of the files does not pair
    them all up. A larger file is never gathered into a row: its aliases are
    joined and counted, each alias meeting the few large files that hold it.
    Files that share less than the threshold are never formed. ``more_than``
    leaves out first files with that many aliases or fewer.
    """
    names = cut_lineage(_file_names(nodes, file))
    sizes = names.groupBy("file").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > large).select("file")
    sets = names.join(big, "file", "left_anti").groupBy("file").agg(F.array_sort(F.collect_set("alias")).alias("tokens")).withColumnRenamed("file", "set_id")
    firsts = sets.where(F.size("tokens") > more_than)
    small = vectors.set_pairs(firsts, sets, threshold, "containment").where("left_set <> right_set").join(
        sets.select(F.col("set_id").alias("left_set"), F.size("tokens").alias("n")), "left_set"
    ).select(F.col("left_set").alias("source_file"), F.col("right_set").alias("other_file"), F.round(F.col("score") * F.col("n")).cast("long").alias("shared"), F.col("n").cast("long").alias("n"))
    mine = names.join(big, "file", "left_semi").select(F.col("file").alias("big"), "alias")
    met = mine.join(names.withColumnRenamed("file", "other"), "alias").where("big <> other").groupBy("big", "other").agg(F.count("*").alias("shared"))
    forth = met.select(F.col("big").alias("source_file"), F.col("other").alias("other_file"), "shared")
    back = met.join(big.withColumnRenamed("file", "other"), "other", "left_anti").select(F.col("other").alias("source_file"), F.col("big").alias("other_file"), "shared")
    counted = forth.unionByName(back).join(sizes.withColumnRenamed("file", "source_file"), "source_file").where(F.col("n") > more_than)
    out = small.unionByName(counted).withColumn("ratio", F.col("shared") / F.col("n")).where(F.col("ratio") >= threshold - 1e-12)
    return out.select("source_file", "other_file", F.col("shared").alias("shared_entity_count"), rnd("ratio").alias("overlap_ratio"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Duplicate documents by checksum: ``key, checksum, duplicate_of, copies``; no list of copies is built."""
    sums = docs.select(key, F.sha2(F.encode(text, "UTF-8"), 256).alias("checksum"))
    groups = sums.groupBy("checksum").agg(F.count("*").alias("copies"), F.min(key).alias("duplicate_of")).where("copies > 1")
    return sums.join(groups, "checksum").where(F.col(key) != F.col("duplicate_of")).select(key, "checksum", "duplicate_of", "copies")


def clusters(nodes: DataFrame, threshold: float = 0.1, file: str = "source_id") -> DataFrame:
    """``file, cluster, size``: components of files whose overlap reaches the threshold.

    A file with few aliases reaches it through any shared one, so such a file
    makes the alias a hub that joins all its files; the pairs of larger files
    come from the containment join.
    """
    names = _file_names(nodes, file)
    sizes = names.groupBy("file").agg(F.count("*").alias("n"))
    few = int(1.0 / threshold + 1e-9)
    small = names.join(sizes.where(F.col("n") <= few), "file", "left_semi").select("alias").distinct()
    hubs = names.join(small, "alias", "left_semi").select(F.col("file").alias("source"), F.concat(F.lit("alias:"), "alias").alias("target"))
    over = document_overlap(nodes, threshold, file, more_than=few)
    edges = hubs.unionByName(over.select(F.col("source_file").alias("source"), F.col("other_file").alias("target")))
    ids = names.select(F.col("file").alias("id")).distinct()
    labels = components(ids.unionByName(hubs.select(F.col("target").alias("id")).distinct()), edges).join(ids, "id", "left_semi")
    # The cluster is named by its smallest file, whatever hubs it holds.
    named = labels.groupBy("component").agg(F.min("id").alias("cluster"), F.count("*").alias("size"))
    return labels.join(named, "component").select(F.col("id").alias("file"), "cluster", "size")


def common_entities(entities: DataFrame, keep: int = 50) -> DataFrame:
    return entities.groupBy(F.lower(strip("text")).alias("entity")).agg(F.count("*").alias("count")).where("entity <> ''").orderBy(F.desc("count"), "entity").limit(keep)


# Topic per entity type.
TOPICS = (
    ("organizations", ("organization", "org", "company")), ("locations", ("location", "gpe", "loc")), ("temporal", ("time", "date")),
    ("numeric", ("value", "money", "percent", "number")), ("domain_entities", ("product", "event", "facility", "group")),
)


def topics(entities: DataFrame, keep: int = 12) -> DataFrame:
    kind = F.lower("type")
    topic = first_match(*[(kind.isin(*kinds), name) for name, kinds in TOPICS], other="generic_entities")
    return entities.groupBy(topic.alias("topic")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "topic").limit(keep)
