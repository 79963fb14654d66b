"""Graph operators over ``nodes(id, label, entity_type, ...)`` and ``edges(source, target, relation, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.ids import edge_key
from strataloom.functions.numeric import band, count_if, first_match, flags, ratio, rnd
from strataloom.functions.text import strip
from strataloom.operators.profile import side_by_side
from strataloom.operators.skew import hot_keys, split_join
from strataloom.session import cut_lineage

# Relations that should hold in both directions.
SYMMETRIC = ("related_to", "cross_source_related")


def build(entities: DataFrame, relations: DataFrame, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """File graph: one node per lower label, edges with known ends, no repeats, no self links.

    Pass ``file`` to build one graph per file; ids are then prefixed by it.
    """
    keys = [file] if file else []
    node_id = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("norm"))
    nodes = (
        entities.withColumn("norm", F.lower(strip("text"))).where("norm <> ''").groupBy(*keys, "norm")
        .agg(F.min("text").alias("label"), F.min("type").alias("entity_type"), F.count("*").alias("mentions"))
        .withColumn("id", node_id)
    )
    ids = nodes.select(*keys, "norm", "id")
    # Repeats are counted before the ends are looked up: a hub's name meets its distinct edges only.
    ends = relations.withColumn("_s", F.lower(strip("source"))).withColumn("_t", F.lower(strip("target"))).where("_s <> _t")
    ends = ends.groupBy(*keys, "_s", "_t", "relation").agg(F.count("*").alias("mentions"))
    for side, col in (("_s", "_source"), ("_t", "_target")):
        ends = ends.join(ids.withColumnsRenamed({"norm": side, "id": col}), [*keys, side])
    best = ends.groupBy(*keys, F.col("_source").alias("source"), F.col("_target").alias("target"), "relation").agg(F.sum("mentions").alias("mentions"))
    return nodes.drop("norm"), best


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, degree`` for every node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(counted, "id", "left").fillna(0, ["in_degree", "out_degree"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def central(degree_rows: DataFrame, keep: int = 15) -> DataFrame:
    return degree_rows.orderBy(F.desc("degree"), "id").limit(keep)


def density(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """``node_count, edge_count, density, avg_degree``."""
    one = side_by_side(nodes.agg(F.count("*").alias("node_count")), edges.agg(F.count("*").alias("edge_count")))
    n, e = F.col("node_count"), F.col("edge_count")
    most = n.cast("double") * (n - 1) if directed else n.cast("double") * (n - 1) / 2.0
    more = n > 1
    return one.select(
        "node_count", "edge_count", F.when(more, rnd(e / most, 6)).otherwise(F.lit(0.0)).alias("density"),
        F.when(more, rnd(2.0 * e / n, 4)).otherwise(F.lit(0.0)).alias("avg_degree"),
    )


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components ``id, component`` (smallest id of the component).

    Smallest labels travel along edges and then jump over their own labels, so
    long chains take a logarithmic number of rounds. Each round is written to
    the checkpoint folder; hub nodes meet a bounded broadcast.
    """
    both = edges.where("source <> target").select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")),
    )).alias("e")).select("e.*").distinct()
    both = cut_lineage(both)
    hubs = cut_lineage(hot_keys(both, "other"))
    labels = cut_lineage(nodes.select("id").distinct().withColumn("component", F.col("id")))
    for _ in range(rounds):
        seen = split_join(both, labels.select(F.col("id").alias("other"), "component"), "other", hubs).groupBy("id").agg(F.min("component").alias("near"))
        moved = labels.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = moved.select(F.col("id").alias("next"), F.col("next").alias("far"))
        stepped = cut_lineage(moved.join(jump, "next", "left").select("id", "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = stepped.select("id", F.col("next").alias("component"))
        if stepped.where("next <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    used = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(used, "id", "left_anti")


def hubs(degree_rows: DataFrame, share: float = 0.2, least: int = 8) -> DataFrame:
    """Nodes with degree >= max(``least``, ``share`` of the nodes)."""
    total = degree_rows.agg(F.count("*").alias("nodes"))
    limit = F.greatest(F.lit(least), F.floor(F.col("nodes") * share))
    return side_by_side_rows(degree_rows, total).where(F.col("degree") >= limit).drop("nodes")


def side_by_side_rows(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Rows with the columns of a one-row frame (a broadcast of a single row)."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def quality(nodes: DataFrame, edges: DataFrame, weak: float = 0.5) -> DataFrame:
    """Findings ``finding, source, target, relation, value``: weak, invalid and duplicate edges, sparse nodes."""
    null = F.lit(None).cast("string")
    known = nodes.select("id").distinct()
    cols = ["source", "target", "relation"]
    low = edges.where(F.col("confidence") < weak).select(F.lit("weak_edge").alias("finding"), *cols, F.col("confidence").cast("double").alias("value"))
    ends = edges.join(known.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(known.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    invalid = ends.where((F.col("source") == F.col("target")) | F.col("_s").isNull() | F.col("_t").isNull()).select(
        F.lit("invalid_edge").alias("finding"), *cols, F.lit(None).cast("double").alias("value")
    )
    twice = edges.groupBy(*cols).agg(F.count("*").cast("double").alias("value")).where("value > 1").select(F.lit("duplicate_edge").alias("finding"), *cols, "value")
    deg = edges.select(F.explode(F.array("source", "target")).alias("source")).groupBy("source").agg(F.count("*").cast("double").alias("value"))
    sparse = deg.where("value <= 1").select(F.lit("sparse_node").alias("finding"), "source", null.alias("target"), null.alias("relation"), "value")
    return low.unionByName(invalid).unionByName(twice).unionByName(sparse)


def missing_inverse(edges: DataFrame, symmetric=SYMMETRIC) -> DataFrame:
    """Edges of symmetric relations without their counterpart."""
    own = edges.where(F.col("relation").isin(*symmetric)).select("source", "target", "relation").distinct()
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation").distinct()
    return own.join(back, ["source", "target", "relation"], "left_anti")


def multi_relation(edges: DataFrame) -> DataFrame:
    """Node pairs linked by more than one relation; the relation list is bounded by the relation names."""
    return edges.groupBy("source", "target").agg(F.array_sort(F.collect_set("relation")).alias("relations")).where(F.size("relations") > 1)


def scope(nodes: DataFrame, edges: DataFrame, node_sources: DataFrame, edge_sources: DataFrame, sources: DataFrame, active_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Part of the graph that shares a source: ``node_sources(id, source_id)``, ``edge_sources(edge_key, source_id)``."""
    keep = nodes.join(node_sources.join(sources, "source_id", "left_semi"), "id", "left_semi")
    near = edges.join(edge_sources.join(sources, "source_id", "left_semi"), "edge_key", "left_semi")
    for side in ("source", "target"):
        near = near.join(keep.select(F.col("id").alias(side)), side, "left_semi")
    if active_only and "suppressed" in near.columns:
        near = near.where(~F.coalesce("suppressed", F.lit(False)))
    return keep, near


def union_graphs(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of file graphs with ids prefixed by the file."""
    nodes = edges = None
    for name, (n, e) in parts.items():
        pre = lambda c, name=name: F.concat(F.lit(f"{name}:"), F.col(c))
        n = n.withColumn("id", pre("id")).withColumn("file_id", F.lit(name))
        e = e.withColumn("source", pre("source")).withColumn("target", pre("target")).withColumn("file_id", F.lit(name))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    return nodes, edges


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new nodes by id: the old label stays, the confidence is the larger one; ``status`` tells which."""
    rows = old.select("id", "label", "entity_type", "confidence", F.lit(0).alias("age")).unionByName(
        new.select("id", "label", "entity_type", "confidence", F.lit(1).alias("age"))
    )
    was, now = F.min("age") == 0, F.max("age") == 1
    return rows.groupBy("id").agg(
        F.min_by("label", F.struct("age", "label")).alias("label"), F.min_by("entity_type", F.struct("age", "entity_type")).alias("entity_type"),
        rnd(F.max("confidence")).alias("confidence"), first_match((was & now, "updated"), (was, "kept"), other="created").alias("status"),
    )


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new edges by key, self links dropped, larger confidence kept."""
    cols = ["source", "target", "relation"]
    rows = old.select(*cols, "confidence", F.lit(0).alias("age")).unionByName(new.select(*cols, "confidence", F.lit(1).alias("age")))
    was, now = F.min("age") == 0, F.max("age") == 1
    return rows.where("source <> target").groupBy(*cols).agg(
        rnd(F.max("confidence")).alias("confidence"), first_match((was & now, "updated"), (was, "kept"), other="created").alias("status")
    ).withColumn("edge_key", edge_key("source", "relation", "target"))


def upsert_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return side_by_side(*[
        df.agg(*[count_if(F.col("status") == s).alias(f"{name}_{s}") for s in ("created", "updated")]) for name, df in (("nodes", nodes), ("edges", edges))
    ])


def suppress(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``edge_key, action, reason`` decisions (suppress or restore)."""
    have = "suppressed" in edges.columns
    base = edges if have else edges.withColumn("suppressed", F.lit(False))
    base = base if "suppression_reason" in edges.columns else base.withColumn("suppression_reason", F.lit(None).cast("string"))
    d = decisions.select("edge_key", F.lower("action").alias("_a"), F.col("reason").alias("_r"))
    joined = base.join(d, "edge_key", "left")
    flag = F.when(F.col("_a") == "suppress", F.lit(True)).when(F.col("_a") == "restore", F.lit(False)).otherwise(F.col("suppressed"))
    why = F.when(F.col("_a") == "suppress", F.coalesce("_r", F.lit("manual"))).when(F.col("_a") == "restore", F.lit(None)).otherwise(F.col("suppression_reason"))
    return joined.withColumn("suppressed", flag).withColumn("suppression_reason", why).drop("_a", "_r")


def _active(edges: DataFrame) -> Column:
    return ~F.coalesce("suppressed", F.lit(False)) if "suppressed" in edges.columns else F.lit(True)


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, suppressed share, confidence bands and contradiction ratio in one row."""
    active, conf = _active(edges), F.col("confidence")
    odd = F.lower("relation").rlike("contradict|ambiguous")
    one = side_by_side(nodes.agg(F.count("*").alias("node_count")), edges.agg(
        F.count("*").alias("edge_count"), count_if(active).alias("active_edge_count"), count_if(~active).alias("suppressed_edge_count"),
        count_if(active & (conf < 0.5)).alias("low"), count_if(active & (conf >= 0.5) & (conf < 0.8)).alias("medium"), count_if(active & (conf >= 0.8)).alias("high"),
        count_if(active & odd).alias("contradictory"),
    ))
    alive = F.greatest(F.lit(1), F.col("active_edge_count"))
    return one.select(
        "*", rnd(100.0 * ratio("suppressed_edge_count", F.greatest(F.lit(1), F.col("edge_count"))), 2).alias("suppressed_ratio_pct"),
        rnd(F.col("low") / alive).alias("high_risk_edge_ratio"), rnd(F.col("contradictory") / alive).alias("contradiction_ratio"),
    ).drop("contradictory")


def top_share(df: DataFrame, col: str, keep: int = 5) -> DataFrame:
    """``name, count, percentage`` of the most frequent values."""
    counted = df.groupBy(F.lower(F.col(col)).alias("name")).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("_total"))
    share = rnd(100.0 * F.col("count") / F.greatest(F.lit(1), F.col("_total")), 2)
    return side_by_side_rows(counted, total).withColumn("percentage", share).drop("_total").orderBy(F.desc("count"), "name").limit(keep)


def source_coverage(node_sources: DataFrame, edge_sources: DataFrame, keep: int = 10) -> DataFrame:
    """Sources by nodes and edges they support."""
    n = node_sources.groupBy("source_id").agg(F.count("*").alias("node_count"))
    e = edge_sources.groupBy("source_id").agg(F.count("*").alias("edge_count"))
    both = n.join(e, "source_id", "full_outer").fillna(0, ["node_count", "edge_count"])
    return both.orderBy(F.desc(F.col("node_count") + F.col("edge_count")), "source_id").limit(keep)


def summary(nodes: DataFrame, edges: DataFrame, node_sources: DataFrame) -> DataFrame:
    """One-row summary: metrics, density, multi-source share and caveats."""
    per_node = node_sources.groupBy("id").agg(F.count_distinct("source_id").alias("sources"))
    multi = per_node.agg(count_if(F.col("sources") > 1).alias("multi"))
    files = node_sources.agg(F.count_distinct("source_id").alias("source_files_count"))
    one = side_by_side(metrics(nodes, edges), density(nodes, edges.where(_active(edges))).select("density", "avg_degree"), multi, files)
    present = edges.agg(rnd(ratio(F.count("confidence"), F.greatest(F.lit(1), F.count("*")))).alias("confidence_present_ratio"))
    one = side_by_side(one, present)
    notes = flags(
        ((F.col("node_count") == 0) & (F.col("edge_count") == 0), "empty graph"),
        ((F.col("confidence_present_ratio") < 0.6) & (F.col("edge_count") > 0), "few edges carry a confidence"),
        ((F.col("high_risk_edge_ratio") > 0.25) & (F.col("edge_count") > 0), "many edges have low confidence"),
    )
    share = rnd(ratio("multi", F.greatest(F.lit(1), F.col("node_count"))))
    return one.withColumn("multi_source_entity_ratio", share).withColumn("caveats", F.array_join(notes, "; ")).drop("multi")


def edge_confidence(relations: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """Base by relation plus up to .2 for remembered co-occurrence (unordered pair)."""
    a, b = F.lower("source"), F.lower("target")
    keyed = relations.withColumn("left", F.least(a, b)).withColumn("right", F.greatest(a, b))
    joined = keyed.join(pair_counts.select("left", "right", F.col("count").alias("_n")), ["left", "right"], "left").drop("left", "right")
    base = F.when(F.col("relation") == "related_to", F.lit(0.4)).otherwise(F.lit(0.7))
    gain = F.least(F.lit(0.2), 0.02 * F.coalesce("_n", F.lit(0)))
    return joined.withColumn("confidence", rnd(F.least(F.lit(1.0), base + gain))).drop("_n")


def construct(nodes: DataFrame, accepted: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Second rule set: nodes used, accepted edges keyed and counted by source, and skipped relations.

    ``names`` maps ``text`` to ``id``; ``accepted`` holds ``source, target,
    relation, confidence, action, source_id``.
    """
    ends = accepted
    for side in ("source", "target"):
        ends = ends.join(names.select(F.col("text").alias(side), F.col("id").alias(f"{side}_node")), side, "left")
    fine = F.col("source_node").isNotNull() & F.col("target_node").isNotNull() & (F.col("source_node") != F.col("target_node"))
    edges = ends.where(fine).groupBy(F.col("source_node").alias("source"), F.col("target_node").alias("target"), "relation").agg(
        F.max("confidence").alias("confidence"), F.min("action").alias("governance"), F.count_distinct("source_id").alias("sources"), F.count("*").alias("triples")
    ).withColumn("edge_id", edge_key("source", "relation", "target")).withColumn("suppressed", F.lit(False))
    used = nodes.join(names.select("id").distinct(), "id", "left_semi")
    skipped = ends.where(~F.coalesce(fine, F.lit(False))).select("source", "target", "relation")
    return used, edges, skipped


def _on_paths(links: DataFrame) -> DataFrame:
    """Links whose ends have both an incoming and an outgoing link, pruned repeatedly."""
    links = cut_lineage(links)
    size = links.count()
    while size:
        live = links.join(links.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(
            links.select(F.col("source").alias("target")).distinct(), "target", "left_semi"
        )
        links = cut_lineage(live.select("source", "target"))
        left = links.count()
        if left == size:
            break
        size = left
    return links


def cyclic_parts(edges: DataFrame) -> DataFrame:
    """Strongly connected parts with a cycle of any length: ``part, nodes, edges, cycles``, named by their smallest node.

    ``cycles`` is the number of independent cycles, ``edges - nodes + 1``. No depth-first
    search closes more cycles in a part, so the count is never below what one reports.
    Every node learns the smallest node that reaches it and the smallest it reaches; where
    both are the same node, it is on a part with that node. The rest splits by the two
    labels and goes through again. A round of labels goes one edge further.
    """
    links = _on_paths(edges.where("source <> target").select("source", "target").distinct())
    out = links.sparkSession.createDataFrame([], "part string, nodes long, edges long, cycles long")
    while not links.isEmpty():
        labels = cut_lineage(links.select(F.col("source").alias("id")).distinct().select("id", F.col("id").alias("up"), F.col("id").alias("down")))
        while True:
            heard = links.join(labels.select(F.col("id").alias("source"), "up"), "source").select(F.col("target").alias("id"), "up", F.lit(None).cast("string").alias("down")).unionByName(
                links.join(labels.select(F.col("id").alias("target"), "down"), "target").select(F.col("source").alias("id"), F.lit(None).cast("string").alias("up"), "down")
            )
            least = heard.groupBy("id").agg(F.min("up").alias("near_up"), F.min("down").alias("near_down"))
            moved = labels.join(least, "id").select(
                "id", F.least("up", "near_up").alias("up"), F.least("down", "near_down").alias("down"),
                ((F.col("near_up") < F.col("up")) | (F.col("near_down") < F.col("down"))).alias("moved"),
            )
            moved = cut_lineage(moved)
            labels = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        ends = [labels.select(F.col("id").alias(side), F.struct("up", "down").alias(f"{side}_labels")) for side in ("source", "target")]
        inner = links.join(ends[0], "source").join(ends[1], "target").where("source_labels = target_labels")
        inner = cut_lineage(inner.select("source", "target", "source_labels.up", "source_labels.down"))
        counted = inner.where("up = down").groupBy(F.col("up").alias("part")).agg(F.count_distinct("source").alias("nodes"), F.count("*").alias("edges"))
        out = out.unionByName(counted.withColumn("cycles", F.col("edges") - F.col("nodes") + 1))
        links = _on_paths(inner.where("up <> down").select("source", "target"))
    return out


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Directed simple cycles up to ``longest`` edges: ``nodes, length``, each once from its smallest node.

    Only nodes with both an incoming and an outgoing edge can lie on a cycle;
    edges are pruned to those first (repeatedly), and paths grow only over
    nodes larger than their start, so a cycle is met in one rotation.
    """
    links = _on_paths(edges.where("source <> target").select("source", "target").distinct())
    out = None
    paths = links.where("target > source").select(F.col("source").alias("start"), F.col("target").alias("end"), F.array("source", "target").alias("nodes"))
    step = links.select(F.col("source").alias("end"), F.col("target").alias("next"))
    for length in range(2, longest + 1):
        grown = paths.join(step, "end")
        closed = grown.where("next = start").select("nodes", F.lit(length).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        paths = grown.where((F.col("next") > F.col("start")) & ~F.array_contains("nodes", F.col("next"))).select(
            "start", F.col("next").alias("end"), F.concat("nodes", F.array("next")).alias("nodes")
        )
    return out


def consistency(nodes: DataFrame, edges: DataFrame, violations: DataFrame, cycle_rows: DataFrame, low: float = 0.45) -> DataFrame:
    """Trust score ``1 - .4 violations - .2 orphans - .2 low confidence - .2 cycles`` with a band.

    ``cycle_rows`` are single cycles or the parts of :func:`cyclic_parts`.
    """
    live = edges.where(_active(edges))
    one = side_by_side(
        nodes.agg(F.count("*").alias("node_count")),
        live.agg(F.count("*").alias("active_edge_count"), count_if(F.col("confidence") < low).alias("low_confidence_edges")),
        isolated(nodes, live).agg(F.count("*").alias("orphan_nodes")), violations.agg(F.count("*").alias("ontology_violations")),
        cycle_rows.agg((F.coalesce(F.sum("cycles"), F.lit(0)) if "cycles" in cycle_rows.columns else F.count("*")).alias("cycles")),
    )
    n = F.greatest(F.lit(1), F.col("active_edge_count"))
    score = rnd(
        1.0 - 0.4 * (F.col("ontology_violations") / n) - 0.2 * (F.col("orphan_nodes") / F.greatest(F.lit(1), F.col("node_count")))
        - 0.2 * (F.col("low_confidence_edges") / n) - 0.2 * F.least(F.lit(1.0), F.least(F.lit(10), F.col("cycles")) / 5.0)
    )
    return one.withColumn("graph_trust_score", F.greatest(F.lit(0.0), score)).withColumn("trust_band", band(score, ((0.75, "high"), (0.45, "medium")), "low"))


def entity_list(nodes: DataFrame, edges: DataFrame, orphans_only: bool = False) -> DataFrame:
    """Nodes with their degree, best connected first."""
    out = nodes.join(degrees(nodes, edges).select("id", "degree"), "id")
    out = out.where("degree = 0") if orphans_only else out
    return out.orderBy(F.desc("degree"), "label")


def relation_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of their ends, best confidence first."""
    name = nodes.select("id", "label")
    out = edges.join(name.withColumnsRenamed({"id": "source", "label": "source_label"}), "source").join(
        name.withColumnsRenamed({"id": "target", "label": "target_label"}), "target"
    )
    return out.orderBy(F.desc("confidence"), "source_label", "relation", "target_label")

