"""Canonical nodes and edges, resolution, links across sources and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import entity_id
from strataloom.functions.numeric import rnd
from strataloom.operators import link, resolve
from strataloom.plans import base
from strataloom.plans.extraction import MENTIONS, relations_sql
from strataloom.plans.registry import query
from strataloom.session import load

CE = "'ce_' || substr(sha1({type} || ':' || lower(trim({text}))), 1, 16)"
ENTITY_ID = CE.format(type="type", text="text")
ENTITIES = f"{MENTIONS}, d AS (SELECT source AS source_id, text, label, type, min(doc_id) AS chunk_idx, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1, 2, 3, 4)"
REL = relations_sql()


def nodes(spark, sf_dir):
    return resolve.nodes(base.entities(spark, sf_dir))


def edges(spark, sf_dir):
    rels = base.relations(spark, sf_dir).withColumn("chunk_idx", F.col("doc_id"))
    return resolve.edges(rels, base.entities(spark, sf_dir))


NODES = f"""SELECT {ENTITY_ID} AS canonical_id, arg_min(trim(text), (source_id, chunk_idx, text)) AS label, any_value(type) AS entity_type, arg_min(label, (source_id, chunk_idx, text)) AS ner_label,
  CAST(0.65 AS DOUBLE) AS confidence, min(source_id) AS first_source, count(*) AS mentions, count(DISTINCT text) AS alias_count FROM d GROUP BY 1"""


@query("canonical_nodes", f"WITH {ENTITIES} {NODES}")
def canonical_nodes(spark, sf_dir):
    return nodes(spark, sf_dir)


@query("canonical_aliases", f"WITH {ENTITIES} SELECT DISTINCT {ENTITY_ID} AS canonical_id, trim(text) AS alias FROM d")
def canonical_aliases(spark, sf_dir):
    return resolve.aliases(base.entities(spark, sf_dir))


@query("canonical_provenance", f"WITH {ENTITIES} SELECT DISTINCT {ENTITY_ID} AS canonical_id, source_id, CAST(chunk_idx AS INTEGER) AS chunk_idx FROM d")
def canonical_provenance(spark, sf_dir):
    return resolve.provenance(base.entities(spark, sf_dir))


EDGES = f"""k AS (SELECT source AS src, trim(text) AS name, arg_min({CE.format(type='type', text='text')}, (CASE WHEN type = 'entity' THEN 1 ELSE 0 END, type)) AS id FROM (SELECT DISTINCT source, text, type FROM m) GROUP BY 1, 2),
ce AS (SELECT r.src AS source_id, r.doc_id AS chunk_idx, r.relation, r.context, a.id AS s, b.id AS t FROM r JOIN k a ON a.src = r.src AND a.name = r.source JOIN k b ON b.src = r.src AND b.name = r.target WHERE r.source <> r.target)"""
EDGE_ID = "'cr_' || substr(sha1(s || ':' || relation || ':' || t || ':' || chunk_idx), 1, 16)"


@query(
    "canonical_edges",
    f"""WITH {REL}, {EDGES} SELECT {EDGE_ID} AS canonical_relation_id, s AS source_canonical_id, t AS target_canonical_id, relation, CAST(0.55 AS DOUBLE) AS confidence, source_id, chunk_idx, context FROM ce""",
)
def canonical_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(
    "validate_graph",
    f"""WITH {REL}, {EDGES}, e AS (SELECT DISTINCT {EDGE_ID} AS id, s, t FROM ce), n AS (SELECT DISTINCT {ENTITY_ID} AS id FROM m WHERE type <> 'value')
SELECT 'source_not_found' AS finding, id AS subject, s AS detail FROM e WHERE s NOT IN (SELECT id FROM n) UNION ALL SELECT 'target_not_found', id, t FROM e WHERE t NOT IN (SELECT id FROM n)""",
)
def validate_graph(spark, sf_dir):
    """Dangling ends once amounts are left out of the node table."""
    kept = nodes(spark, sf_dir).where("entity_type <> 'value'")
    return resolve.check(kept, edges(spark, sf_dir).dropDuplicates(["canonical_relation_id"]))


@query(
    "validate_graph_report",
    f"""WITH {REL}, {EDGES}, e AS (SELECT DISTINCT {EDGE_ID} AS id, s, t FROM ce), n AS (SELECT DISTINCT {ENTITY_ID} AS id FROM m)
SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FILTER (s NOT IN (SELECT id FROM n)) + count(*) FILTER (t NOT IN (SELECT id FROM n)) FROM e) AS error_count,
  (SELECT count(*) FILTER (s NOT IN (SELECT id FROM n)) + count(*) FILTER (t NOT IN (SELECT id FROM n)) FROM e) = 0 AS valid""",
)
def validate_graph_report(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir).dropDuplicates(["canonical_relation_id"])
    return resolve.check_report(resolve.check(n, e), n, e)


def batch(spark, sf_dir):
    """Nodes in a stable order: by first source, then id."""
    order = F.conv(F.substring("canonical_id", 4, 15), 16, 10).cast("long")
    return nodes(spark, sf_dir).select("canonical_id", "label", "entity_type", "confidence", order.alias("order"))


def decisions(spark, sf_dir, gen: int = 1):
    return base.kept(spark, sf_dir, f"decisions{gen}", lambda: resolve.resolve(batch(spark, sf_dir), gen=gen))


def _flat(d):
    return d.select("source_id", "target_id", "decision", rnd("score").alias("score"), "candidate_id")


@query("resolve_entities")
def resolve_entities(spark, sf_dir):
    return _flat(decisions(spark, sf_dir))


@query("resolve_entities_exact_heavy")
def resolve_entities_exact_heavy(spark, sf_dir):
    return _flat(decisions(spark, sf_dir, gen=2))


def split_registry(spark, sf_dir):
    """Nodes first seen in one half of the sources form the registry, the others arrive."""
    n = nodes(spark, sf_dir)
    old = F.pmod(F.hash("first_source"), F.lit(2)) == 0
    order = F.conv(F.substring("canonical_id", 4, 15), 16, 10).cast("long")
    known = base.entities(spark, sf_dir).where(F.pmod(F.hash("source_id"), F.lit(2)) == 0)
    return n.where(old), n.withColumn("order", order), resolve.aliases(known)


@query("resolve_against_registry")
def resolve_against_registry(spark, sf_dir):
    registry, incoming, names = split_registry(spark, sf_dir)
    return _flat(resolve.resolve(incoming, registry, names))


@query("resolution_report")
def resolution_report(spark, sf_dir):
    return resolve.resolution_report(decisions(spark, sf_dir))


@query("merged_registry")
def merged_registry(spark, sf_dir):
    return resolve.merge(batch(spark, sf_dir), decisions(spark, sf_dir))


@query("remapped_edges")
def remapped_edges(spark, sf_dir):
    out = resolve.remap(edges(spark, sf_dir), decisions(spark, sf_dir))
    return out.groupBy("source_canonical_id", "target_canonical_id", "relation").agg(F.count("*").alias("count"))


def review_table(spark, sf_dir):
    open_ = decisions(spark, sf_dir).where("decision = 'new_pending_review'")
    return open_.select(
        F.concat(F.lit("rv_"), "source_id").alias("review_id"), "source_id", F.col("candidate_id").alias("target_id"), "score", F.lit("pending").alias("status"), rnd("score", 6).alias("created_at")
    )


@query("pending_reviews")
def pending_reviews(spark, sf_dir):
    return resolve.reviews(review_table(spark, sf_dir))


@query("applied_reviews")
def applied_reviews(spark, sf_dir):
    """Reviews above the middle of the review band are approved, the others rejected."""
    table = review_table(spark, sf_dir)
    made = table.select("review_id", F.when(F.col("score") >= 0.65, "approve").otherwise("reject").alias("decision"))
    return resolve.apply_reviews(table, made)[0].select("review_id", "source_id", "target_id", "status")


@query("split_entities")
def split_entities(spark, sf_dir):
    """Aliases that differ from their node's label are split off as places."""
    n, a = nodes(spark, sf_dir), resolve.aliases(base.entities(spark, sf_dir))
    wanted = a.join(n.select("canonical_id", "label"), "canonical_id").where("alias <> label").select("canonical_id", "alias", F.lit("location").alias("entity_type"))
    return resolve.split_alias(n, a, wanted)[2]


@query(
    "registry_metrics",
    f"""WITH {ENTITIES}, n AS ({NODES}), al AS (SELECT DISTINCT {ENTITY_ID} AS canonical_id, trim(text) AS alias FROM d)
SELECT (SELECT count(*) FROM n) AS canonical_node_count, (SELECT string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) FROM n) AS entity_types, (SELECT count(*) FROM al) AS total_alias_count,
  round((SELECT count(*) FROM al) / CAST((SELECT count(*) FROM n) AS DOUBLE), 2) AS avg_aliases_per_node""",
)
def registry_metrics(spark, sf_dir):
    return resolve.metrics(nodes(spark, sf_dir), resolve.aliases(base.entities(spark, sf_dir)))


# --- links ----------------------------------------------------------------------------


def db_nodes(spark, sf_dir):
    """Values of the relational tables as database entities."""
    parts = (("nation", "n_name", "location"), ("region", "r_name", "location"), ("customer", "c_mktsegment", "category"), ("part", "p_name", "product"), ("part", "p_type", "category"), ("customer", "c_name", "organization"))
    out = None
    for table, col, kind in parts:
        one = load(spark, sf_dir, table).select(F.col(col).alias("label")).distinct().withColumn("entity_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("canonical_id", entity_id("entity_type", "label"))


def text_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select("canonical_id", "label", "entity_type")


DB_NODES = " UNION ".join(
    f"SELECT {c} AS label, '{k}' AS type FROM {t}"
    for t, c, k in (("nation", "n_name", "location"), ("region", "r_name", "location"), ("customer", "c_mktsegment", "category"), ("part", "p_name", "product"), ("part", "p_type", "category"), ("customer", "c_name", "organization"))
)


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "link_candidates",
    f"""WITH {ENTITIES}, n AS ({NODES}), s AS (SELECT {CE.format(type='type', text='label')} AS id, {_norm('label')} AS norm, list_distinct(regexp_extract_all(lower(label), '[a-z0-9_]+')) AS tok FROM ({DB_NODES})),
t AS (SELECT canonical_id AS id, {_norm('label')} AS norm, list_distinct(regexp_extract_all(lower(label), '[a-z0-9_]+')) AS tok FROM n),
p AS (SELECT s.id AS source_id, t.id AS target_id, CASE WHEN s.norm <> '' AND t.norm <> '' AND (contains(s.norm, t.norm) OR contains(t.norm, s.norm)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS containment,
  coalesce(len(list_intersect(s.tok, t.tok)) / nullif(CAST(len(s.tok) + len(t.tok) - len(list_intersect(s.tok, t.tok)) AS DOUBLE), 0), 0) AS j FROM s, t WHERE s.id <> t.id)
SELECT source_id, target_id, containment, round(greatest(containment, j), 4) AS lexical FROM p WHERE greatest(containment, j) >= 0.55""",
)
def link_candidates(spark, sf_dir):
    return link.lexical_pairs(db_nodes(spark, sf_dir), text_nodes(spark, sf_dir)).select("source_id", "target_id", "containment", rnd("lexical").alias("lexical"))


def links(spark, sf_dir):
    return base.kept(spark, sf_dir, "links", lambda: link.cross_source(db_nodes(spark, sf_dir), text_nodes(spark, sf_dir)))


@query("cross_source_links")
def cross_source_links(spark, sf_dir):
    return links(spark, sf_dir).select("source_id", "target_id", rnd("lexical").alias("lexical"), "semantic", rnd("embedding").alias("embedding"), "score", "state", "reason")


@query("cross_source_link_stats")
def cross_source_link_stats(spark, sf_dir):
    return link.link_stats(links(spark, sf_dir), db_nodes(spark, sf_dir))


@query("cross_source_link_metrics")
def cross_source_link_metrics(spark, sf_dir):
    return link.metrics(links(spark, sf_dir))


@query("cross_source_link_reviews")
def cross_source_link_reviews(spark, sf_dir):
    """Links with a score as a review table, approved from .6 on: the approved edges."""
    table = links(spark, sf_dir).where("score IS NOT NULL").select(F.concat_ws("|", "source_id", "target_id").alias("review_id"), "source_id", "target_id", "score", F.lit("pending").alias("status"))
    made = table.select("review_id", F.when(F.col("score") >= 0.6, "approve").otherwise("reject").alias("decision"))
    return link.apply_review(table, made)[1]


@query("semantic_hints")
def semantic_hints(spark, sf_dir):
    from strataloom.operators import profile
    from strataloom.plans import rules

    labels = rules.labelled(spark, sf_dir)
    schema_nodes = rules.canonical_schema(spark, sf_dir)[0]
    hints = link.db_hints(labels, profile.classify_tables(labels), schema_nodes)
    return hints.select("canonical_id", F.array_join("hints", ",").alias("hints"))


@query("evidence_boost")
def evidence_boost(spark, sf_dir):
    from strataloom.plans import rules

    return link.evidence_boost(rules.canonical_schema(spark, sf_dir)[0], rules.evidence(spark, sf_dir))


# --- across documents ------------------------------------------------------------------

PER_FILE = f"{ENTITIES}, f AS (SELECT DISTINCT source_id AS file, lower(trim(text)) AS alias, {ENTITY_ID} AS id FROM d)"


def per_file(spark, sf_dir):
    return base.entities(spark, sf_dir).select("source_id", F.col("text").alias("alias"), entity_id("type", "text").alias("canonical_id"))


SHARED = "SELECT alias, count(DISTINCT file) AS files, count(DISTINCT id) AS canonical_ids, min(id) AS first_id, CASE WHEN count(DISTINCT id) = 1 THEN 'same_entity' ELSE 'canonical_drift' END AS kind FROM f GROUP BY alias HAVING count(DISTINCT file) > 1"


@query("shared_aliases", f"WITH {PER_FILE} {SHARED}")
def shared_aliases(spark, sf_dir):
    return link.shared_aliases(per_file(spark, sf_dir))


@query("shared_canonical_ids", f"WITH {PER_FILE} SELECT id AS canonical_id, count(DISTINCT file) AS files FROM f GROUP BY 1 HAVING count(DISTINCT file) > 1")
def shared_canonical_ids(spark, sf_dir):
    return link.shared_ids(per_file(spark, sf_dir))


@query("synonym_conflicts", f"WITH {PER_FILE} SELECT first_id AS canonical_id, count(*) AS alias_count FROM ({SHARED}) WHERE kind = 'same_entity' GROUP BY 1 HAVING count(*) > 8")
def synonym_conflicts(spark, sf_dir):
    return link.synonym_conflicts(per_file(spark, sf_dir))


OVERLAP = """fa AS (SELECT DISTINCT file, alias FROM f), z AS (SELECT file, count(*) AS n FROM fa GROUP BY 1),
o AS (SELECT x.file AS source_file, y.file AS other_file, count(*) AS shared, any_value(z.n) AS n FROM fa x JOIN fa y ON x.alias = y.alias AND x.file <> y.file JOIN z ON z.file = x.file GROUP BY 1, 2)"""


@query("document_overlap", f"WITH {PER_FILE}, {OVERLAP} SELECT source_file, other_file, shared AS shared_entity_count, round(shared / CAST(n AS DOUBLE), 4) AS overlap_ratio FROM o WHERE shared / CAST(n AS DOUBLE) >= 0.1")
def document_overlap(spark, sf_dir):
    return link.document_overlap(per_file(spark, sf_dir))


@query(
    "document_clusters",
    f"""WITH RECURSIVE {PER_FILE}, {OVERLAP}, g AS (SELECT source_file AS s, other_file AS t FROM o WHERE shared / CAST(n AS DOUBLE) >= 0.1), u AS (SELECT s, t FROM g UNION SELECT t, s FROM g UNION SELECT file, file FROM z),
reach(s, t) AS (SELECT s, t FROM u UNION SELECT reach.s, u.t FROM reach JOIN u ON reach.t = u.s), l AS (SELECT s AS file, min(t) AS cluster, count(*) AS size FROM reach GROUP BY 1) SELECT file, cluster, size FROM l""",
)
def document_clusters(spark, sf_dir):
    return link.clusters(per_file(spark, sf_dir))


@query(
    "duplicate_documents",
    "SELECT doc_id, sha256(text) AS checksum, duplicate_of, copies FROM documents JOIN (SELECT sha256(text) AS c, min(doc_id) AS duplicate_of, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1) ON c = sha256(text) WHERE doc_id <> duplicate_of",
)
def duplicate_documents(spark, sf_dir):
    return link.duplicates(load(spark, sf_dir, "documents"))


@query("common_entities", f"WITH {MENTIONS} SELECT lower(text) AS entity, count(*) AS count FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def common_entities(spark, sf_dir):
    return link.common_entities(base.mentions(spark, sf_dir))


@query(
    "topic_buckets",
    f"WITH {MENTIONS} SELECT CASE type WHEN 'organization' THEN 'organizations' WHEN 'time' THEN 'temporal' WHEN 'value' THEN 'numeric' ELSE 'generic_entities' END AS topic, count(*) AS count FROM m GROUP BY 1",
)
def topic_buckets(spark, sf_dir):
    return link.topics(base.mentions(spark, sf_dir))
