"""Retrieval over conversations as prompts and documents as the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.numeric import rnd
from strataloom.operators import chunking, evaluate, graph, retrieve, vectors, wiki
from strataloom.plans import base, graphs
from strataloom.plans.registry import query
from strataloom.plans.text import chunks_sql, words_sql
from strataloom.plans.vectors import ranked_sql, vectors_sql
from strataloom.session import load

PROMPT_SQL = "p AS (SELECT conv_id || '-' || turn AS prompt_id, conv_id, text FROM conversations WHERE role = 'user')"


def prompts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), "conv_id", "turn", "text")


def replies(spark, sf_dir):
    """Assistant turns of a conversation as the evidence of its prompts."""
    said = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "text")
    return prompts(spark, sf_dir).select("prompt_id", "conv_id").join(said, "conv_id").select("prompt_id", "text")


@query(
    "routing",
    f"""WITH {graphs.GRAPH}, k AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e) AS e), d AS (SELECT n AS node_count, e AS edge_count, round(e / (CAST(n AS DOUBLE) * (n - 1)), 6) AS density FROM k)
SELECT density, CASE WHEN density < 0.002 THEN 'vector_weighted' WHEN density < 0.008 THEN 'balanced' ELSE 'graph_weighted' END AS mode, CASE WHEN density < 0.002 THEN 7 WHEN density < 0.008 THEN 5 ELSE 4 END AS chunk_k,
  CASE WHEN density < 0.002 THEN 6 WHEN density < 0.008 THEN 8 ELSE 12 END AS top_k_nodes, CASE WHEN density < 0.002 THEN 12 WHEN density < 0.008 THEN 20 ELSE 30 END AS max_relations FROM d""",
)
def routing(spark, sf_dir):
    return retrieve.route(graph.density(*graphs.parts(spark, sf_dir))).drop("node_count", "edge_count", "avg_degree")


@query("seed_terms")
def seed_terms(spark, sf_dir):
    return retrieve.seeds(prompts(spark, sf_dir))


@query(
    "prompt_complexity",
    f"""WITH {PROMPT_SQL} SELECT prompt_id, CASE WHEN regexp_matches(lower(text), 'code|script|implement|function') OR len({words_sql()}) > 100 THEN 'high'
  WHEN regexp_matches(lower(text), 'analyse|analyze|explain|compare|why') OR len({words_sql()}) > 35 THEN 'medium' ELSE 'low' END AS complexity FROM p""",
)
def prompt_complexity(spark, sf_dir):
    return prompts(spark, sf_dir).select("prompt_id", retrieve.complexity("text").alias("complexity"))


# A made-up catalogue to rank: name, cost per 1000 tokens, speed, strengths.
CATALOGUE = (
    ("heron", 0.0008, "slow", ("reasoning",)), ("otter", 0.0002, "fast", ("summaries",)), ("finch", 0.004, "medium", ("tables", "reasoning")), ("badger", 0.0035, "fast", ()),
)
MODEL_ROWS = ", ".join(f"({i}, '{n}', {c}::DOUBLE, '{s}', {str('reasoning' in k).upper()})" for i, (n, c, s, k) in enumerate(CATALOGUE))


@query(
    "model_ranking",
    f"""WITH {PROMPT_SQL}, c AS (SELECT prompt_id, len({words_sql()}) AS n, CASE WHEN regexp_matches(lower(text), 'code|script|implement|function') OR len({words_sql()}) > 100 THEN 'high' WHEN regexp_matches(lower(text), 'analyse|analyze|explain|compare|why') OR len({words_sql()}) > 35 THEN 'medium' ELSE 'low' END AS complexity FROM p),
mo(i, model, cost, speed, reasoning) AS (VALUES {MODEL_ROWS}),
s AS (SELECT *, round(greatest(0, least(100, 50 + CASE WHEN complexity = 'low' AND speed = 'fast' THEN 25 WHEN complexity = 'medium' AND speed IN ('fast', 'medium') THEN 20 WHEN complexity = 'high' AND reasoning THEN 25 ELSE 0 END + CASE WHEN speed = 'fast' THEN 5 ELSE 0 END - CASE WHEN complexity = 'low' AND cost > 0.003 THEN 20 ELSE 0 END)), 1)::DOUBLE AS score FROM c, mo)
SELECT prompt_id, complexity, model, score, round((800 + n * 1.3) / 1000 * cost, 5)::DOUBLE AS estimated_cost, CASE WHEN score >= 90 THEN 'Optimal choice' WHEN score >= 75 THEN 'Good alternative' WHEN score >= 60 THEN 'Viable option' ELSE 'Not recommended' END AS label,
  CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, i) AS INTEGER) AS place, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, i) = 1 AS chosen FROM s""",
)
def model_ranking(spark, sf_dir):
    return retrieve.rank_models(prompts(spark, sf_dir), CATALOGUE)


@query(
    "retrieval_coverage",
    f"""WITH {PROMPT_SQL}, t AS (SELECT DISTINCT prompt_id, conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM p), e AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations WHERE role = 'assistant'),
k AS (SELECT t.prompt_id, count(*) AS a, count(e.token) AS b FROM t LEFT JOIN e ON e.conv_id = t.conv_id AND e.token = t.token GROUP BY 1)
SELECT p.prompt_id, coalesce(a, 0) AS prompt_token_count, coalesce(b, 0) AS covered_prompt_tokens, round(coalesce(100.0 * b / nullif(a, 0), 0), 2)::DOUBLE AS coverage_pct FROM p LEFT JOIN k USING (prompt_id)""",
)
def retrieval_coverage(spark, sf_dir):
    return retrieve.coverage(prompts(spark, sf_dir), replies(spark, sf_dir))


def answers(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "conv_id", "text")


def asked(spark, sf_dir):
    said = load(spark, sf_dir, "conversations").where("role <> 'assistant'").select("conv_id", "text")
    return answers(spark, sf_dir).select("answer_id", "conv_id").join(said, "conv_id").select("answer_id", "text")


FAITH = """a AS (SELECT conv_id || '-' || turn AS answer_id, conv_id, text FROM conversations WHERE role = 'assistant'), st AS (SELECT answer_id, conv_id, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]\\s+'), 1) AS pos FROM a),
ss AS (SELECT * FROM st WHERE trim(s, E' \\t\\n\\r') <> ''), tk AS (SELECT DISTINCT answer_id, conv_id, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9_]+')) AS token FROM ss),
ev AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations WHERE role <> 'assistant'),
ok AS (SELECT tk.answer_id, pos, count(ev.token) / CAST(count(*) AS DOUBLE) >= 0.35 AS ok FROM tk LEFT JOIN ev ON ev.conv_id = tk.conv_id AND ev.token = tk.token GROUP BY 1, 2),
f AS (SELECT a.answer_id, coalesce(t, 0) AS total, coalesce(g, 0) AS supported FROM a LEFT JOIN (SELECT answer_id, count(*) AS t FROM ss GROUP BY 1) x USING (answer_id) LEFT JOIN (SELECT answer_id, count(*) FILTER (ok) AS g FROM ok GROUP BY 1) y USING (answer_id))"""


@query(
    "faithfulness",
    f"""WITH {FAITH}, r AS (SELECT *, round(coalesce(100.0 * supported / nullif(total, 0), 0), 2)::DOUBLE AS faithfulness_pct FROM f) SELECT *, CASE WHEN faithfulness_pct >= 80 THEN 'low' WHEN faithfulness_pct >= 55 THEN 'medium' ELSE 'high' END AS risk_level FROM r""",
)
def faithfulness(spark, sf_dir):
    return retrieve.faithfulness(answers(spark, sf_dir), asked(spark, sf_dir))


@query("hallucination_rates", f"WITH {FAITH} SELECT round(1 - sum(supported) / sum(total), 4) AS unsupported_claim_rate, round(avg((supported = total)::INTEGER), 4) AS grounded_answer_rate FROM f")
def hallucination_rates(spark, sf_dir):
    return evaluate.hallucination(faithfulness(spark, sf_dir))


def degree_rows(spark, sf_dir):
    return graph.degrees(*graphs.parts(spark, sf_dir))


def fact_rows(spark, sf_dir):
    return base.kept(spark, sf_dir, "facts", lambda: wiki.facts(*graphs.parts(spark, sf_dir)))


def wiki_hits(spark, sf_dir):
    pages = graphs.parts(spark, sf_dir)[0].select(F.col("id").alias("canonical_id"), F.col("label").alias("title"), "entity_type")
    return retrieve.wiki_lookup(prompts(spark, sf_dir), pages, fact_rows(spark, sf_dir))


@query("wiki_lookup")
def wiki_lookup(spark, sf_dir):
    return wiki_hits(spark, sf_dir)[0]


@query("wiki_facts_for_prompts")
def wiki_facts_for_prompts(spark, sf_dir):
    return wiki_hits(spark, sf_dir)[1]


# Entities of a prompt by SQL: the four patterns in turn, ranked as the extractor does.
def lexical_hits(spark, sf_dir):
    nodes, edges = graphs.parts(spark, sf_dir)
    return retrieve.lexical(prompts(spark, sf_dir), nodes, edges, degree_rows(spark, sf_dir))


@query("lexical_relations")
def lexical_relations(spark, sf_dir):
    return lexical_hits(spark, sf_dir)


def semantic_hits(spark, sf_dir):
    nodes, edges = graphs.parts(spark, sf_dir)
    return base.kept(spark, sf_dir, "semantic_hits", lambda: retrieve.semantic(prompts(spark, sf_dir), nodes, edges, degree_rows(spark, sf_dir)))


@query("semantic_relations")
def semantic_relations(spark, sf_dir):
    return semantic_hits(spark, sf_dir)


@query("relations_with_fallback")
def relations_with_fallback(spark, sf_dir):
    """Lexical relations first here, semantic ones for the prompts that name no entity."""
    out = retrieve.fallback([("graph-lexical", lexical_hits(spark, sf_dir)), ("graph-semantic", semantic_hits(spark, sf_dir))])
    return out.groupBy("mode").agg(F.count_distinct("prompt_id").alias("prompts"), F.count("*").alias("relations"))


def passage_hits(spark, sf_dir, k: int = 5):
    def make():
        chunks = chunking.chunk(load(spark, sf_dir, "documents")).withColumn("chunk_id", F.concat_ws("-", "doc_id", "idx"))
        items = vectors.hash_vectors(chunks, "chunk_id")
        asks = vectors.hash_vectors(prompts(spark, sf_dir), "prompt_id")
        found = vectors.top_k(asks, items, k, "prompt_id", "chunk_id", digits=9)
        return found.join(chunks.select("chunk_id", "text"), "chunk_id")

    return base.kept(spark, sf_dir, f"passages{k}", make)


@query(
    "vector_passages",
    f"""WITH {PROMPT_SQL}, c AS ({chunks_sql()}), q AS (SELECT prompt_id AS key, text FROM p), i AS (SELECT doc_id || '-' || idx AS key, text FROM c), {vectors_sql('qv', 'q')}, {vectors_sql('iv', 'i')},
r AS ({ranked_sql('q', 'i', 'qv', 'iv', 5)}) SELECT query AS prompt_id, item AS chunk_id, round(score, 6) AS score, "rank" FROM r""",
)
def vector_passages(spark, sf_dir):
    return passage_hits(spark, sf_dir).select("prompt_id", "chunk_id", rnd("score", 6).alias("score"), "rank")


@query("context_assembly")
def context_assembly(spark, sf_dir):
    out = retrieve.context(prompts(spark, sf_dir), wiki_hits(spark, sf_dir)[1], semantic_hits(spark, sf_dir), passage_hits(spark, sf_dir))
    return out.select("prompt_id", F.sha2("context", 256).alias("context_sha"), "explain.fact_count", "explain.relation_count", "explain.chunk_count")


@query("passage_coverage")
def passage_coverage(spark, sf_dir):
    return retrieve.coverage(prompts(spark, sf_dir), passage_hits(spark, sf_dir).select("prompt_id", "text"))


def profile_parts(spark, sf_dir):
    """System turns are the stored profiles, user turns the prompts."""
    c = load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    dense = vectors.hash_vectors(c, "key")
    rows = c.join(dense, "key")
    profs = rows.where("role = 'system'").select(
        F.col("key").alias("profile_id"), "vector", F.lit(1).cast("long").alias("usage"), F.concat(F.lit("general-v"), "conv_id").alias("name"), F.lit("general").alias("domain")
    )
    asks = rows.where("role = 'user'").select(F.col("key").alias("prompt_id"), "vector", "text", (F.col("conv_id") * 10000 + F.col("turn")).alias("order"))
    return asks, profs


def matched(spark, sf_dir):
    def make(i):
        return lambda: profile_parts(spark, sf_dir)[i]

    asks, profs = (base.kept(spark, sf_dir, name, make(i)) for i, name in enumerate(("profile_asks", "profiles")))
    return asks, profs, base.kept(spark, sf_dir, "profile_matches", lambda: retrieve.match_profiles(asks, profs))


@query(
    "profile_matches",
    f"""WITH k AS (SELECT conv_id || '-' || turn AS key, role, text FROM conversations), q AS (SELECT * FROM k WHERE role = 'user'), i AS (SELECT * FROM k WHERE role = 'system'), {vectors_sql('qv', 'q')}, {vectors_sql('iv', 'i')},
r AS ({ranked_sql('q', 'i', 'qv', 'iv', 1)}), s AS (SELECT q.key AS prompt_id, item AS profile_id, coalesce(round(100.0::DOUBLE * (score / 2 + 0.5), 1), 0)::DOUBLE AS match_score FROM q LEFT JOIN r ON r.query = q.key)
SELECT *, CASE WHEN match_score >= 80 THEN 'reuse' WHEN match_score >= 50 THEN 'modify' ELSE 'create' END AS decision, round(0.044::DOUBLE * greatest(0.05, 1.0 - match_score / 100.0 * 0.9), 4)::DOUBLE AS estimated_cost,
  least(95.0, round(match_score * 0.82::DOUBLE, 1))::DOUBLE AS token_saving_pct FROM s""",
)
def profile_matches(spark, sf_dir):
    return retrieve.decision_costs(matched(spark, sf_dir)[2])


@query("profiles_after_matches")
def profiles_after_matches(spark, sf_dir):
    asks, profs, found = matched(spark, sf_dir)
    out = retrieve.apply_match(found, asks, profs, "order")
    return out.select("profile_id", "usage", "name", "domain", rnd(vectors.dot("vector", "vector"), 6).alias("norm"))


@query("recent_profiles")
def recent_profiles(spark, sf_dir):
    asks, profs, found = matched(spark, sf_dir)
    out = retrieve.apply_match(found, asks, profs, "order")
    return retrieve.recent(out.select("profile_id", "usage", "name", "domain"), "usage")


@query(
    "token_usage",
    f"""WITH t AS (SELECT conv_id, CAST(sum(floor(len({words_sql()}) * 1.3::DOUBLE)) AS BIGINT) AS tokens_used FROM (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2) GROUP BY 1)
SELECT conv_id, tokens_used, tokens_used * 5 AS tokens_saved, round(tokens_used * 0.00000025, 5)::DOUBLE AS cost FROM t""",
)
def token_usage(spark, sf_dir):
    """Turns of a role joined per conversation; conversations are short by nature."""
    c = load(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    wide = c.groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(text).fillna("", ["system", "user", "assistant"])
    return retrieve.token_usage(wide, "conv_id", ("system", "user", "assistant"))


