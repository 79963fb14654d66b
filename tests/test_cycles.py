"""Directed cycles of any length count in the trust score."""

from strataloom.operators import graph
from strataloom.plans import graphs, load_all
from strataloom.plans.registry import PLANS


def test_parts_of_any_length(spark):
    ring = [(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)]
    pairs = [("b", "c"), ("c", "b"), ("c", "d"), ("d", "b")]
    rest = [("a3", "b"), ("d", "y"), ("y", "z"), ("s", "a0"), ("x", "x")]
    edges = spark.createDataFrame([*ring, *pairs, *rest], "source string, target string")
    got = sorted(map(tuple, graph.cyclic_parts(edges).collect()))
    assert got == [("a0", 7, 7, 1), ("b", 3, 4, 2)]
    assert graph.cyclic_parts(edges.where("source in ('s', 'y')")).count() == 0


def test_a_long_ring_lowers_the_trust_score(spark, monkeypatch):
    load_all()
    nodes = spark.createDataFrame([(f"n{i}", "concept") for i in range(4)], "id string, entity_type string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 4}", "related_to", 0.9) for i in range(4)], "source string, target string, relation string, confidence double")
    monkeypatch.setattr(graphs, "parts", lambda spark, sf_dir: (nodes, edges))
    monkeypatch.setattr(graphs, "violations", lambda spark, sf_dir: edges.limit(0))
    row = PLANS["graph_consistency"](spark, "").first()
    assert (row["cycles"], row["graph_trust_score"]) == (1, 0.96)
