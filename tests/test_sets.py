"""The similarity join over blocks against brute force, and what it leaves out of shuffles."""

import itertools
import random

import pytest

from strataloom.operators import sets, vectors


@pytest.fixture
def texts():
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))] for _ in range(60)]
    near = [[*b[: len(b) * 4 // 5], f"x{k}"] for k, b in enumerate(base)]
    rows = [" ".join(b) for b in [*base, *near, *base[:20]]] + ["", "...", "Same same", "same"]
    return list(enumerate(rows)) + [(3, rows[7]), (200, None)]


def brute(rows, threshold):
    found = []
    own = [(k, set((t or "").lower().split()) - {"..."}) for k, t in rows]
    for (i, a), (j, b) in itertools.combinations(own, 2):
        if a and b and i != j and len(a & b) / len(a | b) >= threshold:
            found.append((min(i, j), max(i, j), round(len(a & b) / len(a | b), 9)))
    return sorted(found)


@pytest.mark.parametrize("most,hits", [(1 << 20, 1 << 20), (900, 3)])
def test_similar_rows_equal_brute_force(spark, texts, monkeypatch, most, hits):
    for name, value in (("BLOCK_TOKENS", most), ("HITS", hits), ("CELLS", hits * 50), ("FLAGS", max(64, hits * 100))):
        monkeypatch.setattr(sets, name, value)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted((r[0], r[1], round(r[2], 9)) for r in vectors.similar_rows(df, 0.6, "doc_id").collect())
    assert got == brute(texts, 0.6)


def test_pairs_of_blocks_in_small_pieces(spark, monkeypatch):
    for name, value in (("BLOCK_TOKENS", 150), ("HITS", 5), ("CELLS", 30), ("FLAGS", 90)):
        monkeypatch.setattr(sets, name, value)
    rng = random.Random(2)
    own = [sorted(set(rng.choices([f"t{i}" for i in range(40)], k=rng.randint(1, 25)))) for _ in range(50)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(own)], "set_id string, tokens array<string>")
    for measure in ("jaccard", "containment"):
        got = {(r[0], r[1]) for r in vectors.set_pairs(df, df, 0.5, measure).collect()}
        want = {(str(i), str(j)) for (i, a), (j, b) in itertools.product(enumerate(own), repeat=2) if len(set(a) & set(b)) / len(set(a) | set(b) if measure == "jaccard" else a) >= 0.5}
        assert got == want


def test_no_candidate_pair_is_shuffled(spark, texts):
    """Only similar pairs reach a join: before, candidates were joined by token, made distinct and sent with both token arrays."""
    df = spark.createDataFrame(texts, "doc_id long, text string")
    plan = vectors.similar_rows(df, 0.6, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "array_intersect" not in plan and "HashAggregate" not in plan


def test_empty_sides(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert vectors.similar_rows(df, 0.6, "doc_id").collect() == []
