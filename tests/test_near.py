"""Near vectors: every pair within the distance is found."""

import numpy as np

from strataloom.operators import vectors
from strataloom.plans import load_all
from strataloom.plans.registry import PLANS
from strataloom.session import load

SMALL = "/root/testdata/sf0.01"


def brute(ids, v, distance):
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    return {(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and d[i, j] < distance}


def test_near_neighbours_are_whole(spark):
    load_all()
    rows = load(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), 1.15)
    got = [(r["left_id"], r["right_id"]) for r in PLANS["near_neighbours"](spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_at_the_edge(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    step = rng.normal(size=(300, 64))
    v = np.concatenate([base, base + 1.14 * step / np.linalg.norm(step, axis=1, keepdims=True)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = {(r["left_id"], r["right_id"]) for r in vectors.near_pairs(df, 1.15, "id", blocks=3).collect()}
    assert got == brute(list(range(600)), v, 1.15) and len(got) >= 300
