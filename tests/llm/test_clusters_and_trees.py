"""Vantage-point trees, bisector tournament and Merkle manifest against plain versions, with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import bisector, merkle, vp_tree

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label string, key string, dim string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "k", "d", "l") for r in rows], VECTORS).repartition(3)


def odd_vectors(width):
    one = [1.0] + [0.0] * (width - 1)
    return [
        (None, one), (900, None), (901, []), (902, [0.0] * width), (903, [None] + one[1:]), (904, [NAN] + one[1:]), (905, [INF] + one[1:]), (906, one[:-1]), (907, [-2.0] * (width - 1)),
    ]


# --- nearest neighbours


def nearest_by_hand(rows, every, k):
    usable = {(v, tuple(x)) for v, x in rows if v is not None and x and None not in x and all(map(math.isfinite, x)) and any(x)}
    out = set()
    for q, x in usable:
        if q % every == 0:
            found = [(-sum_in_order(x, y), v) for v, y in usable if v != q and len(y) == len(x)]
            best = sorted(found, key=lambda p: (math.isnan(p[0]), p))[:k]
            out |= {(q, rank + 1, v, -s) for rank, (s, v) in enumerate(best)}
    return out


def sum_in_order(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def answers(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_nearest_is_exact_with_factor_one(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    points = np.concatenate([centres[rng.integers(0, 6, 500)] + 0.1 * rng.normal(size=(500, 5)), rng.normal(size=(60, 5)) * 20])
    rows = [(int(k), x.tolist()) for k, x in enumerate(points)]
    rows += [(1000 + k, points[3].tolist()) for k in range(100)]  # many copies
    rows += [(1200 + k, (points[3] * 1e-3).tolist()) for k in range(3)] + [rows[20], rows[20], (20, rows[5][1])]  # repeated rows, one id twice
    rows += odd_vectors(5)
    got = answers(vp_tree.nearest(frame(spark, rows), "vec_id % 20 = 0", k=7, shard_bytes=3000))
    assert got == nearest_by_hand(rows, 20, 7)


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e308, 1e-310])
def test_nearest_with_extreme_lengths(spark, size):
    rng = np.random.default_rng(2)
    rows = [(int(k), (x * (size if k % 9 == 0 else 1.0)).tolist()) for k, x in enumerate(rng.uniform(-1, 1, size=(80, 3)))]
    got = answers(vp_tree.nearest(frame(spark, rows), "vec_id % 10 = 0", k=4, shard_bytes=1000))
    assert {a[:3] for a in got} == {a[:3] for a in nearest_by_hand(rows, 10, 4)}


def test_nearest_with_few_or_no_rows(spark):
    assert answers(vp_tree.nearest(frame(spark, []), "vec_id % 20 = 0")) == set()
    assert answers(vp_tree.nearest(frame(spark, odd_vectors(4)[1:6]), "vec_id % 20 = 0")) == set()
    assert answers(vp_tree.nearest(frame(spark, [(20, [1.0, 2.0]), (-1, [3.0, 0.0])]), "vec_id % 20 = 0")) == {(20, 1, -1, 3.0)}


def test_a_larger_factor_meets_fewer_pairs_and_keeps_most_hits():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    items = centres[rng.integers(0, 40, 8000)] + 0.15 * rng.normal(size=(8000, 16))
    norms = np.sqrt((items**2).sum(axis=1))
    space, least = vp_tree.Space(float(np.log2(norms.max()))), np.arange(8000)
    open_bar = np.full(100, -np.inf)
    met, hits = {}, {}
    for factor in (1.0, 2.0, 4.0):
        who, item, _, met[factor] = vp_tree.search(items[:100], open_bar, items, least, 20, factor, space)
        hits[factor] = set(zip(who.tolist(), item.tolist()))
    want = np.argsort(-(items[:100] @ items.T), axis=1, kind="stable")[:, :20]
    assert hits[1.0] == {(q, int(v)) for q in range(100) for v in want[q]}
    assert met[4.0] < met[2.0] < met[1.0] < 800_000
    assert len(hits[2.0] & hits[1.0]) >= 0.9 * len(hits[1.0])


# --- clusters


def clusters_by_hand(rows, k, rounds, width, scale):
    kept = [(v, [math.floor(scale * a) for a in x]) for v, x in rows if x is not None and len(x) == width and None not in x and all(map(math.isfinite, x))]
    named = sorted((hashlib.sha256(f"3:{v}".encode()).hexdigest(), x) for v, x in kept if v is not None)
    centroids = [x for _, x in named[:k]]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (away(x, centroids[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, x in kept:
            groups[nearest(x)].append(x)
        centroids = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    placed = [(v, nearest(x), away(x, centroids[nearest(x)])) for v, x in kept]
    per = [sum(d for _, c, d in placed if c == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((v if v is not None else -10**9, c, d, per[c], sum(per), digest[c]) for v, c, d in placed)


def clustered(df):
    return sorted((r[0] if r[0] is not None else -10**9, *r[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("size", [1.0, 30_000.0, 2.0e6])
def test_clusters_like_plain_rounds(spark, size):
    """The sizes use float64, 64-bit and Python integers."""
    rng = np.random.default_rng(5)
    rows = [(int(k), (size * x).tolist()) for k, x in enumerate(rng.normal(size=(150, 4)))]
    rows += [(200 + k, rows[7][1]) for k in range(40)] + [rows[9], rows[9]] + odd_vectors(4)
    got = clustered(bisector.clusters(frame(spark, rows), k=5, rounds=4, width=4))
    want = clusters_by_hand(rows, 5, 4, 4, 1024)
    limit = (1 << 63) - 1
    assert got == [(*r[:2], *(d if d <= limit else None for d in r[2:5]), r[5]) for r in want]


def test_clusters_ties_and_few_rows(spark):
    rows = [(k, [float(k % 3), 1.0]) for k in range(12)]  # more centroids than places
    assert clustered(bisector.clusters(frame(spark, rows), k=8, rounds=3, width=2)) == clusters_by_hand(rows, 8, 3, 2, 1024)
    assert clustered(bisector.clusters(frame(spark, rows[:2]), k=8, rounds=3, width=2)) == clusters_by_hand(rows[:2], 8, 3, 2, 1024)
    assert clustered(bisector.clusters(frame(spark, odd_vectors(2)[1:2]), width=2)) == []
    assert clustered(bisector.clusters(frame(spark, []))) == []


def test_a_zero_on_the_bisector_goes_to_the_smaller_number():
    tests = bisector.Bisectors([[0, 0], [4, 0], [2, 0]], 8)
    assert tests.winners(np.array([[2, 5], [1, 0], [3, 0], [-1, 1], [0, 9]])).tolist() == [2, 0, 1, 0, 0]


# --- Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def reduce_by_hand(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def manifest_by_hand(rows):
    groups = {}
    for row in rows:
        text = row[4]
        low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        leaf = plain_leaf(row, text)
        groups.setdefault(row[2], []).append((row[0], leaf, plain_leaf(row, low) if hit else leaf))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees[lang] = reduce_by_hand([r[1] for r in groups[lang]])
    top = reduce_by_hand([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for k, (doc, leaf, changed) in enumerate(groups[lang]):
            proof, node = "", changed
            for levels, at in ((trees[lang], k), (top, g)):
                for level in levels[:-1]:
                    first = at - at % 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    proof, node, at = proof + left + right, h(left + node + right), at // 8
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, no string"


def manifested(spark, rows, levels=3):
    docs = spark.createDataFrame([(*r, "t", "g", "n") for r in rows], DOCS).repartition(4)
    return sorted((tuple(r) for r in merkle.manifest(docs, merkle.every_third(), levels).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_like_a_plain_tree(spark, levels):
    """Several rounds of superblocks, lone leaves and more langs than a run holds."""
    rnd = random.Random(6)
    rows = [(k, rnd.choice(["web", None, "ü"]), "en", rnd.randrange(99), f"Text {k} É {'X' * (k % 7)}") for k in range(600)]
    rows += [(k, "s", f"l{k % 11}", None, rnd.choice([None, "", "ABC", "abc"])) for k in range(700, 760)]
    rows += [(900, "s", None, 3, "Lone"), (None, None, "en", None, None), (None, "a", "en", 1, "N"), (5, "other", "en", 1, "Same id")]
    rows += [(41, "s", "de", 1, "Twice")] * 20 + [(k, "s", "fr", 1, "x") for k in range(9)]
    assert manifested(spark, rows, levels) == manifest_by_hand(rows)


def test_manifest_of_small_tables(spark):
    for rows in ([], [(1, "s", None, 1, "One")], [(1, "s", "a", 1, "One"), (2, "s", "b", 2, None)], [(k, "s", "a", 1, "T" * 50_000) for k in range(9)]):
        assert manifested(spark, rows) == manifest_by_hand(rows)


def test_a_tampered_leaf_is_found(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, "Abc") for k in range(20)], "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, F.col("doc_id") == 7).where("NOT verified").collect()
    assert [r.doc_id for r in found] == [7]
