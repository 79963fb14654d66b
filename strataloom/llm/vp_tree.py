"""Nearest neighbours by largest inner product with vantage-point trees.

With one more component, ``sqrt(M^2 - |x|^2)`` for an item (``M`` is the
largest norm) and 0 for a query, the largest inner product is the smallest
Euclidean distance, so the triangle inequality holds. A tree over a bounded
sample deals items into shards; each shard has a tree of its own. A query
first searches one part of the shard nearest to it, and then with the distance
of its worst hit only the shards whose lower bound, times ``factor``, is within
it. Within a shard buckets are met in order of their bounds and left out by
the same rule. Factor one loses nothing; a larger one prunes more.

Equal vectors are one item with its ``k + 1`` smallest ids. Blocks of queries
and parts of shards are bounded, so a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import Batches, packed, slices
from strataloom.session import cut_lineage

SAMPLE = 16_384  # items that the upper tree is built from, in expectation
LEAVES = 1024  # shards of the upper tree at most; those that grow too large are parted by hash
SHARD_BYTES = 8 << 20  # of the items of a part
BLOCK = 4096  # queries that a task searches one part for
BUCKET = 256
CHUNK = 512  # queries searched at a time

ROWS = "vec_id long, dim int, key binary, log_norm double, vector binary"
ROWS_ARROW = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()), ("log_norm", pa.float64()), ("vector", pa.binary())])
HITS = "key binary, vec_id long, score double, worst double"
HITS_ARROW = pa.schema([("key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64()), ("worst", pa.float64())])


def _row_batches(batches: Batches) -> Batches:
    """Usable rows as doubles, with a key of the content."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for vec, values in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
                if not vec.is_valid or not values.is_valid or not len(values) or values.values.null_count:
                    continue
                x = values.values.to_numpy() + 0.0  # -0.0 is 0.0
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    yield vec.as_py(), len(x), blake2b(raw, digest_size=16).digest(), _log_norm(x), raw

    yield from packed(rows(), ROWS_ARROW, lambda row: 64 + len(row[4]))


def _log_norm(x: np.ndarray) -> float:
    """Binary logarithm of the length, which does not overflow."""
    exponent = min(1023, int(np.frexp(np.abs(x).max())[1]))
    unit = x / 2.0**exponent
    return float(np.log2(unit @ unit) / 2 + exponent)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.cumsum(x * y, axis=1)[:, -1]


class Tree:
    """A vantage-point tree over rows of ``points``; node ``i`` has children ``2 i + 1`` (near) and ``2 i + 2``, and all leaves one depth."""

    def __init__(self, points: np.ndarray, bucket: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(points)) / bucket))))
        self.vantage = np.zeros(((1 << self.depth) - 1, points.shape[1]))
        self.radius = np.zeros(len(self.vantage))
        groups = [np.arange(len(points))]
        for level in range(self.depth):
            below = []
            for k, own in enumerate(groups):
                node = (1 << level) - 1 + k
                at = _vantage(points, own)
                away = _distances(points[own], at[None])[:, 0] if len(own) else np.zeros(0)
                order = np.argsort(away, kind="stable")
                half = len(own) // 2
                self.vantage[node], self.radius[node] = at, away[order[half - 1]] if half else 0.0
                below += [own[order[:half]], own[order[half:]]]
            groups = below
        self.groups = groups

    def ancestors(self) -> np.ndarray:
        """The nodes above each leaf, from the root."""
        leaf = np.arange(1 << self.depth)
        return np.stack([(1 << level) - 1 + (leaf >> (self.depth - level)) for level in range(self.depth)], axis=1) if self.depth else np.zeros((1, 0), np.int64)

    def spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each leaf's points to each node above it; an empty leaf is out of reach."""
        above = self.ancestors()
        low, high = np.full(above.shape, np.inf), np.full(above.shape, -np.inf)
        for leaf, own in enumerate(self.groups):
            if len(own) and self.depth:
                d = _distances(points[own], self.vantage[above[leaf]])
                low[leaf], high[leaf] = d.min(axis=0), d.max(axis=0)
        return low, high

    def routed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point by the radii, and its distances to the nodes on its way."""
        node, path = np.zeros(len(points), np.int64), np.zeros((len(points), self.depth))
        away = _distances(points, self.vantage) if self.depth else None
        for level in range(self.depth):
            d = away[np.arange(len(points)), node]
            path[:, level] = d
            node = 2 * node + np.where(d <= self.radius[node], 1, 2)
        return node - ((1 << self.depth) - 1), path


def _vantage(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of a few points the one whose distances to others differ most."""
    if not len(own):
        return points[0]
    tried = own[:: max(1, len(own) // 8)][:8]
    seen = own[:: max(1, len(own) // 256)]
    return points[tried[_distances(points[seen], points[tried]).std(axis=0).argmax()]]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(0.0, square))


def _bounds(away: np.ndarray, above: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of each query to each leaf, from its distances to the nodes."""
    bound = np.where(np.isinf(low).any(axis=1), np.inf, 0.0)[None].repeat(len(away), axis=0)
    for level in range(above.shape[1]):
        d = away[:, above[:, level]]
        with np.errstate(invalid="ignore"):
            bound = np.maximum(bound, np.maximum(low[None, :, level] - d, d - high[None, :, level]))
    return bound


class Space:
    """Vectors scaled by a power of two and lifted so that inner products become distances."""

    def __init__(self, log_norm: float):
        exponent = min(1000, max(-1000, -int(np.floor(log_norm)) - 1))
        self.scale = float(2.0**exponent)
        self.norm = float(2.0 ** (log_norm + exponent)) * (1 + 1e-9)

    def items(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """A query's length does not matter for its order, so it gets the items' norm, which keeps rounding alike for all."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x *= self.norm / np.sqrt((x * x).sum(axis=1))[:, None]
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def reach(self, cosine: np.ndarray) -> np.ndarray:
        """Distance of an item whose inner product with a lifted query is ``cosine``."""
        return np.sqrt(np.maximum(0.0, 2.0 * self.norm**2 - 2.0 * cosine)) + SLACK

    def lifted(self, scores: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Inner products with lifted queries, from those with the queries themselves."""
        most = np.abs(queries).max(axis=1)
        length = most * np.sqrt(((queries / most[:, None]) ** 2).sum(axis=1))
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(scores / length * self.scale * self.norm, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)  # infinite scores bound nothing


SLACK = 1e-6  # distances are known to about 1e-8 of the norm, which is 0.5 to 1


def search(queries: np.ndarray, worst: np.ndarray, items: np.ndarray, least: np.ndarray, most: int, factor: float, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, item and score of the ``most`` best items of each query (ties: smaller ``least``), and how many pairs were met.

    ``worst``: score that a hit must reach, known from elsewhere.
    """
    lifted = space.items(items)
    tree = Tree(lifted, BUCKET)
    above, (low, high) = tree.ancestors(), tree.spans(lifted)
    out, met = [], 0
    for first in range(0, len(queries), CHUNK):
        own = queries[first : first + CHUNK]
        q, floor_ = space.queries(own), worst[first : first + CHUNK].copy()
        bound = _bounds(_distances(q, tree.vantage), above, low, high) if tree.depth else np.zeros((len(q), 1))
        order = np.argsort(bound, axis=1, kind="stable")
        open_ = np.arange(len(q))
        state = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for rank in range(len(tree.groups)):
            reach = space.reach(space.lifted(floor_[open_], own[open_]))
            open_ = open_[bound[open_, order[open_, rank]] * factor <= reach]
            if not len(open_):
                break
            at, found = order[open_, rank], [state]
            for leaf in np.unique(at):
                who, inside = open_[at == leaf], tree.groups[leaf]
                if not len(inside):
                    continue
                rough = q[who] @ lifted[inside].T
                met += rough.size
                bar = space.lifted(floor_[who], own[who])
                if len(inside) > most:
                    bar = np.maximum(bar, np.partition(rough, -most, axis=1)[:, -most])
                a, b = np.nonzero(rough >= bar[:, None] - 1e-9)
                a, b = who[a], inside[b]
                score = np.concatenate([_dots(own[a[s : s + 65536]], items[b[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
                found.append((a, b, score))
            state = _best([np.concatenate(x) for x in zip(*found, strict=True)], least, most)
            full = np.bincount(state[0], minlength=len(q)) == most
            last = np.flatnonzero(np.append(np.diff(state[0]) != 0, True)) if len(state[0]) else np.zeros(0, np.int64)
            ends = np.full(len(q), -np.inf)
            ends[state[0][last]] = state[2][last]
            floor_ = np.where(full, np.fmax(floor_, ends), floor_)
        out.append((state[0] + first, state[1], state[2]))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), met


def _best(found: list[np.ndarray], least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` of each query by falling score and rising id; scores that are no number come last."""
    who, item, score = found
    order = np.lexsort((least[item], -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), who))
    who, item, score = who[order], item[order], score[order]
    start = np.searchsorted(who, who)
    keep = np.arange(len(who)) - start < most
    return who[keep], item[keep], score[keep]


def _searched(most: int, factor: float, log_norm: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Hits of a block of queries in a part of a shard, at most ``most`` ids for each query; ``worst`` is set if there are as many."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        if not queries.num_rows or not items.num_rows:
            return HITS_ARROW.empty_table()
        q, x = _matrix(queries), _matrix(items)
        ids = [sorted(v) for v in items["ids"].to_pylist()]
        least = np.array([v[0] for v in ids], np.int64)
        worst = np.array([-np.inf if v is None else v for v in queries["worst"].to_pylist()])
        who, item, score, _ = search(q, worst, x, least, most, factor, Space(log_norm))
        n = np.array([len(v) for v in ids], np.int64)[item]
        who, score = np.repeat(who, n), np.repeat(score, n)
        own = np.array([v for k in item for v in ids[k]], np.int64)
        who, own, score = _best([who, own, score], _Same(), most)
        keys = queries["key"].combine_chunks()
        starts = np.searchsorted(who, who)
        full = np.bincount(who, minlength=len(q))[who] == most
        ends = score[np.minimum(starts + most, len(score)) - 1] if len(score) else score
        return pa.Table.from_arrays([keys.take(pa.array(who)), pa.array(own), pa.array(score), pa.array(np.where(full, ends, -np.inf))], schema=HITS_ARROW)

    return run


class _Same:
    """Ids that order themselves."""

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        return ids


def _matrix(rows: pa.Table) -> np.ndarray:
    raw = rows["vector"].to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _routed(tree: Tree, space: Space) -> Callable[[Batches], Batches]:
    """Items of the tree's dimension with their leaf and the distances on the way; others are in leaf 0 without distances."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 1024):
            leaf, path = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
            own = np.flatnonzero(np.asarray(batch.column("dim")) == tree.vantage.shape[1] - 1)
            if len(own) and tree.depth:
                leaf[own], d = tree.routed(space.items(_matrix(pa.Table.from_batches([batch.take(pa.array(own))]))))
                for k, values in zip(own, d.tolist(), strict=True):
                    path[k] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(path, pa.list_(pa.float64()))], names=[*batch.schema.names, "leaf", "path"])

    return run


def _visits(tree: Tree, low: np.ndarray, high: np.ndarray, factor: float, space: Space, home: bool) -> Callable[[Batches], Batches]:
    """The leaf nearest to each query (``home``), or every leaf within reach of its worst hit; the home leaf is among them."""
    above = tree.ancestors()
    schema = pa.schema([("key", pa.binary()), ("dim", pa.int32()), ("vector", pa.binary()), ("worst", pa.float64()), ("leaf", pa.int32())])

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, CHUNK):
            mine = np.asarray(batch.column("dim")) == tree.vantage.shape[1] - 1
            rows, leaf = np.flatnonzero(~mine), np.zeros((~mine).sum(), np.int64)
            own = np.flatnonzero(mine)
            if len(own):
                x = _matrix(pa.Table.from_batches([batch.take(pa.array(own))]))
                bound = _bounds(_distances(space.queries(x), tree.vantage), above, low, high) if tree.depth else np.zeros((len(x), 1))
                if home:
                    a, b = np.arange(len(own)), bound.argmin(axis=1)
                else:
                    worst = np.array([-np.inf if v is None else v for v in batch.column("worst").to_pylist()])[own]
                    a, b = np.nonzero((bound * factor <= space.reach(space.lifted(worst, x))[:, None]) & np.isfinite(bound))
                rows, leaf = np.concatenate([rows, own[a]]), np.concatenate([leaf, b])
            for s in range(0, len(rows), 4096):
                taken = batch.select(["key", "dim", "vector", "worst"]).take(pa.array(rows[s : s + 4096]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf[s : s + 4096], pa.int32())], schema=schema)

    return run


VISIT = "key binary, dim int, vector binary, worst double, leaf int"


def nearest(vectors: DataFrame, is_query: str, k: int = 20, factor: float = 1.0, shard_bytes: int = SHARD_BYTES, leaves: int = LEAVES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each row that ``is_query`` (SQL over ``vec_id``) names.

    ``vectors(vec_id, embedding)``; only vectors of one length are compared. Null
    ids and vectors that are null, empty, zero or hold a null or non-finite
    component take no part. A row is no candidate for queries of its own id;
    rows equal in id and vector count once, queries of one id and different
    vectors are answered each. Ties go to the smaller id. A score that
    overflows is infinite, one that is no number comes last. Fewer
    candidates than ``k``: all of them. An empty table gives no rows.
    """
    spark, most = vectors.sparkSession, k + 1
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut_lineage(source.mapInArrow(_row_batches, ROWS))
    first = Window.partitionBy("key").orderBy("vec_id")
    own_ids = rows.select("key", "vec_id").distinct().withColumn("no", F.row_number().over(first)).where(F.col("no") <= most)
    ids = own_ids.groupBy("key").agg(F.collect_list("vec_id").alias("ids"))  # k + 1 at most
    one = rows.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.max(F.expr(is_query).cast("int")).alias("asks"))
    items = cut_lineage(one.join(ids, "key"))

    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, total = (sizes[0].dim, sizes[0].n) if sizes else (1, 0)
    log_norm = rows.agg(F.coalesce(F.max("log_norm"), F.lit(0.0))).first()[0]
    space = Space(log_norm)
    share = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < F.lit(float(SAMPLE) * (1 << 30) / max(1, total))
    sample = _matrix(items.where((F.col("dim") == dim) & share).select("vector").toArrow()) if total else np.zeros((0, dim))
    per_part = max(1, shard_bytes // (8 * (dim + 1)))
    wanted = min(leaves, -(-total // per_part))
    tree = Tree(space.items(sample) if len(sample) else np.zeros((0, dim + 1)), max(4, -(-len(sample) // max(1, wanted))))

    kind = "key binary, dim int, vector binary, asks int, ids array<long>, leaf int, path array<double>"
    placed = cut_lineage(items.mapInArrow(_routed(tree, space), kind))
    reach = (f(F.try_element_at("path", F.lit(level + 1))).alias(f"{name}{level}") for level in range(tree.depth) for name, f in (("low", F.min), ("high", F.max)))
    spans = cut_lineage(placed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), *reach))
    low, high = np.full((1 << tree.depth, tree.depth), np.inf), np.full((1 << tree.depth, tree.depth), -np.inf)
    for r in spans.where(F.col("dim") == dim).collect():  # a row per leaf of the upper tree
        low[r.leaf], high[r.leaf] = [r[f"low{x}"] for x in range(tree.depth)], [r[f"high{x}"] for x in range(tree.depth)]

    parts = F.ceil(F.col("n") * 8.0 * (F.col("dim") + 1) / F.lit(shard_bytes)).cast("int")
    shards = spans.select("dim", "leaf", parts.alias("parts"))
    shelved = placed.join(shards, ["dim", "leaf"]).select("dim", "leaf", F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts")).cast("int").alias("part"), "vector", "ids")
    shelved = cut_lineage(shelved)
    asked = placed.where("asks = 1").select("key", "dim", "vector", F.lit(None).cast("double").alias("worst"))
    search_part = _searched(most, factor, log_norm)

    homes = asked.mapInArrow(_visits(tree, low, high, factor, space, True), VISIT).join(shards, ["dim", "leaf"])
    homes = cut_lineage(homes.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    begun = cut_lineage(_met(homes, shelved, search_part))
    worst = begun.groupBy("key").agg(F.max("worst").alias("worst"))
    known = homes.drop("worst").join(worst, "key", "left").select("key", "dim", "vector", "worst", F.col("leaf").alias("home"), F.col("part").alias("home_part"))
    known = cut_lineage(known)
    onward = known.select("key", "dim", "vector", "worst").mapInArrow(_visits(tree, low, high, factor, space, False), VISIT).join(shards, ["dim", "leaf"])
    onward = onward.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    been = known.select("key", F.col("home").alias("leaf"), F.col("home_part").alias("part"))
    onward = cut_lineage(onward.join(been, ["key", "leaf", "part"], "left_anti"))
    hits = begun.unionByName(_met(onward, shelved, search_part)).select("key", "vec_id", "score")

    order = [F.when(F.isnan("score"), F.lit(1)).otherwise(F.lit(0)), F.desc("score"), "vec_id"]
    best = hits.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("no") <= most).drop("no")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "key").distinct()
    answers = queries.join(best, "key").where("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(queries: DataFrame, items: DataFrame, search_part: Callable) -> DataFrame:
    """Blocks of the queries of each part beside its items."""
    many = queries.groupBy("dim", "leaf", "part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    many = cut_lineage(many)
    dealt = queries.join(many, ["dim", "leaf", "part"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    copied = items.join(many, ["dim", "leaf", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ("dim", "leaf", "part", "block")
    asked = dealt.select(*by, "key", "vector", "worst").groupBy(*by)
    return asked.cogroup(copied.select(*by, "vector", "ids").groupBy(*by)).applyInArrow(search_part, HITS)


#: The same in DuckDB for factor one.
SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) > 0),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
