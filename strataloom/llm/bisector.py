"""Centroid clustering by a tournament of integer bisectors.

Vectors and centroids are integers. Between centroids ``a < b`` lies the
bisector ``x . 2 (b - a) = |b|^2 - |a|^2``; normals and thresholds of all pairs
are computed once per round. A vector plays ``k - 1`` tests: the winner so far
against the next centroid, which wins only if the sign is positive, so a zero
favours the smaller number. All numbers are exact: float64 while every sum
stays below 2^53, 64-bit integers below 2^63, Python integers above. Tasks
carry ``k`` sums each; only ``k`` times the dimension numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Batches, packed
from strataloom.session import cut_lineage

POINTS = pa.schema([("vec_id", pa.int64()), ("point", pa.binary())])
SUMS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.decimal128(38, 0))])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.decimal128(38, 0))])
LARGEST = (1 << 63) - 1


def _grid_batches(width: int, scale: float) -> Callable[[Batches], Batches]:
    """Vectors of ``width`` usable components as 64-bit integers ``floor(scale * x)``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("embedding")
            fits = np.asarray(lists.value_lengths().fill_null(-1)) == width  # null lists have no length
            kept = np.flatnonzero(fits)
            if not len(kept):
                continue
            flat = lists.take(pa.array(kept)).flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(len(kept), width)
            with np.errstate(over="ignore", invalid="ignore"):
                grid = np.floor(x * scale)
            usable = (np.isfinite(x) & (np.abs(grid) < 2.0**52)).all(axis=1)
            own = batch.column("vec_id").take(pa.array(kept[usable]))
            values = grid[usable].astype(np.int64)
            yield pa.RecordBatch.from_arrays([own, pa.array([v.tobytes() for v in values], pa.binary())], schema=POINTS)

    return run


class Bisectors:
    """Normals and thresholds between all pairs of centroids, in the smallest number type that is exact."""

    def __init__(self, centroids: list[list[int]], reach: int):
        """``reach``: no component of a vector is larger."""
        self.k = len(centroids)
        largest = max([reach, *(abs(v) for c in centroids for v in c)])
        bound = 8 * max(1, len(centroids[0])) * (largest + 1) ** 2
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
        c = np.array(centroids, object)
        square = [int(sum(v * v for v in row)) for row in centroids]
        self.centroids = c.astype(self.kind)
        self.normals = {(a, b): (2 * (c[b] - c[a])).astype(self.kind) for b in range(self.k) for a in range(b)}
        self.thresholds = {(a, b): square[b] - square[a] for b in range(self.k) for a in range(b)}

    def winners(self, points: np.ndarray) -> np.ndarray:
        x = points.astype(self.kind)
        champion = np.zeros(len(x), np.int64)
        for b in range(1, self.k):
            before = champion.copy()
            for a in range(b):
                rows = np.flatnonzero(before == a)
                if len(rows):
                    champion[rows[x[rows] @ self.normals[a, b] > self.thresholds[a, b]]] = b
        return champion

    def distances(self, points: np.ndarray, champion: np.ndarray) -> list[int]:
        away = points.astype(self.kind) - self.centroids[champion]
        return [int(d) for d in (away * away).sum(axis=1)]


def _played(centroids: list[list[int]]) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, Bisectors]]:
    made: dict[int, Bisectors] = {}

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Bisectors]:
        points = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.int64).reshape(batch.num_rows, -1)
        reach = 1 << max(20, int(np.abs(points).max(initial=0)).bit_length())
        if reach not in made:
            made[reach] = Bisectors(centroids, reach)
        return points, made[reach].winners(points), made[reach]

    return run


def _sum_batches(centroids: list[list[int]]) -> Callable[[Batches], Batches]:
    """Per cluster the exact sum of each dimension over a task; dimension -1 counts vectors."""
    k, width = len(centroids), len(centroids[0])

    def run(batches: Batches) -> Batches:
        play = _played(centroids)
        high, low, count = np.zeros((k, width), np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points, winner, _ = play(batch)
            for c in range(k):
                own = points[winner == c]
                high[c] += (own >> 32).sum(axis=0)
                low[c] += (own & 0xFFFFFFFF).sum(axis=0)
                count[c] += len(own)
        yield from packed(
            ((c, d, Decimal(int(count[c]) if d < 0 else (int(high[c, d]) << 32) + int(low[c, d]))) for c in range(k) if count[c] for d in range(-1, width)), SUMS
        )

    return run


def _assign_batches(centroids: list[list[int]]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        play = _played(centroids)
        for batch in batches:
            if batch.num_rows:
                points, winner, tests = play(batch)
                away = [Decimal(d) for d in tests.distances(points, winner)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(winner, pa.int32()), pa.array(away, ASSIGNED.field("distance").type)], schema=ASSIGNED)

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every usable row of ``vectors(vec_id, embedding)``.

    Rows with a null vector, another number of components, or a component that
    is null, not finite or (times ``scale``) 2^52 or more are left out. The
    first centroids are the ``k`` rows of smallest SHA-256 of ``seed:vec_id``;
    rows of one id are taken by their components, a null id last. With
    fewer rows than ``k`` each is a centroid. Equal centroids: the smaller
    number keeps the vectors, the other stays as it is. A distance or sum
    beyond 64 bits is null. No usable row: no result.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    points = cut_lineage(source.mapInArrow(_grid_batches(width, float(scale)), "vec_id long, point binary"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(order.asc_nulls_last(), "point").limit(k).collect()
    centroids = [np.frombuffer(r.point, np.int64).tolist() for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        parts = points.mapInArrow(_sum_batches(centroids), "cluster int, dim int, total decimal(38,0)")
        sums = {(r.cluster, r.dim): int(r.total) for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()}
        moved = [[sums[c, d] // sums[c, -1] for d in range(width)] if (c, -1) in sums else centroids[c] for c in range(len(centroids))]
        if moved == centroids:
            break  # every further round would do the same
        centroids = moved
    assigned = cut_lineage(points.mapInArrow(_assign_batches(centroids), "vec_id long, cluster int, distance decimal(38,0)"))
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, _long(inertia[c]), _long(whole), digests[c]) for c in sorted(inertia)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(of), "cluster")  # k rows
    return out.select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: Decimal | int | None) -> int | None:
    return int(value) if value is not None and value <= LARGEST else None


def sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same in DuckDB, a pair of tables for each round."""
    nearest = (
        "SELECT v.vec_id, v.x, c.no, sum((a - b) * (a - b)) AS d FROM v, {c} c, LATERAL (SELECT unnest(v.x)::HUGEINT AS a, unnest(c.x)::HUGEINT AS b) GROUP BY v.vec_id, v.x, c.no "
        "QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.no) = 1"
    )
    parts = [
        f"e AS (SELECT vec_id, list_transform(embedding, lambda q: q::DOUBLE) AS y FROM embeddings WHERE len(embedding) = {width})",
        f"v AS (SELECT vec_id, list_transform(y, lambda q: floor({scale} * q)::BIGINT) AS x FROM e WHERE len(list_filter(y, lambda q: q IS NULL OR NOT isfinite(q))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS no, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(f"n{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        parts.append(f"s{r} AS (SELECT no, i, sum(w::HUGEINT) AS s, count(*) AS n FROM (SELECT no, unnest(range(1, {width + 1})) AS i, unnest(x) AS w FROM n{r}) GROUP BY no, i)")
        parts.append(f"m{r} AS (SELECT no, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY no)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.no, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.no = m.no)")
    parts.append(f"n{rounds} AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, n.no::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY n.no))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM n{rounds} n JOIN c{rounds} c ON n.no = c.no"
    )
