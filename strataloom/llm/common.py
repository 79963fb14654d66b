"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` bears them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(text: str = "text") -> Column:
    """64-bit content key that tells rows with one id and different texts apart."""
    return F.xxhash64(F.col(text))


def chained(*steps: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """One ``mapInArrow`` function out of several, so rows cross to Python once."""

    def run(batches: Batches) -> Batches:
        for step in steps:
            batches = step(batches)
        return batches

    return run


#: Cached makers, by name, of what a worker keeps from task to task.
KEPT: dict[str, Callable] = {}


def lean(run: Callable[[Batches], Batches], keeps: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` in a worker that lives on beside other stages.

    Before it, what tasks of other operators keep in the worker goes, all but that of the maker named ``keeps``; after
    each task what was freed goes back to the system.
    """

    def own(batches: Batches) -> Batches:
        gone = [maker for name, maker in KEPT.items() if name != keeps and maker.cache_info().currsize]
        for maker in gone:
            maker.cache_clear()
        if gone:
            gc.collect()
            _trim()
        yield from run(batches)
        _trim()

    return own


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def packed(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] = lambda row: 64, most: int = 4 << 20) -> Batches:
    """Record batches of about ``most`` bytes from row tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(name).to_pylist() for name in names]


def slices(batches: Batches, rows: int = 256) -> Batches:
    """Small batches, so that the Python objects of one are few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def linked(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Components of undirected ``edges``: a row ``id, component_id`` (smallest id) for each id that has an edge.

    Alternates large-star and small-star steps, which keep the number of edges
    bounded by the input and end in stars around the smallest ids after a
    logarithmic number of rounds. Each round is checkpointed. A hub is only
    ever met by grouping, with partial aggregation, and by a join in which
    Spark may split its rows.
    """
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _mark(now)
    for _ in range(rounds):
        for step in (_large_star, _small_star):
            now = cut_lineage(step(now))
        last, seen = seen, _mark(now)
        if last == seen:
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # nodes without smaller neighbours are their own smallest
    return (
        both.join(least, "u", "left").where("v > u")
        .select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def word_digests(words: list[bytes], digest: Callable[[bytes], bytes]) -> np.ndarray:
    """``n x 2`` unsigned 64-bit halves of a 16-byte digest of each word."""
    return np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, 2)


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all runs of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    step = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        if width <= 8:
            for k in range(width):
                total = total * step + values[k : k + n]
            return total
        powers = np.cumprod(np.full(len(values), step, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers)])
        inverse = np.cumprod(np.full(n, np.uint64(pow(int(step), -1, 1 << 64)), np.uint64))
        return mixed((sums[width:] - sums[:n]) * inverse)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a work folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
