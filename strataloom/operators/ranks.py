"""Exact order statistics and global ranks without a one-task sort.

``order_statistics`` narrows every wanted rank to a value bracket with a
mergeable sketch, counts exactly what lies below the bracket, and sorts only
the values inside it. ``average_ranks`` ranks a whole column by splitting its
distinct values over buckets at sketch quantiles. ``rank_rows`` puts ranks in
the place of values row by row, over range partitions with offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

ACCURACY = 10_000
SORT_LIMIT = 1_000_000


def number(c: str) -> Column:
    """Column as double with NaN turned to null."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _narrow(df: DataFrame, wanted: dict, box: dict) -> dict:
    """One aggregate over ``df``: sketch a bracket around each rank inside ``box``."""
    # Ranks that share a bracket share one sketch.
    shared: dict[tuple, list[int]] = {}
    for (col, rank), bounds in box.items():
        shared.setdefault((col, bounds), []).append(rank)
    eps = 2.0 / ACCURACY
    exprs, asked = [], []
    for (col, (low, high, below, inside)), ranks in shared.items():
        v = number(col)
        points = []
        for rank in ranks:
            at = (rank - below + 0.5) / max(1, inside)
            points += [max(0.0, at - eps), min(1.0, at + eps)]
        exprs.append(F.percentile_approx(F.when((v >= low) & (v <= high), v), points, ACCURACY).alias(f"b{len(asked)}"))
        asked.append((col, ranks))
    row = df.agg(*exprs).first()
    edges = {(col, r): tuple(row[i][2 * j:2 * j + 2]) for i, (col, ranks) in enumerate(asked) for j, r in enumerate(ranks)}
    keys = list(box)
    counts = []
    for i, (col, rank) in enumerate(keys):
        low, high = edges[(col, rank)]
        v = number(col)
        counts.append(F.count(F.when(v < low, 1)).alias(f"c{i}"))
        counts.append(F.count(F.when((v >= low) & (v <= high), 1)).alias(f"i{i}"))
    row = df.agg(*counts).first()
    out = {}
    for i, key in enumerate(keys):
        below, inside = row[f"c{i}"], row[f"i{i}"]
        low, high = edges[key]
        if not below <= key[1] < below + inside:  # sketch missed: keep the wider, exact bracket
            low, high, below, inside = box[key]
        out[key] = (float(low), float(high), below, inside)
    return out


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], counts: Mapping[str, int], sort_limit: int = SORT_LIMIT
) -> DataFrame:
    """Exact values at 0-based ranks: ``column, rank, value``.

    ``counts`` holds the number of non-null values per column. Only bracket
    edges (two numbers per rank) reach the driver.
    """
    box = {
        (col, int(r)): (float("-inf"), float("inf"), 0, counts[col])
        for col, rs in ranks.items()
        for r in sorted(set(rs))
        if 0 <= r < counts[col]
    }
    if not box:
        return df.sparkSession.createDataFrame([], "column string, rank long, value double")
    for _ in range(4):
        wide = {k: b for k, b in box.items() if b[3] > sort_limit and b[0] < b[1]}
        if not wide:
            break
        tighter = _narrow(df, wide, wide)
        if tighter == wide:
            break
        box.update(tighter)
    # Overlapping brackets of a column are merged, so a value is tested once per column.
    merged: dict[str, list[list]] = {}
    for (col, rank), (low, high, below, _) in sorted(box.items(), key=lambda kv: (kv[0][0], kv[1][0])):
        runs = merged.setdefault(col, [])
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
            runs[-1][3].append(rank)
        else:
            runs.append([low, high, below, [rank]])
    wanted, cells, gid = [], [], 0
    for col, runs in merged.items():
        v, cell = number(col), None
        for low, high, below, rs in runs:
            test, hit = (v >= low) & (v <= high), F.struct(F.lit(gid).alias("gid"), v.alias("value"))
            cell = F.when(test, hit) if cell is None else cell.when(test, hit)
            wanted += [(gid, col, r, r - below) for r in rs]
            gid += 1
        cells.append(cell)
    values = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell"))
        .groupBy("cell.gid", "cell.value")
        .agg(F.count("*").alias("copies"))
    )
    upto = F.sum("copies").over(W.partitionBy("gid").orderBy("value"))
    placed = values.withColumn("last", upto).withColumn("first", F.col("last") - F.col("copies"))
    target = df.sparkSession.createDataFrame(wanted, "gid int, column string, rank long, local long")
    return (
        placed.join(F.broadcast(target), "gid")
        .where((F.col("local") >= F.col("first")) & (F.col("local") < F.col("last")))
        .select("column", "rank", "value")
    )


def average_ranks(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """Average 1-based rank of every distinct value of a column: ``value, avg_rank``.

    Copies of a value are counted first, so a hot value is one row. Distinct
    values are spread over sketch-quantile buckets; a bucket is sorted alone
    and shifted by the exact count in the buckets before it.
    """
    spark = df.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    grid = [i / buckets for i in range(1, buckets)]
    v = number(col)
    splits = df.agg(F.percentile_approx(v, grid, ACCURACY).alias("s")).first()["s"] or []
    splits = sorted({float(s) for s in splits})
    edges = F.lit(splits).cast("array<double>") if splits else F.array().cast("array<double>")
    values = (
        df.select(v.alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("copies"))
        .withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("value"))))
    )
    totals = values.groupBy("bucket").agg(F.sum("copies").alias("total"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    upto = F.sum("copies").over(W.partitionBy("bucket").orderBy("value"))
    return (
        values.join(F.broadcast(offsets), "bucket")
        .withColumn("last", F.col("offset") + upto)
        .select("value", (F.col("last") - (F.col("copies") - 1) / 2.0).alias("avg_rank"))
    )


Batches = Iterator[pa.RecordBatch]
ENDS = "part int, n long, first double, first_run long, last double, last_run long"


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _ends(col: str) -> Callable[[Batches], Batches]:
    """Rows of a sorted partition, with its first and last value and how often it holds them."""

    def run(batches: Batches) -> Batches:
        part, n, first, first_run, last, last_run = None, 0, None, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(col).to_numpy()
            if part is None:
                part, first = batch.column("_part")[0].as_py(), values[0]
            first_run += int((values == first).sum())
            tail = int((values == values[-1]).sum())
            last_run = tail + (last_run if values[0] == values[-1] == last else 0)
            last, n = values[-1], n + len(values)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [n], "first": [first], "first_run": [first_run], "last": [last], "last_run": [last_run]})

    return run


def _spans(ends: list) -> dict[int, tuple[int, dict[float, float]]]:
    """For each partition the rows before it and the average ranks of its first and last value, which others may hold too."""
    low: dict[float, int] = {}
    high: dict[float, int] = {}
    before, starts = 0, {}
    for e in sorted(ends, key=lambda e: e["part"]):
        starts[e["part"]] = before
        low.setdefault(e["first"], before)
        high[e["first"]] = before + e["first_run"]
        before += e["n"]
        low.setdefault(e["last"], before - e["last_run"])
        high[e["last"]] = before
    return {e["part"]: (starts[e["part"]], {v: (low[v] + high[v] + 1) / 2 for v in (e["first"], e["last"])}) for e in ends}


def _ranked(col: str, spans: dict[int, tuple[int, dict[float, float]]]) -> Callable[[Batches], Batches]:
    """Average ranks in the place of a sorted column's values; only the rows of the run that is still open are held."""

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        value, at, edges = None, 0, {}

        def closed() -> Batches:
            """The held run, all of one value."""
            n = sum(b.num_rows for b in held)
            rank = edges.get(value, at + (n + 1) / 2)
            yield from (_with(b, col, np.full(b.num_rows, rank)) for b in held)

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(col).to_numpy()
            if value is None:
                at, edges = spans[batch.column("_part")[0].as_py()]
            starts = _starts(values)
            if held and values[0] == value and len(starts) > 1:
                held.append(batch.slice(0, starts[1]))
                batch, values, starts = batch.slice(starts[1]), values[starts[1] :], starts[1:] - starts[1]
            if held and values[0] != value:
                yield from closed()
                at += sum(b.num_rows for b in held)
                held = []
            inside = starts[-1]  # runs before it end here
            if inside:
                sizes = np.diff(starts)
                ranks = at + starts[:-1] + (sizes + 1) / 2
                for k in (0, len(sizes) - 1):
                    ranks[k] = edges.get(values[starts[k]], ranks[k])
                yield _with(batch.slice(0, inside), col, np.repeat(ranks, sizes))
                at += inside
            held.append(batch.slice(inside))
            value = values[-1]
        if held:
            yield from closed()

    return run


def _with(batch: pa.RecordBatch, col: str, values: np.ndarray) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(col), col, pa.array(values, pa.float64()))


def rank_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the values of its double columns ``cols`` (no nulls) replaced by average 1-based ranks.

    Column by column, rows are dealt to range partitions of value and row
    number, so a hot value fills several. A partition's ends and size are all that
    reaches the driver; with them a second look ranks each partition alone.
    Rows keep their other columns, and nothing is joined.
    """
    rows = cut_lineage(df).withColumn("_row", F.monotonically_increasing_id())
    for col in cols:
        dealt = cut_lineage(rows.withColumn(col, F.col(col) + F.lit(0.0)).repartitionByRange(col, "_row").sortWithinPartitions(col, "_row"))
        dealt = dealt.withColumn("_part", F.spark_partition_id())
        spans = _spans(dealt.select("_part", col).mapInArrow(_ends(col), ENDS).collect())
        rows = dealt.mapInArrow(_ranked(col, spans), dealt.schema).drop("_part")
    return rows.drop("_row")


def row_index(df: DataFrame, key: str, by=(), buckets: int | None = None, name: str = "row_idx") -> DataFrame:
    """0-based position by a unique numeric ``key`` within ``by``, for groups of any size.

    Rows are spread over sketch-quantile buckets of the key, so a group that
    holds a third of the table is numbered by many tasks.
    """
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    by = list(by)
    v = number(key)
    splits = df.agg(F.percentile_approx(v, [i / buckets for i in range(1, buckets)], ACCURACY).alias("s")).first()["s"] or []
    splits = sorted({float(s) for s in splits})
    edges = F.lit(splits).cast("array<double>") if splits else F.array().cast("array<double>")
    placed = df.withColumn("_bucket", F.size(F.filter(edges, lambda e: e < v)))
    totals = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_total"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(key))
    return (
        placed.withColumn("_local", local)
        .join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_local") - 1)
        .drop("_bucket", "_local", "_offset")
    )
