"""Exact set similarity join: packed blocks of sets beside packed blocks of sets, no candidate pair or set copied over a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

BLOCK_TOKENS = 1 << 20  # of a block, at most but for a longer set
BLOCKS = 24  # of a small input, so that all cores have work
HITS = 1 << 20  # shared tokens looked at together
CELLS = 1 << 21  # tokens of right sets counted together
FLAGS = 1 << 24  # marks held at a time
SPARE = 16  # for so many tokens that a pair must share, one more shared rare token is asked before it is compared

Batches = Iterator[pa.RecordBatch]


def _once(batches: Batches) -> Batches:
    """Rows as they are, but tokens only where a task meets a set first."""
    seen: set = set()
    for batch in batches:
        new = []
        for key in batch.column("set_id").to_pylist():
            new.append(key not in seen)
            seen.add(key)
        at = batch.schema.get_field_index("tokens")
        yield batch.set_column(at, "tokens", pc.if_else(pa.array(new, pa.bool_()), batch.column(at), pa.scalar(None, batch.column(at).type)))


def _pack(most: int) -> Callable[[Batches], Batches]:
    """Sets in order of size to blocks of about ``most`` tokens; equal sets stand side by side and stay once."""

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table["tokens"].combine_chunks()
        words, codes = np.unique(np.asarray(lists.flatten(), np.int64), return_inverse=True)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        columns = {"ids": table["set_id"].combine_chunks(), "n": pa.array(n), "words": pa.array(words), "codes": pa.array(codes.astype(np.int32))}
        one = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for name, values in columns.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(one)
        return pa.RecordBatch.from_pydict({"low": pa.array([n.min()], pa.int32()), "high": pa.array([n.max()], pa.int32()), "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Batches) -> Batches:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("set_id")
            new = np.ones(len(ids), bool)
            new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or ids[0].as_py() != last
            last = ids[-1].as_py()
            batch = batch.filter(pa.array(new))
            ends, start = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + (not held), int(np.searchsorted(ends, before + most - size, side="right")))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1]) - before
                start = stop
                if start < batch.num_rows:
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    return run


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places ``first[i], first[i] + 1, ...``, ``count[i]`` of each."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)


class _Side:
    """One block, and how its tokens stand when another block gives their order."""

    def __init__(self, block: bytes):
        row = pa.ipc.open_file(block).read_all()
        self.ids, n, words, codes = (row[name].combine_chunks().flatten() for name in ("ids", "n", "words", "codes"))
        self.n, self.words, self.codes = n.to_numpy().astype(np.int64), words.to_numpy(), codes.to_numpy()
        self.copies = np.bincount(self.codes, minlength=len(self.words))

    def lay(self, rank: np.ndarray, v: int, need: np.ndarray) -> None:
        """Tokens of each set by ``rank``, those of this block alone first; ``head``: what a set that shares ``need`` must share ``least`` of."""
        place = rank[self.codes]
        shared = place >= 0
        key = np.repeat(np.arange(len(self.n)), self.n)[shared] * v + place[shared]
        key.sort()
        self.row, self.rank = np.divmod(key, v)
        self.held = np.bincount(self.row, minlength=len(self.n))
        self.first = np.cumsum(self.held) - self.held
        self.at = np.arange(len(key)) - (self.first - self.n + self.held)[self.row]
        self.least = 1 + need // SPARE
        self.head = np.flatnonzero(self.at < np.where(need > self.n, 0, self.n - need + self.least)[self.row])


def _needs(threshold: float, measure: str):
    """Least overlap of sets of two sizes, and of each set of one side with any of the other."""
    t = threshold
    if measure == "jaccard":
        pair = lambda x, y: np.ceil(t / (1 + t) * (x + y) - 1e-6)
        one = lambda n, others: np.where(others.max() < t * n - 1e-6, n + 1, pair(n, np.maximum(np.ceil(t * n - 1e-6), others.min())))
        return pair, one, one
    pair = lambda x, y: np.ceil(t * x - 1e-6) + 0 * y
    return pair, lambda n, others: pair(n, n), lambda n, others: pair(others.min(), n)


def _pairs(x: _Side, y: _Side, threshold: float, measure: str, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and scores of the pairs of two blocks that reach ``threshold``; of one block with itself each pair once.

    Tokens are ordered by how often both blocks hold them. Of the first tokens,
    some longer a stretch than for one, a pair must share several; on the first
    shared token what is left of either set bounds the overlap.
    """
    pair, of_x, of_y = _needs(threshold, measure)
    at = np.minimum(np.searchsorted(y.words, x.words), len(y.words) - 1)
    in_x = np.flatnonzero(y.words[at] == x.words)
    in_y, v = at[in_x], len(in_x)
    if not v:
        return
    order = np.argsort(x.copies[in_x] + y.copies[in_y], kind="stable")
    for side, own, need in ((x, in_x, of_x(x.n, y.n)), (y, in_y, of_y(y.n, x.n))):
        rank = np.full(len(side.words), -1, np.int64)
        rank[own[order]] = np.arange(v)
        side.lay(rank, v, np.maximum(need, 1).astype(np.int64))
        if x is y:
            break
    post = y.head[np.argsort(y.rank[y.head], kind="stable")]
    count = np.bincount(y.rank[post], minlength=v)
    begin = np.cumsum(count) - count
    rows, met = x.row[x.head], count[x.rank[x.head]]
    ends, start = np.cumsum(met), 0
    flags = np.zeros(max(1, FLAGS // v) * v, bool)
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, side="right")))
        if stop < len(rows):  # a set is looked at whole
            edge = int(np.searchsorted(rows, rows[stop]))
            stop = edge if edge > start else int(np.searchsorted(rows, rows[stop], side="right"))
        own = np.repeat(x.head[start:stop], met[start:stop])
        other = post[_spans(begin[x.rank[x.head[start:stop]]], met[start:stop])]
        key, start = x.row[own] * len(y.n) + y.row[other], stop
        key, once, shared = np.unique(key, return_index=True, return_counts=True)  # the first of a pair is its rarest token
        a, b = np.divmod(key, len(y.n))
        good = np.minimum(x.n[a] - x.at[own[once]], y.n[b] - y.at[other[once]]) >= pair(x.n[a], y.n[b])
        good &= shared >= np.minimum(x.least[a], y.least[b])
        if same:
            good &= a < b
        a, b = a[good], b[good]
        if len(a):
            both = _overlaps(x, y, a, b, v, flags)
            score = both / (x.n[a] + y.n[b] - both) if measure == "jaccard" else both / x.n[a]
            kept = score >= threshold - 1e-12
            yield a[kept], b[kept], score[kept]


def _overlaps(x: _Side, y: _Side, a: np.ndarray, b: np.ndarray, v: int, flags: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs in order of ``a``: some left sets are marked, then the tokens of their right sets looked up."""
    lefts, place = np.unique(a, return_inverse=True)
    cells, room, start, out = np.cumsum(y.held[b]), len(flags) // v, 0, []
    while start < len(a):
        stop = min(int(np.searchsorted(place, place[start] + room)), int(np.searchsorted(cells, (cells[start - 1] if start else 0) + CELLS, side="right")))
        stop = max(start + 1, stop)
        some, held = lefts[place[start] : place[stop - 1] + 1], y.held[b[start:stop]]
        marks = np.repeat(np.arange(len(some)) * v, x.held[some]) + x.rank[_spans(x.first[some], x.held[some])]
        flags[marks] = True
        hit = flags[np.repeat((place[start:stop] - place[start]) * v, held) + y.rank[_spans(y.first[b[start:stop]], held)]]
        out.append(np.add.reduceat(hit, np.cumsum(held) - held, dtype=np.int64))
        flags[marks] = False
        start = stop
    return np.concatenate(out)


def _meet(threshold: float, measure: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("same")[i].as_py()
                x = _Side(batch.column("left_block")[i].as_py())
                y = x if same else _Side(batch.column("right_block")[i].as_py())
                for a, b, score in _pairs(x, y, threshold, measure, same):
                    for s in range(0, len(a), 1 << 16):
                        some = slice(s, s + (1 << 16))
                        yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(a[some])), y.ids.take(pa.array(b[some])), pa.array(score[some])], names=["left_set", "right_set", "score"])

    return run


def hashed(sets: DataFrame) -> DataFrame:
    """``sets`` with 64-bit hashes for ``tokens``, written once; null where ``set_id`` has come before. Null and empty sets go."""
    hashes = sets.where(F.col("set_id").isNotNull() & (F.size("tokens") > 0)).withColumn("tokens", F.transform("tokens", lambda w: F.xxhash64(w)))
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in hashes.schema)
    return cut_lineage(hashes.mapInArrow(_once, schema))


def _blocks(held: DataFrame) -> DataFrame:
    """``no, low, high, block``, about one block a partition: the sets of :func:`hashed` by size, each once."""
    held = held.where("tokens IS NOT NULL").select("set_id", F.size("tokens").alias("n"), "tokens")
    total = held.agg(F.sum("n")).first()[0] or 0
    most = int(min(BLOCK_TOKENS, max(1 << 16, total // BLOCKS)))
    parts = max(1, -(-int(total) // most))
    ranged = held.repartitionByRange(parts, "n", "set_id").sortWithinPartitions("n", "set_id").coalesce(parts)
    packed = cut_lineage(ranged.select("set_id", "tokens").mapInArrow(_pack(most), "low int, high int, block binary"))
    return cut_lineage(packed.withColumn("no", F.monotonically_increasing_id()).repartition(max(1, packed.count())))


def block_pairs(left: DataFrame, right: DataFrame | None, threshold: float, measure: str = "jaccard") -> DataFrame:
    """Pairs of sets at or above ``threshold``: ``left_set, right_set, score``; without ``right`` each pair of different sets once.

    ``left`` and ``right`` come from :func:`hashed`. Sets are packed by size into blocks, written once; a task
    reads two blocks and keeps what is similar, so disk holds the sets and the
    answer, and memory two blocks. Block pairs whose sizes cannot meet are left
    out. It is exact, so its work grows with pairs of blocks and of sets that
    share a rare token.
    """
    mine = _blocks(left)
    other = mine if right is None else _blocks(right)
    x = mine.select(F.col("no").alias("left_no"), F.col("low").alias("left_low"), F.col("high").alias("left_high"), F.col("block").alias("left_block"))
    y = other.select(F.col("no").alias("right_no"), F.col("low").alias("right_low"), F.col("high").alias("right_high"), F.col("block").alias("right_block"))
    t = F.lit(threshold - 1e-9)
    meets = F.col("right_high") >= t * F.col("left_low")
    if measure == "jaccard":
        meets = meets & (F.col("left_high") >= t * F.col("right_low"))
    if right is None:
        meets = meets & (F.col("left_no") <= F.col("right_no"))
    same = (F.col("left_no") == F.col("right_no")) if right is None else F.lit(False)
    kinds = [df.schema["set_id"].dataType.simpleString() for df in (left, left if right is None else right)]
    met = x.join(y.hint("shuffle_replicate_nl"), meets).select("left_block", "right_block", same.alias("same"))
    return met.mapInArrow(_meet(float(threshold), measure), f"left_set {kinds[0]}, right_set {kinds[1]}, score double")
