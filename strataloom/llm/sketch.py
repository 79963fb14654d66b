"""Counting sketches: each task counts hash cells, the partial sketches are added cell by cell."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.common import Batches, columns, packed, slices

SEGMENTS = 1024  # stretches of cells that are merged apart from each other
HELD = 4 << 20  # cells that a task gathers before it counts them

PARTIAL = pa.schema([("segment", pa.int32()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
PARTIAL_DDL = "segment int, n long, cells binary, counts binary"


def _shrunk(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _grown(held: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(held, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").reshape(-1)


def partial(cells: Iterable[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows of a task's sketch of ``2**bits`` cells: per segment the cells that occur, as gaps, and how often."""
    per = (1 << bits) // SEGMENTS
    held: list[np.ndarray] = []

    def rows():
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(found, np.arange(0, (SEGMENTS + 1) * per, per))
        for s in range(SEGMENTS):
            if ends[s] < ends[s + 1]:
                own = found[ends[s] : ends[s + 1]].astype(np.int64) - s * per
                yield s, len(own), _shrunk(np.diff(own, prepend=0)), _shrunk(counts[ends[s] : ends[s + 1]])

    size = 0
    for some in cells:
        held.append(some)
        size += len(some)
        if size >= HELD:
            yield from rows()
            held, size = [], 0
    if size:
        yield from rows()


def partial_batches(cells: Iterable[np.ndarray], bits: int) -> Batches:
    return packed(partial(cells, bits), PARTIAL, lambda row: 40 + len(row[2]) + len(row[3]))


def merge(partials: DataFrame, bits: int, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Add partial sketches and bring ``finish(counts)`` of all cells, one byte or bit each, to the driver.

    The result's size is fixed by ``bits``, whatever the input's size. Partial
    sketches stream through a task that holds the counts of one segment.
    """
    per = (1 << bits) // SEGMENTS
    empty = finish(np.zeros(per, np.int64)).astype(np.uint8)

    def run(batches: Batches) -> Batches:
        def rows():
            now, counts = None, None
            for part in slices(batches):
                for segment, n, cells, own in zip(*columns(part, *PARTIAL.names), strict=True):
                    if segment != now:
                        if now is not None:
                            yield now, _packed(finish(counts))
                        now, counts = segment, np.zeros(per, np.int64)
                    counts[np.cumsum(_grown(cells, n).astype(np.int64))] += _grown(own, n)
            if now is not None:
                yield now, _packed(finish(counts))

        yield from packed(rows(), pa.schema([("segment", pa.int32()), ("cells", pa.binary())]), lambda row: len(row[1]))

    sorted_ = partials.repartition("segment").sortWithinPartitions("segment")
    out = np.tile(empty, SEGMENTS)
    for row in sorted_.mapInArrow(run, "segment int, cells binary").toLocalIterator():
        out[row["segment"] * len(empty) : (row["segment"] + 1) * len(empty)] = np.frombuffer(pa.decompress(bytes(row["cells"]), len(empty), "zstd", asbytes=True), np.uint8)
    return out


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.uint8).tobytes(), "zstd", asbytes=True)
