"""Removal of repeated word windows with a count-min prefilter.

Windows are known by an anchor, the least hash of the short word runs inside
them, so neighbouring windows mostly share one and a repeated window always
repeats its anchor. Tasks count anchors in count-min sketches, which are added;
an estimate is never below the true count, so windows whose anchor is estimated
to occur once are truly alone. A second pass groups the others exactly: first
whole stretches of windows of one anchor, then, only where an anchor has several
different stretches, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import sketch
from strataloom.llm.common import Batches, columns, mixed, packed, rolling, slices, word_digests
from strataloom.session import cut_lineage

WINDOW = 50
ANCHOR = 16  # words of the runs that anchors are chosen from
BITS = 28  # cells of the sketch, half of them for each of its two rows; 32 MB as bits

STRETCHES = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("windows", pa.list_(pa.int64())),
])
CLEANED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

_EMPTY = np.empty(0, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low


def stretches(text: str | None, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors, starts, stops, windows``: hashes of all windows, and the stretches of them that share an anchor."""
    words = (text or "").encode().split()
    if len(words) < window:
        return _EMPTY, np.empty(0, np.int64), np.empty(0, np.int64), _EMPTY
    halves = word_digests(words, xxhash.xxh3_128_digest)
    windows = rolling(np.ascontiguousarray(halves[:, 0]), window, _STEP)
    anchors = least_of(rolling(np.ascontiguousarray(halves[:, 1]), anchor, _STEP), window - anchor + 1)
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return anchors[starts], starts, np.append(starts[1:], len(anchors)), windows


def contents(windows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the windows of each stretch, in order."""
    with np.errstate(over="ignore"):
        step = np.uint64(_STEP)
        powers = np.cumprod(np.full(len(windows), step, np.uint64))
        back = np.cumprod(np.full(len(windows), np.uint64(pow(_STEP, -1, 1 << 64)), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(windows * powers)])
        return mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each anchor in either row of the sketch."""
    half, shift = 1 << (bits - 1), np.uint64(65 - bits)
    return (anchors >> shift).astype(np.int64), (mixed(anchors ^ np.uint64(_STEP)) >> shift).astype(np.int64) + half


def _sketch_batches(window: int, anchor: int, bits: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        found = (stretches(text, window, anchor)[0] for part in slices(batches) for text in part.column("text").to_pylist())
        # anchors are least values: spread them over all cells
        yield from sketch.partial_batches((np.concatenate(cells(mixed(a), bits)).astype(np.uint32) for a in found), bits)

    return run


def repeated(counts: np.ndarray) -> np.ndarray:
    return np.packbits(counts >= 2)


def _stretch_batches(window: int, anchor: int, bits: int, sent) -> Callable[[Batches], Batches]:
    """The stretches whose anchor is estimated to occur more than once, with the hashes of their windows."""

    def run(batches: Batches) -> Batches:
        bit = np.frombuffer(pa.decompress(sent.value, (1 << bits) // 8, "zstd", asbytes=True), np.uint8)
        held, n_held = [], 0
        for part in slices(batches):
            for doc, row, text in zip(*columns(part, "doc_id", "row", "text"), strict=True):
                anchors, starts, stops, windows = stretches(text, window, anchor)
                if not len(anchors):
                    continue
                seen = np.ones(len(anchors), bool)
                for at in cells(mixed(anchors), bits):
                    seen &= (bit[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                if seen.any():
                    content = contents(windows, starts, stops)[seen]
                    inside = np.repeat(seen, stops - starts)
                    held.append((anchors[seen], content, doc, row, starts[seen], (stops - starts)[seen], windows[inside]))
                    n_held += int(inside.sum())
                    if n_held > 200_000:
                        yield _joined(held)
                        held, n_held = [], 0
        if held:
            yield _joined(held)

    return run


def _joined(held: list) -> pa.RecordBatch:
    sizes = np.array([len(h[0]) for h in held])
    which = pa.array(np.repeat(np.arange(len(held)), sizes))
    own = lambda k: pa.array([h[k] for h in held], pa.int64()).take(which)
    long = lambda k: pa.array(np.concatenate([h[k] for h in held]).view(np.int64))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([h[5] for h in held]))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), long(6))
    return pa.RecordBatch.from_arrays([long(0), long(1), own(2), own(3), pa.array(np.concatenate([h[4] for h in held]).astype(np.int32)), lists], schema=STRETCHES)


def covered_spans(found: DataFrame, window: int) -> DataFrame:
    """``doc_id, row, spans``: the word spans that windows found in a smaller document cover.

    A stretch found whole in a smaller document is covered whole. For the first
    document of each stretch it is asked window by window, and only where the
    anchor has other stretches, as equal windows have equal anchors.
    """
    first = cut_lineage(found.groupBy("anchor", "content").agg(F.min("doc_id").alias("least")))
    several = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    asked = first.join(several, "anchor", "left_semi")
    leaders = found.join(asked, ["anchor", "content"]).where("doc_id = least").dropDuplicates(["anchor", "content"])
    each = cut_lineage(leaders.select("anchor", "content", "least", F.posexplode("windows").alias("at", "hash")))
    seen = each.groupBy("anchor", "hash").agg(F.min("least").alias("before"))
    early = each.join(seen, ["anchor", "hash"]).where("before < least").groupBy("anchor", "content", "least").agg(F.collect_list("at").alias("at"))
    places = found.select("anchor", "content", "doc_id", "row", "start", F.size("windows").alias("n"))
    whole = places.join(first, ["anchor", "content"]).where("doc_id > least").select(
        "doc_id", "row", F.struct("start", (F.col("start") + F.col("n") + (window - 1)).alias("stop")).alias("span")
    )
    single = places.join(early, ["anchor", "content"]).where("doc_id = least").select("doc_id", "row", "start", F.explode("at").alias("at")).select(
        "doc_id", "row", F.struct((F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + window).alias("stop")).alias("span")
    )
    return whole.unionByName(single).groupBy("doc_id", "row").agg(F.collect_list("span").alias("spans"))


def _clean_batches(texts: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        def rows():
            for part in slices(batches):
                for doc, text, spans in zip(*columns(part, "doc_id", "text", "spans"), strict=True):
                    words = (text or "").encode().split()
                    n = len(words)
                    if spans:
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, [s["start"] for s in spans], 1)
                        np.add.at(edge, [s["stop"] for s in spans], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                    kept = b" ".join(words)
                    yield doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None

        yield from packed(rows(), CLEANED, lambda row: 130 + len(row[4] or ""))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = BITS, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row of ``docs(doc_id, text)``.

    A word goes if a window over it also starts in a document with a smaller
    id. A null or empty text has no words. A null id is neither smaller nor
    larger: such a document keeps its words and removes none. Rows with one id
    remove nothing from each other and are told apart by their text; repeated
    rows are treated alike. Other columns are not looked at. ``kept`` is null
    without ``with_text``.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    known = sketch.merge(texts.select("text").mapInArrow(_sketch_batches(window, anchor, bits), sketch.PARTIAL_DDL), bits, repeated)
    sent = docs.sparkSession.sparkContext.broadcast(pa.compress(known.tobytes(), "zstd", asbytes=True))
    found = texts.where("doc_id IS NOT NULL").mapInArrow(
        _stretch_batches(window, anchor, bits, sent), "anchor long, content long, doc_id long, row long, start int, windows array<long>"
    )
    spans = covered_spans(cut_lineage(found), window).withColumnsRenamed({"doc_id": "d", "row": "r"})
    both = texts.join(spans, texts["doc_id"].eqNullSafe(spans["d"]) & (texts["row"] == spans["r"]), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_clean_batches(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
