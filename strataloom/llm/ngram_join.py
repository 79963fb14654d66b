"""N-gram Jaccard join by several global token orders.

A document is the set of its word shingles. In any one order of all shingles,
two sets of Jaccard similarity ``t`` must share one of their first
``n - ceil(t n) + 1`` shingles, their prefix. A pair is compared in full only if
that holds in every one of several orders: one by rarity, which keeps common
shingles out of the prefixes and alone makes pairs, and one by hash, read from
both ends, which is asked after the sets of a pair have met.

Equal sets are one class from the start. The classes of a prefix shingle first
meet a leader; pairs already in one component are not looked at again, so a
large group of near copies costs a few stars and not all its pairs. What stars
leave apart in a large group meets in packed blocks of sets, without a row per pair.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import sketch
from strataloom.llm.common import Batches, columns, free_names, lean, linked, mixed, packed, rolling, slices
from strataloom.session import cut_lineage

SHINGLE = 5
PERCENT = 80
BITS = 28  # cells of the rarity sketch: 32 MB of bits and 32 MB of levels
GROUP = 8  # cells that share a level
STARS = 2  # rounds of stars before all open pairs
LEADERS = 3  # leaders that a class meets in a round of stars
BLOCK = 50_000  # pairs of a block of comparisons, about
CROWD = 64  # open classes of a shingle; more meet in packed blocks
BLOCK_TOKENS = 1 << 16  # of a packed block, about
PARTS = 64  # partitions of packed blocks, at most; each meets each
COLUMNS = 4096  # shingles whose overlaps are added together
SENT = 1_000_000  # class keys of at most about 40 bytes that may be sent to every task

_digest = xxhash.xxh3_64_intdigest

CLASSES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("cls", pa.binary())])
POSTINGS = pa.schema([("token", pa.int64()), ("cls", pa.binary()), ("n", pa.int32()), ("at", pa.int32())])
SETS = pa.schema([("cls", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary())])
PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
BLOCKS = pa.schema([
    ("family", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("least", pa.int32()), ("most", pa.int32()),
    ("classes", pa.list_(pa.binary())), ("roots", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()),
])


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; fewer words than ``size`` are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.array([_digest(w) for w in words], np.uint64)
    own = min(size, len(words))
    return np.unique(mixed(rolling(hashed, own, 0x9E3779B97F4A7C15) + np.uint64(own)))


def _class(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _class_batches(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        def rows():
            for part in slices(batches):
                for doc, row, text in zip(*columns(part, "doc_id", "row", "text"), strict=True):
                    tokens = shingles(text, size)
                    yield doc, row, len(tokens), _class(tokens)

        yield from packed(rows(), CLASSES)

    return run


def _cell_batches(size: int, bits: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        cells = ((shingles(text, size) >> np.uint64(64 - bits)).astype(np.uint32) for part in slices(batches) for text in part.column("text").to_pylist())
        yield from sketch.partial_batches(cells, bits)

    return run


def rarities(counts: np.ndarray) -> np.ndarray:
    """A bit per cell, whether it was met more than once, then a level per group of cells: two steps per doubling of its largest count."""
    largest = counts.reshape(-1, GROUP).max(axis=1)
    return np.concatenate([np.packbits(counts > 1, bitorder="little"), np.minimum(255, np.ceil(2 * np.log2(np.maximum(1, largest)))).astype(np.uint8)])


def rarity(tokens: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The level of each shingle in the merged ``table``, 0 for those that one text alone holds."""
    cell = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    stretch = (1 << bits) // sketch.SEGMENTS // GROUP  # bytes of bits in a segment, and of levels behind them
    group = cell // GROUP
    at = group + group // stretch * stretch
    return np.where(table[at] >> (cell % GROUP).astype(np.uint8) & 1, table[at + stretch], 0)


def prefix(n: int, percent: int) -> int:
    """How many first shingles of ``n`` a similar set must share one of."""
    return n - -(-percent * n // 100) + 1


def indexed(n: int, percent: int) -> int:
    """The same where the other set is at least as large."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _posting_batches(size: int, bits: int, percent: int, sent) -> Callable[[Batches], Batches]:
    """Prefixes in the order of rarity, then hash; a class that a task meets again is left out.

    A shingle of one text alone takes its place in the prefix, but no other set can share it: it is not sent.
    """

    def run(batches: Batches) -> Batches:
        table = np.frombuffer(pa.decompress(sent.value, (1 << bits) // GROUP * 2, "zstd", asbytes=True), np.uint8)
        seen: set[bytes] = set()
        held, n_held = [], 0
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                tokens = shingles(text, size)
                cls = _class(tokens)
                if not len(tokens) or cls in seen:
                    continue
                seen.add(cls)
                level = rarity(tokens, table, bits)
                first = np.lexsort((tokens, level))[: prefix(len(tokens), percent)]
                at = np.flatnonzero(level[first]).astype(np.int32)
                if len(at):
                    held.append((tokens[first[at]].view(np.int64), cls, len(tokens), at))
                    n_held += len(at)
                if n_held > 100_000:
                    yield _postings(held)
                    held, n_held = [], 0
        if held:
            yield _postings(held)

    return run


def _postings(held: list) -> pa.RecordBatch:
    tokens, classes, sizes, at = zip(*held, strict=True)
    lengths = [len(t) for t in tokens]
    cls = pa.array(classes, pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), lengths)))
    n = np.repeat(np.array(sizes, np.int32), lengths)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), cls, pa.array(n), pa.array(np.concatenate(at))], schema=POSTINGS)


def _set_batches(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        def rows():
            for part in slices(batches):
                for cls, text in zip(*columns(part, "cls", "text"), strict=True):
                    tokens = shingles(text, size)
                    yield cls, len(tokens), tokens.astype("<u8").tobytes()

        yield from packed(rows(), SETS, lambda row: 40 + len(row[2]))

    return run


def _verify(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pairs of one block that are similar; a pair that others of the block connect already is not compared.

    A pair must share a prefix shingle in the hash orders, up and down, before
    it is compared in full.
    """

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        p, q = prefix(len(x), percent), prefix(len(y), percent)
        for some, others in ((x[:p], y[:q]), (x[-p:], y[-q:])):
            if not len(np.intersect1d(some, others, assume_unique=True)):
                return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(pairs: pa.Table, members: pa.Table) -> pa.Table:
        sets = {c: np.frombuffer(t, "<u8") for c, t in zip(*columns(members, "cls", "tokens"), strict=True)}
        parent = {c: c for c in sets}

        def root(c: bytes) -> bytes:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = []
        for a, b in zip(*columns(pairs, "a", "b"), strict=True):
            u, v = root(a), root(b)
            if u != v and similar(sets[a], sets[b]):
                parent[u] = v
                found.append((a, b))
        return pa.table([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], schema=PAIRS)

    return run


def _sent(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if it is; else Spark joins by a shuffle."""
    return F.broadcast(small) if small.count() <= SENT else small


def _sets(named: DataFrame, texts: DataFrame, owners: DataFrame, size: int) -> DataFrame:
    """``cls, tokens`` of the classes of ``named(cls)``, made anew from one text of each."""
    wanted = cut_lineage(owners.join(named, "cls", "left_semi"))
    found = texts.join(_sent(wanted), texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["row"] == wanted["row"])).select("cls", "text")
    return cut_lineage(found.mapInArrow(lean(_set_batches(size)), "cls binary, n int, tokens binary")).dropDuplicates(["cls"]).select("cls", "tokens")


def _verified(pairs: DataFrame, texts: DataFrame, owners: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b, token)``, similar ones that connect what all similar ones connect.

    Pairs meet the sets of their classes in blocks: those made by one shingle,
    and where these are many, by the hashes of both sides. So a set moves once
    per block and not once per pair. Sets are made anew from one text of each
    class that a pair names.
    """
    pairs = cut_lineage(pairs)
    sets = _sets(cut_lineage(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()), texts, owners, size)
    # Only shingles of more than a block of pairs are cut, so the join that tells them moves no pair by its shingle.
    large = pairs.groupBy("token").agg(F.ceil(F.sqrt(F.count("*") / F.lit(BLOCK))).cast("long").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(_sent(cut_lineage(large)), "token", "left").select("token", *(F.pmod(F.xxhash64(side), parts).alias(f"of_{side}") for side in "ab"), "a", "b")
    block = ["token", "of_a", "of_b"]
    own = [f"own_{name}" for name in block]
    members = dealt.select(*(F.col(x).alias(y) for x, y in zip(block, own, strict=True)), F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls")
    return cut_lineage(dealt.groupBy(*block).cogroup(members.groupBy(*own)).applyInArrow(_verify(percent), "a binary, b binary"))


def _candidate_groups(texts: DataFrame, sent, size: int, percent: int, bits: int) -> DataFrame:
    """The prefix shingles that several classes share: ``token, cls, n, at, first``; ``first`` marks what may be the smaller set of a pair."""
    postings = texts.select("text").mapInArrow(lean(_posting_batches(size, bits, percent, sent)), "token long, cls binary, n int, at int")
    together = Window.partitionBy("token")
    first = F.expr(f"at < n + 1 - ((2L * {percent} * n + {99 + percent}) div {100 + percent})")
    return cut_lineage(
        postings.repartition("token").dropDuplicates(["token", "cls"]).withColumn("first", first)
        .withColumn("several", F.count("*").over(together)).withColumn("any", F.max("first").over(together))
        .where("several > 1 AND any").drop("several", "any")
    )


def _labelled(groups: DataFrame, known: DataFrame | None) -> DataFrame:
    """Groups with the component ``root`` of each class, without shingles all of whose classes are in one."""
    if known is None:
        return groups.withColumn("root", F.col("cls"))
    together = Window.partitionBy("token")
    named = groups.join(known.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component_id", "cls")).drop("component_id")
    return named.withColumn("low", F.min("root").over(together)).withColumn("high", F.max("root").over(together)).where("low <> high").drop("low", "high")


def _star(groups: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a class with leaders of its shingles, each shingle's drawn by a hash: the ``LEADERS`` it shares most with."""
    lead = F.min(F.when(F.col("first"), F.struct(F.xxhash64("cls", "token", F.lit(turn)).alias("drawn"), "cls", "n", "root"))).over(Window.partitionBy("token"))
    met = groups.withColumn("lead", lead).where("lead.root <> root").where(f"100L * least(n, lead.n) >= {percent}L * greatest(n, lead.n)").where("lead.n <= n OR first")
    shared = met.groupBy("cls", F.col("lead.cls").alias("other")).agg(F.count("*").alias("shared"), F.min("token").alias("token"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("shared"), "other"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select(F.col("other").alias("a"), F.col("cls").alias("b"), "token")


def _families(crowd: DataFrame) -> DataFrame:
    """``cls, n, root, family`` of the classes of crowded shingles; shingles that one class holds together are one family."""
    lowest = crowd.groupBy("cls", "n", "root").agg(F.min("token").alias("low"))
    edges = crowd.select("token", "cls").join(lowest.select("cls", "low"), "cls").select("token", "low").distinct()
    joined = linked(edges, "token", "low").select(F.col("id").alias("low"), F.col("component_id").alias("family"))
    return lowest.join(joined, "low", "left").select("cls", "n", "root", F.coalesce("family", "low").alias("family"))


def _pack(batches: Batches) -> Batches:
    """Sets in order of family and component to blocks, each of one family."""

    def rows():
        held, size = [], 0
        for part in slices(batches):
            for row in zip(*columns(part, "family", "root", "n", "cls", "tokens"), strict=True):
                if held and (held[0][0] != row[0] or size >= BLOCK_TOKENS):
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += row[2]
        if held:
            yield block(held)

    def block(held: list) -> tuple:
        family, roots, sizes, classes, tokens = zip(*held, strict=True)
        return family[0], min(roots), max(roots), min(sizes), max(sizes), classes, roots, sizes, b"".join(tokens)

    yield from packed(rows(), BLOCKS, lambda row: 60 * len(row[5]) + len(row[8]))


class _Block:
    """Sets of a packed block: classes, components and the shingles of all, one after another."""

    def __init__(self, classes: list[bytes], roots: list[bytes], sizes: list[int], tokens: bytes):
        self.classes, self.roots, self.n = classes, roots, np.array(sizes, np.int64)
        self.tokens, self.row = np.frombuffer(tokens, "<u8"), np.repeat(np.arange(len(sizes)), sizes)


def _overlaps(x: _Block, y: _Block) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks."""
    both = np.zeros((len(x.n), len(y.n)), np.float32)
    shared = np.intersect1d(np.unique(x.tokens), np.unique(y.tokens), assume_unique=True)
    if not len(shared):
        return both
    cells = []
    for side in (x, y):
        at = np.minimum(np.searchsorted(shared, side.tokens), len(shared) - 1)
        cells.append((side.row[own := np.flatnonzero(shared[at] == side.tokens)], at[own]))
    for start in range(0, len(shared), COLUMNS):
        ones = []
        for side, (row, at) in zip((x, y), cells, strict=True):
            own = (at >= start) & (at < start + COLUMNS)
            ones.append(np.zeros((len(side.n), min(COLUMNS, len(shared) - start)), np.float32))
            ones[-1][row[own], at[own] - start] = 1
        both += ones[0] @ ones[1].T
    return both


def _joined(x: _Block, y: _Block, percent: int) -> list[tuple[bytes, bytes]]:
    """Similar pairs of two blocks that connect what all their similar pairs connect."""
    names, codes = np.unique(np.array([*x.roots, *y.roots], object), return_inverse=True)
    of_x, of_y = codes[: len(x.roots)], codes[len(x.roots) :]
    small, large = np.minimum.outer(x.n, y.n), np.maximum.outer(x.n, y.n)
    open_ = (of_x[:, None] != of_y[None]) & (100 * small >= percent * large)
    if not open_.any():
        return []
    both = _overlaps(x, y).astype(np.int64)
    a, b = np.nonzero(open_ & (100 * both >= percent * (x.n[:, None] + y.n[None] - both)))
    _, once = np.unique(of_x[a] * len(names) + of_y[b], return_index=True)
    parent, found = list(range(len(names))), []

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for i, j in zip(a[once].tolist(), b[once].tolist(), strict=True):
        if (u := root(of_x[i])) != (v := root(of_y[j])):
            parent[u] = v
            found.append((x.classes[i], y.classes[j]))
    return found


def _meet(percent: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        def rows():
            for part in slices(batches, 1):
                left, right = (_Block(*(columns(part, f"{side}_{name}")[0][0] for name in BLOCKS.names[5:])) for side in "xy")
                yield from _joined(left, right, percent)

        yield from packed(rows(), PAIRS)

    return run


def _crowded(crowd: DataFrame, texts: DataFrame, owners: DataFrame, size: int, percent: int) -> DataFrame:
    """Of all pairs within the families of ``crowd(token, cls, n, root)``, similar ones that connect what all similar ones connect.

    Sets are packed by family and component into blocks, written once; a task
    reads two blocks and multiplies them. So no pair is a row, disk holds the
    sets and memory two blocks. Blocks of one and the same component, or of
    sizes too far apart, do not meet. The work grows with the square of what stars
    leave apart in a family, which is dealt over all tasks.
    """
    sets = _sets(crowd.select("cls"), texts, owners, size)
    total = crowd.agg(F.sum("n")).first()[0]
    parts, order = max(1, min(PARTS, -(-total // BLOCK_TOKENS))), ("family", "root", "n", "cls")
    ranged = crowd.join(sets, "cls").repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)
    kinds = "family long, low binary, high binary, least int, most int, classes array<binary>, roots array<binary>, sizes array<int>, tokens binary"
    blocks = cut_lineage(ranged.mapInArrow(lean(_pack), kinds).withColumn("no", F.monotonically_increasing_id()))
    x, y = (blocks.select(*(F.col(name).alias(f"{side}_{name}") for name in blocks.columns)) for side in "xy")
    apart = "NOT (x_low = x_high AND y_low = y_high AND x_low = y_low)"
    meets = f"x_family = y_family AND x_no <= y_no AND {apart} AND 100L * x_most >= {percent}L * y_least AND 100L * y_most >= {percent}L * x_least"
    met = x.join(y.hint("shuffle_replicate_nl"), F.expr(meets)).select(*(f"{side}_{name}" for side in "xy" for name in BLOCKS.names[5:]))
    return cut_lineage(met.mapInArrow(lean(_meet(percent)), "a binary, b binary"))


def _edges(texts: DataFrame, owners: DataFrame, sent, size: int, percent: int, bits: int) -> DataFrame:
    """Components ``id, component_id`` of the classes that link with another.

    Rounds of stars connect what is easily connected; then all pairs that are
    still in different components are compared: the classes of crowded shingles
    by families in packed blocks, all others pair by pair.
    """
    groups = _candidate_groups(texts, sent, size, percent, bits)
    near, known = None, None
    for turn in range(STARS):
        some = _verified(_star(_labelled(groups, known), turn, percent), texts, owners, size, percent)
        near = some if near is None else near.unionByName(some)
        known = linked(near)
    open_ = cut_lineage(_labelled(groups, known).withColumn("crowded", F.count("*").over(Window.partitionBy("token")) > CROWD))
    crowd = open_.where("crowded").select("token", "cls", "n", "root")
    if crowd.isEmpty():
        rest = open_.withColumn("family", F.lit(None).cast("long"))
    else:
        families = cut_lineage(_families(crowd))
        near = near.unionByName(_crowded(families, texts, owners, size, percent))
        rest = open_.where("NOT crowded").join(families.select("cls", "family"), "cls", "left")
    x, y = rest.where("first").alias("x"), rest.alias("y")
    smaller = F.expr("x.n < y.n OR (x.n = y.n AND x.cls < y.cls)")
    room = F.expr(f"least(x.n - x.at, y.n - y.at) * {100 + percent}L >= {percent}L * (x.n + y.n)")  # positional bound
    met = x.join(y, F.expr(f"x.token = y.token AND x.root <> y.root AND NOT coalesce(x.family = y.family, false) AND 100L * x.n >= {percent}L * y.n") & smaller & room)
    pairs = met.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.min("x.token").alias("token"))
    return linked(near.unionByName(_verified(pairs, texts, owners, size, percent)))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id, row`` (hash of the text) for every row of ``docs(doc_id, text)``.

    Two documents link when ``100 * intersection >= percent * union`` of their
    shingle sets. A null or empty text, or one without words, has no set, links
    with nothing and is its own component. Rows with one id and different texts
    are documents of their own that bear one id; repeated rows are reported
    each. A null id is never the smallest. Other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    rows = cut_lineage(texts.mapInArrow(lean(_class_batches(size)), "doc_id long, row long, n long, cls binary"))
    full = rows.where("n > 0")
    owners = full.groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("o")).select("cls", "o.doc_id", "o.row")
    table = sketch.merge(texts.select("text").mapInArrow(lean(_cell_batches(size, bits)), sketch.PARTIAL_DDL), bits, rarities)
    sent = docs.sparkSession.sparkContext.broadcast(pa.compress(table.tobytes(), "zstd", asbytes=True))
    edges = _edges(texts, owners, sent, size, percent, bits)
    named = rows.where("n > 0").join(edges.withColumnsRenamed({"id": "cls", "component_id": "root"}), "cls", "left").select(
        "doc_id", "row", "n", F.coalesce("root", "cls").alias("root")
    )
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row").unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their component; those without words stay.

    Repeated rows are one document and stay together, as do all rows of a null id that link with no other. Columns of
    any name pass through; an empty table stays empty.
    """
    doc, row = free_names(docs, "_d", "_r")
    found = near_duplicates(docs.select("doc_id", "text")).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped = cut_lineage(found.select(F.col("doc_id").alias(doc), F.col("row").alias(row)))
    gone = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(row))
    return docs.join(_sent(dropped), gone, "left_anti")
