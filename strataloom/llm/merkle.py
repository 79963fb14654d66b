"""Merkle manifest of a dataset: a tree per group, a tree over the groups, a proof for every row.

Leaves are numbered in order of their group and id. A *superblock* is ``8**levels``
neighbouring nodes of one tree; it is reduced by one task, its digest is a
node of the next round, and so on until each tree has one node. On the way
back, nodes and the outer nodes of their superblock (what stands left and right
of its path at each level above) are cogrouped by superblock in
``applyInPandas``: the task reduces its nodes again, joins each node's siblings
with the outer ones and folds the path up to the root. Rounds above the first
see one row per superblock, the last one of them a row per node, whose outer
nodes are those that the round below needs.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

FANOUT = 8
LEVELS = 3  # of a superblock: 512 nodes, whatever the size of the dataset
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree long, n long, pos long, digest string"
OUTER = "tree long, block long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = "row long, subroot string, root string, proof_sha256 string, folded_root string"


def sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, in hex, of the fields one after another: byte count, ``:`` and value each, or ``-`` for null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``no``, their place in the order of ``by`` from 0; only one count per partition reaches the driver."""
    dealt = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    placed = dealt.withColumn("_at", F.monotonically_increasing_id())  # partition number and place within it
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("_part")).count().collect())
    starts, total = [], 0
    for part_no, n in counts:
        starts.append((part_no, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("no", F.col("_start") + inside).drop("_at", "_part", "_start")


def levels_of(n: int, most: int) -> int:
    """Reductions that a superblock takes part in, in a tree that has ``n`` nodes in this round."""
    k = 0
    while n > 1 and k < most:
        n = -(-n // FANOUT)
        k += 1
    return k


def reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock level by level, those given first."""
    rows = [digests]
    for _ in range(levels):
        now = rows[-1]
        rows.append([sha("".join(now[k : k + FANOUT])) for k in range(0, len(now), FANOUT)])
    return rows


def around(rows: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``k`` in its run, at each level of a superblock."""
    lefts, rights = [], []
    for level in rows[:-1]:
        first = k - k % FANOUT
        lefts.append("".join(level[first:k]))
        rights.append("".join(level[k + 1 : first + FANOUT]))
        k //= FANOUT
    return lefts, rights


def folded(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights, strict=True):
        node = sha(left + node + right)
    return node


def _superblock(levels: int) -> Callable:
    """The node of the next round that one superblock becomes."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        tree, n, pos = (int(nodes[c].iloc[0]) for c in ("tree", "n", "pos"))
        top = reduced(nodes["digest"].tolist(), levels_of(n, levels))[-1][0]
        return pd.DataFrame({"tree": [tree], "n": [-(-n // FANOUT**levels)], "pos": [pos // FANOUT**levels], "digest": [top]})

    return run


def _outer_of_nodes(levels: int) -> Callable:
    """For each node of a superblock, its outer nodes up to the root: those within the superblock, then the superblock's own."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        rows = reduced(nodes["digest"].tolist(), levels_of(int(nodes["n"].iloc[0]), levels))
        lefts, rights, subroot, root = [], [], None, None
        if len(outer):
            lefts, rights = (list(outer[c].iloc[0]) for c in ("lefts", "rights"))
            subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
        out = []
        for k, (tree, pos, digest) in enumerate(zip(nodes["tree"], nodes["pos"], nodes["digest"], strict=True)):
            left, right = around(rows, k)
            left, right = left + lefts, right + rights
            out.append((tree, pos, left, right, subroot, root if root is not None else folded(digest, left, right)))
        return pd.DataFrame(out, columns=["tree", "block", "lefts", "rights", "subroot", "root"])

    return run


def _proofs(levels: int) -> Callable:
    """Local reduction, joined proof and fold of every leaf of a superblock."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        rows = reduced(nodes["digest"].tolist(), levels_of(int(nodes["n"].iloc[0]), levels))
        lefts, rights = (list(outer[c].iloc[0]) for c in ("lefts", "rights"))
        out = []
        for k, (row, changed) in enumerate(zip(nodes["row"], nodes["changed"], strict=True)):
            left, right = around(rows, k)
            left, right = left + lefts, right + rights
            proof = sha("".join(a + b for a, b in zip(left, right, strict=True)))
            out.append((row, outer["subroot"].iloc[0], outer["root"].iloc[0], proof, folded(changed, left, right)))
        return pd.DataFrame(out, columns=["row", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FANOUT**levels)).cast("long").alias("block")


def rounds(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """Nodes of each round, those given first, until a tree of ``largest`` nodes has one; small trees stay at one node."""
    found = [nodes]
    while largest > 1:
        now = found[-1].select("tree", "n", "pos", "digest")
        found.append(cut_lineage(now.groupBy("tree", _block(levels)).applyInPandas(_superblock(levels), NODE)))
        largest = -(-largest // FANOUT**levels)
    return found


def descended(found: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Outer nodes (``tree, block``) of the superblocks of the first round, from those of the trees' last nodes."""
    for nodes in found[:0:-1]:
        inner = nodes.select("tree", "n", "pos", "digest")
        outer = cut_lineage(inner.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "block")).applyInPandas(_outer_of_nodes(levels), OUTER))
    return outer


def manifest(docs: DataFrame, tamper: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    Each row is a leaf of the tree of its ``lang``, in order of ``doc_id``; rows
    of one id follow in order of their digests (equal rows are leaves of
    their own), a null id comes first. Langs are ordered bytewise, null first.
    ``tamper`` says which rows have A-Z lower-cased in their text before they
    are verified; their own leaf and proof stay the original ones. Null text is
    not changed, empty text neither. A table without rows gives none. Other
    columns are left out.
    """
    spark = docs.sparkSession
    tamper = F.lit(False) if tamper is None else tamper
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own, other = ([F.col(c) if c != "text" else text for c in FIELDS] for text in (F.col("text"), lowered))
    leaf = leaf_digest(own)
    leaves = cut_lineage(docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tamper, leaf_digest(other)).otherwise(leaf).alias("changed")))
    leaves = leaves.withColumn("copy", F.monotonically_increasing_id())  # parts equal rows, of which one partition may hold too many
    leaves = numbered(leaves, "lang", "doc_id", "leaf", "changed", "copy")
    groups = numbered(leaves.groupBy("lang").agg(F.min("no").alias("first"), F.count("*").alias("n")), "lang")
    groups = cut_lineage(groups.select(F.col("lang").alias("_lang"), "first", "n", F.col("no").alias("tree")))
    placed = leaves.join(groups, F.col("lang").eqNullSafe(F.col("_lang")))
    nodes = cut_lineage(placed.select("tree", "n", (F.col("no") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), "changed", F.col("no").alias("row"), "doc_id"))
    trees, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    up = rounds(nodes, most, levels)
    subroots = up[-1].select(F.lit(-1).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    above = rounds(subroots, trees, levels)
    nothing = spark.createDataFrame([], OUTER)
    top = cut_lineage(above[0].groupBy("tree", _block(levels)).cogroup(descended(above, nothing, levels).groupBy("tree", "block")).applyInPandas(_outer_of_nodes(levels), OUTER))
    own = subroots.select(F.col("pos").alias("block"), F.col("digest").alias("own"))  # a block of ``top`` is a tree of leaves
    start = top.join(own, "block").select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "lefts", "rights", F.col("own").alias("subroot"), "root")
    outer = descended(up, start, levels)
    proofs = nodes.select("tree", "n", "pos", "digest", "changed", "row").groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "block")).applyInPandas(_proofs(levels), PROOF)
    out = nodes.select("row", "doc_id", F.col("digest").alias("leaf")).join(proofs, "row")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def every_third(doc_id: str = "doc_id") -> Column:
    """Rows whose id in decimal has a CRC-32 that 3 divides."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


#: The same in DuckDB; trees of any height.
SQL = """
WITH RECURSIVE f AS (SELECT doc_id, lang, text, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
leaf AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
      sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(array_to_string(head, '') || coalesce(strlen(low) || ':' || low, '-')) AS low FROM f),
t(g, n, lvl, pos, digest) AS (SELECT g, n, 0, pos, leaf FROM leaf UNION ALL
      SELECT g, (n + 7) // 8, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, n, lvl, pos // 8),
sub AS (SELECT g, digest AS subroot, max(lvl) OVER () AS deep, lvl AS height FROM t WHERE n = 1),
u(n, lvl, pos, digest) AS (SELECT count(*) OVER (), 0, g - 1, subroot FROM sub UNION ALL
      SELECT (n + 7) // 8, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY n, lvl, pos // 8),
nodes AS (SELECT g, lvl, pos, n, digest FROM t UNION ALL SELECT 0, lvl, pos, n, digest FROM u),
side AS (SELECT g, lvl, pos, (SELECT coalesce(string_agg(digest, '' ORDER BY b.pos), '') FROM nodes b WHERE b.g = a.g AND b.lvl = a.lvl AND b.pos // 8 = a.pos // 8 AND b.pos < a.pos) AS lefts,
      (SELECT coalesce(string_agg(digest, '' ORDER BY b.pos), '') FROM nodes b WHERE b.g = a.g AND b.lvl = a.lvl AND b.pos // 8 = a.pos // 8 AND b.pos > a.pos) AS rights
      FROM nodes a WHERE n > 1),
step AS (SELECT l.doc_id, s.lvl, s.lefts, s.rights FROM leaf l JOIN side s ON s.g = l.g AND s.pos = l.pos // (8 ** s.lvl)::BIGINT
      UNION ALL SELECT l.doc_id, h.height + s.lvl, s.lefts, s.rights FROM leaf l JOIN sub h ON h.g = l.g JOIN side s ON s.g = 0 AND s.pos = (l.g - 1) // (8 ** s.lvl)::BIGINT),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM leaf),
fold(doc_id, lvl, node) AS (SELECT doc_id, 0, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END FROM leaf JOIN crc USING (doc_id)
      UNION ALL SELECT fold.doc_id, fold.lvl + 1, sha256(s.lefts || node || s.rights) FROM fold JOIN step s ON s.doc_id = fold.doc_id AND s.lvl = fold.lvl),
last AS (SELECT doc_id, arg_max(node, lvl) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY lvl)) AS proof_sha256 FROM step GROUP BY doc_id),
root AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, h.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, k.folded_root, k.folded_root = r.root AS verified
FROM leaf l JOIN sub h USING (g) CROSS JOIN root r LEFT JOIN proof p USING (doc_id) JOIN last k USING (doc_id)
"""
