"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its
BPE encoding. Storing that token per prefix makes encoding a left-to-right
scan: a candidate token is right if it can follow the stored last token of the
prefix before it. Appending bytes only adds entries, and after an edit the
entries are rewritten up to the first place where old and new agree again.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import KEPT, Batches, chained, columns, lean, packed, slices

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
KEPT_BYTES = 10 << 20  # of the results of each of the two generations that a worker keeps; workers live on beside later stages
KEPT_PAIRS = 1 << 16
TOGETHER = 1 << 18  # characters of texts that are encoded together
ENTRY = 160  # bytes of an entry besides its key and value


class Ranks:
    """The ranks of a vocabulary and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        self.merged: dict[tuple[int, int], int] = {}
        self.whole = [len(token) == 1 for token in self.bytes_of]
        # What stands at a token's left and right edge while its bytes are merged, from a byte to the token.
        self.left_edge: list[tuple[int, ...]] = [(r,) for r in range(len(self.bytes_of))]
        self.right_edge = list(self.left_edge)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge_below(token, rank)
                if len(parts) == 2:
                    self.merged[parts[0], parts[1]] = rank
                    self.whole[rank] = True
                    self.left_edge[rank] = (*self.left_edge[parts[0]], rank)
                    self.right_edge[rank] = (*self.right_edge[parts[1]], rank)
        self.ends = {token[k:]: -1 for token in ranks for k in range(1, len(token))} | ranks
        self.known: dict[int, bool] = {}
        self.many = Many(self)

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """What the bytes of a token are before the merge that makes it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether ``left, right`` is itself the encoding of the bytes of both."""
        if len(self.known) >= KEPT_PAIRS:
            self.known.clear()
        found = self.known[left << 32 | right] = not self._meets(left, right)
        return found

    def _meets(self, left: int, right: int) -> bool:
        """Whether a merge across the border comes up while the bytes of both tokens are merged.

        Merges happen in the order of their ranks, at one rank from left to right. The
        two edges at the border therefore grow in a known order; played forward,
        the border merge wins if its rank is below that of the next merge of the
        left token and not above that of the right one.
        """
        ours, theirs = self.right_edge[left], self.left_edge[right]
        never = len(self.bytes_of)
        i, j, across = 0, 0, self.merged.get
        while True:
            grows_left = ours[i + 1] if i + 1 < len(ours) else never
            grows_right = theirs[j + 1] if j + 1 < len(theirs) else never
            border = across((ours[i], theirs[j]), never)
            if border < grows_left and border <= grows_right and border < never:
                return True
            if grows_left == grows_right == never:
                return False
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1


class Prefixes:
    """The last token of each prefix of a byte string that may grow and change."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self._fill(start + 1, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many entries were computed anew.

        Entries before the edit stay. Behind it an entry depends on the bytes
        and entries of the longest token's length before it; once as many
        entries in a row are as they were, all later ones are too.
        """
        tail, behind = self.last[stop:], len(self.data) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start:]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end, end)
            old = end - (len(self.data) - behind) - 1
            same = same + 1 if old >= 0 and tail[old] == self.last[-1] else 0
            if same >= self.ranks.longest:
                self.last += tail[old + 1 :]
                return end - start
        return len(self.data) - start

    def _fill(self, first: int, final: int) -> None:
        """Store the last token of the prefixes that end at ``first`` to ``final``.

        Tokens that end there are tried from short to long; only one of them
        can follow what is stored for the prefix before it.
        """
        ranks, data, last = self.ranks, self.data, self.last
        ends, known = ranks.ends.get, ranks.known.get
        for end in range(first, final + 1):
            start = end - 1
            while True:
                token = ends(data[start:end]) if start >= 0 else None
                if token is None:
                    raise ValueError(f"byte {data[end - 1]} is no token")
                if token >= 0:
                    if not start:
                        fits = ranks.whole[token]
                    elif (fits := known(last[start - 1] << 32 | token)) is None:
                        fits = ranks.beside(last[start - 1], token)
                    if fits:
                        last.append(token)
                        break
                start -= 1

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.ranks.bytes_of[found[-1]])
        return found[::-1]


class Table:
    """Whole numbers looked up by whole numbers, many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            _, first = np.unique(slot[rest], return_index=True)
            rest_free = rest[first][self.keys[slot[rest[first]]] < 0]
            self.keys[slot[rest_free]], self.values[slot[rest_free]] = keys[rest_free], values[rest_free]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for those that are not there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class Many:
    """The last tokens of all prefixes of many short pieces, one position of all pieces at a time."""

    WIDTH = 32  # bytes; longer pieces are filled alone
    PAIRS = 18  # binary logarithm of the pairs that are remembered

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        nodes: dict[int, int] = {}
        ends = [-1]
        for token, rank in ranks.ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = rank
        self.step = Table(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.token_of = np.array(ends, np.int32)
        self.whole = np.array(ranks.whole)
        self.length = np.array([len(t) for t in ranks.bytes_of], np.int64)
        self.pairs, self.fit = np.full(1 << self.PAIRS, -1, np.int64), np.zeros(1 << self.PAIRS, bool)

    def beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.PAIRS)).astype(np.int64)
        out, new = self.fit[slot], np.flatnonzero(self.pairs[slot] != keys)
        if len(new):
            once, where = np.unique(keys[new], return_inverse=True)
            fits = np.array([not self.ranks._meets(k >> 32, k & 0xFFFFFFFF) for k in once.tolist()])
            out[new] = fits[where]
            self.pairs[slot[new]], self.fit[slot[new]] = keys[new], out[new]  # of several pairs in one place the last stays, with its own answer
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece of at most ``WIDTH`` bytes, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        size = np.array([len(pieces[k]) for k in order], np.int64)
        width = int(size[0])
        data = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in order]), np.uint8).reshape(-1, width).astype(np.int64)
        last = np.full(data.shape, -1, np.int32)
        for end in range(1, width + 1):
            rows = np.arange(np.searchsorted(-size, -end, side="right"))
            node = np.zeros(len(rows), np.int64)
            for start in range(end - 1, -1, -1):
                node = self.step.get(node << 8 | data[rows, start]).astype(np.int64)
                if (node < 0).any():
                    break
                token = self.token_of[node]
                fits = token >= 0
                at = np.flatnonzero(fits)
                fits[at] = self.beside(last[rows[at], start - 1], token[at]) if start else self.whole[token[at]]
                last[rows[fits], end - 1] = token[fits]
                rows, node = rows[~fits], node[~fits]
                if not len(rows):
                    break
            if len(rows):
                raise ValueError("a byte is no token")
        found, end, all_ = [], size.copy(), np.arange(len(size))
        while (end > 0).any():
            token = np.where(end > 0, last[all_, np.maximum(end, 1) - 1], -1)
            end -= np.where(end > 0, self.length[token], 0)
            found.append(token)
        ids = np.stack(found[::-1], axis=1)
        kept = ids >= 0
        raw, stops = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        out = [b""] * len(pieces)
        for k, a, b in zip(order, [0, *stops], stops, strict=False):
            out[k] = raw[a:b]
        return out


class Encoder:
    """Encodes texts piece by piece; pieces seen before are looked up."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = Ranks({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})
        # the tokenizer's white space is the Unicode property, without the information separators
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.kept = _Kept()
        self.single = {}  # pieces that are one token
        for token, rank in self.ranks.ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.single[token.decode()] = struct.pack("<I", rank)

    def _piece(self, piece: bytes) -> bytes:
        ids = Prefixes(self.ranks, piece).tokens()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers.

        A single space between two other characters always starts a piece, so
        the chunks between such spaces are encoded on their own. Pieces that are
        new in these texts are filled together.
        """
        split = [self.pieces(t) if UNEVEN(t) else CHUNKS(t) for t in texts]
        known = {chunk: self.kept.find(chunk) for chunk in set().union(*split)}
        parts = {chunk: self.pieces(chunk) for chunk, ids in known.items() if ids is None}
        ids = {p: known.get(p) or self.kept.find(p) or self.single.get(p) for own in parts.values() for p in own}
        new = [p for p, found in ids.items() if found is None]
        raw = [p.encode() for p in new]
        short = [k for k, r in enumerate(raw) if len(r) <= Many.WIDTH]
        ids.update(zip([new[k] for k in short], self.ranks.many.encode([raw[k] for k in short]), strict=True))
        ids.update((new[k], self._piece(r)) for k, r in enumerate(raw) if len(r) > Many.WIDTH)
        for p in new:
            self.kept.keep(p, ids[p])
        for chunk, own in parts.items():
            known[chunk] = b"".join([ids[p] for p in own])
            if len(own) > 1:
                self.kept.keep(chunk, known[chunk])
        return [b"".join([known[chunk] for chunk in own]) for own in split]

    def decode(self, ids: bytes) -> bytes:
        of = self.ranks.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


class _Kept:
    """Results by key in two generations: what is asked for again outlives the older one, which goes when the younger is full."""

    def __init__(self):
        self.younger, self.older, self.size = {}, {}, 0

    def find(self, key: str) -> bytes | None:
        value = self.younger.get(key)
        if value is None and (value := self.older.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= 64:
            self.younger[key] = value
            self.size += ENTRY + len(key) + len(value)
            if self.size > KEPT_BYTES:
                self.older, self.younger, self.size = self.younger, {}, 0


#: White space at an end or two in a row.
UNEVEN = re.compile(r"\A\s|\s\s|\s\Z").search
#: Chunks of any other text, with the space before them.
CHUNKS = re.compile(r" ?[^ ]+").findall


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


KEPT["byte_bpe"] = encoder


def encode_batches(path: str, pattern: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = encoder(path, pattern)

        def rows():
            for part in slices(batches):
                ids, texts = columns(part, "doc_id", "text")
                first = 0
                while first < len(texts):
                    last, size = first, 0
                    while last < len(texts) and (last == first or size < TOGETHER):
                        size, last = size + len(texts[last] or ""), last + 1
                    yield from zip(ids[first:last], own.encode_many([t or "" for t in texts[first:last]]), strict=True)
                    first = last

        yield from packed(rows(), ENCODED, lambda row: 16 + len(row[1]))

    return run


def digest_batches(path: str, pattern: str, with_ids: bool = False) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = encoder(path, pattern)
        decimal = [b"%d" % i for i in range(len(own.ranks.bytes_of))]

        def rows():
            for part in slices(batches):
                for doc, ids in zip(*columns(part, "doc_id", "ids"), strict=True):
                    ids = ids or b""
                    shown = b" ".join([decimal[i] for i in np.frombuffer(ids, "<u4").tolist()])
                    yield doc, len(ids) // 4, hashlib.sha256(shown).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), *([ids] if with_ids else [])

        yield from packed(rows(), DIGEST.append(ENCODED.field("ids")) if with_ids else DIGEST, lambda row: 150 + 4 * row[1] * with_ids)

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit) for every row of ``docs(doc_id, text)``.

    Row by row and without a shuffle. A null or empty text has no ids; a null
    or repeated id is handed through; other columns are not looked at; the
    longest text is held once, with one entry per byte of its longest piece.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode_batches(path, pattern), "doc_id long, ids binary")


def digests(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of :func:`encode`."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded.select("doc_id", "ids").mapInArrow(digest_batches(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_check(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """:func:`encode` and :func:`digests` in one crossing to Python; the ids themselves stand last ``with_ids``."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = lean(chained(encode_batches(path, pattern), digest_batches(path, pattern, with_ids)), keeps="byte_bpe")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    )
