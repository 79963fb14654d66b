"""Token ids in Huffman-coded blocks.

Ids are counted over the whole corpus; from the counts comes a canonical prefix
code whose longest word is limited. Blocks are decoded on their own: each holds
whole documents and the bit offset of every 256th id, and decoding steps through
all these stretches at once, one table lookup per id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm.common import Batches, columns, drop_folder, packed, slices
from strataloom.session import work_folder

LIMIT = 18  # bits of the longest code word, if so many words suffice
EVERY = 256  # ids between two checkpoints
BLOCK = 1 << 18  # ids after which a block ends
CACHED = 400_000  # words in each of the two generations whose ids a worker keeps

IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DRAFTS = IDS.append(pa.field("counts", pa.binary()))
COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
BLOCKS = pa.schema([
    ("part", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("checkpoints", pa.binary()), ("payload", pa.binary()),
])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{field.name} {kinds[field.type]}" for field in schema)


# --- the code ---------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total size with none over ``limit``; 0 where the count is 0 (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    row, leaves = weights, []
    for _ in range(limit):
        leaves.append(None if row is weights else np.cumsum(at < len(weights)))
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([weights, pairs])
        at = np.argsort(joined, kind="stable")
        row = joined[at]
    take = 2 * len(order) - 2
    for own in reversed(leaves):
        single = min(take, len(order)) if own is None else int(own[take - 1]) if take else 0
        lengths[order[:single]] += 1
        take = 2 * (take - single)
    return lengths


class Code:
    """Canonical code of given lengths: words in order of length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(self.lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        room = 1 << (self.limit - self.lengths[order])
        starts = np.concatenate([[0], np.cumsum(room)[:-1]]) if len(order) else np.zeros(0, np.int64)
        self.words = np.zeros(len(lengths), np.uint64)
        self.words[order] = (starts >> (self.limit - self.lengths[order])).astype(np.uint64)
        filled = int(room.sum())
        self.table_id = np.zeros(1 << self.limit, np.uint32)
        self.table_bits = np.ones(1 << self.limit, np.uint8)
        self.table_id[:filled] = np.repeat(order, room)
        self.table_bits[:filled] = np.repeat(self.lengths[order], room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints of a block of ids."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        spread = self.words[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        place, size = at >> 5, (int(ends[-1]) >> 5) + 2 if len(ids) else 0
        high = np.bincount(place, (spread >> np.uint64(32)).astype(np.float64), size)
        low = np.bincount(place + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        return (high + low).astype(">u4").tobytes(), at[::EVERY].astype("<i8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ids of a block: all stretches between checkpoints advance together."""
        if not n:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at = np.frombuffer(checkpoints, "<i8").copy()
        out = np.empty((EVERY, len(at)), np.uint32)
        last, cut = len(window) - 1, np.uint32(32 - self.limit)
        for k in range(EVERY):
            word = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> cut
            out[k] = self.table_id[word]
            at += self.table_bits[word]
        return out.T.reshape(-1)[:n]


# --- text to ids ------------------------------------------------------------

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SIGNS = r"!-&(-@\[-`{-~"  # ASCII but letters and the apostrophe, which may start a contraction
_STRIPPED = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'")
_PLAIN = re.compile(rf"([{_SIGNS}]*)([{_LETTERS}]+)([{_SIGNS}]*)").fullmatch
#: Bytes that the byte-level step shows as another character, as it shows a byte that has no sign of its own.
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_WORDS = re.compile(r"[^\t-\r \x85\xa0  -     　]+").findall
_SEPARATORS = re.compile("[\x1c-\x1f]").search


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins what white space parts, so words are looked up.

    A word of letters between ASCII signs falls into these three, as the
    tokenizer parts letters from signs; of the letters, the tokenizer's model
    gets the lower-case bytes as its byte-level step shows them. All other
    words go through the whole tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # one id each, wherever they stand
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        top = max([-1, *self.tokenizer.get_vocab(with_added_tokens=True).values()])
        self.id_bytes = [i.to_bytes(self.width, "little") for i in range(top + 1)]
        self.marked = re.compile("|".join(map(re.escape, self.marks))).search if self.marks else lambda word: None
        self.sign = next((c for c in self.marks[0] if all(c in m for m in self.marks)), "") if self.marks else "\0"  # in every mark, so words without it hold none
        self.simple = not any(m.isalpha() for m in self.marks)  # no mark can stand in a word of letters alone
        self.words, self.letters, self.others = _Known(self._word), _Known(self._letters), _Known(self._other)

    def _ids(self, ids: list[int]) -> bytes:
        return self.id_bytes[ids[0]] if len(ids) == 1 else b"".join([self.id_bytes[i] for i in ids])

    def _word(self, word: str) -> bytes:
        core = word.strip(_STRIPPED)
        if core.isascii() and core.isalpha():
            if core == word and self.simple:
                return self.letters[word.lower()]
            if self.sign not in word or not self.marked(word):
                before, _, after = word.partition(core)
                return (self.others[before] if before else b"") + self.letters[core.lower()] + (self.others[after] if after else b"")
        plain = _PLAIN(word)
        if plain is None or self.sign in word and self.marked(word):
            return self.others[word]
        before, run, after = plain.groups()
        found = self.letters[run.lower()]
        return (self.others[before] if before else b"") + found + (self.others[after] if after else b"")

    def _letters(self, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(_SHOWN)
        return self._ids([token.id for token in self.model.tokenize(shown)])

    def _other(self, part: str) -> bytes:
        return self._ids(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        for known in (self.words, self.letters, self.others):
            known.turn()
        own = self.words.__getitem__
        return [b"".join(map(own, _WORDS(t) if _SEPARATORS(t) else t.split())) for t in texts]


class _Known(dict):
    """Values made when first asked for; what is asked for again outlives the older generation, which goes when the younger is full."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _planes(ids: bytes, width: int) -> bytes:
    """Ids for the time between two steps: first all low bytes, then the others, compressed."""
    return pa.compress(np.frombuffer(ids, np.uint8).reshape(-1, width).T.tobytes(), "zstd", asbytes=True)


def _from_planes(held: bytes, n: int, width: int) -> np.ndarray:
    raw = pa.decompress(held, n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(-1)


def _tokenise(path: str, end: int | None) -> Callable[[Batches], Batches]:
    """Ids of each document; a task's last row holds its ``counts`` of all ids and nothing else."""

    def run(batches: Batches) -> Batches:
        own = word_tokenizer(path)
        tail = b"" if end is None else np.array([end], own.kind).tobytes()
        width = np.dtype(own.kind).itemsize

        def rows():
            total = np.zeros(0, np.int64)
            for part in slices(batches):
                docs, texts = columns(part, "doc_id", "text")
                encoded = [ids + tail for ids in own.encode([t or "" for t in texts])]
                found = np.bincount(np.frombuffer(b"".join(encoded), own.kind), minlength=len(total))
                found[: len(total)] += total
                total = found
                for doc, ids in zip(docs, encoded, strict=True):
                    yield doc, len(ids) // width, _planes(ids, width), None
            if len(total):
                yield None, None, None, zlib.compress(total.astype("<i8").tobytes(), 1)

        yield from packed(rows(), DRAFTS, lambda row: 24 + len(row[2] or row[3]))

    return run


def _count(batches: Batches) -> Batches:
    """The counts of several tasks as one."""
    total = np.zeros(0, np.int64)
    for part in slices(batches, 16):
        for held in part.column("counts").to_pylist():
            found = np.frombuffer(zlib.decompress(held), "<i8").copy()
            short, total = sorted((total, found), key=len)
            total[: len(short)] += short
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=COUNTS)


def _to_blocks(lengths: np.ndarray, width: int, block: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        code, part_no = Code(lengths), TaskContext.get().partitionId()

        def rows():
            first, gathered, docs, sizes, held = 0, 0, [], [], []

            def close():
                ids = np.concatenate(held)
                payload, checkpoints = code.encode(ids)
                return part_no, first, len(ids), docs, sizes, checkpoints, payload

            for part in slices(batches):
                for doc, n, ids in zip(*columns(part, "doc_id", "n_tokens", "ids"), strict=True):
                    docs.append(doc)
                    sizes.append(n)
                    held.append(_from_planes(ids, n, width) if n else np.empty(0, f"<u{width}"))
                    if (gathered := gathered + n) >= block:
                        row = close()
                        yield row
                        first, gathered, docs, sizes, held = first + row[2], 0, [], [], []
            if docs:
                yield close()

        yield from packed(rows(), BLOCKS, lambda row: 16 * len(row[3]) + len(row[5]) + len(row[6]))

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end: int | None = 2, limit: int = LIMIT, block: int = BLOCK) -> None:
    """Write the ids of ``docs(doc_id, text)`` to ``folder``: ``blocks`` in ascending order of ``doc_id`` and the code's ``lengths``.

    A null or empty text has only the ``end`` id (none if ``end`` is None). Null
    ids come first; rows with one id stand by their tokens, so repeated rows
    are interchangeable, and a hot id is dealt over several partitions. A
    document longer than ``block`` makes a block of its own. An empty table
    gives no blocks. What reaches the driver is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    drafts = work_folder(spark, "token-drafts")
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenise(path, end), ddl(DRAFTS))
    ids.write.option("compression", "none").parquet(drafts)
    both = spark.read.parquet(drafts)
    held = both.where("counts IS NULL").drop("counts")
    counted = both.select("counts").where("counts IS NOT NULL").mapInArrow(_count, ddl(COUNTS)).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{folder}/lengths")
    ordered = held.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(_to_blocks(lengths, width, block), ddl(BLOCKS)).write.option("compression", "none").parquet(f"{folder}/blocks")
    drop_folder(spark, drafts)


def read(spark: SparkSession, folder: str, then: Callable[[Batches], Batches] | None = None, schema: str = ddl(READ)) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of a written folder; ``then`` maps these batches in the same crossing.

    ``start`` counts the ids of all documents before. The driver sees one row
    per file part and the code lengths.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/lengths").first()["lengths"]), np.uint8)
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = dict(zip([p for p, _ in parts], np.concatenate([[0], np.cumsum([n for _, n in parts])]).tolist(), strict=False))

    def run(batches: Batches) -> Batches:
        code = Code(lengths)

        def rows():
            for part in slices(batches, 1):
                for no, first, n, docs, sizes, checkpoints, payload in zip(*columns(part, *BLOCKS.names), strict=True):
                    ids, at = code.decode(payload, checkpoints, n).astype("<u4"), 0
                    for doc, size in zip(docs, sizes, strict=True):
                        yield doc, base[no] + first + at, size, ids[at : at + size].tobytes()
                        at += size

        found = packed(rows(), READ, lambda row: 40 + len(row[3]))
        yield from then(found) if then else found

    return blocks.mapInArrow(run, schema)


CRC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def crc_batches(batches: Batches) -> Batches:
    """``ids`` to their unsigned crc32."""
    for batch in batches:
        sums = pa.array([zlib.crc32(ids) for ids in batch.column("ids").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in CRC.names[:3]), sums], schema=CRC)
