"""SQLite databases as a Spark source and sink: key ranges read in parallel, filters pushed into the database.

``path`` is a database file or a folder of them, on a file system that all
executors mount. Writing fills one database per task and names the finished ones in a
manifest, which is replaced last: readers see the old table or the new one.
"""

from __future__ import annotations

import json
import math
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

FORMAT = "strataloom_sqlite"
RANGE_ROWS = 100_000  # keys of a partition, if their number is not given
RANGES = 10_000  # partitions of a database at most
BATCH = 4096

# Declared types in both directions. Decimals and times are kept as text, which SQLite compares as such.
WRITTEN = {
    "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "TEXT",
    "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME",
}
READ = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "INTEGER": "bigint", "BIGINT": "bigint", "FLOAT": "float", "REAL": "double", "DOUBLE": "double",
    "NUMERIC": "double", "BLOB": "binary", "DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "timestamp_ntz",
}
COMPARED = ("tinyint", "smallint", "int", "bigint", "double", "string", "date")  # ordered alike in both


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite needs a mounted path, not {path}")
    return unquote(parts.path) if parts.scheme else path


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(file: str) -> closing:
    return closing(sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True, timeout=60))


def databases(path: str, table: str | None = None) -> list[str]:
    """Database files of a path; in a folder those that the table's manifest names, or all that hold the table."""
    path = local_path(path)
    if os.path.isfile(path):
        return [path]
    manifest = os.path.join(path, f"{table}.manifest.json")
    if table and os.path.isfile(manifest):
        with open(manifest, encoding="utf-8") as f:
            return [os.path.join(path, name) for name in json.load(f)]
    found = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith((".db", ".sqlite", ".sqlite3"))] if os.path.isdir(path) else []
    return [f for f in found if not table or _columns(f, table)]


def _columns(file: str, table: str) -> list[tuple]:
    """``name, type, not null, primary key place`` of a table's columns."""
    with _open(file) as db:
        return [(r[1], r[2], bool(r[3]), r[5]) for r in db.execute(f"PRAGMA table_info({_named(table)})")]


def _spark_type(declared: str) -> str:
    kind = declared.upper().strip()
    if exact := re.fullmatch(r"DECIMAL(?:TEXT)?\((\d+), ?(\d+)\)", kind):
        return f"decimal({exact[1]},{exact[2]})"
    return READ.get(kind.split("(")[0].strip(), "string")


def _declared(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMALTEXT({kind.precision},{kind.scale})"
    if kind.simpleString() not in WRITTEN:
        raise ValueError(f"SQLite has no place for {kind.simpleString()}")
    return WRITTEN[kind.simpleString()]


def _stored(kind: T.DataType, values: list) -> list:
    if isinstance(kind, T.DecimalType):
        return [v if v is None else str(v) for v in values]
    if isinstance(kind, T.DateType):
        return [v if v is None else v.isoformat() for v in values]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [v if v is None else (v.astimezone(UTC) if v.tzinfo else v).strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0") for v in values]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return ["NaN" if v is not None and math.isnan(v) else v for v in values]  # SQLite has no NaN of its own
    return values


def _restored(kind: T.DataType, values: Sequence) -> list:
    if isinstance(kind, T.DecimalType):
        unit = Decimal(1).scaleb(-kind.scale)
        return [v if v is None else Decimal(str(v)).quantize(unit) for v in values]
    if isinstance(kind, T.DateType):
        return [v if v is None else date.fromisoformat(v[:10]) for v in values]
    if isinstance(kind, T.TimestampNTZType):
        return [v if v is None else datetime.fromisoformat(v) for v in values]
    if isinstance(kind, T.TimestampType):
        return [v if v is None else (d if (d := datetime.fromisoformat(v)).tzinfo else d.replace(tzinfo=UTC)) for v in values]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [v if v is None else float(v) for v in values]
    if isinstance(kind, T.BooleanType):
        return [v if v is None else bool(v) for v in values]
    if isinstance(kind, T.StringType):
        return [v if v is None or isinstance(v, str) else v.decode() if isinstance(v, bytes) else str(v) for v in values]
    return list(values)


@dataclass
class KeyRange(InputPartition):
    file: str
    low: int | None  # None: no rows of this database are told apart by key
    high: int | None
    nulls: bool


class SqliteReader(DataSourceReader):
    """Reads ranges of a whole-number key (the row id unless another is named); comparisons with constants run in the database."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table, self.path = schema, options["table"], options["path"]
        self.key, self.ranges = options.get("key", "rowid"), options.get("ranges")
        self.terms: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column, value = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None, getattr(f, "value", None)
            if column not in self.schema.fieldNames():
                yield f
            elif isinstance(f, (IsNull, IsNotNull)):
                self.terms.append((f"{_named(column)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []))
            elif self.schema[column].dataType.simpleString() not in COMPARED:
                yield f
            elif type(f) in signs and _plain(value):
                self.terms.append((f"{_named(column)} {signs[type(f)]} ?", [_text_of(value)]))
            elif isinstance(f, In) and len(value) < 500 and all(map(_plain, value)):
                self.terms.append((f"{_named(column)} IN ({', '.join('?' * len(value))})", [_text_of(v) for v in value]))
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        found = []
        for file in databases(self.path, self.table):
            with _open(file) as db:
                low, high, kinds = db.execute(f"SELECT min({self._key}), max({self._key}), max(typeof({self._key}) NOT IN ('integer', 'null')) FROM {_named(self.table)}").fetchone()
            if kinds:
                raise ValueError(f"{self.key} of {self.table} is no whole number everywhere")
            if low is None:
                found.append(KeyRange(file, None, None, True))
                continue
            n = int(self.ranges) if self.ranges else min(RANGES, -(-(high - low + 1) // RANGE_ROWS))
            step = -(-(high - low + 1) // max(1, n))
            found += [KeyRange(file, s, min(s + step - 1, high), s == low) for s in range(low, high + 1, step)]
        return found or [KeyRange("", None, None, False)]

    @property
    def _key(self) -> str:
        return self.key if self.key == "rowid" else _named(self.key)

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        terms, values = [], []
        if partition.low is not None:
            terms.append(f"({self._key} BETWEEN ? AND ?{f' OR {self._key} IS NULL' * partition.nulls})")
            values += [partition.low, partition.high]
        for term, own in self.terms:
            terms.append(term)
            values += own
        names = ", ".join(map(_named, self.schema.fieldNames())) or "1"
        where = f" WHERE {' AND '.join(terms)}" if terms else ""
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        with _open(partition.file) as db:
            rows = db.execute(f"SELECT {names} FROM {_named(self.table)}{where}", values)
            while part := rows.fetchmany(BATCH):
                columns = [pa.array(_restored(f.dataType, v), k.type) for f, k, v in zip(self.schema, kinds, zip(*part, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def _plain(value: object) -> bool:
    return isinstance(value, (int, str, date, float)) and not isinstance(value, (bool, datetime)) and value == value


def _text_of(value: object) -> object:
    return value.isoformat() if isinstance(value, date) else value


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class SqliteWriter(DataSourceArrowWriter):
    """A database per task; the manifest that names the finished ones is replaced at the end, so a task may run twice."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.table, self.folder, self.overwrite = schema, options["table"], local_path(options["path"]), overwrite
        self.declared = ", ".join(f"{_named(f.name)} {_declared(f.dataType)}" for f in schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        name, begun = f"{self.table}-{uuid.uuid4().hex}.db", False
        holes = ", ".join("?" * len(self.schema))
        with closing(sqlite3.connect(os.path.join(self.folder, f"{name}.part"), isolation_level=None)) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE {_named(self.table)} ({self.declared})")
            db.execute("BEGIN")
            for batch in iterator:
                begun = begun or batch.num_rows > 0
                columns = [_stored(f.dataType, c.to_pylist()) for f, c in zip(self.schema, batch.columns, strict=True)]
                db.executemany(f"INSERT INTO {_named(self.table)} VALUES ({holes})", zip(*columns, strict=True))
            db.execute("COMMIT")
        if not begun:
            os.remove(os.path.join(self.folder, f"{name}.part"))
            return Written(None)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        old = [os.path.basename(f) for f in databases(self.folder, self.table)]
        new = [m.file for m in messages if m is not None and m.file]
        if not new and (self.overwrite or not old):
            new = [self.write(iter(())).file or self._empty()]
        for name in new:
            os.replace(os.path.join(self.folder, f"{name}.part"), os.path.join(self.folder, name))
        manifest = os.path.join(self.folder, f"{self.table}.manifest.json")
        with open(f"{manifest}.part", "w", encoding="utf-8") as f:
            json.dump(new if self.overwrite else old + new, f)
        os.replace(f"{manifest}.part", manifest)
        for name in old if self.overwrite else []:
            os.remove(os.path.join(self.folder, name))

    def _empty(self) -> str:
        """A database with the table and no rows, which keeps the schema."""
        name = f"{self.table}-{uuid.uuid4().hex}.db"
        with closing(sqlite3.connect(os.path.join(self.folder, f"{name}.part"))) as db:
            db.execute(f"CREATE TABLE {_named(self.table)} ({self.declared})")
        return name

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.file and os.path.exists(part := os.path.join(self.folder, f"{m.file}.part")):
                os.remove(part)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        files = databases(self.options["path"], self.options["table"])
        if not files:
            raise ValueError(f"no table {self.options['table']} under {self.options['path']}")
        ticked = lambda name: "`" + name.replace("`", "``") + "`"
        return ", ".join(f"{ticked(n)} {_spark_type(kind)}{' NOT NULL' * strict}" for n, kind, strict, _ in _columns(files[0], self.options["table"]))

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, dict(self.options), overwrite)


def _ready(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_table(spark: SparkSession, path: str, table: str, *, key: str | None = None, ranges: int | None = None) -> DataFrame:
    """A table of the databases under ``path``, in ``ranges`` parts of the whole-number ``key`` per database (the row id; as many as its size asks)."""
    _ready(spark)
    options = {"path": path, "table": table} | ({"key": key} if key else {}) | ({"ranges": str(ranges)} if ranges else {})
    return spark.read.format(FORMAT).options(**options).load()


def write_table(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """Write ``df`` as databases in the folder ``path``, one per partition; ``append`` adds to what is there."""
    _ready(df.sparkSession)
    df.write.format(FORMAT).mode(mode).options(path=path, table=table).save()


CHECK = "file string, reachable boolean, sound boolean, tables int, error string"


def check(spark: SparkSession, path: str) -> DataFrame:
    """Whether the executors can open each database, and its own quick check finds it sound."""
    files = databases(path) or [local_path(path)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column("file").to_pylist():
                try:
                    with _open(file) as db:
                        sound = db.execute("PRAGMA quick_check(1)").fetchone()[0] == "ok"
                        rows.append((file, True, sound, db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table'").fetchone()[0], None))
                except sqlite3.Error as error:
                    rows.append((file, os.path.isfile(file), False, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()), strict=True)], names=["file", "reachable", "sound", "tables", "error"])

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(look, CHECK)


CATALOG = "table string, column string, type string, nullable boolean, ordinal int, key_place int, refers string, indexes array<string>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row per column of the tables under ``path``: type, place in the primary key, what it refers to, and the indexes it is in. Metadata only."""
    rows = {}
    for file in databases(path):
        with _open(file) as db:
            for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                refers = {r[3]: f"{r[2]}.{r[4] or ''}".rstrip(".") for r in db.execute(f"PRAGMA foreign_key_list({_named(table)})")}
                indexes: dict[str, list[str]] = {}
                for index in sorted(r[1] for r in db.execute(f"PRAGMA index_list({_named(table)})")):
                    for r in db.execute(f"PRAGMA index_info({_named(index)})"):
                        indexes.setdefault(r[2], []).append(index)
                for k, (name, kind, strict, place) in enumerate(_columns(file, table)):
                    rows[table, name] = (table, name, _spark_type(kind), not strict, k, place, refers.get(name), indexes.get(name, []))
    return spark.createDataFrame(list(rows.values()), CATALOG)
