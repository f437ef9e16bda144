"""Spark data sources for SQLite files: a table with filters pushed into the query, the texts of many files, and a writer."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Fixed value: how long a read waits for a writer.
BUSY_S = 2.0
#: What Python holds at a time of the texts that it reads, and rows of those that it writes.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 1_000
KINDS = (("INT", LongType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("BLOB", BinaryType()))
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def plain_path(path: str) -> str:
    """A path of the local or a mounted file system, as Spark writes it (file:/a, file:///a) or plain."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(plain_path(path))}?mode=ro", uri=True, timeout=BUSY_S)


def table_columns(path: str, table: str) -> list[tuple[str, str]]:
    """(name, declared type) of a table, empty if there is none."""
    with closing(_open(path)) as db:
        return [(r[1], (r[2] or "").upper()) for r in db.execute("SELECT * FROM pragma_table_info(?)", (table,))]


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("partitions", "1"))
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            sign = SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, int | float | str):
                self.where.append((f.attribute[0], sign, f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], "IS NOT", None))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        """Ranges of row numbers, so that a large table is read by several tasks."""
        with closing(_open(self.path)) as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a table without row numbers
                return [Rows(0, -1)]
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(high + 1, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        terms = [f'"{n}" {sign} ?' for n, sign, _ in self.where]
        values = [v for _, _, v in self.where]
        if partition.high >= partition.low:
            terms += ["rowid >= ?", "rowid < ?"]
            values += [partition.low, partition.high]
        sql = f"SELECT {', '.join(f'"{n}"' for n in names)} FROM \"{self.table}\"" + (f" WHERE {' AND '.join(terms)}" if terms else "")
        casts = [{LongType: int, DoubleType: float}.get(type(f.dataType)) for f in self.schema.fields]
        text = [isinstance(f.dataType, StringType) for f in self.schema.fields]
        with closing(_open(self.path)) as db:
            for row in db.execute(sql, values):
                yield tuple(None if v is None else v.decode("utf-8", "replace") if t and isinstance(v, bytes) else str(v) if t else c(v) if c else v for v, c, t in zip(row, casts, text, strict=True))


class FileWriter(DataSourceWriter):
    """Each task writes a database file of its own below the folder `path`; it gets its name when it is whole."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.folder, self.table = schema, plain_path(options["path"]), options["table"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        part = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.tmp")
        declared = {LongType: "INTEGER", DoubleType: "REAL", BinaryType: "BLOB"}
        columns = ", ".join(f'"{f.name}" {declared.get(type(f.dataType), "TEXT")}' for f in self.schema.fields)
        marks = ", ".join("?" for _ in self.schema.fields)
        with closing(sqlite3.connect(part)) as db:
            db.execute(f'CREATE TABLE "{self.table}" ({columns})')
            db.executemany(f'INSERT INTO "{self.table}" VALUES ({marks})', map(tuple, rows))
            db.commit()
        return Written(part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.part, m.part.removesuffix(".tmp") + ".db")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.unlink(m.part)


class Written(WriterCommitMessage):
    def __init__(self, part: str) -> None:
        self.part = part


class Stretch(InputPartition):
    """A range of row numbers of a table of a file; no range where the table has no row numbers, no table where the file can't be read."""

    def __init__(self, path: str, part: int, table: str | None, columns: list[str], low: int | None, high: int | None, error: str | None = None) -> None:
        self.path, self.part, self.table, self.columns, self.low, self.high, self.error = path, part, table, columns, low, high, error


class TextsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.tables, self.rows = json.loads(options["paths"]), json.loads(options.get("tables", "{}")), int(options.get("rows", "50000"))

    def partitions(self) -> list[Stretch]:
        out: list[Stretch] = []
        for path in self.paths:
            try:
                out += self._stretches(path)
            except sqlite3.Error as e:
                out.append(Stretch(path, 0, None, [], None, None, str(e)))
        return out

    def _stretches(self, path: str) -> list[Stretch]:
        out: list[Stretch] = []
        with closing(_open(path)) as db:
            wanted = self.tables or {r[0]: [] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name")}
            for table, columns in wanted.items():
                there = [r[1] for r in db.execute("SELECT * FROM pragma_table_info(?)", (table,))]
                columns = [c for c in there if c in columns] if columns else there
                if not columns:
                    continue
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
                except sqlite3.OperationalError:
                    out.append(Stretch(path, len(out), table, columns, None, None))
                    continue
                if low is not None:
                    for a in range(low, high + 1, self.rows):
                        out.append(Stretch(path, len(out), table, columns, a, min(high + 1, a + self.rows)))
        return out

    def read(self, x: Stretch) -> Iterator[pa.RecordBatch]:
        """Rows in batches of a bounded number of characters, however long the texts and the stretch are."""
        rows, held = [], 0
        for row in self._read(x):
            rows.append(row)
            held += len(row[6] or "")
            if held >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _read(self, x: Stretch) -> Iterator[tuple]:
        if x.error:
            yield x.path, x.part, None, None, None, None, None, x.error
            return
        names = ", ".join(map(_quoted, x.columns))
        sql, values = f"SELECT {'rowid' if x.low is not None else 'NULL'}, {names} FROM {_quoted(x.table)}", ()
        if x.low is not None:
            sql, values = f"{sql} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (x.low, x.high)
        try:
            with closing(_open(x.path)) as db:
                db.text_factory = bytes
                for n, (row_id, *row) in enumerate(db.execute(sql, values)):
                    for i, v in enumerate(row):
                        if (text := _text(v)) is not None:
                            yield x.path, x.part, x.table, n if row_id is None else row_id, i, x.columns[i], text, None
        except sqlite3.Error as e:
            yield x.path, x.part, x.table, None, None, None, None, str(e)


TEXTS = pa.schema([("path", pa.string()), ("part", pa.int32()), ("tbl", pa.string()), ("row_id", pa.int64()), ("col_no", pa.int32()), ("col", pa.string()), ("text", pa.string()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TEXTS, strict=True)], schema=TEXTS)


def _text(v) -> str | None:
    """A value as text: numbers as they are written, bytes if they are UTF-8; null and empty ones are none."""
    if isinstance(v, bytes):
        try:
            v = v.decode()
        except UnicodeDecodeError:
            return None
    return str(v) if v is not None and v != "" else None


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class TextsSource(DataSource):
    """format("sqlite_texts"): every text of every wanted column of many files, a row each.

    Options: paths, a JSON list; tables, a JSON object of columns by table
    (without columns: all; without tables: all); rows, how many row numbers a
    task reads.  A file or range that can't be read is one row with `error`.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_texts"

    def schema(self) -> str:
        return "path string, part int, tbl string, row_id long, col_no int, col string, text string, error string"

    def reader(self, schema: StructType) -> TextsReader:
        return TextsReader(dict(self.options))


def read_texts(spark: SparkSession, paths: list[str], tables: dict[str, tuple[str, ...]] | None = None, rows: int = 50_000) -> DataFrame:
    """(path, part, tbl, row_id, col_no, col, text, error) of database files."""
    spark.dataSource.register(TextsSource)
    return spark.read.format("sqlite_texts").options(paths=json.dumps(paths), tables=json.dumps(tables or {}), rows=str(rows)).load()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python by BATCH_ROWS: by default 10,000 are taken apart at once, whatever their length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_files(df: DataFrame, folder: str, table: str) -> None:
    """df as a table of database files, one a partition."""
    df.sparkSession.dataSource.register(SqliteSource)
    with _small_batches(df.sparkSession):
        df.write.format("sqlite_file").options(path=folder, table=table).mode("append").save()


class SqliteSource(DataSource):
    """format("sqlite_file") with the options path, table and partitions; written, path is a folder of files."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        found = table_columns(self.options["path"], self.options["table"])
        return StructType([StructField(n, next((k for mark, k in KINDS if mark in t), StringType())) for n, t in found])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, partitions: int = 1) -> DataFrame:
    """A table of a SQLite file; of the columns asked for, those that it lacks are null."""
    from pyspark.sql import functions as F

    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("sqlite_file").options(path=path, table=table, partitions=str(partitions)).load()
    if columns is None:
        return df
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def has_table(path: str, table: str) -> bool:
    return bool(table_columns(path, table))
