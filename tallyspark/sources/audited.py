"""What the audit looks at: files found by their metadata, and a stream of the lines that are appended to them."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.operators import audit
from tallyspark.sources import files, sqlite

#: Bytes that are read at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Place:
    """Where a tool keeps files: folder, endings, and for databases the columns of tables that hold text."""

    name: str
    root: str
    endings: tuple[str, ...]
    tables: dict[str, tuple[str, ...]] | None = None


def places(home: str) -> tuple[Place, ...]:
    """The audited folders below a home folder, in their fixed order."""
    return (
        Place("Claude Code", f"{home}/.claude/projects", ("jsonl",)),
        Place("Codex", f"{home}/.codex", ("jsonl",)),
        Place("Cursor", f"{home}/Library/Application Support/Cursor/User/globalStorage", ("vscdb",), {"cursorDiskKV": ("value",)}),
        Place("Gemini CLI", f"{home}/.gemini/tmp", ("json",)),
        Place("OpenCode", f"{home}/.local/share/opencode", ("db",), {"message": ("data",)}),
        Place("OpenClaw", f"{home}/.openclaw/agents", ("jsonl",)),
    )


def discover(spark: SparkSession, place: Place, since: datetime | None = None) -> DataFrame:
    """(source, path, bytes, changed): files of a place that changed at or after `since`; no file is opened.

    A database also changes when its write-ahead log does, so it takes the
    newer of the two times.  A folder that does not exist has no files.
    """
    if not files.exists(spark, place.root):
        return spark.createDataFrame([], "source string, path string, bytes long, changed timestamp")
    listed = files.listed(spark, place.root)
    ending = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\.([^.]*)$", 1))
    if place.tables is None:
        found = listed.where(ending.isin(*place.endings))
    else:
        marked = listed.withColumns({"log": F.col("path").endswith("-wal"), "base": F.regexp_replace("path", "-wal$", "")}).where(F.lower(F.regexp_extract("base", r"\.([^./]*)$", 1)).isin(*place.endings))
        found = marked.groupBy("base").agg(F.max(F.when(~F.col("log"), F.col("bytes"))).alias("bytes"), F.max("changed").alias("changed")).where("bytes IS NOT NULL").withColumnRenamed("base", "path")
    if since is not None:
        found = found.where(F.col("changed") >= F.lit(since))
    return found.select(F.lit(place.name).alias("source"), "path", "bytes", "changed")


def discover_all(spark: SparkSession, found: tuple[Place, ...], since: datetime | None = None) -> DataFrame:
    """The files of all places; order by path where the order matters, as a union has none."""
    out = None
    for p in found:
        more = discover(spark, p, since)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else spark.createDataFrame([], "source string, path string, bytes long, changed timestamp")


# Appended lines

class Change(InputPartition):
    """A file whose size or time differs from what was read; None where it was or is not there."""

    def __init__(self, path: str, before: list[int] | None, now: list[int] | None) -> None:
        self.path, self.before, self.now = path, before, now


class AppendedReader(DataSourceStreamReader):
    """Offsets are {path: [bytes, time]}.  The driver only lists; what was read is marked by the tasks that read it.

    A mark holds the digest of a file's first bytes, its number of lines and
    whether it ended a line, under the path and the offset that it belongs to.
    The task that reads on takes it up: if the bytes before the offset still
    have that digest, it emits what comes after them; else the whole file,
    after a row that takes back what came from it.  A batch that is run again
    reads the same ranges and writes the same marks.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.marks = sqlite.plain_path(options["path"]), sqlite.plain_path(options["marks"])
        self.endings = tuple(f".{e}" for e in options.get("endings", "jsonl").split(","))
        self.grows = tuple(f".{e}" for e in options.get("grows", "jsonl").split(","))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.lower().endswith(self.endings):
                    try:
                        s = os.stat(os.path.join(folder, name))
                    except FileNotFoundError:  # gone since it was listed
                        continue
                    found[os.path.join(folder, name)] = [s.st_size, s.st_mtime_ns]
        return dict(sorted(found.items()))

    def partitions(self, start: dict, end: dict) -> list[Change]:
        return [Change(p, start.get(p), end.get(p)) for p in sorted({*start, *end}) if start.get(p) != end.get(p)]

    def commit(self, end: dict) -> None:
        """Marks that no file needs any more go."""
        kept = {self._mark(p, at) for p, at in end.items()}
        if os.path.isdir(self.marks):
            for name in os.listdir(self.marks):
                if name.endswith(".json") and os.path.join(self.marks, name) not in kept:
                    os.unlink(os.path.join(self.marks, name))

    def read(self, change: Change) -> Iterator[tuple]:
        if change.now is None:
            yield change.path, "gone", None, None, None
            return
        try:
            with open(change.path, "rb") as f:
                yield from self._read(f, change)
        except FileNotFoundError:  # deleted after it was listed: the next batch says so
            return

    def _read(self, f, change: Change) -> Iterator[tuple]:
        digest, lines, ended = hashlib.sha256(), 0, True
        if change.before is not None:
            mark = self._load(change)
            digest = _digest(f, change.before[0])
            if mark and change.path.lower().endswith(self.grows) and change.now[0] > change.before[0] and mark["ended"] and mark["digest"] == digest.hexdigest():
                lines = mark["lines"]
            else:
                yield change.path, "reset", None, None, None
                f.seek(0)
                digest = hashlib.sha256()
        left, rest = change.now[0] - f.tell(), b""
        while left and (chunk := f.read(min(CHUNK, left))):
            left -= len(chunk)
            digest.update(chunk)
            ended = chunk.endswith(b"\n")
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                lines += 1
                yield change.path, "line", lines, line.decode("utf-8", "replace"), change.now[1] // 1000
        if rest:
            lines += 1
            yield change.path, "line", lines, rest.decode("utf-8", "replace"), change.now[1] // 1000
        self._save(change, {"digest": digest.hexdigest(), "lines": lines, "ended": ended})

    def _mark(self, path: str, at: list[int]) -> str:
        return os.path.join(self.marks, hashlib.sha256(f"{path}|{at[0]}|{at[1]}".encode()).hexdigest() + ".json")

    def _load(self, change: Change) -> dict | None:
        try:
            with open(self._mark(change.path, change.before)) as f:
                return json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            return None

    def _save(self, change: Change, mark: dict) -> None:
        os.makedirs(self.marks, exist_ok=True)
        at = self._mark(change.path, change.now)
        part = f"{at}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(mark, f)
        os.replace(part, at)


def _digest(f, n: int):
    """The digest of the next n bytes, as far as there are so many."""
    digest = hashlib.sha256()
    while n and (chunk := f.read(min(CHUNK, n))):
        digest.update(chunk)
        n -= len(chunk)
    return digest


class AppendedLines(DataSource):
    """format("appended_lines") for readStream.

    Options: path, the folder; marks, a folder that driver and executors
    share; endings of the files, and those of them that grow line by line.
    Each row is a line with its number, or says that what came from a file
    before is void: `reset` as the file was rewritten, `gone` as it was deleted.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, op string, line_number long, line string, changed_us long"

    def streamReader(self, schema) -> AppendedReader:  # noqa: N802
        return AppendedReader(dict(self.options))


def appended_lines(spark: SparkSession, path: str, marks: str, endings: str = "jsonl", grows: str = "jsonl") -> DataFrame:
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").options(path=path, marks=marks, endings=endings, grows=grows).load()


def keep_findings(changes: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """A streaming query that keeps the findings of all files as they are now, in versioned tables below `table`.

    Version b is version b-1 without the files that batch b resets or takes
    away, and what batch b finds.  Only the lines of the batch are scanned; a
    batch that is run again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        at = F.timestamp_micros("changed_us")
        found = audit.findings(batch.where("op = 'line'").withColumn("changed", at), "path", when="changed").drop("value")
        if number > 0:
            void = batch.where("op <> 'line'").select("path").distinct()
            found = spark.read.parquet(f"{table}/v={number - 1}").join(void, "path", "left_anti").unionByName(found)
        found.write.mode("overwrite").parquet(f"{table}/v={number}")
        batch.unpersist()

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def found_now(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The findings as of a version, the last one if none is given."""
    if version is None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(table)
        names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        version = max(int(n.removeprefix("v=")) for n in names if n.startswith("v="))
    return spark.read.parquet(f"{table}/v={version}")


# Databases as lines

def numbered(texts: DataFrame) -> DataFrame:
    """(path, tbl, row_id, col, line_number, line) of texts of databases: lines are numbered through a file from 1.

    texts: as of sqlite.read_texts().  Lines are counted by part, the parts'
    counts added up in a small table, and a window inside a part does the
    rest, so that no task orders a whole file.
    """
    split = texts.where("text IS NOT NULL").withColumn("_lines", F.split("text", "\n"))
    sized = split.withColumn("_n", F.size("_lines").cast("long"))
    parts = sized.groupBy("path", "part").agg(F.sum("_n").alias("_sum"))
    upto = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("path", "part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("path", "part").orderBy("row_id", "col_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(first, ["path", "part"])
    out = placed.select("path", "tbl", "row_id", "col", F.posexplode("_lines").alias("_at", "line"), (F.col("_first") + F.col("_in")).alias("_before"))
    return out.select("path", "tbl", "row_id", "col", (F.col("_before") + F.col("_at") + 1).alias("line_number"), F.regexp_replace("line", "\r$", "").alias("line"))


def scan(spark: SparkSession, found: tuple[Place, ...], since: datetime | None = None) -> DataFrame:
    """(source, path, line_number, rule_name, severity, category, masked, detected_at): a full audit of all places."""
    out = None
    for place in found:
        listed = discover(spark, place, since)
        paths = [r.path for r in listed.select("path").orderBy("path").collect()]
        if not paths:
            continue
        if place.tables is None:
            lines = files.numbered_lines(spark, paths)
        else:
            lines = numbered(sqlite.read_texts(spark, paths, place.tables)).select("path", "line_number", "line")
        rows = lines.join(listed.select("path", "changed"), "path").withColumn("source", F.lit(place.name))
        more = audit.findings(rows, "source", "path", when="changed").drop("value")
        out = more if out is None else out.unionByName(more)
    return out if out is not None else spark.createDataFrame([], "source string, path string, line_number long, rule_name string, severity string, category string, masked string, detected_at string")
