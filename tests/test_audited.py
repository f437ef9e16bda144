"""Files of the audit: discovery by metadata, databases as lines, and the stream of appended lines."""

import datetime as dt
import json
import os
import sqlite3
from collections import Counter
from contextlib import closing

import pytest

from tallyspark.sources import audited, files, sqlite

KEY = "ghp_" + "a1B2" * 9
OTHER = "npm_" + "Z9y8" * 9


def put(path, text, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    if at:
        os.utime(path, (at, at))
    return str(path)


def database(path, **tables):
    path.parent.mkdir(parents=True, exist_ok=True)
    with closing(sqlite3.connect(path)) as db:
        for name, (columns, rows) in tables.items():
            db.execute(f"CREATE TABLE {name} ({columns})")
            for r in rows:
                db.execute(f"INSERT INTO {name} VALUES ({', '.join('?' for _ in r)})", r)
        db.commit()
    return str(path)


def test_discovery_by_ending_and_time(spark, tmp_path):
    since = dt.datetime(2026, 4, 10, tzinfo=dt.UTC)
    new, old = since.timestamp(), since.timestamp() - 1
    put(tmp_path / "b" / "new file.JSONL", "x", new)
    put(tmp_path / "a.jsonl", "xyz", new + 5)
    put(tmp_path / "old.jsonl", "x", old)
    put(tmp_path / "a.txt", "x", new)
    place = audited.Place("logs", str(tmp_path), ("jsonl",))
    found = audited.discover(spark, place, since).orderBy("path").collect()
    assert [(r.path.removeprefix(str(tmp_path)), r.bytes) for r in found] == [("/a.jsonl", 3), ("/b/new file.JSONL", 1)]
    assert audited.discover(spark, place).count() == 3
    assert audited.discover(spark, audited.Place("none", str(tmp_path / "missing"), ("jsonl",))).count() == 0


def test_a_database_takes_the_time_of_its_log(spark, tmp_path):
    since = dt.datetime(2026, 4, 10, tzinfo=dt.UTC)
    new, old = since.timestamp() + 9, since.timestamp() - 9
    for name in ("a", "b"):
        put(tmp_path / f"{name}.db", "x", old)
    put(tmp_path / "a.db-wal", "log", new)
    put(tmp_path / "lonely.db-wal", "log", new)
    put(tmp_path / "c.jsonl", "x", old)
    put(tmp_path / "c.jsonl-wal", "x", new)
    tables = audited.Place("d", str(tmp_path), ("db",), {"message": ("data",)})
    assert [(r.path, r.bytes) for r in audited.discover(spark, tables, since).collect()] == [(str(tmp_path / "a.db"), 1)]
    assert audited.discover(spark, audited.Place("l", str(tmp_path), ("jsonl",)), since).count() == 0
    assert [r.source for r in audited.discover_all(spark, (tables, audited.Place("l", str(tmp_path), ("jsonl",)))).orderBy("source", "path").collect()] == ["d", "d", "l"]


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)) + "\n\nlast"
    path = put(tmp_path / "a b.txt", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r.line_number: r.line for r in files.numbered_lines(spark, [path]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == dict(enumerate(text.split("\n"), 1))


def test_every_text_of_every_column_is_found_with_its_line(spark, tmp_path):
    rows = [(f"row {i}", i if i else None, b"\xff\xfe" if i % 2 else f"note\n{'key ' + KEY if i == 7 else ''}".encode()) for i in range(10)]
    path = database(tmp_path / "state.vscdb", odd=("a TEXT, n INTEGER, b BLOB", rows), plain=("k TEXT PRIMARY KEY, v TEXT", [("id", ""), ("z", f"{OTHER}\r\nend")]), bare=("k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID --", [("q", "w")]))
    with closing(sqlite3.connect(path)) as db:
        db.execute("UPDATE odd SET b = ? WHERE rowid = 8", (f"note\nkey {KEY}",))
        db.commit()
        want, n = {}, 0
        for table in ("bare", "odd", "plain"):
            for row in db.execute(f"SELECT * FROM {table}"):
                for v in row:
                    try:
                        text = v.decode() if isinstance(v, bytes) else "" if v is None else str(v)
                    except UnicodeDecodeError:
                        continue
                    for line in text.split("\n") if text else ():
                        n += 1
                        want[n] = line.removesuffix("\r")
    texts = sqlite.read_texts(spark, [path], rows=3)
    got = audited.numbered(texts).collect()
    assert {r.line_number: r.line for r in got} == want and len(got) == len(want)
    assert texts.rdd.getNumPartitions() == 6
    place = audited.Place("Cursor", str(tmp_path), ("vscdb",), {"odd": ("b",), "plain": ("v", "gone"), "missing": ("x",)})
    found = {(r.rule_name, r.line_number, r.masked) for r in audited.scan(spark, (place,)).collect()}
    narrow = [x for i, r in enumerate(rows) if i == 7 or i % 2 == 0 for x in ("note", "second")]
    assert {x[0] for x in found} == {"GitHub token", "npm token"}
    assert {x[1] for x in found} == {2 * sum(i == 7 or i % 2 == 0 for i in range(8)), len(narrow) + 1}


def test_a_file_that_is_no_database_is_a_row_and_others_are_read(spark, tmp_path):
    good = database(tmp_path / "a.db", message=("data TEXT", [(f"token: {KEY}",)]))
    bad = put(tmp_path / "b.db", "no database" * 500)
    rows = sqlite.read_texts(spark, [good, bad, str(tmp_path / "none.db")]).collect()
    assert {r.path: r.error is None for r in rows} == {good: True, bad: False, str(tmp_path / "none.db"): False}
    found = audited.scan(spark, (audited.Place("OpenCode", str(tmp_path), ("db",), {"message": ("data",)}),))
    assert {r.rule_name for r in found.collect()} >= {"GitHub token"} and {r.path for r in found.collect()} == {good}


def test_databases_are_written_by_tasks(spark, tmp_path):
    sqlite.write_files(spark.range(1000).selectExpr("id", "concat('t', id) AS text", "id / 2 AS half").repartition(3), str(tmp_path / "out"), "message")
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 3 and all(n.endswith(".db") for n in names)
    texts = sqlite.read_texts(spark, [str(tmp_path / "out" / n) for n in names], {"message": ("text",)}, rows=100)
    assert {r.text for r in texts.collect()} == {f"t{i}" for i in range(1000)}


class Log:
    """A folder, the stream over it, and what a full scan of it says."""

    def __init__(self, spark, tmp_path, endings="jsonl,json"):
        self.spark, self.root, self.tmp, self.endings, self.clock = spark, tmp_path / "logs", tmp_path, endings, 1_800_000_000
        self.before = Counter()
        self.root.mkdir()

    def put(self, name, text):
        self.clock += 1
        put(self.root / name, text, self.clock)

    def lines(self):
        return audited.appended_lines(self.spark, str(self.root), str(self.tmp / "marks"), self.endings)

    def run(self):
        """The rows that one batch read: how many by (file, op)."""
        out = str(self.tmp / "seen")
        both = self.lines().writeStream.format("json").option("path", out).option("checkpointLocation", str(self.tmp / "c1")).trigger(availableNow=True).start()
        both.awaitTermination()
        rows = self.spark.read.schema("path string, op string, line_number long, line string").json(out).collect()
        found = [(os.path.basename(r.path), r.op, r.line_number) for r in rows]
        new = Counter(found) - self.before
        self.before = Counter(found)
        return sorted(found, key=str), sorted(new.elements(), key=str)

    def findings(self):
        q = audited.keep_findings(self.lines(), str(self.tmp / "found"), str(self.tmp / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(os.path.basename(r.path), r.rule_name, r.line_number) for r in audited.found_now(self.spark, str(self.tmp / "found")).collect()}
        place = audited.Place("logs", str(self.root), tuple(self.endings.split(",")))
        want = {(os.path.basename(r.path), r.rule_name, r.line_number) for r in audited.scan(self.spark, (place,)).collect()}
        assert got == want
        return got


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_only_appended_lines_are_read(log):
    log.put("a.jsonl", "one\ntwo\n")
    log.put("b.jsonl", "x\n")
    assert log.run()[0] == [("a.jsonl", "line", 1), ("a.jsonl", "line", 2), ("b.jsonl", "line", 1)]
    log.put("a.jsonl", "one\ntwo\nthree\n\nfive\n")
    assert log.run()[1] == [("a.jsonl", "line", 3), ("a.jsonl", "line", 4), ("a.jsonl", "line", 5)]
    assert log.run()[1] == []
    (log.root / "b.jsonl").unlink()
    assert log.run()[1] == [("b.jsonl", "gone", None)]
    assert len(os.listdir(log.tmp / "marks")) <= 2  # the last batch is committed when the next begins


def test_rewritten_files_are_read_again(log):
    log.put("a.jsonl", "one\ntwo\n")
    log.put("open.jsonl", "no end")
    log.put("whole.json", "{}\n")
    log.run()
    log.put("a.jsonl", "ONE\ntwo\nthree\n")
    log.put("open.jsonl", "no end yet\n")
    log.put("whole.json", "{}\n{}\n")
    grown, _ = log.run()
    assert [x for x in grown if x[1] == "reset"] == [("a.jsonl", "reset", None), ("open.jsonl", "reset", None), ("whole.json", "reset", None)]
    assert sum(x == ("a.jsonl", "line", 2) for x in grown) == 2


def test_findings_equal_a_full_scan_after_each_change(log):
    log.put("a.jsonl", "clean\n")
    assert log.findings() == set()
    log.put("a.jsonl", f"clean\nkey {KEY}\n")
    assert log.findings() == {("a.jsonl", "GitHub token", 2)}
    log.put("b.jsonl", f"{OTHER}\nrest")
    log.put("a.jsonl", f"clean\nkey {KEY}\n\n{OTHER}\n")
    assert log.findings() == {("a.jsonl", "GitHub token", 2), ("a.jsonl", "npm token", 4), ("b.jsonl", "npm token", 1)}
    log.put("a.jsonl", f"short {OTHER}\n")
    assert log.findings() == {("a.jsonl", "npm token", 1), ("b.jsonl", "npm token", 1)}
    (log.root / "b.jsonl").unlink()
    log.put("c.jsonl", "")
    assert log.findings() == {("a.jsonl", "npm token", 1)}


def test_a_lost_mark_means_a_full_read(log):
    log.put("a.jsonl", "one\n")
    log.run()
    for name in os.listdir(log.tmp / "marks"):
        (log.tmp / "marks" / name).unlink()
    log.put("a.jsonl", "one\ntwo\n")
    assert ("a.jsonl", "reset", None) in log.run()[1]


def test_texts_of_databases_pass_in_bounded_batches(spark, tmp_path):
    """Long and short texts, a stretch of many rows: no batch holds more than the bound and one text, and nothing is left out."""
    path = str(tmp_path / "a.db")
    texts = [("x" * 300_000 if i % 400 == 0 else "é" * 3000 if i < 1000 else str(i)) for i in range(5000)]
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE t (a TEXT)")
        db.executemany("INSERT INTO t VALUES (?)", [(t,) for t in texts])
        db.commit()
    reader = sqlite.TextsReader({"paths": json.dumps([path])})
    (stretch,) = reader.partitions()
    batches = list(reader.read(stretch))
    assert [t for b in batches for t in b.column("text").to_pylist()] == texts
    assert all(b.num_rows <= 1000 and sum(map(len, b.column("text").to_pylist())) <= (1 << 20) + 300_000 for b in batches)
    assert [r.text for r in sqlite.read_texts(spark, [path]).orderBy("row_id").collect()] == texts
    name, folder = "spark.sql.execution.arrow.maxRecordsPerBatch", str(tmp_path / "out")
    before = spark.conf.get(name)
    sqlite.write_files(spark.range(7000).selectExpr("id", "repeat('y', 500) AS v").coalesce(1), folder, "t")
    assert spark.conf.get(name) == before and sqlite.read_texts(spark, [f"{folder}/{f}" for f in os.listdir(folder)]).count() == 14_000
