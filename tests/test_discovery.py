"""Which logs are read, how their sessions are merged with an index, and readers that fail while reading."""

import datetime as dt
import json
import os
import sqlite3
from contextlib import closing

import pytest

from tallyspark.functions import columns as C
from tallyspark.sources import readers

UTC = dt.UTC
START, END = dt.datetime(2026, 4, 10, tzinfo=UTC), dt.datetime(2026, 4, 11, tzinfo=UTC)
AT = START.timestamp()


def rollout(path, session, tokens, model=None, source=None, cwd=None, at=AT + 60, pad=0):
    """A log of one count, changed at a time."""
    total = {"input_tokens": tokens, "cached_input_tokens": 0, "output_tokens": 0, "reasoning_output_tokens": 0}
    rows = [
        {"type": "session_meta", "payload": {k: v for k, v in (("id", session), ("source", source), ("cwd", cwd)) if v}},
        *([{"type": "turn_context", "payload": {"model": model}}] if model else []),
        {"timestamp": "2026-04-10T01:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": total}}},
        *[{"type": "other", "payload": {"id": "x" * pad}}] * bool(pad),
    ]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    os.utime(path, (at, at))
    return str(path)


def index(path, *threads):
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE threads (rollout_path TEXT, model TEXT, source TEXT, cwd TEXT, created_at INTEGER, updated_at INTEGER)")
        db.executemany("INSERT INTO threads VALUES (?, ?, ?, ?, ?, ?)", threads)
        db.commit()
    return str(path)


def by_session(found):
    return {r.session_id: (os.path.basename(r.rollout), r.model, r.agent_kind, r.project_path, r.quality) for r in found.collect()}


def test_index_and_logs_are_merged(spark, tmp_path):
    day, old, now = tmp_path / "sessions/2026/04/10", tmp_path / "sessions/2026/03/01", int(AT) + 60
    told = rollout(day / "told.jsonl", "told", 10, "log-model", "cli", "/log")
    half = rollout(day / "half.jsonl", "half", 20, "gpt-5.4", '{"subagent": "x"}', "/half")
    far = rollout(old / "far.jsonl", "far", 30, at=AT - 9e6)
    rollout(day / "copy.jsonl", "same", 5, at=AT + 90)
    rollout(tmp_path / "archived_sessions/copy-long.jsonl", "same", 5, "m", pad=500)
    rollout(old / "unlisted.jsonl", "unlisted", 7)
    rollout(day / "stale.jsonl", "stale", 7, at=AT - 1)
    rollout(day / "unnamed.jsonl", None, 7)
    db = index(tmp_path / "state.sqlite", (told, "gpt-5", "cli", "/index", 0, now), (told, "gpt-5", "cli", "/index", 0, now), (half, "", "", "", 0, now), (far, "gpt-5", "cli", "/far", 0, now), (str(day / "missing.jsonl"), "m", "cli", "/x", 0, now), (half, "late", "cli", "/l", int(AT) + 90_000, now + 90_000))
    found = readers.merged_sessions(spark, str(tmp_path), db, START, END)
    got = by_session(found)
    assert got == {
        "told": ("told.jsonl", "gpt-5", "main", "/index", "exact"),
        "half": ("half.jsonl", "gpt-5.4", "subagent", "/half", "exact"),
        "far": ("far.jsonl", "gpt-5", "main", "/far", "exact"),
        "same": ("copy-long.jsonl", "m", "main", None, "unknown"),
        str(day / "unnamed.jsonl"): ("unnamed.jsonl", None, "main", None, "unknown"),
    }
    events = readers.rollout_log(spark, str(tmp_path), START, END, index=db)["events"]
    read = {os.path.basename(f) for f in events.inputFiles()}
    assert {f for f in read if f.endswith(".jsonl")} == {"told.jsonl", "half.jsonl", "far.jsonl", "copy-long.jsonl", "unnamed.jsonl"}
    assert sorted((r.input_tokens, r.model, r.project_path) for r in events.collect()) == [(5, "m", None), (7, None, None), (10, "gpt-5", "/index"), (20, "gpt-5.4", "/half"), (30, "gpt-5", "/far")]
    tables, status = readers.collect_all(spark, {"Codex": {"path": str(tmp_path), "index": db}}, START, END)
    assert tables["events"].groupBy("reader").sum("input_tokens").head()[1] == 72
    assert {r.reader: r.status for r in status.collect() if r.status != "disabled"} == {"Codex": "ok"}


@pytest.mark.parametrize("index_text", [None, "no database" * 99])
def test_logs_alone_where_there_is_no_index(spark, tmp_path, index_text):
    rollout(tmp_path / "sessions/2026/04/09/a b.jsonl", "a", 10, "m")
    if index_text:
        (tmp_path / "state.sqlite").write_text(index_text)
    events = readers.rollout_log(spark, str(tmp_path), START, END, index=str(tmp_path / "state.sqlite"))["events"]
    assert [(r.input_tokens, r.model, r.session_id) for r in events.collect()] == [(10, "m", "a")]


def test_no_session_at_all(spark, tmp_path):
    (tmp_path / "archived_sessions").mkdir()
    found = readers.rollout_log(spark, str(tmp_path), START, END, index=index(tmp_path / "i.db"))
    assert found["events"].count() == 0 and found["sessions"].count() == 0
    assert set(found["events"].columns) == set(readers.EVENT)


def composer(path, value):
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
        rows = [("composerData:1", json.dumps({"lastUpdatedAt": int(AT * 1000) + 5, "contextTokensUsed": value, "modelConfig": {"modelName": "gpt-5"}}))]
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", rows)
        db.commit()
    return str(path)


@pytest.mark.parametrize(("now", "end", "live"), [(START + dt.timedelta(hours=5), END, 1), (END, END, 0), (START - dt.timedelta(seconds=1), END, 0), (START, END + dt.timedelta(days=1), 0)])
def test_live_contexts_belong_to_today_alone(spark, tmp_path, now, end, live):
    tables, _ = readers.collect_all(spark, {"Cursor": composer(tmp_path / "c.db", 90)}, START, end, now=now)
    found = tables["supplemental"].collect() if "supplemental" in tables else []
    assert [r.value for r in found] == [90] * live


def test_one_corrupt_file_is_a_row_and_the_rest_is_read(spark, tmp_path):
    log = tmp_path / "claude/p/a.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text(json.dumps({"type": "assistant", "timestamp": "2026-04-10T00:00:00Z", "requestId": "r", "message": {"model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}}}) + "\n")
    cut = tmp_path / "claw/a.jsonl.gz"
    cut.parent.mkdir()
    cut.write_bytes(b"\x1f\x8b\x08\x00 this is no gzip")
    (tmp_path / "claw/b.jsonl").write_text("{}\n")
    messages = str(tmp_path / "o.db")
    with closing(sqlite3.connect(messages)) as db:
        db.execute("CREATE TABLE message (session_id TEXT, time_created INTEGER, data TEXT)")
        db.executemany("INSERT INTO message VALUES ('s', ?, ?)", [(int(AT * 1000), json.dumps({"role": "assistant", "pad": "x" * 900})) for _ in range(500)])
        db.commit()
    raw = bytearray(open(messages, "rb").read())
    raw[8 * 4096 : 40 * 4096] = bytes(32 * 4096)  # pages of the table, so that the schema still reads
    open(messages, "wb").write(raw)
    empty = tmp_path / "gjc"
    empty.mkdir()
    (empty / "a.jsonl").write_text("{}\n")
    paths = {"Claude Code": str(tmp_path / "claude"), "OpenCode": messages, "GJC": str(empty), "Hermes": str(tmp_path / "none.db"), "Cursor": composer(tmp_path / "c.db", 8), "OpenClaw": str(empty)}
    tables, status = readers.collect_written(spark, paths, START, END, enabled=set(paths) - {"OpenClaw"}, now=START)
    got = {r.reader: (r.status, r.events, r.total_tokens, r.output_tokens) for r in status.orderBy("place").collect()}
    assert list(got) == list(readers.READERS)
    assert got["Claude Code"] == ("loaded", 1, 7, 4) and got["OpenCode"] == ("failed", 0, 0, 0) and got["Hermes"][0] == "failed"
    assert got["GJC"] == ("empty", 0, 0, 0) and got["Cursor"] == ("loaded", 0, 0, 0) and got["OpenClaw"][0] == got["Codex"][0] == "disabled"
    assert all(r.message for r in status.where("status = 'failed'").collect())
    assert [(r.reader, sum(r[c] for c in C.COUNTERS)) for r in tables["events"].collect()] == [("Claude Code", 7)]
    assert tables["supplemental"].count() == 1
