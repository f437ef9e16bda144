"""Readers on files like those that the tools write."""

import datetime as dt
import json
import sqlite3
from contextlib import closing

import pytest

from tallyspark.functions import columns as C
from tallyspark.operators import folds, pricing
from tallyspark.sources import files, readers, sqlite
from tallyspark.streaming import live

UTC = dt.UTC
START, END = dt.datetime(2026, 4, 10, tzinfo=UTC), dt.datetime(2026, 4, 11, tzinfo=UTC)


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path.parent)


def total(events):
    return [sum(r[c] for c in C.COUNTERS) for r in events.orderBy("ts").collect()]


def test_request_log(spark, tmp_path):
    line = lambda at, out: {"type": "assistant", "timestamp": f"2026-04-10T00:{at:02}:00Z", "requestId": "r1", "sessionId": "s", "cwd": "/w/app", "message": {"model": "claude-sonnet-4-6", "usage": {"input_tokens": 10, "output_tokens": out}}}
    path = write(tmp_path / "p" / "a.jsonl", [line(0, 2), "", "not json", line(4, 7), {"type": "user", "timestamp": "2026-04-10T00:00:00Z"}])
    found = readers.request_log(spark, path, START, END)
    assert total(found["events"]) == [17]
    r = found["events"].head()
    assert (r.project_name, r.quality, r.session_id, r.model) == ("app", "exact", "s", "claude-sonnet-4-6")
    assert found["activity"].count() == 2


def test_rollout_log(spark, tmp_path):
    count = lambda at, *t: {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), t, strict=True))}}}
    rows = [{"type": "session_meta", "payload": {"id": "x", "cwd": "/w/app"}}, count("2026-04-09T23:00:00Z", 100, 20, 40, 10), count("2026-04-10T01:00:00Z", 140, 30, 55, 15), count("2026-04-10T02:00:00Z", 140, 30, 55, 15), count("2026-04-10T03:00:00Z", 200, 50, 80, 20)]
    path = write(tmp_path / "a.jsonl", rows)
    events = readers.rollout_log(spark, path, START, END)["events"]
    assert total(events) == [55, 85]
    sums = events.groupBy().sum(*C.COUNTERS).head()
    assert tuple(sums) == (70, 30, 30, 0, 10)


def test_headed_log(spark, tmp_path):
    usage = lambda i, o, r, w, reason, cost: {"input": i, "output": o, "cacheRead": r, "cacheWrite": w, "reasoningTokens": reason, "cost": {"total": cost}}
    rows = [
        {"type": "session", "id": "s", "cwd": "/w"},
        {"type": "message", "timestamp": "2026-04-10T00:00:00Z", "message": {"role": "assistant", "model": "m", "usage": usage(100, 30, 8, 2, 7, 0.005)}},
        {"type": "message", "timestamp": "2026-04-10T00:01:00Z", "message": {"role": "toolResult", "toolName": "task", "details": {"usage": usage(50, 12, 4, 1, 0, 0.002)}}},
        {"type": "message", "timestamp": "2026-04-10T00:02:00Z", "message": {"role": "toolResult", "toolName": "other", "details": {"usage": usage(5, 5, 5, 5, 0, 1.0)}}},
    ]
    events = readers.headed_log(spark, write(tmp_path / "a.jsonl", rows), START, END)["events"]
    assert total(events) == [140, 67]
    s = events.groupBy().sum(*C.COUNTERS, "cost").head()
    assert tuple(s)[:5] == (150, 35, 12, 3, 7) and s[5] == pytest.approx(0.007)
    assert {r.session_id for r in events.collect()} == {"s"}


def test_aliased_log(spark, tmp_path):
    rows = [{"role": "assistant", "timestamp": "2026-04-10T01:00:00Z", "usage": {"input_tokens": 300, "output_tokens": 40}}, {"role": "assistant", "created_at": "2026-04-10T02:00:00Z", "usage": {"prompt_tokens": 400, "completion_tokens": 50}}, {"role": "user", "timestamp": "2026-04-10T02:00:00Z", "usage": {"input_tokens": 9}}, {"role": "assistant", "timestamp": "2026-04-11T00:00:00Z", "usage": {"input_tokens": 9}}, {"role": "assistant", "timestamp": "2026-04-10", "usage": {"input_tokens": 9}}]
    s = readers.aliased_log(spark, write(tmp_path / "a.jsonl", rows), START, END)["events"].groupBy().sum("input_tokens", "output_tokens").head()
    assert tuple(s) == (700, 90)


def test_json_sessions(spark, tmp_path):
    write(tmp_path / "d" / "a.json", [{"messages": [{"timestamp": "2026-04-10T01:00:00Z", "type": "gemini", "model": "gemini-3", "tokens": {"input": 10, "output": 5, "cached": 4, "thoughts": 2, "tool": 1, "total": 18}}, {"type": "user"}]}])
    write(tmp_path / "d" / "b.json", ['[{"usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 3, "totalTokenCount": 10, "cachedContentTokenCount": 0}}]'])
    found = readers.json_sessions(spark, str(tmp_path / "d"), dt.datetime(2026, 1, 1, tzinfo=UTC), dt.datetime(2036, 1, 1, tzinfo=UTC))["events"]
    assert sorted(total(found)) == [10, 18]


def test_sqlite_bubbles(spark, tmp_path):
    path = str(tmp_path / "c.db")
    bubble = lambda b, at, i, o, u, model=None: (f"bubbleId:{b}", json.dumps({"bubbleId": b, "createdAt": at, "usageUuid": u, "tokenCount": {"inputTokens": i, "outputTokens": o}, **({"modelInfo": {"modelName": model}} if model else {})}))
    rows = [bubble("1", "2026-04-10T01:00:00Z", 120, 30, "u1"), bubble("1b", "2026-04-10T01:00:01Z", 0, 0, "u1", "gpt-5.2"), bubble("2", "2026-04-10T02:00:00Z", 80, 20, "u2", "claude-4.5-sonnet-thinking"), bubble("3", "2026-04-12T02:00:00Z", 9, 9, "u3"), ("other", "x"), ("bubbleId:z", "not json")]
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(k, v.encode()) for k, v in rows])
        db.commit()
    events = readers.bubbles(spark, path, START, END)["events"]
    priced = pricing.with_cost(events, reasoning=False)
    assert tuple(priced.groupBy().sum("input_tokens", "output_tokens", "cost_nano").head()) == (200, 50, 1_170_000)


def test_sqlite_messages_and_sessions(spark, tmp_path):
    path = str(tmp_path / "o.db")
    ms = int(START.timestamp() * 1000)
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE message (session_id TEXT, time_created INTEGER, data TEXT)")
        data = json.dumps({"role": "assistant", "modelID": "gpt-5.4", "tokens": {"input": 5, "output": 4, "reasoning": 3, "cache": {"read": 2, "write": 1}}})
        db.executemany("INSERT INTO message VALUES (?, ?, ?)", [("s", ms + 5, data), ("s", ms - 5, data), (None, ms + 9, '{"role": "user"}')])
        db.execute("CREATE TABLE threads (rollout_path TEXT, model TEXT, source TEXT, created_at INTEGER, updated_at INTEGER)")
        db.executemany("INSERT INTO threads VALUES (?, ?, ?, ?, ?)", [("/a", "m", "cli", 0, ms // 1000 + 5), ("/b", "", '{"subagent": 1}', 0, 5)])
        db.execute("CREATE TABLE sessions (id TEXT, started_at REAL, model TEXT, input_tokens INTEGER, output_tokens INTEGER)")
        db.execute("INSERT INTO sessions VALUES ('h', 1.5, 'm', 10, 5)")
        db.execute("CREATE TABLE session_model_usage (session_id TEXT, model TEXT, task TEXT, api_call_count INTEGER, input_tokens INTEGER, output_tokens INTEGER)")
        db.executemany("INSERT INTO session_model_usage VALUES ('h', ?, ?, ?, ?, ?)", [("a", "", 2, 0, 0), ("b", "x", 1, 30, 1)])
        db.commit()
    assert total(readers.message_table(spark, path, START, END)["events"]) == [15]
    assert [(r.rollout, r.agent_kind, r.project_path) for r in readers.indexed_sessions(spark, path, START, END).collect()] == [("/a", "main", None)]
    store = readers.session_store(spark, path)
    s = store["sessions"].head()
    assert (s.input_tokens, s.output_tokens, s.model, s.started_us, s.latest_us) == (30, 5, None, 1_500_000, None)
    assert store["unmetered"].head().calls == 2
    many = sqlite.read_table(spark, path, "message", partitions=3)
    assert many.rdd.getNumPartitions() == 3 and many.count() == 3
    assert readers.collect(spark, {"OpenCode": path, "OpenClaw": str(tmp_path / "none")}, START, END)[1].where("status = 'failed'").count() == 1


def test_files(spark, tmp_path):
    write(tmp_path / "sessions/2026/04/05/a.jsonl", ["1"])
    write(tmp_path / "sessions/2026/04/08/b.jsonl", ["2", "", "3"])
    write(tmp_path / "archived_sessions/c.jsonl", ["4"])
    found = files.in_days(files.lines(spark, str(tmp_path)), "2026-04-10", "2026-04-10")
    assert sorted(r.text for r in found.collect()) == ["2", "3", "4"]


def test_only_wanted_days_are_listed(spark, tmp_path):
    for day in ("2026/04/01", "2026/04/08", "2026/04/10"):
        write(tmp_path / f"sessions/{day}/r.jsonl", ["x"])
    write(tmp_path / "archived_sessions/old.jsonl", ["x"])
    found = files.day_folders(spark, str(tmp_path), START.date(), END.date())
    assert [f.removeprefix(str(tmp_path)) for f in found] == ["/sessions/2026/04/08", "/sessions/2026/04/10", "/archived_sessions"]


def test_sessions_reach_the_union(spark, tmp_path):
    path = str(tmp_path / "store.db")
    at = START.replace(tzinfo=dt.UTC).timestamp()
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sessions (id TEXT, started_at REAL, model TEXT, input_tokens INTEGER, output_tokens INTEGER, cwd TEXT, estimated_cost_usd REAL, actual_cost_usd REAL)")
        db.executemany("INSERT INTO sessions VALUES (?, ?, 'm', ?, 5, '/p', ?, ?)", [("in", at + 60, 10, 0.5, 0.0), ("old", at - 86400, 20, 1.0, 2.0), ("empty", at + 90, -5, 0, 0)])
        db.execute("CREATE TABLE messages (id TEXT, session_id TEXT, timestamp REAL)")
        db.execute("INSERT INTO messages VALUES ('1', 'in', ?)", (at + 3600,))
    tables, status = readers.collect_all(spark, {"Hermes": path, "OpenClaw": str(tmp_path / "none")}, START, END)
    rows = tables["events"].collect()
    assert [(r.session_id, r.model, r.input_tokens, r.output_tokens, r.cost, r.project_path, r.reader) for r in rows] == [("in", "m", 10, 5, 0.5, "/p", "Hermes")]
    assert rows[0].ts == (START + dt.timedelta(hours=1)).replace(tzinfo=None)
    assert {r.reader: r.status for r in status.collect() if r.status != "disabled"} == {"Hermes": "ok", "OpenClaw": "failed"}


def test_streams(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    write(src / "a.json", [{"device_id": "a", "sequence": 1, "digest": "x"}, {"device_id": "a", "sequence": 3, "digest": "y"}])
    stream = spark.readStream.schema("device_id string, sequence long, digest string").json(str(src))
    q = live.keep_latest(stream, str(out), str(ck)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.sequence for r in live.latest(spark, str(out), 0).collect()] == [3]
    samples = tmp_path / "s"
    write(samples / "a.json", [{"key": "k", "day": "d", "at_us": 0, "tokens": 120}, {"key": "k", "day": "d", "at_us": 5_000_000, "tokens": 180}])
    rates = live.velocities(spark.readStream.schema("key string, day string, at_us long, tokens long").json(str(samples)), weight=1.0)
    q = rates.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.rate for r in spark.table("rates").collect()) == [0.0, 12.0]
    assert folds.velocity(None, "d", 0.0, 1, 1.0, 1.0)[1] == 0
