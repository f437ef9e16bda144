"""The sync stream against a clock played by hand and against the plain cycle."""

import datetime
import json
import os
import random
from types import SimpleNamespace

import pytest

from tallyspark.streaming import sync

T0 = 1_700_000_000_000
SEEN = "device_id string, at timestamp, kind string, action string, sequence long, signature string, digest string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def row(device, ms, kind, action=None, sequence=None, signature=None, digest=None):
    return {"device_id": device, "at_ms": ms, "kind": kind, "action": action, "sequence": sequence, "signature": signature, "digest": digest}


def played(spark, tmp_path, batches, interval=300):
    """The actions of a stream that takes each batch's rows in one micro-batch."""
    seen, out = tmp_path / "seen", tmp_path / "out"
    seen.mkdir()
    for i, rows in enumerate(batches):
        file = seen / f"{i:04}.json"
        file.write_text("\n".join(json.dumps({**r, "at": datetime.datetime.fromtimestamp(r["at_ms"] / 1000, datetime.UTC).isoformat()}) for r in rows))
        os.utime(file, (1_000_000 + i, 1_000_000 + i))
    before = spark.conf.get(PROVIDER)
    sync.state_store(spark)
    try:
        stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).json(str(seen))
        query = sync.sync_actions(stream, interval).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    found = spark.read.parquet(str(out)).selectExpr("device_id", "unix_millis(at) ms", "action", "sequence", "digest", "attempt").collect()
    return sorted(map(tuple, found))


def test_waits_double_up_to_the_interval():
    waits = [sync.retry_delay(300, "d", n) for n in range(1, 12)]
    for wait, base in zip(waits, [30, 60, 120, 240] + [300] * 7, strict=True):
        assert base <= wait <= base + base // 5
    assert sync.retry_delay(10**6, "d", 9) == sync.retry_delay(10**6, "d", 9) <= 30 * 128 * 6 // 5
    assert 0 <= sync.regular_delay(300, "d", "initial") <= 30 and 300 <= sync.regular_delay(300, "d", "success") <= 330


def test_a_clock_played_by_hand(spark, tmp_path):
    first = T0 + 1000 * sync.regular_delay(300, "d", "initial")
    second = first + 1000 * (1 + sync.retry_delay(300, "d", 1))
    lost = second + 300_000
    third = lost + 1000 * sync.retry_delay(300, "d", 2)
    fourth = third + 1000
    fifth = fourth + 1000 * (1 + sync.regular_delay(300, "d", "success"))
    after = fifth + 1000
    sixth = after + 1000 * (1 + sync.regular_delay(300, "d", "success"))
    tick = lambda ms: [row("clock", ms, "ok")]  # noqa: E731  a row that only moves the watermark
    batches = [
        [row("d", T0, "source", signature="s1", digest="a")],
        tick(first + 500),
        [row("d", first + 1000, "failed", "upload", 1), row("d", first + 1000, "ok", "heartbeat", 1), row("d", first + 1500, "source", signature="s2", digest="b")],
        tick(third + 500),  # the second upload has no reply, the third is sent
        [row("d", fourth, "ok", "upload", 1)],  # the cycle goes on with what is new
        [row("d", fourth + 1000, "ok", "upload", 2)],
        tick(fifth + 500),
        [row("d", after, "conflict", "heartbeat", 2)],  # the hub lost it: uploaded at once
        [row("d", after + 1000, "ok", "upload", 3)],
        tick(sixth + 500),
        tick(sixth + 600),
    ]
    assert played(spark, tmp_path, batches) == sorted(
        [
            ("d", first, "upload", 1, "a", 1),
            ("d", second, "upload", 1, "a", 2),
            ("d", third, "upload", 1, "a", 3),
            ("d", fourth, "upload", 2, "b", 3),
            ("d", fifth, "heartbeat", 2, "b", 1),
            ("d", after, "upload", 3, "b", 1),
            ("d", sixth, "heartbeat", 3, "b", 1),
        ]
    )


def test_the_stream_equals_the_plain_cycle_however_rows_are_batched(spark, tmp_path):
    draw, want, rows = random.Random(3), [], []
    for k in range(12):
        device, c, clock = f"d{k}", sync.Cycle(), T0
        for _ in range(25):
            clock += draw.randint(1, 400) * 1000
            c, due = sync.passed(c, device, clock, 120)
            kind = draw.choice(["source", "ok", "ok", "failed", "conflict"]) if c.asked else "source"
            r = row(device, clock, kind, *((None, None, draw.choice(["s", "t", None]), draw.choice("ab")) if kind == "source" else (c.asked, c.sequence)))
            c, more = sync.told(c, device, SimpleNamespace(**r), clock, 120)
            want += due + more
            rows.append(r)
    rows.sort(key=lambda r: r["at_ms"])
    found = played(spark, tmp_path, [rows[i : i + 60] for i in range(0, len(rows), 60)], 120)
    last = {r["device_id"]: r["at_ms"] for r in rows}
    assert [f for f in found if f[1] <= last[f[0]]] == sorted(want) and len(want) > 100


@pytest.mark.parametrize("rows", [[], [row(None, T0, "source"), row("d", T0, None), row("d", T0, "ok", "upload", 1)]])
def test_nothing_to_send(spark, tmp_path, rows):
    assert played(spark, tmp_path, [[row("d", T0, "ok")], rows]) == []
