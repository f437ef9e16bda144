"""The sync cycle of devices as a stream with timers: what each sends when, and when it tries again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The first wait after a failure in seconds, and the failures after which waits no longer double.
RETRY_S, MOST_FAILURES = 30, 8


@dataclass(frozen=True)
class Cycle:
    """A device: its source as last seen, what the hub holds of it, the upload not yet taken, and what it waits for.

    Times are milliseconds.  `asked` is the action whose reply is awaited,
    `fresh` whether an upload ends its cycle, as one that is tried again does not.
    """

    sequence: int = 0
    signature: str | None = None
    digest: str | None = None
    verified: str | None = None
    uploaded: str | None = None
    pending: str | None = None
    asked: str | None = None
    fresh: bool = False
    failures: int = 0
    due: int | None = None


STATE = "sequence long, signature string, digest string, verified string, uploaded string, pending string, asked string, fresh boolean, failures int, due long"


def jitter(most_s: int, *names: Any) -> int:
    """Seconds from 0 to most_s that depend on the names alone, so that a batch run again waits as long."""
    return int(hashlib.sha256(":".join(map(str, names)).encode()).hexdigest()[:8], 16) % (most_s + 1)


def regular_delay(interval_s: int, device: str, phase: str) -> int:
    """Seconds to the next cycle: up to a tenth of the interval more, or that alone before the first."""
    return jitter(max(1, interval_s // 10), phase, device) + (0 if phase == "initial" else interval_s)


def retry_delay(interval_s: int, device: str, failures: int) -> int:
    """Seconds to wait after so many failures in a row: doubled each time up to the interval, and up to a fifth more."""
    base = min(RETRY_S << (min(failures, MOST_FAILURES) - 1), interval_s)
    return base + jitter(max(1, base // 5), "retry", device, failures)


def failed(c: Cycle, device: str, at: int, interval_s: int) -> Cycle:
    n = min(c.failures + 1, MOST_FAILURES)
    return replace(c, failures=n, asked=None, due=at + 1000 * retry_delay(interval_s, device, n))


def act(c: Cycle, device: str, at: int, interval_s: int) -> tuple[Cycle, tuple]:
    """The next thing to send: a pending upload again, a heartbeat for what is unchanged, or an upload of the next sequence."""
    if c.pending is not None:
        c = replace(c, asked="upload", fresh=False)
    elif c.uploaded is not None and (c.uploaded == c.digest or (c.signature is not None and c.signature == c.verified)):
        c = replace(c, asked="heartbeat", verified=c.signature if c.uploaded == c.digest else c.verified)
    else:
        c = replace(c, asked="upload", fresh=True, sequence=c.sequence + 1, pending=c.digest)
    sent = (device, at, c.asked, c.sequence, c.pending if c.asked == "upload" else c.uploaded, c.failures + 1)
    return replace(c, due=at + 1000 * interval_s), sent


def passed(c: Cycle, device: str, until: int, interval_s: int) -> tuple[Cycle, list[tuple]]:
    """What falls due up to a time: an action, or the failure of one that had no reply for an interval."""
    out = []
    while c.due is not None and c.due <= until:
        if c.asked is not None:
            c = failed(c, device, c.due, interval_s)
        else:
            c, sent = act(c, device, c.due, interval_s)
            out.append(sent)
    return c, out


def told(c: Cycle, device: str, row: Any, at: int, interval_s: int) -> tuple[Cycle, list[tuple]]:
    """The state after a row: a source as it is now, or a reply to the action that is awaited; other replies change nothing."""
    if row.kind == "source":
        first = c.due is None
        return replace(c, signature=row.signature, digest=row.digest or "", due=at + 1000 * regular_delay(interval_s, device, "initial") if first else c.due), []
    if c.asked is None or row.action != c.asked or row.sequence != c.sequence:
        return c, []
    again = False
    if c.asked == "upload" and row.kind == "ok":
        again = not c.fresh
        c = replace(c, uploaded=c.pending, verified=None, pending=None)
    elif c.asked == "heartbeat" and row.kind == "conflict":
        again = True
        c = replace(c, uploaded=None, verified=None)
    elif row.kind != "ok":
        return failed(c, device, at, interval_s), []
    if again:
        c, sent = act(c, device, at, interval_s)
        return c, [sent]
    return replace(c, asked=None, failures=0, due=at + 1000 * regular_delay(interval_s, device, "success")), []


class Syncing(StatefulProcessor):
    """Holds one Cycle and one timer a device."""

    def __init__(self, interval_s: int):
        self.interval_s = interval_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.cycle = handle, handle.getValueState("cycle", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        c = old = Cycle(*self.cycle.get()) if self.cycle.exists() else Cycle()
        out = []
        for row in sorted(rows, key=lambda r: (r.at_ms, r.kind != "source", r.kind or "", r.sequence or 0, r.signature or "", r.digest or "")):
            c, due = passed(c, key[0], row.at_ms, self.interval_s)
            c, more = told(c, key[0], row, row.at_ms, self.interval_s)
            out += due + more
        self.keep(old, c)
        return map(self.row, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        old = Cycle(*self.cycle.get())
        c, out = passed(old, key[0], expiredTimerInfo.getExpiryTimeInMs(), self.interval_s)
        self.keep(replace(old, due=None), c)
        return map(self.row, out)

    def keep(self, old: Cycle, new: Cycle) -> None:
        if old.due != new.due:
            if old.due is not None:
                self.handle.deleteTimer(old.due)
            if new.due is not None:
                self.handle.registerTimer(new.due)
        self.cycle.update(astuple(new))

    @staticmethod
    def row(sent: tuple) -> Row:
        device, at, *rest = sent
        return Row(device_id=device, at_ms=at, action=rest[0], sequence=rest[1], digest=rest[2], attempt=rest[3])


def sync_actions(seen: DataFrame, interval_s: int = 300, late: str = "0 seconds") -> DataFrame:
    """(device_id, at, action, sequence, digest, attempt): what devices send, of a stream of what they see.

    seen: (device_id, at, kind, action, sequence, signature, digest).  A row of
    kind `source` gives the present signature and digest; `ok`, `conflict` and
    `failed` are the hub's replies to an action and its sequence.  An unchanged
    source sends a heartbeat, a changed one an upload of the next sequence,
    which stays pending until the hub takes it and is sent again before
    anything newer.  A refused heartbeat forgets what the hub holds and uploads
    in the same cycle; other failures, and no reply for an interval, wait for
    min(30 s * 2^(n-1), interval) and a fifth at most.

    Event time is the clock: a device's own rows move it, and for silent
    devices the watermark.  One state and one timer a device; rows without a
    device, time or kind are left out; a null digest counts as empty.  Needs
    the RocksDB state store, which `state_store` sets.
    """
    rows = seen.where("device_id is not null and at is not null and kind is not null").withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    made = rows.groupBy("device_id").transformWithState(Syncing(interval_s), "device_id string, at_ms long, action string, sequence long, digest string, attempt int", "append", "EventTime")
    return made.select("device_id", F.timestamp_millis("at_ms").alias("at"), "action", "sequence", "digest", "attempt")


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
