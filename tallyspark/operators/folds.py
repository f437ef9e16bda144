"""Order-dependent folds: cumulative counters, replay suppression, velocity and the delta ledger.

Each runs over partitions sorted by key and order and holds one state at a
time, so memory does not grow with the length of a key's history.  The steps
are plain functions that the streaming operators use as well.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyspark.functions.columns import COUNTERS

Step = Callable[[Any, Any], tuple[Any, list[tuple]]]


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df sorted by key and order, each key in one task, with `_at` from 1 in each key.

    The window asks for both, and adaptive plans keep what it asks for.  A
    plain repartition by key does not: where df is a union of inputs that each
    lie by key, it is left out as done already, and then the inputs' partitions
    are merged each in its own way.
    """
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fold(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Rows of each key in order through step(state, row) -> (state, rows out); the state begins as None.

    Rows come as Arrow batches, so that a column of longs with a null keeps its digits.
    """
    Row = namedtuple("Row", [*df.columns, "at"], rename=True)  # noqa: N806
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out: list[tuple] = []
            for row in map(Row._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                state, rows = step(None if row[-1] == 1 else state, row)
                out += rows
            columns = zip(*out, strict=True) if out else [()] * len(out_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return in_order(df, keys, order).mapInArrow(run, schema)


class Counts(NamedTuple):
    """Cumulative counters as a log reports them: cached is part of input, reasoning of output."""

    input: int
    cached: int
    output: int
    reasoning: int

    @property
    def spoken(self) -> int:
        return self.input + self.output

    def since(self, other: Counts) -> Counts:
        return Counts(*(a - b for a, b in zip(self, other, strict=True)))

    def split(self) -> tuple[int, int, int, int]:
        """Disjoint input, output, cache-read and reasoning tokens."""
        return max(0, self.input - self.cached), max(0, self.output - self.reasoning), self.cached, self.reasoning


#: How close to the baseline a smaller total is a late report, not a reset.
STALE_SHARE, STALE_STEPS = 0.98, 2


def advance(base: Counts | None, total: Counts, last: Counts | None) -> tuple[Counts, Counts]:
    """(next baseline, what this report adds)."""
    nothing = Counts(0, 0, 0, 0)
    if base is None:
        return total, last if last is not None else total
    if total == base:
        return base, nothing
    if all(t >= b for t, b in zip(total, base, strict=True)):
        return total, total.since(base)
    late = last is not None and min(base.spoken, total.spoken, last.spoken) > 0 and (total.spoken >= STALE_SHARE * base.spoken or total.spoken + STALE_STEPS * last.spoken >= base.spoken)
    if late:
        return base, nothing
    return (total if any(total) else base), (last if last is not None else nothing)


TOTAL, LAST = ("t_input", "t_cached", "t_output", "t_reasoning"), ("l_input", "l_cached", "l_output", "l_reasoning")
COUNTED = "input_tokens long, output_tokens long, cache_read_tokens long, reasoning_tokens long"


def _counts(row: Any, names: tuple[str, ...]) -> Counts | None:
    values = [getattr(row, n) for n in names]
    return None if values[0] is None else Counts(*(int(v or 0) for v in values))


def counter_step(state: Counts | None, row: Any) -> tuple[Counts | None, list[tuple]]:
    total = _counts(row, TOTAL)
    if total is None:
        return state, []
    state, added = advance(state, total, _counts(row, LAST))
    parts = added.split()
    return state, [(row.rollout, row.ts, row.ord, *parts)] if sum(parts) > 0 else []


#: Up to here sums and shares of counters are exact in doubles, as they are in whole numbers.
EXACT = 1 << 51
#: How often baselines are looked for anew before rows are stepped through one by one.
ROUNDS = 64


def advances(totals: np.ndarray, lasts: np.ndarray, known: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(what each report adds, place of the last baseline) of many rollouts' reports at once, as `advance` gives them one by one.

    totals and lasts have a row a counter; known tells where there are
    increments, begins where a rollout begins.  First every report is taken as
    the next one's baseline; those that then prove late or empty are no longer,
    and so on.  What a report is depends on those before it alone, so nothing
    changes any more only when all are as by the plain step.  None: too many
    rounds.
    """
    at, kept = np.arange(len(begins)), np.ones(len(begins), bool)
    spoken, step = totals[0] + totals[2], lasts[0] + lasts[2]
    for _ in range(ROUNDS):
        of = np.append(0, np.maximum.accumulate(np.where(kept, at, 0))[:-1])
        base, before = totals[:, of], spoken[of]
        up = (totals >= base).all(0)
        late = ~up & known & (np.minimum(np.minimum(before, spoken), step) > 0) & ((spoken >= STALE_SHARE * before) | (spoken + STALE_STEPS * step >= before))
        now = begins | up | ~late & totals.any(0)
        if (now == kept).all():
            added = np.where(begins, np.where(known, lasts, totals), np.where(up, totals - base, np.where(late, 0, lasts)))
            return added, int(np.flatnonzero(kept)[-1])
        kept = now
    return None


def counter_events(snapshots: DataFrame, kind: str = "string", ts: str = "timestamp_ntz") -> DataFrame:
    """(rollout, ts, ord, disjoint counters): what each report of a running total adds, rows that add nothing left out.

    snapshots: (rollout, ts, ord, t_* totals, l_* last increments or null), by
    time, not by place in the file.  Filter by time afterwards: the fold has to
    begin before the range.  Arrow batches of sorted reports are folded whole;
    from one to the next goes the baseline.
    """
    whole = {n: F.coalesce(F.col(n).cast("long"), F.lit(0)) for n in TOTAL} | {n: F.when(F.col(LAST[0]).isNotNull(), F.coalesce(F.col(n).cast("long"), F.lit(0))) for n in LAST}
    seen = snapshots.where(F.col(TOTAL[0]).isNotNull()).select(F.col("rollout").cast(kind).alias("rollout"), F.col("ts").cast(ts).alias("ts"), F.col("ord").cast("long").alias("ord"), *(c.alias(n) for n, c in whole.items()))
    schema = f"rollout {kind}, ts {ts}, ord long, {COUNTED}"
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 1), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = lambda names: np.array([batch.column(n).fill_null(0).to_numpy() for n in names])  # noqa: B023, E731
            totals, lasts = np.hstack([held, values(TOTAL)]), np.hstack([0 * held, values(LAST)])
            known, begins = np.append(False, batch.column(LAST[0]).is_valid().to_numpy(zero_copy_only=False)), np.append(True, batch.column("_at").to_numpy() == 1)
            small = max(totals.max(), lasts.max()) < EXACT and min(totals.min(), lasts.min()) > -EXACT
            if not (small and (found := advances(totals, lasts, known, begins))):
                found = _steps(totals, lasts, known, begins)
            added, stood = found
            held = totals[:, stood : stood + 1]
            i, c, o, r = added[:, 1:]
            parts = np.array([np.maximum(0, i - c), np.maximum(0, o - r), c, r])
            adds = pa.array(parts.sum(0) > 0)
            columns = [*(batch.column(n) for n in ("rollout", "ts", "ord")), *map(pa.array, parts)]
            yield pa.RecordBatch.from_arrays([x.filter(adds).cast(f.type) for x, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return in_order(seen, ["rollout"], ["ts", "ord"]).mapInArrow(run, schema)


def _steps(totals: np.ndarray, lasts: np.ndarray, known: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, int]:
    """advances() by the plain step."""
    base, stood, added = None, 0, []
    for k, (total, last, told, begin) in enumerate(zip(totals.T.tolist(), lasts.T.tolist(), known.tolist(), begins.tolist(), strict=True)):
        was = None if begin else base
        base, adds = advance(was, Counts(*total), Counts(*last) if told else None)
        stood = stood if base is was else k
        added.append(adds)
    return np.array(added, np.int64).T, stood


@dataclass(frozen=True)
class Fork:
    """Where a forked session's log is: still repeating its parent's, or on its own."""

    waiting: bool = False
    inherited: tuple[Counts, int | None] | None = None
    child: str | None = None
    repeated: str | None = None
    by_user: bool = False
    begun: frozenset = field(default_factory=frozenset)


def own_turn(state: Fork, turn: str | None, turn_key: str | None, child_key: str | None) -> bool:
    """Whether a turn's context is the child's; ids carry their time in the first digits."""
    if state.repeated is None or turn is None or turn_key is None or child_key is None:
        return True
    if turn_key != child_key:
        return turn_key > child_key
    return state.by_user or turn in state.begun


def replay_step(state: Fork | None, row: Any) -> tuple[Fork, list[tuple]]:
    s, kind = state or Fork(), row.entry
    if s.waiting:
        if kind == "turn_context":
            mine = own_turn(s, row.turn_id, row.turn_key, row.child_key if row.child_key is not None else None)
            return (replace(s, waiting=False, repeated=None, by_user=False, begun=frozenset()) if mine else s), []
        if kind == "task_started" and row.turn_id is not None:
            return replace(s, begun=s.begun | {row.turn_id}), []
        if kind == "session_meta":
            return (replace(s, repeated=row.session_id) if row.session_id is not None and row.session_id != s.child else s), []
    if kind == "session_meta" and row.parent_id is not None:
        again = row.session_id is not None and row.session_id == s.child
        s = replace(s, child=row.session_id)
        return (s if again else replace(s, waiting=True, inherited=None, repeated=None, by_user=row.thread_source == "user", begun=frozenset())), []
    total = _counts(row, TOTAL)
    if kind != "token_count" or row.ts is None or total is None:
        return s, []
    reported = None if row.t_reported is None else int(row.t_reported)
    if s.waiting:
        return replace(s, inherited=(total, reported)), []
    if s.inherited is not None:
        base, base_reported = s.inherited
        repeats = (reported is not None and base_reported is not None and reported <= base_reported) or all(t <= b for t, b in zip(total, base, strict=True))
        if repeats:
            return s, []
        s = replace(s, inherited=None)
    last = _counts(row, LAST) or (None,) * 4
    return s, [(row.rollout, row.ts, int(row.ord), *total, *last)]


def without_replays(entries: DataFrame, ts: str = "timestamp_ntz") -> DataFrame:
    """Snapshots of rollout logs, without what a fork repeats of its parent, in file order.

    entries: (rollout, ord, ts, entry, session_id, parent_id, thread_source,
    turn_id, turn_key, child_key, t_reported, t_*, l_*); the keys are the time
    digits of the turn's id and of the forked child's.
    """
    longs = ", ".join(f"{n} long" for n in (*TOTAL, *LAST))
    return fold(entries, ["rollout"], ["ord"], replay_step, f"rollout string, ts {ts}, ord long, {longs}")


@dataclass(frozen=True)
class Velocity:
    day: Any
    at: float
    tokens: int
    value: float


def velocity(state: Velocity | None, day: Any, at: float, tokens: int, weight: float, least_s: float) -> tuple[Velocity, float]:
    """(next state, smoothed tokens a second) of a sample of the day's running output total."""
    if state is None or state.day != day:
        return Velocity(day, at, tokens, 0.0), 0.0
    elapsed = at - state.at
    if elapsed < least_s:
        return state, state.value
    if tokens < state.tokens:
        return Velocity(day, at, tokens, 0.0), 0.0
    raw = (tokens - state.tokens) / elapsed
    value = weight * raw + (1 - weight) * state.value if state.value > 0 else raw
    return Velocity(day, at, tokens, value), value


def smoothed(at: np.ndarray, tokens: np.ndarray, begins: np.ndarray, value: float, weight: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rates, samples they stand on) of many days' samples at once, as `velocity` gives them one by one.

    begins marks where a key or day begins; `value` is the rate that the first
    sample already has.  A day's samples are laid out at least `least` apart
    from the next day's, so that one chain of jumps to the first sample that is
    far enough passes through all days; doubling the jumps finds its members.
    Between these a rate is an affine step of the one before, and doubling
    composes the steps.
    """
    n, day = len(at), np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    span = np.append(at[first[1:] - 1], at[-1]) - at[first] + least
    place = at - at[first][day] + np.append(0, np.cumsum(span)[:-1])[day]
    jump, on = np.append(np.searchsorted(place, place + least), n), np.zeros(n + 1, bool)
    on[0] = True
    while jump[0] < n:
        on[jump[np.flatnonzero(on)]] = True
        jump = jump[jump]
    kept = np.flatnonzero(on[:n])
    added, elapsed = np.diff(tokens[kept], prepend=0), np.diff(at[kept], prepend=0)
    reset = begins[kept] | (added < 0)
    raw = np.where(reset, 0.0, added / np.where(reset, 1, elapsed))
    raw[0] = value
    rises = np.cumsum(raw > 0)
    head = np.maximum.accumulate(np.where(reset, np.arange(len(kept)), 0))
    anew = rises - (raw > 0) == (rises - (raw > 0))[head]  # nothing above zero since the last reset
    while True:
        a, b, d = np.where(anew, 0.0, 1 - weight), np.where(anew, raw, weight * raw), 1
        while d < len(kept) and a.any():
            b[d:], a[d:] = b[d:] + a[d:] * b[:-d], a[d:] * a[:-d]
            d *= 2
        faded = np.append(False, b[:-1] == 0) & ~anew  # too small for a double, so the next begins anew
        if not faded.any():
            break
        anew = anew | faded
    last = np.cumsum(on[:n]) - 1
    return b[last], kept[last]


def velocities(samples: DataFrame, key: str = "string", weight: float = 0.65, least_s: float = 1.0) -> DataFrame:
    """(key, at_us, tokens, rate) for samples (key, day, at_us, tokens); of equal times the smaller total comes first.

    Arrow batches of sorted samples are smoothed whole; from one to the next
    goes the last sample that a rate stands on.
    """
    weight, least = min(max(weight, 0.0), 1.0), math.ceil(max(least_s, 0.1) * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, days = batch.column("key"), batch.column("day")
            at, tokens = (batch.column(c).cast(pa.int64()).to_numpy() for c in ("at_us", "tokens"))
            begins = np.ones(len(at), bool)
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (keys, days)]
            begins[1:] = (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)
            known = held is not None and (keys[0].as_py(), days[0].as_py()) == held[:2]
            if known:
                begins[0] = False
                rates, base = smoothed(np.append(held[2], at), np.append(held[3], tokens), np.append(True, begins), held[4], weight, least)
                stood = base[-1] - 1
                rates = rates[1:]
            else:
                rates, base = smoothed(at, tokens, begins, 0.0, weight, least)
                stood = base[-1]
            point = (at[stood], tokens[stood]) if stood >= 0 else held[2:4]
            held = (keys[-1].as_py(), days[-1].as_py(), *point, rates[-1])
            yield pa.RecordBatch.from_arrays([keys, pa.array(at), pa.array(tokens), pa.array(rates * 1e6)], names=["key", "at_us", "tokens", "rate"])

    sorted_samples = in_order(samples.select(F.col("key").cast(key), "day", "at_us", "tokens"), ["key"], ["at_us", "day", "tokens"])
    return sorted_samples.mapInArrow(run, f"key {key}, at_us long, tokens long, rate double")


@dataclass(frozen=True)
class Baseline:
    counters: tuple[int, ...]
    cost: float
    last_activity: int


def ledger_step(state: Baseline | None, row: Any) -> tuple[Baseline | None, list[tuple]]:
    """What an observation of a session's totals adds: ('event' | 'carry', time, counters, cost)."""
    now = tuple(int(getattr(row, c) or 0) for c in COUNTERS)
    cost = float(row.cost or 0.0)
    valid = lambda t: t is not None and row.started_us <= t <= row.observed_us
    latest = row.latest_us if valid(row.latest_us) else None
    fresh = Baseline(now, cost, int(latest if latest is not None else state.last_activity if state else row.started_us))
    out = lambda kind, at, counters, c: [(row.session, kind, int(at), *counters, float(c))]
    if state is None:
        if sum(now) <= 0:
            return None, []
        before = row.previous_us
        dated = before is not None and before <= row.observed_us and (row.started_us >= before or (valid(row.earliest_us) and row.earliest_us >= before))
        return fresh, out("event", latest if latest is not None else row.started_us, now, cost) if dated else out("carry", row.observed_us, now, cost)
    if any(a < b for a, b in zip(now, state.counters, strict=True)):
        return fresh, out("carry", row.observed_us, now, cost)
    delta = tuple(a - b for a, b in zip(now, state.counters, strict=True))
    if sum(delta) <= 0:
        return fresh, []
    at = latest if latest is not None and latest > state.last_activity else row.observed_us
    if cost >= state.cost:
        added = cost - state.cost
    else:
        rates = (row.input_rate, row.output_rate, row.cache_read_rate, row.cache_write_rate)
        added = 0.0 if rates[0] is None else (delta[0] * rates[0] + (delta[1] + delta[4]) * rates[1] + delta[2] * rates[2] + delta[3] * rates[3]) / 1e9
    return fresh, out("event", at, delta, added)


LEDGER = "session string, kind string, at_us long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", cost double"


def ledger(observations: DataFrame) -> DataFrame:
    """Dated events and undated carry-overs of sessions known only by their totals at each observation.

    observations: (session, observed_us, previous_us, started_us, earliest_us,
    latest_us, the five counters, cost, the four rates); previous_us is when the
    last successful observation was.

    Once a session has tokens, each observation is the next one's baseline, so
    ledger_step() needs no fold: the row before and the last known activity
    before are windows over a session, in one exchange.
    """
    by = Window.partitionBy("session").orderBy("observed_us")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    valid = lambda c: F.when((F.col(c) >= F.col("started_us")) & (F.col(c) <= F.col("observed_us")), F.col(c))
    rows = observations.withColumns({c: F.coalesce(F.col(c).cast("long"), zero) for c in COUNTERS} | {"cost": F.coalesce(F.col("cost").cast("double"), F.lit(0.0)), "_latest": valid("latest_us"), "_earliest": valid("earliest_us")})
    now = sum((F.col(c) for c in COUNTERS), zero)
    rows = rows.withColumn("_begun", F.max(now > 0).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_begun")
    rows = rows.withColumns({f"_b_{c}": F.lag(c).over(by) for c in (*COUNTERS, "cost")} | {"_seen": F.coalesce(F.last("_latest", ignorenulls=True).over(before), F.first("started_us").over(before))})
    first = F.col(f"_b_{COUNTERS[0]}").isNull()
    dated = (F.col("previous_us") <= F.col("observed_us")) & ((F.col("started_us") >= F.col("previous_us")) | F.coalesce(F.col("_earliest") >= F.col("previous_us"), F.lit(False)))
    event = F.coalesce(dated, F.lit(False))
    delta = {c: F.when(first, F.col(c)).otherwise(F.col(c) - F.col(f"_b_{c}")) for c in COUNTERS}
    fell = ~first & (F.least(*delta.values()) < 0)
    fresh = F.when(F.col("_latest") > F.col("_seen"), F.col("_latest")).otherwise(F.col("observed_us"))
    rates = F.col("input_rate").cast("double"), F.col("output_rate"), F.col("cache_read_rate"), F.col("cache_write_rate")
    d = [delta[c] for c in COUNTERS]
    priced = (d[0] * rates[0] + (d[1] + d[4]) * rates[1] + d[2] * rates[2] + d[3] * rates[3]) / 1e9
    added = F.when(F.col("cost") >= F.col("_b_cost"), F.col("cost") - F.col("_b_cost")).otherwise(F.coalesce(priced, F.lit(0.0)))
    carried = fell | first & ~event
    at = F.when(fell, F.col("observed_us")).when(first, F.when(event, F.coalesce("_latest", "started_us")).otherwise(F.col("observed_us"))).otherwise(fresh)
    told = {c: F.when(fell, F.col(c)).otherwise(delta[c]) for c in COUNTERS}
    kept = rows.withColumns({"_add": sum(d, zero), "_keep": first | fell}).where(F.col("_keep") | (F.col("_add") > 0))
    return kept.select(F.col("session").cast("string").alias("session"), F.when(carried, "carry").otherwise("event").alias("kind"), at.cast("long").alias("at_us"), *(c.cast("long").alias(n) for n, c in told.items()), F.when(first | fell, F.col("cost")).otherwise(added).cast("double").alias("cost"))
