"""Structured Streaming forms of the stateful operators.

Watermarks and late data are an addition: the batch operators read whole
ranges and need none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions import columns as C
from tallyspark.operators import devices, folds

#: Fixed value: how recent the last sign of a tool must be, in seconds; one writes less often.
RECENT, RECENT_BY_SOURCE = 30, {"Cursor": 90}


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Token sums by hour and source of a stream of token events with a timestamp `ts`."""
    sums = [F.sum(c).alias(c) for c in (*C.COUNTERS, "total_tokens")]
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "source").agg(*sums).select(F.col("w.start").alias("start"), "source", *(c for c in (*C.COUNTERS, "total_tokens")))


def velocities(samples: DataFrame, weight: float = 0.65, least_s: float = 1.0) -> DataFrame:
    """(key, at_us, tokens, rate) of a stream of samples (key, day, at_us, tokens); one point of state a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = folds.Velocity(*state.get) if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["at_us", "day", "tokens"]).itertuples(index=False):
            now, rate = folds.velocity(now, row.day, row.at_us / 1e6, int(row.tokens), weight, least_s)
            out.append((key[0], row.at_us, row.tokens, rate))
        if now is not None:
            state.update((now.day, now.at, now.tokens, now.value))
        yield pd.DataFrame(out, columns=["key", "at_us", "tokens", "rate"])

    return samples.groupBy("key").applyInPandasWithState(run, "key string, at_us long, tokens long, rate double", "day string, at double, tokens long, value double", "append", GroupStateTimeout.NoTimeout)


def increments(snapshots: DataFrame) -> DataFrame:
    """What each report of a running total adds; the baseline of each rollout is the state.

    Reports of one batch are taken in time order; one that is late by a batch
    is judged against the newer baseline, as any regression is.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base = folds.Counts(*state.get) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "ord"])
        for row in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
            base, found = folds.counter_step(base, row)
            out += found
        if base is not None:
            state.update(tuple(base))
        yield pd.DataFrame(out, columns=["rollout", "ts", "ord", "input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens"])

    schema = f"rollout string, ts timestamp, ord long, {folds.COUNTED}"
    return snapshots.groupBy("rollout").applyInPandasWithState(run, schema, "a long, b long, c long, d long", "append", GroupStateTimeout.NoTimeout)


def keep_latest(envelopes: DataFrame, path: str, checkpoint: str):
    """A streaming query that keeps each device's highest sequence in versioned tables below a path.

    Version b is made of version b-1 and batch b: a batch that is run again
    after a failure writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("device_id", "sequence", "digest")
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v={number - 1}").select("device_id", "sequence", "digest"))
        devices.latest_wins(rows).write.mode("overwrite").parquet(f"{path}/v={number}")

    return envelopes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={version}")


def active_tools(events: DataFrame, now_us: int) -> DataFrame:
    """(source, last_us, active): whether each tool has shown a sign recently."""
    limit = F.lit(RECENT)
    for source, seconds in RECENT_BY_SOURCE.items():
        limit = F.when(F.col("source") == source, seconds).otherwise(limit)
    last = events.groupBy("source").agg(F.max("us").alias("last_us"))
    return last.withColumn("active", F.lit(now_us) - F.col("last_us") <= limit * 1_000_000)


def activity_state(active: DataFrame, order: list[str]) -> DataFrame:
    """(any_active, first): of active_tools(), whether one is, and the first of those that are by the order of probing."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    on = F.col("active") & (place > 0)
    return active.agg(F.coalesce(F.bool_or(on), F.lit(False)).alias("any_active"), F.min_by(F.when(on, F.col("source")), F.when(on, place)).alias("first"))


def recent_tool_use(lines: DataFrame, since_us: int, text: str = "text") -> DataFrame:
    """(path, active): whether a log has a tool call or its result at or after a time."""
    parts = F.from_json(F.get_json_object(text, "$.message.content"), "array<struct<type: string>>")
    used = F.coalesce(F.exists(parts, lambda c: c["type"].isin("tool_use", "tool_result")), F.lit(False))
    at = C.micros(C.iso_timestamp(F.get_json_object(text, "$.timestamp")))
    return lines.groupBy("path").agg(F.coalesce(F.bool_or(used & (at >= since_us)), F.lit(False)).alias("active"))
