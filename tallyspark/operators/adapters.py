"""Canonical facts from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import columns as C

#: Fixed values of the stand-in facts.
SOURCES = ("Claude Code", "Codex", "Cursor", "OpenCode")
MODELS = ("claude-sonnet-4-6", "gpt-5.4-mini-2026-01-01", "gpt-5.4", "gpt-5-unknown", "mystery", None)


def _pick(index: F.Column, values: tuple) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def token_events(events: DataFrame) -> DataFrame:
    """events as token events: who, when, which model, five disjoint counters and an attribution."""
    k = F.get_json_object("props", "$.k").cast("long")
    user, event = F.col("user_id"), F.col("event_id")
    path = F.when(user % 3 != 0, F.concat(F.lit("/p/"), (user % 7).cast("string")))
    session = F.when(event % 5 != 0, F.concat(F.lit("s"), user.cast("string"), F.lit("-"), (event % 3).cast("string")))
    out = events.select(
        "event_id", "ts", "user_id", _pick(user % 4, SOURCES).alias("source"), _pick(event % 6, MODELS).alias("model"), F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), k.alias("output_tokens"),
        (event % 50).alias("cache_read_tokens"), F.when(F.col("event_type") == "purchase", k).otherwise(F.lit(0).cast("long")).alias("cache_write_tokens"), (k % 7).alias("reasoning_tokens"),
        C.attribution(path, F.lit(None).cast("string"), session, F.lit(None).cast("string"), _pick(event % 3, ("exact", "inferred", "unknown"))).alias("a"),
        F.when(F.col("event_type") == "error", "subagent").otherwise("main").alias("agent_kind"), user.cast("string").alias("stream_id"), C.micros("ts").alias("us"),
    )
    return out.select("*", "a.*").drop("a", "session_label").withColumn("total_tokens", C.total_tokens())


def activity_events(events: DataFrame) -> DataFrame:
    return token_events(events).select("event_id", "stream_id", "ts", "us", F.col("model").alias("key"), "agent_kind", "source")
