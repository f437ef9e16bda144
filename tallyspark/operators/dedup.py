"""Duplicate reports of one request, and merges of one session's descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import columns as C


def largest_per_request(rows: DataFrame, key: str, counters: list[str], ts: str = "ts", order: str = "ord") -> DataFrame:
    """One row a request: the largest of each counter and of the time, the first model that is not null, the best attribution.

    Filter by time before: the range decides which reports take part.
    """
    model = F.min_by("model", F.when(F.col("model").isNotNull(), F.col(order)))
    rank = F.struct(C.attribution_rank("quality", "project_path", "session_id"), -F.col(order))
    best = F.max_by(F.struct("project_path", "project_name", "session_id", "quality"), rank)
    return rows.groupBy(key).agg(*(F.max(c).alias(c) for c in counters), F.max(ts).alias(ts), model.alias("model"), best.alias("a")).select(key, *counters, ts, "model", "a.*")


def best_activity_source(rows: DataFrame, key: str, source: str, ts: str = "us") -> DataFrame:
    """(key, source, points, span): of the files that tell of a request the one with the most times, the longest span, the earliest begin."""
    each = rows.groupBy(key, source).agg(F.countDistinct(ts).alias("points"), (F.max(ts) - F.min(ts)).alias("span"), F.min(ts).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("points"), F.desc("span"), "first", source)
    return each.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(rows: DataFrame, key: str, *order: F.Column) -> DataFrame:
    """The first row of each key in an order.  Only a key and its best row meet in the aggregation."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def backfill_model(tokens: DataFrame, models: DataFrame, key: str, order: str) -> DataFrame:
    """tokens with a missing model taken from the last row of the same id that has one."""
    last = models.where("model IS NOT NULL").groupBy(key).agg(F.max_by("model", order).alias("_model"))
    return tokens.join(last, key, "left").withColumn("model", F.coalesce("model", "_model")).drop("_model")


def merge_sessions(sessions: DataFrame) -> DataFrame:
    """One row a session of descriptions from several places, in their order.

    The first model that is not null, subagent and a known source if any says
    so, the path of the largest file (newer, then earlier listed, among equals),
    and the project of the best quality, the first among equals.
    """
    named = F.col("project_path").isNotNull()
    rank = C.quality_rank("quality")
    model = F.min_by("model", F.when(F.col("model").isNotNull(), F.col("ord")))
    return (
        sessions.groupBy("session_id")
        .agg(
            model.alias("model"),
            F.when(F.bool_or(F.col("agent_kind") == "subagent"), "subagent").otherwise("main").alias("agent_kind"),
            F.bool_or("has_source").alias("has_source"),
            F.max_by("rollout_path", F.struct("file_size", "file_time", -F.col("ord"))).alias("rollout_path"),
            F.max_by(F.struct("project_path", "quality"), F.when(named, F.struct(rank, -F.col("ord")))).alias("p"),
        )
        .select("session_id", "model", "agent_kind", "has_source", "rollout_path", "p.project_path", F.coalesce("p.quality", F.lit("unknown")).alias("quality"))
    )


def resolve_totals(sessions: DataFrame, by_model: DataFrame, counters: list[str]) -> DataFrame:
    """sessions with each counter the larger of its own and its models' sum, and the model if there is only one."""
    summed = by_model.groupBy("session_id").agg(*(F.sum(c).alias(f"_{c}") for c in counters), F.collect_set("model").alias("_models"))
    out = sessions.join(summed, "session_id", "left")
    only = F.when(F.size("_models") == 1, F.col("_models")[0]).when(F.size("_models") > 1, F.lit(None).cast("string")).otherwise(F.col("model"))
    larger = {c: F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))) for c in counters}
    return out.withColumns(larger | {"model": only}).drop("_models", *(f"_{c}" for c in counters))


def unmetered_calls(by_model: DataFrame, counters: list[str]) -> DataFrame:
    """(session_id, calls): calls of the main task whose counters are all zero."""
    empty = (C.blank_to_null("task").isNull()) & (C.total_tokens(*counters) == 0)
    return by_model.groupBy("session_id").agg(F.coalesce(F.sum(F.when(empty, F.col("api_calls"))), F.lit(0)).alias("calls"))


def forward_fill(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last value that is not null, up to and with the row itself."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
