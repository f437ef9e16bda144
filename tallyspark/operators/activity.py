"""Working time from point events: slices, islands, wall clock and concurrency, all in whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import written

SECOND = 1_000_000
#: What an event without a near successor counts for, and the longest gap that counts whole.
TAIL, GAP = 30 * SECOND, 300 * SECOND
#: All streams together are looked at in narrow cells of this length, so many of which make a wide one.
NARROW, WIDE = 10 * SECOND, 1_024


def spans(events: DataFrame, stream: str = "stream_id", ts: str = "us", order: str = "event_id", clip: int | None = None, tail: int = TAIL, gap: int = GAP) -> DataFrame:
    """All events with start_us, end_us and active_us: up to the stream's next event if that is near, else the tail.

    Of events at the same time only the last counts; nothing counts at or
    after clip, and no span goes beyond it.  A stream's spans never overlap,
    so active_us adds up over its events to their merged time: sums by any key
    need no second pass.
    """
    w = Window.partitionBy(stream).orderBy(ts, order)
    ahead = F.lead(ts).over(w) - F.col(ts)
    length = F.when(ahead.isNull() | (ahead > gap), F.lit(tail)).otherwise(ahead)
    end = F.col(ts) + length
    if clip is not None:
        end = F.when(F.col(ts) >= clip, F.col(ts)).otherwise(F.least(end, F.lit(clip)))
    return events.withColumns({"start_us": F.col(ts), "end_us": end}).withColumn("active_us", F.col("end_us") - F.col("start_us"))


def slices(events: DataFrame, stream: str = "stream_id", ts: str = "us", order: str = "event_id", clip: int | None = None, tail: int = TAIL, gap: int = GAP) -> DataFrame:
    """events with start_us and end_us, without those that take no time."""
    return spans(events, stream, ts, order, clip, tail, gap).where("end_us > start_us").drop("active_us")


def islands(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, start_us, end_us): the union of each key's intervals; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(*keys, "start_us", "end_us", reach.alias("_reach"))
    begun = F.sum(F.when(F.col("_reach").isNull() | (F.col("start_us") > F.col("_reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", begun).groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def active_time(intervals: DataFrame, *keys: str, stream: str = "stream_id") -> DataFrame:
    """(keys, active_us): merged time of each stream, added up by key; keys may be empty."""
    merged = islands(intervals, *keys, stream)
    return merged.groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("active_us"))


def busy(intervals: DataFrame, narrow: int = NARROW, wide: int = WIDE) -> DataFrame:
    """(wall_us, max_streams): how long any of the intervals holds, and how many at most at once; an end comes before a start at the same time.

    Begins and ends are added up by microsecond, those by narrow cell, and
    those by wide cell: running sums over wide cells, of narrow ones inside a
    wide one and of microseconds inside a narrow one then meet.  No interval
    is cut, and no task orders more than a narrow cell's distinct times, the
    narrow cells of a wide one, or the wide cells of the whole range.
    """
    edge = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d"))))
    at = intervals.where("end_us > start_us").select(edge.alias("e")).groupBy("e.t").agg(F.sum("e.d").alias("d"))
    at = written(at.select("t", "d", F.floor(F.col("t") / narrow).alias("small"), F.floor(F.col("t") / (narrow * wide)).alias("large")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    small = at.groupBy("large", "small").agg(F.sum("d").alias("d"), F.min("t").alias("first"))
    large = small.groupBy("large").agg(F.sum("d").alias("d"), F.min("first").alias("first"))
    over = Window.orderBy("large")  # a row a wide cell
    large = large.select("large", total("d", over).alias("base"), F.lead("first").over(over).alias("later"))
    inside = Window.partitionBy("large").orderBy("small")
    small = small.join(large, "large").select("small", (F.col("base") + total("d", inside)).alias("base"), F.coalesce(F.lead("first").over(inside), F.col("later")).alias("later"))
    each = Window.partitionBy("small").orderBy("t")
    n = F.col("base") + F.sum("d").over(each.rowsBetween(Window.unboundedPreceding, 0))
    told = at.select("small", "t", "d").join(small, "small").select(n.alias("n"), (F.coalesce(F.lead("t").over(each), F.col("later")) - F.col("t")).alias("length"))
    return told.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("length"))), F.lit(0)).alias("wall_us"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_streams"))


def wall_clock(intervals: DataFrame) -> DataFrame:
    """(wall_us): the time in which any stream is active."""
    return busy(intervals).select("wall_us")


def max_concurrency(merged: DataFrame) -> DataFrame:
    """(max_streams): the most streams active at once, of per-stream islands."""
    return busy(merged).select("max_streams")


def work_time(events: DataFrame, stream: str = "stream_id", ts: str = "us", order: str = "event_id", kind: str = "agent_kind", clip: int | None = None) -> DataFrame:
    """One row: total, main, subagent and wall-clock microseconds, active streams and most at once."""
    cut = slices(events, stream, ts, order, clip)
    merged = islands(cut, kind, stream)
    length = F.col("end_us") - F.col("start_us")
    part = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, length)), F.lit(0)).alias(f"{k}_us")
    totals = merged.agg(F.coalesce(F.sum(length), F.lit(0)).alias("total_us"), part("main"), part("subagent"), F.countDistinct(stream).alias("streams"))
    return totals.crossJoin(busy(islands(merged, stream)))  # two rows of one


def with_fallback(measured: DataFrame, fallback: DataFrame) -> DataFrame:
    """Work time of sources with events, and added to it that of sources which only report seconds.

    Those add to every duration and to the streams, one each, but not to the
    concurrency, which only observed overlap shows.  fallback: (source, active_us).
    """
    extra = fallback.where("active_us > 0").agg(F.coalesce(F.sum("active_us"), F.lit(0)).alias("_us"), F.count("*").alias("_n"))
    both = measured.crossJoin(extra)
    most = F.when((F.col("max_streams") == 0) & (F.col("_n") > 0), 1).otherwise(F.col("max_streams"))
    changed = {c: F.col(c) + F.col("_us") for c in ("total_us", "main_us", "wall_us")} | {"streams": F.col("streams") + F.col("_n"), "max_streams": most.cast("long")}
    return both.withColumns(changed).drop("_us", "_n")
