"""Reports over priced token events.  Money is exact in nano-dollars until it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import columns as C
from tallyspark.operators import activity
from tallyspark.sources.scratch import written

#: Fixed value: a report of more hours has no buckets.
MOST_BUCKETS = 48
SUMS = (*C.COUNTERS, "total_tokens", "cost_nano")


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]


def totals(events: DataFrame, *keys: str) -> DataFrame:
    """The five counters, their total and the cost, by the keys; one row without keys."""
    out = events.groupBy(*keys).agg(*_sums()) if keys else events.agg(*_sums())
    return out


def timed_totals(events: DataFrame, *keys: str, stream: str = "stream_id") -> DataFrame:
    """The sums by the keys with active_us, in one pass over the events."""
    timed = activity.spans(events, stream)
    return timed.groupBy(*keys).agg(*_sums(), F.coalesce(F.sum("active_us"), F.lit(0)).alias("active_us"))


def model_totals(events: DataFrame) -> DataFrame:
    """(model, tokens, cost, sources, price_known) of events with a model; sources sorted."""
    named = events.where("model IS NOT NULL")
    return named.groupBy("model").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("cost_nano").alias("cost_nano"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("sources"), F.max("price_known").alias("price_known"))


def lightweight(events: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """(source, total_tokens, output_tokens), reading no other column; readers without events have zeros."""
    out = events.groupBy("source").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("output_tokens").alias("output_tokens"))
    if readers is not None:
        out = readers.join(out, "source", "left").fillna(0, ["total_tokens", "output_tokens"])
    return out


def hours(spark: SparkSession, start: str, end: str, most: int = MOST_BUCKETS) -> DataFrame:
    """(start, end) of the hours that the range touches, the last one clipped; none if there are more than `most`."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    spine = spark.range(1).select(F.explode(F.sequence(C.hour_floor(s), e, F.expr("interval 1 hour"))).alias("start")).where(F.col("start") < e)
    spine = spine.select("start", F.least(F.col("start") + F.expr("interval 1 hour"), e).alias("end")).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return spine.where(F.col("_n") <= most).drop("_n")  # at most one row an hour of a range


def hourly_buckets(events: DataFrame, start: str, end: str) -> DataFrame:
    """Every hour of the range with its sums, zeros where nothing happened."""
    inside = events.where(C.in_range("ts", start, end)).groupBy(C.hour_floor("ts").alias("start")).agg(*_sums())
    spine = hours(events.sparkSession, start, end)
    return spine.join(inside, "start", "left").fillna(0, list(SUMS))


def peak(buckets: DataFrame) -> DataFrame:
    """The bucket with the most tokens, the earliest of equals; no row if none has any."""
    top = F.max_by(F.struct("start", "end", "total_tokens"), F.struct("total_tokens", -C.epoch("start")))
    return buckets.where("total_tokens > 0").agg(top.alias("b")).where("b IS NOT NULL").select("b.*")


def hourly_summary(buckets: DataFrame) -> DataFrame:
    """(active_hours, total_tokens, average_tokens, peak_tokens): whole-number average over the active hours."""
    live = F.count(F.when(F.col("total_tokens") > 0, 1))
    total = F.coalesce(F.sum("total_tokens"), F.lit(0))
    out = buckets.agg(live.alias("active_hours"), total.alias("total_tokens"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("peak_tokens"))
    return out.withColumn("average_tokens", F.when(F.col("active_hours") > 0, F.expr("total_tokens div active_hours")).otherwise(F.lit(0).cast("long")))


def top_hours(buckets: DataFrame, n: int = 5) -> DataFrame:
    return buckets.where("total_tokens > 0").orderBy(F.desc("total_tokens"), "start").limit(n)


def daily(events: DataFrame) -> DataFrame:
    """(day, counters, events, active_us): the rollup that whole-day ranges can be answered from."""
    days = events.withColumn("day", C.day_key("ts"))
    timed = activity.spans(days.withColumn("_s", F.concat_ws("|", "stream_id", "day")), "_s")
    return timed.groupBy("day").agg(*_sums(), F.count("*").alias("events"), F.sum("active_us").alias("active_us"))


def daily_range_sum(rollup: DataFrame, first: str, last: str, value: str = "total_tokens") -> DataFrame:
    """Half-open by day, from the rollup alone."""
    return rollup.where((F.col("day") >= first) & (F.col("day") < last)).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def period_totals(events: DataFrame, tomorrow: str) -> DataFrame:
    """(last_7, last_30, all_time): trailing windows that end at tomorrow's midnight, in one pass."""
    end = F.lit(tomorrow).cast("timestamp_ntz")
    since = lambda days: F.coalesce(F.sum(F.when(F.col("ts") >= end - F.expr(f"interval {days} day"), F.col("total_tokens"))), F.lit(0))
    return events.where(F.col("ts") < end).agg(since(7).alias("last_7"), since(30).alias("last_30"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("all_time"))


def compared(events: DataFrame, day: str) -> DataFrame:
    """(current, previous, direction, text): a day's tokens against those of the day before."""
    d = F.lit(day).cast("timestamp_ntz")
    at = lambda n: (F.col("ts") >= d + F.expr(f"interval {n} day")) & (F.col("ts") < d + F.expr(f"interval {n + 1} day"))
    both = events.where(at(0) | at(-1)).agg(*(F.coalesce(F.sum(F.when(at(n), F.col("total_tokens"))), F.lit(0)).alias(name) for n, name in ((0, "current"), (-1, "previous"))))
    return both.withColumn("c", C.comparison("current", "previous")).select("current", "previous", "c.direction", "c.text")


def best_attribution(events: DataFrame) -> DataFrame:
    """(source, session_id, best_path, best_name, best_quality): of a session's attributions the best, the first of equals."""
    rank = F.struct(C.attribution_rank("quality", "project_path", "session_id"), -F.col("event_id"))
    best = F.max_by(F.struct(F.col("project_path").alias("best_path"), F.col("project_name").alias("best_name"), F.col("quality").alias("best_quality")), rank)
    return events.where("session_id IS NOT NULL").groupBy("source", "session_id").agg(best.alias("b")).select("source", "session_id", "b.*")


def attributed(events: DataFrame) -> DataFrame:
    """events under their session's best attribution; `quality` stays their own."""
    best = best_attribution(events)
    out = events.join(best, ["source", "session_id"], "left")
    known = F.col("best_quality").isNotNull()
    return out.withColumns({"project_path": F.when(known, F.col("best_path")).otherwise(F.col("project_path")), "project_name": F.coalesce(F.when(known, F.col("best_name")).otherwise(F.col("project_name")), F.lit(C.UNKNOWN_PROJECT))}).drop("best_path", "best_name", "best_quality")


def quality_name(rank: Column) -> Column:
    return F.when(rank == 3, "exact").when(rank == 2, "inferred").otherwise("unknown")


def _joined(name: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(name)), ";")


def project_stats(events: DataFrame) -> DataFrame:
    """By project: sums, first and last activity, the best quality seen, sources, models and how many sessions."""
    rows = attributed(events.where("total_tokens > 0"))
    key = F.concat_ws("|", "source", C.session_key("session_id", "project_path", "ts"))
    return (
        rows.withColumn("_session", key)
        .groupBy("project_path", "project_name")
        .agg(*_sums(), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max(C.quality_rank("quality")).alias("_q"), _joined("source").alias("sources"), _joined("model").alias("models"), F.countDistinct("_session").alias("sessions"))
        .withColumn("quality", quality_name(F.col("_q")))
        .drop("_q")
    )


def session_stats(events: DataFrame) -> DataFrame:
    """By source and session: sums, span, models, and project and path from the best-ranked event."""
    rows = attributed(events.where("total_tokens > 0")).withColumn("session_key", C.session_key("session_id", "project_path", "ts"))
    meta = F.max_by(F.struct("project_path", "project_name", "session_id"), F.struct(C.metadata_rank("quality", "project_path", "project_name"), -F.col("event_id")))
    out = rows.groupBy("source", "session_key").agg(*_sums(), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max(C.quality_rank("quality")).alias("_q"), _joined("model").alias("models"), meta.alias("m"))
    out = out.select("source", "session_key", *SUMS, "first_at", "last_at", "models", quality_name(F.col("_q")).alias("quality"), "m.*")
    return out.withColumn("label", C.session_label(F.lit(None).cast("string"), "session_id", "first_at"))


def supplemental_stats(values: DataFrame) -> DataFrame:
    """(label, unit, source, included, quality, value): sums above zero."""
    return values.groupBy("label", "unit", "source", "included", "quality").agg(F.sum("value").alias("value")).where("value > 0")


def context_only_models(values: DataFrame) -> DataFrame:
    """(model, source, quality, total_tokens): context sizes, which never enter the totals."""
    return values.where("unit = 'tokens' AND quality = 'contextOnly' AND model IS NOT NULL").groupBy("model", "source", "quality").agg(F.sum("value").alias("total_tokens"))


def event_model_stats(events: DataFrame, clip: int | None = None) -> DataFrame:
    """(model, source, total_tokens, cost_nano, active_us) from events: time is estimated by source, a stream a session."""
    rows = events.where("total_tokens > 0 AND model IS NOT NULL").withColumn("_stream", C.activity_stream("source", "session_id", "project_path", "ts"))
    timed = activity.spans(rows, "_stream", clip=clip)
    return timed.groupBy("source", "model").agg(*(F.sum(c).alias(c) for c in ("total_tokens", "cost_nano", "active_us")))


def model_stats(explicit: DataFrame, events: DataFrame, legacy: DataFrame) -> DataFrame:
    """(id, model, source, total_tokens, cost_nano, active_us): what each source is known to have used of each model.

    Rows a source reports itself come first; rows from events are added for
    models that none of these name; what a total by model holds beyond both is
    a residual under the sources not yet covered.  explicit and events: (model,
    source, the three measures); legacy: (model, sources array, the measures).
    """
    measures = ("total_tokens", "cost_nano", "active_us")
    kinds = ((explicit, "explicit"), (events, "event"), (legacy, "legacy"))
    listed = lambda df, kind: F.col("sources") if kind == "legacy" else F.array("source")
    parts = [df.select("model", F.lit(kind).alias("_kind"), listed(df, kind).alias("_sources"), *measures) for df, kind in kinds]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_source", F.when(F.size("_sources") == 1, F.col("_sources")[0]))
    # a model has a row for each tool and kind: one exchange by model serves all the windows and the sum below
    w = Window.partitionBy("model")
    kind, some = F.col("_kind"), F.greatest(*measures) > 0
    rows = rows.withColumn("_own", F.max((kind == "explicit") & some).over(w))
    rows = rows.withColumn("_known", some & ((kind == "explicit") | (~F.col("_own") & (kind == "legacy") & F.col("_source").isNotNull())))
    rows = rows.withColumns({"_any": F.max("_known").over(w), "_known_sources": F.collect_set(F.when(F.col("_known"), F.col("_source"))).over(w)})
    from_events = some & (kind == "event") & ~F.col("_own") & ~F.array_contains("_known_sources", F.col("_source"))
    rows = rows.withColumn("_base", F.col("_known") | F.coalesce(from_events, F.lit(False)))
    rows = rows.withColumns({f"_c_{m}": F.sum(F.when(F.col("_base"), F.col(m)).otherwise(0)).over(w) for m in measures} | {"_covered": F.collect_set(F.when(F.col("_base"), F.col("_source"))).over(w)})
    missing = F.array_sort(F.array_except("_sources", "_covered"))
    named = F.when(F.size(missing) > 0, F.array_join(missing, "+")).otherwise("fallback")
    left = {m: F.when(F.col("_base"), F.col(m)).otherwise(F.greatest(F.col(m) - F.col(f"_c_{m}"), F.lit(0))) for m in measures}
    kept = rows.where(F.col("_base") | ((kind == "legacy") & ~F.col("_any"))).withColumns(left | {"source": F.when(F.col("_base"), F.col("_source")).otherwise(named)}).where(some)
    out = kept.groupBy("model", "source").agg(*(F.sum(m).alias(m) for m in measures))
    many = F.count("*").over(w) > 1
    return out.withColumn("id", F.when(many, F.concat_ws("|", "model", "source")).otherwise(F.col("model")))


def source_stats(events: DataFrame) -> DataFrame:
    """(source, sums, active_us): active time from each source's own streams."""
    return timed_totals(events.withColumn("_s", F.concat_ws("|", "source", "stream_id")), "source", stream="_s")


ORDERS = {
    "projects": [F.desc, "cost_nano", F.desc, "total_tokens", F.asc, "project_name", F.asc, "project_path"],
    "sessions": [F.desc, "cost_nano", F.desc, "total_tokens", F.desc, "last_at", F.asc, "label", F.asc, "session_key"],
    "models": [F.desc, "active_us", F.desc, "total_tokens", F.desc, "cost_nano", F.asc, "model", F.asc, "source"],
    "sources": [F.desc, "active_us", F.desc, "total_tokens", F.desc, "cost_nano", F.asc, "source"],
    "context": [F.desc, "total_tokens", F.asc, "model", F.asc, "source"],
    "origins": [F.desc, "is_local", F.asc, "lower_name", F.asc, "origin_id"],
    "supplemental": [F.asc, "label_rank", F.asc, "source", F.desc, "value"],
    "events": [F.asc, "ts", F.asc, "source", F.asc, "model", *(x for c in C.COUNTERS for x in (F.asc, c))],
    "ledger": [F.asc, "at_us", F.asc, "session", F.asc, "model"],
    "devices": [F.asc, "lower_name", F.asc, "device_id"],
}
#: Labels of supplemental values in their order; others follow by unit.
LABELS = ("Context", "Sessions", "Reported Cost")


def label_rank(label: str = "label") -> Column:
    rank = F.lit(len(LABELS))
    for i, name in enumerate(LABELS):
        rank = F.when(F.col(label) == name, i).otherwise(rank)
    return rank


def ordered(df: DataFrame, report: str, n: int | None = None) -> DataFrame:
    """A report's rows in its order, the first n if given (a top-k, which no full sort precedes)."""
    spec = ORDERS[report]
    out = df.orderBy(*(f(c) for f, c in zip(spec[::2], spec[1::2], strict=True)))
    return out.limit(n) if n else out


def placed(df: DataFrame, order: str | list[tuple[str, bool]], parts: int | None = None) -> DataFrame:
    """All rows of a report, or by (column, ascending), with `place` from 1.

    Ranges of the order go to parts, which are written; a part's first place
    is the sum of the counts before it, so no task orders more than a part.
    """
    spec = [(c, f is F.asc) for f, c in zip(ORDERS[order][::2], ORDERS[order][1::2], strict=True)] if isinstance(order, str) else order
    by = [F.asc(c) if up else F.desc(c) for c, up in spec]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row a part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return dealt.join(F.broadcast(first), "_part").withColumn("place", (F.col("_first") + inside).cast("long")).drop("_part", "_first")  # at most `parts` rows


def page(df: DataFrame, order: list[tuple[str, bool]], n: int, after: Row | dict | None = None) -> DataFrame:
    """The n rows that follow the key `after` in an order, the first n without one.

    The order must be of columns that are unique together and not null.  A
    page is found by its key, not by skipping rows: each is a top-k behind a
    filter, and none shows a row twice or leaves one out when rows are added.
    """
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for c, up in order:
            behind = behind | same & ((F.col(c) > after[c]) if up else (F.col(c) < after[c]))
            same = same & (F.col(c) == after[c])
        df = df.where(behind)
    return df.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order)).limit(n)


def top_picks(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """(pick, name, cost_nano): the first project with a path, else the first one, and the first session."""
    first = ORDERS["projects"]
    order = [f(c) for f, c in zip(first[::2], first[1::2], strict=True)]
    project = projects.orderBy(F.col("project_path").isNull(), *order).limit(1).select(F.lit("project").alias("pick"), F.col("project_name").alias("name"), "cost_nano")
    return project.unionByName(ordered(sessions, "sessions", 1).select(F.lit("session").alias("pick"), F.col("label").alias("name"), "cost_nano"))


def with_all_sources(sums: DataFrame, names: list[str], shown: bool = True) -> DataFrame:
    """sums by source, and where shown a row of zeros for each name without one."""
    if not shown:
        return sums
    known = sums.sparkSession.createDataFrame([(n,) for n in names], "source string")
    measures = [c for c in sums.columns if c != "source"]
    return known.join(sums, "source", "full").select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in measures))


def by_either_key(a: DataFrame, b: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """The keys of two maps, each with the sums of both."""
    both = a.select(key, *measures).unionByName(b.select(key, *measures))
    return both.groupBy(key).agg(*(F.sum(m).alias(m) for m in measures))
