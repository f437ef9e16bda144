"""The tools' logs and databases as token events and activity events.

Each reader gives a dict: `events` (ts, source, model, five counters,
project_path, project_name, session_id, quality, stream_id, agent_kind, cost
or null) and, where the tool has them, further tables.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import PurePosixPath as Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import columns as C
from tallyspark.operators import dedup, folds, pricing
from tallyspark.sources import files, scratch, sqlite

EVENT = ("ts", "source", "model", *C.COUNTERS, "project_path", "project_name", "session_id", "quality", "stream_id", "agent_kind", "cost")


def _events(df: DataFrame, source: str, **cells: Column) -> DataFrame:
    """Rows as events: missing counters are zero, attribution is normalised, rows without tokens go."""
    zero = F.lit(0).cast("long")
    null = F.lit(None).cast("string")
    a = C.attribution(cells.pop("project_path", null), cells.pop("project_name", null), cells.pop("session_id", null), null, cells.pop("quality", F.lit("unknown")))
    given = {c: F.coalesce(cells.pop(c, zero).cast("long"), zero) for c in C.COUNTERS}
    base = {"source": F.lit(source), "model": null, "agent_kind": F.lit("main"), "cost": F.lit(None).cast("double"), "stream_id": F.lit(source)} | given | cells
    out = df.withColumn("_a", a).select(*(c.alias(n) for n, c in base.items()), F.col("_a.project_path"), F.col("_a.project_name"), F.col("_a.session_id"), F.col("_a.quality"))
    return out.select(*EVENT).where(C.total_tokens() > 0)


def _within(df: DataFrame, ts: str, start: datetime, end: datetime) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def request_log(spark: SparkSession, path: str, start: datetime, end: datetime, home: str = "") -> dict[str, DataFrame]:
    """Assistant lines of JSON logs; repeats of a request keep the largest of each counter."""
    schema = "type string, timestamp string, requestId string, sessionId string, session_id string, cwd string, message struct<id: string, model: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>"
    rows = files.decoded(files.lines(spark, path, since=start), schema).where("r.type = 'assistant' AND r.message.usage IS NOT NULL").withColumn("ts", C.iso_timestamp("r.timestamp"))
    rows = _within(rows.where("ts IS NOT NULL"), "ts", start, end)
    folder = F.element_at(F.split("path", "/"), -2)
    key = F.coalesce(C.blank_to_null("r.requestId"), C.blank_to_null("r.message.id"), F.concat_ws("#", "path", F.to_json("line")))
    named = C.blank_to_null("r.cwd").isNotNull()
    rows = rows.select(
        key.alias("request"), "path", "line", "ts", C.model_id("r.message.model").alias("model"), F.col("r.message.usage.input_tokens").alias("input_tokens"), F.col("r.message.usage.output_tokens").alias("output_tokens"),
        F.col("r.message.usage.cache_read_input_tokens").alias("cache_read_tokens"), F.col("r.message.usage.cache_creation_input_tokens").alias("cache_write_tokens"), C.blank_to_null("r.cwd").alias("project_path"),
        F.when(named, C.last_path_part("r.cwd")).otherwise(C.project_from_folder(folder, home)).alias("project_name"), F.coalesce("r.sessionId", "r.session_id", C.session_from_path("path")).alias("session_id"), F.when(named, "exact").otherwise("inferred").alias("quality"),
    )
    order = rows.withColumn("ord", F.xxhash64("path", "line").cast("long"))
    one = dedup.largest_per_request(order, "request", ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"])
    cells = {c: F.col(c) for c in ("ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "project_path", "project_name", "session_id", "quality")}
    timed = rows.withColumn("us", C.micros("ts"))
    best = dedup.best_activity_source(timed, "request", "path").select("request", "path")
    activity = timed.join(best, ["request", "path"]).select(F.col("request").alias("stream_id"), "us", "ts", F.col("model").alias("key"), F.lit("main").alias("agent_kind")).distinct()
    return {"events": _events(one, "Claude Code", stream_id=F.col("request"), **cells), "activity": activity}


def rollout_log(spark: SparkSession, path: str, start: datetime, end: datetime, index: str | None = None) -> dict[str, DataFrame]:
    """Logs of running totals: repeats of a parent's log go, totals become increments, and then the range is taken.

    Which logs are read is settled before one is opened: merged_sessions()
    with an index, else those of the days of the range and of three days
    before and of the archive, where the path has folders by day.
    """
    sessions = scratch.written(merged_sessions(spark, path, index, start, end)) if index is not None else None
    if sessions is not None:
        path, since = sorted(r.rollout for r in sessions.select("rollout").collect()), None
        if not path:
            return {"events": _no_events(spark), "sessions": sessions}
    else:
        path, since = _rollout_folders(spark, path, start, end), start
    counts = "struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint, total_tokens: bigint>"
    schema = f"timestamp string, type string, payload struct<type: string, id: string, forked_from_id: string, source: string, thread_source: string, turn_id: string, model: string, cwd: string, info: struct<total_token_usage: {counts}, last_token_usage: {counts}>>"
    rows = files.decoded(files.lines(spark, path, since=since), schema)
    parent = F.coalesce(C.blank_to_null("r.payload.forked_from_id"), F.get_json_object("text", "$.payload.source.subagent.thread_spawn.parent_thread_id"))
    kind = F.when(F.col("r.type") == "event_msg", F.col("r.payload.type")).otherwise(F.col("r.type"))
    part = lambda group, prefix: [F.coalesce(F.col(f"r.payload.info.{group}.{n}"), F.when(F.col(f"r.payload.info.{group}").isNotNull(), F.lit(0).cast("long"))).alias(f"{prefix}_{c}") for n, c in (("input_tokens", "input"), ("cached_input_tokens", "cached"), ("output_tokens", "output"), ("reasoning_output_tokens", "reasoning"))]
    by_file = Window.partitionBy("path").orderBy("line")
    session = C.blank_to_null("r.payload.id")
    entries = rows.select(
        F.col("path").alias("rollout"), F.row_number().over(by_file).cast("long").alias("ord"), C.iso_timestamp("r.timestamp").alias("ts"), kind.alias("entry"), session.alias("session_id"), parent.alias("parent_id"), F.col("r.payload.thread_source").alias("thread_source"),
        C.blank_to_null("r.payload.turn_id").alias("turn_id"), C.uuid7_key("r.payload.turn_id").alias("turn_key"), C.uuid7_key(F.last(F.when(parent.isNotNull() & (kind == "session_meta"), session), ignorenulls=True).over(by_file)).alias("child_key"),
        F.col("r.payload.info.total_token_usage.total_tokens").alias("t_reported"), *part("total_token_usage", "t"), *part("last_token_usage", "l"),
    )
    counted = folds.counter_events(folds.without_replays(entries, "timestamp"), ts="timestamp")
    counted = _within(counted, "ts", start, end)
    about = files.first_of_file(rows.select("path", "line", C.model_id("r.payload.model").alias("model"), C.blank_to_null("r.payload.cwd").alias("project_path"), F.when(kind == "session_meta", F.get_json_object("text", "$.payload.source")).alias("origin"), session.alias("session_id")), "model", "project_path", "origin", "session_id")
    about = about.withColumnRenamed("path", "rollout").withColumns({"agent_kind": C.agent_kind("origin"), "quality": F.lit("exact")})
    if sessions is not None:
        known = sessions.select("rollout", *(F.col(c).alias(f"_{c}") for c in ("model", "project_path", "agent_kind", "quality")))
        told = {"model": F.coalesce("_model", "model"), "project_path": F.coalesce("_project_path", "project_path"), "agent_kind": F.when(F.col("_agent_kind") == "subagent", "subagent").otherwise(F.col("agent_kind")), "quality": F.col("_quality")}
        about = about.join(known, "rollout", "left").withColumns(told).drop(*(f"_{c}" for c in told))
    joined = counted.join(about, "rollout", "left")
    cells = {c: F.col(c) for c in ("ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens", "project_path", "quality", "agent_kind")}
    events = _events(joined, "Codex", session_id=F.coalesce("session_id", C.session_from_path("rollout")), stream_id=F.col("rollout"), **cells)
    return {"events": events} | ({"sessions": sessions} if sessions is not None else {})


def _no_events(spark: SparkSession) -> DataFrame:
    kinds = {"ts": "timestamp", "cost": "double"} | {c: "long" for c in C.COUNTERS}
    return spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in EVENT))


def _rollout_folders(spark: SparkSession, path: str, start: datetime, end: datetime) -> str | list[str]:
    if Path(path).name in ("sessions", "archived_sessions"):
        return path
    return files.day_folders(spark, path, start.date(), end.date()) or path


def merged_sessions(spark: SparkSession, path: str, index: str, start: datetime, end: datetime) -> DataFrame:
    """(session_id, rollout, model, agent_kind, has_source, project_path, quality): sessions of the index and of logs, each once.

    The index gives the sessions that overlap the range, wherever their logs
    lie; the folders of the days give the logs changed since its start, but
    for those that the index tells all of.  Only what is left is opened, and
    of it the lines that name a session.  An index that can't be read has
    none, a log that is not there goes.
    """
    try:
        known = indexed_sessions(spark, index, start, end)
    except Exception:  # noqa: BLE001  no index, or none that can be read
        known = spark.createDataFrame([], "rollout string, model string, agent_kind string, project_path string, has_source boolean")
    found = files.listed(spark, _rollout_folders(spark, path, start, end), "*.jsonl").where(F.col("changed") >= F.lit(start)).select(F.col("path").alias("rollout"))
    complete = known.where("model IS NOT NULL AND has_source AND project_path IS NOT NULL").select("rollout").distinct()
    logs = found.join(complete, "rollout", "left_anti")
    named = known.select("rollout").distinct().withColumn("indexed", F.lit(True))
    wanted = {r.rollout: bool(r.indexed) for r in logs.join(named, "rollout", "full").collect()}
    paths = sorted(p for p, indexed in wanted.items() if not indexed or files.exists(spark, p))
    if not paths:
        return spark.createDataFrame([], "session_id string, rollout string, model string, agent_kind string, has_source boolean, project_path string, quality string")
    sizes = files.listed(spark, paths).select(F.col("path").alias("rollout"), F.col("bytes").alias("file_size"), F.col("changed").alias("file_time"))
    schema = "type string, payload struct<id: string, model: string, cwd: string>"
    rows = files.decoded(files.lines(spark, paths).where(F.col("text").contains('"session_meta"') | F.col("text").contains('"turn_context"')), schema).where("r.type IN ('session_meta', 'turn_context')")
    meta = F.col("r.type") == "session_meta"
    first = files.first_of_file(
        rows.select("path", "line", F.when(~meta, C.model_id("r.payload.model")).alias("model"), C.blank_to_null("r.payload.cwd").alias("project_path"), F.when(meta, F.get_json_object("text", "$.payload.source")).alias("origin"), F.when(meta, C.blank_to_null("r.payload.id")).alias("session_id")),
        "model", "project_path", "origin", "session_id",
    ).withColumnRenamed("path", "rollout")
    about = sizes.join(first, "rollout", "left")
    named_by = F.coalesce("session_id", "rollout").alias("session_id")
    place = ["rollout", "file_size", "file_time"]
    by_index = known.join(about.select(*place, "session_id"), "rollout").select(named_by, *place, "model", "agent_kind", "has_source", "project_path", F.lit("exact").alias("quality"), F.lit(0).alias("from"))
    quality = F.when(F.col("project_path").isNotNull(), "exact").otherwise("unknown").alias("quality")
    by_log = about.join(logs, "rollout", "left_semi").select(named_by, *place, "model", C.agent_kind("origin").alias("agent_kind"), F.col("origin").isNotNull().alias("has_source"), "project_path", quality, F.lit(1).alias("from"))
    both = by_index.unionByName(by_log)
    ord_ = F.struct("from", "rollout", F.coalesce("model", F.lit("")), F.coalesce("project_path", F.lit("")))
    ranked = both.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy(ord_))).withColumnRenamed("rollout", "rollout_path")
    return dedup.merge_sessions(ranked).withColumnRenamed("rollout_path", "rollout")


def indexed_sessions(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Sessions of the index that overlap the range, once each."""
    t = sqlite.read_table(spark, path, "threads", ["rollout_path", "model", "source", "cwd", "created_at", "updated_at"])
    rows = t.where((F.col("updated_at") >= int(start.timestamp())) & (F.col("created_at") < int(end.timestamp())))
    return rows.where("rollout_path IS NOT NULL").select(files.plain(F.col("rollout_path")).alias("rollout"), C.model_id("model").alias("model"), C.agent_kind("source").alias("agent_kind"), C.blank_to_null("cwd").alias("project_path"), C.blank_to_null("source").isNotNull().alias("has_source")).distinct()


def bubbles(spark: SparkSession, path: str, start: datetime, end: datetime, today: bool = False) -> dict[str, DataFrame]:
    """Messages of a key-value table: newest of each usage id, model from itself or from the last message of the id."""
    kv = sqlite.read_table(spark, path, "cursorDiskKV", ["key", "value"])
    kv = kv.withColumn("value", F.col("value").cast("string"))
    rows = kv.where(C.key_prefix("key", "bubbleId:") & C.json_valid("value"))
    get = lambda p: F.get_json_object("value", p)
    rows = rows.select(
        "key", C.blank_to_null(get("$.bubbleId")).alias("bubble"), F.coalesce(C.blank_to_null(get("$.usageUuid")), C.blank_to_null(get("$.requestId")), C.blank_to_null(get("$.bubbleId"))).alias("usage"), C.iso_timestamp(get("$.createdAt")).alias("ts"),
        F.coalesce(C.json_long("value", "$.tokenCount.inputTokens"), F.lit(0)).alias("input_tokens"), F.coalesce(C.json_long("value", "$.tokenCount.outputTokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(C.cursor_model_id(get("$.modelInfo.modelName")), C.cursor_model_id(get("$.modelName")), C.cursor_model_id(get("$.model"))).alias("model"),
    )
    tokens = _within(rows.where("input_tokens + output_tokens > 0"), "ts", start, end)
    tokens = dedup.backfill_model(tokens, rows.select("usage", "model", "key"), "usage", "key")
    tokens = dedup.newest(tokens, "usage", F.desc("ts"), F.asc("bubble"))
    out = {"events": _events(tokens, "Cursor", ts=F.col("ts"), model=F.col("model"), input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"))}
    if today:
        live = kv.where(C.key_prefix("key", "composerData:") & C.json_valid("value")).select(F.coalesce(C.json_long("value", "$.lastUpdatedAt"), C.json_long("value", "$.createdAt")).alias("ms"), C.json_long("value", "$.contextTokensUsed").alias("value_"), C.cursor_model_id(get("$.modelConfig.modelName"), F.from_json(get("$.usageData"), "map<string, string>")).alias("model"))
        live = live.where((F.col("ms") >= int(start.timestamp() * 1000)) & (F.col("ms") < int(end.timestamp() * 1000)) & (F.col("value_") > 0))
        out["supplemental"] = live.select(F.lit("Context").alias("label"), F.lit("tokens").alias("unit"), F.lit("Cursor").alias("source"), "model", F.lit(False).alias("included"), F.lit("contextOnly").alias("quality"), F.col("value_").alias("value"))
    return out


def json_sessions(spark: SparkSession, path: str, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """Whole documents: messages with their own times, or usage metadata stamped with the file's time."""
    docs = files.documents(spark, path, since=start)
    message = "struct<timestamp: string, type: string, model: string, tokens: struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint, tool: bigint, total: bigint>>"
    current = docs.where(F.get_json_object("text", "$.messages").isNotNull()).select("path", F.explode(F.from_json(F.get_json_object("text", "$.messages"), f"array<{message}>")).alias("m")).where("m.type = 'gemini' AND m.tokens IS NOT NULL")
    t = lambda n: F.coalesce(F.col(f"m.tokens.{n}"), F.lit(0))
    new = current.select("path", C.iso_timestamp("m.timestamp").alias("ts"), C.model_id("m.model").alias("model"), F.greatest(t("input") - t("cached"), F.lit(0)).alias("i"), (t("output") + t("tool")).alias("o"), t("cached").alias("c"), t("thoughts").alias("r"))
    usage = "struct<usageMetadata: struct<promptTokenCount: bigint, candidatesTokenCount: bigint, totalTokenCount: bigint, cachedContentTokenCount: bigint>>"
    old = docs.where(F.get_json_object("text", "$.messages").isNull())
    each = F.coalesce(F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<{usage}>")), F.array(F.from_json("text", usage.removeprefix("struct<").removesuffix(">").replace(": ", " ", 1))))
    u = lambda n: F.coalesce(F.col(f"m.usageMetadata.{n}"), F.lit(0))
    legacy = old.select("path", "modified", F.explode(each).alias("m")).where("m.usageMetadata IS NOT NULL").select("path", F.col("modified").alias("ts"), F.lit(None).cast("string").alias("model"), F.greatest(u("promptTokenCount") - u("cachedContentTokenCount"), F.lit(0)).alias("i"), u("candidatesTokenCount").alias("o"), u("cachedContentTokenCount").alias("c"), F.lit(0).alias("r"))
    rows = _within(new.unionByName(legacy), "ts", start, end)
    return {"events": _events(rows, "Gemini CLI", ts=F.col("ts"), model=F.col("model"), input_tokens=F.col("i"), output_tokens=F.col("o"), cache_read_tokens=F.col("c"), reasoning_tokens=F.col("r"), session_id=C.session_from_path("path"), stream_id=F.col("path"))}


def headed_log(spark: SparkSession, path: str, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """Logs with session headers that hold for the lines after them; the recorded cost counts."""
    usage = "struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, reasoningTokens: bigint, cost: struct<total: double>>"
    schema = f"type string, id string, cwd string, timestamp string, message struct<role: string, toolName: string, model: string, usage: {usage}, details: struct<usage: {usage}>>"
    rows = files.decoded(files.lines(spark, path, since=start), schema).withColumns({"_id": F.when(F.col("r.type") == "session", F.col("r.id")), "_cwd": F.when(F.col("r.type") == "session", F.col("r.cwd"))})
    rows = dedup.forward_fill(dedup.forward_fill(rows, ["path"], "line", "_id", "session_id"), ["path"], "line", "_cwd", "cwd")
    own, tool = F.col("r.message.role") == "assistant", (F.col("r.message.role") == "toolResult") & (F.col("r.message.toolName") == "task")
    used = rows.where((F.col("r.type") == "message") & (own | tool)).withColumn("u", F.when(own, F.col("r.message.usage")).otherwise(F.col("r.message.details.usage"))).where("u IS NOT NULL").withColumn("ts", C.iso_timestamp("r.timestamp"))
    used = _within(used, "ts", start, end)
    n = lambda c: F.greatest(F.coalesce(F.col(f"u.{c}"), F.lit(0)), F.lit(0))
    cells = {"ts": F.col("ts"), "model": C.model_id("r.message.model"), "input_tokens": n("input"), "output_tokens": F.greatest(n("output") - n("reasoningTokens"), F.lit(0)), "cache_read_tokens": n("cacheRead"), "cache_write_tokens": n("cacheWrite"), "reasoning_tokens": n("reasoningTokens")}
    where = {"project_path": F.col("cwd"), "quality": F.lit("exact"), "session_id": F.coalesce("session_id", C.session_from_path("path")), "cost": F.coalesce("u.cost.total", F.lit(0.0)), "agent_kind": F.when(own, "main").otherwise("subagent")}
    return {"events": _events(used, "GJC", stream_id=F.coalesce("session_id", "path"), **cells, **where)}


def aliased_log(spark: SparkSession, path: str, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """Assistant lines whose fields go by either of two names; neither model nor cost."""
    schema = "role string, timestamp string, created_at string, usage struct<input_tokens: bigint, prompt_tokens: bigint, output_tokens: bigint, completion_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>"
    rows = files.decoded(files.lines(spark, path, since=start), schema).where("r.role = 'assistant' AND r.usage IS NOT NULL").withColumn("ts", C.iso_timestamp(F.coalesce("r.timestamp", "r.created_at")))
    rows = _within(rows, "ts", start, end)
    u = lambda *names: F.coalesce(*(F.col(f"r.usage.{n}") for n in names))
    return {"events": _events(rows, "OpenClaw", ts=F.col("ts"), input_tokens=u("input_tokens", "prompt_tokens"), output_tokens=u("output_tokens", "completion_tokens"), cache_read_tokens=u("cache_read_input_tokens"), cache_write_tokens=u("cache_creation_input_tokens"), session_id=C.session_from_path("path"), stream_id=F.col("path"))}


def message_table(spark: SparkSession, path: str, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """Assistant rows of a message table with a JSON column; the range is part of the query that SQLite runs."""
    t = sqlite.read_table(spark, path, "message", ["session_id", "time_created", "data"])
    rows = t.where((F.col("time_created") >= int(start.timestamp() * 1000)) & (F.col("time_created") < int(end.timestamp() * 1000)))
    rows = rows.where((F.get_json_object("data", "$.role") == "assistant") & F.get_json_object("data", "$.tokens").isNotNull())
    n = lambda p: C.json_long("data", f"$.tokens.{p}")
    cells = {"ts": F.timestamp_millis("time_created"), "model": C.model_id(F.get_json_object("data", "$.modelID")), "input_tokens": n("input"), "output_tokens": n("output"), "cache_read_tokens": n("cache.read"), "cache_write_tokens": n("cache.write"), "reasoning_tokens": n("reasoning")}
    return {"events": _events(rows, "OpenCode", session_id=F.col("session_id"), stream_id=F.coalesce("session_id", F.lit("opencode")), **cells)}


HERMES = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_tokens", "cache_write_tokens": "cache_write_tokens", "reasoning_tokens": "reasoning_tokens"}


def session_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sessions with their first and last activity and, if the store has it, usage by model: what the ledger observes."""
    columns = ["id", "started_at", "model", *HERMES, "cwd", "git_repo_root", "estimated_cost_usd", "actual_cost_usd"]
    s = sqlite.read_table(spark, path, "sessions", columns).withColumnRenamed("id", "session_id")
    s = s.withColumns({c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)) for c in HERMES} | {"started_us": (F.col("started_at").try_cast("double") * 1e6).cast("long")})
    if sqlite.has_table(path, "messages"):
        seen = sqlite.read_table(spark, path, "messages", ["session_id", "timestamp"]).groupBy("session_id").agg((F.min("timestamp") * 1e6).cast("long").alias("earliest_us"), (F.max("timestamp") * 1e6).cast("long").alias("latest_us"))
        s = s.join(seen, "session_id", "left")
    else:
        s = s.withColumns({c: F.lit(None).cast("long") for c in ("earliest_us", "latest_us")})
    out = {"sessions": s}
    if sqlite.has_table(path, "session_model_usage"):
        m = sqlite.read_table(spark, path, "session_model_usage", ["session_id", "model", "task", "api_call_count", *HERMES]).withColumns({c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)) for c in HERMES})
        m = m.withColumns({"model": C.model_id("model"), "api_calls": F.coalesce(F.col("api_call_count").try_cast("long"), F.lit(0))})
        out["sessions"] = dedup.resolve_totals(s, m, list(HERMES))
        out["unmetered"] = dedup.unmetered_calls(m, list(HERMES))
    return out


def session_events(spark: SparkSession, path: str, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """session_store(), and as `events` what an observation at the end of the range dates into it.

    A session counts if it began, or its first message came, after the start;
    it is one event at its last message, or where none is known at its
    beginning.  Its cost is the actual one, else the estimated one.
    """
    out = session_store(spark, path)
    s = out["sessions"]
    us = lambda t: F.lit(t).cast("timestamp_ntz")
    null = F.lit(None).cast("long")
    cost = pricing.best_recorded_cost("_actual", "_estimated", "_none")
    s = s.withColumns({"_actual": F.col("actual_cost_usd").try_cast("double"), "_estimated": F.col("estimated_cost_usd").try_cast("double"), "_none": F.lit(None).cast("double")})
    seen = s.where("started_us IS NOT NULL").select(
        F.col("session_id").alias("session"), C.micros(us(end)).alias("observed_us"), C.micros(us(start)).alias("previous_us"), "started_us", "earliest_us", "latest_us", *C.COUNTERS, cost.alias("cost"), *(null.alias(r) for r in pricing.RATES)
    )
    dated = folds.ledger(seen).where("kind = 'event'").withColumn("ts", F.timestamp_micros("at_us").cast("timestamp_ntz"))
    about = s.select(F.col("session_id").alias("session"), C.model_id("model").alias("model"), F.coalesce(C.blank_to_null("git_repo_root"), C.blank_to_null("cwd")).alias("project_path"))
    joined = _within(dated, "ts", start, end).join(about, "session", "left")
    cells = {c: F.col(c) for c in ("ts", "model", "project_path", "cost", *C.COUNTERS)}
    out["events"] = _events(joined, "Hermes", session_id=F.col("session"), stream_id=F.col("session"), quality=F.lit("exact"), **cells)
    return out


#: The readers of local logs in their fixed order.
READERS: dict[str, Callable] = {
    "Claude Code": request_log,
    "Codex": rollout_log,
    "Cursor": bubbles,
    "Gemini CLI": json_sessions,
    "OpenCode": message_table,
    "OpenClaw": aliased_log,
    "GJC": headed_log,
    "Hermes": session_events,
}
#: Tables of readers besides their events that collect_all() brings together.
OTHERS = ("activity", "supplemental", "unmetered")


def is_today(start: datetime, end: datetime, now: datetime) -> bool:
    """Whether the range is exactly the day that it is now: only then do live contexts belong to it."""
    return end - start == timedelta(days=1) and start <= now < end


def _plan(spark: SparkSession, name: str, given: str | dict, start: datetime, end: datetime, now: datetime | None) -> dict[str, DataFrame]:
    """A reader's tables.  given: its path, or a dict of its arguments, as {"path": ..., "index": ...}."""
    args = dict(given) if isinstance(given, dict) else {"path": given}
    if name == "Cursor":
        args.setdefault("today", is_today(start, end, now or datetime.now(start.tzinfo)))
    return READERS[name](spark, start=start, end=end, **args)


def _joined(found: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    tables: dict[str, DataFrame] = {}
    for name, kinds in found.items():
        for kind in ("events", *OTHERS):
            if kind in kinds:
                more = kinds[kind].withColumn("reader", F.lit(name))
                tables[kind] = tables[kind].unionByName(more, allowMissingColumns=True) if kind in tables else more
    return tables


def _said(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0][:200]


def collect_all(spark: SparkSession, paths: dict[str, str | dict], start: datetime, end: datetime, enabled: set[str] | None = None, now: datetime | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, status): lazy unions of the enabled readers' events and OTHERS, each row with its reader, and how each fared.

    A reader that fails when its plan is made, as for a missing file, is a row
    of status, not an error; collect_written() also bears what fails later.
    """
    found: dict[str, dict[str, DataFrame]] = {}
    status = []
    for name in READERS:
        if name not in paths or (enabled is not None and name not in enabled):
            status.append((name, "disabled", None))
            continue
        try:
            found[name] = _plan(spark, name, paths[name], start, end, now)
            status.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001  whatever a reader's files hold
            status.append((name, "failed", _said(e)))
    return _joined(found), spark.createDataFrame(status, "reader string, status string, message string")


#: Status of collect_written().
STATUS = "place int, reader string, status string, message string, events long, total_tokens long, output_tokens long"


def collect_written(
    spark: SparkSession, paths: dict[str, str | dict], start: datetime, end: datetime, enabled: set[str] | None = None, now: datetime | None = None, folder: str | None = None, at_once: int = 4
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, status) as of collect_all(), but read now: a reader that fails while its files are read is a row of status too.

    Each reader's tables are written below a shared folder, several readers
    at a time, and counted while they are written; the union is of what
    succeeded, so it is computed once and its reader's failure is nobody
    else's.  status keeps the readers' order: loaded, empty, failed or
    disabled, with counts of events and tokens that are 0 where a reader gave
    none.  Of a reader that fails nothing is kept.
    """
    folder = folder or scratch.new_folder(spark)

    def read(name: str) -> tuple[str, str | None, tuple[int, int, int], dict[str, DataFrame]]:
        try:
            seen = Observation(f"read {name}")
            kinds = {k: t for k, t in _plan(spark, name, paths[name], start, end, now).items() if k in ("events", *OTHERS)}
            sums = [F.count("*").alias("events"), F.coalesce(F.sum(C.total_tokens()), F.lit(0)).alias("total"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output")]
            kinds["events"] = kinds["events"].observe(seen, *sums)
            out = {k: scratch.written(t, f"{folder}/{name.replace(' ', '_')}/{k}") for k, t in kinds.items()}
            got = seen.get
            counts = (got["events"], got["total"], got["output"])
            any_row = counts[0] or any(t.limit(1).count() for k, t in out.items() if k != "events")
            return ("loaded" if any_row else "empty"), None, counts, out
        except Exception as e:  # noqa: BLE001  whatever a reader's files hold
            return "failed", _said(e), (0, 0, 0), {}

    wanted = [n for n in READERS if n in paths and (enabled is None or n in enabled)]
    with ThreadPoolExecutor(at_once) as pool:
        results = dict(zip(wanted, pool.map(read, wanted), strict=True))
    rows = [(i, n, *(results[n][:2] if n in results else ("disabled", None)), *(results[n][2] if n in results else (0, 0, 0))) for i, n in enumerate(READERS)]
    return _joined({n: r[3] for n, r in results.items()}), spark.createDataFrame(rows, STATUS)


def collect(spark: SparkSession, paths: dict[str, str | dict], start: datetime, end: datetime, enabled: set[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(events, status) of collect_all()."""
    tables, status = collect_all(spark, paths, start, end, enabled)
    return (tables["events"].drop("reader") if "events" in tables else None), status
