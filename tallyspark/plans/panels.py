"""Registered queries of labels, orders, settings, validation and discovery, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import columns as C
from tallyspark.operators import audit, cube, devices, export, pricing, reports
from tallyspark.plans.catalogue import _SUMS, END, START, cubed, priced, query, table, token_events
from tallyspark.sources import files
from tallyspark.streaming import live

# Labels and settings

@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN e > 0 THEN e END, CASE WHEN p > 0 THEN p END, 0.0::DOUBLE) AS cost FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice ELSE 0 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS e, l_tax AS p FROM lineitem)")
def recorded_cost(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumns({"a": F.when(n % 3 == 0, F.col("l_extendedprice")).otherwise(0.0), "e": F.when(n % 2 == 0, F.col("l_discount")), "p": F.col("l_tax")})
    return rows.select("l_orderkey", "l_linenumber", pricing.best_recorded_cost("a", "e", "p").alias("cost"))


@query("SELECT o_orderkey, s = date_trunc('day', s) AND e = date_trunc('day', e) AND s < e AS whole FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 2 AS BIGINT)) AS s, date_trunc('day', o_orderdate) + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS e FROM orders)")
def whole_day_ranges(spark, sf_dir):
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (day + F.expr("make_dt_interval(0, o_orderkey % 2)")).alias("s"), (day + F.expr("make_dt_interval(o_orderkey % 3)")).alias("e"))
    return rows.select("o_orderkey", C.whole_days("s", "e").alias("whole"))


@query("SELECT user_id, round(CASE WHEN o > 0 AND s > 0 THEN o * 1.0::DOUBLE / s ELSE 0 END, 6) AS rate FROM (SELECT user_id, sum(output_tokens) AS o, CASE WHEN user_id % 4 = 0 THEN 0 ELSE count(*) * 30 END AS s FROM te GROUP BY 1)", "te")
def output_rates(spark, sf_dir):
    rows = token_events(spark, sf_dir).groupBy("user_id").agg(F.sum("output_tokens").alias("o"), F.count("*").alias("n"))
    return rows.select("user_id", F.round(C.output_rate("o", F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("n") * 30)), 6).alias("rate"))


@query("SELECT user_id, CASE WHEN w > 0 THEN (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 'x' ELSE 'N/A' END AS label FROM (SELECT *, CASE WHEN w > 0 THEN (a * 200 + w) // (2 * w) END AS h FROM (SELECT user_id, count(*) * 8 AS a, user_id % 12 AS w FROM events GROUP BY user_id))")
def parallel_labels(spark, sf_dir):
    """The SQL rounds ties up in whole numbers, as the operator does."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 8).alias("a"))
    return rows.select("user_id", C.parallel_label("a", F.col("user_id") % 12).alias("label"))


@query(
    "SELECT model, regexp_replace(model, '^claude-', '') AS name, CASE WHEN known THEN 'priced' WHEN t > 0 THEN 'unpriced' ELSE '-' END AS price, CASE WHEN len(s) <= 2 THEN array_to_string(s, ', ') ELSE array_to_string(s[1:2], ', ') || ' +' || (len(s) - 2) END AS sources FROM (SELECT model, bool_or(price_known) AS known, sum(total_tokens) AS t, list_sort(list(DISTINCT source)) AS s FROM pe WHERE model IS NOT NULL GROUP BY 1)",
    "te", "pr", "rp", "pe",
)
def model_labels(spark, sf_dir):
    rows = priced(spark, sf_dir).where("model IS NOT NULL").groupBy("model").agg(F.bool_or("price_known").alias("known"), F.sum("total_tokens").alias("t"), F.sum("cost_nano").alias("c"), F.array_sort(F.collect_set("source")).alias("s"))
    price = C.price_label("known", "t", F.col("c") / 1e9)
    return rows.select("model", C.model_name("model").alias("name"), F.when(price.startswith("$"), "priced").otherwise(price).alias("price"), C.some_and_more("s").alias("sources"))


@query("SELECT c_custkey, c_custkey % 6 IN (0, 3) AS text_safe, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 3 THEN repeat('é', 80) END AS name, c_custkey % 6 IN (0, 2) AS id_safe, c_custkey % 6 IN (0, 2) AS credential_safe FROM customer")
def field_checks(spark, sf_dir):
    """Each customer gets a text, an id and a credential of one of six kinds, among them the longest allowed and one more."""
    case = lambda *of: F.element_at(F.array(*of), (F.col("c_custkey") % 6 + 1).cast("int"))
    times = lambda x, n: F.lit(x * n)
    text = case(F.col("c_name"), F.concat(F.lit(" "), "c_name"), F.concat("c_name", F.lit("\u202e")), times("é", 80), times("é", 81), F.lit(""))
    key = case(F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")), F.lit("a.b"), times("a", 80), times("a", 81), F.lit(""), F.lit("é"))
    credential = case(times("x", 32), times("x", 31), times("~", 512), times("~", 513), F.lit("a b" * 20), times("é", 40))
    return table(spark, sf_dir, "customer").select("c_custkey", C.safe_text(text, 80).alias("text_safe"), C.device_name(text).alias("name"), C.device_id(key).alias("id_safe"), C.safe_credential(credential).alias("credential_safe"))


@query("SELECT page_id, v AS form, v IN (0, 1, 2, 8, 9) AS allowed FROM pages, (SELECT unnest(range(12)) AS v)")
def hub_urls(spark, sf_dir):
    """Twelve addresses of each page's host, and of this machine."""
    host = F.regexp_extract("url", "//([^/?#]+)", 1)
    forms = [("https://", ""), ("https://", "/"), ("HTTPS://", ":443/"), ("https://", ":65536"), ("https://", ":"), ("http://", ""), ("https://u:p@", ""), ("https://", "/a")]
    urls = [F.concat(F.lit(a), host, F.lit(b)) for a, b in forms] + [F.lit("http://127.0.0.1:8080"), F.lit("http://[::1]/"), F.concat(F.lit("https://"), host, F.lit("?q=1")), F.concat(F.lit("ftp://"), host)]
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*urls)).alias("form", "u")).select("page_id", F.col("form").cast("long").alias("form"), C.allowed_hub_url("u").alias("allowed"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 5 YEAR BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2001-01-02' AS accepted FROM orders")
def accepted_times(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 5 YEAR")).cast("timestamp_ntz").alias("at"))
    return rows.select("o_orderkey", C.accepted_time("at", F.lit("2001-01-01").cast("timestamp_ntz")).alias("accepted"))


@query("SELECT c_custkey, c_custkey % 5 < 2 AS jwt FROM customer")
def jwt_check(spark, sf_dir):
    """Headers with an algorithm, with a type, with neither, no JSON, and two parts instead of three."""
    head = F.element_at(F.array(*(F.lit(x) for x in ('{"alg":"HS256"}', '{"typ":"JWT"}', '{"x":1}', "no json", '{"alg":"none"}'))), (F.col("c_custkey") % 5 + 1).cast("int"))
    token = F.concat(F.regexp_replace(F.base64(head.cast("binary")), "=+$", ""), F.lit(".eyJzdWIiOiIxIn0"), F.when(F.col("c_custkey") % 5 == 4, "").otherwise(".c2lnbmF0dXJl"))
    return table(spark, sf_dir, "customer").select("c_custkey", audit.is_jwt(token).alias("jwt"))


@query("SELECT source, CASE WHEN c > 0 THEN CAST(CAST(round(a * 1.0::DOUBLE / c * 100) AS BIGINT) AS VARCHAR) || '%' WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE '-' END AS label FROM (SELECT source || '/' || (user_id % 5) AS source, coalesce(sum(CASE WHEN project_path IS NOT NULL THEN cost_nano END), 0) AS a, sum(CASE WHEN user_id % 5 = 0 THEN 0 ELSE cost_nano END) AS c, count(DISTINCT CASE WHEN project_path IS NOT NULL THEN session_id END) AS n FROM pe GROUP BY 1)", "te", "pr", "rp", "pe")
def attributed_labels(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("source", F.concat_ws("/", "source", (F.col("user_id") % 5).cast("string")))
    own = F.col("project_path").isNotNull()
    sums = rows.groupBy("source").agg(F.coalesce(F.sum(F.when(own, F.col("cost_nano"))), F.lit(0)).alias("a"), F.sum(F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.col("cost_nano"))).alias("c"), F.countDistinct(F.when(own, F.col("session_id"))).alias("n"))
    return sums.select("source", C.attributed_label("a", "c", "n").alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s IN (60, 180, 300, 600) THEN s ELSE 180 END AS every, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN FALSE WHEN l_linenumber % 3 = 1 THEN TRUE END, TRUE) AS enabled FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) * 60 AS s FROM lineitem)")
def settings(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.refresh_interval(F.floor("l_quantity").cast("long") * 60).alias("every"), C.enabled(F.when(k == 0, False).when(k == 1, True)).alias("enabled"))


@query("""SELECT c_custkey, nullif(regexp_extract('{"id":1,"name":"' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END || '"}', '"name":"([^"]*)"', 1), '') AS name FROM customer""")
def quoted_values(spark, sf_dir):
    line = F.concat(F.lit('{"id":1,"name":"'), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")), F.lit('"}'))
    return table(spark, sf_dir, "customer").select("c_custkey", C.quoted_value(line, "name").alias("name"))


# Orders: all rows with their places

_PLACED = "row_number() OVER (ORDER BY {0}) AS place FROM {1}"
_MODELS = "(SELECT model, source, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, CAST(max(us) - min(us) AS BIGINT) AS active_us FROM pe WHERE model IS NOT NULL GROUP BY 1, 2)"


def _used(spark, sf_dir, *keys):
    rows = priced(spark, sf_dir).where(F.col(keys[0]).isNotNull()).groupBy(*keys)
    return rows.agg(F.sum("total_tokens").alias("total_tokens"), F.sum("cost_nano").alias("cost_nano"), (F.max("us") - F.min("us")).alias("active_us"))


@query(f"SELECT model, source, active_us, {_PLACED.format('active_us DESC, total_tokens DESC, cost_nano DESC, model, source', _MODELS)}", "te", "pr", "rp", "pe")
def order_models(spark, sf_dir):
    return reports.placed(_used(spark, sf_dir, "model", "source"), "models").select("model", "source", "active_us", "place")


@query(f"SELECT source, {_PLACED.format('active_us DESC, total_tokens DESC, cost_nano DESC, source', _MODELS.replace('model, source,', 'source,').replace('model IS NOT NULL GROUP BY 1, 2', 'source IS NOT NULL GROUP BY 1'))}", "te", "pr", "rp", "pe")
def order_sources(spark, sf_dir):
    return reports.placed(_used(spark, sf_dir, "source"), "sources").select("source", "place")


@query(f"SELECT model, source, total_tokens, {_PLACED.format('total_tokens DESC, model, source', _MODELS)}", "te", "pr", "rp", "pe")
def order_context(spark, sf_dir):
    return reports.placed(_used(spark, sf_dir, "model", "source"), "context").select("model", "source", "total_tokens", "place")


@query(f"SELECT origin_id, {_PLACED.format('is_local DESC, lower_name, origin_id', '(SELECT c_custkey % 40 = 7 AS is_local, lower(c_mktsegment) AS lower_name, CAST(c_custkey AS VARCHAR) AS origin_id FROM customer)')}")
def order_origins(spark, sf_dir):
    """Local origins first, then by name whatever its case, then by id."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40 == 7).alias("is_local"), F.lower("c_mktsegment").alias("lower_name"), F.col("c_custkey").cast("string").alias("origin_id"))
    return reports.placed(rows, "origins").select("origin_id", "place")


@query(f"SELECT label, source, value, {_PLACED.format('r, source, value DESC', '(SELECT *, CASE label WHEN chr(67) || $$ontext$$ THEN 0 WHEN $$Sessions$$ THEN 1 WHEN $$Reported Cost$$ THEN 2 ELSE 3 END AS r FROM (SELECT CASE user_id % 4 WHEN 0 THEN $$Context$$ WHEN 1 THEN $$Sessions$$ WHEN 2 THEN $$Reported Cost$$ ELSE $$Other$$ END AS label, source, CAST(sum(cache_read_tokens) AS BIGINT) AS value FROM te GROUP BY 1, 2))')}", "te")
def order_supplemental(spark, sf_dir):
    k = F.col("user_id") % 4
    rows = token_events(spark, sf_dir).groupBy(F.when(k == 0, "Context").when(k == 1, "Sessions").when(k == 2, "Reported Cost").otherwise("Other").alias("label"), "source").agg(F.sum("cache_read_tokens").alias("value"))
    return reports.placed(rows.withColumn("label_rank", reports.label_rank()), "supplemental").select("label", "source", "value", "place")


@query(f"SELECT us, source, model, input_tokens, {_PLACED.format('us, source, model NULLS FIRST, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens', 'te')}", "te")
def order_events(spark, sf_dir):
    return reports.placed(token_events(spark, sf_dir), "events").select("us", "source", "model", "input_tokens", "place")


@query(f"SELECT at_us, session, model, {_PLACED.format('at_us, session, model NULLS FIRST', '(SELECT us AS at_us, coalesce(session_id, stream_id) AS session, model FROM te)')}", "te")
def order_ledger(spark, sf_dir):
    rows = token_events(spark, sf_dir).select(F.col("us").alias("at_us"), F.coalesce("session_id", "stream_id").alias("session"), "model")
    return reports.placed(rows, "ledger")


@query(f"SELECT device_id, {_PLACED.format('lower_name, device_id', '(SELECT lower(s_name) AS lower_name, CAST(s_suppkey AS VARCHAR) AS device_id FROM supplier)')}")
def order_devices(spark, sf_dir):
    return reports.placed(table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("lower_name"), F.col("s_suppkey").cast("string").alias("device_id")), "devices").select("device_id", "place")


@query(
    "SELECT 'project' AS pick, project_name AS name, cost_nano FROM (SELECT * FROM ps ORDER BY project_path IS NULL, cost_nano DESC, total_tokens DESC, project_name, project_path LIMIT 1) UNION ALL SELECT 'session', label, cost_nano FROM (SELECT * FROM ss ORDER BY cost_nano DESC, total_tokens DESC, last_at DESC, label, session_key LIMIT 1)",
    "te", "pr", "rp", "pe", "ba", "ae", "ak", "ps", "ss",
)
def top_picks(spark, sf_dir):
    return cube.top_picks(cubed(spark, sf_dir))


# Sets, validation, discovery, export

@query("SELECT user_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM te WHERE user_id % 2 = 0 OR user_id % 3 = 0 GROUP BY 1", "te")
def key_union(spark, sf_dir):
    sums = token_events(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 2).alias("part")).agg(F.sum("total_tokens").alias("total_tokens"))
    of = lambda part: sums.where((F.col("part") == part) & ((F.col("user_id") % 2 == 0) | (F.col("user_id") % 3 == 0)))
    return reports.by_either_key(of(0), of(1), "user_id", ["total_tokens"])


@query("SELECT c_custkey, CASE WHEN v <> 1 THEN 'version' WHEN NOT regexp_full_match(d, '[A-Za-z0-9._:-]{1,128}') THEN 'device' WHEN w <= 0 OR w > 367 THEN 'window' WHEN t > 200000 THEN 'events' END AS error FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN c_custkey % 7 = 0 THEN 'bad id!' ELSE 'device-' || c_custkey END AS d, c_custkey % 400 AS w, c_custkey % 300 * 1000 AS t FROM customer)")
def snapshot_validation(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 11 == 0, 2).otherwise(1).alias("version"), F.when(k % 7 == 0, "bad id!").otherwise(F.concat(F.lit("device-"), k.cast("string"))).alias("device_id"), (k % 400).alias("days"), (k % 300 * 1000).alias("token_events"), F.lit(0).alias("activity_events"))
    return devices.snapshot_errors(rows).select("c_custkey", "error")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def reader_scope(spark, sf_dir):
    """Of readers, one in three tells origins apart; those are shown for a remote origin."""
    return devices.statuses(table(spark, sf_dir, "supplier").withColumn("partitioned", F.col("s_suppkey") % 3 == 0), "remote:1").select("s_suppkey")


@query(f"SELECT n.source, {', '.join(f'coalesce({c}, 0) AS {c}' for c in reports.SUMS)} FROM (SELECT unnest(['Claude Code', 'Codex', 'Cursor', 'Gemini CLI', 'OpenCode', 'OpenClaw', 'GJC', 'Hermes']) AS source) n FULL JOIN (SELECT source, {_SUMS} FROM pe GROUP BY 1) s ON n.source = s.source", "te", "pr", "rp", "pe")
def sources_with_empty(spark, sf_dir):
    from tallyspark.sources.readers import READERS

    return reports.with_all_sources(reports.totals(priced(spark, sf_dir), "source"), list(READERS))


@query("SELECT event_id FROM events WHERE event_id % 10 = 0 OR (ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-13')")
def dated_discovery(spark, sf_dir):
    """Files of three days before the range, of the range, and archived ones."""
    day = F.date_format("ts", "/'sessions'/yyyy/MM/dd/")
    paths = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 10 == 0, "/archived_sessions/").otherwise(day), F.lit("x.jsonl")).alias("path"))
    return files.in_days(paths, "2024-01-10", "2024-01-12").select("event_id")


@query("SELECT 'log' || user_id AS path, bool_or(event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-25') AS active FROM events GROUP BY 1")
def recent_tool_use(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "tool_use").otherwise("text")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("log"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit('{"timestamp":"'), at, F.lit('","message":{"content":[{"type":"text"},{"type":"'), kind, F.lit('"}]}}')).alias("text"))
    return live.recent_tool_use(lines, 1706140800 * 1_000_000)


_JSON = lambda *names, **given: "json_object(" + ", ".join(f"'{n}', {given.get(n, n)}" for n in sorted({*names, *given})) + ")"
_SPAN = {c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')" for c in ("first_at", "last_at")}


@query(
    f"""SELECT CAST(json_object('date', '{START}', 'endDate', '{END}', 'models', (SELECT to_json(list({_JSON("model", "total_tokens", "cost_nano")} ORDER BY total_tokens DESC, model)) FROM (SELECT model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM pe WHERE model IS NOT NULL GROUP BY 1)),
    'projects', (SELECT to_json(list({_JSON(*reports.SUMS, "models", "project_name", "project_path", "quality", "sources", "sessions", **_SPAN)} ORDER BY total_tokens DESC, project_name, coalesce(project_path, ''))) FROM ps),
    'sessions', (SELECT to_json(list({_JSON(*reports.SUMS, "models", "project_name", "project_path", "quality", "source", "session_id", "session_key", **_SPAN)} ORDER BY total_tokens DESC, source, session_key)) FROM ss),
    'sources', (SELECT to_json(list({_JSON("source", *reports.SUMS)} ORDER BY total_tokens DESC, source)) FROM (SELECT source, {_SUMS} FROM pe GROUP BY 1)), 'startDate', '{START}', 'totals', (SELECT {_JSON(*reports.SUMS)} FROM (SELECT {_SUMS} FROM pe))) AS VARCHAR) AS json""",
    "te", "pr", "rp", "pe", "ba", "ae", "ak", "ps", "ss",
)
def json_export(spark, sf_dir):
    return export.as_document(cubed(spark, sf_dir), START, START, END)


@query("SELECT section, count(*) AS objects, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM (SELECT 'total' AS section, sum(total_tokens) AS total_tokens FROM pe UNION ALL SELECT 'source', sum(total_tokens) FROM pe GROUP BY source UNION ALL SELECT 'model', sum(total_tokens) FROM pe WHERE model IS NOT NULL GROUP BY model UNION ALL SELECT 'project', total_tokens FROM ps UNION ALL SELECT 'session', total_tokens FROM ss) GROUP BY 1", "te", "pr", "rp", "pe", "ba", "ae", "ak", "ps", "ss")
def json_lines(spark, sf_dir):
    """An export of any size: an object a row.  Read back, they hold what the sections add up to."""
    rows = export.as_json(export.sections(cubed(spark, sf_dir), START, END))
    return rows.groupBy("section").agg(F.count("*").alias("objects"), F.sum(F.get_json_object("json", "$.total_tokens").cast("long")).alias("total_tokens"))
