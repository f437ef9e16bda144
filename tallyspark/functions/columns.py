"""Scalar column functions: parsing, normalisation, ranks, labels and formats."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of attribution quality and of audit severity, and models that stand for none.
QUALITY_RANK = {"exact": 3, "inferred": 2, "unknown": 1}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
NO_MODEL = ("<synthetic>",)
NO_CURSOR_MODEL = ("default", "composer-1")
UNKNOWN_PROJECT = "Unknown Project"
#: Tokens a second and the frame interval from there on; linear between, level outside.
FRAME_BANDS = ((0.0, 0.09), (20.0, 0.055), (40.0, 0.035), (60.0, 0.023), (80.0, 0.016))
COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
LONG_MAX = 2**63 - 1
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
_UUID7 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_range(ts: Column | str, start: str, end: str) -> Column:
    """Half-open: start <= ts < end."""
    return (_c(ts) >= F.lit(start).cast("timestamp_ntz")) & (_c(ts) < F.lit(end).cast("timestamp_ntz"))


def iso_timestamp(c: Column | str) -> Column:
    """A date, a time and a zone, with or without a fraction; anything else is null."""
    return F.when(_c(c).rlike(_ISO), F.try_to_timestamp(_c(c)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(_c(c), r"^\s+|\s+$", ""), F.lit(""))


def model_id(c: Column | str) -> Column:
    x = blank_to_null(c)
    return F.when(~x.isin(*NO_MODEL), x)


def cursor_model_id(c: Column | str, usage: Column | None = None) -> Column:
    """As model_id, without the tool's own names; the one key of a usage map stands in for a missing model."""
    x = model_id(c)
    x = F.when(~x.isin(*NO_CURSOR_MODEL), x)
    if usage is None:
        return x
    only = model_id(F.when(F.size(usage) == 1, F.map_keys(usage)[0]))
    return F.coalesce(x, F.when(~only.isin(*NO_CURSOR_MODEL), only))


def last_path_part(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"([^/]+)/*$", 1), F.lit(""))


def session_from_path(c: Column | str) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(last_path_part(c), r"(.)\.[^.]*$", "$1")


def project_from_folder(folder: Column | str, home: str) -> Column:
    """The project of a folder that names a path by hyphens: the encoded home goes, and hyphens before the rest."""
    coded = "-".join(home.split("/"))
    return F.nullif(F.regexp_replace(F.regexp_replace(_c(folder), f"^\\Q{coded}\\E", ""), "^-+", ""), F.lit(""))


def attribution(path: Column | str, name: Column | str, session: Column | str, label: Column | str, quality: Column | str) -> Column:
    """Blanks are null, the name falls back to the path's last part, and without a name the quality is unknown."""
    p = blank_to_null(path)
    n = F.coalesce(blank_to_null(name), last_path_part(p))
    q = F.when(n.isNull(), F.lit("unknown")).otherwise(_c(quality))
    return F.struct(p.alias("project_path"), n.alias("project_name"), blank_to_null(session).alias("session_id"), blank_to_null(label).alias("session_label"), q.alias("quality"))


def quality_rank(c: Column | str) -> Column:
    return reduce(lambda e, kv: e.when(_c(c) == kv[0], kv[1]), list(QUALITY_RANK.items())[1:], F.when(_c(c) == "exact", 3)).otherwise(1)


def attribution_rank(quality: Column | str, path: Column | str, session: Column | str) -> Column:
    return quality_rank(quality) * 100 + F.when(_c(path).isNotNull(), 20).otherwise(0) + F.when(_c(session).isNotNull(), 1).otherwise(0)


def metadata_rank(quality: Column | str, path: Column | str, name: Column | str) -> Column:
    return quality_rank(quality) * 100 + F.when(_c(path).isNotNull(), 10).otherwise(0) + F.when(_c(name).isNotNull(), 1).otherwise(0)


def severity_rank(c: Column | str) -> Column:
    return F.when(_c(c) == "high", 0).when(_c(c) == "medium", 1).otherwise(2)


def total_tokens(*counters: Column | str) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(_c(x), F.lit(0)) for x in counters or COUNTERS))


def hour_floor(ts: Column | str) -> Column:
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def day_key(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def hour_label(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "HH:mm")


def epoch(ts: Column | str) -> Column:
    """Whole seconds; naive times count as UTC."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def session_key(session: Column | str, project: Column | str, ts: Column | str) -> Column:
    return F.coalesce(_c(session), F.concat_ws("|", F.coalesce(_c(project), F.lit(UNKNOWN_PROJECT)), epoch(hour_floor(ts)).cast("string")))


def session_label(label: Column | str, session: Column | str, ts: Column | str) -> Column:
    base = last_path_part(session)
    return F.coalesce(blank_to_null(label), F.substring(base, 1, 10), F.concat(hour_label(ts), F.lit(" session")))


def activity_stream(source: Column | str, session: Column | str, project: Column | str, ts: Column | str) -> Column:
    own = F.concat_ws("|", _c(source), _c(session))
    return F.when(_c(session).isNotNull(), own).otherwise(F.concat_ws("|", _c(source), F.coalesce(_c(project), F.lit(UNKNOWN_PROJECT)), epoch(hour_floor(ts)).cast("string")))


def agent_kind(source_json: Column | str) -> Column:
    """subagent if the field is that string or an object with such a key."""
    c = _c(source_json)
    return F.when(c.isin("subagent", '"subagent"') | F.get_json_object(c, "$.subagent").isNotNull(), "subagent").otherwise("main")


def uuid7_key(c: Column | str) -> Column:
    """The twelve hex digits of the time of a version 7 UUID, which order such ids; null for others."""
    return F.when(_c(c).rlike(_UUID7), F.substring(F.lower(F.replace(_c(c), F.lit("-"), F.lit(""))), 1, 12))


def saturating(total: Column) -> Column:
    """A decimal sum held within the range of a long."""
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def sha256(c: Column | str) -> Column:
    return F.sha2(_c(c).cast("binary"), 256)


def opaque_id(key: bytes, c: Column | str) -> Column:
    """The first 16 bytes of HMAC-SHA-256, in hex; Spark has no such function of its own."""
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:32])

    return run(_c(c))


#: The longest hub URL and host in bytes, the hosts that may go without TLS, the first second of accepted
#: times since 1970, and how many seconds one may lie ahead of the clock.
URL_BYTES, HOST_BYTES, OPEN_HOSTS = 2048, 253, ("localhost", "127.0.0.1", "[::1]")
EARLIEST_S, AHEAD_S = 946_684_800, 86_400


def safe_text(c: Column | str, longest: int = 256) -> Column:
    """Neither empty nor longer, no blanks at the ends, no control, format, direction-changing or unassigned characters.

    Length counts code points, of which eight bytes each are allowed.  Null stays null.
    """
    c = _c(c)
    return (F.length(c) > 0) & (F.length(c) <= longest) & (F.octet_length(c) <= 8 * longest) & ~c.rlike(r"^\p{Z}|\p{Z}$|[\p{Cc}\p{Cf}\p{Cn}]")


def device_name(c: Column | str) -> Column:
    """The name without blanks and line ends around it, or null where what is left is no safe text of 80."""
    name = F.regexp_replace(_c(c), r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")
    return F.when(safe_text(name, 80), name)


def device_id(c: Column | str) -> Column:
    return _c(c).rlike(r"\A[A-Za-z0-9_-]{1,80}\z")


def safe_credential(c: Column | str) -> Column:
    """From 32 to 512 visible ASCII characters."""
    return _c(c).rlike(r"\A[\x21-\x7E]{32,512}\z")


def allowed_hub_url(c: Column | str) -> Column:
    """An https address without user, path, query or fragment, or an http one of this machine; ports from 1 to 65535."""
    form = r"(?i)\A(https?)://([A-Za-z0-9._~!$&'()*+,;=%-]+|\[[0-9A-F:.]+\])(?::([0-9]+))?/?\z"
    scheme, host, port = (F.regexp_extract(_c(c), form, i) for i in (1, 2, 3))
    in_range = (port == "") | F.coalesce(port.try_cast("long").between(1, 65535), F.lit(False))
    reachable = (F.lower(scheme) == "https") | F.lower(host).isin(*OPEN_HOSTS)
    return (F.octet_length(_c(c)) <= URL_BYTES) & (host != "") & (F.octet_length(host) <= HOST_BYTES) & in_range & reachable


def accepted_time(c: Column | str, now: Column) -> Column:
    """Not before the year 2000, and not more than a day ahead of the clock."""
    at = micros(c)
    return at.between(EARLIEST_S * 1_000_000, micros(now) + AHEAD_S * 1_000_000)


def safe_id(c: Column | str, longest: int = 128) -> Column:
    return _c(c).rlike(rf"^[A-Za-z0-9._:-]{{1,{longest}}}$")


def key_prefix(c: Column | str, prefix: str) -> Column:
    """Parquet readers prune by this as they would by the range up to the next prefix."""
    return _c(c).startswith(prefix)


def cache_efficiency(cache_read: Column | str, inputs: Column | str) -> Column:
    total = _c(inputs) + _c(cache_read)
    return F.when(total > 0, _c(cache_read) * F.lit(100.0) / total).otherwise(F.lit(0.0))


def output_rate(output: Column | str, seconds: Column | str) -> Column:
    return F.when((_c(seconds) > 0) & (_c(output) > 0), _c(output) / _c(seconds)).otherwise(F.lit(0.0))


def parallel_multiplier(agent: Column | str, wall: Column | str) -> Column:
    return F.when(_c(wall) > 0, _c(agent) / _c(wall)).otherwise(F.lit(0.0))


def parallel_label(agent: Column | str, wall: Column | str) -> Column:
    return F.when(_c(wall) > 0, F.format_string("%.2fx", parallel_multiplier(agent, wall))).otherwise("N/A")


def comparison(current: Column | str, previous: Column | str) -> Column:
    """Against the day before, as (direction, text): null if that is unknown."""
    now, then = _c(current), _c(previous)
    share = F.concat(F.floor(F.abs(F.try_divide((now - then) * F.lit(100.0), then))).cast("string"), F.lit("% from yesterday"))
    direction = F.when(now == then, "flat").when(then == 0, F.lit(None).cast("string")).when(now > then, "up").otherwise("down")
    text = F.when(now == then, "0% from yesterday").when(then == 0, "No usage yesterday").otherwise(share)
    return F.when(then.isNotNull(), F.struct(direction.alias("direction"), text.alias("text")))


def frame_interval(rate: Column | str) -> Column:
    r = _c(rate)
    e = F.when(r <= FRAME_BANDS[0][0], F.lit(FRAME_BANDS[0][1]))
    for (x0, y0), (x1, y1) in zip(FRAME_BANDS, FRAME_BANDS[1:], strict=False):
        e = e.when(r <= x1, F.lit(y0) + (r - x0) * ((y1 - y0) / (x1 - x0)))
    return e.otherwise(F.lit(FRAME_BANDS[-1][1]))


def _short(v: Column) -> Column:
    """One decimal from 10 on, else two; zeros beyond the first decimal go."""
    return F.when(v >= 10, F.format_string("%.1f", F.round(v, 1))).otherwise(F.regexp_replace(F.format_string("%.2f", F.round(v, 2)), "0$", ""))


def format_tokens(c: Column | str) -> Column:
    """999, 1.0K, 1.23M, 3.56B; what would round to 1000 of a unit goes to the next."""
    v = _c(c).cast("double")
    return (
        F.when(v < 1000, _c(c).cast("string"))
        .when(v < 999_950, F.concat(_short(v / 1e3), F.lit("K")))
        .when(v < 999_950_000, F.concat(_short(v / 1e6), F.lit("M")))
        .otherwise(F.concat(_short(v / 1e9), F.lit("B")))
    )


def format_cost(c: Column | str) -> Column:
    v = _c(c).cast("double")
    return (
        F.when(v >= 1000, F.format_string("$%.1fK", v / 1000))
        .when(v >= 100, F.format_string("$%.0f", v))
        .when(v >= 10, F.format_string("$%.1f", v))
        .otherwise(F.format_string("$%.2f", v))
    )


def format_rate(c: Column | str) -> Column:
    v = _c(c).cast("double")
    tenth = F.round(v, 1)
    known = (v > 0) & ~F.isnan(v) & (v < float("inf"))
    return F.when(known, F.when(tenth >= 10, F.format_string("%.0f token/s", F.round(v))).otherwise(F.format_string("%.1f token/s", tenth))).otherwise("0 token/s")


def format_duration(seconds: Column | str) -> Column:
    s = F.round(_c(seconds)).cast("long")
    minutes = F.floor(s / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    whole = F.when(rest == 0, F.format_string("%dh", hours)).otherwise(F.format_string("%dh %dm", hours, rest))
    return F.when(s <= 0, "0m").when(s < 60, F.format_string("%ds", s)).when(minutes < 60, F.format_string("%dm", minutes)).otherwise(whole)


def model_name(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "^claude-", "")


def price_label(known: Column | str, tokens: Column | str, cost: Column | str) -> Column:
    return F.when(_c(known) & (_c(cost) >= 0), format_cost(cost)).when(~_c(known) & (_c(tokens) > 0), "unpriced").otherwise("-")


def some_and_more(names: Column | str, shown: int = 2) -> Column:
    """The first names, and how many more there are."""
    n = _c(names)
    return F.when(F.size(n) <= shown, F.array_join(n, ", ")).otherwise(F.concat(F.array_join(F.slice(n, 1, shown), ", "), F.lit(" +"), (F.size(n) - shown).cast("string")))


def attributed_label(attributed: Column | str, cost: Column | str, sessions: Column | str) -> Column:
    share = F.concat(F.round(_c(attributed) / _c(cost) * 100).cast("long").cast("string"), F.lit("%"))
    return F.when(_c(cost) > 0, share).when(_c(sessions) > 0, _c(sessions).cast("string")).otherwise("-")


def json_long(c: Column | str, path: str) -> Column:
    """A number of a JSON field; null if the field is missing or no number, or the text is no JSON."""
    return F.get_json_object(_c(c), path).try_cast("long")


def json_valid(c: Column | str) -> Column:
    return F.try_parse_json(_c(c)).isNotNull()


def quoted_value(c: Column | str, key: str) -> Column:
    """The text between quotes after a key, without parsing the line."""
    return F.nullif(F.regexp_extract(_c(c), f'"{key}":"([^"]*)"', 1), F.lit(""))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Whether a range runs from one midnight to a later one."""
    midnight = lambda c: _c(c) == F.date_trunc("day", _c(c))
    return midnight(start) & midnight(end) & (_c(start) < _c(end))


#: The refresh intervals that can be chosen, in seconds, and what others become.
REFRESH, REFRESH_DEFAULT = (60, 180, 300, 600), 180


def refresh_interval(c: Column | str) -> Column:
    return F.when(_c(c).isin(*REFRESH), _c(c)).otherwise(REFRESH_DEFAULT)


def enabled(c: Column | str) -> Column:
    """A reader that no setting names is on."""
    return F.coalesce(_c(c), F.lit(True))
