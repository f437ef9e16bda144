"""Snapshots of several devices: latest wins, differences, validation, freshness and origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import columns as C

#: Windows and counts of a valid snapshot, and when a device counts as stale.
MOST_DAYS, MOST_EVENTS, MOST_TOKENS, STALE_INTERVALS = 367, 200_000, 1_000_000_000, 4
#: Devices of a hub, and for how many seconds what was loaded is used again, without the hub, and in sums.
MOST_DEVICES, REUSE_S, OFFLINE_S, TOTALS_S = 64, 30, 48 * 3600, 600


def latest_wins(envelopes: DataFrame) -> DataFrame:
    """(device_id, sequence, digest, conflict): the highest sequence, and whether it came with different contents."""
    top = envelopes.groupBy("device_id").agg(F.max("sequence").alias("sequence"))
    same = envelopes.join(top, ["device_id", "sequence"])
    return same.groupBy("device_id", "sequence").agg(F.min("digest").alias("digest"), (F.min("digest") != F.max("digest")).alias("conflict"))


def verdicts(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """candidates with `verdict` by the stored sequence: stale, repeat, conflict or replace."""
    known = stored.select("device_id", F.col("sequence").alias("_s"), F.col("digest").alias("_d"))
    out = candidates.join(known, "device_id", "left")
    verdict = F.when(F.col("_s").isNull() | (F.col("sequence") > F.col("_s")), "replace").when(F.col("sequence") < F.col("_s"), "stale").when(F.col("digest") == F.col("_d"), "repeat").otherwise("conflict")
    return out.withColumn("verdict", verdict).drop("_s", "_d")


def manifest_diff(manifest: DataFrame, cached: DataFrame) -> DataFrame:
    """(device_id, change): fetch what is new or newer, keep what is as known, remove what is no longer listed."""
    both = manifest.select("device_id", F.col("sequence").alias("m")).join(cached.select("device_id", F.col("sequence").alias("c")), "device_id", "full")
    change = F.when(F.col("m").isNull(), "removed").when(F.col("c").isNull() | (F.col("m") > F.col("c")), "changed").otherwise("retained")
    return both.select("device_id", change.alias("change"))


def freshness(devices: DataFrame, now_us: int) -> DataFrame:
    """devices with `stale`: not seen for more than four of their intervals; one that was never seen is not."""
    age = F.lit(now_us) - F.col("last_seen_us")
    return devices.withColumn("stale", F.coalesce(age > F.col("interval_s") * STALE_INTERVALS * 1_000_000, F.lit(False)))


def retained(events: DataFrame, today: str, days: int, ts: str = "ts") -> DataFrame:
    """Events of the last `days` UTC days, today included, up to tomorrow."""
    end = F.lit(today).cast("timestamp_ntz") + F.expr("interval 1 day")
    return events.where((F.col(ts) >= end - F.expr(f"interval {days} day")) & (F.col(ts) < end))


def overlapping(windows: DataFrame, start: str, end: str, first: str = "covered_from", last: str = "covered_to") -> DataFrame:
    return windows.where((F.col(first) < F.lit(end).cast("timestamp_ntz")) & (F.col(last) > F.lit(start).cast("timestamp_ntz")))


def valid_events(events: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Events whose counters are all within 0 and the most, with one above zero."""
    each = [F.coalesce(F.col(c), F.lit(0)).between(0, most) for c in C.COUNTERS]
    ok = each[0] & each[1] & each[2] & each[3] & each[4]
    return events.where(ok & (C.total_tokens() > 0))


def snapshot_errors(snapshots: DataFrame) -> DataFrame:
    """snapshots with `error`: the first rule broken, null if none; (version, days, token_events, activity_events, device_id)."""
    error = (
        F.when(F.col("version") != 1, "version")
        .when(~C.safe_id("device_id"), "device")
        .when((F.col("days") <= 0) | (F.col("days") > MOST_DAYS), "window")
        .when((F.col("token_events") > MOST_EVENTS) | (F.col("activity_events") > MOST_EVENTS), "events")
    )
    return snapshots.withColumn("error", error)


def remote_events(events: DataFrame, devices: DataFrame, local_device: str) -> DataFrame:
    """Events of other devices, their source named with the device and their streams kept apart by it."""
    named = devices.where(F.col("device_id") != local_device).select("device_id", F.col("name").alias("_name"))
    out = events.join(named, "device_id")
    return out.withColumns({"source": F.concat_ws(" · ", "source", "_name"), "stream_id": F.concat_ws("|", "device_id", "stream_id"), "origin_id": F.concat(F.lit("remote:"), F.col("device_id"))}).drop("_name")


def scoped(events: DataFrame, scope: str = "all") -> DataFrame:
    """All origins or one; rows without an origin are local."""
    origin = events.withColumn("origin_id", F.coalesce("origin_id", F.lit("local")))
    return origin if scope == "all" else origin.where(F.col("origin_id") == scope)


def merged_origins(slices: DataFrame, measures: list[str]) -> DataFrame:
    """(origin_id, name, measures): sums, and the name of the newest slice."""
    return slices.groupBy("origin_id").agg(F.max_by("name", F.struct("updated", "name")).alias("name"), *(F.sum(m).alias(m) for m in measures))


def aliases(devices: DataFrame) -> DataFrame:
    """devices with `alias`: a number after the name where several share name and platform, by id."""
    same = Window.partitionBy("name", "platform")
    n = F.row_number().over(same.orderBy("device_id"))
    return devices.withColumn("alias", F.when(F.count("*").over(same) > 1, F.concat_ws(" ", "name", n.cast("string"))).otherwise(F.col("name")))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(missing, extra): how many keys of a are not in b, and the other way round."""
    lost = lambda x, y, name: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").agg(F.count("*").alias(name))
    return lost(a, b, "missing").crossJoin(lost(b, a, "extra"))  # two rows of one


def digest_of_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest) that is equal for equal sets of rows, whatever their order.

    A row's digest leads to a bucket by its first six digits; a bucket is the
    digest of its sorted rows, and buckets are digested by their first four,
    two and no digits.  However hot a key, it is dealt over 16,777,216 buckets,
    and above them no list is longer than 256.
    """
    row = C.sha256(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    level = rows.select(key, row.alias("d")).withColumn("p", F.col("d"))
    for digits in (6, 4, 2, 0):
        within = F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])
        level = level.groupBy(key, F.substring("p", 1, digits).alias("q")).agg(C.sha256(F.array_join(within, "\n")).alias("d")).withColumnRenamed("q", "p")
    return level.select(key, F.col("d").alias("digest"))


def version_tags(devices: DataFrame, hub: str, manifest: bool = False) -> DataFrame:
    """(hub, tag): the digest of its devices' ids and sequences in id order; a manifest's has the time seen and interval too.

    Devices that never sent are left out of the plain tag and have sequence 0
    in the manifest's.  A hub has at most MOST_DEVICES; more fail.
    """
    sequence = F.coalesce("latest_sequence", F.lit(0).cast("long"))
    parts = ["device_id", sequence] + ([F.coalesce(F.floor(F.col("last_seen_us") / 1000).cast("long"), F.lit(-1)), F.col("interval_s")] if manifest else [])
    line = F.struct(F.col("device_id").alias("id"), F.concat_ws(":", *parts).alias("line"))
    counted = F.lit(True) if manifest else F.col("latest_sequence").isNotNull()
    lines = F.transform(F.array_sort(F.collect_list(F.when(counted, line))), lambda x: x["line"])
    few = F.when(F.count("*") > MOST_DEVICES, F.raise_error(F.lit(f"a hub has more than {MOST_DEVICES} devices"))).otherwise(F.array_join(lines, "\n"))
    return devices.groupBy(hub).agg(C.sha256(few).alias("tag"))


def cache_decisions(caches: DataFrame, now_us: int) -> DataFrame:
    """caches with `decision`, `offline` and `totals`: what a device's loaded snapshots may still be used for.

    caches: complete, checked_us, fetched_us, fallback and stale.  What was
    checked within REUSE_S is reused, if it is complete, and, where it came from
    a fallback, fetched within OFFLINE_S; `stale` where a device in it is;
    anything else is fetched.  `offline`: may stand in if that fails; `totals`:
    sums made of it still hold.  Times ahead of the clock or null never do.
    """
    age = lambda c, most: F.coalesce((F.lit(now_us) - F.col(c)).between(0, most * 1_000_000), F.lit(False))
    usable = F.coalesce("complete", F.lit(False)) & age("checked_us", REUSE_S)
    fallback, stale = F.coalesce("fallback", F.lit(False)), F.coalesce("stale", F.lit(False))
    decision = F.when(~usable | (fallback & ~age("fetched_us", OFFLINE_S)), "fetch").when(~fallback & stale, "stale").otherwise("reuse")
    return caches.withColumns({"decision": decision, "offline": age("fetched_us", OFFLINE_S), "totals": age("fetched_us", TOTALS_S)})


def sync_decisions(now: DataFrame, before: DataFrame) -> DataFrame:
    """(device_id, decision, sequence): upload with the next sequence if source and content changed, else a heartbeat.

    now: (device_id, signature, digest); before: the same and the last sequence.
    """
    last = before.select("device_id", F.col("signature").alias("_s"), F.col("digest").alias("_d"), F.col("sequence").alias("_n"))
    same = F.coalesce((F.col("signature") == F.col("_s")) | (F.col("digest") == F.col("_d")), F.lit(False))
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return now.join(last, "device_id", "left").select("device_id", F.when(same, "heartbeat").otherwise("upload").alias("decision"), F.when(same, n).otherwise(n + 1).alias("sequence"))


def storage_quota(stored: DataFrame, incoming: DataFrame, most: int) -> DataFrame:
    """(device_id, used, fits): bytes stored with each incoming snapshot in the place of the device's own."""
    own = stored.groupBy("device_id").agg(F.sum("bytes").alias("_own"))
    total = stored.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_all"))
    out = incoming.join(own, "device_id", "left").crossJoin(total)  # one row
    used = F.col("_all") - F.coalesce("_own", F.lit(0)) + F.col("bytes")
    return out.select("device_id", used.alias("used"), (used <= most).alias("fits"))


def statuses(readers: DataFrame, scope: str = "all") -> DataFrame:
    """Reader statuses of a scope: those of one origin are shown for readers that tell origins apart."""
    return readers if scope == "all" else readers.where(F.col("partitioned") == (scope != "local"))
