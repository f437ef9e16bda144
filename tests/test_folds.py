"""Folds against the plain step over each key's rows in order."""

import collections
import datetime
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import cube, folds
from tallyspark.plans import catalogue, panels  # noqa: F401
from tallyspark.sources.scratch import written

SNAPSHOT = "rollout string, ts timestamp_ntz, ord long, " + ", ".join(f"{n} long" for n in (*folds.TOTAL, *folds.LAST))


def rollouts(seed, n=60):
    """Totals that rise, repeat, fall a little (late reports), fall far (resets) and are missing, with and without increments."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        total = [draw.choice([0, 2**53 + 1]), 0, 0, 0]
        for o in range(draw.randint(1, 12)):
            kind = draw.choice(["rise", "rise", "rise", "same", "late", "reset", "none"]) if k % 2 else draw.choice(["rise", "same", "none"])
            step = [draw.randint(0, 90) for _ in range(4)]
            if kind == "rise":
                total = [a + b for a, b in zip(total, step, strict=True)]
            shown = {"late": [max(0, t - 1) for t in total], "reset": step}.get(kind, total)
            if kind == "reset":
                total = step
            last = step if draw.random() < 0.6 else [None] * 4
            ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=o)
            rows.append((f"r{k}", ts, o, *([None] * 4 if kind == "none" else shown), *last))
    return rows


def test_counter_events_equal_the_plain_fold(spark):
    rows = rollouts(7)
    want, state = [], {}
    row_of = collections.namedtuple("R", ["rollout", "ts", "ord", *folds.TOTAL, *folds.LAST])
    for r in sorted(rows):
        state[r[0]], out = folds.counter_step(state.get(r[0]), row_of(*r))
        want += out
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SNAPSHOT).repartition(5)
    got = [tuple(r) for r in folds.counter_events(df).collect()]
    assert sorted(got) == sorted(want) and any(v >= 2**53 for r in want for v in r[3:])


def test_longs_beside_nulls_keep_their_digits(spark):
    big = 2**53 + 1
    null = [None] * 4
    empty = [None] * 7
    kinds = "rollout string, ord long, ts timestamp_ntz, entry string, session_id string, parent_id string, thread_source string, turn_id string, turn_key string, child_key string, t_reported long, " + ", ".join(f"{n} long" for n in (*folds.TOTAL, *folds.LAST))
    rows = [("a", 1, None, "turn_context", *empty, *null, *null), ("a", 2, datetime.datetime(2024, 1, 1), "token_count", *empty, big, 0, 0, 0, *null)]
    found = folds.without_replays(spark.createDataFrame(rows, kinds)).collect()
    assert [r.t_input for r in found] == [big]


def test_no_rows_no_events(spark):
    assert folds.counter_events(spark.createDataFrame([], SNAPSHOT)).count() == 0


def test_reports_read_their_events_once(spark):
    sf = "/root/testdata/sf0.001"
    # each scan of events has one of distinct model names beside it
    most = {"token_totals": 2, "daily_rollup": 2, "source_stats": 2, "model_stats_by_source": 2, "model_stats": 6}
    # these read a written cube
    most |= {"export_sections": 1, "project_breakdown": 2, "attributed_cost": 1, "top_picks": 2, "json_export": 1}
    for name, n in most.items():
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= n, name


def test_a_cube_reads_its_events_once(spark):
    events = catalogue.priced(spark, "/root/testdata/sf0.001")
    added = cube.usage(events)._jdf.queryExecution().executedPlan().toString()
    assert added.count("FileScan parquet") == 2 and cube.cube(written(cube.usage(events)))._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2


def test_velocities_in_whole_batches_equal_the_plain_step(spark):
    draw, rows = random.Random(5), []
    for k in [None, *(f"k{i}" for i in range(20))]:
        at, tokens, day = 0, 0, 0
        for i in range(draw.randint(1, 120)):
            if draw.random() < 0.05:
                day, tokens = day + 1, 0
            at += draw.choice([0, 1, 400_000, 999_999, 1_000_000, 7_000_000])
            tokens = max(0, tokens + draw.choice([0, 0, 4, 900, -2]))
            rows.append((k, f"d{day}" if day != 2 else None, at, tokens))
    want, state = [], {}
    for k, day, at, tokens in sorted(rows, key=lambda r: (str(r[0]), r[2], str(r[1] or ""), r[3])):
        state[k], rate = folds.velocity(state.get(k), day, at, tokens, 0.65, 1e6)
        want.append((str(k), at, tokens, round(rate * 1e6, 6)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(draw.sample(rows, len(rows)), "key string, day string, at_us long, tokens long")
        got = [(str(r.key), r.at_us, r.tokens, round(r.rate, 6)) for r in folds.velocities(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted(want) and sum(r[3] > 0 for r in want) > 200
    assert folds.velocities(df.limit(0)).count() == 0


def test_rates_that_fade_to_nothing_begin_anew():
    at, tokens = np.arange(1, 3001) * 2_000_000, np.where(np.arange(3000) < 2000, 100, 300)
    tokens[0] = 0
    rates, _ = folds.smoothed(at, tokens, np.arange(3000) == 0, 0.0, 0.65, 1_000_000)
    state, want = None, []
    for a, t in zip(at.tolist(), tokens.tolist(), strict=True):
        state, rate = folds.velocity(state, "d", a, t, 0.65, 1e6)
        want.append(rate)
    assert np.allclose(rates, want, rtol=1e-12, atol=1e-300) and want[1999] == 0 and rates[2000] == want[2000] == 200 / 2_000_000


def test_forks_whose_entries_lie_apart_are_folded_whole(spark):
    """A union of inputs of unequal size that each lie by rollout, in an adaptive plan that merges small partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    for k, v in zip(before, ("40", "false", "32k", "1k"), strict=True):
        spark.conf.set(k, v)
    try:
        null = lambda kind="string": F.lit(None).cast(kind)
        of = lambda n: spark.range(n).select((F.col("id") % 8_000).cast("string").alias("rollout"), (F.col("id") / 8_000).cast("long").alias("o"))
        numbered = lambda n: of(n).withColumn("k", F.row_number().over(Window.partitionBy("rollout").orderBy("o")))
        entry = lambda rows, at, name, **given: rows.select("rollout", at.cast("long").alias("ord"), F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.lit(name).alias("entry"), *(given.get(c, null()).alias(c) for c in ("session_id", "parent_id", "thread_source", "turn_id", "turn_key", "child_key")), null("long").alias("t_reported"), *((F.col("k") * 7).cast("long").alias(c) if name == "token_count" else null("long").alias(c) for c in folds.TOTAL), *(null("long").alias(c) for c in folds.LAST))
        first = numbered(8_000).where("k = 1")
        entries = entry(numbered(32_000), F.col("k") * 10, "token_count").unionByName(entry(first, F.lit(1), "session_meta", session_id=F.lit("c"), parent_id=F.lit("p"))).unionByName(entry(first, F.lit(25), "turn_context"))
        got = collections.Counter(r.ord for r in folds.without_replays(entries).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {30: 8_000, 40: 8_000}


def test_reports_advanced_in_whole_batches_equal_the_plain_fold(spark):
    """Totals small enough for whole batches, of few rows each, so that rollouts go on from one to the next."""
    rows = [(r[0], r[1], r[2], *(None if v is None else v - (2**53 + 1) * (v > 2**52) for v in r[3:])) for s in (7, 8) for r in rollouts(s, 40) if s == 7 or r[0] < "r5"]
    rows = list({(r[0], r[2]): r for r in rows}.values())
    want, state = [], {}
    row_of = collections.namedtuple("R", ["rollout", "ts", "ord", *folds.TOTAL, *folds.LAST])
    for r in sorted(rows, key=lambda r: r[:3]):
        state[r[0]], out = folds.counter_step(state.get(r[0]), row_of(*r))
        want += out
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [tuple(r) for r in folds.counter_events(spark.createDataFrame(rows, SNAPSHOT)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted(want) and len(want) > 100


def test_advances_take_late_reports_of_late_ones():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randint(1, 30)
        totals = np.array([[draw.choice([0, 97, 98, 99, 100, 101, 300]) for _ in range(n)] for _ in range(4)])
        lasts, known = np.array([[draw.choice([0, 1, 50]) for _ in range(n)] for _ in range(4)]), np.array([draw.random() < 0.8 for _ in range(n)])
        begins = np.array([i == 0 or draw.random() < 0.1 for i in range(n)])
        added, stood = folds.advances(totals, lasts * known, known, begins)
        want, base = folds._steps(totals, lasts, known, begins)
        assert (added == want).all() and (totals[:, stood] == totals[:, base]).all()


def test_running_totals_are_shuffled_once_in_tasks_of_bounded_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue, "REPORTS_A_TASK", 100, raising=False)
    n = -(-catalogue.table(spark, sf, "lineitem").count() // 100)
    for name in ("counter_fold", "counter_fold_resets", "counter_fold_late", "replay_suppression", "delta_ledger"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and f", {n})" in plan and plan.count("Sort [") <= 3, name


def test_tasks_of_the_ledger_neither_grow_nor_become_too_many_to_write_unsorted(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "REPORTS_A_TASK", 500, raising=False)
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        tasks = catalogue.delta_ledger(spark, sf).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < 1_000, sf
    reports = catalogue.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    for few, most, n in ((10, reports, 200), (10, 20, -(-reports // 20)), (reports, reports, spark.sparkContext.defaultParallelism)):
        monkeypatch.setattr(catalogue, "REPORTS_A_TASK", few, raising=False)
        monkeypatch.setattr(catalogue, "MOST_A_TASK", most, raising=False)
        plan = catalogue.delta_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and f", {n})" in plan, (few, most, n)
