"""Whole orders with places, pages by key, concurrency by cells, and the ledger against the plain step."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.columns import COUNTERS
from tallyspark.operators import activity, audit, folds, reports

ORDER = [("a", True), ("b", False), ("c", True)]


def rows(n=400, seed=1):
    draw = random.Random(seed)
    return list({(draw.randint(0, 3), draw.randint(0, 5), draw.randint(0, 99)) for _ in range(n)})


def test_places_run_through_all_parts(spark):
    some = rows() + rows()[:50]
    found = reports.placed(spark.createDataFrame(some, "a int, b int, c int"), ORDER, parts=7).orderBy("place").collect()
    assert [r.place for r in found] == list(range(1, len(some) + 1))
    assert [(r.a, r.b, r.c) for r in found] == sorted(some, key=lambda x: (x[0], -x[1], x[2]))
    assert reports.placed(spark.createDataFrame([], "a int, b int, c int"), ORDER, parts=3).count() == 0


def test_pages_show_each_row_once(spark):
    df = spark.createDataFrame(rows(), "a int, b int, c int").cache()
    seen, after = [], None
    while page := reports.page(df, ORDER, 37, after).collect():
        seen += [(r.a, r.b, r.c) for r in page]
        after = page[-1]
    assert seen == sorted(rows(), key=lambda x: (x[0], -x[1], x[2]))
    between = spark.createDataFrame([(0, 9, 0)], df.schema)
    assert [tuple(r) for r in reports.page(df.unionByName(between), ORDER, 5, after=dict(zip("abc", seen[10], strict=True))).collect()] == seen[11:16]


def test_findings_are_told_apart_within_a_line(spark):
    key = "ghp_" + "a1B2" * 9
    lines = spark.createDataFrame([(1, 1, f"{key} {key} {key}"), (1, 2, "")], "doc_id int, line_number int, line string")
    found = audit.ranked(audit.findings(lines, "doc_id"))
    first = reports.page(found, audit.in_order("doc_id"), 2).collect()
    rest = reports.page(found, audit.in_order("doc_id"), 2, first[-1]).collect()
    assert [r.nth for r in first + rest] == [0, 1, 2]


@pytest.mark.parametrize("seed", range(3))
def test_concurrency_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    spans = [(a := draw.randint(-200, 3000), a + draw.choice([0, 1, 7, 90, 2500])) for _ in range(draw.choice([0, 1, 80]))]
    df = spark.createDataFrame(spans, "start_us long, end_us long")
    times = [t for t in range(-201, 6000) if any(a <= t < b for a, b in spans)]
    r = activity.busy(df, narrow=10, wide=8).head()
    assert (r.wall_us, r.max_streams) == (len(times), max((sum(a <= t < b for a, b in spans) for t in times), default=0))


def test_the_ledger_equals_the_plain_step(spark):
    draw, seen = random.Random(4), []
    for k in range(80):
        at, total = 1000, [0] * 5
        for _ in range(draw.randint(1, 9)):
            at += draw.randint(1, 90)
            total = [0] * 5 if draw.random() < 0.2 else [max(0, t + draw.choice([0, 0, 5, 9, -3 * (draw.random() < 0.1)])) for t in total]
            near = lambda: draw.choice([None, at - draw.randint(-20, 200), 990])  # noqa: B023, E731
            rate = draw.choice([None, 3])
            seen.append((f"s{k}", at, draw.choice([None, at - 60, 900]), draw.choice([950, 1005]), near(), near(), *total, draw.choice([None, 1.5, 0.25, 2.0]), *(rate if rate is None else rate + i for i in range(4))))
    kinds = "session string, observed_us long, previous_us long, started_us long, earliest_us long, latest_us long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", cost double, input_rate long, output_rate long, cache_read_rate long, cache_write_rate long"
    df = spark.createDataFrame(seen, kinds)
    want = folds.fold(df, ["session"], ["observed_us"], folds.ledger_step, folds.LEDGER).withColumn("cost", F.round("cost", 12))
    got = folds.ledger(df).withColumn("cost", F.round("cost", 12))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 100
    assert "Arrow" not in got._jdf.queryExecution().toString()
