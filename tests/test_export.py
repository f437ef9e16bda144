"""A document of a cube's rows is whole and in order, however many there are."""

import json
import random

from pyspark.sql import functions as F

from tallyspark.operators import export, reports


def test_a_document_holds_every_row_in_order(spark):
    n = 100_200
    k = F.col("id")
    kinds = dict.fromkeys((*reports.SUMS, "sessions"), "long") | dict.fromkeys(("first_at", "last_at"), "timestamp_ntz")
    cells = {"section": F.when(k == 0, "total").when(k == 1, "source").when(k < 4, "model").when(k < 100, "project").otherwise("session"), "source": F.when((k == 1) | (k >= 100), F.concat(F.lit("a\"é"), (k % 3).cast("string"))), "model": F.when((k > 1) & (k < 4), k.cast("string")), "session_key": F.when(k >= 100, k.cast("string")), "project_name": F.when(k > 3, (k % 10).cast("string")), "project_path": F.when(k % 2 == 0, k.cast("string")), "total_tokens": k % 50}
    names = (*dict.fromkeys((*cells, *kinds, "session_id", "models", "sources", "quality")),)
    found = spark.range(n).repartition(7).select(*(cells.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names))
    got = json.loads(export.as_document(found, "d", "s", "e").head()[0])
    assert list(got) == ["date", "endDate", "models", "projects", "sessions", "sources", "startDate", "totals"]
    assert (got["date"], got["startDate"], got["endDate"]) == ("d", "s", "e") and got["totals"]["total_tokens"] == 0
    assert [len(got[p]) for p in ("models", "projects", "sessions", "sources")] == [2, 96, n - 100, 1]
    want = sorted(range(100, n), key=lambda i: (-(i % 50), i % 3, str(i)))
    assert [int(r["session_key"]) for r in got["sessions"]] == want
    assert [(-r["total_tokens"], r["project_name"]) for r in got["projects"]] == sorted((-(i % 50), str(i % 10)) for i in range(4, 100))
    assert all(list(r) == sorted(r) and r["source"][:3] == "a\"é" and "models" in r for r in random.Random(1).sample(got["sessions"], 50))


def test_an_empty_cube_is_a_document(spark):
    schema = "section string, source string, model string, session_key string, project_path string, project_name string, session_id string, first_at timestamp_ntz, last_at timestamp_ntz, models string, sources string, quality string, sessions long, " + ", ".join(f"{c} long" for c in reports.SUMS)
    got = json.loads(export.as_document(spark.createDataFrame([], schema), "d", "s", "e").head()[0])
    assert got["sessions"] == got["models"] == [] and got["totals"] is None
