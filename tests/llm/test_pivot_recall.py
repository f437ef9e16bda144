"""Recall of the pivot index against brute force, on tables of three kinds."""

import numpy as np
import pytest

from tallyspark.llm import pivots
from tests.llm import brute


def made(kind, n=6000, d=48, planted=400, seed=1):
    """Unit vectors, of which planted pairs have a cosine of exactly 0.95."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    if kind == "cone":
        x += 2.3 * np.sqrt(d) * np.eye(d)[0]  # mean cosine about 0.84
    if kind == "dense":
        x[: n // 3] = rng.standard_normal(d) + 0.25 * rng.standard_normal((n // 3, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = n // 2 + np.arange(planted)
    other = x[at + planted] - (x[at + planted] * x[at]).sum(1, keepdims=True) * x[at]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return np.vstack((x, 0.9501 * x[at] + np.sqrt(1 - 0.9501**2) * other))


@pytest.mark.parametrize("kind", ["even", "cone", "dense"])
def test_recall(spark, kind):
    x = made(kind)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(table).collect()}
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want.sum() >= 800
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.95 * want.sum()
    planted = np.flatnonzero(want > 0)[-400:]
    assert sum(got[i] > 0 for i in planted.tolist()) >= 0.95 * len(planted)


def test_points_fit_their_bytes_and_dimensions_without_any_are_still_compared(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = []
    for dim, n in ((16, 300), (8, 200), (4, 60)):
        base = draw.normal(size=(n, dim))
        rows += [*base.tolist(), *(base[:20] * 1.5 + 0.01 * draw.normal(size=(20, dim))).tolist()]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivots, "HELD_BYTES", 8 * 16 * 41 + 8 * 8 * 34)
    held, fit = {}, pivots.fit_pivots
    monkeypatch.setattr(pivots, "fit_pivots", lambda *a: held.update(fit(*a)) or held)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()}
    assert set(held) < {16, 8, 4} and sum(p.x.nbytes + p.mean.nbytes for p in held.values()) <= pivots.HELD_BYTES
    assert got == brute.vectors(rows)
