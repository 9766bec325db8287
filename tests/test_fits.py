"""Oscillation fits against numpy's least squares, and user aggregates in two phases."""

import math

import numpy as np
import pytest

from stepfield.operators import calls as K
from stepfield.operators import spectral as SP


def left_over(t, ys, f):
    """Sum of squares that offset, sine and cosine of one frequency leave."""
    m = np.stack([np.ones_like(t), np.sin(2 * np.pi * f * t), np.cos(2 * np.pi * f * t)], axis=1)
    return sum(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() for y in ys)


def test_fit_is_a_minimum(spark):
    rng = np.random.default_rng(3)
    rows, runs = [], {}
    for run, f in enumerate((0.8, 1.7, 2.4)):
        t = np.sort(rng.uniform(50, 60, 150))
        a = 0.3 + 2 * np.sin(2 * math.pi * f * t + 0.4) + rng.normal(0, 0.3, 150)
        b = -1 + np.sin(2 * math.pi * f * t - 1.1) + rng.normal(0, 0.3, 150)
        runs[run] = (t, [a, b])
        rows += [(run, i, *map(float, v)) for i, v in enumerate(zip(t, a, b))]
    df = spark.createDataFrame(rows, "run bigint, i bigint, t double, a double, b double")
    found = {r.run: r.frequency for r in SP.fit_oscillation(df, ["run"], "t", ["a", "b"], ["i"], rounds=10).collect()}
    assert sorted(found) == [0, 1, 2]
    for run, (t, ys) in runs.items():
        best = left_over(t - t[0], ys, found[run])
        assert all(best <= left_over(t - t[0], ys, found[run] + d) for d in (-1e-3, -1e-5, 1e-5, 1e-3))
        near = found[run] * np.linspace(0.8, 1.2, 400)
        assert best <= min(left_over(t - t[0], ys, f) for f in near) + 1e-9


def test_fit_of_awkward_runs(spark):
    rows = [(1, i, i * 0.1, math.sin(i * 0.3)) for i in range(60)]
    rows += [(1, 99, None, 5.0), (1, 100, 3.0, None), (None, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0), (3, 2, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "run bigint, i bigint, t double, a double")
    out = SP.fit_oscillation(df, ["run"], "t", ["a"], ["i"]).collect()
    assert [r.run for r in out] == [1]
    assert abs(out[0].frequency - 3 / (2 * math.pi)) < 1e-6 and abs(out[0].amplitude - 1) < 1e-6
    assert SP.fit_oscillation(df.limit(0), ["run"], "t", ["a"], ["i"], frequency=1.0).count() == 0


def test_batch_aggregate(spark):
    rows = [(k, [float(i), i * 0.5, 1.0][: 3 - i % 2]) for i, k in enumerate(["a", "b", None, "a"] * 50)] + [("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)

    def fn(v):
        n = np.linalg.norm(v, axis=1)
        return {"s": n, "low": n, "high": n}

    out = {r.k: r for r in K.batch_aggregate(df, fn, ["v"], {"s": "sum", "low": "min", "high": "max"}, ["k"]).collect()}
    assert set(out) == {"a", "b", "c", None} and out["c"].s is None and out["c"].low is None
    for key in ("a", "b", None):
        whole = [math.sqrt(sum(x * x for x in v)) for k, v in rows if k == key and v and len(v) == 3]
        if whole:
            assert math.isclose(out[key].s, sum(whole)) and math.isclose(out[key].low, min(whole)) and math.isclose(out[key].high, max(whole))
        else:
            assert out[key].s is None


def test_batch_aggregate_in_small_batches(spark):
    df = spark.range(5000).selectExpr("id % 7 AS k", "id AS x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = K.batch_aggregate(df, lambda x: {"n": np.ones(len(x)), "top": x}, ["x"], {"n": "sum", "top": "max"}, ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: (r.n, r.top) for r in out} == {k: (len(range(k, 5000, 7)), max(range(k, 5000, 7))) for k in range(7)}
    with pytest.raises(ValueError):
        K.batch_aggregate(df, len, ["x"], {"n": "mean"}, ["k"])
    with pytest.raises(ValueError):
        K.batch_aggregate(df, len, ["x"], {"k": "sum"}, ["k"])
