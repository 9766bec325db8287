import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.operators import spectral as SP
from stepfield.operators.calls import derive, needed
from stepfield.operators.formula import expand


@pytest.mark.parametrize("n,line", [(48, 64), (48, 8), (47, 16), (64, 4), (12, 5)])
def test_lines_of_any_length(spark, n, line):
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=(3, n))
    df = spark.createDataFrame([(k, i, float(data[k, i]), 0.0) for k in range(3) for i in range(n)], "k bigint, i bigint, re double, im double")
    out = SP.transform_line(df, ["k"], "i", n, line=line).collect()
    want = np.fft.fft(data, axis=1)
    assert len(out) == 3 * n
    assert max(abs(complex(r.re, r.im) - want[r.k, r.i]) for r in out) < 1e-8


@pytest.mark.parametrize("n", [8, 7])
def test_fft_axis(spark, n):
    values = np.cos(np.arange(n))
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k bigint, x bigint, value double")
    out = sorted(SP.fft(df, {"x": (1.0, 3.0, n)}, ["k"]).collect(), key=lambda r: r.x)
    want = np.fft.fftshift(np.fft.fft(values)) * 2.0 * np.exp(-1j)
    assert max(abs(complex(r.re, r.im) - w) for r, w in zip(out, want)) < 1e-9
    assert abs(out[0].k_x - (-(n // 2)) * math.pi) < 1e-12 and out[n // 2].k_x == 0


def test_fft_refuses_vectors(spark):
    with pytest.raises(ValueError):
        SP.fft(spark.range(1).select("id", F.array(F.lit(1.0)).alias("value")), {"id": (0.0, 1.0, 1)}, [])


def test_fit_oscillation(spark):
    rows = [(r, i, i * 0.05, 0.2 + 3 * math.sin(2 * math.pi * f * i * 0.05 + 0.5), 1.5 + 0.5 * math.sin(2 * math.pi * f * i * 0.05 - 1.0))
            for r, f in enumerate((0.7, 1.3)) for i in range(200)]
    df = spark.createDataFrame(rows, "run bigint, i bigint, t double, a double, b double")
    for row in SP.fit_oscillation(df, ["run"], "t", ["a", "b"], ["i"]).collect():
        c, a, p = (0.2, 3.0, 0.5) if row.column == "a" else (1.5, 0.5, -1.0)
        assert abs(row.frequency - (0.7, 1.3)[row.run]) < 1e-4
        assert abs(row.offset - c) < 1e-2 and abs(row.amplitude - a) < 1e-2
        assert abs((row.phase - p + math.pi) % (2 * math.pi) - math.pi) < 1e-2


def test_derive(spark):
    df = spark.range(3)
    registry = {"b": (["id"], lambda i: i + 1), "c": (["b"], lambda b: b * 2), "d": (["c"], lambda c: c), "x": (["y"], lambda y: y), "y": (["x"], lambda x: x)}
    out = derive(df, registry, ["c"])
    assert out.columns == ["id", "b", "c"] and [r.c for r in out.collect()] == [2, 4, 6]
    assert needed(registry, ["c"], ["id"]) == ["b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        derive(df, registry, ["x"])
    with pytest.raises(ValueError):
        derive(df, registry, ["nothing"])


def test_formula_drops_zeros(spark):
    cells = expand(("i",), [(1.0, [("T", "i", "j"), ("m", "j")])], {"i": 2, "j": 2}, {"T": [[2, 0], [0, 0]]})
    assert str(cells[(1,)]._jc.toString()) == "0.0" and "m[1]" not in str(cells[(0,)]._jc.toString())
