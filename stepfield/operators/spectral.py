"""Fourier transform along grid axes and oscillation fits (A-25, A-26)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.operators import runs as R
from stepfield.session import cut_lineage

LINE = 1 << 16


def _short(df: DataFrame, keys: list[str], i: str, n: int, inverse: bool) -> DataFrame:
    """Transform of lines of at most LINE points: one array per line, transformed by batches."""
    lines = df.groupBy(*keys).agg(F.collect_list(F.struct(i, "re", "im")).alias("_l"))
    lines = lines.select(*keys, F.col(f"_l.{i}").alias("_i"), F.col("_l.re").alias("_re"), F.col("_l.im").alias("_im"))

    def transform(place: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        a = np.zeros((len(place), n), dtype=complex)
        for row, (p, x, y) in enumerate(zip(place, re, im)):
            a[row, np.asarray(p, dtype=np.int64)] = np.asarray(x) + 1j * np.asarray(y)
        out = np.fft.ifft(a, axis=1) * n if inverse else np.fft.fft(a, axis=1)
        return pd.DataFrame({"re": list(out.real), "im": list(out.imag)})

    spectrum = F.pandas_udf(transform, "re array<double>, im array<double>")(F.col("_i"), F.col("_re"), F.col("_im"))
    return (lines.select(*keys, spectrum.alias("_s"))
            .select(*keys, F.posexplode(F.arrays_zip("_s.re", "_s.im")).alias(i, "_z"))
            .select(*keys, F.col(i).cast("bigint").alias(i), F.col("_z.re").alias("re"), F.col("_z.im").alias("im")))


def _turn(df: DataFrame, phase) -> DataFrame:
    """Multiply (re, im) by exp(i · phase)."""
    c, s = F.cos(phase), F.sin(phase)
    return df.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def _factor(n: int, line: int) -> int | None:
    """A divisor d of n with d and n/d as near to each other as possible and d at most ``line``."""
    for d in range(math.isqrt(n), 1, -1):
        if n % d == 0 and d <= line:
            return d
    return None


def transform_line(df: DataFrame, keys: list[str], i: str, n: int, inverse: bool = False, line: int = LINE) -> DataFrame:
    """Discrete Fourier transform along index ``i`` (0 … n-1) of rows keys, i, re, im.

    A long line is never gathered: with n = a·b it is transformed in lines of a and of b points with
    one factor in between, and a length without a fitting divisor becomes a convolution of a length
    with one.
    """
    if n <= line:
        return _short(df, keys, i, n, inverse)
    sign = 2.0 if inverse else -2.0
    a = _factor(n, line)
    if a is not None:
        b = n // a
        p, q = i + "_p", i + "_q"
        rows = df.withColumns({p: F.floor(F.col(i) / b).cast("bigint"), q: (F.col(i) % b).cast("bigint")}).drop(i)
        first = transform_line(rows, [*keys, q], p, a, inverse, line)
        turned = _turn(first, sign * math.pi / n * ((F.col(p) * F.col(q)) % n))
        second = transform_line(turned, [*keys, p], q, b, inverse, line)
        return second.withColumn(i, (F.col(p) + a * F.col(q)).cast("bigint")).select(*keys, i, "re", "im")
    m = 1 << (2 * n - 1).bit_length()
    # exp(∓i·pi·k²/n); k² is taken modulo 2n to stay exact.
    chirp = (sign / 2.0) * math.pi / n * ((F.col(i) * F.col(i)) % (2 * n))
    spark = df.sparkSession
    up = transform_line(_turn(df, chirp), keys, i, m, False, line)
    back = spark.range(m).select(F.col("id").alias(i)).withColumn("_k", F.least(F.col(i), m - F.col(i)))
    on = F.col("_k") < n
    wave = -(sign / 2.0) * math.pi / n * ((F.col("_k") * F.col("_k")) % (2 * n))
    back = back.select(F.lit(0).alias("_one"), i, F.when(on, F.cos(wave)).otherwise(0.0).alias("re"), F.when(on, F.sin(wave)).otherwise(0.0).alias("im"))
    filt = transform_line(back, ["_one"], i, m, False, line).select(i, F.col("re").alias("_fr"), F.col("im").alias("_fi"))
    prod = up.join(filt, i).select(*keys, i, (F.col("re") * F.col("_fr") - F.col("im") * F.col("_fi")).alias("re"),
                                   (F.col("re") * F.col("_fi") + F.col("im") * F.col("_fr")).alias("im"))
    conv = transform_line(prod, keys, i, m, True, line).filter(F.col(i) < n)
    return _turn(conv.withColumns({"re": F.col("re") / m, "im": F.col("im") / m}), chirp)


def fft(df: DataFrame, axes: dict[str, tuple[float, float, int]], keys: list[str], value: str = "value", line: int = LINE) -> DataFrame:
    """Fourier transform of a scalar grid along the given axes.

    ``axes`` maps an index column (0 … n-1) to (min, max, n). The result has the index from the
    smallest to the largest wave number, the wave number as ``k_<axis>`` and the amplitude ``re``,
    ``im`` times the product of (max - min) · exp(-i·min).
    """
    if df.schema[value].dataType.typeName() == "array":
        raise ValueError("only scalar grids can be transformed")
    out = df.select(*keys, *axes, F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    for axis, (low, high, n) in axes.items():
        others = [*keys, *[a for a in axes if a != axis]]
        out = transform_line(out, others, axis, n, line=line)
        out = out.withColumn(axis, (F.col(axis) + n // 2) % n)
        out = _turn(out, F.lit(-float(low))).withColumns({"re": F.col("re") * (high - low), "im": F.col("im") * (high - low)})
    dk = {a: 2.0 * math.pi / (high - low) for a, (low, high, _) in axes.items()}
    waves = {f"k_{a}": (F.col(a) - n // 2) * dk[a] for a, (_, _, n) in axes.items()}
    return out.withColumns(waves)


def fit_oscillation(df: DataFrame, by: list[str], time: str, columns: list[str], order: list[str], frequency: float | None = None,
                    grid: int = 24, rounds: int = 6, **kw) -> DataFrame:
    """Least-squares fit of c + a·sin(2πft + p) to several columns with one frequency per run.

    The start is ``frequency``, or half the number of sign changes (at least one) of the smoothed first column over the
    duration. One pass tries ``grid`` + 1 frequencies up to 60 % away from it. From the best one, each of ``rounds`` passes
    takes a Gauss-Newton step of the frequency, with the best c, a and p for it solved from sums over the rows; a step that
    makes the error larger is taken back and halved. Rows are only ever summed, never gathered.

    Rows with a missing key, time or value take no part. A run whose rows do not fix c, a and p gives no row.
    """
    ys = [f"_y{k}" for k in range(len(columns))]
    rows = cut_lineage(df.select(*by, *order, F.col(time).cast("double").alias("_t"), *[F.col(c).cast("double").alias(y) for c, y in zip(columns, ys)])
                       .dropna(subset=[*by, "_t", *ys]))
    start = rows.groupBy(*by).agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    if frequency is None:
        flips = R.sign_flips(R.smooth5(rows, ys[0], by, order, out="_s", **kw), "_s", by, order, **kw)
        start = start.join(flips, by).withColumn("_f", F.greatest(F.col("flips"), F.lit(1)) * 0.5 / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0.0)))
    else:
        start = start.withColumn("_f", F.lit(float(frequency)))
    rows = rows.select(*by, "_t", *ys)
    state = cut_lineage(_scan_frequencies(rows, start.filter("_f > 0").select(*by, "_t0", "_f"), by, ys, grid))
    for _ in range(rounds + 1):
        state = cut_lineage(_step_frequency(rows, state, by, ys))
    fits = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{k}").alias("offset"),
                                        F.hypot(F.col(f"_a{k}"), F.col(f"_b{k}")).alias("amplitude"), F.atan2(F.col(f"_b{k}"), F.col(f"_a{k}")).alias("phase"))
                               for k, c in enumerate(columns)]))
    return state.filter("_c0 is not null").select(*by, F.col("_f").alias("frequency"), "_t0", fits.alias("r")).select(
        *by, "frequency", "r.column", "r.offset", "r.amplitude",
        (F.col("r.phase") - 2.0 * math.pi * F.col("frequency") * F.col("_t0")).alias("phase"))


# The formulas are built as SQL text: one expression each for the session, not one call per operation.

def _normal_sums(s: str, c: str, ys: list[str]) -> dict[str, str]:
    """Sums of the normal equations for offset, sine and cosine that depend on the frequency."""
    sums = {"s": f"sum({s})", "c": f"sum({c})", "ss": f"sum({s} * {s})", "sc": f"sum({s} * {c})", "cc": f"sum({c} * {c})"}
    for y in ys:
        sums.update({f"{y}s": f"sum({y} * {s})", f"{y}c": f"sum({y} * {c})"})
    return sums


def _fixed_sums(ys: list[str]) -> dict[str, str]:
    sums = {"n": "double(count(1))"}
    for y in ys:
        sums.update({f"{y}1": f"sum({y})", f"{y}{y}": f"sum({y} * {y})"})
    return sums


def _det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _normal(at: str = "") -> list[list[str]]:
    return [[at + "n", at + "s", at + "c"], [at + "s", at + "ss", at + "sc"], [at + "c", at + "sc", at + "cc"]]


def _cramer(m, det: str, right) -> list[str]:
    return [f"({_det([[right[i] if j == p else m[i][j] for j in range(3)] for i in range(3)])} / {det})" for p in range(3)]


def _solve(ys: list[str], at: str = ""):
    """Determinant (NULL where it is singular), solutions per column and the error left, for sums named with ``at`` before."""
    m = _normal(at)
    det = f"(CASE WHEN abs({_det(m)}) > 1e-9D * {at}n THEN {_det(m)} END)"
    found = [_cramer(m, det, [f"{at}{y}1", f"{at}{y}s", f"{at}{y}c"]) for y in ys]
    left = [f"{at}{y}{y} - ({x[0]} * {at}{y}1 + {x[1]} * {at}{y}s + {x[2]} * {at}{y}c)" for y, x in zip(ys, found)]
    return det, found, " + ".join(left)


def _named(texts: dict[str, str]) -> list:
    return [F.expr(text).alias(name) for name, text in texts.items()]


def _scan_frequencies(rows: DataFrame, start: DataFrame, by: list[str], ys: list[str], grid: int) -> DataFrame:
    """Best of the frequencies around the start, all of them tried in one pass; no step taken yet. The rows of one
    frequency are summed where they are made, so only sums are shuffled."""
    tries = ", ".join(f"{1.0 + 0.6 * (2.0 * k / grid - 1.0)!r}D" for k in range(grid + 1))
    each = rows.join(start, by).select(*by, "_t0", F.col("_f").alias("_f0"), *ys, "_t", F.explode(F.expr(f"transform(array({tries}), x -> x * _f)")).alias("_f"))
    waves = each.select(*by, "_t0", "_f0", "_f", *ys, *_named({"s": "sin(2D * pi() * _f * (_t - _t0))", "c": "cos(2D * pi() * _f * (_t - _t0))"}))
    total = waves.groupBy(*by, "_t0", "_f0", "_f").agg(*_named({**_fixed_sums(ys), **_normal_sums("s", "c", ys)}))
    errors = total.select(*by, "_t0", "_f0", "_f", F.expr(_solve(ys)[2]).alias("_e")).filter("_e IS NOT NULL")
    best = errors.groupBy(*by, "_t0", "_f0").agg(F.min(F.struct("_e", "_f"))["_f"].alias("_f"))
    empty = [F.lit(None).cast("double").alias(f"_{v}{k}") for k in range(len(ys)) for v in "cab"]
    return best.select(*by, "_t0", (F.col("_f0") * 1.2 / grid).alias("_h"), "_f", F.lit(float("inf")).alias("_e"), F.lit(0.0).alias("_d"), *empty)


def _step_frequency(rows: DataFrame, state: DataFrame, by: list[str], ys: list[str]) -> DataFrame:
    """Judge the proposed frequency ``_f + _d`` from one pass over the rows, and propose the next one.

    The slope of the model by frequency is 2πu(a·cos − b·sin). The part of it that offset, sine and cosine can
    explain is taken out, so the step is that of all unknowns together.
    """
    w = "2D * pi() * (_f + _d) * (_t - _t0)"
    waves = rows.join(state.select(*by, "_t0", "_f", "_d"), by).select(*by, *ys, *_named({"u": "_t - _t0", "s": f"sin({w})", "c": f"cos({w})"}))
    sums = {**_fixed_sums(ys), **_normal_sums("s", "c", ys), "us": "sum(u * s)", "uc": "sum(u * c)", "uss": "sum(u * s * s)", "usc": "sum(u * s * c)",
            "ucc": "sum(u * c * c)", "vss": "sum(u * u * s * s)", "vsc": "sum(u * u * s * c)", "vcc": "sum(u * u * c * c)"}
    for y in ys:
        sums.update({f"{y}us": f"sum({y} * u * s)", f"{y}uc": f"sum({y} * u * c)"})
    det, found, error = _solve(ys)
    solved = {"_det": det, "_error": error, **{f"_n{v}{k}": x for k, xs in enumerate(found) for v, x in zip("cab", xs)}}
    along, across = [], []
    for k, y in enumerate(ys):
        o, a, b = (f"_n{v}{k}" for v in "cab")
        slope = [f"({a} * uc - {b} * us)", f"({a} * usc - {b} * uss)", f"({a} * ucc - {b} * usc)"]
        along.append(f"{a} * {y}uc - {b} * {y}us - ({o} * {slope[0]} + {a} * {slope[1]} + {b} * {slope[2]})")
        inside = " + ".join(f"{v} * {x}" for v, x in zip(slope, _cramer(_normal(), "_det", slope)))
        across.append(f"{a} * {a} * vcc - 2D * {a} * {b} * vsc + {b} * {b} * vss - ({inside})")
    total = waves.groupBy(*by).agg(*_named(sums)).select("*", *_named(solved))
    total = total.select(*by, *[n for n in solved if n != "_det"], *_named({"_along": " + ".join(along), "_across": " + ".join(across)}))
    step = "CASE WHEN _across > 0 THEN _along / (_across * 2D * pi()) ELSE 0D END"
    take, bound = "coalesce(_error <= _e, false)", "least(_h, (_f + _d) / 2)"
    after = {"_f": f"if({take}, _f + _d, _f)", "_e": f"if({take}, _error, _e)", "_d": f"if({take}, greatest(-{bound}, least({bound}, {step})), _d / 2)",
             **{f"_{v}{k}": f"if({take}, _n{v}{k}, _{v}{k})" for k in range(len(ys)) for v in "cab"}}
    return state.join(total, by).select(*by, "_t0", "_h", *_named(after))
