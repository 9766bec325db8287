"""Array and vector columns (H-01 … H-04, H-10 … H-12, H-21 … H-24).

``d`` gives the length where it is known: the expression is then unrolled and stays in generated
code. Without it higher-order functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parts(a, d: int) -> list[Column]:
    """The first ``d`` entries of an array column."""
    a = col(a)
    return [a[i] for i in range(d)]


def total(terms) -> Column:
    terms = list(terms)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def dot(a, b, d: int | None = None) -> Column:
    if d:
        return total(x * y for x, y in zip(parts(a, d), parts(b, d)))
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm2(a, d=None) -> Column:
    return dot(a, a, d)


def norm(a, d=None) -> Column:
    return F.sqrt(norm2(a, d))


def scale(a, k) -> Column:
    return F.transform(col(a), lambda x: x * k)


def unit(a, d=None) -> Column:
    """Vector over its norm; a zero vector gives NULL."""
    n = norm(a, d)
    return F.when(n > 0, F.transform(col(a), lambda x: x / n))


normalise = unit


def project(axis, v, d=None) -> Column:
    """Length of ``v`` along ``axis``."""
    return dot(axis, v, d) / F.nullif(norm(axis, d), F.lit(0.0))


def cross(a, b) -> Column:
    x, y = parts(a, 3), parts(b, 3)
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def dist2(a, b, d=None) -> Column:
    if d:
        return total((x - y) * (x - y) for x, y in zip(parts(a, d), parts(b, d)))
    squares = F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def safe_ratio(a, b, f=1.0) -> Column:
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(F.abs(f * col(a) / col(b)))


def epsilon(i, j, k) -> Column:
    """Alternating symbol for indices 0, 1, 2."""
    i, j, k = col(i), col(j), col(k)
    return ((j - i) * (k - i) * (k - j) / 2).cast("int")


def delta(i, j) -> Column:
    return (col(i) == col(j)).cast("int")


def round_sig(x, n: int) -> Column:
    """Round to ``n`` significant digits."""
    x = col(x)
    p = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * p) / p)


def deg(x) -> Column:
    return F.degrees(col(x))


def rad(x) -> Column:
    return F.radians(col(x))


def gcd(a, b) -> Column:
    """Greatest common divisor by at most 92 Euclid steps, enough for any two BIGINTs."""
    a, b = F.abs(col(a)), F.abs(col(b))
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.struct(
        F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
        F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % s["b"]).alias("b"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a, b) -> Column:
    g = gcd(a, b)
    # a over g is exact; as decimals, so that no step goes through a double.
    part = F.abs(col(a)).cast("decimal(19,0)") / F.nullif(g, F.lit(0)).cast("decimal(19,0)")
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(part.cast("bigint") * F.abs(col(b)).cast("bigint"))


def shift(pos, by: list[float]) -> Column:
    return F.array(*[p + float(s) for p, s in zip(parts(pos, len(by)), by)])


def scale_by(pos, factors) -> Column:
    """Scale by one factor or one per axis."""
    if isinstance(factors, (int, float)):
        return F.transform(col(pos), lambda x: x * float(factors))
    return F.array(*[p * float(f) for p, f in zip(parts(pos, len(factors)), factors)])


def rotate(pos, d: int, angle: float, plane=(0, 1)) -> Column:
    """Rotate in a coordinate plane by ``angle`` radians."""
    p = parts(pos, d)
    i, j = plane
    c, s = math.cos(angle), math.sin(angle)
    out = list(p)
    out[i] = p[i] * c - p[j] * s
    out[j] = p[i] * s + p[j] * c
    return F.array(*out)


def rotate_about(pos, axis: list[float], angle: float) -> Column:
    """Rotate 3-vectors about ``axis``."""
    n = math.sqrt(sum(a * a for a in axis))
    u = [a / n for a in axis]
    c, s = math.cos(angle), math.sin(angle)
    p = parts(pos, 3)
    along = total(a * x for a, x in zip(u, p))
    turned = [u[1] * p[2] - u[2] * p[1], u[2] * p[0] - u[0] * p[2], u[0] * p[1] - u[1] * p[0]]
    return F.array(*[x * c + t * s + a * along * (1 - c) for x, t, a in zip(p, turned, u)])


# The words that users type for an axis and for a part of a complex number.
_AXES = {"x": 0, "y": 1, "z": 2}
_COMPLEX = {"complex": "all", "identity": "all", "abs": "size", "norm": "size", "mod": "size", "modulus": "size",
            "real": "re", "imag": "im", "imaginary": "im"}


def _without(v, axis: int, d: int | None) -> Column:
    """Norm of a vector without one of its components."""
    return F.sqrt(F.greatest(norm2(v, d) - col(v)[axis] * col(v)[axis], F.lit(0.0))) if d is None else F.sqrt(
        total(p * p for p in parts(v, d)[:axis] + parts(v, d)[axis + 1:]))


def vec_filter(v, spec: str, d: int | None = None) -> Column:
    """``identity``, ``norm``, ``component,n`` (or x, y, z), ``projection,n`` (norm without axis n)."""
    words = [w.strip().lower() for w in spec.split(",")]
    axis = _AXES.get(words[1], words[1]) if len(words) == 2 else None
    made = {("identity", False): lambda: col(v), ("norm", False): lambda: norm(v, d), ("component", True): lambda: col(v)[int(axis)],
            ("projection", True): lambda: _without(v, int(axis), d), ("proj", True): lambda: _without(v, int(axis), d)}
    if (words[0], axis is not None) not in made:
        raise ValueError(f"unknown vector filter {spec!r}")
    return made[words[0], axis is not None]()


def complex_filter(c, mode: str) -> Column:
    """Struct (re, im) to a real number, or unchanged for ``complex``."""
    part = _COMPLEX.get(mode)
    if part is None:
        raise ValueError(f"unknown complex filter {mode!r}")
    c = col(c)
    return c if part == "all" else F.hypot(c["re"], c["im"]) if part == "size" else c[part]
