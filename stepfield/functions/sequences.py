"""Number sequences, vector sequences and lattices (H-14, H-15, H-16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.functions.vec import col


#: A quotient this close to a whole number (relative to it) counts as whole: a few units in the last place.
_WHOLE = 2.0**-50


def _points(spec: list) -> tuple[list[Column], list]:
    """The numbers of a sequence, and what stands in each gap between two of them: None, ``...`` or a count."""
    numbers, gaps, gap = [], [], None
    for entry in spec:
        if isinstance(entry, (list, str)):
            if gap is not None or not numbers:
                raise ValueError("a marker needs a number on either side")
            gap = "..." if entry in ([], "...") else entry[0] if len(entry) == 1 else None
            if gap != "..." and (not isinstance(gap, int) or gap < 1):
                raise ValueError("a subdivision is a list of one positive integer")
        else:
            if numbers:
                gaps.append(gap)
            numbers.append(entry if isinstance(entry, Column) else F.lit(float(entry)))
            gap = None
    if gap is not None:
        raise ValueError("a marker needs a number on either side")
    return numbers, gaps


def _grid(start: Column, step: Column, first: int, n: Column, end: Column) -> Column:
    """start + i * step for i from ``first`` to n, where the n-th value is ``end`` itself."""
    return F.transform(F.sequence(F.lit(first).cast("int"), n), lambda i: F.when(i == n, end).otherwise(start + i * step))


def float_set(spec: list, unit: float = 1.0) -> Column:
    """Array column from ``[0, 1, [], 5]`` (go on in equal steps), ``[0, [5], 1]`` (equal parts) or a mix.

    Entries may be numbers or columns; ``[]`` and ``"..."`` mean the same. The last number of a stretch is
    always met exactly, if need be by a shorter last step.
    """
    numbers, gaps = _points(spec)
    pieces = [F.array(numbers[0])] if numbers else []
    for i, gap in enumerate(gaps):
        here, end = numbers[i], numbers[i + 1]
        if gap is None:
            pieces.append(F.array(end))
        elif gap == "...":
            if i == 0 or gaps[i - 1] is not None:
                raise ValueError("two numbers are needed before a continuation")
            start, step = numbers[i - 1], here - numbers[i - 1]
            steps = (end - start) / step
            whole = F.abs(steps - F.rint(steps)) <= steps * _WHOLE
            n = F.when(whole, F.rint(steps)).otherwise(F.ceil(steps)).cast("int")
            short = F.raise_error(F.lit("the second value must lie between first and last")).cast("array<double>")
            pieces.append(F.when(n >= 2, _grid(start, step, 2, F.greatest(n, F.lit(2)), end)).otherwise(short))
        else:
            pieces.append(_grid(here, (end - here) / gap, 1, F.lit(gap), end))
    out = F.concat(*pieces) if pieces else F.array().cast("array<double>")
    return out if unit == 1.0 else F.transform(out, lambda x: x * unit)


def vector_set(norms: list, direction: list[float], normalise: bool = True, unit: float = 1.0) -> Column:
    """Array of vectors along ``direction``, one per value of the sequence ``norms``."""
    n = sum(d * d for d in direction) ** 0.5 if normalise else 1.0
    u = [d / n for d in direction]
    return F.transform(float_set(norms, unit), lambda x: F.array(*[x * d for d in u]))


@dataclass(frozen=True)
class Lattice:
    """A regular grid: (min, max, number of points) per axis."""

    axes: tuple[tuple[float, float, int], ...]
    names: tuple[str, ...] = ("x", "y", "z")
    order: str = "F"

    @staticmethod
    def parse(spec: str, names=None, order="F") -> "Lattice":
        """From text ``min,max,n/min,max,n/…``; one number is an axis of a single point."""
        axes = []
        for piece in spec.split("/"):
            v = [x.strip() for x in piece.split(",")]
            if len(v) == 1:
                axes.append((float(v[0]), float(v[0]), 1))
            elif len(v) == 3:
                axes.append((float(v[0]), float(v[1]), int(v[2])))
            else:
                raise ValueError(f"axis {piece!r}: expected min,max,n")
        return Lattice(tuple(axes), tuple(names or ("x", "y", "z", "w")[: len(axes)]), order)

    @property
    def count(self) -> int:
        n = 1
        for _, _, k in self.axes:
            n *= k
        return n

    def steps(self) -> list[float]:
        return [(b - a) / (n - 1) if n > 1 else 0.0 for a, b, n in self.axes]

    def scaled(self, k: float) -> "Lattice":
        return Lattice(tuple((a * k, b * k, n) for a, b, n in self.axes), self.names, self.order)

    def position(self, axis: int, index) -> Column:
        a, b, n = self.axes[axis]
        return F.lit(a) if n == 1 else F.lit(a) + col(index) * ((b - a) / (n - 1))

    def nearest(self, axis: int, x) -> Column:
        """Nearest index of a position, halves away from zero; 0 on an axis of one point."""
        a, b, n = self.axes[axis]
        if n == 1 or a == b:
            return F.lit(0).cast("bigint")
        return F.round((n - 1) * (col(x) - a) / (b - a)).cast("bigint")

    def sort_columns(self) -> list[str]:
        """Index columns from slowest to fastest: C order as written, F order reversed."""
        cols = ["i" + n for n in self.names]
        return cols if self.order == "C" else cols[::-1]

    def rows(self, spark: SparkSession) -> DataFrame:
        """All grid points with indices and positions, made on the executors from one number range."""
        stride, cols = 1, []
        for axis, name in enumerate(self.names):
            n = self.axes[axis][2]
            cols.append(f"(id div {stride}) % {n} AS i{name}")
            stride *= n
        out = spark.range(self.count).selectExpr(*cols)
        return out.withColumns({n: self.position(i, "i" + n) for i, n in enumerate(self.names)})


def lattice(spark: SparkSession, spec: str, names=None, order="F") -> DataFrame:
    return Lattice.parse(spec, names, order).rows(spark)


def lattice_order(df: DataFrame, order: str = "F", axes=("ix", "iy", "iz")) -> DataFrame:
    """Sort grid rows with the last (C) or the first (F) axis running fastest."""
    return df.orderBy(*(list(axes) if order == "C" else list(axes)[::-1]))
