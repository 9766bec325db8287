"""Schedules over clock columns (P-26, P-27, H-13, ST-08).

``at`` and ``every`` combine with ``|`` and ``&``. A schedule turns into a Boolean column (does a
row match?) or into the next time after a row. The tree only lives on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NEAR = 2.0 ** -52


def is_integer(q) -> Column:
    """True when ``q`` is at most ``NEAR`` away from a whole number."""
    q = F.col(q) if isinstance(q, str) else q
    return F.abs(q - F.rint(q)) <= NEAR


class When:
    """Base of all schedules."""

    def __or__(self, other):
        return AnyOf(self, other)

    def __and__(self, other):
        return AllOf(self, other)

    def variables(self) -> set[str]:
        raise NotImplementedError

    def matches(self, value=F.col) -> Column:
        """Boolean column; ``value`` maps a clock name to a column."""
        raise NotImplementedError

    def next_time(self, var: str, value=F.col) -> Column:
        """Next value of ``var`` after the row, NULL when there is none. A schedule that does not
        involve ``var`` gives a Boolean column instead."""
        raise NotImplementedError


@dataclass
class At(When):
    var: str
    point: object = True

    def variables(self):
        return {self.var}

    def matches(self, value=F.col):
        return value(self.var) == F.lit(self.point)

    def next_time(self, var, value=F.col):
        if var != self.var:
            return F.lit(True)
        if isinstance(self.point, bool):
            return value(var) == F.lit(self.point)
        return F.when(value(var) < self.point, F.lit(float(self.point)))


@dataclass
class Every(When):
    var: str
    delta: float | None = None
    first: float = 0
    last: float | None = None

    def __post_init__(self):
        if self.last is not None and self.last <= self.first:
            raise ValueError("last must be greater than first")
        if self.delta is not None and self.delta <= 0:
            raise ValueError("delta must be positive")

    def variables(self):
        return {self.var}

    def _steps(self, t):
        return (t.cast("double") - float(self.first)) / float(self.delta)

    def matches(self, value=F.col):
        t = value(self.var)
        ok = t >= self.first
        if self.last is not None:
            ok = ok & (t <= self.last)
        return ok if self.delta is None else ok & is_integer(self._steps(t))

    def next_time(self, var, value=F.col):
        if var != self.var:
            return self.matches(value)
        t = value(var)
        if self.delta is None:
            return F.lit(True) if self.last is None else t < self.last
        q = self._steps(t)
        passed = F.when(is_integer(q), F.rint(q)).otherwise(F.floor(q).cast("double"))
        nxt = F.when(t < self.first, F.lit(float(self.first))).otherwise(
            (passed + 1.0) * float(self.delta) + float(self.first))
        return nxt if self.last is None else F.when((t < self.last) & (nxt <= self.last), nxt)


@dataclass
class AnyOf(When):
    a: When
    b: When

    def variables(self):
        return self.a.variables() | self.b.variables()

    def matches(self, value=F.col):
        return self.a.matches(value) | self.b.matches(value)

    def next_time(self, var, value=F.col):
        timed = [w for w in (self.a, self.b) if _timed(w, var)]
        nexts = [w.next_time(var, value) for w in timed]
        if len(nexts) == 2:
            return F.least(*nexts)
        return nexts[0] if nexts else self.a.next_time(var, value) | self.b.next_time(var, value)


@dataclass
class AllOf(When):
    a: When
    b: When

    def variables(self):
        return self.a.variables() | self.b.variables()

    def matches(self, value=F.col):
        return self.a.matches(value) & self.b.matches(value)

    def next_time(self, var, value=F.col):
        ta, tb = _timed(self.a, var), _timed(self.b, var)
        if ta and tb:
            return self._common(var, value)
        na, nb = self.a.next_time(var, value), self.b.next_time(var, value)
        if ta:
            return F.when(nb, na)
        if tb:
            return F.when(na, nb)
        return na & nb

    def _common(self, var, value):
        """Common points of two schedules over one variable: the rules of the one, each narrowed to the other."""
        plain, other = sorted((self.a, self.b), key=lambda w: not isinstance(w, Every))
        if not isinstance(plain, Every) or plain.delta is None:
            raise ValueError("& over one variable needs a plain every() on one side")
        both = _narrowed(other, plain)
        return both.next_time(var, value) if _timed(both, var) else F.lit(None).cast("double")


def _narrowed(w: When, rule: Every) -> When:
    """The points of ``w`` at which ``rule`` holds too, as a schedule again."""
    if isinstance(w, AnyOf):
        return AnyOf(_narrowed(w.a, rule), _narrowed(w.b, rule))
    if isinstance(w, AllOf):
        inner, outer = (w.a, w.b) if _timed(w.a, rule.var) else (w.b, w.a)
        return AllOf(_narrowed(inner, rule), outer)
    if not _timed(w, rule.var):
        return AllOf(w, rule)
    return _meeting(w, rule) if isinstance(w, Every) else w if _holds(rule, w.point) else never


def _exact(x) -> Fraction:
    return Fraction(str(x))


def _holds(rule: Every, point) -> bool:
    t, inside = _exact(point), rule.last is None or point <= rule.last
    return t >= _exact(rule.first) and inside and (t - _exact(rule.first)) % _exact(rule.delta) == 0


def _meeting(a: Every, b: Every) -> When:
    """Two progressions meet in one progression or nowhere (Chinese remainders, in exact fractions)."""
    parts = [_exact(x) for x in (a.first, a.delta, b.first, b.delta)]
    scale = math.lcm(*[x.denominator for x in parts])
    f, d, g, e = [int(x * scale) for x in parts]
    common = math.gcd(d, e)
    if (g - f) % common:
        return never
    step = d * e // common
    first = f + (g - f) // common * pow(d // common, -1, e // common) % (e // common) * d
    first += max(0, -(-(max(f, g) - first) // step)) * step
    ends = [x for x in (a.last, b.last) if x is not None]
    start, last = first / scale, min(ends) if ends else None
    if last is not None and last <= start:
        return At(a.var, start) if last == start else never
    return Every(a.var, step / scale, start, last)


class Never(When):
    def variables(self):
        return set()

    def matches(self, value=F.col):
        return F.lit(False)

    def next_time(self, var, value=F.col):
        return F.lit(False)


never = Never()


def _leaves(w):
    return _leaves(w.a) + _leaves(w.b) if isinstance(w, (AnyOf, AllOf)) else [w]


def _timed(w: When, var: str) -> bool:
    """Does the schedule yield a time (and not a truth value) for ``var``?"""
    if isinstance(w, At):
        return w.var == var and not isinstance(w.point, bool)
    if isinstance(w, Every):
        return w.var == var and w.delta is not None
    if isinstance(w, (AnyOf, AllOf)):
        return _timed(w.a, var) or _timed(w.b, var)
    return False


def at(var: str, point=True) -> At:
    return At(var, point)


def every(a, b=None, first=0, last=None) -> Every:
    """``every('step', 10)`` or ``every(10, 'step')``."""
    var, delta = (a, b) if isinstance(a, str) else (b, a)
    if not isinstance(var, str):
        raise ValueError("every() needs the name of a clock column")
    return Every(var, delta, first, last)


def where_when(df: DataFrame, w: When) -> DataFrame:
    return df.filter(w.matches())


def next_time(df: DataFrame, w: When, var: str, out: str = "next", tolerance: float = 0.0) -> DataFrame:
    """Add the next time of the schedule; one nearer than ``tolerance`` is passed over."""
    nxt = w.next_time(var)
    if tolerance > 0:
        skip = w.next_time(var, lambda n: nxt + tolerance if n == var else F.col(n))
        nxt = F.when(F.abs(nxt - F.col(var)) < tolerance, skip).otherwise(nxt)
    return df.withColumn(out, nxt)


def next_deltas(df: DataFrame, schedules: list[When], var: str, out: str = "delta") -> DataFrame:
    """Add the time from the row to the nearest next event over several schedules."""
    gaps = [w.next_time(var) - F.col(var) for w in schedules if _timed(w, var)]
    return df.withColumn(out, F.least(*gaps) if len(gaps) > 1 else gaps[0])
