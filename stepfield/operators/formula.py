"""Tensor formulas as columns (F-06): H(i) <- sum over j of c · T(i, j) · m(j)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the alternating symbol.
EPSILON = {(0, 1, 2): 1, (1, 2, 0): 1, (2, 0, 1): 1, (0, 2, 1): -1, (2, 1, 0): -1, (1, 0, 2): -1}


def _entry(name: str, index: tuple, local: dict):
    """A number for a local tensor, else the column entry."""
    if name == "eps":
        return EPSILON.get(index, 0)
    if name == "delta":
        return int(index[0] == index[1])
    if name in local:
        v = local[name]
        for i in index:
            v = v[i]
        return v
    c = F.col(name)
    for i in index:
        c = c[i]
    return c


def expand(lhs: tuple, terms: list, ranges: dict[str, int], local: dict | None = None) -> dict[tuple, Column]:
    """Columns per index tuple of the left-hand side.

    ``terms`` is a list of (coefficient, [(tensor, index, …), …]); an index is a name from ``ranges``
    or a number. Indices that the left-hand side lacks are summed. Products with a zero are left out
    and numbers are multiplied beforehand.
    """
    local = local or {}
    free = list(lhs)
    out = {}
    for values in itertools.product(*[range(ranges[i]) for i in free]):
        bound = dict(zip(free, values))
        parts: list[Column] = []
        constant = 0.0
        for coefficient, factors in terms:
            names = list(dict.fromkeys(i for f in factors for i in f[1:] if isinstance(i, str) and i not in bound))
            for inner in itertools.product(*[range(ranges[i]) for i in names]):
                at = {**bound, **dict(zip(names, inner))}
                number = float(coefficient) if isinstance(coefficient, (int, float)) else 1.0
                columns = [] if isinstance(coefficient, (int, float)) else [coefficient]
                for f in factors:
                    v = _entry(f[0], tuple(at[i] if isinstance(i, str) else i for i in f[1:]), local)
                    if isinstance(v, (int, float)):
                        number *= v
                    else:
                        columns.append(v)
                if number == 0.0:
                    continue
                if not columns:
                    constant += number
                    continue
                product = reduce(lambda a, b: a * b, columns)
                parts.append(product if number == 1.0 else product * number)
        if constant or not parts:
            parts.append(F.lit(constant))
        out[values] = reduce(lambda a, b: a + b, parts)
    return out


def formula(df: DataFrame, name: str, lhs: tuple, terms: list, ranges: dict[str, int], local: dict | None = None) -> DataFrame:
    """Add the result as a scalar, an array or an array of arrays, by the rank of the left-hand side."""
    cells = expand(lhs, terms, ranges, local)
    if not lhs:
        return df.withColumn(name, cells[()])
    if len(lhs) == 1:
        return df.withColumn(name, F.array(*[cells[(i,)] for i in range(ranges[lhs[0]])]))
    if len(lhs) == 2:
        rows = [F.array(*[cells[(i, j)] for j in range(ranges[lhs[1]])]) for i in range(ranges[lhs[0]])]
        return df.withColumn(name, F.array(*rows))
    raise ValueError("the left-hand side has rank 2 at most")
