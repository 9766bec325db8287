"""User functions (F-01 … F-05) and the derived-quantity graph (F-07)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def site_wise(df: DataFrame, fn: Callable[..., dict[str, Column]], params: dict | None = None,
              accumulate: dict[str, Column] | None = None, by=()) -> DataFrame:
    """Apply a function of columns at every site: it gets each column and parameter by name and returns
    new columns. With ``accumulate`` the aggregates over them are returned instead, per ``by``."""
    args = {c: F.col(c) for c in df.columns}
    args.update({k: F.lit(v) for k, v in (params or {}).items()})
    out = df.withColumns(fn(**{k: args[k] for k in fn.__code__.co_varnames[: fn.__code__.co_argcount]}))
    if not accumulate:
        return out
    return out.groupBy(*by).agg(*[c.alias(k) for k, c in accumulate.items()])


def as_numpy(column: pa.Array) -> np.ndarray:
    """Numbers of an Arrow column; a list column becomes a matrix as wide as its longest list, NaN where a list is shorter or missing."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.full((len(column), lengths.max(initial=0)), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def batch_aggregate(df: DataFrame, fn: Callable[..., dict[str, np.ndarray]], columns: list[str], results: dict[str, str], by: list[str]) -> DataFrame:
    """Aggregates of a function that is no column expression, in two phases.

    ``fn`` gets the ``columns`` of a batch as numpy arrays and returns named arrays with one number per row; ``results``
    tells how each is merged: ``sum``, ``min`` or ``max``. A batch is reduced per key within its task, so that at most one row
    per key and batch is shuffled and no group is gathered. NaN and null count as missing: a key with nothing else gives null.
    NULL is a key like any other.
    """
    if not by:
        raise ValueError("by names at least one column")
    if wrong := {how for how in results.values() if how not in MERGES}:
        raise ValueError(f"unknown ways to merge: {sorted(wrong)}")
    if both := set(by) & set(results):
        raise ValueError(f"names of keys and results clash: {sorted(both)}")
    schema = T.StructType([df.schema[k] for k in by] + [T.StructField(n, T.DoubleType()) for n in results])

    def partial(batches):
        for batch in batches:
            made = fn(*[as_numpy(batch.column(c)) for c in columns])
            numbers = {n: pa.array(np.asarray(made[n], dtype=np.float64), from_pandas=True) for n in results}
            rows = pa.table({**{k: batch.column(k) for k in by}, **numbers})
            found = rows.group_by(by).aggregate(list(results.items()))
            found = found.select([*by, *[f"{n}_{how}" for n, how in results.items()]]).rename_columns([*by, *results])
            yield from found.combine_chunks().to_batches()

    parts = df.select(*dict.fromkeys([*by, *columns])).mapInArrow(partial, schema)
    return parts.groupBy(*by).agg(*[MERGES[how](n).alias(n) for n, how in results.items()])


def of_position(fn: Callable[[pd.Series], pd.Series], returns: str = "double"):
    """Arrow function of a position column."""
    def call(pos: pd.Series) -> pd.Series:
        return fn(pos)

    return F.pandas_udf(call, returns)


def set_from_pos(points: DataFrame, fn: Callable[[pd.Series], pd.Series], out: str = "value") -> DataFrame:
    """Value from the position; a result that is not a number becomes 0."""
    value = of_position(lambda pos: pd.to_numeric(fn(pos), errors="coerce").astype("float64"))(F.col("pos"))
    return points.withColumn(out, F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value))


def for_entries(entries: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call a function on batches of entry rows (subfield, comp, site, …)."""
    def batches(it):
        for pdf in it:
            yield fn(pdf)

    return entries.mapInPandas(batches, schema)


ACTIONS: dict[str, Callable[[DataFrame, int], None]] = {}


def register_action(name: str, fn: Callable[[DataFrame, int], None]) -> None:
    """Name a function (rows, batch id) for use in schedules; a second one of that name is an error."""
    if name in ACTIONS:
        raise ValueError(f"action {name!r} exists already")
    ACTIONS[name] = fn


def derive(df: DataFrame, registry: dict[str, tuple[list[str], Callable[..., Column]]], targets: list[str]) -> DataFrame:
    """Add the target quantities and what they need, in dependency order: ``registry`` maps a name to
    (names it depends on, function of their columns). What is not needed is not computed."""
    have = set(df.columns)
    levels: list[list[str]] = []
    level_of: dict[str, int] = {}

    def place(name, trail):
        if name in have:
            return -1
        if name in level_of:
            return level_of[name]
        if name in trail:
            raise ValueError("cycle: " + " -> ".join([*trail, name]))
        if name not in registry:
            raise ValueError(f"nothing is known about {name!r}")
        level = 1 + max([place(d, [*trail, name]) for d in registry[name][0]], default=-1)
        level_of[name] = level
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        return level

    for t in targets:
        place(t, [])
    for names in levels:
        df = df.withColumns({n: registry[n][1](*[F.col(d) for d in registry[n][0]]) for n in names})
    return df


def needed(registry: dict, targets: list[str], given: list[str]) -> list[str]:
    """Names that have to be computed for the targets."""
    seen: list[str] = []

    def visit(n):
        if n in given or n in seen:
            return
        for d in registry[n][0]:
            visit(d)
        seen.append(n)

    for t in targets:
        visit(t)
    return seen
