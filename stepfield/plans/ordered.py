"""Ordered scans over runs of any length.

A plain window sends a whole run to one task. Here a run longer than ``rows_per_task`` is cut into
range partitions of the full order; each scan works inside the pieces and takes what it needs from
the neighbouring pieces out of a table with one row per piece.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.session import cut_lineage

ROWS_PER_TASK = 4_000_000


def largest_group(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all), from one map-side combined count."""
    if not by:
        n = df.count()
        return n, n
    row = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


class Ordered:
    """Rows of ``df`` in runs ``by``, each totally ordered by ``order`` (unique inside a run).

    ``size`` may pass on the (largest run, all rows) known from a scan over at least these rows, so
    that they need not be counted again.
    """

    def __init__(self, df, by, order, rows_per_task=None, size=None):
        self.by, self.order = list(by), list(order)
        limit = rows_per_task or ROWS_PER_TASK
        self.size = size or largest_group(df, self.by)
        largest, total = self.size
        self.pieces = largest > limit
        if self.pieces:
            n = max(2, math.ceil(total / limit))
            df = cut_lineage(
                df.repartitionByRange(n, *self.by, *self.order).withColumn("__piece", F.spark_partition_id())
            )
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop("__piece") if self.pieces else self._df

    def map(self, fn) -> "Ordered":
        """Apply a row-wise step (projection or filter) and stay ordered."""
        self._df = fn(self._df)
        return self

    def _keys(self) -> list:
        return self.by + (["__piece"] if self.pieces else [])

    def _window(self, backwards: bool):
        cols = [F.col(c).desc() if backwards else F.col(c).asc() for c in self.order]
        keys = self._keys() or [F.lit(0)]
        return Window.partitionBy(*keys).orderBy(*cols)

    def _neighbours(self, aggregates: dict, carried: dict, backwards: bool) -> DataFrame:
        """One row per piece of a run that spans several pieces: at most two per range partition,
        so the table is bounded by the number of pieces and can be broadcast."""
        per_piece = self._df.groupBy(*self._keys()).agg(*[c.alias(k) for k, c in aggregates.items()])
        run = Window.partitionBy(*(self.by or [F.lit(0)]))
        along = run.orderBy(F.col("__piece").desc() if backwards else F.col("__piece").asc())
        return (
            per_piece.withColumn("__pieces", F.count(F.lit(1)).over(run))
            .filter("__pieces > 1")
            .select(*self._keys(), *[c(along).alias(k) for k, c in carried.items()])
        )

    def _join_neighbours(self, extra: DataFrame) -> DataFrame:
        renamed = extra.select(*[F.col(k).alias("__key_" + k) for k in self._keys()],
                               *[c for c in extra.columns if c not in self._keys()])
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("__key_" + k)) for k in self._keys()])
        return self._df.join(F.broadcast(renamed), cond, "left").drop(*["__key_" + k for k in self._keys()])

    def _shift(self, columns: dict[str, Column], backwards: bool) -> "Ordered":
        w = self._window(backwards)
        if not self.pieces:
            self._df = self._df.select("*", *[F.lag(c).over(w).alias(k) for k, c in columns.items()])
            return self
        edge = F.max_by if not backwards else F.min_by
        packed = F.struct(*[c.alias(k) for k, c in columns.items()])
        extra = self._neighbours(
            {"__edge": edge(packed, F.struct(*self.order))}, {"__edge": lambda a: F.lag("__edge").over(a)}, backwards
        )
        local = self._df.select("*", F.lag(packed).over(w).alias("__local"))
        self._df, keep = local, self._df.columns
        self._df = self._join_neighbours(extra).select(
            *keep, *[F.when(F.col("__local").isNotNull(), F.col("__local")[k]).otherwise(F.col("__edge")[k]).alias(k)
                     for k in columns]
        )
        return self

    def lag(self, **columns: Column) -> "Ordered":
        """Add ``name = value of the expression in the previous row of the run``."""
        return self._shift(columns, backwards=False)

    def lead(self, **columns: Column) -> "Ordered":
        """Add ``name = value of the expression in the next row of the run``."""
        return self._shift(columns, backwards=True)

    def running(self, backwards: bool = False, **columns: tuple[str, Column]) -> "Ordered":
        """Add running values from the start of the run to the row itself.

        Each column is ``(kind, expression)`` with kind ``sum``, ``count``, ``max``, ``min``, ``first``
        or ``last`` (the last two skip NULL). ``backwards`` scans from the end of the run.
        """
        w = self._window(backwards).rowsBetween(Window.unboundedPreceding, 0)
        inside = {k: _scan(kind, c).over(w) for k, (kind, c) in columns.items()}
        if not self.pieces:
            self._df = self._df.select("*", *[c.alias(k) for k, c in inside.items()])
            return self
        order = F.struct(*self.order)
        aggregates = {k: _total(kind, c, order, backwards) for k, (kind, c) in columns.items()}
        carried = {
            "__carry_" + k: (lambda a, k=k, kind=kind:
                        _scan("sum" if kind == "count" else kind, F.col(k))
                        .over(a.rowsBetween(Window.unboundedPreceding, -1)))
            for k, (kind, _) in columns.items()
        }
        extra = self._neighbours(aggregates, carried, backwards)
        keep = self._df.columns
        self._df = self._df.select("*", *[c.alias("__inside_" + k) for k, c in inside.items()])
        self._df = self._join_neighbours(extra).select(
            *keep, *[_combine(kind, F.col("__carry_" + k), F.col("__inside_" + k)).alias(k) for k, (kind, _) in columns.items()]
        )
        return self

    def position(self, name: str, backwards: bool = False) -> "Ordered":
        """Add the 1-based position of the row in its run."""
        return self.running(backwards, **{name: ("count", F.lit(1))})


def _scan(kind, c):
    if kind in ("first", "last"):
        return getattr(F, kind)(c, ignorenulls=True)
    return getattr(F, kind)(c)


def _total(kind, c, order, backwards):
    if kind in ("first", "last"):
        pick = F.max_by if (kind == "last") != backwards else F.min_by
        return pick(c, F.when(c.isNotNull(), order))
    return getattr(F, kind)(c)


def _combine(kind, carry, inside):
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), inside).when(inside.isNull(), carry).otherwise(carry + inside)
    if kind == "first":
        return F.coalesce(carry, inside)
    if kind == "last":
        return F.coalesce(inside, carry)
    return (F.greatest if kind == "max" else F.least)(carry, inside)


def dense_ids(df: DataFrame, by, order, out: str, rows_per_task=None, size=None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … along ``order`` without gathering a group."""
    return (
        Ordered(df, by, order, rows_per_task, size).position("_pos").df
        .withColumn(out, (F.col("_pos") - 1).cast("bigint")).drop("_pos")
    )
