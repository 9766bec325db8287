"""Key lookups that survive hot keys, and checks that ride along with the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table``, which holds each key once; adaptive execution splits the partitions of hot keys.

    Both sides may grow with the data, so both are shuffled: a size estimated from the files leaves out what
    ``explode`` makes of them, and a side taken for small would go whole through the driver.
    """
    return rows.join(table.hint("merge"), on, how)


def matched(rows: DataFrame, table: DataFrame, on: list[str], message: str, few: bool = False) -> DataFrame:
    """``lookup`` in which a row without a partner stops the job as soon as one of the table's columns is used.

    ``few`` marks a catalog with few keys, to which very many rows each may belong: only the catalog may be broadcast.
    """
    table = table.withColumn("_hit", F.lit(True))
    out = rows.join(table, on, "left") if few else lookup(rows, table, on, "left")
    found = F.col("_hit").isNotNull()
    return out.withColumns({f.name: need(F.col(f.name), message, f.dataType.simpleString(), found)
                            for f in table.schema if f.name not in on}).drop("_hit")


def demand(df: DataFrame, bad, message: str) -> None:
    """Raise when any row satisfies ``bad``; for small tables, as it runs their plan."""
    if df.filter(bad).limit(1).count():
        raise ValueError(message)


def need(value: Column, message: str, kind: str, ok: Column | None = None) -> Column:
    """The value itself; a row where it is NULL (or ``ok`` fails) stops the job that computes it."""
    good = value.isNotNull() if ok is None else ok
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)).cast(kind))
