"""Permutations as tables (H-23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.operators.graph import components


def invert_perm(perm: DataFrame) -> DataFrame:
    """Swap the roles of new and original ids."""
    return perm.select(*[c for c in perm.columns if c not in ("new_pid", "orig_pid")],
                       F.col("orig_pid").alias("new_pid"), F.col("new_pid").alias("orig_pid"))


def perm_sign(perm: DataFrame, keys: list[str]) -> DataFrame:
    """Sign of each permutation: even when its length less its number of cycles is even.

    The cycles are the components of the graph new → original, so no pairs are formed.
    """
    e = perm.select(*keys, F.col("new_pid").alias("src"), F.col("orig_pid").alias("dst"))
    cycles = components(e, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("component").alias("_c"))
    return cycles.select(*keys, (1 - 2 * ((F.col("_n") - F.col("_c")) % 2)).cast("int").alias("sign"))
