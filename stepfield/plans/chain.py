"""Follow pointers forwards through ordered rows.

Some scans depend on the row accepted last (a throttle, blocks of a minimal length). Each row then
points to the row that would be accepted next, and the accepted rows are those on the path from the
first row. Short runs are walked in one task each. A long run is cut into pieces: every row first
learns where its path leaves the piece, these exits are composed by doubling, and the pieces are
then walked independently from their entry rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.plans.ordered import ROWS_PER_TASK, largest_group
from stepfield.session import cut_lineage


def on_path(df: DataFrame, by: list[str], pos: str, nxt: str, rows_per_task: int | None = None, size=None) -> DataFrame:
    """Keep the rows reached from position 1 of each run.

    ``pos`` numbers the rows of a run 1, 2, …; ``nxt`` is a larger position or NULL.
    Returns the key columns and ``pos`` of the rows reached.
    """
    limit = rows_per_task or ROWS_PER_TASK
    keys = df.select(*by, pos, nxt).withColumn("_piece", F.floor((F.col(pos) - 1) / limit).cast("bigint"))
    largest, _ = size or largest_group(df, by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, pos).schema)
    if largest <= limit:
        entries = keys.withColumn("_entry", F.col(pos) == 1)
    else:
        keys = cut_lineage(keys)
        entries = _entries(keys, by, pos, nxt, math.ceil(largest / limit))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        places = pdf[pos].to_numpy()
        target = pdf[nxt].to_numpy(dtype="float64", na_value=np.nan)
        start = np.flatnonzero(pdf["_entry"].to_numpy(dtype=bool))
        taken = []
        i = int(start[0]) if len(start) else len(places)
        while i < len(places):
            taken.append(i)
            if np.isnan(target[i]):
                break
            i = int(np.searchsorted(places, int(target[i])))
        return pdf.loc[taken, [*by, pos]]

    return entries.groupBy(*by, "_piece").applyInPandas(walk, schema)


def _entries(keys, by, pos, nxt, pieces):
    """Flag, in every piece, the row by which the path from the first row comes in."""
    types = {f.name: f.dataType.simpleString() for f in keys.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, pos]) + ", _exit bigint"

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        places = pdf[pos].to_numpy()
        target = pdf[nxt].to_numpy(dtype="float64", na_value=np.nan)
        out = target.copy()
        inside = np.searchsorted(places, np.nan_to_num(target, nan=float(places[-1] + 1)))
        for i in range(len(places) - 1, -1, -1):
            if inside[i] < len(places):
                out[i] = out[inside[i]]
        return pdf[[*by, pos]].assign(_exit=pd.array(out, dtype="Float64").astype("Int64"))

    jump = cut_lineage(keys.groupBy(*by, "_piece").applyInPandas(leave, schema))
    jumps = [jump]
    for _ in range(max(0, math.ceil(math.log2(max(pieces, 1))))):
        last = jumps[-1]
        onward = last.select(*by, F.col(pos).alias("_exit"), F.col("_exit").alias("_far"))
        jumps.append(cut_lineage(last.join(onward, [*by, "_exit"], "left").select(*by, pos, F.col("_far").alias("_exit"))))
    found = jump.filter(F.col(pos) == 1).select(*by, pos)
    for j in reversed(jumps):
        step = found.join(j, [*by, pos]).filter("_exit is not null").select(*by, F.col("_exit").alias(pos))
        found = cut_lineage(found.unionByName(step).distinct())
    return keys.join(found.withColumn("_hit", F.lit(True)), [*by, pos], "left").select(
        *by, pos, nxt, "_piece", F.coalesce("_hit", F.lit(False)).alias("_entry"))
