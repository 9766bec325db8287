"""Restart of stopped runs at a stage (ST-05).

A stream keeps for each run the stage it is in and whether that stage has converged. After a stop this state is read from the
checkpoint as a table: runs go on at their stage, or at the next one if it has converged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.streaming import live as L
from stepfield.streaming import ordered as O


def stage_step(stage: str, column: str, stop: float, by: list[str], order: list[str], countdown: int = 2):
    """State: stage, how many low values end the rows so far, whether the stage has converged, the last clock."""
    def detect(carried, pdf):
        stages, row = pdf[stage].to_numpy(), np.arange(len(pdf))
        low = pdf[column].to_numpy(dtype="float64", na_value=np.nan) < stop
        at, many, over = carried[:3] if carried else (None, 0, False)
        new = np.concatenate([[at is None or stages[0] != at], stages[1:] != stages[:-1]])
        # The last row that does not count for the low values that end at a row; before the first one, as far back as ``many``.
        reset = np.where(~low, row, np.where(new, row - 1, -1 - many))
        count = row - np.maximum.accumulate(reset)
        part, hit = np.cumsum(new), low & (count >= countdown)
        if over:
            hit &= part > 0
        _, first = np.unique(part[hit], return_index=True)
        places = np.flatnonzero(hit)[first]
        done = bool((over and part[-1] == 0) or (len(places) and part[places[-1]] == part[-1]))
        clock = pdf[order[0]].iloc[-1]
        clock = clock.to_pydatetime() if isinstance(clock, pd.Timestamp) else clock.item()
        return (int(stages[-1]), int(min(count[-1], countdown)), done, clock), pdf[[*by, *order, stage]].iloc[places]

    return detect


def stages_converged(sdf: DataFrame, stage: str, column: str, stop: float, by: list[str], order: list[str], countdown: int = 2,
                     lateness: O.Lateness | None = None) -> DataFrame:
    """The row at which a stage of a run converges, its first after ``countdown`` values below ``stop`` in a row: by, order, stage.

    Batches come in order, or with ``lateness`` out of order. Stages are whole numbers that never fall within a run.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sdf.schema}
    state = f"stage bigint, low int, converged boolean, last {kinds[order[0]]}"
    schema = L.schema_of(sdf, [*by, *order, stage])
    step = stage_step(stage, column, stop, by, order, countdown)
    if lateness is None:
        return L._scan(sdf.select(*by, *order, stage, column), step, state, schema, by, order)
    return O.scan(sdf.select(*dict.fromkeys([*by, *order, stage, column, lateness.column])), step, state, schema, by, order, lateness)


def saved_stages(spark: SparkSession, checkpoint: str, by: list[str], lateness: O.Lateness | None = None) -> DataFrame:
    """The state of a stopped ``stages_converged``: by, stage, converged, last (clock of the last row).

    With ``lateness`` these are the rows that the watermark has passed; later ones still wait in the checkpoint.
    """
    reader = spark.read.format("statestore")
    if lateness is None:
        state = reader.load(checkpoint)
        held, run = F.col("value")["groupState"], [F.col("key")[k].alias(k) for k in by]
    else:
        state = reader.option("stateVarName", "carried").load(checkpoint)
        held = F.col("list_element")
        run = [held[f"by{i}"].alias(k) for i, k in enumerate(by)]
    return state.filter(held["stage"].isNotNull()).select(*run, *[held[c].alias(c) for c in ("stage", "converged", "last")])


def resume_points(plan: DataFrame, saved: DataFrame, by: list[str]) -> DataFrame:
    """Where each run of a plan (by, stage) goes on: by, stage, converged, last, go_on.

    The saved stage unless it has converged, else the plan's next one, NULL when nothing is left. A run that has no saved
    state begins at its first stage.
    """
    have = saved.select(*by, F.col("stage").alias("_at"), "converged", "last")
    rows = plan.select(*by, "stage").distinct().join(have, by, "left")
    left = F.col("_at").isNull() | (F.col("stage") > F.col("_at")) | ((F.col("stage") == F.col("_at")) & ~F.col("converged"))
    return rows.groupBy(*by).agg(F.max("_at").alias("stage"), F.max("converged").alias("converged"), F.max("last").alias("last"),
                                 F.min(F.when(left, F.col("stage"))).alias("go_on"))


def resume_rows(rows: DataFrame, points: DataFrame, by: list[str], stage: str) -> DataFrame:
    """Rows of a table from the stage on at which their run goes on."""
    here = points.filter("go_on is not null").select(*by, F.col("go_on").alias("_go_on"))
    return rows.join(here, by).filter(F.col(stage) >= F.col("_go_on")).drop("_go_on")
