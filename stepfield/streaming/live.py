"""Structured Streaming versions of the run-table scans (ST-01 … ST-07).

State is kept per run and is a few numbers, whatever the length of the run. Rows of one micro-batch
are put in order inside their run; batches must arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stepfield.functions.when import When
from stepfield.operators.calls import ACTIONS

#: A call of an action that has returned.
CALLS = "batch bigint, action string"


def run_to_end(sdf: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process all that is there into a file sink (exactly once per checkpoint) and stop."""
    start(sdf, path, checkpoint, fmt, available_now=True).awaitTermination()


def start(sdf: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False, every: str = "10 seconds"):
    """Start into a file sink. A query started again with the same checkpoint goes on where it stopped,
    with its state."""
    writer = sdf.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


# Scheduled actions

def scheduled(sdf: DataFrame, schedule: list[tuple[str, When]]) -> DataFrame:
    """One row per row and action whose schedule it matches, with the action's name. Works on streams
    and tables and keeps no state."""
    _check_names(schedule)
    hits = F.array(*[F.when(w.matches(), F.lit(name)) for name, w in schedule])
    return sdf.withColumn("action", F.explode(F.filter(hits, lambda a: a.isNotNull())))


def _check_names(schedule):
    names = [n for n, _ in schedule]
    double = {n for n in names if names.count(n) > 1}
    if double:
        raise ValueError(f"actions named twice: {sorted(double)}; join their schedules with |")


def schema_of(df: DataFrame, names: list[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{c} {fields[c]}" for c in names)


def changes_plan(sdf: DataFrame, schedule: list[tuple[str, When]], by: list[str], order: list[str], var: str, more=()):
    """Rows with what each action's schedule says of them, and the step, state and schema of the scan over them."""
    _check_names(schedule)
    names = [n for n, _ in schedule]
    plan = sdf.select(*by, *order, *[c for c in more if c not in (*by, *order)], *[w.matches().alias(f"match{i}") for i, (_, w) in enumerate(schedule)],
                      *[w.next_time(var).cast("double").alias(f"due{i}") for i, (_, w) in enumerate(schedule)])

    def fire(last, pdf):
        out = []
        for i, name in enumerate(names):
            planned = pdf[f"due{i}"].fillna(-1.0)
            before = planned.shift(fill_value=-2.0 if last is None else last[i])
            hit = pdf[pdf[f"match{i}"] | (planned != before)]
            out.append(hit[[*by, *order]].assign(action=name))
        return tuple(float(pdf[f"due{i}"].fillna(-1.0).iloc[-1]) for i in range(len(names))), pd.concat(out)

    return plan, fire, ", ".join(f"t{i} double" for i in range(len(names))), schema_of(sdf, [*by, *order]) + ", action string"


def _scan(sdf: DataFrame, step, state_schema: str, schema, by: list[str], order: list[str]) -> DataFrame:
    """A step (state, rows in order) -> (state, result) over the runs of a stream whose batches come in order."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        after, out = step(tuple(state.get) if state.exists else None, pd.concat(list(batches)).sort_values(order, ignore_index=True))
        if after is not None:
            state.update(after)
        yield out

    return sdf.groupBy(*by).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def scheduled_changes(sdf: DataFrame, schedule: list[tuple[str, When]], by: list[str], order: list[str], var: str) -> DataFrame:
    """Like ``scheduled``, and an action also fires when its predicted next ``var`` is not the one
    predicted at the row before: by, order, action."""
    plan, step, state, schema = changes_plan(sdf, schedule, by, order, var)
    return _scan(plan, step, state, schema, by, order)


def dispatch(sdf: DataFrame, checkpoint: str, available_now: bool = False, log: str | None = None):
    """Call the registered action (see ``register_action``) on its rows of each batch.

    After a failure Spark repeats the batch. With ``log`` (a folder that belongs to this checkpoint) each call that has
    returned is written down, and the repeated batch skips it; the one that failed is called again.
    """
    spark = sdf.sparkSession
    if log is not None:
        spark.createDataFrame([], CALLS).write.mode("append").parquet(log)

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = set()
        if log is not None:
            done = {r.action for r in spark.read.schema(CALLS).parquet(log).filter(F.col("batch") == batch_id).collect()}
        batch = batch.persist()
        try:
            for name in sorted(r.action for r in batch.select("action").distinct().collect()):
                if name in done:
                    continue
                ACTIONS[name](batch.filter(F.col("action") == name), batch_id)
                if log is not None:
                    spark.createDataFrame([(batch_id, name)], CALLS).coalesce(1).write.mode("append").parquet(log)
        finally:
            batch.unpersist()

    writer = sdf.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# Detectors

def _blocks(v: np.ndarray, carried: tuple, statistics: int) -> tuple[tuple, list[int], list[float]]:
    """Cut the changes between values into blocks that have ``statistics`` changes and are not all zero.

    Returns what is left for later (changes, their sum, the sum of their sizes, last value), and of each block
    that closes the place of its last value and its quality.
    """
    n, dev, osc, before = carried
    v = v if before is None else np.concatenate([[before], v])
    shift = 0 if before is None else 1
    change = np.diff(v)
    total, size = np.concatenate([[0.0], np.cumsum(change)]), np.concatenate([[0.0], np.cumsum(np.abs(change))])
    start, closed, values = 0, [], []
    while True:
        moved = start if osc > 0 else int(np.searchsorted(size, size[start], side="right"))
        end = max(start + max(statistics - n, 1), moved)
        if end > len(change):
            break
        closed.append(end - shift)
        values.append(abs((dev + total[end] - total[start]) / (osc + size[end] - size[start])))
        start, n, dev, osc = end, 0, 0.0, 0.0
    rest = (n + len(change) - start, float(dev + total[-1] - total[start]), float(osc + size[-1] - size[start]), float(v[-1]))
    return rest, closed, values


CONVERGE_STATE, THROTTLE_STATE = "low int, n int, dev double, osc double, before double", "last double"


def converge_step(column: str, stop: float, by: list[str], order: list[str], countdown: int = 2, statistics: int = 5):
    def detect(carried, pdf):
        low, n, dev, osc, before = carried or (0, 0, 0.0, 0.0, None)
        v = pdf[column].to_numpy(dtype="float64", na_value=np.nan)
        row, high = np.arange(len(v)), ~(v < stop)
        # How long the values have been low; every countdown-th of them converges and opens a new part.
        last = np.maximum.accumulate(np.where(high, row, -1 - low))
        done = ~high & ((row - last) % countdown == 0)
        part = np.cumsum(done)
        quality = np.full(len(v), np.nan)
        places = np.flatnonzero(high)
        tail = (n, dev, osc, before)
        for at in np.split(places, np.flatnonzero(np.diff(part[places])) + 1) if len(places) else ():
            own = tail if part[at[0]] == 0 else (0, 0.0, 0.0, None)
            tail, closed, values = _blocks(v[at], own, statistics)
            quality[at[closed]] = values
        if done.any() and (not len(places) or part[places[-1]] < part[-1]):
            tail = (0, 0.0, 0.0, None)
        return (int(row[-1] - last[-1]), *tail), pdf[[*by, *order]].assign(converged=done, quality=quality)

    return detect


def converge_stream(sdf: DataFrame, column: str, stop: float, by: list[str], order: list[str], countdown: int = 2, statistics: int = 5) -> DataFrame:
    """Convergence flag and quality per row, as ``convergence`` gives them on a table."""
    schema = schema_of(sdf, [*by, *order]) + ", converged boolean, quality double"
    return _scan(sdf, converge_step(column, stop, by, order, countdown, statistics), CONVERGE_STATE, schema, by, order)


def throttle_step(time: str, seconds: float):
    def accept(carried, pdf):
        last = carried[0] if carried else None
        times = pdf[time].to_numpy(dtype="float64")
        kept = []
        i = 0 if last is None else int(times.searchsorted(last + seconds))
        while i < len(times):
            kept.append(i)
            last = float(times[i])
            i = max(i + 1, int(times.searchsorted(last + seconds)))
        return None if last is None else (last,), pdf.iloc[kept]

    return accept


def throttle_stream(sdf: DataFrame, time: str, seconds: float, by: list[str], order: list[str]) -> DataFrame:
    """Rows at least ``seconds`` after the row accepted before."""
    return _scan(sdf, throttle_step(time, seconds), THROTTLE_STATE, sdf.schema, by, order)


def last_of_step(column: str, schema, ended: str | None = None):
    """State: the last row seen (null in all columns once its run is over)."""
    names = schema.names
    # Whole numbers come as floats where others of their column are null.
    whole = {f.name for f in schema if f.dataType.typeName() in ("long", "integer", "short", "byte")}

    def plain(name, v):
        if pd.isna(v):
            return None
        return int(v) if name in whole else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v

    def emit(carried, pdf):
        held = None if carried is None or all(v is None for v in carried) else pd.DataFrame([carried], columns=names)
        over = ended is not None and bool(pdf[ended].any())
        rows = pdf[~pdf[ended].astype(bool)][names] if ended else pdf[names]
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True) if len(rows) else held
        if not len(rows):
            return carried, rows
        after = rows[column].shift(-1)
        change = rows[column].ne(after) & ~(rows[column].isna() & after.isna())
        change.iloc[-1] = over
        last = tuple(plain(name, v) for name, v in rows.iloc[-1].items())
        return (None,) * len(names) if over else last, rows[change.to_numpy()]

    return emit


def last_of_stream(sdf: DataFrame, column: str, by: list[str], order: list[str], idle_ms: int | None = None, ended: str | None = None) -> DataFrame:
    """Last row of each stretch of equal values, as soon as the next stretch begins.

    The last row of a run comes when a row with a true ``ended`` column tells that the run is over (such a row is
    a marker only), or with ``idle_ms`` when nothing more arrived for so long.
    """
    kept = sdf.drop(ended) if ended else sdf
    schema, names = kept.schema, kept.columns
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def emit(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([state.get], columns=names) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield held
            return
        pdf = pd.concat(list(batches)).sort_values(order, ignore_index=True)
        over = ended is not None and bool(pdf[ended].any())
        rows = pdf[~pdf[ended].astype(bool)][names] if ended else pdf[names]
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True) if len(rows) else held
        if len(rows):
            after = rows[column].shift(-1)
            change = rows[column].ne(after) & ~(rows[column].isna() & after.isna())
            change.iloc[-1] = over
            if not over:
                state.update(tuple(v.item() if hasattr(v, "item") else v for v in rows.iloc[-1]))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
            yield rows[change.to_numpy()]
        if over and state.exists:
            state.remove()

    return sdf.groupBy(*by).applyInPandasWithState(emit, schema, schema, "append", timeout)


def skip_saved(sdf: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """One row per run and step. With an event time the memory of steps is limited to ``late``."""
    if event_time is None:
        return sdf.dropDuplicates(keys)
    return sdf.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def bucket_avg(df: DataFrame, time: str, width: str, columns: list[str], by=(), late: str | None = None) -> DataFrame:
    """Averages per time bucket; on a stream a bucket comes out once the watermark has passed it."""
    rows = df.withWatermark(time, late) if late is not None else df
    means: list[Column] = [F.avg(c).alias(c) for c in columns]
    out = rows.groupBy(F.window(time, width).alias("w"), *by).agg(*means, F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *columns, "n")
