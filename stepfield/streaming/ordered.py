"""Run scans on streams whose rows arrive out of order (ST-01, ST-02, ST-04, ST-06).

Rows wait in keyed state until the watermark has passed them and are then scanned in order. Runs are dealt to buckets by their
key, since each call to the state costs the same for one run and for hundreds. A bucket's rows are kept as packed pieces in a
map by time slice; a timer per slice fires when the watermark passes its end, and only that slice is taken out, ordered and
scanned run by run, with a few numbers of each run carried on in a list state. So no more of a run is held at a time than one slice,
however long the run and however many rows a micro-batch has; each piece of input is put away as it comes. Rows later than the watermark
allows are dropped by Spark before they reach the scan.

The scans themselves are the steps of ``live``; on rows that are late by no more than ``late`` they give what they give on a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stepfield.streaming import live as L

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Lateness:
    """Event time column (timestamp), how late rows may come (as for a watermark), seconds of a time slice, and the number of
    buckets of runs. A task holds a slice of one bucket at a time; a checkpoint keeps the number it was started with."""

    column: str
    late: str
    slice_seconds: int = 86400
    buckets: int = 1024


#: Whole numbers come as floats where others of their column are null, so these go as 0 with a flag of this name in front
#: (without an underscore first: Spark renames such columns on their way).
_NULL = "null_of_"


def _pack(pdf: pd.DataFrame, names: list[str]) -> bytes:
    columns = [pa.array(pdf[n], mask=pdf[_NULL + n].to_numpy(dtype=bool) if _NULL + n in pdf else None, from_pandas=True) for n in names]
    batch = pa.RecordBatch.from_arrays(columns, names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _plain(v):
    if pd.isna(v):
        return None
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else bytes(v) if isinstance(v, bytearray) else v


def _runs(table: pa.Table, by: list[str], order: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Key and rows, in order, of each run of a table."""
    pdf = table.to_pandas()
    run = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    mixed = any(pa.types.is_integer(f.type) and table[f.name].null_count for f in table.schema)
    place = np.argsort(run, kind="stable") if mixed else pdf.assign(__run=run).sort_values(["__run", *order]).index.to_numpy()
    if not mixed:
        pdf = pdf.take(place)
    ends = np.flatnonzero(np.diff(run[place])) + 1
    for a, b in zip([0, *ends], [*ends, len(place)]):
        # A null turns the whole numbers of its own run into floats, not those of others.
        own = table.take(place[a:b]).to_pandas().sort_values(order, ignore_index=True) if mixed else pdf.iloc[a:b].reset_index(drop=True)
        yield tuple(_plain(own[k].iloc[0]) for k in by), own


class InOrder(StatefulProcessor):
    """Hands the rows of each run to a step (state, rows in order) -> (state, result) once the watermark has passed them."""

    def __init__(self, step: Callable, state_schema: str, by: list[str], order: list[str], names: list[str], whole: list[str], slice_ms: int):
        self.step, self.state_schema, self.by, self.order, self.names, self.whole, self.slice_ms = step, state_schema, by, order, names, whole, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getListState("carried", self.state_schema)
        self.waiting = handle.getMapState("waiting", "slice bigint, piece bigint", "rows binary")
        self.pieces = handle.getValueState("pieces", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.pieces.get()[0] if self.pieces.exists() else 0
        for pdf in rows:
            for at, part in pdf.groupby(pdf["event_ms"] // self.slice_ms, sort=False):
                self.waiting.updateValue((int(at), n), (_pack(part, self.names),))
                self.handle.registerTimer((int(at) + 1) * self.slice_ms)
                n += 1
        self.pieces.update((n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms
        keys = sorted(k for k in (tuple(k) for k in self.waiting.keys()) if k[0] < due)
        if not keys:
            return
        n = len(self.by)
        held = {tuple(_plain(v) for v in r[:n]): tuple(r[n:]) for r in self.carried.get()} if self.carried.exists() else {}
        for at in sorted({k[0] for k in keys}):
            own = [k for k in keys if k[0] == at]
            table = pa.concat_tables([_unpack(self.waiting.getValue(k)[0]) for k in own], promote_options="permissive")
            found: dict[tuple, list[pd.DataFrame]] = {}
            for run, pdf in _runs(table, self.by, self.order):
                state, out = self.step(held.get(run), pdf)
                if state is not None:
                    held[run] = tuple(state)
                if len(out):
                    found.setdefault(tuple(out.dtypes), []).append(out)
            for k in own:
                self.waiting.removeKey(k)
            for outs in found.values():
                out = pd.concat(outs, ignore_index=True)
                # Spark takes a float NaN of a whole column for 0, so nulls go as None.
                for c in out.columns.intersection(self.whole):
                    if out[c].dtype.kind == "f":
                        out[c] = pd.Series([None if np.isnan(v) else int(v) for v in out[c]], dtype=object)
                yield out
        if held:
            self.carried.put([run + state for run, state in held.items()])

    def close(self) -> None:
        pass


def scan(sdf: DataFrame, step: Callable, state_schema: str, schema: str | StructType, by: list[str], order: list[str], lateness: Lateness) -> DataFrame:
    """Any step over the runs of a stream, in order of ``order``; rows of one slice are ordered by it, and slices by time."""
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names, kinds = sdf.columns, {f.name: f.dataType for f in sdf.schema}
    whole = [n for n in names if kinds[n].typeName() in ("long", "integer", "short", "byte")]
    # Runs of one bucket have null in the same columns of their key.
    nulls = reduce(lambda a, b: a + b, [F.col(k).isNull().cast("bigint") * 2**i for i, k in enumerate(by)])
    bucket = F.pmod(F.xxhash64(*by), F.lit(lateness.buckets)) * 2 ** len(by) + nulls
    rows = sdf.withWatermark(lateness.column, lateness.late).select(
        *[F.coalesce(n, F.lit(0).cast(kinds[n])).alias(n) if n in whole else F.col(n) for n in names], bucket.alias("bucket"),
        *[F.col(n).isNull().alias(_NULL + n) for n in whole], F.unix_millis(lateness.column).alias("event_ms"))
    state = ", ".join([*[f"by{i} {kinds[k].simpleString()}" for i, k in enumerate(by)], state_schema])
    processor = InOrder(step, state, by, order, names, whole, lateness.slice_seconds * 1000)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")


def converge(sdf: DataFrame, column: str, stop: float, by: list[str], order: list[str], lateness: Lateness, countdown: int = 2, statistics: int = 5) -> DataFrame:
    """``live.converge_stream`` for rows out of order."""
    schema = L.schema_of(sdf, [*by, *order]) + ", converged boolean, quality double"
    return scan(sdf, L.converge_step(column, stop, by, order, countdown, statistics), L.CONVERGE_STATE, schema, by, order, lateness)


def throttle(sdf: DataFrame, time: str, seconds: float, by: list[str], order: list[str], lateness: Lateness) -> DataFrame:
    """``live.throttle_stream`` for rows out of order."""
    return scan(sdf, L.throttle_step(time, seconds), L.THROTTLE_STATE, sdf.schema, by, order, lateness)


def last_of(sdf: DataFrame, column: str, by: list[str], order: list[str], lateness: Lateness, ended: str | None = None) -> DataFrame:
    """``live.last_of_stream`` for rows out of order."""
    kept = sdf.drop(ended) if ended else sdf
    state = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return scan(sdf, L.last_of_step(column, kept.schema, ended), state, kept.schema, by, order, lateness)


def changes(sdf: DataFrame, schedule, by: list[str], order: list[str], var: str, lateness: Lateness) -> DataFrame:
    """``live.scheduled_changes`` for rows out of order."""
    plan, step, state, schema = L.changes_plan(sdf, schedule, by, order, var, [lateness.column])
    return scan(plan, step, state, schema, by, order, lateness)
