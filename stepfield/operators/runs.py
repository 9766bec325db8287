"""Scans over run tables: rows of a run in order (W-01 … W-09, W-12, A-24, U-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.plans.chain import on_path
from stepfield.plans.ordered import Ordered, dense_ids


def last_of(df: DataFrame, column: str, by: list[str], order: list[str], **kw) -> DataFrame:
    """Last row of each stretch of equal values; a value that comes back later counts again."""
    scan = Ordered(df, by, order, **kw).lead(_next=F.struct(F.col(column).alias("v")))
    changed = F.col("_next").isNull() | ~F.col(column).eqNullSafe(F.col("_next.v"))
    return scan.df.filter(changed).drop("_next")


def _stretches(scan: Ordered, column: str) -> Ordered:
    """Add ``_new`` (first row of a stretch of equal values)."""
    scan.lag(_prev=F.struct(F.col(column).alias("v")))
    return scan.map(lambda d: d.withColumn(
        "_new", F.col("_prev").isNull() | ~F.col(column).eqNullSafe(F.col("_prev.v"))).drop("_prev"))


def stage_clock(df: DataFrame, by: list[str], order: list[str], stage: str = "stage", step: str = "step",
                time: str = "time", **kw) -> DataFrame:
    """Step and time since the stage began, with the zero points, per stretch of equal stage."""
    zero = F.struct(F.col(step).alias("s"), F.col(time).alias("t"))
    scan = _stretches(Ordered(df, by, order, **kw), stage).running(_zero=("last", F.when(F.col("_new"), zero)))
    return scan.df.withColumns({
        "zero_stage_step": F.col("_zero.s"), "zero_stage_time": F.col("_zero.t"),
        "stage_step": F.col(step) - F.col("_zero.s"), "stage_time": F.col(time) - F.col("_zero.t"),
    }).drop("_zero", "_new")


def accumulate(df: DataFrame, columns: list[str], by: list[str], order: list[str], **kw) -> DataFrame:
    """Replace counters that restart by running totals: a fall adds the whole value, else the rise."""
    scan = Ordered(df, by, order, **kw).lag(**{"_p_" + c: F.col(c) for c in columns})
    gain = {c: F.when(F.col("_p_" + c).isNull() | (F.col(c) < F.col("_p_" + c)), F.col(c))
            .otherwise(F.col(c) - F.col("_p_" + c)) for c in columns}
    scan.running(**{"_a_" + c: ("sum", gain[c]) for c in columns})
    keep = [F.col("_a_" + c).alias(c) if c in columns else F.col(c) for c in df.columns]
    return scan.df.select(*keep)


def crossings(df: DataFrame, x: str, y: str, value: float, by: list[str], order: list[str], **kw) -> DataFrame:
    """x where the line through the points crosses ``value``; a point on the value counts once and
    the segment after it not at all."""
    scan = Ordered(df, by, order, **kw).lag(_px=F.col(x), _py=F.col(y))
    px, py = F.col("_px"), F.col("_py")
    hit = F.when(F.col(y) == value, F.col(x).cast("double")).when(
        ((F.col(y) > value) & (py < value)) | ((F.col(y) < value) & (py > value)),
        px + (value - py) * (F.col(x) - px) / (F.col(y) - py))
    return scan.df.withColumn("crossing", hit).filter("crossing is not null").drop("_px", "_py")


def convergence(df: DataFrame, column: str, stop: float, by: list[str], order: list[str], countdown: int = 2,
                statistics: int = 5, rows_per_task: int | None = None) -> DataFrame:
    """Add ``converged`` (true at every ``countdown``-th value in a row below ``stop``) and ``quality``
    (|sum of changes| over sum of |changes|, per block of at least ``statistics`` changes between
    values not below; convergence starts afresh)."""
    kw = {"rows_per_task": rows_per_task}
    scan = Ordered(df, by, order, **kw).position("_row")
    scan.map(lambda d: d.withColumn("_below", F.col(column) < stop))
    scan.running(_above=("last", F.when(~F.col("_below"), F.col("_row"))))
    scan.map(lambda d: d.withColumn(
        "converged", F.col("_below") & ((F.col("_row") - F.coalesce("_above", F.lit(0))) % countdown == 0)))
    scan.running(_resets=("count", F.when(F.col("converged"), F.lit(1))))
    kw["size"] = scan.size
    base = scan.df.drop("_above", "_below")
    above = base.filter(F.col(column) >= stop).select(*by, "_resets", "_row", F.col(column).alias("_v"))
    segment = [*by, "_resets"]
    dev = Ordered(above, segment, ["_row"], **kw).lag(_pv=F.col("_v"))
    dev.map(lambda d: d.filter("_pv is not null").withColumn("_dev", F.col("_v") - F.col("_pv")))
    dev.position("_k")
    # A block closes at its fifth change, or later at the first change that is not zero.
    dev.running(backwards=True, _live=("last", F.when(F.col("_dev") != 0, F.col("_k"))))
    dev.running(backwards=True, _n=("max", F.col("_k")))
    # Node k stands for "a block starts at change k"; its end decides where the next one starts.
    last = dev.df.select(*segment, "_row", "_dev", "_k", "_live", "_n")
    last = last.withColumn("_end", F.greatest(F.col("_live"), F.col("_k") + (statistics - 1))).withColumn("_end", F.when(F.col("_live").isNotNull() & (F.col("_end") <= F.col("_n")), F.col("_end")))
    starts = on_path(last.withColumn("_next", F.when(F.col("_end") < F.col("_n"), F.col("_end") + 1)),
                     segment, "_k", "_next", rows_per_task, scan.size)
    marked = last.join(starts.withColumn("_start", F.lit(True)), [*segment, "_k"], "left")
    blocks = Ordered(marked, segment, ["_k"], **kw).running(
        _block=("count", F.when(F.col("_start"), F.lit(1))), _close=("last", F.when(F.col("_start"), F.col("_end"))))
    quality = (
        blocks.df.filter("_k <= _close").groupBy(*segment, "_block")
        .agg(F.max("_row").alias("_row"), F.sum("_dev").alias("_d"), F.sum(F.abs("_dev")).alias("_o"))
        .select(*by, "_row", F.abs(F.col("_d") / F.col("_o")).alias("quality"))
    )
    return base.join(quality, [*by, "_row"], "left").drop("_row", "_resets")


def next_tolerance(quality: Column, tolerance: Column, worsen=1.5, improve=0.5, low=1e-4, high=1.0) -> Column:
    """Tolerance suggested by a quality: looser at 1, tighter below one half, NULL for no change."""
    new = F.when(quality == 1.0, tolerance * worsen).when(quality < 0.5, tolerance * improve)
    new = F.when(new.isNotNull(), F.least(F.greatest(new, F.lit(low)), F.lit(high)))
    return F.when(new != tolerance, new)


def smooth5(df: DataFrame, column: str, by: list[str], order: list[str], out: str = "smooth", **kw) -> DataFrame:
    """Weights 1 4 6 4 1 without normalising; beyond an end the end value counts."""
    c = F.col(column)
    scan = Ordered(df, by, order, **kw).lag(_b1=c).lead(_f1=c)
    scan.map(lambda d: d.withColumns({"_b1": F.coalesce("_b1", c), "_f1": F.coalesce("_f1", c)}))
    scan.lag(_b2=F.col("_b1")).lead(_f2=F.col("_f1"))
    smooth = (F.coalesce("_b2", F.col("_b1")) + 4 * F.col("_b1") + 6 * c + 4 * F.col("_f1")
              + F.coalesce("_f2", F.col("_f1")))
    return scan.df.withColumn(out, smooth).drop("_b1", "_b2", "_f1", "_f2")


def sign_flips(df: DataFrame, column: str, by: list[str], order: list[str], **kw) -> DataFrame:
    """Number of neighbouring rows with strictly opposite signs, per run."""
    scan = Ordered(df, by, order, **kw).lag(_p=F.col(column))
    return scan.df.groupBy(*by).agg(
        F.sum(F.when(F.col(column) * F.col("_p") < 0, 1).otherwise(0)).cast("bigint").alias("flips"))


def last_n(df: DataFrame, n: int, by: list[str], order: list[str], **kw) -> DataFrame:
    return Ordered(df, by, order, **kw).position("_p", backwards=True).df.filter(F.col("_p") <= n).drop("_p")


def throttle(df: DataFrame, time: str, seconds: float, by: list[str], order: list[str],
             rows_per_task: int | None = None) -> DataFrame:
    """Keep a row when at least ``seconds`` (above 0) passed since the row kept before it; the first row stays."""
    if seconds <= 0:
        return df
    kw = {"rows_per_task": rows_per_task}
    first = Ordered(df, by, order, **kw).position("_pos")
    rows, (largest, every) = first.df, first.size
    marks = rows.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.col("_pos"), F.col("_pos").alias("_o"))
    asks = rows.select(*by, (F.col(time) + seconds).alias("_t"), F.lit(0).alias("_kind"),
                       F.lit(None).cast("bigint").alias("_pos"), F.col("_pos").alias("_o"))
    scan = Ordered(marks.unionByName(asks), by, ["_t", "_kind", "_o"], rows_per_task, (2 * largest, 2 * every))
    scan.running(backwards=True, _next=("last", F.col("_pos")))
    pointers = scan.df.filter("_kind = 0").select(*by, F.col("_o").alias("_pos"), "_next")
    kept = on_path(pointers, by, "_pos", "_next", rows_per_task, first.size)
    return rows.join(kept, [*by, "_pos"], "left_semi").drop("_pos")


def row_ids(df: DataFrame, by: list[str], order: list[str], out: str = "row", **kw) -> DataFrame:
    """Row number (from 0) of each save of a field, in save order."""
    return dense_ids(df, by, order, out, **kw)


def timer_totals(df: DataFrame, by: list[str], order: list[str], kind: str = "kind", time: str = "time", **kw) -> DataFrame:
    """Seconds and stops per counter from start/stop events. A second start without a stop is
    ignored; a stop without a start is counted as unmatched. ``open`` tells a running counter."""
    started = F.col(kind) == "start"
    scan = Ordered(df.filter(F.col(kind).isin("start", "stop")), by, order, **kw).lag(_pk=F.col(kind))
    fresh = started & (F.col("_pk").isNull() | (F.col("_pk") == "stop"))
    scan.running(_t0=("last", F.when(fresh, F.col(time)))).lead(_nk=F.col(kind))
    closing = ~started & (F.col("_pk") == "start")
    tail = F.col("_nk").isNull()
    return scan.df.groupBy(*by).agg(
        F.sum(F.when(closing, F.col(time) - F.col("_t0")).otherwise(0.0)).alias("seconds"),
        F.count(F.when(closing, 1)).alias("stops"),
        F.count(F.when(~started & ~F.coalesce(closing, F.lit(False)), 1)).alias("unmatched_stops"),
        F.count(F.when(started & ~fresh, 1)).alias("double_starts"),
        F.max(tail & started).alias("open"),
    )


def append_equal(*tables: DataFrame) -> DataFrame:
    """Rows of tables with the same columns, in any column order; other columns are an error."""
    return reduce(lambda a, b: a.unionByName(b), tables)
