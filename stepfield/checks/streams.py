"""Streaming queries over the events table; each reads the whole table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepfield.checks.base import EVENTS, epoch_us, event_runs, query, r, table
from stepfield.checks.runs import CONVERGE, THROTTLE
from stepfield.functions.when import at, every
from stepfield.operators import calls as K
from stepfield.session import shared_folder
from stepfield.streaming import live as L
from stepfield.streaming import ordered as O
from stepfield.streaming import restart as RS

BY, ORDER = ["run_id"], ["us", "event_id"]
W = "(PARTITION BY run_id ORDER BY us, event_id)"


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("user_id").alias("run_id"), "event_id", epoch_us("ts").alias("us"), (epoch_us("ts") / 1e6).alias("time"),
                      "event_type", "value", F.timestamp_micros(epoch_us("ts")).alias("ts"))


def drain(spark, sdf):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    L.run_to_end(sdf, base + "/out", base + "/checkpoint")
    return spark.read.schema(sdf.schema).parquet(base + "/out")


@query("st01_scheduled", f"""WITH {EVENTS} SELECT run_id, event_id, 'averages' AS action FROM ev WHERE event_id % 10 = 0
 UNION ALL SELECT run_id, event_id, 'fields' FROM ev WHERE event_id = 77 OR (event_id >= 5 AND event_id % 35 = 5)""")
def _(spark, sf):
    plan = [("averages", every("event_id", 10)), ("fields", at("event_id", 77) | every("event_id", 35, first=5))]
    return drain(spark, L.scheduled(stream(spark, sf), plan)).select("run_id", "event_id", "action")


@query("st01_scheduled_changes", f"""WITH {EVENTS}, n AS (SELECT *, (event_id // 1000 + 1) * 1000 AS nt, lag((event_id // 1000 + 1) * 1000) OVER {W} AS pt FROM ev)
 SELECT run_id, event_id, 'averages' AS action FROM n WHERE event_id % 1000 = 0 OR pt IS NULL OR pt <> nt""")
def _(spark, sf):
    out = L.scheduled_changes(stream(spark, sf), [("averages", every("event_id", 1000))], BY, ORDER, "event_id")
    return drain(spark, out).select("run_id", "event_id", "action")


@query("st02_converge_stream", CONVERGE)
def _(spark, sf):
    s = stream(spark, sf).withColumn("value", F.round("value", 0))
    return drain(spark, L.converge_stream(s, "value", 10.0, BY, ORDER)).select("run_id", "event_id", "converged", r("quality"))


@query("st03_skip_saved", f"WITH {EVENTS} SELECT DISTINCT run_id, us // 86400000000 AS step FROM ev")
def _(spark, sf):
    s = stream(spark, sf).select("run_id", F.floor(F.col("us") / 86400000000).alias("step"))
    return drain(spark, L.skip_saved(s, ["run_id", "step"]))


@query("st04_throttle_stream", THROTTLE)
def _(spark, sf):
    s = stream(spark, sf).select("run_id", "event_id", "us", "time")
    return drain(spark, L.throttle_stream(s, "time", 86400.0, BY, ORDER)).select("run_id", "event_id", "us")


@query("st05_restart", "SELECT user_id AS run_id, event_id, value FROM events")
def _(spark, sf):
    """Stop after the first half of the files and start again with the same checkpoint."""
    base = f"{shared_folder(spark)}/restart-{uuid.uuid4().hex}"
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "value")
    for part in (0, 1):
        ev.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(base + "/in")
        s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(base + "/in")
        L.run_to_end(s, base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")


# Stages are weeks; a stage converges with two values below 60 in a row. The stream stops after the first three fifths of the time.
_WEEK = 7 * 86400 * 10**6
_STAGES = f"""{EVENTS}, p AS (SELECT *, us // {_WEEK} AS stage FROM ev), cut AS (SELECT min(us) + (max(us) - min(us)) * 3 // 5 AS c FROM ev),
 low AS (SELECT *, coalesce(value < 60, false) AS low, lag(coalesce(value < 60, false)) OVER (PARTITION BY run_id, stage ORDER BY us, event_id) AS before FROM @),
 hit AS (SELECT *, low AND coalesce(before, false) AS hit FROM low)"""


def stopped_stages(spark, sf, go_on: bool):
    """Checkpoint and result of the stage stream after its first part, or after a restart with the rest too, and the plan of stages."""
    base = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    rows = event_runs(spark, sf).select("run_id", "us", "event_id", "value", F.floor(F.col("us") / _WEEK).alias("stage"))
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    cut = low + (high - low) * 3 // 5
    for part in (F.col("us") < cut, F.col("us") >= cut)[:1 + go_on]:
        rows.filter(part).write.mode("append").parquet(base + "/in")
        s = spark.readStream.schema(rows.schema).parquet(base + "/in")
        L.run_to_end(RS.stages_converged(s, "stage", "value", 60.0, BY, ORDER), base + "/out", base + "/checkpoint")
    return base + "/checkpoint", spark.read.parquet(base + "/out"), rows.select("run_id", "stage")


@query("st05_stages", f"WITH {_STAGES.replace('@', 'p')} SELECT run_id, us, event_id, stage FROM hit WHERE hit QUALIFY row_number() OVER (PARTITION BY run_id, stage ORDER BY us, event_id) = 1")
def _(spark, sf):
    """Stopped and started again, the stream gives what an unbroken one gives."""
    return stopped_stages(spark, sf, True)[1].select("run_id", "us", "event_id", "stage")


@query("st05_resume_points", f"""WITH {_STAGES.replace('@', 'p, cut WHERE us < c')}, st AS (SELECT * FROM (SELECT run_id, stage, bool_or(hit) AS converged, max(us) AS last FROM hit GROUP BY run_id, stage)
 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY stage DESC) = 1)
 SELECT p.run_id, any_value(st.stage) AS stage, any_value(converged) AS converged, any_value(last) AS last,
 min(CASE WHEN st.stage IS NULL OR p.stage > st.stage OR (p.stage = st.stage AND NOT converged) THEN p.stage END) AS go_on FROM p LEFT JOIN st USING (run_id) GROUP BY p.run_id""")
def _(spark, sf):
    checkpoint, _, plan = stopped_stages(spark, sf, False)
    return RS.resume_points(plan, RS.saved_stages(spark, checkpoint, BY), BY)


#: Files of a batch.
FILES = 4


def in_batches(spark, rows, last, clock: str, parts: int = 3):
    """A stream of the rows in ``parts`` batches of some files by their time, then of the rows ``last``."""
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(clock), F.max(clock)).first()
    part = F.least(F.floor((F.col(clock) - low) * parts / (high - low + 1)), F.lit(parts - 1))
    for k in range(parts):
        rows.filter(part == k).repartition(FILES).write.mode("append").parquet(path)
    last.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query("st06_last_of_stream", f"""WITH {EVENTS}, n AS (SELECT *, lead(event_type) OVER {W} AS nx FROM ev) SELECT run_id, event_id, event_type FROM n WHERE nx <> event_type OR nx IS NULL""")
def _(spark, sf):
    """Runs go on over several batches, and a marker for each run comes at the end."""
    rows = event_runs(spark, sf).select("run_id", "event_id", "us", "event_type", F.lit(False).alias("ended"))
    marks = rows.groupBy("run_id").agg(F.lit(None).cast("bigint").alias("event_id"), (F.max("us") + 1).alias("us"),
                                       F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("ended"))
    out = L.last_of_stream(in_batches(spark, rows, marks, "us"), "event_type", BY, ORDER, ended="ended")
    return drain(spark, out).select("run_id", "event_id", "event_type")


def out_of_order(spark, rows, parts: int = 4, files: int = 3):
    """A stream of the rows in ``parts`` batches in which many rows come a batch late, and what lateness that is.

    Two batches with a row far in the future (run -1) follow, so that the watermark passes all.
    """
    path = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    width = (high - low) // parts + 1
    came = F.col("us") + F.pmod(F.xxhash64("event_id"), F.lit(width))
    rows = rows.withColumn("ts", F.timestamp_micros("us")).withColumn("_part", F.floor((came - low) / width))
    for k in range(parts + 1):
        rows.filter(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(path)
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("run_id", "us", "ts", "_part")]
    for k in (1, 2):
        at = F.lit(high + 100 * k * width)
        mark = spark.range(files).select(F.lit(-1).cast(rows.schema["run_id"].dataType).alias("run_id"), at.alias("us"), F.timestamp_micros(at).alias("ts"), *null)
        mark.select(*rows.drop("_part").columns).repartition(files).write.mode("append").parquet(path)
    s = spark.readStream.schema(rows.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(path)
    return s, O.Lateness("ts", f"{2 * width // 10**6 + 1} seconds", max(1, width // 10**6))


@query("st01_late_changes", f"""WITH {EVENTS}, n AS (SELECT *, (event_id // 1000 + 1) * 1000 AS nt, lag((event_id // 1000 + 1) * 1000) OVER {W} AS pt FROM ev)
 SELECT run_id, event_id, 'averages' AS action FROM n WHERE event_id % 1000 = 0 OR pt IS NULL OR pt <> nt""")
def _(spark, sf):
    s, late = out_of_order(spark, event_runs(spark, sf).select("run_id", "event_id", "us"))
    out = O.changes(s, [("averages", every("event_id", 1000))], BY, ORDER, "event_id", late)
    return drain(spark, out).filter("run_id >= 0").select("run_id", "event_id", "action")


@query("st02_late_converge", CONVERGE)
def _(spark, sf):
    s, late = out_of_order(spark, event_runs(spark, sf).select("run_id", "event_id", "us", F.round("value", 0).alias("value")))
    out = drain(spark, O.converge(s, "value", 10.0, BY, ORDER, late))
    return out.filter("run_id >= 0").select("run_id", "event_id", "converged", r("quality"))


@query("st04_late_throttle", THROTTLE)
def _(spark, sf):
    s, late = out_of_order(spark, event_runs(spark, sf).select("run_id", "event_id", "us", "time"))
    out = drain(spark, O.throttle(s.withColumn("time", F.coalesce("time", F.col("us") / 1e6)), "time", 86400.0, BY, ORDER, late))
    return out.filter("run_id >= 0").select("run_id", "event_id", "us")


@query("st06_late_last_of", f"""WITH {EVENTS}, n AS (SELECT *, lead(event_type) OVER {W} AS nx FROM ev) SELECT run_id, event_id, event_type FROM n WHERE nx <> event_type OR nx IS NULL""")
def _(spark, sf):
    """Runs go on over several batches, out of order, and a marker for each run comes among its last rows."""
    rows = event_runs(spark, sf).select("run_id", "event_id", "us", "event_type", F.lit(False).alias("ended"))
    marks = rows.groupBy("run_id").agg(F.lit(None).cast("bigint").alias("event_id"), (F.max("us") + 1).alias("us"),
                                       F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("ended"))
    s, late = out_of_order(spark, rows.unionByName(marks))
    s = s.withColumn("ended", F.coalesce("ended", F.lit(False)))
    return drain(spark, O.last_of(s, "event_type", BY, ORDER, late, ended="ended")).filter("run_id >= 0").select("run_id", "event_id", "event_type")


_BUCKET = f"WITH {EVENTS}, b AS (SELECT us // 3600000000 * 3600 AS start, event_type, round(avg(value), 5) AS value, count(*) AS n FROM ev GROUP BY ALL)"


@query("st07_bucket_avg", f"{_BUCKET} SELECT * FROM b")
def _(spark, sf):
    df = event_runs(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    out = L.bucket_avg(df, "ts", "1 hour", ["value"], ["event_type"])
    return out.select(F.unix_seconds("start").alias("start"), "event_type", r("value", 5), "n")


@query("st07_bucket_avg_stream", f"{_BUCKET} SELECT * FROM b")
def _(spark, sf):
    """A last row far in the future lets the watermark pass all buckets."""
    rows = event_runs(spark, sf).select("us", "event_type", "value")
    end = rows.agg((F.max("us") + 10**12).alias("us"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    # The batch after the mark closes the buckets: the mark comes twice.
    s = in_batches(spark, rows, end.unionByName(end).repartition(2), "us")
    s = s.withColumn("ts", F.timestamp_micros("us"))
    out = drain(spark, L.bucket_avg(s, "ts", "1 hour", ["value"], ["event_type"], late="10 minutes"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", r("value", 5), "n")


@query("f04_register_action", "SELECT event_type, count(*) AS n, 'count' AS action FROM events WHERE event_id % 10 = 0 GROUP BY event_type")
def _(spark, sf):
    base = f"{shared_folder(spark)}/actions-{uuid.uuid4().hex}"
    name = "count-" + base[-8:]

    def save(rows, batch_id):
        rows.groupBy("event_type").count().write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    K.register_action(name, save)
    L.dispatch(L.scheduled(stream(spark, sf), [(name, every("event_id", 10))]), base + "/checkpoint", available_now=True).awaitTermination()
    out = spark.read.parquet(base + "/out")
    return out.groupBy("event_type").agg(F.sum("count").alias("n")).withColumn("action", F.lit("count"))
