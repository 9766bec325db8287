"""Queries that scan runs in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.checks.base import EVENTS, epoch_us, event_runs, query, r, table
from stepfield.operators import probe as P
from stepfield.operators import runs as R

BY, ORDER = ["run_id"], ["us", "event_id"]
W = "(PARTITION BY run_id ORDER BY us, event_id)"
THROTTLE = f"""WITH RECURSIVE {EVENTS}, keep(run_id, time) AS (SELECT run_id, min(time) FROM ev GROUP BY run_id
 UNION ALL SELECT keep.run_id, min(ev.time) FROM keep JOIN ev ON ev.run_id = keep.run_id AND ev.time >= keep.time + 86400 GROUP BY keep.run_id)
 SELECT run_id, event_id, us FROM ev JOIN keep USING (run_id, time)"""


@query("w01_last_of", f"""WITH {EVENTS}, n AS (SELECT *, lead(event_type) OVER {W} AS nx FROM ev)
 SELECT run_id, event_id, event_type, value FROM n WHERE nx IS NULL OR nx <> event_type""")
def _(spark, sf):
    return R.last_of(event_runs(spark, sf), "event_type", BY, ORDER).select("run_id", "event_id", "event_type", "value")


@query("w02_stage_clock", f"""WITH {EVENTS}, a AS (SELECT *, row_number() OVER {W} AS step, lag(event_type) OVER {W} AS pt FROM ev),
 b AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt <> event_type THEN 1 ELSE 0 END) OVER {W} AS g FROM a)
 SELECT run_id, event_id, step, step - first_value(step) OVER (PARTITION BY run_id, g ORDER BY us, event_id) AS stage_step,
 round(time - first_value(time) OVER (PARTITION BY run_id, g ORDER BY us, event_id), 3) AS stage_time FROM b""")
def _(spark, sf):
    from stepfield.plans.ordered import Ordered
    df = Ordered(event_runs(spark, sf), BY, ORDER).position("step").df
    return R.stage_clock(df, BY, ORDER, stage="event_type").select("run_id", "event_id", "step", "stage_step", r("stage_time", 3))


@query("w03_accumulate", f"""WITH {EVENTS}, a AS (SELECT *, lag(value) OVER {W} AS p FROM ev)
 SELECT run_id, event_id, round(sum(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END) OVER {W}, 4) AS value FROM a""")
def _(spark, sf):
    return R.accumulate(event_runs(spark, sf), ["value"], BY, ORDER).select("run_id", "event_id", r("value", 4))


@query("w04_crossings", f"""WITH {EVENTS}, a AS (SELECT *, lag(time) OVER {W} AS px, lag(value) OVER {W} AS py FROM ev)
 SELECT run_id, event_id, round(CASE WHEN value = 10 THEN time ELSE px + (10 - py) * (time - px) / (value - py) END, 2) AS crossing FROM a
 WHERE value = 10 OR (value > 10 AND py < 10) OR (value < 10 AND py > 10)""")
def _(spark, sf):
    return R.crossings(event_runs(spark, sf), "time", "value", 10.0, BY, ORDER).select("run_id", "event_id", r("crossing", 2))


CONVERGE = f"""WITH RECURSIVE {EVENTS}, o AS (SELECT run_id, event_id, round(value, 0) AS v, row_number() OVER {W} AS k FROM ev),
s AS (SELECT run_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS low, 0 AS n, 0::DOUBLE AS dev, 0::DOUBLE AS osc, NULL::DOUBLE AS seen, false AS converged, NULL::DOUBLE AS quality FROM (SELECT DISTINCT run_id FROM o)
 UNION ALL SELECT run_id, k, event_id, CASE WHEN v < 10 AND NOT done THEN low + 1 ELSE 0 END,
  CASE WHEN done OR closes THEN 0 WHEN counts THEN n + 1 ELSE n END, CASE WHEN done OR closes THEN 0 WHEN counts THEN dev + v - seen ELSE dev END,
  CASE WHEN done OR closes THEN 0 WHEN counts THEN osc + abs(v - seen) ELSE osc END, CASE WHEN done THEN NULL WHEN v < 10 THEN seen ELSE v END, done,
  CASE WHEN closes THEN abs((dev + v - seen) / (osc + abs(v - seen))) END
 FROM (SELECT *, counts AND n + 1 >= 5 AND osc + abs(v - seen) > 0 AS closes FROM (
  SELECT o.*, low, n, dev, osc, seen, v < 10 AND low = 1 AS done, v >= 10 AND seen IS NOT NULL AS counts FROM s JOIN o ON o.run_id = s.run_id AND o.k = s.k + 1)))
SELECT run_id, event_id, converged, round(quality, 6) AS quality FROM s WHERE k > 0"""


@query("w05_convergence", CONVERGE)
def _(spark, sf):
    df = event_runs(spark, sf).withColumn("value", F.round("value", 0))
    return R.convergence(df, "value", 10.0, BY, ORDER).select("run_id", "event_id", "converged", r("quality"))


@query("w06_interp1", """WITH t AS (SELECT DISTINCT epoch(o_orderdate)::DOUBLE AS x FROM orders),
 tab AS (SELECT epoch_us(ts) / 1e6 AS tx, value AS ty FROM events),
 lo AS (SELECT x, tx, ty FROM t ASOF LEFT JOIN tab ON t.x >= tab.tx), hi AS (SELECT x, tx, ty FROM t ASOF LEFT JOIN tab ON t.x <= tab.tx)
 SELECT x, round(CASE WHEN lo.tx IS NULL THEN hi.ty WHEN hi.tx IS NULL OR lo.tx = x THEN lo.ty
 ELSE lo.ty + (hi.ty - lo.ty) * (x - lo.tx) / (hi.tx - lo.tx) END, 4) AS y FROM lo JOIN hi USING (x)""")
def _(spark, sf):
    tab = event_runs(spark, sf).select(F.col("time").alias("x"), F.col("value").alias("y"))
    asked = table(spark, sf, "orders").select((epoch_us("o_orderdate") / 1e6).alias("x")).distinct()
    return P.interp1(asked, tab, [], "x", "y", "y").select("x", r("y", 4))


@query("w07_smooth5", f"""WITH {EVENTS}, a AS (SELECT *, first_value(value) OVER {W} AS f,
 last_value(value) OVER (PARTITION BY run_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 lag(value, 1) OVER {W} AS b1, lag(value, 2) OVER {W} AS b2, lead(value, 1) OVER {W} AS f1, lead(value, 2) OVER {W} AS f2 FROM ev)
 SELECT run_id, event_id, round(coalesce(b2, f) + 4 * coalesce(b1, f) + 6 * value + 4 * coalesce(f1, l) + coalesce(f2, l), 4) AS smooth FROM a""")
def _(spark, sf):
    return R.smooth5(event_runs(spark, sf), "value", BY, ORDER).select("run_id", "event_id", r("smooth", 4))


@query("w07_sign_flips", f"""WITH {EVENTS}, a AS (SELECT run_id, value - 15 AS v, lag(value - 15) OVER {W} AS p FROM ev)
 SELECT run_id, sum(CASE WHEN v * p < 0 THEN 1 ELSE 0 END)::BIGINT AS flips FROM a GROUP BY run_id""")
def _(spark, sf):
    return R.sign_flips(event_runs(spark, sf).withColumn("value", F.col("value") - 15), "value", BY, ORDER)


@query("w08_last_n", f"""WITH {EVENTS} SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY us DESC, event_id DESC) AS n FROM ev) WHERE n <= 5""")
def _(spark, sf):
    return R.last_n(event_runs(spark, sf), 5, BY, ORDER).select("run_id", "event_id")


@query("w09_throttle", THROTTLE)
def _(spark, sf):
    return R.throttle(event_runs(spark, sf), "time", 86400.0, BY, ORDER).select("run_id", "event_id", "us")


@query("a24_timer_totals", f"""WITH {EVENTS}, k AS (SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 'start' ELSE 'stop' END AS kind FROM ev),
 a AS (SELECT *, lag(kind) OVER {W} AS pk, lead(kind) OVER {W} AS nk FROM k),
 b AS (SELECT *, last_value(CASE WHEN kind = 'start' AND (pk IS NULL OR pk = 'stop') THEN time END IGNORE NULLS) OVER {W} AS t0 FROM a)
 SELECT run_id, round(sum(CASE WHEN kind = 'stop' AND pk = 'start' THEN time - t0 ELSE 0 END), 2) AS seconds,
 count(CASE WHEN kind = 'stop' AND pk = 'start' THEN 1 END) AS stops,
 count(CASE WHEN kind = 'stop' AND (pk IS NULL OR pk = 'stop') THEN 1 END) AS unmatched_stops,
 count(CASE WHEN kind = 'start' AND pk = 'start' THEN 1 END) AS double_starts, bool_or(nk IS NULL AND kind = 'start') AS open FROM b GROUP BY run_id""")
def _(spark, sf):
    df = event_runs(spark, sf).withColumn("kind", F.when(F.col("event_type").isin("view", "signup"), "start").otherwise("stop"))
    return R.timer_totals(df, BY, ORDER).withColumn("seconds", r("seconds", 2))


@query("u05_append", "SELECT * FROM (SELECT user_id AS run_id, value FROM events UNION ALL SELECT l_orderkey, l_tax FROM lineitem)")
def _(spark, sf):
    a = event_runs(spark, sf).select("run_id", "value")
    b = table(spark, sf, "lineitem").select(F.col("l_tax").alias("value"), F.col("l_orderkey").alias("run_id"))
    return R.append_equal(a, b)
