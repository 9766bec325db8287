"""Restart at a stage and actions that are called once, against plain loops."""

import uuid

import pytest
from pyspark.sql import functions as F

from stepfield.operators import calls as K
from stepfield.session import shared_folder
from stepfield.streaming import live as L
from stepfield.streaming import ordered as O
from stepfield.streaming import restart as RS

KIND = "run int, t long, stage int, v double"


def rows_of(n=60):
    return [(run, t, t // (5 + run), float((t * 7 + run * 3) % 11) if (t + run) % 13 else None) for run in range(4) for t in range(n)]


def loop(rows, stop, countdown):
    """Rows at which stages converge, and the last state of each run."""
    found, state = [], {}
    for run, t, stage, v in sorted(rows):
        at, low, over, _ = state.get(run, (None, 0, False, None))
        if at != stage:
            low, over = 0, False
        low = low + 1 if v is not None and v < stop else 0
        if low >= countdown and not over:
            over = True
            found.append((run, t, stage))
        state[run] = (stage, low, over, t)
    return found, {run: (s[0], s[2], s[3]) for run, s in state.items()}


def feed(spark, base, rows, **more):
    spark.createDataFrame(rows, KIND).repartition(3).write.mode("append").parquet(base + "/in")
    s = spark.readStream.schema(KIND).parquet(base + "/in")
    L.run_to_end(RS.stages_converged(s, "stage", "v", 8.0, ["run"], ["t"], **more), base + "/out", base + "/checkpoint")


@pytest.mark.parametrize("countdown", [1, 3])
def test_stages_over_a_restart(spark, countdown):
    base, rows = f"{shared_folder(spark)}/{uuid.uuid4().hex}", rows_of()
    parts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 17), (17, 18), (18, 44), (44, 60))]
    seen = []
    for part in parts:
        feed(spark, base, part, countdown=countdown)
        seen += part
        found, state = loop(seen, 8.0, countdown)
        assert sorted(map(tuple, spark.read.parquet(base + "/out").select("run", "t", "stage").collect())) == found
        saved = RS.saved_stages(spark, base + "/checkpoint", ["run"])
        assert {r.run: (r.stage, r.converged, r["last"]) for r in saved.collect()} == state
    assert found


def test_resume(spark):
    plan = spark.createDataFrame([(run, s) for run in (1, 2, 3, 4) for s in (0, 2, 5)] * 2, "run int, stage int")
    saved = spark.createDataFrame([(1, 2, True, 9), (2, 2, False, 8), (3, 5, True, 7), (7, 0, True, 1)], "run int, stage int, converged boolean, last long")
    points = RS.resume_points(plan, saved, ["run"])
    assert {tuple(r) for r in points.collect()} == {(1, 2, True, 9, 5), (2, 2, False, 8, 2), (3, 5, True, 7, None), (4, None, None, None, 0)}
    rows = RS.resume_rows(plan.distinct(), points, ["run"], "stage")
    assert {tuple(r) for r in rows.collect()} == {(1, 5), (2, 2), (2, 5), (4, 0), (4, 2), (4, 5)}
    assert RS.resume_points(plan.limit(0), saved, ["run"]).count() == 0


def test_late_rows(spark):
    base, rows = f"{shared_folder(spark)}/{uuid.uuid4().hex}", rows_of(40)
    late = O.Lateness("ts", "12 seconds", 5)
    for lo in range(0, 52, 10):
        # A third of the rows comes a batch late.
        part = [r for r in rows if (r[1] // 10 + (r[1] % 3 == 0)) * 10 == lo]
        part += [(99, 1000 + lo, 0, None)] if lo >= 40 else []
        spark.createDataFrame(part, KIND).repartition(2).write.mode("append").parquet(base + "/in")
        s = spark.readStream.schema(KIND).parquet(base + "/in").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000))
        L.run_to_end(RS.stages_converged(s, "stage", "v", 8.0, ["run"], ["t"], 2, late), base + "/out", base + "/checkpoint")
    found, state = loop(rows, 8.0, 2)
    assert sorted(map(tuple, spark.read.parquet(base + "/out").filter("run < 99").select("run", "t", "stage").collect())) == found
    saved = RS.saved_stages(spark, base + "/checkpoint", ["run"], late)
    assert {r.run: (r.stage, r.converged, r["last"]) for r in saved.collect() if r.run < 99} == state


@pytest.mark.parametrize("logged", [True, False])
def test_actions_of_a_repeated_batch(spark, logged):
    base, calls, broken = f"{shared_folder(spark)}/{uuid.uuid4().hex}", [], [True]

    def first(rows, batch):
        calls.append(("first", batch, rows.count()))

    def second(rows, batch):
        if batch == 1 and broken:
            broken.clear()
            raise RuntimeError("no space")
        calls.append(("second", batch, rows.count()))

    one, two = f"a-{base[-8:]}", f"b-{base[-8:]}"
    K.register_action(one, first)
    K.register_action(two, second)

    def run():
        s = spark.readStream.schema("action string").parquet(base + "/in")
        return L.dispatch(s, base + "/checkpoint", True, base + "/log" if logged else None)

    rows = spark.createDataFrame([(one,), (two,), (two,)], "action string")
    rows.write.mode("append").parquet(base + "/in")
    run().awaitTermination()
    rows.write.mode("append").parquet(base + "/in")
    with pytest.raises(Exception, match="no space"):
        run().awaitTermination()
    run().awaitTermination()
    again = [] if logged else [("first", 1, 1)]
    assert calls == [("first", 0, 1), ("second", 0, 2), ("first", 1, 1), *again, ("second", 1, 2)]
