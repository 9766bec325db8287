"""Streams whose rows come out of order give what tables give; no run is held whole."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepfield.functions.when import every
from stepfield.operators import runs as R
from stepfield.streaming import live as L
from stepfield.streaming import ordered as O

SCHEMA = "run string, i bigint, t double, v double, k string, ended boolean, at timestamp"
DAY = 86400.0


@pytest.fixture(scope="module")
def rows(spark):
    rnd, data, t = random.Random(2), [], 0.0
    for i in range(300):
        t += rnd.random() * 3600
        data.append(("a" if i % 3 else "b", i, t, float(rnd.choice([0, 0, 4, 5, 7])), rnd.choice("xxy"), False))
    return data


def drain(spark, rows, build, base):
    """Rows come up to a day late, in five batches; then a row far in the future, twice."""
    rnd = random.Random(4)
    came = sorted(rows, key=lambda r: r[2] + rnd.random() * DAY)
    cut = [came[len(came) * k // 5:len(came) * (k + 1) // 5] for k in range(5)] + [[("end", -k, 1e8 * k, 0.0, "x", False)] for k in (1, 2)]
    for part in cut:
        df = spark.createDataFrame([(*r, None) for r in part], SCHEMA).withColumn("at", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.02)
    sdf = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    L.run_to_end(sdf, f"{base}/out", f"{base}/cp")
    return spark.read.schema(sdf.schema).parquet(f"{base}/out").filter("run <> 'end'").collect()


def table(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


LATE = O.Lateness("at", "1 day", 6 * 3600)


def test_convergence(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: O.converge(s, "v", 2.0, ["run"], ["i"], LATE), tmp_path)
    want = R.convergence(table(spark, rows), "v", 2.0, ["run"], ["i"]).collect()
    plain = lambda rs: sorted((r.i, r.converged, None if r.quality is None or pd.isna(r.quality) else round(r.quality, 9)) for r in rs)
    assert plain(got) == plain(want) and any(r.converged for r in got)


def test_throttle(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: O.throttle(s, "t", 5000.0, ["run"], ["i"], LATE), tmp_path)
    assert sorted(r.i for r in got) == sorted(r.i for r in R.throttle(table(spark, rows), "t", 5000.0, ["run"], ["i"]).collect())


def test_last_of(spark, rows, tmp_path):
    marks = [(run, 1000 + k, max(r[2] for r in rows) + 1, 0.0, "x", True) for k, run in enumerate("ab")]
    got = drain(spark, rows + marks, lambda s: O.last_of(s, "k", ["run"], ["i"], LATE, ended="ended"), tmp_path)
    assert sorted(r.i for r in got) == sorted(r.i for r in R.last_of(table(spark, rows), "k", ["run"], ["i"]).collect())


def test_changes(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: O.changes(s, [("a", every("i", 50))], ["run"], ["i"], "i", LATE), tmp_path)
    want = set()
    for run in "ab":
        before = None
        for r in (r for r in rows if r[0] == run):
            due = (r[1] // 50 + 1) * 50
            if r[1] % 50 == 0 or due != before:
                want.add(r[1])
            before = due
    assert {r.i for r in got} == want


def test_a_slice_at_a_time(spark, rows, tmp_path):
    """A run of two hundred rows is never handed to the scan at once."""
    step = L.throttle_step("t", 1e-6)

    def sized(state, pdf):
        after, out = step(state, pdf)
        return after, out.assign(v=float(len(pdf)))

    got = drain(spark, rows, lambda s: O.scan(s, sized, L.THROTTLE_STATE, s.schema, ["run"], ["i"], LATE), tmp_path)
    assert len(got) == len(rows) and max(r.v for r in got) < 40


def test_runs_share_the_calls_to_the_state(spark, tmp_path):
    """Forty runs wait in three places (two buckets, one more for the null run); nulls of one run leave the ids of the others whole."""
    schema, top = "run bigint, i bigint, t double, at timestamp", 2**60
    rows = [(None if k == 7 else top + k, None if k == 8 else top + 100 * k + j, 1e6 + 3600.0 * j, None) for j in range(20) for k in range(40)]
    late = O.Lateness("at", "1 day", 6 * 3600, buckets=2)
    for part in (rows[:400], rows[400:], [(-1, 1, 1e8, None)], [(-1, 2, 2e8, None)]):
        spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    L.run_to_end(O.throttle(s, "t", 7000.0, ["run"], ["t"], late), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out").filter("run is null or run <> -1").collect()
    assert sorted((str(r.run), str(r.i), r.t) for r in got) == sorted((str(r[0]), str(r[1]), r[2]) for r in rows if (r[2] - 1e6) % 7200 == 0)
    held = spark.read.format("statestore").option("stateVarName", "carried").load(f"{tmp_path}/cp").filter("not list_element.by0 <=> -1")
    assert held.count() == 40 and held.select("key").distinct().count() == 3
