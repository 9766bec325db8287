"""Streams must give what the table operators give, also across batches and restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stepfield.functions.when import at, every
from stepfield.operators import calls as K
from stepfield.operators import runs as R
from stepfield.streaming import live as L

SCHEMA = "run string, i bigint, t double, v double, k string"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    data, t = [], 0.0
    for i in range(240):
        t += rnd.random()
        data.append(("a" if i % 3 else "b", i, t, float(rnd.choice([0, 0, 4, 5, 7])), rnd.choice("xxy")))
    return data


def drain(spark, rows, build, base):
    """Three batches, each by its own start of the query."""
    for part in range(3):
        batch = spark.createDataFrame(rows[part * 80:(part + 1) * 80], SCHEMA)
        batch.coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)
        sdf = build(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"))
        L.run_to_end(sdf, f"{base}/out", f"{base}/cp")
    return spark.read.schema(sdf.schema).parquet(f"{base}/out").collect()


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_convergence(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: L.converge_stream(s, "v", 2.0, ["run"], ["i"]), tmp_path)
    want = R.convergence(table(spark, rows), "v", 2.0, ["run"], ["i"]).collect()
    as_rows = lambda rs: sorted((r.i, r.converged, None if r.quality is None else round(r.quality, 9)) for r in rs)
    assert as_rows(got) == as_rows(want) and any(r.converged for r in got) and any(r.quality is not None for r in got)


def test_throttle(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: L.throttle_stream(s, "t", 3.0, ["run"], ["i"]), tmp_path)
    want = R.throttle(table(spark, rows), "t", 3.0, ["run"], ["i"]).collect()
    assert sorted(r.i for r in got) == sorted(r.i for r in want)


def test_last_of(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: L.last_of_stream(s, "k", ["run"], ["i"]), tmp_path)
    want = {r.i for r in R.last_of(table(spark, rows), "k", ["run"], ["i"]).collect()}
    ends = {max(r[1] for r in rows if r[0] == run) for run in "ab"}
    assert {r.i for r in got} == want - ends


def test_skip_saved(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: L.skip_saved(s.select("run", F.floor(F.col("i") / 7).alias("step")), ["run", "step"]), tmp_path)
    assert sorted((r.run, r.step) for r in got) == sorted({(r[0], r[1] // 7) for r in rows})


def test_scheduled(spark, rows, tmp_path):
    plan = [("save", every("i", 50)), ("note", at("i", 7) | every("i", 60, first=1))]
    got = drain(spark, rows, lambda s: L.scheduled(s, plan).select("i", "action"), tmp_path)
    want = [(i, "save") for i in range(0, 240, 50)] + [(7, "note")] + [(i, "note") for i in range(1, 240, 60)]
    assert sorted((r.i, r.action) for r in got) == sorted(want)


def test_scheduled_changes(spark, rows, tmp_path):
    got = drain(spark, rows, lambda s: L.scheduled_changes(s, [("save", every("i", 50))], ["run"], ["i"], "i"), tmp_path)
    want = []
    for run in "ab":
        before = None
        for r in [r for r in rows if r[0] == run]:
            nxt = (r[1] // 50 + 1) * 50
            if r[1] % 50 == 0 or nxt != before:
                want.append(r[1])
            before = nxt
    assert sorted(r.i for r in got) == sorted(want)


def test_actions_have_one_meaning():
    K.register_action("once", lambda rows, batch: None)
    with pytest.raises(ValueError):
        K.register_action("once", lambda rows, batch: None)
