"""Scans over long runs in pieces must give what one window gives."""

import random

import pytest
from pyspark.sql import functions as F

from stepfield.operators import columns as C
from stepfield.operators import probe as P
from stepfield.operators import runs as R
from stepfield.plans.ordered import Ordered, dense_ids

SMALL = {"rows_per_task": 40}


@pytest.fixture(scope="module")
def rows(spark):
    """One run holds most of the rows, with many equal times and gaps in the values."""
    rnd = random.Random(5)
    data = []
    for i in range(900):
        run = "hot" if i % 3 else f"r{i % 11}"
        data.append((run, i, float(rnd.randrange(200)), rnd.choice([None, 1.0, 2.0, 2.0, 5.0, 7.0]), rnd.choice("aab")))
    return spark.createDataFrame(data, "run string, id bigint, t double, v double, k string").repartition(7).cache()


def same(a, b):
    key = lambda row: tuple("" if x is None else repr(x) for x in row)
    cols = sorted(a.columns)
    left, right = [sorted(map(key, df.select(*cols).collect())) for df in (a, b)]
    assert left == right
    return len(left)


def scan(rows, **kw):
    o = Ordered(rows, ["run"], ["t", "id"], **kw)
    o.lag(p=F.col("v"), q=F.col("id")).lead(n=F.col("v"))
    o.running(s=("sum", F.col("v")), c=("count", F.col("v")), m=("max", F.col("v")), l=("last", F.col("v")), f=("first", F.col("v")))
    o.running(backwards=True, bl=("last", F.col("v")), bs=("sum", F.col("v")), bm=("min", F.col("v")))
    return o


def test_pieces_equal_one_window(rows):
    whole, cut = scan(rows), scan(rows, **SMALL)
    assert not whole.pieces and cut.pieces
    assert same(whole.df, cut.df) == 900


def test_global_order(rows):
    a = Ordered(rows, [], ["t", "id"]).position("p").df
    b = Ordered(rows, [], ["t", "id"], **SMALL).position("p").df
    same(a, b)
    assert sorted(r.p for r in b.collect()) == list(range(1, 901))


def test_dense_ids(rows):
    same(dense_ids(rows, ["run"], ["id"], "n"), dense_ids(rows, ["run"], ["id"], "n", **SMALL))


@pytest.mark.parametrize("fn", [
    lambda d, **kw: R.last_of(d, "k", ["run"], ["t", "id"], **kw),
    lambda d, **kw: R.stage_clock(d, ["run"], ["t", "id"], stage="k", step="id", time="t", **kw),
    lambda d, **kw: R.accumulate(d, ["id"], ["run"], ["t", "id"], **kw),
    lambda d, **kw: R.crossings(d.filter("v is not null"), "t", "v", 2.0, ["run"], ["t", "id"], **kw),
    lambda d, **kw: R.smooth5(d.fillna(0.0), "v", ["run"], ["t", "id"], **kw),
    lambda d, **kw: R.last_n(d, 5, ["run"], ["t", "id"], **kw),
    lambda d, **kw: C.short_list(d, ["run"], ["t", "id"], **kw),
    lambda d, **kw: R.timer_totals(d.withColumn("kind", F.when(F.col("k") == "a", "start").otherwise("stop")), ["run"], ["t", "id"], time="t", **kw),
])
def test_operators_in_pieces(rows, fn):
    assert same(fn(rows), fn(rows, **SMALL)) > 0


def test_throttle_against_loop(rows):
    out = R.throttle(rows, "t", 7.0, ["run"], ["t", "id"])
    cut = R.throttle(rows, "t", 7.0, ["run"], ["t", "id"], **SMALL)
    same(out, cut)
    want = []
    for run in {r.run for r in rows.collect()}:
        last = None
        for row in sorted((r for r in rows.collect() if r.run == run), key=lambda r: (r.t, r.id)):
            if last is None or row.t - last >= 7.0:
                last = row.t
                want.append(row.id)
    assert sorted(r.id for r in out.collect()) == sorted(want)


def brute_convergence(values, stop, countdown=2, statistics=5):
    left, n, dev, osc, before = countdown, 0, 0.0, 0.0, None
    out = []
    for v in values:
        done, q = False, None
        if v < stop:
            left -= 1
            if left < 1:
                done, left, n, dev, osc, before = True, countdown, 0, 0.0, 0.0, None
        else:
            left = countdown
            if before is not None:
                n, dev, osc = n + 1, dev + v - before, osc + abs(v - before)
                if n >= statistics and osc > 0:
                    q, n, dev, osc = abs(dev / osc), 0, 0.0, 0.0
            before = v
        out.append((done, q))
    return out


@pytest.mark.parametrize("limit", [None, 40])
def test_convergence_against_loop(spark, limit):
    rnd = random.Random(9)
    data = []
    for run, n in (("hot", 400), ("b", 30), ("flat", 40)):
        for i in range(n):
            v = 5.0 if run == "flat" and i < 25 else float(rnd.choice([0, 4, 4, 4, 5, 6, 8]))
            data.append((run, i, v))
    df = spark.createDataFrame(data, "run string, i bigint, v double")
    out = R.convergence(df, "v", 3.0, ["run"], ["i"], rows_per_task=limit).collect()
    for run in ("hot", "b", "flat"):
        got = sorted((r.i, r.converged, r.quality) for r in out if r.run == run)
        want = brute_convergence([d[2] for d in data if d[0] == run], 3.0)
        for (i, c, q), (wc, wq) in zip(got, want):
            assert c == wc and (q is None) == (wq is None), (run, i)
            assert q is None or abs(q - wq) < 1e-12
        assert len(got) == len(want)


def test_next_tolerance(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.3, 0.5), (0.7, 0.5), (1.0, 1.0), (0.1, 1e-4)], "q double, t double")
    got = [r[0] for r in df.select(R.next_tolerance(F.col("q"), F.col("t"))).collect()]
    assert got == [0.75, 0.25, None, None, None]


def test_interp1_in_pieces(spark, rows):
    table = rows.filter("v is not null").groupBy("run", "t").agg(F.max("v").alias("v"))
    asked = rows.select("run", "id", (F.col("t") * 1.03 - 3).alias("t"))
    a = P.interp1(asked, table, ["run"], "t", "v", "y")
    b = P.interp1(asked, table, ["run"], "t", "v", "y", rows_per_task=40)
    assert same(a, b) == 900



def test_columns_by_token(spark):
    df = spark.createDataFrame([(1.0, 3.0, 4.0, 9.0)], "time double, m_Py_0 double, m_Py_1 double, maxangle_m_Py double")
    assert C.select_cols(df, 0, "angle").columns == ["time", "maxangle_m_Py"]
    assert C.select_cols(df, "m_Py_", several=True).columns == ["m_Py_0", "m_Py_1"]
    with pytest.raises(ValueError):
        C.select_cols(df, "m_Py")
    with pytest.raises(ValueError):
        C.select_cols(df, "none")
    # Only columns containing "m_Py_" count; one match is accepted.
    assert C.magnitude(df, "m_Py").first()["mod_m_Py"] == 5.0
    assert C.magnitude(df, "m_Py_1").first() is not None if "m_Py_1_" in df.columns else True
