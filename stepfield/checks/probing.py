"""Queries that probe, interpolate, transform and derive."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from stepfield.checks.base import EVENTS, LOC, MESH, SNAP, epoch_us, event_runs, part_mesh, query, r, snapshots, subfield_where, table, xyz_out
from stepfield.functions.sequences import Lattice, lattice_order
from stepfield.functions.vec import vec_filter
from stepfield.operators import calls as K
from stepfield.operators import formula as FM
from stepfield.operators import mesh as M
from stepfield.operators import probe as P
from stepfield.operators import snapshots as S
from stepfield.operators import spectral as SP


def part_probes(spark, sf):
    """One probe near the middle of every cube of the part mesh, some of them outside."""
    c = F.floor(F.col("p_partkey") / 4).cast("bigint")
    pos = F.array(F.floor(c / 64) + 0.43 + (F.col("p_size") % 7) / 20.0, F.floor(c % 64 / 8) + 0.51 + (F.col("p_size") % 5) / 20.0, c % 8 + 0.37 + (F.col("p_size") % 3) / 10.0)
    return table(spark, sf, "part").select((F.col("p_partkey") % 4).alias("mesh_id"), F.col("p_partkey").alias("probe"), pos.alias("pos"))


_D3 = "(({1}x-{0}x)*(({2}y-{0}y)*({3}z-{0}z)-({2}z-{0}z)*({3}y-{0}y)) - ({1}y-{0}y)*(({2}x-{0}x)*({3}z-{0}z)-({2}z-{0}z)*({3}x-{0}x)) + ({1}z-{0}z)*(({2}x-{0}x)*({3}y-{0}y)-({2}y-{0}y)*({3}x-{0}x)))"


def _d(*names):
    text = _D3.format(*["@%s@" % n for n in names])
    for n in names:
        for a in "xyz":
            text = text.replace(f"@{n}@{a}", f"p{a}" if n == "p" else f"{a}{n}")
    return text


PROBE = f"""prb AS (SELECT p_partkey % 4 AS mesh_id, p_partkey AS probe, p_partkey // 4 // 64 + 0.43::DOUBLE + (p_size % 7) / 20.0::DOUBLE AS px,
 p_partkey // 4 % 64 // 8 + 0.51::DOUBLE + (p_size % 5) / 20.0::DOUBLE AS py, p_partkey // 4 % 8 + 0.37::DOUBLE + (p_size % 3) / 10.0::DOUBLE AS pz FROM part),
 bx AS (SELECT *, least(x0,x1,x2,x3) AS lx, greatest(x0,x1,x2,x3) AS hx, least(y0,y1,y2,y3) AS ly, greatest(y0,y1,y2,y3) AS hy, least(z0,z1,z2,z3) AS lz, greatest(z0,z1,z2,z3) AS hz FROM loc),
 cand AS (SELECT prb.probe, px, py, pz, bx.* FROM prb JOIN (SELECT *, unnest(range(floor(lx)::BIGINT, floor(hx)::BIGINT + 1)) AS cell FROM bx) bx ON bx.mesh_id = prb.mesh_id AND cell = floor(px)::BIGINT
  WHERE px BETWEEN lx AND hx AND py BETWEEN ly AND hy AND pz BETWEEN lz AND hz),
 wts AS (SELECT mesh_id, probe, sid, region, v0, v1, v2, v3, {_d('p', '1', '2', '3')} / {_d('0', '1', '2', '3')} AS w0, {_d('0', 'p', '2', '3')} / {_d('0', '1', '2', '3')} AS w1,
  {_d('0', '1', 'p', '3')} / {_d('0', '1', '2', '3')} AS w2, {_d('0', '1', '2', 'p')} / {_d('0', '1', '2', '3')} AS w3 FROM cand),
 hit AS (SELECT * FROM wts WHERE least(w0, w1, w2, w3) >= -1e-12 QUALIFY row_number() OVER (PARTITION BY mesh_id, probe ORDER BY sid) = 1),
 pm AS (SELECT mesh_id, probe, unnest([v0, v1, v2, v3]) AS pid, unnest([w0, w1, w2, w3]) AS weight FROM hit)"""


@query("j04_locate", f"WITH {LOC}, {PROBE} SELECT mesh_id, probe, sid, region, round(w0, 6) AS w0, round(w3, 6) AS w3 FROM hit")
def _(spark, sf):
    return P.locate(part_probes(spark, sf), part_mesh(spark, sf)).select("mesh_id", "probe", "sid", "region", r("w0"), r("w3"))


@query("j16_probe_matrix", f"WITH {LOC}, {PROBE} SELECT mesh_id, probe, pid, round(weight, 6) AS weight FROM pm")
def _(spark, sf):
    return P.probe_matrix(part_probes(spark, sf), part_mesh(spark, sf)).select("mesh_id", "probe", "pid", r("weight"))


_APPLIED = """app AS (SELECT run_id, mesh_id, subfield, id, probe, sum(weight * a) AS a, sum(weight * b) AS b, sum(weight * c) AS c FROM pm JOIN snap USING (mesh_id, pid) GROUP BY ALL HAVING count(*) = 4)"""


@query("j16_apply_matrix", f"WITH {LOC}, {SNAP}, {PROBE}, {_APPLIED} SELECT run_id, subfield, id, probe, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM app")
def _(spark, sf):
    m = part_mesh(spark, sf)
    return P.apply_matrix(P.probe_matrix(part_probes(spark, sf), m), snapshots(spark, sf, m), 3, 4).select("run_id", "subfield", "id", "probe", *xyz_out())


@query("j17_probe", f"""WITH {LOC}, {SNAP}, {PROBE}, {_APPLIED} SELECT s.run_id, s.subfield, s.id, prb.probe, round(sqrt(a*a+b*b+c*c), 6) AS value
 FROM prb JOIN (SELECT DISTINCT run_id, mesh_id, subfield, id FROM snap) s USING (mesh_id) LEFT JOIN app ON app.run_id = s.run_id AND app.subfield = s.subfield AND app.id = s.id AND app.probe = prb.probe""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    got = P.probe(snapshots(spark, sf, m), m, part_probes(spark, sf), 3, vec=lambda v: vec_filter(v, "norm", 3))
    return got.select("run_id", "subfield", "id", "probe", r("value"))


@query("f05_probe_filter", f"""WITH {LOC}, {SNAP}, {PROBE}, {_APPLIED} SELECT run_id, subfield, id, probe, round(sqrt(a*a+c*c), 6) AS value FROM app""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    got = P.probe(snapshots(spark, sf, m), m, part_probes(spark, sf), 3, vec=lambda v: vec_filter(v, "projection,1", 3))
    return got.filter("value is not null").select("run_id", "subfield", "id", "probe", r("value"))


@query("j09_asof_interp", f"""WITH {MESH}, {SNAP}, t AS (SELECT unnest([-0.2, 0.0, 0.3, 1.0, 1.37, 9.0])::DOUBLE AS t), w AS (SELECT t, unnest([greatest(0, least(3, floor(t / 0.5)))::BIGINT, greatest(0, least(3, floor(t / 0.5) + 1))::BIGINT]) AS id,
 unnest([1 - (greatest(0, least(1.5, t)) / 0.5 - greatest(0, least(3, floor(t / 0.5)))), greatest(0, least(1.5, t)) / 0.5 - greatest(0, least(3, floor(t / 0.5)))]) AS w FROM t)
 SELECT run_id, subfield, t, pid, round(sum(w * a), 6) AS a, round(sum(w * b), 6) AS b, round(sum(w * c), 6) AS c FROM snap JOIN w USING (id) GROUP BY ALL""")
def _(spark, sf):
    s = snapshots(spark, sf)
    times = s.select("run_id").distinct().withColumn("t", F.explode(F.array(*[F.lit(x) for x in (-0.2, 0.0, 0.3, 1.0, 1.37, 9.0)])))
    return P.asof_interp(s, times, 3).select("run_id", "subfield", "t", F.col("site")[0].alias("pid"), *xyz_out())


@query("j09_asof_runs", f"""WITH {EVENTS}, q AS (SELECT o_orderkey, o_custkey % (SELECT max(user_id) + 1 FROM events) AS run_id, epoch_us(o_orderdate) / 1e6 AS time FROM orders),
 lo AS (SELECT q.*, ev.time AS tl, value AS vl FROM q ASOF LEFT JOIN ev ON q.run_id = ev.run_id AND q.time >= ev.time),
 hi AS (SELECT o_orderkey, ev.time AS th, value AS vh FROM q ASOF LEFT JOIN ev ON q.run_id = ev.run_id AND q.time <= ev.time)
 SELECT o_orderkey, run_id, round(CASE WHEN tl IS NULL THEN vh WHEN th IS NULL OR tl = time THEN vl ELSE vl + (vh - vl) * (time - tl) / (th - tl) END, 4) AS value FROM lo JOIN hi USING (o_orderkey)""")
def _(spark, sf):
    runs = table(spark, sf, "events").agg(F.max("user_id") + 1).scalar()
    q = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % runs).alias("run_id"), (epoch_us("o_orderdate") / 1e6).alias("time"))
    tab = event_runs(spark, sf).select("run_id", "time", "value")
    return P.interp1(q, tab, ["run_id"], "time", "value", "value").select("o_orderkey", "run_id", r("value", 4))


# The part grid: part keys laid out on a lattice 10 x 20 x (as many layers as the table gives).

def part_grid(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.lit(0).alias("grid_id"), (k % 10).alias("ix"), F.floor(k % 200 / 10).alias("iy"), F.floor(k / 200).alias("iz"),
                                           F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("v"))


def part_lattice(spark, sf):
    layers = table(spark, sf, "part").agg(F.floor(F.max("p_partkey") / 200) + 1).first()[0]
    return Lattice(((0.0, 9.0, 10), (0.0, 19.0, 20), (0.0, float(layers - 1), int(layers))))


_GRID = "g AS (SELECT p_partkey % 10 AS ix, p_partkey % 200 // 10 AS iy, p_partkey // 200 AS iz, p_retailprice AS a, p_size::DOUBLE AS b FROM part)"


@query("j18_grid_interp", f"""WITH {_GRID}, q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_quantity - 5) / 4.0 AS x, l_discount * 250 - 2 AS y, l_tax * 10 AS z FROM lineitem),
 c AS (SELECT *, greatest(0, least(9, x)) AS cx, greatest(0, least(19, y)) AS cy, greatest(0, least((SELECT max(iz) FROM g), z)) AS cz FROM q),
 e AS (SELECT *, floor(cx) + dx AS jx, floor(cy) + dy AS jy, floor(cz) + dz AS jz, (CASE dx WHEN 0 THEN 1 - (cx - floor(cx)) ELSE cx - floor(cx) END) * (CASE dy WHEN 0 THEN 1 - (cy - floor(cy)) ELSE cy - floor(cy) END)
  * (CASE dz WHEN 0 THEN 1 - (cz - floor(cz)) ELSE cz - floor(cz) END) AS w FROM c, range(2) p(dx), range(2) s(dy), range(2) t(dz))
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(sum(w * a), 4) AS a, round(sum(w * b), 5) AS b FROM e JOIN g ON ix = jx AND iy = jy AND iz = jz WHERE w > 0 GROUP BY ALL""")
def _(spark, sf):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    q = table(spark, sf, "lineitem").select(F.lit(0).alias("grid_id"), F.struct(*names).alias("point"),
                                            F.array((F.col("l_quantity") - 5) / 4.0, F.col("l_discount") * 250 - 2, F.col("l_tax") * 10).alias("pos"))
    out = P.grid_interp(q, part_grid(spark, sf), part_lattice(spark, sf), 2, once=True)
    return out.select("point.*", r(F.col("value")[0], 4).alias("a"), r(F.col("value")[1], 5).alias("b"))


@query("j19_snap_to_lattice", """SELECT round(10 * (l_quantity - 1) / 49)::BIGINT AS ix, round(4 * l_tax / 0.08)::BIGINT AS iy, 0::BIGINT AS iz,
 max_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS value FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("pos", F.array("l_quantity", "l_tax", "l_discount"))
    spec = Lattice(((1.0, 50.0, 11), (0.0, 0.08, 5), (0.5, 0.5, 1)))
    return P.snap_to_lattice(df, spec, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_extendedprice").withColumnRenamed("l_extendedprice", "value")


@query("a23_grid_range", "SELECT 0 AS grid_id, least(min(p_retailprice), min(p_size)) AS low, greatest(max(p_retailprice), max(p_size)) AS high FROM part")
def _(spark, sf):
    return P.grid_range(part_grid(spark, sf))


@query("t05_lattice_order", f"WITH {_GRID} SELECT ix, iy, iz, row_number() OVER (ORDER BY iz, iy, ix) AS place FROM g")
def _(spark, sf):
    from stepfield.plans.ordered import Ordered
    g = lattice_order(part_grid(spark, sf).select("ix", "iy", "iz"), "F")
    return Ordered(g, [], ["iz", "iy", "ix"]).position("place").df


@query("h16_lattice", f"WITH {_GRID} SELECT ix, iy, iz, round(ix * 0.5 + 1, 6)::DOUBLE AS x, round(iy * 0.25, 6)::DOUBLE AS y, round(-iz * 1.0, 6)::DOUBLE AS z, a AS price FROM g")
def _(spark, sf):
    g = part_grid(spark, sf)
    layers = part_lattice(spark, sf).axes[2][2]
    lat = Lattice(((1.0, 5.5, 10), (0.0, 4.75, 20), (0.0, -float(layers - 1), layers)))
    rows = lat.rows(spark).join(g, ["ix", "iy", "iz"])
    return rows.select("ix", "iy", "iz", r("x"), r("y"), r("z"), F.col("v")[0].alias("price"))


@query("a25_fft", f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings), k AS (SELECT unnest(range(64)) - 32 AS k),
 s AS (SELECT vec_id, k, sum(v * cos(-2*pi()*k*n/64)) AS re, sum(v * sin(-2*pi()*k*n/64)) AS im FROM e, k GROUP BY ALL)
 SELECT vec_id, k + 32 AS ix, round(k * 2*pi() / 6.3, 6) AS k_ix, round(6.3 * (re * cos(-1) - im * sin(-1)), 4) AS re, round(6.3 * (re * sin(-1) + im * cos(-1)), 4) AS im FROM s""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("ix", "value"))
    out = SP.fft(e.withColumn("ix", F.col("ix").cast("bigint")), {"ix": (1.0, 7.3, 64)}, ["vec_id"])
    return out.select("vec_id", "ix", r("k_ix"), r("re", 4), r("im", 4))


@query("a25_fft_grid", f"""WITH {_GRID}, k AS (SELECT unnest(range(10)) - 5 AS k), l AS (SELECT unnest(range(20)) - 10 AS l),
 s1 AS (SELECT iy, iz, k, sum(a * cos(-2*pi()*k*ix/10)) AS re, sum(a * sin(-2*pi()*k*ix/10)) AS im FROM g, k GROUP BY ALL),
 s2 AS (SELECT iz, k, l, sum(re * cos(-2*pi()*l*iy/20) - im * sin(-2*pi()*l*iy/20)) AS re, sum(re * sin(-2*pi()*l*iy/20) + im * cos(-2*pi()*l*iy/20)) AS im FROM s1, l GROUP BY ALL)
 SELECT iz, k + 5 AS ix, l + 10 AS iy, round(re * 9 * 19, 1) AS re, round(im * 9 * 19, 1) AS im FROM s2""")
def _(spark, sf):
    g = part_grid(spark, sf).select("iz", "ix", "iy", F.col("v")[0].alias("value"))
    out = SP.fft(g, {"ix": (0.0, 9.0, 10), "iy": (0.0, 19.0, 20)}, ["iz"])
    return out.select("iz", "ix", "iy", r("re", 1), r("im", 1))


# Oscillations: two columns of each run of events, time in days. The SQL takes the same steps, with one common table per pass.

def _det(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


_NORMAL = [["n", "s1", "c1"], ["s1", "ss", "sc"], ["c1", "sc", "cc"]]


def _solved(right, det="dt"):
    return [f"({_det([[right[i] if j == p else _NORMAL[i][j] for j in range(3)] for i in range(3)])} / {det})" for p in range(3)]


_FIT_SUMS = ("count(*)::DOUBLE AS n, sum(s) AS s1, sum(c) AS c1, sum(s*s) AS ss, sum(s*c) AS sc, sum(c*c) AS cc, "
             + ", ".join(f"sum(y{k}) AS p{k}, sum(y{k}*y{k}) AS pp{k}, sum(y{k}*s) AS ps{k}, sum(y{k}*c) AS pc{k}" for k in (0, 1)))
_FIT_MORE = ("sum(u*s) AS us, sum(u*c) AS uc, sum(u*s*s) AS uss, sum(u*s*c) AS usc, sum(u*c*c) AS ucc, sum(u*u*s*s) AS vss, sum(u*u*s*c) AS vsc, "
             "sum(u*u*c*c) AS vcc, " + ", ".join(f"sum(y{k}*u*s) AS qs{k}, sum(y{k}*u*c) AS qc{k}" for k in (0, 1)))
_FIT_FOUND = ", ".join(f"{e} AS n{v}{k}" for k in (0, 1) for v, e in zip("oab", _solved([f"p{k}", f"ps{k}", f"pc{k}"])))
_FIT_ERROR = " + ".join(f"pp{k} - (no{k}*p{k} + na{k}*ps{k} + nb{k}*pc{k})" for k in (0, 1))
_FIT_DET = f"CASE WHEN abs({_det(_NORMAL)}) > 1e-9 * n THEN {_det(_NORMAL)} END AS dt"


def _fit_sql(frequency=None, rounds=6):
    start = ("greatest(coalesce(flips, 0), 1) * 0.5 / nullif(t1 - t0, 0)" if frequency is None else f"{frequency}::DOUBLE")
    sql = f"""WITH {EVENTS}, v AS MATERIALIZED (SELECT run_id, us, event_id, (us - 1704067200000000) / 86400e6 AS t, value - avg(value) OVER (PARTITION BY run_id) AS y0, ln(1 + value) AS y1 FROM ev),
 sm AS (SELECT run_id, us, event_id, coalesce(lag(y0, 2) OVER w, lag(y0) OVER w, y0) + 4 * coalesce(lag(y0) OVER w, y0) + 6 * y0 + 4 * coalesce(lead(y0) OVER w, y0)
   + coalesce(lead(y0, 2) OVER w, lead(y0) OVER w, y0) AS m FROM v WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)),
 fl AS (SELECT run_id, count(*) FILTER (m * l < 0) AS flips FROM (SELECT run_id, m, lag(m) OVER (PARTITION BY run_id ORDER BY us, event_id) AS l FROM sm) GROUP BY run_id),
 st AS (SELECT run_id, t0, {start} AS f0 FROM (SELECT run_id, min(t) AS t0, max(t) AS t1 FROM v GROUP BY run_id) JOIN fl USING (run_id)),
 z AS (SELECT run_id, t0, f0, y0, y1, f, sin(2 * pi() * f * (t - t0)) AS s, cos(2 * pi() * f * (t - t0)) AS c
   FROM (SELECT *, f0 * (1 + 0.6 * (k / 12e0 - 1)) AS f FROM st JOIN v USING (run_id), range(25) q(k) WHERE f0 > 0)),
 zs AS (SELECT run_id, t0, f0, f, {_FIT_SUMS} FROM z GROUP BY run_id, t0, f0, f), zd AS (SELECT *, {_FIT_DET} FROM zs), zf AS (SELECT *, {_FIT_FOUND} FROM zd),
 g0 AS MATERIALIZED (SELECT run_id, t0, f0 * 0.05e0 AS h, arg_min(f, {_FIT_ERROR}) AS f, 1e308 AS e, 0e0 AS d, {", ".join(f"NULL::DOUBLE AS {v}{k}" for k in (0, 1) for v in "oab")} FROM zf WHERE dt IS NOT NULL GROUP BY run_id, t0, f0)"""
    slopes = {k: [f"(na{k}*uc - nb{k}*us)", f"(na{k}*usc - nb{k}*uss)", f"(na{k}*ucc - nb{k}*usc)"] for k in (0, 1)}
    along = " + ".join(f"na{k}*qc{k} - nb{k}*qs{k} - (no{k}*{x[0]} + na{k}*{x[1]} + nb{k}*{x[2]})" for k, x in slopes.items())
    across = " + ".join(f"na{k}*na{k}*vcc - 2*na{k}*nb{k}*vsc + nb{k}*nb{k}*vss - ({' + '.join(a + '*' + b for a, b in zip(x, _solved(x)))})" for k, x in slopes.items())
    for i in range(1, rounds + 2):
        kept = ", ".join(f"CASE WHEN x.e1 <= o.e THEN x.n{v}{k} ELSE o.{v}{k} END AS {v}{k}" for k in (0, 1) for v in "oab")
        sql += f""",
 w{i} AS (SELECT run_id, y0, y1, t - t0 AS u, sin(2 * pi() * (f + d) * (t - t0)) AS s, cos(2 * pi() * (f + d) * (t - t0)) AS c FROM g{i - 1} JOIN v USING (run_id)),
 x{i} AS (SELECT *, {along} AS al, {across} AS ac, {_FIT_ERROR} AS e1 FROM (SELECT *, {_FIT_FOUND} FROM (SELECT *, {_FIT_DET} FROM (SELECT run_id, {_FIT_SUMS}, {_FIT_MORE} FROM w{i} GROUP BY run_id)))),
 g{i} AS MATERIALIZED (SELECT o.run_id, o.t0, o.h, CASE WHEN x.e1 <= o.e THEN o.f + o.d ELSE o.f END AS f, CASE WHEN x.e1 <= o.e THEN x.e1 ELSE o.e END AS e,
   CASE WHEN x.e1 <= o.e THEN greatest(-least(o.h, (o.f + o.d) / 2), least(least(o.h, (o.f + o.d) / 2), CASE WHEN ac > 0 THEN al / (ac * 2 * pi()) ELSE 0 END)) ELSE o.d / 2 END AS d, {kept}
   FROM g{i - 1} o JOIN x{i} x USING (run_id))"""
    rows = " UNION ALL ".join(f"SELECT run_id, '{name}' AS \"column\", f, o{k} AS o, a{k} AS a, b{k} AS b, t0 FROM g{rounds + 1} WHERE o0 IS NOT NULL" for k, name in ((0, "a"), (1, "b")))
    return sql + f""" SELECT run_id, "column", round(f, 4) + 0 AS frequency, round(o, 3) + 0 AS "offset", round(sqrt(a*a + b*b), 3) + 0 AS amplitude, round(atan2(b, a) - 2 * pi() * f * t0, 2) + 0 AS phase FROM ({rows})"""


def fitted_events(spark, sf, frequency=None):
    ev = event_runs(spark, sf)
    mean = ev.groupBy("run_id").agg(F.avg("value").alias("mean"))
    rows = ev.join(mean, "run_id").select("run_id", "us", "event_id", ((F.col("us") - 1704067200000000) / 86400e6).alias("t"), (F.col("value") - F.col("mean")).alias("a"), F.log1p("value").alias("b"))
    out = SP.fit_oscillation(rows, ["run_id"], "t", ["a", "b"], ["us", "event_id"], frequency)
    return out.select("run_id", "column", r("frequency", 4), r("offset", 3), r("amplitude", 3), r("phase", 2))


@query("a26_fit_oscillation", _fit_sql())
def _(spark, sf):
    return fitted_events(spark, sf)


@query("a26_fit_daily", _fit_sql(1.0))
def _(spark, sf):
    return fitted_events(spark, sf, 1.0)


# User functions and formulas

@query("f01_site_wise", f"WITH {MESH}, {SNAP} SELECT run_id, subfield, id, round(sum(2.5 * (a*a + b*c)), 5) AS total, count(*) AS n FROM snap GROUP BY ALL")
def _(spark, sf):
    def energy(value, k):
        return {"e": k * (value[0] * value[0] + value[1] * value[2])}

    return K.site_wise(snapshots(spark, sf), energy, {"k": 2.5}, {"total": r(F.sum("e"), 5), "n": F.count(F.lit(1))}, ["run_id", "subfield", "id"])


@query("f01_batch_aggregate", f"""WITH {MESH}, {SNAP} SELECT run_id, subfield, id, round(sum(q), 5) AS total, round(min(q), 6) AS least, round(max(q), 6) AS most
 FROM (SELECT *, a*(2*a + b) + b*(3*b - c) + c*(c + a) AS q FROM snap) GROUP BY ALL""")
def _(spark, sf):
    def energy(value):
        q = np.einsum("ni,ij,nj->n", value, np.array([[2.0, 1.0, 0.0], [0.0, 3.0, -1.0], [1.0, 0.0, 1.0]]), value)
        return {"total": q, "least": q, "most": q}

    out = K.batch_aggregate(snapshots(spark, sf), energy, ["value"], {"total": "sum", "least": "min", "most": "max"}, ["run_id", "subfield", "id"])
    return out.select("run_id", "subfield", "id", r("total", 5), r("least"), r("most"))


@query("f02_set_from_pos", f"WITH {MESH} SELECT mesh_id, pid, round(CASE WHEN x > 3 THEN 0 ELSE x * 2 + y END, 6) AS value FROM pts")
def _(spark, sf):
    out = K.set_from_pos(part_mesh(spark, sf).points, lambda pos: pos.map(lambda p: "none" if p[0] > 3 else p[0] * 2 + p[1]))
    return out.select("mesh_id", "pid", r("value"))


@query("f03_for_entries", f"WITH {MESH}, {SNAP} SELECT subfield, id, pid, mesh_id, round(greatest(a, 0), 6) AS a FROM snap")
def _(spark, sf):
    e = S.entrywise(snapshots(spark, sf)).filter("comp = 0").select("subfield", "id", F.col("site")[0].alias("pid"), "mesh_id", "entry")
    return K.for_entries(e, lambda p: p.assign(a=p["entry"].clip(lower=0))[["subfield", "id", "pid", "mesh_id", "a"]], "subfield string, id bigint, pid bigint, mesh_id bigint, a double").withColumn("a", r("a"))


@query("f06_formula", """SELECT vec_id, round(embedding[2]::DOUBLE*embedding[6]::DOUBLE - embedding[3]::DOUBLE*embedding[5]::DOUBLE + 2*embedding[1]::DOUBLE, 6) AS h0,
 round(embedding[3]::DOUBLE*embedding[4]::DOUBLE - embedding[1]::DOUBLE*embedding[6]::DOUBLE + 3*embedding[2]::DOUBLE, 6) AS h1,
 round(embedding[1]::DOUBLE*embedding[5]::DOUBLE - embedding[2]::DOUBLE*embedding[4]::DOUBLE + 4*embedding[3]::DOUBLE, 6) AS h2 FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>")).select("vec_id", F.slice("e", 1, 3).alias("m"), F.slice("e", 4, 3).alias("h"))
    t = [[2, 0, 0], [0, 3, 0], [0, 0, 4]]
    out = FM.formula(e, "out", ("i",), [(1.0, [("eps", "i", "j", "k"), ("m", "j"), ("h", "k")]), (1.0, [("T", "i", "j"), ("m", "j")])], {"i": 3, "j": 3, "k": 3}, {"T": t})
    return out.select("vec_id", *[r(F.col("out")[i]).alias(f"h{i}") for i in range(3)])


@query("f07_derive", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice * (1 - l_discount) / l_quantity AS unit FROM lineitem")
def _(spark, sf):
    registry = {"net": (["l_extendedprice", "l_discount"], lambda p, d: p * (1 - d)), "charge": (["net", "l_tax"], lambda n, t: n * (1 + t)),
                "unit": (["net", "l_quantity"], lambda n, q: n / q), "unused": (["charge"], lambda c: c * 2)}
    out = K.derive(table(spark, sf, "lineitem"), registry, ["charge", "unit"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "charge", "unit")
