"""Queries on field snapshots over the part mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.checks.base import EDGES, FACES, LOC, MESH, PREG, SNAP, part_mesh, query, r, snapshots, subfield_where, table, xyz_out
from stepfield.checks.meshes import PROPS, region_names
from stepfield.operators import mesh as M
from stepfield.operators import rules as R
from stepfield.operators import snapshots as S
from stepfield.plans.skewed import lookup

OUT = ["run_id", "subfield", "id"]
ABC = "round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c"
WS = f"WITH {MESH}, {SNAP}"


def pid():
    return F.col("site")[0].alias("pid")


@query("p05_select_fields", f"""{WS} SELECT run_id, field, subfield, id, pid, {ABC} FROM snap
 UNION ALL SELECT run_id, 'm_total', 'm_total', id, pid, round(sum(a), 6), round(sum(b), 6), round(sum(c), 6) FROM snap GROUP BY ALL""")
def _(spark, sf):
    return S.select_fields(snapshots(spark, sf), "m,+m", 3).select("run_id", "field", "subfield", "id", pid(), *xyz_out())


@query("a08_total", f"{WS} SELECT run_id, 'm_total' AS field, id, pid, round(sum(a), 6) AS a, round(sum(b), 6) AS b, round(sum(c), 6) AS c FROM snap GROUP BY ALL")
def _(spark, sf):
    s = snapshots(spark, sf)
    catalog = s.select("run_id", "field", "subfield").distinct().withColumn("unit", F.lit("A/m"))
    return S.total(s, ["m"], 3, catalog).select("run_id", "field", "id", pid(), *xyz_out())


@query("p06_select_ids", f"{WS} SELECT run_id, subfield, id, pid FROM snap WHERE id IN (1, 3)")
def _(spark, sf):
    return S.select_ids(snapshots(spark, sf), [1, -1]).select(*OUT, pid())


@query("p07_catalog", f"{WS} SELECT run_id, id, 'm' AS fields FROM snap GROUP BY ALL")
def _(spark, sf):
    return S.fields_by_id(snapshots(spark, sf)).select("run_id", "id", F.array_join("fields", ",").alias("fields"))


@query("p07_ids_by_field", f"{WS} SELECT DISTINCT run_id, field, id FROM snap")
def _(spark, sf):
    return S.ids_by_field(snapshots(spark, sf))


@query("p10_rescale_pos", f"WITH {MESH} SELECT mesh_id, pid, round(x * 1e-9 / 1e-6, 8) AS x, round(y * 1e-9 / 1e-6, 8) AS y FROM pts")
def _(spark, sf):
    p = S.rescale_pos(part_mesh(spark, sf).points, 1e-9, 1e-6)
    return p.select("mesh_id", "pid", r(F.col("pos")[0], 8).alias("x"), r(F.col("pos")[1], 8).alias("y"))


@query("s06_units", f"{WS} SELECT run_id, subfield, id, pid, round(a * 795.5, 5) AS a, round(b * 795.5, 5) AS b, round(c * 795.5, 5) AS c FROM snap")
def _(spark, sf):
    s = snapshots(spark, sf)
    catalog = s.select("run_id", "field", "subfield").distinct().withColumn("unit", F.lit("Oe"))
    factors = catalog.select("unit").distinct().withColumn("factor", F.lit(795.5))
    return S.convert(s, catalog, factors, 3).select(*OUT, pid(), *xyz_out(digits=5))


@query("p14_where_region", f"""WITH {MESH}, {FACES}, {PREG}, {PROPS}, q AS (SELECT mesh_id, pid, count(DISTINCT region) AS n,
 count(DISTINCT CASE WHEN prop = 'magnetic' THEN region END) AS m, count(DISTINCT CASE WHEN prop = 'CHINA' OR prop LIKE '%_2' THEN region END) AS x
 FROM preg LEFT JOIN props USING (mesh_id, region) GROUP BY ALL) SELECT mesh_id, pid FROM q WHERE (m > 0 AND NOT m = n) OR n = 3""")
def _(spark, sf):
    sites = M.point_regions(part_mesh(spark, sf))
    test = (R.some("magnetic") & ~R.all_of("magnetic")) | R.count(3)
    return R.where_region(sites, region_names(spark, sf), test).select("mesh_id", "pid")


_RULES = [(3.0, None), (1.0, "Brand#1"), (2.0, ["Brand#2", "Brand#3"]), (7.0, "Brand#3")]


@query("p15_assign", "SELECT p_partkey, p_brand AS material, CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#3' THEN 7 ELSE 3 END::DOUBLE AS value FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("material"))
    return R.assign(p, R.rules_frame(spark, _RULES))


@query("p16_as_constant", "SELECT p_brand AS material, max(p_retailprice) AS value FROM part WHERE p_brand = 'Brand#4' GROUP BY p_brand")
def _(spark, sf):
    # The rules come from the table: the highest price of each brand.
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("material")).agg(F.min("p_partkey").alias("ord"), F.max("p_retailprice").alias("value"))
    return R.as_constant(p.select("ord", "material", "value"), "Brand#4").withColumn("material", F.lit("Brand#4"))


@query("p17_set_field", f"""WITH {MESH} SELECT mesh_id, pid, round(2 * (x + 1) / sqrt((x+1)**2 + y**2 + z**2), 6) AS a, round(2 * y / sqrt((x+1)**2 + y**2 + z**2), 6) AS b,
 round(2 * z / sqrt((x+1)**2 + y**2 + z**2), 6) AS c FROM pts""")
def _(spark, sf):
    p = part_mesh(spark, sf).points
    pos = F.col("pos")
    return S.set_field(p, F.array(pos[0] + 1.0, pos[1], pos[2]), normalise=True, scale=2.0).select("mesh_id", "pid", *xyz_out())


@query("p18_flatten_tensors", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS v_0, round(embedding[2]::DOUBLE, 6) AS v_1, round(embedding[1]::DOUBLE*embedding[3]::DOUBLE, 6) AS t_02, round(embedding[2]::DOUBLE*embedding[2]::DOUBLE, 6) AS t_11 FROM embeddings")
def _(spark, sf):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    e = table(spark, sf, "embeddings").select("vec_id", v.alias("v")).withColumn("t", F.transform("v", lambda x: F.transform("v", lambda y: x * y)))
    f = S.flatten_tensors(e, {"v": (3,), "t": (3, 3)})
    return f.select("vec_id", r("v_0"), r("v_1"), r("t_02"), r("t_11"))


@query("p19_entrywise", f"{WS} SELECT run_id, subfield, id, pid, unnest([0, 1, 2])::INT AS comp, unnest([round(a, 6), round(b, 6), round(c, 6)]) AS entry FROM snap")
def _(spark, sf):
    return S.entrywise(snapshots(spark, sf)).select(*OUT, pid(), "comp", r("entry"))


@query("p20_by_site", f"""{WS} SELECT run_id, id, pid, round(max(CASE WHEN region = 1 THEN a END), 6) AS m1, round(max(CASE WHEN region = 2 THEN b END), 6) AS m2,
 round(max(CASE WHEN region = 3 THEN c END), 6) AS m3 FROM snap GROUP BY ALL""")
def _(spark, sf):
    t = S.by_site(S.entrywise(snapshots(spark, sf)), ["m_1", "m_2", "m_3"], 3)
    return t.select("run_id", "id", pid(), *[r(F.col(f"m_{i + 1}")[i]).alias(f"m{i + 1}") for i in range(3)])


@query("p21_field_of", f"{WS} SELECT DISTINCT run_id, field, subfield FROM snap WHERE subfield = 'm_2'")
def _(spark, sf):
    return S.field_of(snapshots(spark, sf).select("run_id", "field", "subfield").distinct(), "m_2")


@query("p28_defined_regions", f"{WS} SELECT DISTINCT run_id, mesh_id, 'all' AS subfield, region::INT AS region FROM snap WHERE region <= 2")
def _(spark, sf):
    s = snapshots(spark, sf).filter("subfield in ('m_1', 'm_2')").withColumn("subfield", F.lit("all"))
    mesh = part_mesh(spark, sf)
    return S.defined_regions(s, mesh)


@query("j01_site_positions", f"""WITH {MESH}, {EDGES} SELECT e.mesh_id, src, dst, round((a.x + b.x) / 2, 6) AS a, round((a.y + b.y) / 2, 6) AS b, round((a.z + b.z) / 2, 6) AS c
 FROM edg e JOIN pts a ON a.mesh_id = e.mesh_id AND a.pid = src JOIN pts b ON b.mesh_id = e.mesh_id AND b.pid = dst""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    sites = M.edges(m).select("mesh_id", F.array("src", "dst").alias("site"))
    return S.site_positions(sites, m.points).select("mesh_id", F.col("site")[0].alias("src"), F.col("site")[1].alias("dst"), *xyz_out("pos"))


@query("s09_subfield_positions", f"{WS} SELECT DISTINCT s.mesh_id, subfield, pid, round(x * 1e-3, 8) AS x, round(y * 1e-3, 8) AS y FROM snap s JOIN pts USING (mesh_id, pid)")
def _(spark, sf):
    m = part_mesh(spark, sf)
    s = snapshots(spark, sf, m)
    pos = S.site_positions(s, m.points, factor=1e-3)
    sites = s.select("mesh_id", "subfield", "site").distinct()
    return lookup(sites, pos, ["mesh_id", "site"]).select("mesh_id", "subfield", pid(), r(F.col("pos")[0], 8).alias("x"), r(F.col("pos")[1], 8).alias("y"))


@query("j02_to_point_order", f"""{WS}, k AS (SELECT DISTINCT run_id, mesh_id, subfield, id FROM snap)
 SELECT run_id, subfield, id, pid, round(coalesce(a, 0), 6) AS a, round(coalesce(c, 0), 6) AS c FROM k JOIN pts USING (mesh_id) LEFT JOIN snap USING (run_id, mesh_id, subfield, id, pid)""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    s = S.to_point_order(snapshots(spark, sf, m), m.points, 3)
    return s.select(*OUT, "pid", r(F.col("value")[0]).alias("a"), r(F.col("value")[2]).alias("c"))


@query("j03_realign", f"""{WS}, n AS (SELECT mesh_id, pid, row_number() OVER (PARTITION BY mesh_id ORDER BY z, pid) - 1 AS np FROM pts),
 o AS (SELECT mesh_id, pid, row_number() OVER (PARTITION BY mesh_id ORDER BY pid) - 1 AS k FROM pts) SELECT run_id, subfield, id, np AS pid, {ABC} FROM snap JOIN n USING (mesh_id, pid)""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    now = M.sort_mesh(m, 2)[1]
    saved = m.points.select("mesh_id", F.col("pid").alias("new_pid"), F.col("pid").alias("orig_pid"))
    return S.realign(snapshots(spark, sf, m), saved, now).select(*OUT, pid(), *xyz_out())


@query("j10_combine", f"""{WS} SELECT run_id, subfield, pid, round(sum(CASE id WHEN 0 THEN 2 WHEN 3 THEN -0.5 END * a), 6) AS a, round(sum(CASE id WHEN 0 THEN 2 WHEN 3 THEN -0.5 END * b), 6) AS b,
 round(sum(CASE id WHEN 0 THEN 2 WHEN 3 THEN -0.5 END * c), 6) AS c FROM snap WHERE id IN (0, 3) GROUP BY ALL""")
def _(spark, sf):
    return S.combine(snapshots(spark, sf), [(2.0, 0), (-0.5, 3)], 3).select("run_id", "subfield", pid(), *xyz_out())


@query("j11_variation", f"""{WS} SELECT s.run_id, s.subfield, s.id, s.pid, round(s.a - (0.5 * p.a + 0.5 * q.a), 6) AS a, round(s.b - (0.5 * p.b + 0.5 * q.b), 6) AS b,
 round(s.c - (0.5 * p.c + 0.5 * q.c), 6) AS c FROM snap s JOIN snap p ON p.run_id = s.run_id AND p.subfield = s.subfield AND p.pid = s.pid AND p.id = 0
 JOIN snap q ON q.run_id = s.run_id AND q.subfield = s.subfield AND q.pid = s.pid AND q.id = 1""")
def _(spark, sf):
    return S.variation(snapshots(spark, sf), 0.25, 3).select(*OUT, pid(), *xyz_out())


def _second(s):
    """The same sites with the components turned round."""
    v = F.col("value")
    return s.withColumn("value", F.array(v[1], v[2], v[0]))


@query("j12_diff_norm", f"""{WS} SELECT run_id, subfield, id, round(sqrt(max((a-b)**2+(b-c)**2+(c-a)**2)), 6) AS max_norm, round(sqrt(sum((a-b)**2+(b-c)**2+(c-a)**2)), 5) AS l2_norm FROM snap GROUP BY ALL""")
def _(spark, sf):
    s = snapshots(spark, sf)
    return S.diff_norm(s, _second(s), 3).select(*OUT, r("max_norm"), r("l2_norm", 5))


@query("j13_inner", f"{WS} SELECT run_id, subfield, id, round(sum(a*b+b*c+c*a), 5) AS product FROM snap GROUP BY ALL")
def _(spark, sf):
    s = snapshots(spark, sf)
    return S.inner(s, _second(s), 3).select(*OUT, r("product", 5))


@query("j14_axpby", f"{WS} SELECT run_id, subfield, id, pid, round(2*a-3*b, 6) AS a, round(2*b-3*c, 6) AS b, round(2*c-3*a, 6) AS c FROM snap")
def _(spark, sf):
    s = snapshots(spark, sf)
    return S.axpby(2.0, s, -3.0, _second(s), 3).select(*OUT, pid(), *xyz_out())


@query("j15_push", f"{WS} SELECT run_id, subfield, id, pid, round(CASE WHEN pid % 3 = 0 THEN 10 * a ELSE a END, 6) AS a FROM snap")
def _(spark, sf):
    s = snapshots(spark, sf)
    part = S.scale(s.filter(F.col("site")[0] % 3 == 0), 10.0, 3)
    return S.push(part, s).select(*OUT, pid(), r(F.col("value")[0]).alias("a"))


@query("j15_pull", f"{WS} SELECT run_id, subfield, id, pid, round(a, 6) AS a FROM snap WHERE pid % 3 = 0")
def _(spark, sf):
    s = snapshots(spark, sf)
    part = S.scale(s.filter(F.col("site")[0] % 3 == 0), 10.0, 3)
    return S.pull(s, part).select(*OUT, pid(), r(F.col("value")[0]).alias("a"))


INT = f"""WITH {LOC}, {SNAP}, rv AS (SELECT mesh_id, corn.region, pid, sum(abs(svol) / 4) AS v FROM corn JOIN vol USING (mesh_id, sid) GROUP BY ALL)"""


@query("a02_integrate", f"""{INT}, i AS (SELECT run_id, subfield, id, sum(a*v) AS a, sum(b*v) AS b, sum(c*v) AS c FROM snap JOIN rv USING (mesh_id, region, pid) GROUP BY ALL)
 SELECT run_id, subfield, id, unnest([0, 1, 2])::INT AS comp, round(unnest([a, b, c]), 5) AS integral FROM i""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    v = S.subfield_volumes(m, subfield_where(spark, m))
    return S.integrate(snapshots(spark, sf, m), v, 3).select(*OUT, "comp", r("integral", 5))


@query("a02_integrate_periodic", f"""WITH {LOC}, {SNAP}, own AS (SELECT mesh_id, pid, sum(abs(svol)/4) AS v FROM corn JOIN vol USING (mesh_id, sid) GROUP BY ALL),
 side AS (SELECT mesh_id, (pid // 81) * 9 + pid % 9 AS gid, pid FROM pts WHERE pid % 81 // 9 IN (0, 8)),
 grp AS (SELECT mesh_id, gid, min(pid) OVER (PARTITION BY mesh_id, gid) AS lead, pid FROM side QUALIFY count(*) OVER (PARTITION BY mesh_id, gid) = 2),
 tot AS (SELECT mesh_id, gid, sum(v) AS t FROM grp JOIN own USING (mesh_id, pid) GROUP BY ALL),
 shared AS (SELECT mesh_id, pid, coalesce(t, v) AS v FROM own LEFT JOIN grp USING (mesh_id, pid) LEFT JOIN tot USING (mesh_id, gid) WHERE lead IS NULL OR lead = pid)
 SELECT run_id, subfield, id, 0::INT AS comp, round(sum(a * v), 5) AS integral FROM snap JOIN shared USING (mesh_id, pid) GROUP BY ALL""")
def _(spark, sf):
    m = part_mesh(spark, sf, periodic=True)
    s = snapshots(spark, sf, m)
    return S.integrate(s, M.site_volumes(m), 3, m.periodic).filter("comp = 0").select(*OUT, "comp", r("integral", 5))


@query("a03_average", f"""{INT}, t AS (SELECT mesh_id, region, sum(abs(svol)) AS t FROM vol GROUP BY ALL),
 i AS (SELECT run_id, subfield, id, sum(a*v) / any_value(t) AS a, sum(b*v) / any_value(t) AS b, sum(c*v) / any_value(t) AS c FROM snap JOIN rv USING (mesh_id, region, pid) JOIN t USING (mesh_id, region) GROUP BY ALL)
 SELECT run_id, subfield, id, unnest([0, 1, 2])::INT AS comp, round(unnest([a, b, c]), 6) AS average FROM i""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    return S.average(snapshots(spark, sf, m), m, subfield_where(spark, m), 3).select(*OUT, "comp", r("average"))


_ANG = """se AS (SELECT DISTINCT a.mesh_id, a.region, a.pid AS src, b.pid AS dst FROM corn a JOIN corn b ON a.mesh_id = b.mesh_id AND a.sid = b.sid AND a.pid < b.pid),
 ang AS (SELECT p.run_id, p.mesh_id, p.subfield, p.id, max(degrees(acos(least(1, greatest(-1, (p.a*q.a+p.b*q.b+p.c*q.c) / (sqrt(p.a*p.a+p.b*p.b+p.c*p.c)*sqrt(q.a*q.a+q.b*q.b+q.c*q.c))))))) AS m
  FROM se JOIN snap p ON p.mesh_id = se.mesh_id AND p.region = se.region AND p.pid = se.src JOIN snap q ON q.mesh_id = se.mesh_id AND q.region = se.region AND q.pid = se.dst AND q.id = p.id GROUP BY ALL)"""


@query("a06_max_angle", f"WITH {MESH}, {SNAP}, {_ANG} SELECT run_id, subfield, id, round(m, 4) AS max_angle FROM ang")
def _(spark, sf):
    m = part_mesh(spark, sf)
    return S.max_angle(snapshots(spark, sf, m), m, subfield_where(spark, m)).select(*OUT, r("max_angle", 4))


@query("a04_averages", f"""{INT}, {_ANG}, t AS (SELECT mesh_id, region, sum(abs(svol)) AS t FROM vol GROUP BY ALL),
 i AS (SELECT run_id, id, step, stage, time, subfield, sum(a*v) / any_value(t) AS a, sum(c*v) / any_value(t) AS c FROM snap JOIN rv USING (mesh_id, region, pid) JOIN t USING (mesh_id, region) GROUP BY ALL)
 SELECT run_id, id, step, stage, time, round(max(CASE WHEN subfield = 'm_1' THEN a END), 6) AS m_1_0, round(max(CASE WHEN subfield = 'm_3' THEN c END), 6) AS m_3_2,
 round(max(CASE WHEN subfield = 'm_2' THEN m END), 4) AS maxangle_m_2 FROM i JOIN ang USING (run_id, subfield, id) GROUP BY ALL""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    names = [f"m_{s}_{i}" for s in (1, 2, 3) for i in range(3)] + [f"maxangle_m_{s}" for s in (1, 2, 3)]
    t = S.averages(snapshots(spark, sf, m), m, subfield_where(spark, m), names=names)
    return t.select("run_id", "id", "step", "stage", "time", r("m_1_0"), r("m_3_2"), r("maxangle_m_2", 4))


@query("a07_norms", f"{WS} SELECT run_id, subfield, id, round(sqrt(max(a*a+b*b+c*c)), 6) AS max_norm, round(sqrt(sum(a*a+b*b+c*c)), 5) AS l2_norm FROM snap GROUP BY ALL")
def _(spark, sf):
    return S.norms(snapshots(spark, sf), 3).select(*OUT, r("max_norm"), r("l2_norm", 5))


@query("a16_equalize_periodic", f"""{WS}, side AS (SELECT mesh_id, (pid // 81) * 9 + pid % 9 AS gid, pid FROM pts WHERE pid % 81 // 9 IN (0, 8)),
 grp AS (SELECT mesh_id, gid, pid FROM side QUALIFY count(*) OVER (PARTITION BY mesh_id, gid) = 2),
 j AS (SELECT snap.*, gid FROM snap LEFT JOIN grp USING (mesh_id, pid))
 SELECT run_id, subfield, id, pid, round(CASE WHEN gid IS NULL THEN a ELSE avg(a) OVER (PARTITION BY run_id, subfield, id, gid) END, 6) AS a FROM j""")
def _(spark, sf):
    m = part_mesh(spark, sf, periodic=True)
    return S.equalize_periodic(snapshots(spark, sf, m), m.periodic, 3).select(*OUT, pid(), r(F.col("value")[0]).alias("a"))


@query("a27_anisotropy_energy", f"""{INT} SELECT run_id, subfield, id, round(sum((-2*c*c - 0.5*c*c*c*c) * v), 6) AS uniaxial,
 round(sum((3*(a*a*b*b + a*a*c*c + b*b*c*c) + 2*a*a*b*b*c*c + ((a*b)**4 + (a*c)**4 + (b*c)**4)) * v), 6) AS cubic FROM snap JOIN rv USING (mesh_id, region, pid) GROUP BY ALL""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    s, v = snapshots(spark, sf, m), S.subfield_volumes(m, subfield_where(spark, m))
    u = S.anisotropy_energy(s, S.uniaxial_energy([0, 0, 2.0], 2.0, 0.5), v).select(*OUT, r("energy").alias("uniaxial"))
    c = S.anisotropy_energy(s, S.cubic_energy([1, 0, 0], [0.3, 1, 0], 3.0, 2.0, 1.0), v).select(*OUT, r("energy").alias("cubic"))
    return u.join(c, OUT)


@query("a28_to_amount", f"{INT} SELECT run_id, subfield, id, pid, round(a * v, 7) AS a, round(a, 6) AS back FROM snap JOIN rv USING (mesh_id, region, pid)")
def _(spark, sf):
    m = part_mesh(spark, sf)
    v = S.subfield_volumes(m, subfield_where(spark, m))
    amount = S.to_amount(snapshots(spark, sf, m), v, 3)
    back = S.to_density(amount, v, 3).select(*S.KEY, "site", F.col("value").alias("_back"))
    return lookup(amount, back, [*S.KEY, "site"]).select(*OUT, pid(), r(F.col("value")[0], 7).alias("a"), r(F.col("_back")[0]).alias("back"))


@query("w12_row_ids", f"{WS} SELECT run_id, subfield, id, row_number() OVER (PARTITION BY run_id, subfield ORDER BY id) - 1 AS row FROM (SELECT DISTINCT run_id, subfield, id FROM snap)")
def _(spark, sf):
    return S.saves(snapshots(spark, sf)).select(*OUT, "row")


@query("u01_all_ids", "SELECT user_id::VARCHAR AS run_id, event_id AS id FROM events UNION SELECT l_orderkey::VARCHAR, l_partkey FROM lineitem")
def _(spark, sf):
    a = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("id"))
    return S.all_ids(a, table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_partkey").alias("id")))


@query("u02_common", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT event_id FROM events INTERSECT SELECT o_custkey FROM orders")
def _(spark, sf):
    a, b, c = [table(spark, sf, t).select(F.col(n).alias("k")) for t, n in (("lineitem", "l_partkey"), ("events", "event_id"), ("orders", "o_custkey"))]
    return S.common(a, b, c)


@query("u03_minus", "SELECT event_id AS k FROM events EXCEPT SELECT o_custkey FROM orders")
def _(spark, sf):
    return S.minus(table(spark, sf, "events").select(F.col("event_id").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("u06_merge_requests", f"{WS} SELECT DISTINCT run_id, id, subfield AS field FROM snap WHERE subfield = 'm_1' OR (subfield <> 'm_3' AND id > 1)")
def _(spark, sf):
    s = snapshots(spark, sf).select("run_id", "id", F.col("subfield").alias("field"))
    return S.merge_requests(s.filter("field = 'm_1'"), s.filter("field <> 'm_3' and id > 1"))


@query("j26_subfield_jumps", f"""WITH {MESH}, {FACES}, {PREG}, el AS (SELECT mesh_id, pid, string_agg(region::VARCHAR, '+' ORDER BY region) AS element FROM preg GROUP BY ALL),
 rs AS (SELECT DISTINCT mesh_id, element, 'm_' || region AS subfield FROM el JOIN preg USING (mesh_id, pid) WHERE region >= 1)
 SELECT a.mesh_id, a.element AS element_a, b.element AS element_b, a.subfield FROM rs a JOIN (SELECT DISTINCT mesh_id, element FROM rs) b ON a.mesh_id = b.mesh_id
 WHERE NOT EXISTS (SELECT 1 FROM rs x WHERE x.mesh_id = a.mesh_id AND x.element = b.element AND x.subfield = a.subfield)""")
def _(spark, sf):
    pr = M.point_regions(part_mesh(spark, sf))
    el = pr.select("mesh_id", F.array_join(F.col("regions").cast("array<string>"), "+").alias("element"), F.explode("regions").alias("region"))
    rs = el.filter("region >= 1").select("mesh_id", "element", F.concat(F.lit("m_"), "region").alias("subfield")).distinct()
    return S.subfield_jumps(rs)


@query("j23_pending_states", """SELECT brand, size, 'fixed' AS kind FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT DISTINCT p_size AS size FROM part)
 WHERE (brand, size) NOT IN (SELECT (p_brand, p_size) FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    axes = {"brand": p.select("p_brand"), "size": p.select("p_size")}
    done = p.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return R.pending_states(axes, {"kind": "fixed"}, done)


@query("j24_regions_by_entity", f"WITH {MESH}, {PROPS} SELECT DISTINCT mesh_id, region, prop FROM simp JOIN props USING (mesh_id, region)")
def _(spark, sf):
    return R.regions_by_entity(region_names(spark, sf), part_mesh(spark, sf).simplices)


@query("j25_per_material", f"WITH {MESH}, {PROPS} SELECT mesh_id, sid, prop, round(region * length(prop) + sid / 10.0::DOUBLE, 6) AS e FROM simp JOIN props USING (mesh_id, region)")
def _(spark, sf):
    s = part_mesh(spark, sf).simplices
    e = R.per_material(s, region_names(spark, sf), F.col("region") * F.length("prop") + F.col("sid") / 10.0, "e", ("mesh_id", "region"))
    return e.select("mesh_id", "sid", "prop", r("e"))
