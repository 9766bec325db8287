"""Queries on the part mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.checks.base import EDGES, ELEN, FACES, LOC, MESH, PREG, QUAL, part_mesh, query, r, table
from stepfield.functions import geometry as g
from stepfield.operators import graph as G
from stepfield.operators import mesh as M
from stepfield.plans.skewed import lookup

V = M.vertices


def ids(c, n, names="abcd"):
    return [F.col(c)[i].alias(names[i]) for i in range(n)]


@query("h05_det_bary", f"""WITH {LOC} SELECT mesh_id, sid, round(svol * 6, 6) AS det, round(0.1::DOUBLE, 6) AS w0, round(0.2::DOUBLE, 6) AS w1, round(0.3::DOUBLE, 6) AS w2, round(0.4::DOUBLE, 6) AS w3 FROM vol""")
def _(spark, sf):
    v = V(3)
    p = [0.1 * v[0][a] + 0.2 * v[1][a] + 0.3 * v[2][a] + 0.4 * v[3][a] for a in range(3)]
    return M.located(part_mesh(spark, sf)).select("mesh_id", "sid", r(g.signed_volume(v) * 6.0).alias("det"), *[r(w).alias(f"w{k}") for k, w in enumerate(g.bary(p, v))])


@query("h07_circles", f"""WITH {LOC}, {QUAL} SELECT mesh_id, sid, round(3*v/(sqrt(h0*(h0-e12)*(h0-e13)*(h0-e23))+sqrt(h1*(h1-e02)*(h1-e03)*(h1-e23))
 +sqrt(h2*(h2-e01)*(h2-e03)*(h2-e13))+sqrt(h3*(h3-e01)*(h3-e02)*(h3-e12))), 5) AS r_in, round(sqrt((p+q+s)*(p+q-s)*(p-q+s)*(q+s-p))/(24*v), 5) AS r_out, 0.0::DOUBLE AS off FROM heron""")
def _(spark, sf):
    v = V(3)
    c = g.circum_centre(v)
    return M.located(part_mesh(spark, sf)).select("mesh_id", "sid", r(g.in_radius(v), 5).alias("r_in"), r(g.circum_radius(v), 5).alias("r_out"),
                                                  r(g.length(g.sub(c, v[2])) - g.circum_radius(v), 4).alias("off"))


@query("h27_face_normal", f"""WITH {LOC}, n AS (SELECT mesh_id, sid, ((y2-y1)*(z3-z1)-(z2-z1)*(y3-y1))/2 AS nx, ((z2-z1)*(x3-x1)-(x2-x1)*(z3-z1))/2 AS ny,
 ((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1))/2 AS nz, x0-x1 AS dx, y0-y1 AS dy, z0-z1 AS dz FROM loc)
 SELECT mesh_id, sid, round(CASE WHEN nx*dx+ny*dy+nz*dz > 0 THEN -nx ELSE nx END, 6) AS nx, round(CASE WHEN nx*dx+ny*dy+nz*dz > 0 THEN -ny ELSE ny END, 6) AS ny FROM n""")
def _(spark, sf):
    n = g.face_normal(V(3), 0)
    return M.located(part_mesh(spark, sf)).select("mesh_id", "sid", r(n[0]).alias("nx"), r(n[1]).alias("ny"))


_SA = """u{a} AS (SELECT mesh_id, region, v{a} AS pid, x{b}-x{a} AS ax, y{b}-y{a} AS ay, z{b}-z{a} AS az, x{c}-x{a} AS bx, y{c}-y{a} AS by_, z{c}-z{a} AS bz,
 x{d}-x{a} AS cx, y{d}-y{a} AS cy, z{d}-z{a} AS cz FROM loc)"""
_SOLID = ", ".join(_SA.format(a=a, b=b, c=c, d=d) for a, b, c, d in ((0, 1, 2, 3), (1, 0, 2, 3), (2, 0, 1, 3), (3, 0, 1, 2))) + """,
ua AS (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3),
ub AS (SELECT mesh_id, region, pid, 2 * atan2(abs(ax*(by_*cz-bz*cy)-ay*(bx*cz-bz*cx)+az*(bx*cy-by_*cx)),
 sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+by_*by_+bz*bz)*sqrt(cx*cx+cy*cy+cz*cz) + (ax*bx+ay*by_+az*bz)*sqrt(cx*cx+cy*cy+cz*cz)
 + (bx*cx+by_*cy+bz*cz)*sqrt(ax*ax+ay*ay+az*az) + (cx*ax+cy*ay+cz*az)*sqrt(bx*bx+by_*by_+bz*bz)) AS o FROM ua)"""


@query("a19_solid_angles", f"WITH {LOC}, {_SOLID} SELECT mesh_id, pid, region, round(sum(o), 4) AS angle FROM ub GROUP BY ALL")
def _(spark, sf):
    return M.solid_angles(part_mesh(spark, sf), per_region=True).select("mesh_id", "pid", "region", r("angle", 4))


@query("h09_solid_angle", f"WITH {LOC}, {_SOLID} SELECT mesh_id, pid, round(sum(o), 4) AS angle FROM ub GROUP BY ALL")
def _(spark, sf):
    return M.solid_angles(part_mesh(spark, sf)).select("mesh_id", "pid", r("angle", 4))


@query("j05_neighbours", f"WITH {MESH}, {FACES} SELECT mesh_id, sid_a, sid_b, face[1] AS a, face[2] AS b, face[3] AS c FROM ftab WHERE n = 2")
def _(spark, sf):
    return M.neighbours(part_mesh(spark, sf)).select("mesh_id", "sid_a", "sid_b", *ids("face", 3))


@query("j06_interfaces", f"""WITH {MESH}, {FACES} SELECT mesh_id, face[1] AS a, face[2] AS b, face[3] AS c, CASE WHEN n = 1 THEN -1 ELSE low END AS region_a, high AS region_b
 FROM ftab WHERE n = 1 OR low <> high""")
def _(spark, sf):
    return M.interfaces(part_mesh(spark, sf)).select("mesh_id", *ids("face", 3), "region_a", "region_b")


@query("j07_edges", f"WITH {MESH}, {EDGES} SELECT * FROM edg")
def _(spark, sf):
    return M.edges(part_mesh(spark, sf))


@query("j08_adjacency", f"WITH {MESH}, {EDGES} SELECT mesh_id, src AS pid, dst AS neighbour FROM edg UNION ALL SELECT mesh_id, dst, src FROM edg")
def _(spark, sf):
    return M.adjacency(part_mesh(spark, sf))


@query("a01_site_volumes", f"""WITH {LOC}, own AS (SELECT mesh_id, pid, sum(abs(svol)/4) AS v FROM corn JOIN vol USING (mesh_id, sid) GROUP BY ALL),
 side AS (SELECT mesh_id, (pid // 81) * 9 + pid % 9 AS gid, pid FROM pts WHERE pid % 81 // 9 IN (0, 8)),
 grp AS (SELECT mesh_id, gid, pid FROM side WHERE (mesh_id, gid) IN (SELECT (mesh_id, gid) FROM side GROUP BY mesh_id, gid HAVING count(*) = 2)),
 tot AS (SELECT mesh_id, gid, sum(v) AS t FROM grp JOIN own USING (mesh_id, pid) GROUP BY ALL)
 SELECT mesh_id, pid, round(coalesce(t, v) + 1e-9, 6) AS volume FROM own LEFT JOIN grp USING (mesh_id, pid) LEFT JOIN tot USING (mesh_id, gid)""")
def _(spark, sf):
    # Some sums end in an exact 5 at the seventh digit; the shift keeps the order of summing from deciding.
    return M.site_volumes(part_mesh(spark, sf, periodic=True)).select("mesh_id", "pid", r(F.col("volume") + 1e-9).alias("volume"))


@query("a05_region_volumes", f"""WITH {LOC}, f AS (SELECT mesh_id, region, sum(abs(svol)) AS v FROM vol GROUP BY ALL)
 SELECT mesh_id, region::INT AS region, round(coalesce(v, 0), 4) AS volume FROM (SELECT mesh_id, unnest(range(0, max(region) + 1)) AS region FROM f GROUP BY mesh_id) LEFT JOIN f USING (mesh_id, region)""")
def _(spark, sf):
    return M.region_volumes(part_mesh(spark, sf)).select("mesh_id", "region", r("volume", 4))


def region_names(spark, sf):
    """Bridge region → names: the nations of region 1, 2, 3 of the star schema, for every mesh."""
    n = table(spark, sf, "nation").filter("n_regionkey between 1 and 3").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("prop"))
    magnetic = n.filter("region <= 2").select("region", F.lit("magnetic").alias("prop")).distinct()
    return n.unionByName(magnetic).withColumn("mesh_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))


PROPS = """props AS (SELECT mesh_id, region, prop FROM (SELECT n_regionkey AS region, n_name AS prop FROM nation WHERE n_regionkey BETWEEN 1 AND 3
 UNION ALL SELECT DISTINCT n_regionkey, 'magnetic' FROM nation WHERE n_regionkey IN (1, 2)), (SELECT DISTINCT p_partkey % 4 AS mesh_id FROM part))"""


@query("a05_material_volumes", f"WITH {LOC}, {PROPS} SELECT mesh_id, prop, round(sum(abs(svol)), 4) AS volume FROM vol JOIN props USING (mesh_id, region) GROUP BY ALL")
def _(spark, sf):
    return M.material_volumes(part_mesh(spark, sf), region_names(spark, sf)).select("mesh_id", "prop", r("volume", 4))


@query("a09_surfaces", f"""WITH {MESH}, {FACES} SELECT mesh_id, face[1] AS a, face[2] AS b, face[3] AS c, low AS region FROM ftab WHERE n = 1 OR low <> high
 UNION ALL SELECT mesh_id, face[1], face[2], face[3], high FROM ftab WHERE n > 1 AND low <> high""")
def _(spark, sf):
    return M.surfaces(part_mesh(spark, sf)).select("mesh_id", *ids("face", 3), "region")


@query("a10_point_regions", f"WITH {MESH}, {FACES}, {PREG} SELECT mesh_id, pid, string_agg(region::VARCHAR, ',' ORDER BY region) AS regions FROM preg GROUP BY ALL")
def _(spark, sf):
    return M.point_regions(part_mesh(spark, sf)).select("mesh_id", "pid", F.array_join(F.col("regions").cast("array<string>"), ",").alias("regions"))


@query("a11_mesh_info", f"""WITH {LOC}, {FACES}, {EDGES}, {ELEN}, {PREG}, bord AS (SELECT mesh_id, pid FROM preg GROUP BY ALL HAVING count(*) = 2),
 side AS (SELECT mesh_id, (pid // 81) * 9 + pid % 9 AS gid, pid FROM pts WHERE pid % 81 // 9 IN (0, 8)),
 grp AS (SELECT mesh_id, gid, pid FROM side WHERE (mesh_id, gid) IN (SELECT (mesh_id, gid) FROM side GROUP BY mesh_id, gid HAVING count(*) = 2)),
 c AS (SELECT mesh_id, (SELECT count(*) FROM pts WHERE pts.mesh_id = m.mesh_id) AS np, (SELECT count(*) FROM simp WHERE simp.mesh_id = m.mesh_id) AS ns,
   (SELECT count(*) FROM ftab WHERE ftab.mesh_id = m.mesh_id AND (n = 1 OR low <> high)) AS nf FROM (SELECT DISTINCT mesh_id FROM cubes) m),
 items AS (SELECT mesh_id, 'dimensions' AS item, 3.0 AS value FROM c UNION ALL SELECT mesh_id, 'points', np FROM c UNION ALL SELECT mesh_id, 'simplices', ns FROM c
 UNION ALL SELECT mesh_id, 'surfaces', nf FROM c UNION ALL SELECT mesh_id, 'regions', count(DISTINCT region) FROM simp GROUP BY mesh_id
 UNION ALL SELECT mesh_id, 'volume', sum(abs(svol)) FROM vol GROUP BY mesh_id UNION ALL SELECT mesh_id, 'boundary points', count(*) FROM bord GROUP BY mesh_id
 UNION ALL SELECT mesh_id, 'dense matrix MB', round_even(count(*)::DOUBLE * count(*) * 8 / 1048576.0, 0) FROM bord GROUP BY mesh_id
 UNION ALL SELECT mesh_id, 'periodic points', count(DISTINCT gid) FROM grp GROUP BY mesh_id UNION ALL SELECT mesh_id, 'mirage points', count(*) - count(DISTINCT gid) FROM grp GROUP BY mesh_id
 UNION ALL SELECT mesh_id, 'edges', count(*) FROM elen GROUP BY mesh_id UNION ALL SELECT mesh_id, 'edge mean', avg(length) FROM elen GROUP BY mesh_id
 UNION ALL SELECT mesh_id, 'edge sd', stddev_pop(length) FROM elen GROUP BY mesh_id UNION ALL SELECT mesh_id, 'edge min', min(length) FROM elen GROUP BY mesh_id
 UNION ALL SELECT mesh_id, 'edge max', max(length) FROM elen GROUP BY mesh_id UNION ALL SELECT mesh_id, 'memory floor MB', (np * 28 + nf * 12 + ns * 20) / 1048576.0 FROM c)
 SELECT mesh_id, item, round(value::DOUBLE, 5) AS value FROM items""")
def _(spark, sf):
    return M.mesh_info(part_mesh(spark, sf, periodic=True)).select("mesh_id", "item", r("value", 5))


_HIST = """{name} AS (SELECT mesh_id, {bin} AS bin, count(*) AS n FROM {src} GROUP BY ALL), tot AS (SELECT mesh_id, sum(n) AS t FROM {name} GROUP BY mesh_id),
 grid AS (SELECT mesh_id, t, b::INT AS bin FROM tot, range(10) x(b))"""


@query("a12_edge_stats", f"""WITH {MESH}, {EDGES}, {ELEN}, st AS (SELECT mesh_id, count(*) AS edges, avg(length) AS mean, stddev_pop(length) AS sd, min(length) AS low, max(length) AS high FROM elen GROUP BY mesh_id),
 lb AS (SELECT elen.mesh_id, CASE WHEN length = high THEN 9 ELSE least(9, floor((length - low) / ((high - low) / 10)))::INT END AS bb FROM elen JOIN st USING (mesh_id)),
 {_HIST.format(name='h', bin='bb', src='lb')}
 SELECT mesh_id, bin, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / t, 6) AS share, edges, round(mean, 6) AS mean, round(sd, 6) AS sd, round(low, 6) AS low, round(high, 6) AS high
 FROM grid LEFT JOIN h USING (mesh_id, bin) JOIN st USING (mesh_id)""")
def _(spark, sf):
    return M.edge_stats(part_mesh(spark, sf)).select("mesh_id", "bin", "n", r("share"), "edges", r("mean"), r("sd"), r("low"), r("high"))


@query("a13_quality_hist", f"""WITH {LOC}, {QUAL}, {_HIST.format(name='h', bin='floor(quality * 10)::INT', src='qual')}
 SELECT mesh_id, bin, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / t, 6) AS share FROM grid LEFT JOIN h USING (mesh_id, bin)""")
def _(spark, sf):
    return M.quality_hist(part_mesh(spark, sf), 10, clamp=True).select("mesh_id", "bin", "n", r("share"))


@query("t02_worst", f"WITH {LOC}, {QUAL} SELECT mesh_id, sid, round(quality, 5) AS quality FROM qual ORDER BY round(quality, 9), mesh_id, sid LIMIT 100")
def _(spark, sf):
    m = M.qualities(part_mesh(spark, sf))
    return m.orderBy(F.round("quality", 9), "mesh_id", "sid").limit(100).select("mesh_id", "sid", r("quality", 5))


@query("t02_worst_mesh", f"WITH {LOC}, {QUAL} SELECT round(quality, 5) AS quality FROM qual ORDER BY quality LIMIT 100")
def _(spark, sf):
    return M.worst(part_mesh(spark, sf), 100).select(r("quality", 5))


@query("a14_outer_corners", f"""WITH {MESH} SELECT mesh_id, round(min(x), 6) AS min0, round(min(y), 6) AS min1, round(min(z), 6) AS min2, round(max(x), 6) AS max0,
 round(max(y), 6) AS max1, round(max(z), 6) AS max2 FROM pts GROUP BY mesh_id""")
def _(spark, sf):
    c = M.outer_corners(part_mesh(spark, sf).points)
    return c.select("mesh_id", *[r(f"{n}{a}") for n in ("min", "max") for a in range(3)])


def damaged(spark, sf):
    """The part mesh without every seventh cube's simplices but with all points, and with one face
    shared by three simplices per five hundred."""
    m = part_mesh(spark, sf)
    s = m.simplices.filter(F.floor(F.col("sid") / 6) % 7 != 3)
    extra = m.simplices.filter("sid % 500 = 1").select("mesh_id", (F.col("sid") + 100000000000).alias("sid"), "region", "v")
    return M.Mesh(m.points, s.unionByName(extra), 3)


@query("a15_check_mesh", f"""WITH {MESH.replace('simp AS (SELECT', 'simp0 AS (SELECT', 1).replace('corn AS (', "simp AS (SELECT * FROM simp0 WHERE sid // 6 % 7 <> 3 UNION ALL SELECT mesh_id, sid + 100000000000, region, v0, v1, v2, v3 FROM simp0 WHERE sid % 500 = 1), corn AS (", 1)},
 {FACES}, allp AS (SELECT DISTINCT mesh_id, unnest([v0, v1, v2, v3]) AS pid FROM simp0)
 SELECT mesh_id, 'unused point' AS problem, pid::VARCHAR AS ids FROM allp WHERE (mesh_id, pid) NOT IN (SELECT (mesh_id, pid) FROM corn)
 UNION ALL SELECT mesh_id, 'face not shared by two', array_to_string(face, ',') FROM ftab WHERE n > 2""")
def _(spark, sf):
    return M.check_mesh(damaged(spark, sf)).select("mesh_id", "problem", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("p11_scale_points", f"WITH {MESH} SELECT mesh_id, pid, round(x * 2, 6) AS x, round(y * 0.5, 6) AS y, round(z * 1e3, 6) AS z FROM pts")
def _(spark, sf):
    p = M.scale_points(part_mesh(spark, sf).points, [2.0, 0.5, 1e3])
    return p.select("mesh_id", "pid", *[r(F.col("pos")[i]).alias(n) for i, n in enumerate("xyz")])


@query("p22_split_parts", f"""WITH {MESH}, rule(part, region) AS (VALUES (0, 1), (0, 2), (1, 3)), t AS (SELECT part, c.* FROM corn c JOIN rule USING (region)),
 num AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, part ORDER BY pid) - 1 AS n FROM (SELECT DISTINCT mesh_id, part, pid FROM t)),
 g AS (SELECT mesh_id, part, sid, region, max(n) FILTER (k = 0) AS a, max(n) FILTER (k = 1) AS b, max(n) FILTER (k = 2) AS c, max(n) FILTER (k = 3) AS d
  FROM t JOIN num USING (mesh_id, part, pid) GROUP BY ALL)
 SELECT mesh_id, part, row_number() OVER (PARTITION BY mesh_id, part ORDER BY sid) - 1 AS sid, region, a, b, c, d FROM g""")
def _(spark, sf):
    _, s = M.split_parts(part_mesh(spark, sf), [[1, 2], [3]])
    return s.select("mesh_id", "part", "sid", "region", *ids("v", 4))


@query("p23_surface_only", f"""WITH {MESH}, {FACES}, s AS (SELECT mesh_id, face, 2 AS region FROM ftab WHERE (n = 1 OR low <> high) AND (low = 2 OR high = 2)),
 u AS (SELECT mesh_id, face, region, unnest(face) AS pid, unnest([0, 1, 2]) AS k FROM s),
 num AS (SELECT mesh_id, pid, row_number() OVER (PARTITION BY mesh_id ORDER BY pid) - 1 AS n FROM (SELECT DISTINCT mesh_id, pid FROM u))
 SELECT mesh_id, region, a, b, c FROM (SELECT mesh_id, region, face, max(n) FILTER (k = 0) AS a, max(n) FILTER (k = 1) AS b, max(n) FILTER (k = 2) AS c
 FROM u JOIN num USING (mesh_id, pid) GROUP BY ALL)""")
def _(spark, sf):
    _, s = M.surface_only(part_mesh(spark, sf), [2])
    return s.select("mesh_id", "region", *ids("v", 3))


@query("p24_outer_skin", f"""WITH {MESH}, {FACES}, {PREG}, sp AS (SELECT mesh_id, pid FROM preg GROUP BY ALL HAVING count(*) = 2)
 SELECT mesh_id, sid, count(sp.pid) AS on_surface FROM corn LEFT JOIN sp USING (mesh_id, pid) GROUP BY ALL HAVING count(sp.pid) >= 2""")
def _(spark, sf):
    return M.outer_skin(part_mesh(spark, sf), "ge", 2).select("mesh_id", "sid", "on_surface")


# With one exposed point enough, a simplex's layer is the least distance (in edges) of its points from the
# points that touch exactly two regions.
@query("w11_skin_layers", f"""WITH RECURSIVE {MESH}, {FACES}, {EDGES}, {PREG}, surf AS (SELECT mesh_id, pid FROM preg GROUP BY ALL HAVING count(*) = 2),
 adj AS (SELECT mesh_id, src, dst FROM edg UNION SELECT mesh_id, dst, src FROM edg),
 reach(mesh_id, pid, d) AS (SELECT mesh_id, pid, 0 FROM surf UNION SELECT reach.mesh_id, dst, d + 1 FROM reach JOIN adj ON adj.mesh_id = reach.mesh_id AND src = pid WHERE d < 20),
 near AS (SELECT mesh_id, pid, min(d) AS d FROM reach GROUP BY ALL) SELECT mesh_id, sid, min(d)::INTEGER AS layer FROM corn JOIN near USING (mesh_id, pid) GROUP BY ALL""")
def _(spark, sf):
    return M.skin_layers(part_mesh(spark, sf), "ge", 1)


@query("p25_part_scalars", f"WITH {MESH} SELECT mesh_id, sid, CASE WHEN region IN (2, 3) THEN 5 WHEN region = 1 THEN 10 ELSE 0 END::DOUBLE AS scalar FROM simp")
def _(spark, sf):
    return M.part_scalars(part_mesh(spark, sf).simplices, [(1, 2, 10), (2, 3, 5)]).select("mesh_id", "sid", "scalar")


@query("p29_fix_orientation", f"""WITH {LOC} SELECT mesh_id, sid, CASE WHEN svol < 0 THEN v1 ELSE v0 END AS a, CASE WHEN svol < 0 THEN v0 ELSE v1 END AS b, v2 AS c, v3 AS d FROM vol""")
def _(spark, sf):
    return M.fix_orientation(part_mesh(spark, sf)).simplices.select("mesh_id", "sid", *ids("v", 4))


@query("w10_sort_mesh", f"""WITH {MESH}, n AS (SELECT mesh_id, pid, row_number() OVER (PARTITION BY mesh_id ORDER BY z, pid) - 1 AS np FROM pts)
 SELECT mesh_id, sid, region, max(np) FILTER (k = 0) AS a, max(np) FILTER (k = 1) AS b, max(np) FILTER (k = 2) AS c, max(np) FILTER (k = 3) AS d
 FROM corn JOIN n USING (mesh_id, pid) GROUP BY ALL""")
def _(spark, sf):
    m, _ = M.sort_mesh(part_mesh(spark, sf), 2)
    return m.simplices.select("mesh_id", "sid", "region", *ids("v", 4))


@query("h23_permutations", f"""WITH {MESH}, n AS (SELECT mesh_id, pid AS orig_pid, row_number() OVER (PARTITION BY mesh_id ORDER BY z, pid) - 1 AS new_pid FROM pts)
 SELECT mesh_id, orig_pid AS new_pid, new_pid AS orig_pid FROM n""")
def _(spark, sf):
    from stepfield.operators.permutations import invert_perm
    return invert_perm(M.sort_mesh(part_mesh(spark, sf), 2)[1])


@query("h23_perm_sign", """WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem),
 n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS j FROM o)
 SELECT a.l_orderkey AS perm_id, (1 - 2 * (sum(CASE WHEN a.i < b.i AND a.j > b.j THEN 1 ELSE 0 END) % 2))::INT AS sign FROM n a JOIN n b USING (l_orderkey) GROUP BY a.l_orderkey""")
def _(spark, sf):
    from stepfield.operators.permutations import perm_sign
    from stepfield.plans.ordered import dense_ids
    o = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("perm_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    a = dense_ids(o, ["perm_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "orig_pid")
    b = dense_ids(a, ["perm_id"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "new_pid")
    return perm_sign(b, ["perm_id"])


@query("t01_order_mesh", f"""WITH {MESH} SELECT mesh_id, sid, row_number() OVER (PARTITION BY mesh_id ORDER BY v3 % 17, sid) - 1 AS position FROM simp""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    return M.order_mesh(m, data=m.simplices.select("mesh_id", "sid", (F.col("v")[3] % 17).alias("key"))).select("mesh_id", "sid", "position")


@query("t01_order_centre", f"""WITH {LOC} SELECT mesh_id, count(*) AS n, sum(sid)::BIGINT AS s FROM vol GROUP BY mesh_id""")
def _(spark, sf):
    o = M.order_mesh(part_mesh(spark, sf), axis=1)
    return o.groupBy("mesh_id").agg((F.max("position") + 1).alias("n"), F.sum("sid").alias("s"))


@query("j20_refine", f"""WITH {LOC}, {EDGES}, base AS (SELECT mesh_id, max(pid) + 1 AS b FROM pts GROUP BY mesh_id),
 mid AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY src, dst) - 1 AS k, src, dst FROM edg)
 SELECT mesh_id, pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts UNION ALL
 SELECT mesh_id, b + k, round((p.x + q.x) / 2, 6), round((p.y + q.y) / 2, 6), round((p.z + q.z) / 2, 6)
 FROM mid JOIN base USING (mesh_id) JOIN pts p USING (mesh_id) JOIN pts q USING (mesh_id) WHERE p.pid = src AND q.pid = dst""")
def _(spark, sf):
    p = M.refine(part_mesh(spark, sf), 1).points
    return p.select("mesh_id", "pid", *[r(F.col("pos")[i]).alias(a) for i, a in enumerate("xyz")])


@query("j20_refine_parts", f"""WITH {LOC} SELECT mesh_id, sid AS parent, region, 8::BIGINT AS n, round(abs(svol), 9) AS volume, round(abs(svol) / 8, 12) AS least, round(abs(svol) / 8, 12) AS most FROM vol""")
def _(spark, sf):
    """The eight parts of each simplex have an eighth of its volume each."""
    v = M.volumes(M.refine(part_mesh(spark, sf), 1), per=8 * 6)
    return v.groupBy("mesh_id", F.floor(F.col("sid") / 8).alias("parent"), "region").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("volume"), 9).alias("volume"), r(F.min("volume"), 12).alias("least"), r(F.max("volume"), 12).alias("most"))


_TRI = "tri AS (SELECT mesh_id, sid, region, v0, v1, v2 FROM simp)"
_THIRDS = f"""WITH {MESH}, {_TRI},
 side AS (SELECT DISTINCT mesh_id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT mesh_id, v0 AS a, v1 AS b FROM tri UNION ALL SELECT mesh_id, v0, v2 FROM tri UNION ALL SELECT mesh_id, v1, v2 FROM tri)),
 mid AS (SELECT DISTINCT mesh_id, list_sort([v0, v1, v2]) AS t FROM tri)
 SELECT mesh_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts
 UNION ALL SELECT mesh_id, round((w * p.x + (3 - w) * q.x) / 3, 6), round((w * p.y + (3 - w) * q.y) / 3, 6), round((w * p.z + (3 - w) * q.z) / 3, 6)
 FROM side JOIN pts p USING (mesh_id) JOIN pts q USING (mesh_id), (VALUES (1), (2)) t(w) WHERE p.pid = a AND q.pid = b
 UNION ALL SELECT mesh_id, round((p.x + q.x + s.x) / 3, 6), round((p.y + q.y + s.y) / 3, 6), round((p.z + q.z + s.z) / 3, 6)
 FROM mid JOIN pts p USING (mesh_id) JOIN pts q USING (mesh_id) JOIN pts s USING (mesh_id) WHERE p.pid = t[1] AND q.pid = t[2] AND s.pid = t[3]"""


def _triangles(spark, sf):
    """The first face of each tetrahedron, as a mesh of triangles in space."""
    m = part_mesh(spark, sf)
    return M.Mesh(m.points, m.simplices.withColumn("v", F.slice("v", 1, 3)), 2)


@query("j20_subdivide", _THIRDS)
def _(spark, sf):
    """Points of triangles in 3 x 3 parts: two on each edge, one inside."""
    p = M.subdivide(_triangles(spark, sf), 3).points
    return p.select("mesh_id", *[r(F.col("pos")[i]).alias(a) for i, a in enumerate("xyz")])


_AREA = "0.5 * sqrt(pow({u}y*{v}z - {u}z*{v}y, 2) + pow({u}z*{v}x - {u}x*{v}z, 2) + pow({u}x*{v}y - {u}y*{v}x, 2))".format(u="u", v="v")


@query("j20_subdivide_parts", f"""WITH {MESH}, {_TRI}, e AS (SELECT t.mesh_id, sid, region, q.x-p.x AS ux, q.y-p.y AS uy, q.z-p.z AS uz, s.x-p.x AS vx, s.y-p.y AS vy, s.z-p.z AS vz
 FROM tri t JOIN pts p ON p.mesh_id = t.mesh_id AND p.pid = v0 JOIN pts q ON q.mesh_id = t.mesh_id AND q.pid = v1 JOIN pts s ON s.mesh_id = t.mesh_id AND s.pid = v2), a AS (SELECT *, {_AREA} AS area FROM e)
 SELECT mesh_id, sid AS parent, region, 9::BIGINT AS n, round(area, 9) AS area, round(area / 9, 10) AS least, round(area / 9, 10) AS most FROM a""")
def _(spark, sf):
    """The nine parts of each triangle have a ninth of its area each."""
    m = M.subdivide(_triangles(spark, sf), 3)
    tri = M.placed(m, 9 * 6).withColumns({f"p{k}": F.col("corners")[k] for k in range(3)})
    sides = {f"{n}{a}": F.col(f"p{k}")[i] - F.col("p0")[i] for k, n in ((1, "u"), (2, "v")) for i, a in enumerate("xyz")}
    area = tri.withColumns(sides).withColumn("area", F.expr(_AREA))
    return area.groupBy("mesh_id", F.floor(F.col("sid") / 9).alias("parent"), "region").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("area"), 9).alias("area"), r(F.min("area"), 10).alias("least"), r(F.max("area"), 10).alias("most"))


@query("j21_interface_mismatch", f"""WITH {MESH}, {FACES}, shell AS (SELECT mesh_id, region AS body, face FROM fac GROUP BY ALL HAVING count(*) = 1),
 touch AS (SELECT DISTINCT mesh_id, body, unnest(face) AS pid FROM shell), com AS (SELECT a.mesh_id, a.body AS body_a, b.body AS body_b, a.pid FROM touch a JOIN touch b ON a.mesh_id = b.mesh_id AND a.pid = b.pid AND a.body < b.body),
 bod AS (SELECT DISTINCT mesh_id, body_a, body_b FROM com),
 sided AS (SELECT s.mesh_id, body_a, body_b, body AS side, face, unnest(face) AS pid FROM shell s JOIN bod ON bod.mesh_id = s.mesh_id AND body IN (body_a, body_b)),
 whole AS (SELECT s.mesh_id, s.body_a, s.body_b, side, face FROM sided s JOIN com USING (mesh_id, body_a, body_b, pid) GROUP BY ALL HAVING count(*) = 3)
 SELECT mesh_id, body_a, body_b, face[1] AS a, face[2] AS b, face[3] AS c, max(side) AS side FROM whole GROUP BY mesh_id, body_a, body_b, face HAVING count(*) = 1""")
def _(spark, sf):
    return M.interface_mismatch(part_mesh(spark, sf)).select("mesh_id", "body_a", "body_b", *ids("face", 3), "side")


@query("j22_sharing", f"""WITH {MESH}, e AS (SELECT a.mesh_id, a.sid, least(a.pid, b.pid) AS a, greatest(a.pid, b.pid) AS b FROM corn a JOIN corn b ON a.mesh_id = b.mesh_id AND a.sid = b.sid AND a.k < b.k),
 c AS (SELECT *, count(*) OVER (PARTITION BY mesh_id, a, b) AS owners FROM e) SELECT mesh_id, sid, a, b, owners FROM c WHERE owners > 1""")
def _(spark, sf):
    return M.sharing(part_mesh(spark, sf), 2).select("mesh_id", "sid", *ids("shared", 2), "owners")


@query("j22_external_edges", f"""WITH {MESH}, {FACES}, o AS (SELECT mesh_id, face FROM ftab WHERE n = 1)
 SELECT DISTINCT mesh_id, face[1] AS a, face[2] AS b FROM o UNION SELECT mesh_id, face[1], face[3] FROM o UNION SELECT mesh_id, face[2], face[3] FROM o""")
def _(spark, sf):
    return M.external_edges(part_mesh(spark, sf)).select("mesh_id", *ids("edge", 2))


@query("a21_partition_ids", f"""WITH {MESH} SELECT mesh_id, pid, floor(pid / ceil(n / 7.0))::INT AS part FROM pts JOIN (SELECT mesh_id, count(*) AS n FROM pts GROUP BY 1) USING (mesh_id)""")
def _(spark, sf):
    return M.partition_ids(part_mesh(spark, sf).points, pieces=7).select("mesh_id", "pid", "part")


@query("a22_owner", "SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_partkey < 100 THEN 0 WHEN l_partkey < 350 THEN 1 WHEN l_partkey < 1000 THEN 2 ELSE 3 END)::INT AS part FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.owner("l_partkey", [100, 250, 650]).alias("part"))


@query("a17_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, 1000000000 + l_partkey * 1000000 + (l_orderkey // 50) AS b FROM lineitem),
 adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(n, c) AS (SELECT a, a FROM adj UNION SELECT adj.b, walk.c FROM walk JOIN adj ON adj.a = walk.n WHERE walk.c < adj.b)
 SELECT n AS node, min(c) AS component FROM walk GROUP BY n""")
def _(spark, sf):
    e = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"), (F.lit(1000000000) + F.col("l_partkey") * 1000000 + F.floor(F.col("l_orderkey") / 50)).cast("bigint").alias("dst"))
    return G.components(e)


@query("a17_components_reduce", f"""WITH {MESH} SELECT mesh_id, 0::BIGINT AS component, count(*) AS edges FROM (SELECT DISTINCT mesh_id, least(a.pid, b.pid) AS s, greatest(a.pid, b.pid) AS d
 FROM corn a JOIN corn b USING (mesh_id, sid) WHERE a.k < b.k) GROUP BY mesh_id""")
def _(spark, sf):
    e = M.edges(part_mesh(spark, sf))
    return G.reduce_components(e, G.components(e, ["mesh_id"]), [F.count(F.lit(1)).alias("edges")], ["mesh_id"])


@query("a18_merge_periodic", f"""WITH {MESH}, side AS (SELECT mesh_id, (pid // 81) * 9 + pid % 9 AS gid, pid FROM pts WHERE pid % 81 // 9 IN (0, 4, 8))
 SELECT mesh_id, min(pid) OVER (PARTITION BY mesh_id, gid) AS gid, pid FROM side QUALIFY count(*) OVER (PARTITION BY mesh_id, gid) > 1""")
def _(spark, sf):
    # Chains 0–4 and 4–8 must end in one group.
    p = part_mesh(spark, sf).points.select("mesh_id", "pid")
    y = F.floor(F.col("pid") % 81 / 9)
    up = p.filter(y.isin(0, 4)).select("mesh_id", F.col("pid").alias("src"), (F.col("pid") + 36).alias("dst"))
    far = p.filter(y == 0).select("mesh_id", F.col("pid").alias("src"), (F.col("pid") + 72).alias("dst"))
    pairs = lookup(up.unionByName(far), p.withColumnRenamed("pid", "dst"), ["mesh_id", "dst"], "left_semi")
    return G.merge_periodic(pairs)


@query("u04_mirror", f"""WITH {MESH}, ext AS (SELECT mesh_id, max(pid // 81) AS hi, max(pid) + 1 AS np FROM pts GROUP BY mesh_id),
 im AS (SELECT mesh_id, pid, pid // 81 AS x, pid % 81 // 9 AS y, pid % 9 AS z, hi, np FROM pts JOIN ext USING (mesh_id))
 SELECT mesh_id, (count(*) + count(CASE WHEN x <> hi THEN 1 END))::BIGINT AS points, (SELECT 2 * count(*) FROM simp WHERE simp.mesh_id = im.mesh_id) AS simplices,
 count(CASE WHEN x = 0 THEN 1 END)::BIGINT AS groups, (2 * any_value(hi))::DOUBLE AS top, (any_value(np) + count(CASE WHEN x <> hi THEN 1 END) - 1)::BIGINT AS last FROM im GROUP BY mesh_id""")
def _(spark, sf):
    m = M.mirror(part_mesh(spark, sf, flat=True), [1, 0, 0], 1e-6, 1e-6)
    p = m.points.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("points"), F.max(F.col("pos")[0]).alias("top"), F.max("pid").alias("last"))
    s = m.simplices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("simplices"))
    k = m.periodic.groupBy("mesh_id").agg(F.count_distinct("gid").alias("groups"))
    return p.join(s, "mesh_id").join(k, "mesh_id").select("mesh_id", "points", "simplices", "groups", "top", "last")
