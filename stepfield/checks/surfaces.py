"""Queries on meshes that were made apart, and on sites of higher order."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.checks.base import EDGES, FACES, LOC, MESH, QUAL, part_mesh, query, r, spread, table, xyz_out
from stepfield.checks.meshes import damaged, ids
from stepfield.checks.probing import PROBE, part_probes
from stepfield.operators import interfaces as I
from stepfield.operators import mesh as M
from stepfield.operators import shapes as SH
from stepfield.plans.skewed import lookup

# Two bodies of the part mesh's cubes: below the layer z = 4, and from there on with the cubes cut along other diagonals. The
# second has ids of its own (5 * pid + 7), and its points are off by up to 0.00002.

_STEPS = [(81, 9, 1), (81, 1, 9), (9, 81, 1), (9, 1, 81), (1, 81, 9), (1, 9, 81)]
TOLERANCE = 1e-3


def two_bodies(spark, sf):
    whole = part_mesh(spark, sf)
    c = F.floor(F.col("p_partkey") / 4).cast("bigint")
    part = table(spark, sf, "part")
    cubes = spread(part.select((F.col("p_partkey") % 4).alias("mesh_id"), c.alias("c"), F.lit(1).alias("region")), part.count())
    base = (F.floor(F.col("c") / 64) * 81 + F.floor(F.col("c") % 64 / 8) * 9 + F.col("c") % 8).cast("bigint")

    def body(rows, start, turn):
        tets = F.array(*[F.array(start, start + turn.get(a, a), start + turn.get(a, a) + turn.get(b, b), start + 9 + 1 + turn.get(81, 81)) for a, b, _ in _STEPS])
        return rows.select("mesh_id", "region", "c", F.posexplode(tets).alias("k", "v")).select("mesh_id", (F.col("c") * 6 + F.col("k")).alias("sid"), "region", "v")

    low = body(cubes.filter(F.col("c") % 8 < 4), base, {})
    high = body(cubes.filter(F.col("c") % 8 >= 4), base + 81, {81: -81})
    used = lambda s: s.select("mesh_id", F.explode("v").alias("pid")).distinct()
    points = lookup(whole.points, used(low), ["mesh_id", "pid"], "left_semi")
    off = (F.col("pid") * 13 % 5 - 2) * 1e-5
    # Positions follow the id by the rule of the part mesh; the second body may use points that no cube of that mesh has.
    moved = lookup(whole.points, used(high), ["mesh_id", "pid"], "left_semi").select(
        "mesh_id", (F.col("pid") * 5 + 7).alias("pid"), F.transform("pos", lambda x: x + off).alias("pos"))
    return M.Mesh(points, low, 3), M.Mesh(moved, high.withColumn("v", F.transform("v", lambda p: p * 5 + 7)), 3)


def _body_sql(name, where, start, turn):
    tets = " UNION ALL ".join(f"SELECT mesh_id, {start} AS v0, {start} + {turn.get(a, a)} AS v1, {start} + {turn.get(a, a)} + {turn.get(b, b)} AS v2, {start} + {turn.get(81, 81) + 10} AS v3 FROM corner0 WHERE {where}"
                              for a, b, _ in _STEPS)
    faces = " UNION ALL ".join(f"SELECT mesh_id, list_sort([v{i}, v{j}, v{k}]) AS face FROM tet_{name}" for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)))
    return f"""tet_{name} AS ({tets}), out_{name} AS (SELECT mesh_id, face FROM ({faces}) GROUP BY ALL HAVING count(*) = 1),
 pt_{name} AS (SELECT DISTINCT mesh_id, unnest(face) AS pid FROM out_{name})"""


_ONE_SIDED = f"""{MESH}, {_body_sql('a', 'c % 8 < 4', 'b', {})}, {_body_sql('b', 'c % 8 >= 4', '(b + 81)', {81: -81})},
 same AS (SELECT mesh_id, pid FROM pt_a JOIN pt_b USING (mesh_id, pid)),
 every AS (SELECT mesh_id, 'a' AS side, face FROM out_a UNION ALL SELECT mesh_id, 'b', face FROM out_b),
 com AS (SELECT e.mesh_id, side, face FROM (SELECT *, unnest(face) AS pid FROM every) e JOIN same USING (mesh_id, pid) GROUP BY ALL HAVING count(*) = 3),
 one AS (SELECT mesh_id, face, max(side) AS side FROM com GROUP BY mesh_id, face HAVING count(*) = 1)"""


@query("j21_two_meshes", f"""WITH {_ONE_SIDED} SELECT mesh_id, side, CASE side WHEN 'a' THEN face[1] ELSE face[1] * 5 + 7 END AS a,
 CASE side WHEN 'a' THEN face[2] ELSE face[2] * 5 + 7 END AS b, CASE side WHEN 'a' THEN face[3] ELSE face[3] * 5 + 7 END AS c FROM one""")
def _(spark, sf):
    return I.one_sided_faces(*two_bodies(spark, sf), TOLERANCE).select("mesh_id", "side", *ids("face", 3))


@query("j21_edges_to_divide", f"""WITH {_ONE_SIDED}, e AS (SELECT mesh_id, side, face[1] AS src, face[2] AS dst FROM one UNION ALL SELECT mesh_id, side, face[1], face[3] FROM one UNION ALL SELECT mesh_id, side, face[2], face[3] FROM one),
 d AS (SELECT mesh_id, src, dst, min(side) AS side FROM e GROUP BY mesh_id, src, dst HAVING min(side) = max(side) AND count(*) > 1)
 SELECT d.mesh_id, side, src, dst, round((p.x + q.x) / 2, 6) AS a, round((p.y + q.y) / 2, 6) AS b, round((p.z + q.z) / 2, 6) AS c
 FROM d JOIN pts p ON p.mesh_id = d.mesh_id AND p.pid = src JOIN pts q ON q.mesh_id = d.mesh_id AND q.pid = dst""")
def _(spark, sf):
    low, high = two_bodies(spark, sf)
    found = I.edges_to_divide(I.one_sided_faces(low, high, TOLERANCE), 3)
    return I.middles(found, low.points, 3).select("mesh_id", "side", F.col("edge")[0].alias("src"), F.col("edge")[1].alias("dst"), *xyz_out("pos"))


# Sites of higher order

@query("j01_weighted_sites", f"""WITH {MESH}, {EDGES}, s AS (SELECT mesh_id, src, dst, 1 AS w FROM edg UNION ALL SELECT mesh_id, src, dst, 2 FROM edg)
 SELECT s.mesh_id, src, dst, w AS weight, round((w * p.x + (3 - w) * q.x) / 3, 6) AS a, round((w * p.y + (3 - w) * q.y) / 3, 6) AS b, round((w * p.z + (3 - w) * q.z) / 3, 6) AS c
 FROM s JOIN pts p ON p.mesh_id = s.mesh_id AND p.pid = src JOIN pts q ON q.mesh_id = s.mesh_id AND q.pid = dst""")
def _(spark, sf):
    """The two inner sites of third order on every edge."""
    m = part_mesh(spark, sf)
    sites = SH.order_sites(m, 3).filter(F.size("site") == 2)
    site = F.col("site")
    return SH.weighted_positions(sites, m.points).select(
        "mesh_id", site[0]["pid"].alias("src"), site[1]["pid"].alias("dst"), site[0]["weight"].alias("weight"), *xyz_out("pos"))


@query("j16_second_order", f"""WITH {LOC}, {PROBE} SELECT mesh_id, probe, round(px * px - 2 * py * pz + 3 * pz - 1, 6) AS value FROM hit JOIN prb USING (mesh_id, probe)""")
def _(spark, sf):
    """A field of second order, given at its sites, is met exactly at every probe."""
    m = part_mesh(spark, sf)
    x, y, z = (F.col("pos")[a] for a in range(3))
    values = SH.weighted_positions(SH.order_sites(m, 2), m.points).select("mesh_id", "site", (x * x - 2 * y * z + 3 * z - 1).alias("value"))
    found = SH.apply_shapes(SH.shape_matrix(part_probes(spark, sf), m, 2), values, 2, 3)
    return found.select("mesh_id", "probe", r("value"))


# Rules of the reports on meshes that are not the default

@query("a13_quality_drop", f"""WITH {LOC}, {QUAL}, h AS (SELECT mesh_id, floor(quality * 8)::INT AS bin, count(*) AS n FROM qual WHERE quality >= 0 AND quality < 1 GROUP BY ALL),
 t AS (SELECT mesh_id, count(*) AS t FROM qual GROUP BY mesh_id)
 SELECT t.mesh_id, b AS bin, coalesce(n, 0)::BIGINT AS n FROM t, range(8) g(b) LEFT JOIN h ON h.mesh_id = t.mesh_id AND h.bin = b""")
def _(spark, sf):
    return M.quality_hist(part_mesh(spark, sf), 8).select("mesh_id", "bin", "n")


@query("a15_listed_surfaces", f"""WITH {MESH.replace('simp AS (SELECT', 'simp0 AS (SELECT', 1).replace('corn AS (', "simp AS (SELECT * FROM simp0 WHERE sid // 6 % 7 <> 3 UNION ALL SELECT mesh_id, sid + 100000000000, region, v0, v1, v2, v3 FROM simp0 WHERE sid % 500 = 1), corn AS (", 1)},
 {FACES}, allp AS (SELECT DISTINCT mesh_id, unnest([v0, v1, v2, v3]) AS pid FROM simp0)
 SELECT mesh_id, 'unused point' AS problem, pid::VARCHAR AS ids FROM allp WHERE (mesh_id, pid) NOT IN (SELECT (mesh_id, pid) FROM corn)
 UNION ALL SELECT mesh_id, 'face not shared by two', array_to_string(face, ',') FROM ftab WHERE n <> 2 AND NOT (n = 1 AND face[1] % 3 > 0)""")
def _(spark, sf):
    """The list has two thirds of the outer faces, their points in descending order."""
    m = damaged(spark, sf)
    listed = M.face_table(m).filter((F.col("n") == 1) & (F.col("face")[0] % 3 > 0)).select("mesh_id", F.reverse("face").alias("face"))
    return M.check_mesh(m, listed).select("mesh_id", "problem", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
