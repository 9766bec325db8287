"""Closed forms on cubes cut into tetrahedra, and graphs against small loops."""

import itertools
import random
import math

import pytest
from pyspark.sql import functions as F

from stepfield.functions import geometry as g
from stepfield.operators import graph as G
from stepfield.operators import mesh as M
from stepfield.operators import probe as P
from stepfield.operators import rules as RU
from stepfield.operators import snapshots as S
from stepfield.operators.permutations import perm_sign

N = 4


def cube_rows(n):
    m = n + 1
    points = [(0, x * m * m + y * m + z, [float(x), float(y), float(z)]) for x in range(m) for y in range(m) for z in range(m)]
    simplices = []
    for x, y, z in itertools.product(range(n), repeat=3):
        for k, order in enumerate(itertools.permutations([m * m, m, 1])):
            v = [x * m * m + y * m + z]
            for step in order:
                v.append(v[-1] + step)
            simplices.append((0, ((x * n + y) * n + z) * 6 + k, 1 if x < n / 2 else 2, v))
    return points, simplices


@pytest.fixture(scope="module")
def cube(spark):
    p, s = cube_rows(N)
    return M.Mesh(spark.createDataFrame(p, "mesh_id bigint, pid bigint, pos array<double>").cache(),
                  spark.createDataFrame(s, "mesh_id bigint, sid bigint, region int, v array<bigint>").cache())


@pytest.fixture(scope="module")
def linear(spark, cube):
    """The field (x, y, z) on all points, one save."""
    return cube.points.select(F.lit("r").alias("run_id"), "mesh_id", F.lit("f").alias("field"), F.lit("f").alias("subfield"), F.lit(0).cast("bigint").alias("id"),
                              F.lit(0).alias("step"), F.lit(0).alias("stage"), F.lit(0.0).alias("time"), F.array("pid").alias("site"), F.col("pos").alias("value"))


def test_counts(cube):
    assert M.edges(cube).count() == 3 * N * (N + 1) ** 2 + 3 * N * N * (N + 1) + N ** 3
    table = M.face_table(cube)
    assert table.filter("n = 1").count() == 12 * N * N
    assert table.filter("n = 2 and low <> high").count() == 2 * N * N
    assert M.neighbours(cube).count() == (4 * 6 * N ** 3 - 12 * N * N) // 2
    assert {tuple(r) for r in M.edge_lengths(cube).groupBy(F.round("length", 6)).count().collect()} == {(1.0, 300), (1.414214, 240), (1.732051, 64)}


def test_volumes_and_quality(cube):
    assert {r.region: round(r.volume, 9) for r in M.region_volumes(cube).collect()} == {0: 0.0, 1: 32.0, 2: 32.0}
    assert abs(M.site_volumes(cube).agg(F.sum("volume")).first()[0] - N ** 3) < 1e-9
    assert {round(r.quality, 4) for r in M.qualities(cube).collect()} == {0.7174}
    assert sum(r.n for r in M.quality_hist(cube).collect()) == 6 * N ** 3


def test_solid_angle(cube):
    inner = [r.angle for r in M.solid_angles(cube).collect() if r.pid == 2 * 25 + 2 * 5 + 2]
    assert abs(inner[0] - 4 * math.pi) < 1e-9


def test_probe_linear_field(spark, cube, linear):
    probes = spark.createDataFrame([(0, i, [0.37 * i % 4, 0.11 + 0.23 * i % 3.8, 3.9 - 0.07 * i]) for i in range(50)] + [(0, 99, [5.0, 1.0, 1.0]), (0, 98, [2.0, 2.0, 2.0])],
                                   "mesh_id bigint, probe bigint, pos array<double>")
    got = {r.probe: r for r in P.probe(linear, cube, probes, 3).collect()}
    assert got[99].value is None
    for i, row in got.items():
        if i != 99:
            assert max(abs(a - b) for a, b in zip(row.value, row.pos)) < 1e-9
    # A probe on a common face goes to the simplex with the lowest id.
    assert P.locate(probes.filter("probe = 98"), cube).first().sid == min(
        r.sid for r in cube.simplices.filter(F.array_contains("v", 62)).collect())


def test_integral_and_average(spark, cube, linear):
    where = spark.createDataFrame([(0, "f", 1), (0, "f", 2)], "mesh_id bigint, subfield string, region int")
    got = [round(r.average, 9) for r in S.average(linear, cube, where, 3).orderBy("comp").collect()]
    assert got == [2.0, 2.0, 2.0]


def test_refine(cube):
    fine = M.refine(cube, 1)
    assert fine.points.count() == (N + 1) ** 3 + 604
    assert abs(M.region_volumes(fine).agg(F.sum("volume")).first()[0] - 64) < 1e-9
    # Still a mesh: every face inside is shared by two simplices.
    assert M.face_table(fine).filter("n > 2").count() == 0
    assert M.face_table(fine).filter("n = 1").count() == 4 * 12 * N * N


def test_skin_layers_against_loop(spark, cube):
    points, simplices = cube_rows(N)
    touch = {r.pid: set(r.regions) for r in M.point_regions(cube).collect()}
    front = {p for p, rs in touch.items() if len(rs) == 2}
    left = {s[1]: s[3] for s in simplices}
    want, layer = {}, 0
    while front:
        hit = {i for i, v in left.items() if any(p in front for p in v)}
        fresh = {p for i in hit for p in left[i] if p not in front}
        want.update({i: layer for i in hit})
        left = {i: v for i, v in left.items() if i not in hit}
        front, layer = fresh, layer + 1
    assert {r.sid: r.layer for r in M.skin_layers(cube).collect()} == want


def test_check_mesh(spark, cube):
    assert M.check_mesh(cube, M.surfaces(cube)).count() == 0
    lonely = M.Mesh(cube.points.unionByName(spark.createDataFrame([(0, 999, [0.0, 0.0, 0.0])], cube.points.schema)), cube.simplices)
    assert [r.ids for r in M.check_mesh(lonely).collect()] == [[999]]
    holed = M.Mesh(cube.points, cube.simplices.filter("sid <> 77"))
    inside = M.faces(cube).filter("sid = 77").join(M.face_table(cube).filter("n = 2 and low = high"), ["mesh_id", "face"]).count()
    assert M.check_mesh(holed, M.surfaces(cube)).filter("problem like 'face%'").count() == inside > 0


def test_orientation(cube):
    fixed = M.fix_orientation(cube)
    assert M.located(fixed).filter(g.signed_volume(M.vertices(3)) < 0).count() == 0


def test_mirror(cube):
    two = M.mirror(cube, [1, -1, 0], 1e-6, 1e-6)
    assert two.points.select("mesh_id", "pid").distinct().count() == (2 * N + 1) ** 2 * (N + 1) == two.points.count()
    assert abs(M.region_volumes(two).agg(F.sum("volume")).first()[0] - 4 * N ** 3) < 1e-9
    sizes = {r.gid: r.n for r in two.periodic.groupBy("gid").agg(F.count("*").alias("n")).collect()}
    # Lines where both periodic planes meet hold four images.
    assert sorted(set(sizes.values())) == [2, 4] and sum(1 for n in sizes.values() if n == 4) == N + 1
    assert M.mirror(cube, [1, 0, 0], drop_periodic=True).periodic is None


def test_two_dimensions(spark):
    p = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (0, 3, [1.0, 1.0])], "mesh_id bigint, pid bigint, pos array<double>")
    s = spark.createDataFrame([(0, 0, 1, [0, 1, 2]), (0, 1, 2, [1, 3, 2])], "mesh_id bigint, sid bigint, region int, v array<bigint>")
    m = M.Mesh(p, s, 2)
    assert {round(r.volume, 9) for r in M.volumes(m).collect()} == {0.5}
    assert M.refine(m).simplices.count() == 8
    angles = M.triangle_angles(m).first()
    assert abs(angles.a + angles.b + angles.c - 180) < 1e-9
    probes = spark.createDataFrame([(0, 1, [0.75, 0.75])], "mesh_id bigint, probe bigint, pos array<double>")
    assert P.locate(probes, m).first().sid == 1


def test_subfields_on_a_line(spark):
    """Points 0 … 12 on a line in three regions; fields on the left, on the right two and on all."""
    p = spark.createDataFrame([(0, i, [i * i / 8]) for i in range(13)], "mesh_id bigint, pid bigint, pos array<double>")
    s = spark.createDataFrame([(0, i, 1 + (i >= 4) + (i >= 9), [i, i + 1]) for i in range(12)], "mesh_id bigint, sid bigint, region int, v array<bigint>")
    m = M.Mesh(p, s, 1)

    def snap(subfield, ids):
        return spark.createDataFrame([("r", 0, "v", subfield, 0, 0, 0, 0.0, [i], [2.0 * i]) for i in ids],
                                     "run_id string, mesh_id bigint, field string, subfield string, id bigint, step bigint, stage bigint, time double, site array<bigint>, value array<double>")

    for name, ids, regions in (("left", range(5), [1]), ("right", range(4, 13), [2, 3]), ("all", range(13), [1, 2, 3])):
        assert sorted(r.region for r in S.defined_regions(snap(name, ids), m).collect()) == regions
    with pytest.raises(ValueError):
        S.defined_regions(snap("torn", [0, 1, 2, 3, 4, 6]), m)
    with pytest.raises(ValueError):
        S.set_field(p, [1.0, 2.0], width=3)
    where = spark.createDataFrame([(0, "left", 1)], "mesh_id bigint, subfield string, region int")
    x = [i * i / 8 for i in range(5)]
    want = sum((x[i + 1] - x[i]) * (2 * i + 1) for i in range(4)) / (x[4] - x[0])
    assert abs(S.average(snap("left", range(5)), m, where, 1).first().average - want) < 1e-12


def test_components_by_brute_force(spark):
    """Random forests with loops on single nodes; a node that only has a loop is its own component."""
    rng = random.Random(8)
    edges = [(a, rng.randint(0, a), rng.random()) for a in range(1, 60) if rng.random() < 0.7] + [(90, 90, 0.5)]
    group = {n: n for a, b, _ in edges for n in (a, b)}
    for _ in edges:
        for a, b, _ in edges:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(edges, "src bigint, dst bigint, w double")
    labels = G.components(df)
    assert {r.node: r.component for r in labels.collect()} == group
    best = {}
    for a, b, w in edges:
        best[group[a]] = max(best.get(group[a], (0,)), (w, a, b))
    heaviest = G.reduce_components(df, labels, [F.max_by(F.struct("src", "dst"), "w").alias("e")]).collect()
    assert {r.component: tuple(r.e) for r in heaviest} == {k: v[1:] for k, v in best.items()}


def test_missing_partners_are_errors(spark, cube):
    holes = M.Mesh(cube.points.filter("pid <> 0"), cube.simplices, cube.dim)
    with pytest.raises(Exception):
        M.volumes(holes).collect()
    mapping = cube.points.filter("pid <> 0").select("mesh_id", "pid", F.col("pid").alias("new_pid"))
    with pytest.raises(Exception):
        M.remap(cube.simplices, mapping, ["mesh_id"], 3).collect()
    with pytest.raises(Exception):
        S.site_positions(spark.createDataFrame([(0, [1, 10**6])], "mesh_id bigint, site array<bigint>"), cube.points).collect()


def test_components_long_path_and_star(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(1000, 1400).select(F.lit(5000).cast("bigint").alias("src"), F.col("id").alias("dst"))
    out = G.components(path.unionByName(star)).groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in out) == [(0, 301), (1000, 401)]


def test_merge_periodic_chain(spark):
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 9, 3), (0, 20, 21)], "mesh_id bigint, src bigint, dst bigint")
    got = {(r.gid, r.pid) for r in G.merge_periodic(pairs).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 9), (20, 20), (20, 21)}


def test_perm_sign(spark):
    rows = [(k, i, p[i]) for k, p in enumerate(itertools.permutations(range(4))) for i in range(4)]
    df = spark.createDataFrame(rows, "k bigint, new_pid bigint, orig_pid bigint")
    sign = lambda p: (-1) ** sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4))
    want = {k: sign(p) for k, p in enumerate(itertools.permutations(range(4)))}
    assert {r.k: r.sign for r in perm_sign(df, ["k"]).collect()} == want


def test_partition_sizes(spark, cube):
    got = M.partition_ids(cube.points, sizes=[100, 20, 5]).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {0: 100, 1: 20, 2: 5}
    with pytest.raises(ValueError):
        M.partition_ids(cube.points, sizes=[100, 20])


def test_rules(spark):
    """A default and two exceptions; rules for materials that are missing, or materials without a rule, are errors."""
    rules = RU.rules_frame(spark, [(0.5, None), (7, "steel"), (9, "glass")])
    mats = spark.createDataFrame([("glass",), ("steel",), ("wood",)], "material string")
    assert {r.material: r.value for r in RU.set_plan(rules, mats).collect()} == {"glass": 9, "steel": 7, "wood": 0.5}
    with pytest.raises(ValueError):
        RU.set_plan(rules, mats.filter("material <> 'glass'"))
    with pytest.raises(ValueError):
        RU.set_plan(RU.rules_frame(spark, [(7, "steel")]), mats)
    assert RU.as_constant(rules, "steel").first().value == 7 and RU.as_constant(rules, "wood").first().value == 0.5
    with pytest.raises(ValueError):
        RU.as_constant(rules)


def test_bary_and_normals(spark):
    v = [[F.lit(float(x)) for x in p] for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    row = spark.range(1).select(*g.bary([F.lit(0.1), F.lit(0.2), F.lit(0.3)], v), *g.face_normal(v, 0), *g.face_normal(v, 3)).first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(row, (0.4, 0.1, 0.2, 0.3, 0.5, 0.5, 0.5, 0.0, 0.0, -0.5)))


def test_matrix_with_known_and_counted_entries(spark):
    from stepfield.operators import probe as P

    matrix = spark.createDataFrame([(1, 7, 1, 0.25), (1, 7, 2, 0.75), (1, 8, 2, 0.5), (1, 8, 3, 0.5)], "mesh_id int, probe long, pid long, weight double")
    save = ("run", 1, "m", "m_1", 0, 0, 0, 0.0)
    snap = spark.createDataFrame([(*save, [1], [4.0]), (*save, [2], [8.0])],
                                 "run_id string, mesh_id int, field string, subfield string, id long, step long, stage long, time double, site array<long>, value array<double>")
    for entries in (2, None):
        assert [(r.probe, r.value) for r in P.apply_matrix(matrix, snap, 1, entries).collect()] == [(7, [7.0])]
