"""Meshes made apart, and sites of higher order, against brute force on small meshes."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepfield.operators import interfaces as I
from stepfield.operators import mesh as M
from stepfield.operators import shapes as SH

P = "mesh_id int, pid long, pos array<double>"
S = "mesh_id int, sid long, region int, v array<long>"

# Two tetrahedra over the unit square of each side, the square cut along one diagonal below and along the other above.
SQUARE = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]


def mesh(spark, points, simplices, first=0):
    rows = [(1, first + i, [float(x) for x in p]) for i, p in enumerate(points)]
    return M.Mesh(spark.createDataFrame(rows, P), spark.createDataFrame([(1, i, 1, [first + k for k in v]) for i, v in enumerate(simplices)], S), len(points[0]))


def below(spark):
    return mesh(spark, [*SQUARE, (0.5, 0.5, -1)], [(0, 1, 3, 4), (0, 2, 3, 4)])


def above(spark, cut, off=0.0):
    pairs = [(0, 1, 3), (0, 2, 3)] if cut == "same" else [(0, 1, 2), (1, 2, 3)]
    return mesh(spark, [(x + off, y - off, z + off) for x, y, z in [*SQUARE, (0.5, 0.5, 1)]], [(*p, 4) for p in pairs], first=100)


def test_meshes_that_fit(spark):
    assert I.one_sided_faces(below(spark), above(spark, "same", 1e-7), 1e-5).count() == 0


def test_other_diagonal(spark):
    a, b = below(spark), above(spark, "other", 1e-7)
    found = I.one_sided_faces(a, b, 1e-5)
    assert {(r.side, tuple(r.face)) for r in found.collect()} == {("a", (0, 1, 3)), ("a", (0, 2, 3)), ("b", (100, 101, 102)), ("b", (101, 102, 103))}
    edges = I.edges_to_divide(found, 3)
    assert {(r.side, tuple(r.edge)) for r in edges.collect()} == {("a", (0, 3)), ("b", (1, 2))}
    assert {tuple(r.pos) for r in I.middles(edges, a.points, 3).collect()} == {(0.5, 0.5, 0.0)}


def test_far_apart_and_empty(spark):
    assert I.one_sided_faces(below(spark), above(spark, "other", 0.1), 1e-5).count() == 0
    none = M.Mesh(spark.createDataFrame([], P), spark.createDataFrame([], S), 3)
    assert I.one_sided_faces(below(spark), none, 1e-5).count() == 0


def test_tolerance_too_large(spark):
    with pytest.raises(PySparkException, match="several partners"):
        I.one_sided_faces(below(spark), above(spark, "other"), 1.2).collect()
    with pytest.raises(ValueError):
        I.one_sided_faces(below(spark), above(spark, "other"), 0.0)


def test_same_points_by_brute_force(spark):
    rng = np.random.default_rng(3)
    # Points of a grid of width 1, moved a little; partners may lie in the next cell.
    base = np.array(list(itertools.product(range(-3, 3), repeat=2)), float)
    a, b = base + rng.uniform(-0.05, 0.05, base.shape), base + rng.uniform(-0.05, 0.05, base.shape)
    table = lambda p, first: spark.createDataFrame([(1, first + i, [float(x) for x in row]) for i, row in enumerate(p)], P)
    got = {(r.pid_a, r.pid_b) for r in I.same_points(table(a, 0), table(b, 1000), 2, 0.07).collect()}
    want = {(i, 1000 + j) for i in range(len(a)) for j in range(len(b)) if np.hypot(*(a[i] - b[j])) <= 0.07}
    assert got == want and 0 < len(got) < len(a)


@pytest.mark.parametrize("dim, order", [(1, 1), (1, 4), (2, 3), (3, 2)])
def test_polynomials_are_met(spark, dim, order):
    corners = [[0.0] * dim, *[[1.5 * (i == k) + 0.2 for i in range(dim)] for k in range(dim)]]
    m = mesh(spark, corners, [tuple(range(dim + 1))])
    rng = np.random.default_rng(dim * 10 + order)
    powers = [p for p in itertools.product(range(order + 1), repeat=dim) if sum(p) <= order]
    factor = rng.uniform(-1, 1, len(powers))
    value = lambda x: float(sum(f * np.prod(np.power(x, p)) for f, p in zip(factor, powers)))
    sites = SH.weighted_positions(SH.order_sites(m, order), m.points, dim)
    assert sites.count() == len(M.lattice(order, dim))
    given = [(r.mesh_id, r.site, value(np.array(r.pos))) for r in sites.collect()]
    values = spark.createDataFrame(given, "mesh_id int, site array<struct<pid:long,weight:int>>, value double")
    inside = rng.dirichlet(np.ones(dim + 1), 6) @ np.array(corners)
    probes = spark.createDataFrame([(1, i, [float(x) for x in p]) for i, p in enumerate(inside)], "mesh_id int, probe long, pos array<double>")
    matrix = SH.shape_matrix(probes, m, order)
    got = {r.probe: r.value for r in SH.apply_shapes(matrix, values, order, dim).collect()}
    assert got == pytest.approx({i: value(p) for i, p in enumerate(inside)}, abs=1e-9) and len(got) == 6
    # A site without a value leaves its probes out.
    short = values.filter(F.col("value") != given[0][2])
    assert SH.apply_shapes(matrix, short, order, dim).count() == 0


def test_weights(spark):
    m = mesh(spark, [(0.0,), (3.0,)], [(0, 1)])
    kind = "mesh_id int, site array<struct<pid:long,weight:int>>"
    sites = spark.createDataFrame([(1, [(0, 1), (1, 2)]), (1, [(0, 1), (1, 2)]), (1, [(1, 3)]), (1, [])], kind)
    assert {tuple(r.pos) for r in SH.weighted_positions(sites, m.points, 1, 10.0).collect()} == {(20.0,), (30.0,)}
    for wrong in ([(0, 1), (9, 1)], [(0, 1), (1, -1)]):
        with pytest.raises(PySparkException):
            SH.weighted_positions(spark.createDataFrame([(1, wrong)], kind), m.points, 1).collect()
    with pytest.raises(ValueError):
        SH.order_sites(m, 0)


def test_mesh_store_versions(spark, tmp_path):
    from stepfield.sources import meshes as ME

    path, a, b = str(tmp_path / "store"), below(spark), above(spark, "other")
    points = lambda: {r.pid for r in ME.read_mesh_store(spark, path).points.collect()}
    with pytest.raises(ValueError, match="no mesh store"):
        ME.read_mesh_store(spark, path)
    ME.write_mesh_store(a, path)
    assert points() == {0, 1, 2, 3, 4} and ME.read_mesh_store(spark, path).periodic is None
    with pytest.raises(ValueError, match="already"):
        ME.write_mesh_store(b, path)
    # A write that stops after its first table is never seen.
    broken = M.Mesh(b.points.filter("pid <> 104"), b.simplices, 3)
    with pytest.raises(PySparkException):
        ME.write_mesh_store(broken, path, replace=True)
    assert points() == {0, 1, 2, 3, 4} and len(ME.mesh_versions(spark, path)) == 1
    ME.write_mesh_store(M.Mesh(b.points, b.simplices, 3, spark.createDataFrame([(1, 0, 100), (1, 0, 103)], "mesh_id int, gid long, pid long")), path, replace=True)
    assert points() == {100, 101, 102, 103, 104} and ME.read_mesh_store(spark, path).periodic.count() == 2
    assert [r.number for r in ME.mesh_versions(spark, path)] == [2, 1]


@pytest.mark.parametrize("rows_per_task", [None, 3])
def test_equal_places_of_a_table(spark, rows_per_task):
    from stepfield.operators import probe as P

    table = spark.createDataFrame([(1, x, y) for x, y in ((0.0, 0.0), (1.0, 5.0), (1.0, 2.0), (1.0, 3.0), (2.0, 7.0), (2.0, 7.0))], "run int, x double, y double")
    asked = spark.createDataFrame([(1, x) for x in (-1.0, 0.5, 1.0, 1.0, 1.5, 2.0, 3.0)], "run int, x double")
    got = sorted((r.x, r.out) for r in P.interp1(asked.repartition(4), table.repartition(3), ["run"], "x", "y", "out", rows_per_task).collect())
    # A jump: the least value at its left, the greatest at and right of it.
    assert got == [(-1.0, 0.0), (0.5, 1.0), (1.0, 5.0), (1.0, 5.0), (1.5, 6.0), (2.0, 7.0), (3.0, 7.0)]
