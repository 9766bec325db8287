"""Binary grids by byte ranges, triangles in n x n parts, stores that appear whole."""

import itertools
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from stepfield.operators import mesh as M
from stepfield.sources import grid_blocks as GB
from stepfield.sources import snapshots as SN

GRID = "grid_id string, ix bigint, iy bigint, iz bigint, x double, y double, z double, v array<double>"


def grid_rows(nx=4, ny=3, nz=50, name="g"):
    rng = random.Random(nx)
    return [(name, i, j, k, 1 + 0.5 * i, 2.0 * j, -1 + 0.25 * k, [rng.random(), float(k), -float(i)]) for k in range(nz) for j in range(ny) for i in range(nx)]


@pytest.fixture(scope="module")
def grids(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grids"))
    rows = grid_rows() + grid_rows(2, 2, 3, "small")
    GB.write_grid_blocks(spark.createDataFrame(rows, GRID).repartition(5), path, (0.5, 2.0, 0.25))
    return path, rows


def plain(rows):
    return sorted((r[0], *r[1:4], *(round(c, 9) for c in r[4:7]), tuple(r[7])) for r in rows)


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_any_split_gives_the_grid(spark, grids, split):
    path, rows = grids
    df = GB.read_grid_blocks(spark, path, split)
    assert df.rdd.getNumPartitions() == sum(-(-os.path.getsize(f"{path}/{f}") // split) for f in os.listdir(path) if f.endswith(".ovf"))
    assert plain(df.collect()) == plain(rows)


def test_wanted_grids_and_layers(spark, grids):
    path, rows = grids
    whole, one = GB.read_grid_blocks(spark, path, 200), GB.read_grid_blocks(spark, path, 200, ["small"])
    assert one.rdd.getNumPartitions() < whole.rdd.getNumPartitions() / 3 and plain(one.collect()) == plain(r for r in rows if r[0] == "small")
    some = GB.read_grid_blocks(spark, path, 200, ["g"], (11, 12))
    assert plain(some.collect()) == plain(r for r in rows if r[0] == "g" and 10 < r[3] <= 12)
    assert whole.filter("iz = 2 and x > 1.2").count() == sum(r[3] == 2 and r[4] > 1.2 for r in rows) and whole.count() == len(rows)
    assert GB.read_grid_blocks(spark, path, layers=(5, 3)).count() == 0 and GB.read_grid_blocks(spark, path, grids=["no such"]).count() == 0


def test_both_orders_of_bytes_and_broken_files(spark, tmp_path):
    def write(name, second, size, data=None, check=None, cut=0):
        kind = ("<" if second else ">") + {4: "f", 8: "d"}[size]
        head = f"# OOMMF: rectangular mesh v{2 if second else 1}.0\n# Begin: Header\n# xnodes: 2\n# ynodes: 1\n# znodes: 2\n" + "".join(f"# {a}base: 0\n# {a}stepsize: 1\n" for a in "xyz")
        head += ("# valuedim: 3\n" if second else "# valuemultiplier: 2\n") + f"# End: Header\n# Begin: Data Binary {size}\n"
        values = [GB.CHECKS[size] if check is None else check, *range(12)]
        body = b"".join(struct.pack(kind, v) for v in values)
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.ovf").write_bytes(head.encode() + body[:len(body) - cut] + (b"" if cut else b"\n# End: Data"))
        return str(tmp_path / name)

    for second, size in itertools.product((True, False), (4, 8)):
        got = GB.read_grid_blocks(spark, write(f"ok{second}{size}", second, size), 16).orderBy("iz", "ix").collect()
        assert [r.v for r in got] == [[c * (1 if second else 2) for c in range(3 * i, 3 * i + 3)] for i in range(4)]
    for name, more in (("check", {"check": 1.0}), ("short", {"cut": 9})):
        with pytest.raises(Exception, match="wrong check value" if name == "check" else "cut off"):
            GB.read_grid_blocks(spark, write(name, True, 8, **more)).collect()


def test_grids_with_holes_are_refused(spark, tmp_path):
    rows = grid_rows(2, 2, 2)
    for bad in (rows[:-1] + [rows[0]], rows[:3] + rows[4:]):
        with pytest.raises(Exception, match="missing or repeated|of 8 nodes"):
            GB.write_grid_blocks(spark.createDataFrame(bad, GRID), str(tmp_path / "x"), (1, 1, 1))
    assert not [f for f in os.listdir(tmp_path / "x") if f.endswith(".ovf")]


def square(spark):
    points = [("m", i, [float(i % 3), float(i // 3)]) for i in range(9)] + [("n", 5, [0.0, 0.0]), ("n", 7, [6.0, 0.0]), ("n", 9, [0.0, 6.0])]
    tri = [("m", 2 * c + h, c % 2, [[b, b + 1, b + 4], [b + 4, b, b + 3]][h]) for c, b in enumerate((0, 1, 3, 4)) for h in (0, 1)] + [("n", 0, 1, [7, 5, 9])]
    return M.Mesh(spark.createDataFrame(points, "mesh_id string, pid bigint, pos array<double>"), spark.createDataFrame(tri, "mesh_id string, sid bigint, region int, v array<bigint>"), 2)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_triangles_meet_in_their_points(spark, n):
    m = M.subdivide(square(spark), n)
    points = {(r.mesh_id, r.pid): r.pos for r in m.points.collect()}
    at = [(g, tuple(round(c, 9) for c in p)) for (g, _), p in points.items()]
    # A square of 2 x 2 cells in n parts each: every lattice point once.
    assert len(at) == len(set(at)) and sorted(p for g, p in at if g == "m") == sorted((round(x / n, 9), round(y / n, 9)) for x in range(2 * n + 1) for y in range(2 * n + 1))
    old = {(r.mesh_id, r.pid): r.pos for r in square(spark).points.collect()}
    assert all(points[k] == p for k, p in old.items())
    area, seen = {}, set()
    for r in m.simplices.collect():
        (ax, ay), (bx, by), (cx, cy) = (points[r.mesh_id, p] for p in r.v)
        size = abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2
        assert abs(size - (0.5 if r.mesh_id == "m" else 18) / n**2) < 1e-9
        area[r.mesh_id] = area.get(r.mesh_id, 0) + size
        seen.add((r.mesh_id, r.sid))
    assert len(seen) == 9 * n * n and abs(area["m"] - 4) < 1e-9 and abs(area["n"] - 18) < 1e-9
    # Inner edges belong to two triangles, edges of the border to one.
    edges = M.edges(m).count()
    assert edges == (9 * n * n * 3 + (8 + 3) * n) // 2


def test_lines_in_parts(spark):
    mesh = M.Mesh(spark.createDataFrame([(0, 0, [0.0]), (0, 1, [4.0]), (0, 2, [5.0])], "mesh_id int, pid bigint, pos array<double>"),
                  spark.createDataFrame([(0, 0, 1, [1, 0]), (0, 1, 1, [1, 2])], "mesh_id int, sid bigint, region int, v array<bigint>"), 1)
    m = M.subdivide(mesh, 4)
    assert sorted(r.pos[0] for r in m.points.collect()) == [0, 1, 2, 3, 4, 4.25, 4.5, 4.75, 5]
    assert m.simplices.count() == 8
    with pytest.raises(ValueError):
        M.subdivide(M.Mesh(mesh.points, mesh.simplices, 3), 2)


def snaps(spark, ids, run="r 1", field="m"):
    rows = [(run, 0, field, f"{field}_a", i, i * 10, i // 2, i / 2, [p], [float(p), float(i), 1.0]) for i in ids for p in range(6)]
    return spark.createDataFrame(rows, "run_id string, mesh_id bigint, field string, subfield string, id bigint, step bigint, stage bigint, time double, site array<bigint>, value array<double>")


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    points = spark.createDataFrame([(0, p, [1.0 * p, 0.0, 0.0]) for p in range(6)], "mesh_id bigint, pid bigint, pos array<double>")
    catalog = spark.createDataFrame([("r 1", "m", "m_a", "k"), ("b:2", "m", "m_a", "k")], "run_id string, field string, subfield string, unit string")
    factors = spark.createDataFrame([("k", 1000.0)], "unit string, factor double")
    append = lambda s: SN.append_snapshots(s, path, catalog, factors, points, 3)
    append(snaps(spark, [0, 2]))
    append(snaps(spark, [1, 5]).unionByName(snaps(spark, [3], "b:2")))
    return path, append


def test_one_save_opens_its_files_only(spark, store):
    path, _ = store
    rows = SN.read_snapshot(spark, path, "m", "m_a", 1)
    assert {(r.run_id, r.id, r.row) for r in rows.collect()} == {("r 1", 1, 1)} and rows.count() == 6
    index = {(r.run_id, r.id): set(r.files) for r in SN.save_index(spark, path).collect()}
    assert len(rows.inputFiles()) <= len(index["r 1", 1]) < len(SN.read_store(spark, path).inputFiles())
    got = {(r.run_id, r.id): (r.row, r.sites, r.step) for r in SN.save_index(spark, path).collect()}
    assert got == {("r 1", i): (k, 6, 10 * i) for k, i in enumerate([0, 1, 2, 5])} | {("b:2", 3): (0, 6, 30)}
    assert {(r.run_id, r.id) for r in SN.read_subfield(spark, path, "m", "m_a").collect()} == {("r 1", 0), ("b:2", 3)}
    assert {r.id for r in SN.read_subfield(spark, path, "m", "m_a", row=3).collect()} == {5}
    assert SN.read_subfield(spark, path, "m", "m_a", id=77).count() == 0
    assert {r.value[0] for r in SN.read_subfield(spark, path, "m", "m_a", id=3).collect()} == {1000.0 * p for p in range(6)}


def test_failed_appends_leave_the_store_as_it_was(spark, store):
    path, append = store
    before = sorted(map(str, SN.read_store(spark, path).collect()))
    good = snaps(spark, [8])
    for bad in (snaps(spark, [9], field="unknown"), snaps(spark, [9]).withColumn("mesh_id", F.lit(4).cast("bigint")), snaps(spark, [9], "no such run")):
        with pytest.raises(Exception):
            append(good.unionByName(bad))
    # Stopped between the rows and the publication.
    good.select(*SN.COLUMNS).write.partitionBy("run_id", "field").parquet(f"{path}/rows/batch=alost")
    assert sorted(map(str, SN.read_store(spark, path).collect())) == before
    assert {r.id for r in SN.save_index(spark, path).collect()} == {0, 1, 2, 3, 5}
    append(good)
    assert {r.id for r in SN.save_index(spark, path).collect()} == {0, 1, 2, 3, 5, 8}
    append(good.limit(0))
    assert SN.read_store(spark, path).count() == len(before) + 6
