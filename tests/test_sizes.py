"""Steps whose size is not seen in the files: no side that grows is broadcast, and no task takes a whole file's simplices."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stepfield.checks import QUERIES, base
from stepfield.functions.sequences import Lattice
from stepfield.operators import graph as G
from stepfield.operators import mesh as M
from stepfield.operators import probe as P
from stepfield.operators import snapshots as S
from stepfield.plans.skewed import lookup, matched


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write(spark, path, parts=400, vectors=20):
    spark.range(parts).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{path}/part.parquet")
    v = F.array(*[(F.col("id") * k).cast("float") for k in (1, 2, 3, 4)])
    spark.range(vectors).select(F.col("id").alias("vec_id"), v.alias("embedding")).coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_lookups_shuffle_both_sides(spark):
    rows, table = spark.range(9).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit(2))
    for out in (lookup(rows, table, ["id"]), lookup(rows, table, ["id"], "left_anti"), matched(rows, table, ["id"], "no")):
        assert "Broadcast" not in plan(out)
    assert lookup(rows, table, ["id"]).count() == 3
    assert "Broadcast" in plan(matched(rows, table, ["id"], "no", few=True))


@pytest.mark.parametrize("name", ["snapshots", "edges", "max_angle", "unused", "volumes"])
def test_sides_that_grow_are_not_broadcast(spark, tmp_path, name):
    sf = write(spark, tmp_path)
    m = base.part_mesh(spark, sf, periodic=True)
    s = base.snapshots(spark, sf, m)
    where = base.subfield_where(spark, m)
    out = {"snapshots": lambda: S.norms(s, 3), "edges": lambda: M.edge_lengths(m), "max_angle": lambda: S.max_angle(s, m, where),
           "unused": lambda: M.check_mesh(m), "volumes": lambda: M.site_volumes(m)}[name]()
    # The regions of the subfields are few and may be sent to all.
    assert plan(out).count("BroadcastExchange") == (name == "max_angle")


def test_cubes_are_spread(spark, tmp_path, monkeypatch):
    sf = write(spark, tmp_path)
    want = sorted(base.part_mesh(spark, sf).simplices.collect())
    monkeypatch.setattr(base, "CUBES", 100)
    m = base.part_mesh(spark, sf)
    assert m.simplices.rdd.getNumPartitions() == 4
    assert sorted(m.simplices.collect()) == want


def test_points_without_a_group_keep_their_volume(spark):
    points = spark.createDataFrame([(0, i, [float(i == 1), float(i == 2), float(i == 3)]) for i in range(4)], "mesh_id bigint, pid bigint, pos array<double>")
    simplices = spark.createDataFrame([(0, 0, 1, [0, 1, 2, 3])], "mesh_id bigint, sid bigint, region int, v array<bigint>")
    # The group's id is also the id of a point outside of it.
    periodic = spark.createDataFrame([(0, 3, 0), (0, 3, 1)], "mesh_id bigint, gid bigint, pid bigint")
    got = {r.pid: round(r.volume * 24, 6) for r in M.site_volumes(M.Mesh(points, simplices, 3, periodic)).collect()}
    assert got == {0: 2.0, 1: 2.0, 2: 1.0, 3: 1.0}


def summed_before_shuffle(text, keys):
    """Whether rows are aggregated below an exchange by these keys."""
    lines = text.splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(" + ", ".join(f"{k}#" for k in keys) in "".join(c for c in line if not c.isdigit()).replace("L,", ",")]
    return [("Aggregate" in lines[i + 1]) for i in at]


def test_corners_meet_before_they_are_summed(spark, tmp_path):
    # A task of the join holds nearly every corner of other simplices; a sum there is as long as its rows.
    m = base.part_mesh(spark, write(spark, tmp_path))
    assert summed_before_shuffle(plan(M.located(m)), ["mesh_id", "sid", "region"]) == [False]


def test_corners_meet_before_a_layer_counts_them(spark, tmp_path, monkeypatch):
    m, stored, keep = base.part_mesh(spark, write(spark, tmp_path)), [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: stored.append(plan(df)) or keep(df))
    assert M.skin_layers(m).count() == 6 * 400
    found = [b for text in stored if "count(_f" in text for b in summed_before_shuffle(text, ["mesh_id", "sid"])]
    assert found and not any(found)


def test_points_of_a_grid_stay_one_row(spark):
    spec, rng = Lattice(((0.0, 4.0, 3), (1.0, 1.0, 1), (-1.0, 2.0, 4))), random.Random(6)
    nodes = {(i, 0, k): [float(i * 7 + k), float(i - 3 * k)] for i in range(3) for k in range(4)}
    del nodes[2, 0, 3]
    nodes[1, 0, 1][1] = None
    rows = [(0, *n, v) for n, v in nodes.items()] + [(0, 0, 0, 0, [100.0, None])]  # a node that comes twice is added up
    grid = spark.createDataFrame(rows, "grid_id int, ix bigint, iy bigint, iz bigint, v array<double>")
    at = [[rng.choice([-1.0, 0.0, 0.5, 2.0, 3.0]), rng.uniform(-9, 9), rng.choice([-5.0, -1.0, -0.25, 0.0, 0.75, 1.0])] for _ in range(40)]
    points = [(0, i % 30, p) for i, p in enumerate(at)] + [(0, 3, at[3]), (0, 5, at[5])]

    def value(p):
        x = [min(max(a, 0.0), m) for a, m in ((p[0] / 2, 2.0), (p[1] - 1, 0.0), (p[2] + 1, 3.0))]
        sums = [[], []]
        for end in itertools.product((0, 1), repeat=3):
            w = [a - math.floor(a) if o else 1 - (a - math.floor(a)) for a, o in zip(x, end)]
            if min(w) > 0:
                for r in rows:
                    if r[1:4] == tuple(math.floor(a) + o for a, o in zip(x, end)):
                        for s, v in zip(sums, r[4]):
                            s += [math.prod(w) * v] if v is not None else []
        return [sum(s) if s else None for s in sums]

    for once in (False, True):
        asked = points[:40] if once else points
        want = {i: [value(p) for _, j, p in asked if j == i] for i in range(30)}
        out = P.grid_interp(spark.createDataFrame(points, "grid_id int, point int, pos array<double>").repartition(3), grid, spec, 2, once)
        got = {r.point: r.value for r in out.collect()}
        for i, values in want.items():
            for k in range(2):
                parts = [v[k] for v in values if v[k] is not None]
                assert got[i][k] == (pytest.approx(sum(parts)) if parts else None)
        # Only the grid's nodes are multiplied.
        assert plan(out).split("Initial Plan")[0].count("Generate explode") == 1
    with pytest.raises(Exception, match="a grid node is missing"):
        P.grid_interp(spark.createDataFrame([(0, 1, [4.0, 1.0, 2.0])], "grid_id int, point int, pos array<double>"), grid, spec, 2).collect()


@pytest.mark.parametrize(("n", "dim"), [(1, 2), (2, 2), (3, 2), (4, 2), (1, 1), (3, 1)])
def test_new_points_follow_their_parents(spark, n, dim):
    pos = {0: (0.0, 0.0, 1.0), 5: (3.0, 0.0, 2.0), 2: (0.0, 6.0, 0.0), 9: (3.0, 6.0, 9.0)}
    v = {100: [5, 0, 2], 7: [9, 2, 5], 8: [2, 9, 5]} if dim == 2 else {100: [5, 0], 7: [5, 2], 8: [2, 9]}
    points = spark.createDataFrame([(1, i, list(p)) for i, p in pos.items()], "mesh_id bigint, pid bigint, pos array<double>")
    simplices = spark.createDataFrame([(1, s, 4, x) for s, x in v.items()], "mesh_id bigint, sid bigint, region int, v array<bigint>")
    out = M.subdivide(M.Mesh(points, simplices, dim), n)
    got = {r.pid: tuple(r.pos) for r in out.points.collect()}
    keys = {tuple(sorted((x[k], w) for k, w in enumerate(ws) if w)) for x in v.values() for ws in M.lattice(n, dim)}
    ids = {key: 10 + i for i, key in enumerate(sorted(k for k in keys if len(k) > 1))} | {((p, n),): p for p in pos}
    assert got == {ids[k]: pytest.approx(tuple(sum(w * pos[p][a] for p, w in k) / n for a in range(3))) for k in keys}
    want = {(s * n**dim + j, 4, *(ids[tuple(sorted((x[k], w) for k, w in enumerate(ws) if w))] for ws in part)) for s, x in v.items() for j, part in enumerate(M.lattice_parts(n, dim))}
    assert {(r.sid, r.region, *r.v) for r in out.simplices.collect()} == want


@pytest.mark.parametrize("name", ["j20_refine_parts", "j20_subdivide_parts"])
def test_parts_share_the_positions_of_their_block(spark, tmp_path, name):
    out = QUERIES[name](spark, write(spark, tmp_path))
    text = plan(out)
    # No position goes with a corner of its own, and the rows of a simplex are not summed before they meet.
    assert summed_before_shuffle(text, ["mesh_id", "_near"]) and not any(summed_before_shuffle(text, ["mesh_id", "_near"]))
    assert not summed_before_shuffle(text, ["mesh_id", "sid", "region"])
    assert out.count() == 6 * 400


def test_blocks_place_corners(spark, tmp_path):
    m = base.part_mesh(spark, write(spark, tmp_path))
    want = {(r.mesh_id, r.sid): [r[f"x{k}{a}"] for k in range(4) for a in range(3)] for r in M.located(m).collect()}
    got = {(r.mesh_id, r.sid): [x for p in r.corners for x in p] for r in M.placed(m, 50).collect()}
    assert got == want and len(want) == 6 * 400
    lost = M.Mesh(m.points.filter("pid <> 91"), m.simplices)
    with pytest.raises(Exception, match="a simplex with an unknown point"):
        M.placed(lost, 50).collect()


def plain_components(edges):
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_keep_to_what_hangs_on_no_smaller_node(spark, monkeypatch):
    stored, keep = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: stored.append(keep(df)) or stored[-1])
    # Stars, some of them joined by a node, as rows of orders and their parts are.
    edges = [(i // 20, 1000 + i) for i in range(2000)] + [(3, 1000), (8, 1981)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    assert got == plain_components(edges)
    assert sum(df.count() > 100 for df in stored) == 3


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    graphs = [[(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (40, 140, 300)]
    graphs += [[(i, i + 1) for i in range(60)], [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(70)], [(i, 500) for i in range(30)] + [(7, 7), (900, 900)]]
    rows = [(k, a, b) for k, g in enumerate(graphs) for a, b in g]
    edges = spark.createDataFrame(rows, "k int, src long, dst long").repartition(5)
    alone = spark.createDataFrame([(0, 4000), (3, 2), (9, 1)], "k int, node long")
    want = {(k, x): c for k, g in enumerate(graphs) for x, c in plain_components(g).items()} | {(0, 4000): 4000, (9, 1): 1}
    out = G.components(edges, ["k"], alone).collect()
    assert len(out) == len(want) and {(r.k, r.node): r.component for r in out} == want
