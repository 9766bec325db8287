"""Common surfaces of two meshes that were made apart, each with point ids of its own (J-21)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.operators import mesh as M
from stepfield.plans.skewed import lookup, matched, need
from stepfield.session import cut_lineage


def outer_faces(mesh: M.Mesh) -> DataFrame:
    """Faces of one simplex: mesh_id, face (sorted ids)."""
    return M.face_table(mesh).filter("n = 1").select("mesh_id", "face")


def same_points(a: DataFrame, b: DataFrame, dim: int, tolerance: float) -> DataFrame:
    """Points (mesh_id, pid, pos) of both tables that are at most ``tolerance`` apart: mesh_id, pid_a, pid_b.

    Points fall into cells as wide as the tolerance; one of ``a`` looks into its cell and those around it. The
    points of one table have to be more than twice the tolerance apart: one with two partners stops the job.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    axes = range(dim)
    cell = [F.floor(F.col(f"x{i}") / tolerance).cast("bigint") for i in axes]
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in itertools.product((-1, 0, 1), repeat=dim)])
    near = M.xyz(a, dim).withColumn("_s", F.explode(steps)).select(
        "mesh_id", F.col("pid").alias("pid_a"), *[F.col(f"x{i}").alias(f"a{i}") for i in axes], *[(c + F.col("_s")[i]).alias(f"c{i}") for i, c in enumerate(cell)])
    own = M.xyz(b, dim).select("mesh_id", F.col("pid").alias("pid_b"), *[F.col(f"x{i}").alias(f"b{i}") for i in axes], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    apart = reduce(lambda x, y: x + y, [(F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in axes])
    pairs = lookup(near, own, ["mesh_id", *[f"c{i}" for i in axes]]).filter(apart <= tolerance * tolerance).select("mesh_id", "pid_a", "pid_b")
    message = "a point with several partners: the tolerance is too large"
    for one, other in (("pid_a", "pid_b"), ("pid_b", "pid_a")):
        kind = dict(pairs.dtypes)[other]
        least = F.min(other)
        pairs = pairs.groupBy("mesh_id", one).agg(need(least, message, kind, F.max(other) == least).alias(other))
    return pairs.select("mesh_id", "pid_a", "pid_b")


def _common_faces(faces: DataFrame, same: DataFrame, side: str, dim: int) -> DataFrame:
    """Faces whose points all have a partner: mesh_id, side, face (own ids), key (sorted ids of the first mesh)."""
    names = same.select("mesh_id", F.col(f"pid_{side}").alias("pid"), F.col("pid_a").alias("_to"))
    rows = lookup(faces.withColumn("pid", F.explode("face")), names, ["mesh_id", "pid"])
    whole = rows.groupBy("mesh_id", "face").agg(F.array_sort(F.collect_list("_to")).alias("key")).filter(F.size("key") == dim)
    return whole.select("mesh_id", F.lit(side).alias("side"), "face", "key")


def one_sided_faces(a: M.Mesh, b: M.Mesh, tolerance: float) -> DataFrame:
    """Outer faces all of whose points are on both meshes, but which are faces of one mesh only.

    mesh_id, side (``a`` or ``b``), face (ids of that mesh), key (ids of the first mesh). Meshes of equal ``mesh_id``
    meet; points that are at most ``tolerance`` apart are the same point (see ``same_points``).
    """
    d = a.dim
    if b.dim != d:
        raise ValueError("the meshes differ in dimension")
    outer = {"a": cut_lineage(outer_faces(a)), "b": cut_lineage(outer_faces(b))}
    shell = {s: matched(outer[s].select("mesh_id", F.explode("face").alias("pid")).distinct(), m.points.select("mesh_id", "pid", "pos"), ["mesh_id", "pid"],
                        "a simplex with an unknown point") for s, m in (("a", a), ("b", b))}
    same = cut_lineage(same_points(shell["a"], shell["b"], d, tolerance))
    both = _common_faces(outer["a"], same, "a", d).unionByName(_common_faces(outer["b"], same, "b", d))
    return both.groupBy("mesh_id", "key").agg(F.count(F.lit(1)).alias("_n"), F.max("side").alias("side"), F.max("face").alias("face")).filter(
        "_n = 1").select("mesh_id", "side", "face", "key")


def edges_to_divide(one_sided: DataFrame, dim: int) -> DataFrame:
    """Edges at which the one-sided faces of a mesh meet and which the other mesh's one-sided faces don't have.

    mesh_id, side, edge (sorted ids of the first mesh). Where a square is cut along one diagonal here and along the
    other one there, these are the diagonals: a point in the middle of both makes the meshes fit.
    """
    if dim != 3:
        raise ValueError("faces meet in edges in three dimensions only")
    parts = F.array(*[F.array(F.col("key")[i], F.col("key")[j]) for i, j in itertools.combinations(range(3), 2)])
    rows = one_sided.select("mesh_id", "side", F.explode(parts).alias("edge"))
    found = rows.groupBy("mesh_id", "edge").agg(F.count(F.lit(1)).alias("_n"), F.min("side").alias("side"), F.max("side").alias("_other"))
    return found.filter("side = _other and _n > 1").select("mesh_id", "side", "edge")


def middles(edges: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """The edges with the points in their middle (``pos``); ``points`` are those of the mesh whose ids the edges have."""
    ends = edges.withColumn("pid", F.explode("edge"))
    found = matched(ends, M.xyz(points, dim), ["mesh_id", "pid"], "an edge with an unknown point")
    sums = found.groupBy(*edges.columns).agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(dim)])
    return sums.select(*edges.columns, F.array(*[f"x{i}" for i in range(dim)]).alias("pos"))
