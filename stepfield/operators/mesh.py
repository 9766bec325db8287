"""Unstructured meshes as two tables (J-05 … J-08, J-20 … J-22, A-01, A-05, A-09 … A-15, A-19, A-21,
A-22, P-22 … P-25, P-29, W-10, W-11, T-01, T-02, U-04).

``points(mesh_id, pid, pos)`` and ``simplices(mesh_id, sid, region, v)``; ``v`` lists dim + 1 point ids.
Region -1 is outer space. Every step is keyed by ``mesh_id``, so many meshes are handled at once.
"""

from __future__ import annotations

import itertools
import operator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.functions import geometry as g
from stepfield.plans.ordered import Ordered, dense_ids
from stepfield.plans.skewed import demand, lookup, matched
from stepfield.session import cut_lineage


@dataclass(frozen=True)
class Mesh:
    points: DataFrame
    simplices: DataFrame
    dim: int = 3
    periodic: DataFrame | None = None  # mesh_id, gid, pid


def _subsets(v: Column, dim: int, size: int) -> Column:
    """Array of the sorted sub-tuples of ``size`` vertices."""
    return F.array(*[F.array_sort(F.array(*[v[i] for i in c])) for c in itertools.combinations(range(dim + 1), size)])


def corners(mesh: Mesh) -> DataFrame:
    """One row per simplex and vertex: mesh_id, sid, region, k, pid."""
    return mesh.simplices.select("mesh_id", "sid", "region", F.posexplode("v").alias("k", "pid"))


def xyz(points: DataFrame, dim: int) -> DataFrame:
    return points.select("mesh_id", "pid", *[F.col("pos")[a].alias(f"x{a}") for a in range(dim)])


def located(mesh: Mesh) -> DataFrame:
    """Simplices with the coordinates of vertex k on axis a in column ``x<k><a>``."""
    d = mesh.dim
    rows = matched(corners(mesh), xyz(mesh.points, d), ["mesh_id", "pid"], "a simplex with an unknown point")
    # The corners of a simplex come from different tasks of the join: summing there first would hold a wide row for nearly every corner.
    return rows.repartition("mesh_id", "sid", "region").groupBy("mesh_id", "sid", "region").agg(*[
        F.max(F.when(F.col("k") == k, F.col(f"x{a}"))).alias(f"x{k}{a}") for k in range(d + 1) for a in range(d)
    ] + [F.max(F.when(F.col("k") == k, F.col("pid"))).alias(f"v{k}") for k in range(d + 1)])


def placed(mesh: Mesh, per: int) -> DataFrame:
    """mesh_id, block, sid, region, v and corners (the positions of v); a block is ``per`` numbers of simplices.

    Positions go once to each block that uses a point, instead of once to each corner: neighbours in number share most of theirs.
    """
    block = F.floor(F.col("sid") / per).alias("block")
    used = corners(mesh).select("mesh_id", block, "pid").distinct()
    found = matched(used, mesh.points.select("mesh_id", "pid", "pos"), ["mesh_id", "pid"], "a simplex with an unknown point")
    at = found.groupBy("mesh_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("pid", "pos"))).alias("at"))
    own = mesh.simplices.groupBy("mesh_id", block).agg(F.collect_list(F.struct("sid", "region", "v")).alias("s"))
    both = lookup(own, at, ["mesh_id", "block"])
    parts = F.transform("s", lambda x: F.struct(x["sid"], x["region"], x["v"], F.transform(x["v"], lambda i: F.element_at("at", i)).alias("corners")))
    return both.select("mesh_id", "block", F.inline(parts))


def vertices(dim: int) -> list[list[Column]]:
    """The vertices of a row of ``located`` for the geometry functions."""
    return [[F.col(f"x{k}{a}") for a in range(dim)] for k in range(dim + 1)]


def volumes(mesh: Mesh, per: int | None = None) -> DataFrame:
    """mesh_id, sid, region, v0.., volume. With ``per`` the positions are sent by blocks (``placed``), for meshes whose neighbours have near numbers; simplices are unique there."""
    d = mesh.dim
    if per:
        return placed(mesh, per).select("mesh_id", "sid", "region", *[F.col("v")[k].alias(f"v{k}") for k in range(d + 1)],
                                        g.volume([[F.col("corners")[k][a] for a in range(d)] for k in range(d + 1)]).alias("volume"))
    return located(mesh).select("mesh_id", "sid", "region", *[f"v{k}" for k in range(mesh.dim + 1)],
                                g.volume(vertices(mesh.dim)).alias("volume"))


# Faces, neighbours, surfaces

def faces(mesh: Mesh) -> DataFrame:
    return mesh.simplices.select("mesh_id", "sid", "region",
                                 F.explode(_subsets(F.col("v"), mesh.dim, mesh.dim)).alias("face"))


def face_table(mesh: Mesh) -> DataFrame:
    """One row per face: number of owners, the first and last owner and their regions."""
    return faces(mesh).groupBy("mesh_id", "face").agg(
        F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid_a"), F.max("sid").alias("sid_b"),
        F.min_by("region", "sid").alias("region_a"), F.max_by("region", "sid").alias("region_b"),
        F.min("region").alias("low"), F.max("region").alias("high"))


def neighbours(mesh: Mesh) -> DataFrame:
    """Pairs of simplices with a common face. On a broken face with more owners each later owner is
    paired with the first one."""
    table = face_table(mesh).filter("n > 1")
    pairs = table.filter("n = 2").select("mesh_id", "face", "sid_a", "sid_b")
    crowd = table.filter("n > 2").select("mesh_id", "face", "sid_a")
    more = lookup(faces(mesh), crowd, ["mesh_id", "face"]).filter("sid > sid_a").select(
        "mesh_id", "face", "sid_a", F.col("sid").alias("sid_b"))
    return pairs.unionByName(more)


def interfaces(mesh: Mesh) -> DataFrame:
    """Faces between different regions with both regions; outer space is -1."""
    table = face_table(mesh)
    return table.filter("n = 1 or low <> high").select(
        "mesh_id", "face", F.when(F.col("n") == 1, F.lit(-1)).otherwise(F.col("low")).alias("region_a"),
        F.col("high").alias("region_b"))


def surfaces(mesh: Mesh) -> DataFrame:
    """Faces without a neighbour or with one in another region, once per adjoining body."""
    edge = face_table(mesh).filter("n = 1 or low <> high")
    return edge.select("mesh_id", "face", F.explode(F.array_distinct(F.array("low", "high"))).alias("region"))


def edges(mesh: Mesh) -> DataFrame:
    pair = F.explode(_subsets(F.col("v"), mesh.dim, 2)).alias("e")
    return (mesh.simplices.select("mesh_id", pair)
            .select("mesh_id", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")).distinct())


def adjacency(mesh: Mesh) -> DataFrame:
    """Neighbours of every node in long form: mesh_id, pid, neighbour. A node may have any number."""
    e = edges(mesh)
    both = F.explode(F.array(F.struct(F.col("src").alias("pid"), F.col("dst").alias("neighbour")),
                             F.struct(F.col("dst").alias("pid"), F.col("src").alias("neighbour"))))
    return e.select("mesh_id", both.alias("p")).select("mesh_id", "p.*")


def adjacency_lists(mesh: Mesh) -> DataFrame:
    """The same as one sorted array per node, for meshes, where a node has few neighbours."""
    return adjacency(mesh).groupBy("mesh_id", "pid").agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))


def edge_lengths(mesh: Mesh) -> DataFrame:
    d = mesh.dim
    p = xyz(mesh.points, d)
    a = p.select("mesh_id", F.col("pid").alias("src"), *[F.col(f"x{i}").alias(f"a{i}") for i in range(d)])
    b = p.select("mesh_id", F.col("pid").alias("dst"), *[F.col(f"x{i}").alias(f"b{i}") for i in range(d)])
    rows = lookup(lookup(edges(mesh), a, ["mesh_id", "src"]), b, ["mesh_id", "dst"])
    diff = [F.col(f"b{i}") - F.col(f"a{i}") for i in range(d)]
    return rows.select("mesh_id", "src", "dst", g.length(diff).alias("length"))


def point_region_rows(mesh: Mesh) -> DataFrame:
    """Distinct (mesh_id, pid, region); points of outer faces also touch region -1."""
    inside = corners(mesh).select("mesh_id", "pid", "region")
    outer = face_table(mesh).filter("n = 1").select("mesh_id", F.explode("face").alias("pid"), F.lit(-1).alias("region"))
    return inside.unionByName(outer).distinct()


def point_regions(mesh: Mesh) -> DataFrame:
    """Sorted regions each point touches."""
    return point_region_rows(mesh).groupBy("mesh_id", "pid").agg(F.sort_array(F.collect_set("region")).alias("regions"))


def _surface_points(mesh: Mesh) -> DataFrame:
    """Points touching exactly two regions."""
    return point_region_rows(mesh).groupBy("mesh_id", "pid").count().filter("count = 2").select("mesh_id", "pid")


# Volumes

def site_volumes(mesh: Mesh) -> DataFrame:
    """Share of the volume at each point; periodic images all carry the sum of their group."""
    d = mesh.dim
    share = (F.col("volume") / float(d + 1)).alias("volume")
    rows = volumes(mesh).select("mesh_id", F.explode(F.array(*[f"v{k}" for k in range(d + 1)])).alias("pid"), share)
    own = rows.groupBy("mesh_id", "pid").agg(F.sum("volume").alias("volume"))
    if mesh.periodic is None:
        return own
    tagged = lookup(own, mesh.periodic, ["mesh_id", "pid"], "left")
    shared = tagged.filter("gid is not null").groupBy("mesh_id", "gid").agg(F.sum("volume").alias("_sum"))
    return of_group(tagged, shared, ["mesh_id"]).select("mesh_id", "pid", F.coalesce("_sum", "volume").alias("volume"))


def of_group(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left lookup by ``keys`` and ``gid``; rows without a group are spread by their ``pid``."""
    rows = rows.withColumns({"_in": F.col("gid").isNotNull(), "_at": F.coalesce("gid", "pid")})
    table = table.withColumns({"_in": F.lit(True), "_at": F.col("gid")}).drop("gid")
    return lookup(rows, table, [*keys, "_in", "_at"], "left").drop("_in", "_at")


def region_volumes(mesh: Mesh) -> DataFrame:
    """Volume per region 0 … highest; regions without simplices have 0."""
    found = volumes(mesh).groupBy("mesh_id", "region").agg(F.sum("volume").alias("volume"))
    every = found.groupBy("mesh_id").agg(F.max("region").alias("top")).select(
        "mesh_id", F.explode(F.sequence(F.lit(0), F.greatest("top", F.lit(0)))).alias("region"))
    return every.join(found, ["mesh_id", "region"], "left").select(
        "mesh_id", "region", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def material_volumes(mesh: Mesh, region_props: DataFrame) -> DataFrame:
    """Volume per property of the regions (mesh_id, region, prop)."""
    return (region_volumes(mesh).join(region_props, ["mesh_id", "region"])
            .groupBy("mesh_id", "prop").agg(F.sum("volume").alias("volume")))


# Statistics

def outer_corners(points: DataFrame, dim: int = 3) -> DataFrame:
    p = xyz(points, dim)
    return p.groupBy("mesh_id").agg(*[f(f"x{a}").alias(f"{n}{a}") for n, f in (("min", F.min), ("max", F.max))
                                      for a in range(dim)])


def _histogram(rows: DataFrame, value: str, low, high, bins: int, clamp: bool = True) -> DataFrame:
    """Counts and shares in ``bins`` equal bins, the last one closed. ``clamp`` moves values outside
    into the end bins, else they are left out of the counts (but not of the share's base)."""
    place = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    place = F.when(F.col(value) == high, bins - 1).when(high == low, 0).otherwise(place)
    if clamp:
        place = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))
    # A bin that can't be null takes no filter, which would repeat the whole expression of the value below the sums.
    place = F.coalesce(place, F.lit(-1))
    counted = rows.groupBy("mesh_id", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    base = counted.groupBy("mesh_id").agg(F.sum("n").alias("_all"))
    grid = base.select("mesh_id", "_all", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, ["mesh_id", "bin"], "left").select(
        "mesh_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("share"))


def edge_summary(mesh: Mesh) -> DataFrame:
    return edge_lengths(mesh).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("edges"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("sd"),
        F.min("length").alias("low"), F.max("length").alias("high"))


def edge_stats(mesh: Mesh, bins: int = 10) -> DataFrame:
    """Histogram of the edge lengths over [min, max] with mean, population deviation and range."""
    lengths = edge_lengths(mesh)
    summary = edge_summary(mesh)
    # One row per mesh; every edge has one.
    ranged = lengths.join(F.broadcast(summary.select("mesh_id", "low", "high")), "mesh_id")
    return _histogram(ranged, "length", F.col("low"), F.col("high"), bins).join(summary, "mesh_id")


def qualities(mesh: Mesh) -> DataFrame:
    d, v = mesh.dim, vertices(mesh.dim)
    # Sizes become columns first: within one expression each would be written out at every use.
    rows = located(mesh).withColumns({"_volume": g.volume(v), "_shell": g.shell_size(v), **{f"_e{i}{j}": g.length(g.sub(v[i], v[j]))
                                      for i, j in itertools.combinations(range(d + 1), 2)}})
    rows = rows.withColumns({f"_p{k}": p for k, p in enumerate(g.edge_products(lambda i, j: F.col(f"_e{i}{j}"), d))})
    return rows.select("mesh_id", "sid", "region", g.quality_of("_volume", "_shell", [F.col(f"_p{k}") for k in range(3 if d == 3 else 1)], d).alias("quality"))


def quality_hist(mesh: Mesh, bins: int = 10, clamp: bool = False) -> DataFrame:
    return _histogram(qualities(mesh), "quality", F.lit(0.0), F.lit(1.0), bins, clamp)


def worst(mesh: Mesh, k: int = 100) -> DataFrame:
    return qualities(mesh).orderBy("quality", "mesh_id", "sid").limit(k)


def mesh_info(mesh: Mesh) -> DataFrame:
    """Counts, regions, volume, boundary points, periodic points and memory floor, as (mesh_id, item, value)."""
    d = mesh.dim

    def item(df, name, expr):
        return df.groupBy("mesh_id").agg(expr.cast("double").alias("value")).select(
            "mesh_id", F.lit(name).alias("item"), "value")

    one = F.count(F.lit(1))
    bem = F.rint(one.cast("double") * one * 8 / 1024.0 / 1024.0)
    border = _surface_points(mesh)
    shell = face_table(mesh).filter("n = 1 or low <> high")
    parts = [
        item(mesh.points, "dimensions", F.lit(d)),
        item(mesh.points, "points", one),
        item(mesh.simplices, "simplices", one),
        item(shell, "surfaces", one),
        item(mesh.simplices, "regions", F.count_distinct("region")),
        item(volumes(mesh), "volume", F.sum("volume")),
        item(border, "boundary points", one),
        item(border, "dense matrix MB", bem),
    ]
    if mesh.periodic is not None:
        parts += [item(mesh.periodic, "periodic points", F.count_distinct("gid")),
                  item(mesh.periodic, "mirage points", one - F.count_distinct("gid"))]
    summary = edge_summary(mesh).select("mesh_id", F.explode(F.create_map(*[
        x for n, c in (("edges", "edges"), ("edge mean", "mean"), ("edge sd", "sd"), ("edge min", "low"), ("edge max", "high"))
        for x in (F.lit(n), F.col(c).cast("double"))])).alias("item", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bytes_per = {"points": d * 8 + 4, "surfaces": d * 4, "simplices": (d + 1) * 4 + 4}
    weight = F.create_map(*[x for k, b in bytes_per.items() for x in (F.lit(k), F.lit(float(b)))])
    floor = (out.filter(F.col("item").isin(*bytes_per)).groupBy("mesh_id")
             .agg((F.sum(F.col("value") * weight[F.col("item")]) / 1048576.0).alias("value"))
             .select("mesh_id", F.lit("memory floor MB").alias("item"), "value"))
    return out.unionByName(summary).unionByName(floor)


def check_mesh(mesh: Mesh, listed_surfaces: DataFrame | None = None) -> DataFrame:
    """Problems found: points no simplex uses, and faces that neither join two simplices nor are in
    the list of surfaces (mesh_id, face). Without a list the computed surfaces count."""
    unused = lookup(mesh.points, corners(mesh), ["mesh_id", "pid"], "left_anti").select(
        "mesh_id", F.lit("unused point").alias("problem"), F.array("pid").alias("ids"))
    odd = face_table(mesh).filter("n <> 2").select("mesh_id", "face", "n")
    if listed_surfaces is None:
        odd = odd.filter("n > 2")
    else:
        known = listed_surfaces.select("mesh_id", F.array_sort("face").alias("face")).distinct()
        odd = lookup(odd, known, ["mesh_id", "face"], "left_anti")
    return unused.unionByName(odd.select("mesh_id", F.lit("face not shared by two").alias("problem"),
                                         F.col("face").alias("ids")))


def solid_angles(mesh: Mesh, per_region: bool = False) -> DataFrame:
    """Sum over the simplices at each point of the solid angle seen from it (three dimensions)."""
    v = vertices(3)
    at = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("pid"), g.solid_angle(v[k], *[v[i] for i in range(4) if i != k])
                                      .alias("a")) for k in range(4)])).alias("c")
    rows = located(mesh).select("mesh_id", "region", at).select("mesh_id", "region", "c.pid", "c.a")
    keys = ["mesh_id", "pid"] + (["region"] if per_region else [])
    return rows.groupBy(*keys).agg(F.sum("a").alias("angle"))


def triangle_angles(mesh: Mesh) -> DataFrame:
    """Inner angles of the triangles of a two-dimensional mesh."""
    v = vertices(2)
    a, b, c = g.tri_angles(*v)
    return located(mesh).select("mesh_id", "sid", a.alias("a"), b.alias("b"), c.alias("c"))


# Relabelling and parts

def remap(simplices: DataFrame, mapping: DataFrame, keys: list[str], dim: int, extra=("region",)) -> DataFrame:
    """Replace vertex ids through ``mapping(keys, pid, new_pid)``; a vertex without a new id is an error."""
    rows = simplices.select(*keys, "sid", *extra, F.posexplode("v").alias("k", "pid"))
    rows = matched(rows, mapping.select(*keys, "pid", "new_pid"), [*keys, "pid"], "a vertex without a new id")
    put = [F.max(F.when(F.col("k") == k, F.col("new_pid"))) for k in range(dim + 1)]
    return rows.groupBy(*keys, "sid", *extra).agg(F.array(*put).alias("v"))


def split_parts(mesh: Mesh, parts: list[list[int]]) -> tuple[DataFrame, DataFrame]:
    """Points and simplices of each list of regions, with a ``part`` column, point and simplex ids
    starting at 0 in every part. A simplex may belong to several parts."""
    table = F.array(*[F.struct(F.lit(i).alias("part"), F.array(*[F.lit(r) for r in rs]).alias("rs"))
                      for i, rs in enumerate(parts)])
    tagged = mesh.simplices.withColumn("_p", F.explode(table)).filter(F.array_contains("_p.rs", F.col("region"))).select(
        "mesh_id", F.col("_p.part").alias("part"), "sid", "region", "v")
    return _compact(tagged, mesh, ["mesh_id", "part"])


def _compact(simplices: DataFrame, mesh: Mesh, keys: list[str]):
    used = simplices.select(*keys, F.explode("v").alias("pid")).distinct()
    numbered = dense_ids(used, keys, ["pid"], "new_pid")
    points = lookup(numbered, mesh.points, ["mesh_id", "pid"]).select(
        *keys, F.col("new_pid").alias("pid"), F.col("pid").alias("old_pid"), "pos")
    width = F.size("v")
    rows = simplices.withColumn("_w", width).select(*keys, "sid", "region", "_w", F.posexplode("v").alias("k", "pid"))
    rows = lookup(rows, numbered, [*keys, "pid"])
    put = F.array(*[F.max(F.when(F.col("k") == k, F.col("new_pid"))) for k in range(mesh.dim + 1)])
    back = rows.groupBy(*keys, "sid", "region").agg(put.alias("v"), F.max("_w").alias("_w"))
    back = dense_ids(back.withColumnRenamed("sid", "old_sid"), keys, ["old_sid", "region"], "sid")
    return points, back.select(*keys, "sid", "old_sid", "region", F.slice("v", F.lit(1), F.col("_w")).alias("v"))


def surface_only(mesh: Mesh, regions: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Only the surface faces (of the listed regions), as simplices of one dimension less, renumbered."""
    s = surfaces(mesh)
    if regions is not None:
        s = s.filter(F.col("region").isin(*regions))
    keyed = dense_ids(s, ["mesh_id"], ["face", "region"], "sid").select(
        "mesh_id", "sid", "region", F.col("face").alias("v"))
    return _compact(keyed, mesh, ["mesh_id"])


_COMPARE = {"ge": operator.ge, "gt": operator.gt, "eq": operator.eq, "le": operator.le, "lt": operator.lt}


def outer_skin(mesh: Mesh, compare: str = "ge", n: int = 1) -> DataFrame:
    """Simplices with at least (or exactly, …) n vertices that touch exactly two regions."""
    hit = _surface_points(mesh).withColumn("_s", F.lit(1))
    counted = lookup(corners(mesh), hit, ["mesh_id", "pid"], "left").groupBy("mesh_id", "sid").agg(
        F.count("_s").alias("on_surface"))
    return lookup(mesh.simplices, counted.filter(_COMPARE[compare](F.col("on_surface"), n)), ["mesh_id", "sid"])


def skin_layers(mesh: Mesh, compare: str = "ge", n: int = 1) -> DataFrame:
    """Layer number of each simplex when skins are peeled off one after the other. A layer holds the
    simplices left that meet the newly exposed points; what is never reached has no row."""
    left = cut_lineage(corners(mesh).select("mesh_id", "sid", "pid"))
    front = cut_lineage(_surface_points(mesh))
    done, layer = None, 0
    while front.limit(1).count():
        seen = lookup(left, front.withColumn("_f", F.lit(1)), ["mesh_id", "pid"], "left")
        # Counted where the corners of a simplex have met, as in ``located``.
        hit = seen.repartition("mesh_id", "sid").groupBy("mesh_id", "sid").agg(F.count("_f").alias("_n")).filter(_COMPARE[compare](F.col("_n"), n))
        hit = cut_lineage(hit.select("mesh_id", "sid", F.lit(layer).alias("layer")))
        fresh = lookup(lookup(left, hit, ["mesh_id", "sid"], "left_semi").select("mesh_id", "pid").distinct(), front, ["mesh_id", "pid"], "left_anti")
        front = cut_lineage(fresh)
        left = cut_lineage(lookup(left, hit, ["mesh_id", "sid"], "left_anti"))
        done = hit if done is None else done.unionByName(hit)
        layer += 1
        if layer % 50 == 0:
            done = cut_lineage(done)
    return done if done is not None else left.select("mesh_id", "sid", F.lit(0).alias("layer")).limit(0)


def part_scalars(df: DataFrame, rules: list[tuple], out: str = "scalar") -> DataFrame:
    """Value per row by its ``region``: rules are (region, …, value), the last fitting one wins, else 0."""
    value = F.lit(0.0)
    for *regions, v in rules:
        value = F.when(F.col("region").isin(*regions), F.lit(float(v))).otherwise(value)
    return df.withColumn(out, value)


def sort_mesh(mesh: Mesh, axis: int = 0) -> tuple[Mesh, DataFrame]:
    """Renumber points along an axis (ties by old id); also returns mesh_id, new_pid, orig_pid."""
    keyed = mesh.points.withColumn("_x", F.col("pos")[axis])
    numbered = dense_ids(keyed, ["mesh_id"], ["_x", "pid"], "new_pid").drop("_x")
    mapping = numbered.select("mesh_id", "pid", "new_pid")
    points = numbered.select("mesh_id", F.col("new_pid").alias("pid"), "pos")
    periodic = None
    if mesh.periodic is not None:
        periodic = lookup(mesh.periodic, mapping, ["mesh_id", "pid"]).select("mesh_id", "gid", F.col("new_pid").alias("pid"))
    simplices = remap(mesh.simplices, mapping, ["mesh_id"], mesh.dim)
    return (replace(mesh, points=points, simplices=simplices, periodic=periodic),
            mapping.select("mesh_id", "new_pid", F.col("pid").alias("orig_pid")))


def order_mesh(mesh: Mesh, axis: int | None = 0, data: DataFrame | None = None) -> DataFrame:
    """Position of each simplex along its in-centre coordinate or along ``data(mesh_id, sid, key)``."""
    if data is None:
        data = located(mesh).select("mesh_id", "sid", g.in_centre(vertices(mesh.dim))[axis].alias("key"))
    return dense_ids(data, ["mesh_id"], ["key", "sid"], "position")


def fix_orientation(mesh: Mesh) -> Mesh:
    """Swap the first two vertices of simplices with negative volume."""
    d = mesh.dim
    rest = [F.col(f"v{k}") for k in range(2, d + 1)]
    straight, swapped = F.array("v0", "v1", *rest), F.array("v1", "v0", *rest)
    rows = located(mesh).select("mesh_id", "sid", "region",
                                F.when(g.signed_volume(vertices(d)) < 0, swapped).otherwise(straight).alias("v"))
    return replace(mesh, simplices=rows)


def scale_points(points: DataFrame, factors) -> DataFrame:
    from stepfield.functions.vec import scale_by
    return points.withColumn("pos", scale_by("pos", factors))


# Refinement. Local vertices 0 … dim are the old ones, then the edge mid-points in the
# order of the vertex pairs (0,1), (0,2), …; each row is a sub-simplex of equal volume.
_HALVES = {
    1: [(0, 2), (2, 1)],
    2: [(0, 3, 4), (3, 1, 5), (4, 5, 2), (3, 5, 4)],
    3: [(0, 4, 5, 6), (4, 1, 7, 8), (5, 7, 2, 9), (6, 8, 9, 3),
        (4, 5, 6, 8), (4, 5, 8, 7), (5, 6, 8, 9), (5, 7, 9, 8)],
}


#: Simplices that are dealt out together, and new points of a block, which share a table of their parents' positions.
NEAR, NEW = 48, 64


def _near(rows: DataFrame):
    """Rows by simplex. They meet before they are summed, as they come from different tasks, and neighbours in number stay together."""
    rows = rows.withColumn("_near", F.floor(F.col("sid") / NEAR)).repartition("mesh_id", "_near")
    return rows.groupBy("mesh_id", "_near", "sid", "region")


def refine(mesh: Mesh, level: int = 1) -> Mesh:
    """Split each simplex into 2^dim parts at its edge mid-points, ``level`` times. Old points keep
    their ids; mid-points, one per edge, follow in the order of the edges. Periodic data are lost."""
    for _ in range(level):
        mesh = _refine_once(mesh)
    return mesh


def _refine_once(mesh: Mesh) -> Mesh:
    d = mesh.dim
    top = mesh.points.groupBy("mesh_id").agg((F.max("pid") + 1).alias("_base"))
    mids = dense_ids(edges(mesh), ["mesh_id"], ["src", "dst"], "_n").join(F.broadcast(top), "mesh_id").select(
        "mesh_id", F.array("src", "dst").alias("pair"), (F.col("_base") + F.col("_n")).alias("mid"))
    p = xyz(mesh.points, d)
    ends = mids.select("mesh_id", "mid", F.explode("pair").alias("pid"))
    middle = lookup(ends, p, ["mesh_id", "pid"]).groupBy("mesh_id", "mid").agg(
        F.array(*[F.avg(f"x{a}") for a in range(d)]).alias("pos"))
    points = mesh.points.select("mesh_id", "pid", "pos").unionByName(
        middle.select("mesh_id", F.col("mid").alias("pid"), "pos"))
    rows = mesh.simplices.select("mesh_id", "sid", "region", *[F.col("v")[i].alias(f"v{i}") for i in range(d + 1)],
                                 F.posexplode(_subsets(F.col("v"), d, 2)).alias("k", "pair"))
    # The corners go with one pair.
    rows = rows.withColumns({f"v{i}": F.when(F.col("k") == 0, F.col(f"v{i}")) for i in range(d + 1)})
    rows = lookup(rows, mids, ["mesh_id", "pair"]).drop("pair")
    n_pairs = d * (d + 1) // 2
    local = _near(rows).agg(
        *[F.max(f"v{i}").alias(f"v{i}") for i in range(d + 1)], *[F.max(F.when(F.col("k") == k, F.col("mid"))).alias(f"m{k}") for k in range(n_pairs)])
    names = [F.col(f"v{i}") for i in range(d + 1)] + [F.col(f"m{k}") for k in range(n_pairs)]
    small = F.array(*[F.array(*[names[i] for i in s]) for s in _HALVES[d]])
    simplices = local.select("mesh_id", "sid", "region", F.posexplode(small).alias("j", "v")).select(
        "mesh_id", (F.col("sid") * len(_HALVES[d]) + F.col("j")).alias("sid"), "region", "v")
    return Mesh(points, simplices, d, None)


def lattice(n: int, dim: int) -> list[tuple[int, ...]]:
    """Weights (dim + 1 whole numbers that add up to n) of the lattice points of a simplex."""
    return [(*w, n - sum(w)) for w in itertools.product(range(n + 1), repeat=dim) if sum(w) <= n]


def lattice_parts(n: int, dim: int) -> list[list[tuple[int, ...]]]:
    """The n^dim equal parts of a line or triangle, by the weights of their corners."""
    up = [[w, *(tuple(v + (i == k) - (i == dim) for i, v in enumerate(w)) for k in range(dim))] for w in lattice(n, dim) if w[-1] > 0]
    if dim == 1:
        return up
    down = [[(a + 1, b, c - 1), (a + 1, b + 1, c - 2), (a, b + 1, c - 1)] for a, b, c in lattice(n, dim) if c > 1]
    return up + down


def subdivide(mesh: Mesh, n: int) -> Mesh:
    """Split each line or triangle into n^dim equal parts, for any n of 1 or more.

    A new point is known by its sorted parents with whole weights, so simplices that share an edge meet in the same
    points. Old points keep their ids, new ones follow in the order of their parents. Positions may have more axes than the
    mesh has dimensions. Periodic data are lost.
    """
    d = mesh.dim
    if d not in (1, 2):
        raise ValueError("only lines and triangles can be split into n parts along each edge")
    if n < 1:
        raise ValueError("n must be 1 or more")
    points, weights = mesh.points.select("mesh_id", "pid", "pos"), lattice(n, d)
    inner = [w for w in weights if max(w) < n]
    sides, key = [f"v{i}" for i in range(d + 1)], ["a", "wa", "b", "wb", "c"]
    tri = mesh.simplices.select("mesh_id", "sid", "region", *[F.col("v")[i].alias(c) for i, c in enumerate(sides)])
    if inner:
        sort = lambda w: F.array_sort(F.array(*[F.struct(F.col(f"v{k}").alias("pid"), F.lit(x).alias("weight")) for k, x in enumerate(w) if x]))
        rows = tri.select("*", F.posexplode(F.array(*[sort(w) for w in inner])).alias("k", "key"))
        # A parent's weight follows from the others', so two weights tell whether there is a third parent.
        rows = rows.select("mesh_id", "sid", "region", "k", *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in sides], F.col("key")[0]["pid"].alias("a"),
                           F.col("key")[0]["weight"].alias("wa"), F.col("key")[1]["pid"].alias("b"), F.col("key")[1]["weight"].alias("wb"), F.coalesce(F.get("key", F.lit(2))["pid"], F.lit(0)).alias("c"))
        top = points.groupBy("mesh_id").agg((F.max("pid") + 1).alias("_base"))
        ids = dense_ids(rows.select("mesh_id", *key).distinct(), ["mesh_id"], key, "_n").join(F.broadcast(top), "mesh_id").select("mesh_id", *key, (F.col("_base") + F.col("_n")).alias("id"))
        # New points that follow each other share parents, as neighbours share corners.
        left = F.lit(n) - F.col("wa") - F.col("wb")
        of = ids.select("mesh_id", F.col("id").alias("sid"), F.when(left > 0, F.array("wa", "wb", left)).otherwise(F.array("wa", "wb")).alias("region"),
                        F.when(left > 0, F.array("a", "b", "c")).otherwise(F.array("a", "b")).alias("v"))
        part = lambda i, a: F.get("region", F.lit(i)) * F.get(F.get("corners", F.lit(i)), a)
        pos = F.transform(F.col("corners")[0], lambda x, a: (part(0, a) + part(1, a) + F.coalesce(part(2, a), F.lit(0.0))) / n)
        made = placed(Mesh(points, of, d), NEW).select("mesh_id", F.col("sid").alias("pid"), pos.alias("pos"))
        tri = lookup(rows, ids, ["mesh_id", *key]).drop(*key)
        points = points.unionByName(made)
    local = _near(tri).agg(*[F.max(c).alias(c) for c in sides], *[F.max(F.when(F.col("k") == k, F.col("id"))).alias(f"_{k}") for k in range(len(inner))])
    at = {w: F.col(f"_{inner.index(w)}") if w in inner else F.col(f"v{w.index(n)}") for w in weights}
    parts = lattice_parts(n, d)
    simplices = local.select("mesh_id", "sid", "region", F.posexplode(F.array(*[F.array(*[at[w] for w in part]) for part in parts])).alias("j", "v"))
    return Mesh(points, simplices.select("mesh_id", (F.col("sid") * len(parts) + F.col("j")).alias("sid"), "region", "v"), d, None)


# Queries on broken meshes

def interface_mismatch(mesh: Mesh) -> DataFrame:
    """Faces whose points all lie on the common interface of two bodies but which only one of the two
    has on its surface: mesh_id, body_a, body_b, face, side."""
    d = mesh.dim
    shell = faces(mesh).groupBy("mesh_id", F.col("region").alias("body"), "face").count().filter("count = 1").drop("count")
    touch = shell.select("mesh_id", "body", F.explode("face").alias("pid")).distinct()
    a = touch.withColumnRenamed("body", "body_a")
    b = touch.withColumnRenamed("body", "body_b")
    common = lookup(a, b, ["mesh_id", "pid"]).filter("body_a < body_b")
    bodies = common.select("mesh_id", "body_a", "body_b").distinct().withColumn("body", F.explode(F.array("body_a", "body_b")))
    sided = shell.join(F.broadcast(bodies), ["mesh_id", "body"]).select(
        "mesh_id", "body_a", "body_b", F.col("body").alias("side"), "face")
    keys = ["mesh_id", "body_a", "body_b"]
    whole = (lookup(sided.withColumn("pid", F.explode("face")), common, [*keys, "pid"], "left_semi")
             .groupBy(*keys, "side", "face").count().filter(F.col("count") == d).drop("count"))
    return whole.groupBy(*keys, "face").agg(F.count(F.lit(1)).alias("_n"), F.max("side").alias("side")).filter("_n = 1").drop("_n")


def interface_points_to_add(mesh: Mesh) -> DataFrame:
    """Points of the one-sided interface faces, with the number of such faces they belong to."""
    return (interface_mismatch(mesh).select("mesh_id", "body_a", "body_b", F.explode("face").alias("pid"))
            .groupBy("mesh_id", "body_a", "body_b", "pid").agg(F.count(F.lit(1)).alias("faces")))


def sharing(mesh: Mesh, k: int = 2) -> DataFrame:
    """Simplices that share a set of ``k`` vertices with another one, in long form."""
    rows = mesh.simplices.select("mesh_id", "sid", F.explode(_subsets(F.col("v"), mesh.dim, k)).alias("shared"))
    many = rows.groupBy("mesh_id", "shared").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")
    return lookup(rows, many, ["mesh_id", "shared"])


def external_edges(mesh: Mesh) -> DataFrame:
    """Edges (sub-tuples of one vertex less) of the faces that belong to one simplex."""
    outer = face_table(mesh).filter("n = 1")
    sub = _subsets(F.col("face"), mesh.dim - 1, mesh.dim - 1)
    return outer.select("mesh_id", F.explode(sub).alias("edge")).distinct()


# Partition of the nodes

def partition_ids(points: DataFrame, pieces: int | None = None, sizes: list[int] | None = None) -> DataFrame:
    """Contiguous blocks of node ids: ``pieces`` blocks of equal (rounded up) size, or the given sizes,
    which must add up to the number of nodes."""
    n = points.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = points.join(F.broadcast(n), "mesh_id")
    if sizes is None:
        return rows.withColumn("part", F.floor(F.col("pid") / F.ceil(F.col("_n") / pieces)).cast("int")).drop("_n")
    demand(n, F.col("_n") != sum(sizes), "the sizes do not add up to the number of nodes")
    return rows.drop("_n").withColumn("part", owner("pid", sizes))


def owner(pid, sizes: list[int]) -> Column:
    """Index of the block that holds a node, from the block sizes."""
    pid = F.col(pid) if isinstance(pid, str) else pid
    ends = list(itertools.accumulate(sizes))
    return F.array_size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= pid)).cast("int")


def mirror(mesh: Mesh, directions: list[int], e1: float = 1e-6, e2: float = 1e-6, drop_periodic: bool = False) -> Mesh:
    """Append the mirror image at the outermost plane, per axis with direction 1 or -1.

    A point whose image is nearer than ``e1`` is its own image. A point within ``e2`` of the opposite
    plane and its image are periodic; images of periodic groups are groups, and groups that share a
    point are merged. Point and simplex ids of the copy follow those of the original.
    """
    from stepfield.operators.graph import merge_periodic

    for axis, direction in enumerate(directions):
        if direction == 0:
            continue
        if direction not in (1, -1):
            raise ValueError("directions are 0, 1 or -1")
        x = F.col("pos")[axis]
        ext = mesh.points.groupBy("mesh_id").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), (F.max("pid") + 1).alias("_np"))
        plane, other = ("_hi", "_lo") if direction == 1 else ("_lo", "_hi")
        rows = mesh.points.join(F.broadcast(ext), "mesh_id").withColumn("_m", 2 * F.col(plane) - x)
        rows = rows.withColumn("_weld", F.abs(x - F.col("_m")) < e1)
        free = dense_ids(rows.filter(~F.col("_weld")), ["mesh_id"], ["pid"], "_k")
        free = free.withColumn("new_pid", F.col("_np") + F.col("_k"))
        image = F.transform("pos", lambda v, i: F.when(i == axis, F.col("_m")).otherwise(v))
        mapping = rows.filter("_weld").select("mesh_id", "pid", F.col("pid").alias("new_pid")).unionByName(
            free.select("mesh_id", "pid", "new_pid"))
        points = mesh.points.select("mesh_id", "pid", "pos").unionByName(
            free.select("mesh_id", F.col("new_pid").alias("pid"), image.alias("pos")))
        ns = mesh.simplices.groupBy("mesh_id").agg((F.max("sid") + 1).alias("_ns"))
        copy = remap(mesh.simplices, mapping, ["mesh_id"], mesh.dim).join(F.broadcast(ns), "mesh_id").select(
            "mesh_id", (F.col("sid") + F.col("_ns")).alias("sid"), "region", "v")
        simplices = mesh.simplices.select("mesh_id", "sid", "region", "v").unionByName(copy)
        periodic = None
        if not drop_periodic:
            pairs = free.filter(F.abs(x - F.col(other)) < e2).select("mesh_id", F.col("pid").alias("src"), F.col("new_pid").alias("dst"))
            if mesh.periodic is not None:
                first = mesh.periodic.groupBy("mesh_id", "gid").agg(F.min("pid").alias("src"))
                links = lookup(mesh.periodic, first, ["mesh_id", "gid"]).select("mesh_id", "src", F.col("pid").alias("dst"))
                moved = lookup(links.withColumnRenamed("src", "pid"), mapping, ["mesh_id", "pid"]).select(
                    "mesh_id", F.col("new_pid").alias("src"), F.col("dst").alias("pid"))
                moved = lookup(moved, mapping, ["mesh_id", "pid"]).select("mesh_id", "src", F.col("new_pid").alias("dst"))
                pairs = pairs.unionByName(links).unionByName(moved)
            periodic = merge_periodic(pairs)
        mesh = Mesh(points, simplices, mesh.dim, periodic)
    return mesh
