"""Probing fields in space and time (J-04, J-09, J-16 … J-19, W-06, A-23)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.functions import geometry as g
from stepfield.functions.sequences import Lattice
from stepfield.functions.vec import parts
from stepfield.operators import mesh as M
from stepfield.operators.snapshots import CLOCK, KEY, node
from stepfield.plans.ordered import Ordered
from stepfield.plans.skewed import lookup, matched, need
from stepfield.session import cut_lineage


# Time

def bracket(table: DataFrame, queries: DataFrame, by: list[str], x: str, payload: list[str], rows_per_task=None) -> DataFrame:
    """Add to each query the nearest table rows at or below (``lo``) and at or above (``hi``) its ``x``.

    One ordered scan over the union of both. Of table rows with equal ``x`` the one with the least payload counts for queries
    below them and the one with the greatest payload for those at or above; ``queries`` may hold any number of equal ``x``.
    """
    point = F.struct(F.col(x), *payload)
    extra = [c for c in queries.columns if c not in [*by, x]]
    kind = F.struct(*[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra]) if extra else F.struct(F.lit(None).alias("_"))
    t = table.select(*by, F.col(x).alias("_x"), F.lit(1).alias("_kind"), point.alias("_point"), kind.alias("_query"),
                     F.lit(0).cast("bigint").alias("_tie"))
    packed = F.struct(*extra) if extra else F.struct(F.lit(None).alias("_"))
    tie = F.xxhash64(*queries.columns)
    q = queries.select(*by, F.col(x).alias("_x"), F.lit(2).alias("_kind"), F.lit(None).cast(t.schema["_point"].dataType).alias("_point"),
                       packed.cast(t.schema["_query"].dataType).alias("_query"), tie.alias("_tie"))
    scan = Ordered(t.unionByName(q), by, ["_x", "_kind", "_tie", "_point"], rows_per_task)
    scan.running(lo=("last", F.col("_point"))).running(backwards=True, hi=("last", F.col("_point")))
    hi = F.when(F.col("lo")[x] == F.col("_x"), F.col("lo")).otherwise(F.col("hi"))
    return scan.df.filter("_kind = 2").select(*by, F.col("_x").alias(x), *[F.col("_query")[c].alias(c) for c in extra], "lo", hi.alias("hi"))


def blend(x, lo, hi, tolerance: float = 0.0):
    """Weights of the two neighbours; clamped at the ends, 1 on a hit."""
    x, lo, hi = F.col(x), F.col(lo), F.col(hi)
    on_lo, on_hi = F.abs(x - lo) <= tolerance, F.abs(hi - x) <= tolerance
    w_lo = (F.when(lo.isNull(), F.lit(None)).when(hi.isNull() | on_lo, F.lit(1.0)).when(on_hi, F.lit(0.0))
            .otherwise((hi - x) / (hi - lo)))
    w_hi = (F.when(hi.isNull(), F.lit(None)).when(lo.isNull(), F.lit(1.0)).when(on_lo, F.lit(0.0)).when(on_hi, F.lit(1.0))
            .otherwise((x - lo) / (hi - lo)))
    return w_lo, w_hi


def save_weights(snap: DataFrame, times: DataFrame, tolerance: float = 1e-19, rows_per_task=None) -> DataFrame:
    """Saves and weights that make up each wanted time (run_id, t): KEY, t, weight."""
    per = ["run_id", "mesh_id", "field", "subfield"]
    table = snap.groupBy(*per, F.col("time").alias("t")).agg(F.min("id").alias("id"))
    asked = table.select(*per).distinct().join(times.distinct(), "run_id").select(*per, "t")
    found = bracket(table, asked, per, "t", ["id"], rows_per_task)
    found = found.select(*per, "t", F.col("lo.t").alias("_tl"), F.col("lo.id").alias("_il"), F.col("hi.t").alias("_th"), F.col("hi.id").alias("_ih"))
    w_lo, w_hi = blend("t", "_tl", "_th", tolerance)
    two = F.explode(F.array(F.struct(F.col("_il").alias("id"), w_lo.alias("weight")), F.struct(F.col("_ih").alias("id"), w_hi.alias("weight"))))
    return found.select(*per, "t", two.alias("p")).select(*per, "p.id", "t", "p.weight").filter("weight > 0")


def asof_interp(snap: DataFrame, times: DataFrame, width: int, tolerance: float = 1e-19, rows_per_task=None) -> DataFrame:
    """Fields at the wanted times (run_id, t): a saved one when it matches, else the linear blend of
    its two neighbours in time, else the nearest end."""
    w = save_weights(snap, times, tolerance, rows_per_task)
    sums = snap.join(w, KEY).groupBy("run_id", "mesh_id", "field", "subfield", "t", "site").agg(
        *[F.sum(F.col("weight") * v).alias(f"_{i}") for i, v in enumerate(parts("value", width))])
    return sums.select("run_id", "mesh_id", "field", "subfield", "t", "site",
                       F.array(*[f"_{i}" for i in range(width)]).alias("value"))


def interp1(df: DataFrame, table: DataFrame, by: list[str], x: str, y: str, out: str, rows_per_task=None) -> DataFrame:
    """Piecewise-linear lookup of ``x`` in table (by, x, y), constant beyond the ends."""
    found = bracket(table, df, by, x, [y], rows_per_task)
    found = found.withColumns({"_xl": F.col("lo")[x], "_xh": F.col("hi")[x]})
    w_lo, w_hi = blend(x, "_xl", "_xh")
    value = (F.when(F.col("lo").isNull(), F.col("hi")[y]).when(F.col("hi").isNull(), F.col("lo")[y])
             .otherwise(w_lo * F.col("lo")[y] + w_hi * F.col("hi")[y]))
    return found.withColumn(out, value).drop("lo", "hi", "_xl", "_xh")


# Space

def _level(extent):
    """Power of two of the cell size for a simplex of this extent."""
    return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)))), F.lit(-990)).cast("int")


def _cell(x, level):
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("bigint")


def locate(probes: DataFrame, mesh: M.Mesh, slack: float = 1e-12) -> DataFrame:
    """The simplex that holds each probe (mesh_id, probe, pos) with barycentric weights; a probe
    outside has no row, one on a common face gets the simplex with the lowest id.

    Each simplex is entered into the at most 2^dim cells it touches on a grid whose cells are as
    large as itself; a probe looks into one cell per grid in use. Simplices of a mesh do not overlap,
    so a cell holds few of its own size whatever the grading of the mesh.
    """
    d = mesh.dim
    v = M.vertices(d)
    axes = range(d)
    rows = g.inverse([g.sub(p, v[0]) for p in v[1:]])
    sizes = {f"lo{a}": F.least(*[p[a] for p in v]) for a in axes} | {f"hi{a}": F.greatest(*[p[a] for p in v]) for a in axes}
    linear = {f"g{k}{a}": rows[a][k] for k in axes for a in axes}
    shapes = M.located(mesh).select("mesh_id", "sid", "region", *[f"v{k}" for k in range(d + 1)], *[F.col(f"x0{a}").alias(f"o{a}") for a in axes],
                                    *[c.alias(n) for n, c in {**sizes, **linear}.items()])
    extents = [F.col(f"hi{a}") - F.col(f"lo{a}") for a in axes]
    shapes = shapes.withColumn("_e", F.greatest(*extents) if d > 1 else extents[0]).withColumn("_pad", F.col("_e") * slack)
    shapes = shapes.withColumn("_lv", _level(F.col("_e") + 2 * F.col("_pad"))).drop("_e")
    shapes = shapes.withColumns({f"lo{a}": F.col(f"lo{a}") - F.col("_pad") for a in axes} | {f"hi{a}": F.col(f"hi{a}") + F.col("_pad") for a in axes}).drop("_pad")
    # Stored once: both the list of grids in use and the cells are made from it.
    shapes = cut_lineage(shapes)
    levels = shapes.select("mesh_id", "_lv").distinct()
    for a in axes:
        shapes = shapes.withColumn(f"_c{a}", F.explode(F.sequence(_cell(F.col(f"lo{a}"), F.col("_lv")), _cell(F.col(f"hi{a}"), F.col("_lv")))))
    asked = probes.select("mesh_id", "probe", *[p.alias(f"p{a}") for a, p in enumerate(parts("pos", d))]).join(F.broadcast(levels), "mesh_id")
    asked = asked.withColumns({f"_c{a}": _cell(F.col(f"p{a}"), F.col("_lv")) for a in axes})
    pairs = lookup(asked, shapes, ["mesh_id", "_lv", *[f"_c{a}" for a in axes]])
    pairs = pairs.filter(reduce(lambda x, y: x & y, [F.col(f"p{a}").between(F.col(f"lo{a}"), F.col(f"hi{a}")) for a in axes]))
    # Weights are linear in the position: one row of the inverse edge matrix per vertex but the first.
    pairs = pairs.withColumns({f"w{k + 1}": reduce(lambda x, y: x + y, [F.col(f"g{k}{a}") * (F.col(f"p{a}") - F.col(f"o{a}")) for a in axes]) for k in axes})
    pairs = pairs.withColumn("w0", 1.0 - reduce(lambda x, y: x + y, [F.col(f"w{k + 1}") for k in axes]))
    inside = pairs.filter(reduce(lambda x, y: x & y, [F.col(f"w{k}") >= -slack for k in range(d + 1)]))
    return inside.groupBy("mesh_id", "probe").agg(
        F.min("sid").alias("sid"),
        *[F.min_by("region", "sid").alias("region")],
        *[F.min_by(f"v{k}", "sid").alias(f"v{k}") for k in range(d + 1)],
        *[F.min_by(f"w{k}", "sid").alias(f"w{k}") for k in range(d + 1)])


def probe_matrix(probes: DataFrame, mesh: M.Mesh) -> DataFrame:
    """Sparse matrix rows (mesh_id, probe, pid, weight); store it to probe many times or fields."""
    d = mesh.dim
    entries = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("pid"), F.col(f"w{k}").alias("weight")) for k in range(d + 1)]))
    return locate(probes, mesh).select("mesh_id", "probe", entries.alias("e")).select("mesh_id", "probe", "e.*")


def apply_matrix(matrix: DataFrame, snap: DataFrame, width: int, entries: int | None = None) -> DataFrame:
    """Probe every save: sum of weight times value per probe. A probe in a simplex with a vertex
    where the subfield is undefined gives no row.

    ``entries`` is the number of rows that each probe has in the matrix (dim + 1 for ``probe_matrix``); they are counted if it isn't given.
    """
    rows = node(snap).select(*KEY, *CLOCK, "pid", *[v.alias(f"_{i}") for i, v in enumerate(parts("value", width))])
    sums = lookup(rows, matrix, ["mesh_id", "pid"]).groupBy(*KEY, *CLOCK, "probe").agg(
        F.count(F.lit(1)).alias("_got"), *[F.sum(F.col("weight") * F.col(f"_{i}")).alias(f"_{i}") for i in range(width)])
    if entries is None:
        sums = lookup(sums, matrix.groupBy("mesh_id", "probe").agg(F.count(F.lit(1)).alias("_need")), ["mesh_id", "probe"]).filter("_got = _need")
    else:
        sums = sums.filter(F.col("_got") == entries)
    return sums.select(*KEY, *CLOCK, "probe", F.array(*[f"_{i}" for i in range(width)]).alias("value"))


def probe(snap: DataFrame, mesh: M.Mesh, probes: DataFrame, width: int, vec=None) -> DataFrame:
    """Field values at positions for every save; NULL outside. ``vec`` maps the value column to another."""
    found = apply_matrix(probe_matrix(probes, mesh), snap, width, mesh.dim + 1)
    each = snap.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in CLOCK])
    grid = probes.join(F.broadcast(each), "mesh_id")
    out = lookup(grid, found.drop(*CLOCK), [*KEY, "probe"], "left")
    return out.withColumn("value", vec(F.col("value"))) if vec else out


def grid_interp(points: DataFrame, grid: DataFrame, spec: Lattice, width: int, once: bool = False) -> DataFrame:
    """Multilinear interpolation of a regular grid (grid_id, ix.., v) at points (grid_id, point, pos),
    clamped to the grid. Rows of one point are added up; with ``once`` those of one position count once.

    A point meets its cell, which has the values of all its nodes, so it is one row and not one for each node.
    """
    d = len(spec.axes)
    on, base = ["i" + n for n in spec.names], [f"_c{a}" for a in range(d)]
    rows = points.select("grid_id", "point", *[p.alias(f"_p{a}") for a, p in enumerate(parts("pos", d))])
    rel = []
    for a, (low, high, n) in enumerate(spec.axes):
        step = (high - low) / (n - 1) if n > 1 else 1.0
        rel.append(F.least(F.greatest((F.col(f"_p{a}") - low) / step, F.lit(0.0)), F.lit(float(n - 1))))
    rows = rows.withColumns({c: F.floor(x).cast("bigint") for c, x in zip(base, rel)})
    ends = list(itertools.product((0, 1), repeat=d))
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(c) - o).cast("bigint").alias(b) for c, b, o in zip(on, base, end)]) for k, end in enumerate(ends)]))
    nodes = grid.select("grid_id", *[v.alias(f"_v{i}") for i, v in enumerate(parts("v", width))], *on).select("grid_id", *[f"_v{i}" for i in range(width)], of.alias("_of"))
    nodes = nodes.select("grid_id", "_of.*", *[f"_v{i}" for i in range(width)]).filter(reduce(lambda x, y: x & y, [F.col(c) >= 0 for c in base]))
    cells = nodes.groupBy("grid_id", *base).agg(
        *[F.count(F.when(F.col("k") == k, 1)).alias(f"_n{k}") for k in range(len(ends))],
        *[F.sum(F.when(F.col("k") == k, F.col(f"_v{i}"))).alias(f"_{k}_{i}") for k in range(len(ends)) for i in range(width)])
    met = lookup(rows, cells, ["grid_id", *base], "left")
    sums = [[] for _ in range(width)]
    for k, end in enumerate(ends):
        w = [x - F.col(c) if o else 1.0 - (x - F.col(c)) for x, c, o in zip(rel, base, end)]
        used, weight = reduce(lambda x, y: x & y, [x > 0 for x in w]), reduce(lambda x, y: x * y, w)
        for i in range(width):
            v = need(F.col(f"_{k}_{i}"), "a grid node is missing", "double", F.col(f"_n{k}") > 0)
            sums[i].append(F.when(used, weight * v))
    values = [F.when(F.coalesce(*t).isNotNull(), reduce(lambda x, y: x + y, [F.coalesce(x, F.lit(0.0)) for x in t])).alias(f"_{i}") for i, t in enumerate(sums)]
    # Rows of a point are dealt out once: both sums below are within such a share.
    share = F.pmod(F.hash("grid_id", "point"), F.lit(1 << 20)).alias("_share")
    found = met.select(share, "grid_id", "point", *[f"_p{a}" for a in range(d)], *values).repartition("_share")
    if once:
        found = found.dropDuplicates(["_share", "grid_id", "point", *[f"_p{a}" for a in range(d)]])
    out = found.groupBy("_share", "grid_id", "point").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(width)])
    return out.select("grid_id", "point", F.array(*[f"_{i}" for i in range(width)]).alias("value"))


def snap_to_lattice(df: DataFrame, spec: Lattice, order: list[str], value: str = "value", keys=()) -> DataFrame:
    """Store each row at its nearest lattice index; of several rows the last in ``order`` stays."""
    index = {"i" + n: spec.nearest(a, F.col("pos")[a]) for a, n in enumerate(spec.names)}
    return df.withColumns(index).groupBy(*keys, *index).agg(F.max_by(value, F.struct(*order)).alias(value))


def grid_range(grid: DataFrame, value: str = "v") -> DataFrame:
    """Smallest and largest component over a grid."""
    return grid.select("grid_id", F.array_min(value).alias("a"), F.array_max(value).alias("b")).groupBy("grid_id").agg(
        F.min("a").alias("low"), F.max("b").alias("high"))
