"""Sites of any order on the simplices of a mesh: weighted nodes, positions and probe weights (J-01, J-16).

A site is a sorted array of (pid, weight) with whole weights that add up to the order: a corner has one node, a site
on an edge two. Simplices that share an edge or face so share its sites.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.operators import mesh as M
from stepfield.operators import probe as P
from stepfield.plans.skewed import lookup, matched, need


def _site(ids: list[Column], weights: tuple[int, ...]) -> Column:
    return F.array_sort(F.array(*[F.struct(ids[k].alias("pid"), F.lit(w).alias("weight")) for k, w in enumerate(weights) if w]))


def order_sites(mesh: M.Mesh, order: int) -> DataFrame:
    """The distinct sites of the given order: mesh_id, site."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    ids = [F.col("v")[k] for k in range(mesh.dim + 1)]
    sites = F.array(*[_site(ids, w) for w in M.lattice(order, mesh.dim)])
    return mesh.simplices.select("mesh_id", F.explode(sites).alias("site")).distinct()


def weighted_positions(sites: DataFrame, points: DataFrame, dim: int = 3, factor: float = 1.0) -> DataFrame:
    """Position of each distinct site (mesh_id, site): the mean of its nodes by their weights.

    A node without a point, or weights that add up to 0, stop the job; an empty site has no row.
    """
    rows = sites.select("mesh_id", "site").distinct().withColumn("n", F.explode("site")).select("mesh_id", "site", "n.pid", "n.weight")
    found = matched(rows, M.xyz(points, dim), ["mesh_id", "pid"], "a site with an unknown node").groupBy("mesh_id", "site").agg(
        F.sum("weight").alias("_all"), *[F.sum(F.col("weight") * F.col(f"x{a}")).alias(f"x{a}") for a in range(dim)])
    total = need(F.col("_all"), "a site whose weights add up to 0", dict(found.dtypes)["_all"], F.col("_all") != 0)
    return found.select("mesh_id", "site", F.array(*[F.col(f"x{a}") / total * factor for a in range(dim)]).alias("pos"))


def shape(corner: list[Column], weights: tuple[int, ...]) -> Column:
    """Lagrange shape function of a site from barycentric weights: 1 at the site, 0 at all others of its order."""
    n = sum(weights)
    factors = [(n * corner[k] - i) / float(i + 1) for k, w in enumerate(weights) for i in range(w)]
    return reduce(lambda x, y: x * y, factors)


def shape_matrix(probes: DataFrame, mesh: M.Mesh, order: int) -> DataFrame:
    """Rows (mesh_id, probe, site, weight): a field given at sites of this order has at a probe the sum of weight times
    value. Polynomials up to the order are met exactly; a probe outside has no row."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    d = mesh.dim
    ids, corner = [F.col(f"v{k}") for k in range(d + 1)], [F.col(f"w{k}") for k in range(d + 1)]
    entries = F.array(*[F.struct(_site(ids, w).alias("site"), shape(corner, w).alias("weight")) for w in M.lattice(order, d)])
    return P.locate(probes, mesh).select("mesh_id", "probe", F.explode(entries).alias("e")).select("mesh_id", "probe", "e.*")


def apply_shapes(matrix: DataFrame, values: DataFrame, order: int, dim: int) -> DataFrame:
    """mesh_id, probe, value of a field on sites (mesh_id, site, value); a probe that meets a site without a value has no row."""
    whole = len(M.lattice(order, dim))
    sums = lookup(matrix, values.filter("value is not null"), ["mesh_id", "site"]).groupBy("mesh_id", "probe").agg(
        F.count(F.lit(1)).alias("_got"), F.sum(F.col("weight") * F.col("value")).alias("value"))
    return sums.filter(F.col("_got") == whole).select("mesh_id", "probe", "value")
