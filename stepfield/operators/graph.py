"""Components of graphs (A-17, A-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.plans.skewed import lookup
from stepfield.session import cut_lineage


def components(edges: DataFrame, keys: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Label every node with the smallest node of its component: keys, node, component.

    Alternates two steps: link each node's larger neighbours to the smallest one, then link each
    node's smaller neighbours and itself to the smallest one. Both are a minimum per node, combined
    before the shuffle, and a lookup, so a node with very many edges is never gathered; the number
    of rounds grows with the logarithm of the graph. Nodes with only a self-loop stay.

    First each node is taken for its smallest neighbour, if that is smaller; the steps work on the edges between
    these, which are few where most nodes hang on a smaller one. The smallest node of a component stands for itself.
    """
    keys = list(keys or [])
    e = edges.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v"))
    every = e.select(*keys, F.col("u").alias("node")).unionByName(e.select(*keys, F.col("v").alias("node")))
    if nodes is not None:
        every = every.unionByName(nodes.select(*keys, "node"))
    every = cut_lineage(every.distinct())
    e = e.filter("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut_lineage(e.repartition(*keys, "u").distinct())
    near = cut_lineage(e.groupBy(*keys, "u").agg(F.min("v").alias("m")))
    e = lookup(e, near, [*keys, "u"]).select(*keys, F.col("m").alias("a"), "v")
    e = lookup(e, near.select(*keys, F.col("u").alias("v"), F.col("m").alias("b")), [*keys, "v"], "left").withColumn("b", F.coalesce("b", "v"))
    e = cut_lineage(e.filter("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _fingerprint(e)
    while True:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = lookup(both, low, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = lookup(large, low, [*keys, "u"])
        small = (small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(*keys, "u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = cut_lineage(small)
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    roots = e.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    every = lookup(every, near.withColumnRenamed("u", "node"), [*keys, "node"], "left").withColumn("m", F.coalesce("m", "node"))
    return lookup(every, roots.withColumnRenamed("node", "m"), [*keys, "m"], "left").select(
        *keys, "node", F.coalesce("component", "m").alias("component"))


def _fingerprint(e: DataFrame):
    cols = [F.xxhash64(*e.columns).cast("decimal(38,0)")]
    return tuple(e.agg(F.count(F.lit(1)), F.sum(cols[0])).first())


def reduce_components(edges: DataFrame, labels: DataFrame, aggregates: list, keys: list[str] | None = None) -> DataFrame:
    """Aggregate edge data per component."""
    keys = list(keys or [])
    tagged = lookup(edges.withColumn("node", F.col("src")), labels, [*keys, "node"])
    return tagged.groupBy(*keys, "component").agg(*aggregates)


def merge_periodic(pairs: DataFrame) -> DataFrame:
    """Groups of equivalent points (mesh_id, gid, pid) from pairs (mesh_id, src, dst), with closure;
    the group is named by its smallest point."""
    found = components(pairs, ["mesh_id"])
    sizes = found.groupBy("mesh_id", "component").count().filter("count > 1").drop("count")
    return lookup(found, sizes, ["mesh_id", "component"]).select("mesh_id", F.col("component").alias("gid"), F.col("node").alias("pid"))


def components_per_region(mesh, regions=None) -> DataFrame:
    """Connected parts of each region of a mesh, through shared edges of its simplices."""
    from stepfield.operators.mesh import _subsets
    rows = mesh.simplices if regions is None else mesh.simplices.filter(F.col("region").isin(*regions))
    e = rows.select("mesh_id", "region", F.explode(_subsets(F.col("v"), mesh.dim, 2)).alias("e")).select(
        "mesh_id", "region", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")).distinct()
    return components(e, ["mesh_id", "region"])
