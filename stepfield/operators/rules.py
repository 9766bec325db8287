"""Assignment by material, regions and properties (P-14 … P-16, J-23 … J-25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.plans.skewed import demand, lookup
from stepfield.session import cut_lineage


class RegionTest:
    """A predicate on the regions of a site: ``some(p)``, ``all(p)``, ``count(n)`` with & | ~."""

    def __init__(self, build, props=()):
        self.build, self.props = build, tuple(props)

    def __and__(self, o):
        return RegionTest(lambda c: self.build(c) & o.build(c), self.props + o.props)

    def __or__(self, o):
        return RegionTest(lambda c: self.build(c) | o.build(c), self.props + o.props)

    def __invert__(self):
        return RegionTest(lambda c: ~self.build(c), self.props)


def some(prop: str) -> RegionTest:
    return RegionTest(lambda c: c[prop] > 0, [prop])


def all_of(prop: str) -> RegionTest:
    return RegionTest(lambda c: c[prop] == c[None], [prop])


def count(n: int) -> RegionTest:
    return RegionTest(lambda c: c[None] == n)


def where_region(sites: DataFrame, region_props: DataFrame, test) -> DataFrame:
    """Sites (mesh_id, pid, regions) that pass; ``region_props`` is (mesh_id, region, prop). A bare
    property name means ``some``."""
    test = some(test) if isinstance(test, str) else test
    props = sorted(set(test.props))
    flags = region_props.groupBy("mesh_id", "region").agg(
        *[F.max((F.col("prop") == p).cast("int")).alias(f"_p{i}") for i, p in enumerate(props)] or [F.lit(0).alias("_none")])
    rows = sites.select("mesh_id", "pid", F.explode("regions").alias("region")).join(flags, ["mesh_id", "region"], "left")
    seen = rows.groupBy("mesh_id", "pid").agg(
        F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(f"_p{i}"), F.lit(0)).alias(f"_p{i}") for i in range(len(props))])
    counts = {p: F.col(f"_p{i}") for i, p in enumerate(props)}
    counts[None] = F.col("_n")
    return lookup(sites, seen.filter(test.build(counts)).select("mesh_id", "pid"), ["mesh_id", "pid"], "left_semi")


def rules_frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules (value, materials or None for everywhere) as rows ord, material, value."""
    rows = [(i, m, float(v)) for i, (v, where) in enumerate(rules)
            for m in ([None] if where is None else [where] if isinstance(where, str) else where)]
    return spark.createDataFrame(rows, "ord int, material string, value double")


def set_plan(rules: DataFrame, materials: DataFrame) -> DataFrame:
    """Value per material (column ``material``): the last rule naming it, else the last general rule.
    A material without a value and a rule without a material are errors."""
    named = rules.filter("material is not null").groupBy("material").agg(F.max_by("value", "ord").alias("_v"))
    general = rules.filter("material is null").agg(F.max_by("value", "ord")).scalar()
    known = cut_lineage(materials.select("material").distinct())  # a short list, read by all that follows
    demand(named.join(known, "material", "left_anti"), F.lit(True), "a rule names a material that is not used")
    plan = cut_lineage(known.join(named, "material", "left").select("material", F.coalesce("_v", general).alias("value")))
    demand(plan, "value is null", "a material has no value")
    return plan


def assign(df: DataFrame, rules: DataFrame, out: str = "value") -> DataFrame:
    """Add the value of the rules for each row's ``material``."""
    return df.join(set_plan(rules, df).withColumnRenamed("value", out), "material", "left")


def as_constant(rules: DataFrame, where: str | None = None) -> DataFrame:
    """The one value the rules give (for a material); several different ones are an error."""
    chosen = rules if where is None else rules.filter(F.col("material") == where)
    if where is not None and not chosen.limit(1).count():
        chosen = rules.filter("material is null").orderBy(F.col("ord").desc()).limit(1)
    out = chosen.agg(F.count_distinct("value").alias("_n"), F.first("value").alias("value"))
    demand(out, "_n > 1", "the value is not uniform")
    demand(out, "_n = 0", "the value is not set")
    return out.select("value")


def pending_states(axes: dict[str, DataFrame], default: dict[str, object], done: DataFrame) -> DataFrame:
    """Combinations of the axes, on top of the defaults, that are not in ``done``. The result is the
    full product by definition."""
    grid = reduce(lambda a, b: a.crossJoin(b), [df.select(F.col(df.columns[0]).alias(n)).distinct() for n, df in axes.items()])
    grid = grid.withColumns({n: F.lit(v) for n, v in default.items() if n not in axes}) if set(default) - set(axes) else grid
    on = [c for c in grid.columns if c in done.columns]
    return grid.join(done.select(*on).distinct(), on, "left_anti")


def regions_by_entity(region_props: DataFrame, regions: DataFrame) -> DataFrame:
    """Entities of each region present: (mesh_id, region, prop)."""
    return regions.select("mesh_id", "region").distinct().join(region_props, ["mesh_id", "region"])


def per_material(df: DataFrame, props: DataFrame, expression: Column, out: str, on=("region",)) -> DataFrame:
    """Evaluate one formula once per material: rows joined to the materials of their region, with the
    material's parameters as columns."""
    return df.join(props, list(on)).withColumn(out, expression)
