"""Field snapshots in long form (P-05 … P-10, P-17 … P-21, P-28, J-01 … J-03, J-10 … J-15, J-26,
A-02 … A-04, A-06 … A-08, A-16, A-27, A-28, U-01 … U-03, U-06).

``snapshots(run_id, mesh_id, field, subfield, id, step, stage, time, site, value)``: one row per saved
site; ``site`` lists node ids (one for first order), ``value`` the components. ``width`` is the number
of components, so that sums stay in generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.functions import geometry as g
from stepfield.functions.vec import parts, unit
from stepfield.operators import mesh as M
from stepfield.plans.ordered import dense_ids
from stepfield.plans.skewed import demand, lookup, matched, need

SAVE = ["run_id", "mesh_id", "field", "id"]
KEY = ["run_id", "mesh_id", "field", "subfield", "id"]
CLOCK = ["step", "stage", "time"]


def node(snap: DataFrame) -> DataFrame:
    """First-order snapshots with the node id as ``pid``; a site of several nodes is an error."""
    return snap.withColumn("pid", need(F.col("site")[0], "only first-order fields have one value per point", "bigint", F.size("site") == 1))


def _summed(width: int, weight: Column | float = 1.0, value="value") -> Column:
    return F.array(*[F.sum(weight * v) for v in parts(value, width)])


# Selection and catalog

def select_fields(snap: DataFrame, spec: str, width: int, catalog: DataFrame | None = None) -> DataFrame:
    """Rows of the listed fields, and for ``+name`` the sum over the subfields as ``name_total``."""
    names = [s.strip(" \"'[]()") for s in spec.split(",")]
    plain = [n for n in names if not n.startswith("+")]
    plus = [n.lstrip("+") for n in names if n.startswith("+")]
    out = snap.filter(F.col("field").isin(*plain)) if plain else snap.limit(0)
    return out.unionByName(total(snap, plus, width, catalog)) if plus else out


def total(snap: DataFrame, fields: list[str], width: int, catalog: DataFrame | None = None) -> DataFrame:
    """Sum of the subfields of each field at each site; with a catalog their units must agree."""
    chosen = snap.filter(F.col("field").isin(*fields))
    if catalog is not None:
        units = catalog.filter(F.col("field").isin(*fields)).groupBy("run_id", "field").agg(
            F.count_distinct("unit").alias("n"))
        demand(units, "n > 1", "the subfields of a field have different units")
    keys = ["run_id", "mesh_id", "id", *CLOCK, "site", F.concat("field", F.lit("_total")).alias("field")]
    return chosen.groupBy(*keys).agg(_summed(width).alias("value")).withColumn("subfield", F.col("field")).select(snap.columns)


def select_ids(df: DataFrame, spec) -> DataFrame:
    """Rows of the ids in an int, list or range; -1 stands for the highest id."""
    if isinstance(spec, range):
        low, high = (min(spec), max(spec)) if len(spec) else (1, 0)
        listed = F.col("id").between(max(low, 0), high) & ((F.col("id") - spec.start) % spec.step == 0)
    else:
        spec = [spec] if isinstance(spec, int) else list(spec)
        listed = F.col("id").isin(*[i for i in spec if i != -1])
    if -1 not in spec:
        return df.filter(listed)
    return df.filter(listed | (F.col("id") == df.agg(F.max("id")).scalar()))


def ids_by_field(snap: DataFrame) -> DataFrame:
    """Distinct (run_id, field, id) rows; a field may have any number of ids."""
    return snap.select("run_id", "field", "id").distinct()


def fields_by_id(snap: DataFrame) -> DataFrame:
    """Sorted field names of each id (a short list)."""
    return ids_by_field(snap).groupBy("run_id", "id").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def all_ids(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.select("run_id", "id").distinct() for t in tables]).distinct()


def common(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b.select(*a.columns)), tables)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b.select(*a.columns))


def merge_requests(plain: DataFrame, summed: DataFrame) -> DataFrame:
    """(run_id, id, field) needed for both kinds of request, each once."""
    cols = ["run_id", "id", "field"]
    return plain.select(*cols).unionByName(summed.select(*cols)).distinct()


def field_of(catalog: DataFrame, subfield: str) -> DataFrame:
    found = catalog.filter(F.col("subfield") == subfield).select("run_id", "field", "subfield").distinct()
    if not found.limit(1).count():
        raise ValueError(f"unknown subfield {subfield!r}")
    return found


def saves(snap: DataFrame) -> DataFrame:
    """One row per save of a subfield, with its row number in save order."""
    found = snap.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in CLOCK])
    return dense_ids(found, ["run_id", "mesh_id", "field", "subfield"], ["id"], "row")


def convert(snap: DataFrame, catalog: DataFrame, factors: DataFrame, width: int, divide: bool = False) -> DataFrame:
    """Multiply (or divide) the values of a field by the factor of its unit: catalog (run_id, field,
    subfield, unit) ⋈ factors (unit, factor)."""
    known = matched(catalog, factors.select("unit", "factor"), ["unit"], "a unit without a factor", few=True)
    table = known.select("run_id", "field", "subfield", "factor")
    op = (lambda v: v / F.col("factor")) if divide else (lambda v: v * F.col("factor"))
    return matched(snap, table, ["run_id", "field", "subfield"], "a field that the catalog does not know", few=True).withColumn(
        "value", F.array(*[op(v) for v in parts("value", width)])).select(snap.columns)


def rescale_pos(df: DataFrame, mesh_unit: float, factor: float, dim: int = 3) -> DataFrame:
    """Positions in units of ``factor``: pos · mesh unit / factor."""
    if factor == 0:
        raise ValueError("the position factor must not be 0")
    k = mesh_unit / factor
    return df.withColumn("pos", F.array(*[p * k for p in parts("pos", dim)]))


# Positions and site order

def site_positions(sites: DataFrame, points: DataFrame, dim: int = 3, factor: float = 1.0) -> DataFrame:
    """Mean position of the nodes of each distinct site (mesh_id, site)."""
    rows = sites.select("mesh_id", "site").distinct().withColumn("pid", F.explode("site"))
    found = matched(rows, M.xyz(points, dim), ["mesh_id", "pid"], "a site with an unknown node").groupBy("mesh_id", "site").agg(
        *[(F.avg(f"x{a}") * factor).alias(f"x{a}") for a in range(dim)])
    return found.select("mesh_id", "site", F.array(*[f"x{a}" for a in range(dim)]).alias("pos"))


def to_point_order(snap: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """A value for every point of the mesh in each save, zeros where the subfield is undefined."""
    each = snap.select(*KEY).distinct()
    grid = points.select("mesh_id", "pid").join(F.broadcast(each), "mesh_id")
    have = node(snap).select(*KEY, "pid", "value")
    zeros = F.array(*[F.lit(0.0)] * width)
    return lookup(grid, have, [*KEY, "pid"], "left").withColumn("value", F.coalesce("value", zeros))


def realign(snap: DataFrame, perm_saved: DataFrame, perm_now: DataFrame) -> DataFrame:
    """Rename saved nodes to the node order in use, through the original ids of two permutations
    (mesh_id, new_pid, orig_pid) of equal length."""
    counts = perm_saved.groupBy("mesh_id").count().join(
        perm_now.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("now")), "mesh_id", "full")
    demand(counts, "not (count <=> now)", "the permutations differ in length")
    a = perm_saved.select("mesh_id", F.col("new_pid").alias("pid"), "orig_pid")
    b = perm_now.select("mesh_id", F.col("new_pid").alias("now_pid"), "orig_pid")
    table = lookup(a, b, ["mesh_id", "orig_pid"]).select("mesh_id", "pid", "now_pid")
    found = matched(node(snap), table, ["mesh_id", "pid"], "a site that the permutations do not have")
    return found.withColumn("site", F.array("now_pid")).select(snap.columns)


# Combining snapshots

def combine(snap: DataFrame, terms: list[tuple[float, int]], width: int) -> DataFrame:
    """Sum of coefficient times snapshot row, per site. Rows count the saves from 0."""
    table = F.create_map(*[x for c, r in terms for x in (F.lit(r).cast("bigint"), F.lit(float(c)))])
    rows = saves(snap).withColumn("_c", table[F.col("row")]).filter("_c is not null").select(*KEY, "_c")
    return snap.join(F.broadcast(rows), KEY).groupBy("run_id", "mesh_id", "field", "subfield", "site").agg(
        _summed(width, F.col("_c")).alias("value"))


def variation(snap: DataFrame, t0: float, width: int) -> DataFrame:
    """Difference of every save from the (interpolated) field at ``t0``."""
    from stepfield.operators.probe import asof_interp
    times = snap.select("run_id").distinct().withColumn("t", F.lit(float(t0)))
    ref = asof_interp(snap, times, width).select(
        "run_id", "mesh_id", "field", "subfield", "site", F.col("value").alias("_ref"))
    diff = F.array(*[v - r for v, r in zip(parts("value", width), parts("_ref", width))])
    return lookup(snap, ref, ["run_id", "mesh_id", "field", "subfield", "site"]).withColumn("value", diff).select(snap.columns)


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    both = lookup(a.select(*KEY, "site", F.col("value").alias("_a")), b.select(*KEY, "site", F.col("value").alias("_b")), [*KEY, "site"], "full")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.withColumns({c: need(F.col(c), "the two fields have different sites", "array<double>", paired) for c in ("_a", "_b")})


def diff_norm(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Largest and root-sum-square length of the difference, per save of a subfield."""
    diff = F.array(*[x - y for x, y in zip(parts("_a", width), parts("_b", width))])
    return norms(_paired(a, b).withColumn("value", diff), width)


def inner(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    products = [x * y for x, y in zip(parts("_a", width), parts("_b", width))]
    return _paired(a, b).groupBy(*KEY).agg(F.sum(reduce(lambda x, y: x + y, products)).alias("product"))


def axpby(a: float, x: DataFrame, b: float, y: DataFrame, width: int) -> DataFrame:
    value = F.array(*[a * p + b * q for p, q in zip(parts("_a", width), parts("_b", width))])
    return _paired(x, y).select(*KEY, "site", value.alias("value"))


def scale(snap: DataFrame, k: float, width: int) -> DataFrame:
    """Multiply all values; 0 gives the zero field."""
    return snap.withColumn("value", F.array(*[v * float(k) for v in parts("value", width)]))


def push(restricted: DataFrame, full: DataFrame) -> DataFrame:
    """Write the values of a restricted field into the full one."""
    new = restricted.select(*KEY, "site", F.col("value").alias("_new"))
    return lookup(full, new, [*KEY, "site"], "left").withColumn("value", F.coalesce("_new", "value")).select(full.columns)


def pull(full: DataFrame, restricted: DataFrame) -> DataFrame:
    """The values of a full field at the sites of a restricted one."""
    return lookup(full, restricted.select(*KEY, "site"), [*KEY, "site"], "left_semi")


# Integrals and norms

def subfield_volumes(mesh: M.Mesh, where: DataFrame) -> DataFrame:
    """Volume share of each node inside the regions of each subfield (mesh_id, subfield, region)."""
    d = mesh.dim
    rows = M.volumes(mesh).select("mesh_id", "region", F.explode(F.array(*[f"v{k}" for k in range(d + 1)])).alias("pid"),
                                  (F.col("volume") / float(d + 1)).alias("volume"))
    per = rows.groupBy("mesh_id", "region", "pid").agg(F.sum("volume").alias("volume"))
    return per.join(F.broadcast(where), ["mesh_id", "region"]).groupBy("mesh_id", "subfield", "pid").agg(F.sum("volume").alias("volume"))


def integrate(snap: DataFrame, vols: DataFrame, width: int, periodic: DataFrame | None = None) -> DataFrame:
    """Sum of value times volume per component (KEY, comp, integral). ``vols`` has mesh_id, pid, volume
    and may have a subfield. Where the volume of a periodic group is on each image, only the
    leading image counts."""
    rows = node(snap)
    if periodic is not None:
        lead = periodic.groupBy("mesh_id", "gid").agg(F.min("pid").alias("_lead"))
        followers = lookup(periodic, lead, ["mesh_id", "gid"]).filter("pid <> _lead").select("mesh_id", "pid")
        rows = lookup(rows, followers, ["mesh_id", "pid"], "left_anti")
    on = ["mesh_id", "pid"] + (["subfield"] if "subfield" in vols.columns else [])
    sums = lookup(rows, vols, on).groupBy(*KEY, *CLOCK).agg(
        *[F.sum(v * F.col("volume")).alias(f"_{i}") for i, v in enumerate(parts("value", width))])
    return sums.select(*KEY, *CLOCK, F.posexplode(F.array(*[f"_{i}" for i in range(width)])).alias("comp", "integral"))


def average(snap: DataFrame, mesh: M.Mesh, where: DataFrame, width: int) -> DataFrame:
    """Integral over the volume of the subfield's regions."""
    size = (M.region_volumes(mesh).join(F.broadcast(where), ["mesh_id", "region"])
            .groupBy("mesh_id", "subfield").agg(F.sum("volume").alias("_v")))
    return integrate(snap, subfield_volumes(mesh, where), width).join(size, ["mesh_id", "subfield"]).select(
        *KEY, *CLOCK, "comp", (F.col("integral") / F.nullif("_v", F.lit(0.0))).alias("average"))


def max_angle(snap: DataFrame, mesh: M.Mesh, where: DataFrame, width: int = 3) -> DataFrame:
    """Largest angle (degrees) between the vectors at two nodes of one simplex; zero vectors are skipped."""
    pair = F.explode(M._subsets(F.col("v"), mesh.dim, 2)).alias("e")
    links = mesh.simplices.select("mesh_id", "region", pair).join(F.broadcast(where), ["mesh_id", "region"]).select(
        "mesh_id", "subfield", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")).distinct()
    rows = node(snap).select(*KEY, "pid", *[v.alias(f"c{i}") for i, v in enumerate(parts("value", width))])
    a = rows.select(*KEY, F.col("pid").alias("src"), *[F.col(f"c{i}").alias(f"a{i}") for i in range(width)])
    b = rows.select(*KEY, F.col("pid").alias("dst"), *[F.col(f"c{i}").alias(f"b{i}") for i in range(width)])
    both = lookup(lookup(a, links, ["mesh_id", "subfield", "src"]), b, [*KEY, "dst"])
    turn = g.angle([F.col(f"a{i}") for i in range(width)], [F.col(f"b{i}") for i in range(width)])
    return both.groupBy(*KEY).agg(F.degrees(F.max(turn)).alias("max_angle"))


def averages(snap: DataFrame, mesh: M.Mesh, where: DataFrame, width: int = 3, names: list[str] | None = None) -> DataFrame:
    """One wide row per save: counters, ``<subfield>_<component>`` averages and ``maxangle_<subfield>``."""
    mean = average(snap, mesh, where, width).select(
        "run_id", "id", *CLOCK, F.concat_ws("_", "subfield", "comp").alias("name"), F.col("average").alias("v"))
    clock = snap.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in CLOCK])
    turn = max_angle(snap, mesh, where, width).join(clock, KEY).select(
        "run_id", "id", *CLOCK, F.concat(F.lit("maxangle_"), F.col("subfield")).alias("name"), F.col("max_angle").alias("v"))
    return mean.unionByName(turn).groupBy("run_id", "id", *CLOCK).pivot("name", names).agg(F.first("v", ignorenulls=True))


def norms(snap: DataFrame, width: int) -> DataFrame:
    """Largest length over the sites and root of the sum of squares, per save of a subfield."""
    square = reduce(lambda x, y: x + y, [v * v for v in parts("value", width)])
    return snap.groupBy(*KEY).agg(F.sqrt(F.max(square)).alias("max_norm"), F.sqrt(F.sum(square)).alias("l2_norm"))


def equalize_periodic(snap: DataFrame, periodic: DataFrame, width: int) -> DataFrame:
    """Replace the values on periodic images by their mean."""
    rows = lookup(node(snap), periodic, ["mesh_id", "pid"], "left")
    mean = rows.filter("gid is not null").groupBy(*KEY, "gid").agg(
        F.array(*[F.avg(v) for v in parts("value", width)]).alias("_mean"))
    return M.of_group(rows, mean, KEY).withColumn("value", F.coalesce("_mean", "value")).select(snap.columns)


def uniaxial_energy(axis: list[float], k1: float, k2: float = 0.0, value="value") -> Column:
    """Energy density -K1·c² - K2·c⁴ with c along the (normalised) axis."""
    n = sum(a * a for a in axis) ** 0.5
    c = reduce(lambda x, y: x + y, [a / n * v for a, v in zip(axis, parts(value, 3))])
    return -k1 * c * c - k2 * c * c * c * c


def cubic_energy(axis1, axis2, k1: float, k2: float = 0.0, k3: float = 0.0, value="value") -> Column:
    """Cubic energy density on the orthonormalised axes."""
    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    third = cross(axis1, axis2)
    frame = []
    for a in (axis1, cross(third, axis1), third):
        n = sum(x * x for x in a) ** 0.5
        frame.append([x / n for x in a])
    c = [reduce(lambda x, y: x + y, [k * v for k, v in zip(a, parts(value, 3))]) for a in frame]
    pairs = [c[0] * c[1], c[0] * c[2], c[1] * c[2]]
    e = k1 * reduce(lambda x, y: x + y, [p * p for p in pairs])
    whole = c[0] * c[1] * c[2]
    return e + k2 * whole * whole + k3 * reduce(lambda x, y: x + y, [p * p * p * p for p in pairs])


def anisotropy_energy(snap: DataFrame, density: Column, vols: DataFrame) -> DataFrame:
    """Integral of an energy density expression over the sites, per save of a subfield."""
    return integrate(snap.withColumn("value", F.array(density)), vols, 1).drop("comp").withColumnRenamed("integral", "energy")


def to_amount(snap: DataFrame, vols: DataFrame, width: int, method: str = "box") -> DataFrame:
    """Density to amount per site: times the site's volume."""
    return _by_volume(snap, vols, width, method, lambda v: v * F.col("volume"))


def to_density(snap: DataFrame, vols: DataFrame, width: int, method: str = "box") -> DataFrame:
    return _by_volume(snap, vols, width, method, lambda v: v / F.col("volume"))


def _by_volume(snap, vols, width, method, op):
    if method != "box":
        raise ValueError(f"unknown method {method!r}")
    on = ["mesh_id", "pid"] + (["subfield"] if "subfield" in vols.columns else [])
    return lookup(node(snap), vols, on).withColumn("value", F.array(*[op(v) for v in parts("value", width)])).select(snap.columns)


# Layout

def set_field(df: DataFrame, value, normalise: bool = False, scale: float = 1.0, width: int = 3, out: str = "value") -> DataFrame:
    """Set a field at every row: a constant vector, a column, or a function of the position.

    A Python function gets a pandas Series of positions and returns a Series of vectors.
    """
    if isinstance(value, (list, tuple)):
        if len(value) != width:
            raise ValueError(f"{width} components expected, got {len(value)}")
        value = F.array(*[F.lit(float(v)) for v in value])
    elif callable(value) and not isinstance(value, Column):
        from stepfield.operators.calls import of_position
        value = of_position(value, "array<double>")(F.col("pos"))
    value = F.when(F.size(value) == width, value).otherwise(
        F.raise_error(F.lit("wrong number of components")).cast("array<double>"))
    df = df.withColumn("_raw", value)
    new = unit("_raw", width) if normalise else F.col("_raw")
    return df.withColumn(out, F.array(*[v * float(scale) for v in parts(new, width)])).drop("_raw")


def flatten_tensors(df: DataFrame, shapes: dict[str, tuple]) -> DataFrame:
    """Columns ``name_0`` or ``name_01`` for vectors and rank-2 tensors; scalars stay, higher ranks are an error."""
    out = []
    for c in df.columns:
        shape = shapes.get(c, ())
        if len(shape) > 2:
            raise ValueError(f"{c}: rank {len(shape)} cannot be flattened")
        if not shape:
            out.append(F.col(c))
        elif len(shape) == 1:
            out += [F.col(c)[i].alias(f"{c}_{i}") for i in range(shape[0])]
        else:
            out += [F.col(c)[i][j].alias(f"{c}_{i}{j}") for i in range(shape[0]) for j in range(shape[1])]
    return df.select(*out)


def entrywise(snap: DataFrame) -> DataFrame:
    """One row per component."""
    keep = [c for c in snap.columns if c != "value"]
    return snap.select(*keep, F.posexplode("value").alias("comp", "entry"))


def by_site(entries: DataFrame, subfields: list[str], width: int) -> DataFrame:
    """Component rows back to one vector column per subfield, all subfields of a site together."""
    cells = {s: [F.max(F.when((F.col("subfield") == s) & (F.col("comp") == i), F.col("entry"))) for i in range(width)]
             for s in subfields}
    cols = [F.when(c[0].isNotNull(), F.array(*c)).alias(s) for s, c in cells.items()]
    return entries.groupBy("run_id", "mesh_id", "id", "site").agg(*cols)


def defined_regions(snap: DataFrame, mesh: M.Mesh) -> DataFrame:
    """Regions all of whose points carry the subfield. A point must carry it exactly when it touches
    such a region; anything else is an error."""
    touch = M.point_region_rows(mesh).filter("region >= 1")
    have = node(snap).select("run_id", "mesh_id", "subfield", "pid").distinct()
    fields = have.select("run_id", "mesh_id", "subfield").distinct()
    sites = touch.join(F.broadcast(fields), "mesh_id")
    keys = ["run_id", "mesh_id", "subfield"]
    flagged = lookup(sites, have.withColumn("_d", F.lit(True)), [*keys, "pid"], "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
    full = flagged.groupBy(*keys, "region").agg(F.min("_d").alias("_all")).filter("_all").drop("_all")
    seen = flagged.join(F.broadcast(full.withColumn("_r", F.lit(True))), [*keys, "region"], "left")
    per_site = seen.groupBy(*keys, "pid").agg(F.max("_d").alias("_d"), F.max(F.coalesce("_r", F.lit(False))).alias("_r"))
    demand(per_site, "_d <> _r", "a subfield is defined in a part of a region only")
    return full


def subfield_jumps(region_sub: DataFrame) -> DataFrame:
    """Subfields present in one element and absent in another, per ordered pair (mesh_id, element, subfield).

    Lost = all pairs of a subfield's elements with the elements of the mesh, less those that have it.
    The table lists element kinds, one row per subfield; it does not grow with the mesh."""
    a = region_sub.select("mesh_id", F.col("element").alias("element_a"), "subfield")
    b = region_sub.select("mesh_id", F.col("element").alias("element_b")).distinct()
    have = region_sub.select("mesh_id", F.col("element").alias("element_b"), "subfield")
    return a.join(b, "mesh_id").join(have, ["mesh_id", "element_b", "subfield"], "left_anti").select(
        "mesh_id", "element_a", "element_b", "subfield")
