"""Mesh files and stores (S-10 … S-15)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.operators import mesh as M
from stepfield.plans.ordered import dense_ids
from stepfield.plans.skewed import lookup, need
from stepfield.sources.lines import file_stem, numbered_lines, tokens

_ROW = ["mesh_id", "line", "t"]


def _counts(lines: DataFrame, columns: dict) -> DataFrame:
    """One row per mesh with numbers taken from its header lines."""
    return lines.groupBy("mesh_id").agg(*[c.alias(k) for k, c in columns.items()])


def _at(line: int, value):
    return F.max(F.when(F.col("line") == line, value))


def _number(i):
    return F.get("t", F.lit(i)).try_cast("bigint")


def _lines(spark, path, folder=None) -> DataFrame:
    return numbered_lines(spark, path, folder).select(file_stem().alias("mesh_id"), "line", "value", tokens().alias("t"))


def _floats(start: int = 0):
    return F.transform(F.slice("t", start + 1, F.greatest(F.size("t") - start, F.lit(0))), lambda x: x.try_cast("double"))


def _ints(start: int, shift: int = 0):
    return F.transform(F.slice("t", start + 1, F.greatest(F.size("t") - start, F.lit(0))), lambda x: x.try_cast("bigint") - shift)


def read_meshes(spark: SparkSession, path, fmt: str = "text", dim: int = 3, folder: str | None = None) -> M.Mesh:
    """Many mesh files, one mesh per file, as one pair of tables; ``mesh_id`` is the file name (or the
    part of the path that ``folder`` picks, when a folder of part files is one mesh)."""
    readers = {"text": _read_text, "netgen": _read_netgen, "gambit": _read_gambit, "gmsh1": _read_gmsh1}
    return readers[fmt](_lines(spark, path, folder), dim)


def _needed(head: DataFrame, columns: list[str], message: str) -> DataFrame:
    return head.withColumns({c: need(F.col(c), message, "bigint") for c in columns})


def _blocks(lines: DataFrame, head: DataFrame) -> DataFrame:
    # The table has one row per file; a file may hold any share of the lines, the join spreads them.
    return lines.join(head, "mesh_id")


def _read_text(lines, dim):
    """Two comment lines, the second with the counts; then per block a count line and its rows: points;
    region and vertices; two regions and a face; periodic group and its points."""
    found = F.regexp_extract_all(F.col("value"), F.lit(r"=\s*(\d+)"), F.lit(1))
    head = _counts(lines, {n: _at(1, F.get(found, F.lit(i)).cast("bigint")) for i, n in enumerate(["dim", "np", "ns", "nf", "ng"])})
    rows = _blocks(lines, _needed(head, ["np", "ns"], "not a mesh file: the line with the counts is missing"))
    first = {"p": F.lit(3), "s": 4 + F.col("np"), "f": 5 + F.col("np") + F.col("ns"), "g": 6 + F.col("np") + F.col("ns") + F.col("nf")}
    size = {"p": F.col("np"), "s": F.col("ns"), "f": F.col("nf"), "g": F.col("ng")}
    pick = lambda b: rows.withColumn("_i", F.col("line") - first[b]).filter((F.col("_i") >= 0) & (F.col("_i") < size[b]))
    points = pick("p").select("mesh_id", F.col("_i").alias("pid"), _floats().alias("pos"))
    simplices = pick("s").select("mesh_id", F.col("_i").alias("sid"), _number(0).cast("int").alias("region"), _ints(1).alias("v"))
    groups = pick("g").select("mesh_id", _number(0).alias("gid"), F.explode(_ints(1)).alias("pid"))
    return M.Mesh(points, simplices, dim, groups)


def _read_netgen(lines, dim):
    """Count and points, count and (region, vertices from 1)."""
    np_ = _at(0, _number(0))
    head = _counts(lines, {"np": np_})
    rows = _blocks(lines, _needed(head, ["np"], "the first line must be the number of points"))
    count = rows.filter(F.col("line") == F.col("np") + 1).select("mesh_id", _number(0).alias("ns"))
    points = rows.filter(F.col("line").between(1, F.col("np"))).select("mesh_id", (F.col("line") - 1).alias("pid"), _floats().alias("pos"))
    body = rows.join(count, "mesh_id").withColumn("_i", F.col("line") - F.col("np") - 2).filter("_i >= 0 and _i < ns")
    return M.Mesh(points, body.select("mesh_id", F.col("_i").alias("sid"), _number(0).cast("int").alias("region"), _ints(1, 1).alias("v")), dim)


def _read_gambit(lines, dim):
    """Counts on line 7; points (number, coordinates) from line 10; elements (number, kind, size,
    vertices from 1) after two lines; element numbers of the groups, ten to a line, after five more.
    A fall in those numbers begins a new group, and the groups are the regions 1, 2, …"""
    head = _counts(lines, {"np": _at(6, _number(0)), "ne": _at(6, _number(1))})
    rows = _blocks(lines, _needed(head, ["np", "ne"], "line 7 must hold the counts"))
    points = rows.withColumn("_i", F.col("line") - 9).filter("_i >= 0 and _i < np").select("mesh_id", F.col("_i").alias("pid"), _floats(1).alias("pos"))
    body = rows.withColumn("_i", F.col("line") - 11 - F.col("np")).filter("_i >= 0 and _i < ne").select(
        "mesh_id", _number(0).alias("number"), _ints(3, 1).alias("v"))
    listed = rows.withColumn("_i", F.col("line") - 16 - F.col("np") - F.col("ne")).filter("_i >= 0 and _i < ceil(ne / 10)")
    listed = listed.select("mesh_id", "_i", F.posexplode(_ints(0)).alias("_j", "number"))
    from stepfield.plans.ordered import Ordered
    scan = Ordered(listed, ["mesh_id"], ["_i", "_j"]).lag(_p=F.col("number"))
    scan.running(region=("count", F.when(F.col("_p").isNull() | (F.col("number") <= F.col("_p")), F.lit(1))))
    region = scan.df.select("mesh_id", "number", F.col("region").cast("int").alias("region"))
    simplices = body.join(region, ["mesh_id", "number"])
    return M.Mesh(points, dense_ids(simplices, ["mesh_id"], ["region", "number"], "sid").select("mesh_id", "sid", "region", "v"), dim)


def _read_gmsh1(lines, dim):
    """Nodes (any numbers, renumbered 0, 1, … in file order) and elements (number, type, region, …,
    size, vertices) between their markers; only tetrahedra (type 4) stay."""
    mark = lambda s: F.max(F.when(F.col("value").startswith(s), F.col("line")))
    head = _counts(lines, {"n0": mark("$NOD"), "n1": mark("$ENDNOD"), "e0": mark("$ELM"), "e1": mark("$ENDELM")})
    rows = _blocks(lines, _needed(head, ["n0", "n1", "e0", "e1"], "a section marker is missing (only format 1 is read)"))
    nodes = rows.filter("line > n0 + 1 and line < n1").select("mesh_id", (F.col("line") - F.col("n0") - 2).alias("pid"), _number(0).alias("old"), _floats(1).alias("pos"))
    body = rows.filter("line > e0 + 1 and line < e1").select("mesh_id", "line", _number(0).alias("number"), _number(1).alias("type"), _number(2).cast("int").alias("region"), _ints(5).alias("ends"))
    tets = body.filter("type = 4").select("mesh_id", "number", "line", "region", "ends")
    tets = tets.withColumn("ends", need(F.col("ends"), "only tetrahedra of first order can be read", "array<bigint>", F.size("ends") == 4))
    numbered = dense_ids(tets, ["mesh_id"], ["line"], "sid").withColumnRenamed("ends", "v")
    mapping = nodes.select("mesh_id", F.col("old").alias("pid"), F.col("pid").alias("new_pid"))
    simplices = M.remap(numbered, mapping, ["mesh_id"], dim).select("mesh_id", "sid", "region", "v")
    return M.Mesh(nodes.select("mesh_id", "pid", "pos"), simplices, dim)


def gmsh_report(spark: SparkSession, path, folder: str | None = None) -> DataFrame:
    """Ignored element types with their counts, and nodes no tetrahedron uses (mesh_id, what, n)."""
    lines = _lines(spark, path, folder)
    mesh = _read_gmsh1(lines, 3)
    mark = lambda s: F.max(F.when(F.col("value").startswith(s), F.col("line")))
    rows = _blocks(lines, _counts(lines, {"e0": mark("$ELM"), "e1": mark("$ENDELM")}))
    kinds = rows.filter("line > e0 + 1 and line < e1").filter(_number(1) != 4).groupBy("mesh_id", F.concat(F.lit("type "), F.get("t", F.lit(1))).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    unused = lookup(mesh.points, M.corners(mesh), ["mesh_id", "pid"], "left_anti").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(unused.select("mesh_id", F.lit("unused nodes").alias("what"), "n"))


#: What is known of a published version of a mesh store: its number, its folder and the tables in it.
VERSIONS = "number bigint, version string, tables array<string>"


def mesh_versions(spark: SparkSession, path: str) -> list:
    """Published versions of a mesh store, the newest first; one row for each time it was written."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{path}/published").orderBy(F.desc("number"), F.desc("version")).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def write_mesh_store(mesh: M.Mesh, path: str, replace: bool = False) -> None:
    """Parquet store: points, oriented simplices, interface faces with their two regions, periodic rows.

    A version is written to a folder of its own and published last, so that readers see all of its tables or none, and a write that
    fails leaves the store as it was. A store that exists is refused unless ``replace`` asks for a new version; the older ones
    stay for those who read them.
    """
    spark = mesh.points.sparkSession
    known = mesh_versions(spark, path)
    if known and not replace:
        raise ValueError(f"{path} holds a mesh store already")
    version = "v" + uuid.uuid4().hex
    fixed = M.fix_orientation(mesh)
    parts = {"points": mesh.points, "simplices": fixed.simplices, "surfaces": M.interfaces(mesh)}
    if mesh.periodic is not None:
        width = mesh.periodic.groupBy("mesh_id", "gid").agg(F.sort_array(F.collect_list("pid")).alias("pids"))
        top = width.agg(F.max(F.size("pids")).alias("w")).first()[0] or 0
        pad = F.concat("pids", F.array_repeat(F.lit(-1).cast("bigint"), F.lit(top) - F.size("pids")))
        parts["periodic"] = width.select("mesh_id", "gid", pad.alias("pids"))
    for name, df in parts.items():
        df.repartitionByRange("mesh_id", df.columns[1]).write.parquet(f"{path}/{version}/{name}")
    number = 1 + (known[0].number if known else 0)
    spark.createDataFrame([(number, version, list(parts))], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/published")


def read_mesh_store(spark: SparkSession, path: str, dim: int = 3, periodic: bool = True) -> M.Mesh:
    """The newest version of a mesh store; the padding -1 of periodic groups is removed. Without periodic rows there are no groups."""
    known = mesh_versions(spark, path)
    if not known:
        raise ValueError(f"{path} holds no mesh store")
    folder, groups = f"{path}/{known[0].version}", None
    if periodic and "periodic" in known[0].tables:
        rows = spark.read.parquet(folder + "/periodic")
        groups = rows.select("mesh_id", "gid", F.explode(F.filter("pids", lambda x: x != -1)).alias("pid"))
    return M.Mesh(spark.read.parquet(folder + "/points"), spark.read.parquet(folder + "/simplices"), dim, groups)


def mesh_lines(mesh: M.Mesh, title: str = "mesh file version 1.0") -> DataFrame:
    """The text format as rows (mesh_id, block, place, line); point and simplex ids are made dense."""
    d = mesh.dim
    pids = dense_ids(mesh.points, ["mesh_id"], ["pid"], "new_pid")
    mapping = pids.select("mesh_id", "pid", "new_pid")
    fixed = M.remap(M.fix_orientation(mesh).simplices, mapping, ["mesh_id"], d)
    dense = dense_ids(fixed.withColumnRenamed("sid", "old_sid"), ["mesh_id"], ["old_sid"], "sid")
    renamed = M.Mesh(pids.select("mesh_id", F.col("new_pid").alias("pid"), "pos"), dense.select("mesh_id", "sid", "region", "v"), d)
    faces = dense_ids(M.interfaces(renamed), ["mesh_id"], ["face"], "place")
    text = lambda a: F.array_join(F.col(a).cast("array<string>"), " ")
    coords = F.concat(*[F.format_string("\t%25.12f ", F.col("pos")[a]) for a in range(d)])
    blocks = {
        1: renamed.points.select("mesh_id", F.col("pid").alias("place"), coords.alias("line")),
        2: renamed.simplices.select("mesh_id", F.col("sid").alias("place"), F.concat(F.lit("\t"), F.col("region").cast("string"), F.lit(" "), text("v")).alias("line")),
        3: faces.select("mesh_id", "place", F.concat(F.lit("\t"), F.least("region_a", "region_b").cast("string"), F.lit(" "), F.greatest("region_a", "region_b").cast("string"), F.lit("\t"), text("face")).alias("line")),
    }
    if mesh.periodic is not None:
        groups = lookup(mesh.periodic, mapping, ["mesh_id", "pid"]).groupBy("mesh_id", "gid").agg(F.sort_array(F.collect_list("new_pid")).alias("pids"))
        groups = dense_ids(groups, ["mesh_id"], ["gid"], "place")
        blocks[4] = groups.select("mesh_id", "place", F.concat(F.lit("\t"), F.col("place").cast("string"), F.lit("\t"), text("pids")).alias("line"))
    out = None
    for b, df in blocks.items():
        df = df.select("mesh_id", F.lit(b).alias("block"), "place", "line")
        out = df if out is None else out.unionByName(df)
    counts = out.groupBy("mesh_id").agg(*[F.count(F.when(F.col("block") == b, 1)).alias(f"n{b}") for b in (1, 2, 3, 4)])
    sizes = F.format_string(f"# dim = {d} \t nodes = %d \t simplices = %d \t surfaces = %d \t periodic = %d", "n1", "n2", "n3", "n4")
    heads = F.array(F.struct(F.lit(0).alias("block"), F.lit(f"# {title}").alias("line")), F.struct(F.lit(0).alias("block"), sizes.alias("line")),
                    *[F.struct(F.lit(b).alias("block"), F.col(f"n{b}").cast("string").alias("line")) for b in (1, 2, 3, 4)])
    top = counts.select("mesh_id", F.posexplode(heads).alias("_p", "h")).select(
        "mesh_id", "h.block", (F.col("_p") - 100).cast("bigint").alias("place"), "h.line")
    return out.unionByName(top)


def write_meshes(mesh: M.Mesh, path: str, title: str = "mesh file version 1.0") -> None:
    """Text format, a folder per mesh; a large mesh becomes several part files in order."""
    lines = mesh_lines(mesh, title).repartitionByRange("mesh_id", "block", "place").sortWithinPartitions("mesh_id", "block", "place")
    lines.select("line", "mesh_id").write.partitionBy("mesh_id").text(path)


def read_written_meshes(spark: SparkSession, path: str, dim: int = 3) -> M.Mesh:
    """Folders written by ``write_meshes``."""
    return read_meshes(spark, path + "/mesh_id=*", "text", dim, r"mesh_id=([^/]+)/")
