"""Snapshot stores and exports (S-06 … S-09, S-17 … S-21)."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.functions.text import fixed
from stepfield.functions.units import general
from stepfield.operators.snapshots import CLOCK, KEY, convert, saves, site_positions
from stepfield.plans.ordered import Ordered
from stepfield.plans.skewed import lookup, matched
from stepfield.session import cut_lineage

COLUMNS = ["run_id", "mesh_id", "field", "subfield", "id", *CLOCK, "site", "value"]


#: What the index knows of a save: its key, its clock and the files that hold its rows.
INDEX = ["run_id", "mesh_id", "field", "subfield", "id", *CLOCK]


def append_snapshots(snap: DataFrame, path: str, catalog: DataFrame, factors: DataFrame, points: DataFrame, width: int) -> None:
    """Append to a store partitioned by run and field, values times the factor of their unit. Fields
    that the catalog does not know and runs without a mesh stop the job.

    An append is three tables: its rows, the index of its saves (with the files that hold each), and last its name in the list of
    what is published. Readers see what is published only, so an append that fails leaves the store as it was.
    """
    spark, batch = snap.sparkSession, "a" + uuid.uuid4().hex
    known = catalog.select("run_id", "field", "subfield").distinct().withColumn("_known", F.lit(True))
    meshes = points.select("mesh_id").distinct().withColumn("_mesh", F.lit(True))
    si = convert(snap, catalog, factors, width).select(*COLUMNS)
    si = matched(matched(si, known, ["run_id", "field", "subfield"], "unknown field", few=True), meshes, ["mesh_id"], "no mesh for the run", few=True)
    si = si.withColumn("value", F.when(F.col("_known") & F.col("_mesh"), F.col("value"))).select(*COLUMNS)
    # Rows of one save lie together; a big save still spreads over many files.
    out = si.repartitionByRange("run_id", "field", "id", F.col("site")[0]).sortWithinPartitions("run_id", "field", "id")
    rows = f"{path}/rows/batch={batch}"
    out.write.partitionBy("run_id", "field").parquet(rows)
    if not _there(spark, rows):
        return
    kept = spark.read.parquet(rows).select(*[F.col(c).cast("string") if c == "run_id" else F.col(c) for c in INDEX], F.col("_metadata.file_path").alias("file"))
    index = kept.groupBy(*INDEX, "file").agg(F.count(F.lit(1)).alias("sites"))
    index.write.parquet(f"{path}/index/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/published")


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a written table has any file of rows."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return False
        raise


def _published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The appends of a table that are published; the list has one row per append, so others' folders are pruned."""
    done = spark.read.schema("batch string").parquet(f"{path}/published").distinct()
    return spark.read.parquet(f"{path}/{table}").join(done, "batch", "left_semi")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _published(spark, path, "rows").withColumn("run_id", F.col("run_id").cast("string")).select(*COLUMNS)


def save_index(spark: SparkSession, path: str, field: str | None = None, subfield: str | None = None) -> DataFrame:
    """Every save of the store (KEY and clock) with its row number per subfield (from 0), its sites and its files; no rows are read."""
    index = _published(spark, path, "index").withColumn("run_id", F.col("run_id").cast("string"))
    for name, value in (("field", field), ("subfield", subfield)):
        index = index if value is None else index.filter(F.col(name) == value)
    whole = index.groupBy(*INDEX).agg(F.sum("sites").alias("sites"), F.collect_set("file").alias("files"))
    return whole.join(saves(whole).select(*KEY, "row"), KEY)


def _of_saves(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen saves of an index; only the files that hold them are opened."""
    chosen = cut_lineage(chosen)
    files = [unquote(r.file) for r in chosen.select(F.explode("files").alias("file")).distinct().collect()]  # as many as the reader has to list
    if not files:
        return read_store(spark, path).limit(0).withColumn("row", F.lit(None).cast("bigint"))
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*files).withColumn("run_id", F.col("run_id").cast("string"))
    return rows.select(*COLUMNS).join(F.broadcast(chosen.select(*KEY, "row")), KEY)


def read_snapshot(spark: SparkSession, path: str, field: str, subfield: str, first: int, last: int | None = None) -> DataFrame:
    """Saves number ``first`` (to ``last``) of a subfield; only the files that hold them are opened."""
    index = save_index(spark, path, field, subfield)
    return _of_saves(spark, path, index.filter(F.col("row").between(first, first if last is None else last)))


def read_subfield(spark: SparkSession, path: str, field: str, subfield: str, id: int | None = None, row: int | None = None) -> DataFrame:
    """One save by id (which wins) or by row number, the first one by default."""
    index = save_index(spark, path, field, subfield)
    chosen = index.filter(F.col("id") == id if id is not None else F.col("row") == (row or 0))
    return _of_saves(spark, path, chosen).drop("row").select(*COLUMNS)


def read_positions(spark: SparkSession, path: str, points: DataFrame, field: str, subfield: str, factor: float = 1.0) -> DataFrame:
    """Sites of a subfield with their positions."""
    snap = read_store(spark, path).filter((F.col("field") == field) & (F.col("subfield") == subfield))
    sites = snap.select("mesh_id", "site").distinct()
    return site_positions(sites, points, factor=factor)


def export_by_id(df: DataFrame, path: str, missing: bool = False) -> None:
    """One folder ``id=…`` per save; with ``missing`` ids exported before are skipped."""
    if missing:
        try:
            done = df.sparkSession.read.parquet(path).select("id").distinct()
            df = df.join(done, "id", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    spread = [c for c in ("site", "pid") if c in df.columns]
    df.repartitionByRange("id", *spread).write.mode("append").partitionBy("id").parquet(path)


def dump_snapshots(snap: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Text of snapshots as rows (KEY, position in the block, line): a header block per save of a
    subfield, then index, site, position and value per site."""
    pos = site_positions(snap, points)
    rows = lookup(snap, pos, ["mesh_id", "site"])
    rows = Ordered(rows, KEY, ["site"]).position("_n").df
    vec = lambda c, n: F.concat(F.lit("("), F.concat_ws(" ", *[general(F.col(c)[i]) for i in range(n)]), F.lit(")"))
    body = rows.select(*KEY, F.col("_n").alias("place"), F.format_string(
        "%4d %10s %s %s", F.col("_n") - 1, F.array_join(F.col("site").cast("array<string>"), ","), vec("pos", 3), vec("value", width)).alias("line"))
    heads = snap.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in CLOCK])
    text = F.array(F.concat(F.lit("field    : "), "field"), F.concat(F.lit("subfield : "), "subfield"),
                   F.concat(F.lit("time     : "), general("time")), F.format_string("id       : %d", "id"),
                   F.format_string("step     : %d", "step"), F.format_string("stage    : %d", "stage"),
                   F.lit("#Start (index, site, position, value)"))
    top = heads.select(*KEY, F.posexplode(text).alias("p", "line")).select(*KEY, (F.col("p") - 7).cast("bigint").alias("place"), "line")
    tail = heads.select(*KEY, F.lit(2**62).cast("bigint").alias("place"), F.lit("#End").alias("line"))
    return body.unionByName(top).unionByName(tail)


def write_dump(lines: DataFrame, path: str) -> None:
    """Write dump rows in order over as many files as the data need."""
    lines.repartitionByRange(*KEY, "place").sortWithinPartitions(*KEY, "place").select("line").write.text(path)


def probe_text(df: DataFrame, axes: list[str], order: list[str], value: str = "value", by=()) -> DataFrame:
    """Lines ``t x y z value`` in lattice order, preceded by an empty line where an axis other than
    the fastest one moves on: rows (by, order, line)."""
    scan = Ordered(df, list(by), order).lag(**{"_p_" + c: F.col(c) for c in order[:-1]})
    moved = F.lit(False)
    for c in order[:-1]:
        moved = moved | (F.col("_p_" + c) != F.col(c))
    line = F.concat_ws(" ", *[general(F.col(a).cast("double"), 12) for a in axes], general(F.col(value).cast("double"), 12))
    return scan.df.select(*by, *order, F.concat(F.when(F.coalesce(moved, F.lit(False)), F.lit("\n")).otherwise(F.lit("")), line).alias("line"))


def write_probe_text(df: DataFrame, path: str, axes: list[str], order: list[str], value: str = "value") -> None:
    probe_text(df, axes, order, value).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def site_lines(df: DataFrame, width: int = 3) -> DataFrame:
    """``time x y z v0 v1 v2`` per row of (time, pos, value)."""
    cells = [general("time")] + [fixed(F.col("pos")[i], 6) for i in range(3)] + [general(F.col("value")[i]) for i in range(width)]
    return df.select(*[c for c in df.columns if c not in ("pos", "value")], F.concat_ws(" ", *cells).alias("line"))


def append_sites(df: DataFrame, path: str, width: int = 3) -> None:
    site_lines(df, width).select("line").write.mode("append").text(path)


#: What opening a file counts as when files are dealt to tasks; Spark's 4 MB would give a few small files to each.
OPEN_COST = 1 << 16


def attach_files(spark: SparkSession, glob: str, store: str, chunk: int = 1 << 20) -> None:
    """Keep source files next to the data as numbered chunks, each with the hash of the whole file; empty files
    are passed over by the reader. ``glob`` may name folders: those of very many files are listed much faster than their files are one by one."""
    files = spark.read.format("binaryFile").load(glob)
    places = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / chunk))
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha2"), "content", F.explode(places).alias("chunk"))
    part = F.substring(F.col("content"), (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk))
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_COST))
    try:
        rows.select("path", "length", "sha2", "chunk", part.alias("content")).write.mode("append").parquet(store + "/_files")
    finally:
        spark.conf.set(name, before)


def attached_files(spark: SparkSession, store: str) -> DataFrame:
    """path, length, sha2, chunk, content of the files kept; their chunks in order are the file."""
    return spark.read.parquet(store + "/_files")


def set_attr(df_attrs: DataFrame, store: str) -> None:
    """Append attributes (name, value, at): the latest ``at`` of a name counts."""
    df_attrs.select("name", "value", "at").write.mode("append").parquet(store + "/_attrs")


def get_attr(spark: SparkSession, store: str, name: str | None = None) -> DataFrame:
    rows = spark.read.parquet(store + "/_attrs")
    rows = rows if name is None else rows.filter(F.col("name") == name)
    return rows.groupBy("name").agg(F.max_by("value", "at").alias("value"))
