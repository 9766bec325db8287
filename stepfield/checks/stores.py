"""Queries that write files or stores and read them back. What is written comes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepfield.checks.base import EDGES, FACES, LOC, MESH, SNAP, epoch_us, event_runs, part_mesh, query, r, snapshots, table, xyz_out
from stepfield.checks.probing import part_grid
from stepfield.operators import mesh as M
from stepfield.plans.skewed import lookup
from stepfield.session import shared_folder
from stepfield.sources import grid_blocks as GB
from stepfield.sources import grids as GR
from stepfield.sources import meshes as ME
from stepfield.sources import runs as RU
from stepfield.sources import snapshots as SN
from stepfield.sources.lines import numbered_lines

WS = f"WITH {MESH}, {SNAP}"
RUNS = """SELECT 'u' || (user_id % 5) AS run_id, event_id::DOUBLE AS id, round(epoch_us(ts) / 1e6 - 1700000000, 4) AS time, value AS v_0,
 date_trunc('second', ts)::TIMESTAMP AS localtime, event_type AS note FROM events"""


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def short_runs(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.col("event_id").cast("double").alias("id"),
        F.round(epoch_us("ts") / 1e6 - 1700000000, 4).alias("time"), F.col("value").alias("v_0"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("localtime"), F.col("event_type").alias("note"))


@query("s01_read_runs", RUNS)
def _(spark, sf):
    path = scratch(spark)
    RU.write_runs_text(short_runs(spark, sf), path, ["id"], {"time": "s"}, fmt="%25.16g")
    return RU.read_runs_text(spark, path).select("run_id", "id", "time", "v_0", "localtime", "note")


@query("s05_write_runs_text", f"""SELECT run_id, printf('%25.13g %25.13g %25.13g ', id, time, v_0) || lpad(strftime(localtime, '%Y/%m/%d-%H:%M:%S'), 25, ' ') || ' ' || lpad(note, 25, ' ') AS line
 FROM ({RUNS}) UNION ALL SELECT DISTINCT 'u' || (user_id % 5), '# ' || lpad('time', 24, ' ') FROM events""")
def _(spark, sf):
    """All lines of rows, and once per run the place of a name in the header."""
    path = scratch(spark)
    RU.write_runs_text(short_runs(spark, sf), path, ["id"], {"time": "s"})
    lines = numbered_lines(spark, path + "/run_id=*", r"run_id=([^/]+)/").select(F.col("file").alias("run_id"), "value")
    rows = lines.filter(~F.col("value").startswith("#")).select("run_id", F.col("value").alias("line"))
    heads = lines.filter("value like '#%time%' and value not like '#%<%'").select("run_id", F.concat(F.lit("# "), F.substring("value", 29, 24)).alias("line"))
    return rows.unionByName(heads.distinct())


@query("s02_read_odt", "SELECT event_id::DOUBLE AS \"Oxs_Driver::Iteration\", value AS My_Value_x FROM events")
def _(spark, sf):
    path = scratch(spark)
    head = spark.range(1).select(F.lit("# ODT 1.0\n# Table Start\n# Title: run\n## note\n# Columns: {Oxs_Driver::Iteration} {My Value x}\n# Units: {} A/m").alias("value"))
    rows = event_runs(spark, sf).select(F.concat_ws(" ", "event_id", "value").alias("value"))
    # One header per file: each file gets its own copy in front.
    n = 3
    parts = rows.withColumn("f", F.pmod(F.hash("value"), F.lit(n)))
    heads = head.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    both = heads.withColumn("k", F.lit(0)).unionByName(parts.withColumn("k", F.lit(1)))
    both.repartition(n, "f").sortWithinPartitions("f", "k").select("value", "f").write.partitionBy("f").text(path)
    return RU.read_runs(spark, path + "/f=*", fmt="odt").select("`Oxs_Driver::Iteration`", "My_Value_x")


@query("s03_read_log", "SELECT event_id::DOUBLE AS n, value AS energy FROM events")
def _(spark, sf):
    path = scratch(spark)
    rows = event_runs(spark, sf).select(F.concat_ws("  ", "event_id", "value").alias("value"), F.pmod("event_id", F.lit(2)).alias("f"))
    heads = spark.range(2).select(F.lit("log of a program\n# second line\nn energy\n- J").alias("value"), F.col("id").alias("f"))
    both = heads.withColumn("k", F.lit(0)).unionByName(rows.withColumn("k", F.lit(1)))
    both.repartition(2, "f").sortWithinPartitions("f", "k").select("value", "f").write.partitionBy("f").text(path)
    return RU.read_runs(spark, path + "/f=*", names_line=2, units_line=3).select("n", "energy")


@query("s04_append_runs", "SELECT user_id % 7 AS run_id, event_id, value FROM events")
def _(spark, sf):
    path = scratch(spark)
    ev = event_runs(spark, sf).select((F.col("run_id") % 7).alias("run_id"), "event_id", "value")
    RU.append_runs(ev.filter("event_id % 2 = 0"), path)
    RU.append_runs(ev.filter("event_id % 2 = 1").select("value", "event_id", "run_id"), path)
    return spark.read.parquet(path).select(F.col("run_id").cast("bigint").alias("run_id"), "event_id", "value")


@query("s22_memory_log", """SELECT doc_id, (n_chars / 10.0)::DOUBLE AS time, n_chars AS vmem, (n_chars // 2)::BIGINT AS rss, source AS tag FROM documents WHERE n_chars % 3 <> 0""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    good = F.format_string("x Memory report: T= %.1f VMEM=%dKB RSS=%dKB %s", F.col("n_chars") / 10.0, F.col("n_chars"), F.floor(F.col("n_chars") / 2), F.col("source"))
    lines = d.select("doc_id", F.when(F.col("n_chars") % 3 != 0, good).otherwise(F.regexp_replace("text", "[\r\n]", " ")).alias("value"))
    return RU.memory_log(lines)


def _store(spark, sf):
    path = scratch(spark)
    m = part_mesh(spark, sf)
    s = snapshots(spark, sf, m)
    catalog = s.select("run_id", "field", "subfield").distinct().withColumn("unit", F.lit("kA/m"))
    factors = catalog.select("unit").distinct().withColumn("factor", F.lit(1000.0))
    SN.append_snapshots(s.filter("id < 2"), path, catalog, factors, m.points, 3)
    SN.append_snapshots(s.filter("id >= 2"), path, catalog, factors, m.points, 3)
    return path, m


@query("s06_append_snapshots", f"{WS} SELECT run_id, subfield, id, step, pid, round(a * 1000, 4) AS a, round(b * 1000, 4) AS b, round(c * 1000, 4) AS c FROM snap")
def _(spark, sf):
    path, _ = _store(spark, sf)
    return SN.read_store(spark, path).select("run_id", "subfield", "id", "step", F.col("site")[0].alias("pid"), *xyz_out(digits=4))


@query("s07_read_snapshot", f"{WS} SELECT run_id, id - 0 AS row, pid, round(a * 1000, 4) AS a FROM snap WHERE subfield = 'm_2' AND id BETWEEN 1 AND 2")
def _(spark, sf):
    path, _ = _store(spark, sf)
    return SN.read_snapshot(spark, path, "m", "m_2", 1, 2).select("run_id", "row", F.col("site")[0].alias("pid"), r(F.col("value")[0], 4).alias("a"))


@query("s08_read_subfield", f"{WS} SELECT run_id, id, pid, round(a * 1000, 4) AS a FROM snap WHERE subfield = 'm_1' AND id IN (0, 3)")
def _(spark, sf):
    path, _ = _store(spark, sf)
    both = SN.read_subfield(spark, path, "m", "m_1").unionByName(SN.read_subfield(spark, path, "m", "m_1", id=3))
    return both.select("run_id", "id", F.col("site")[0].alias("pid"), r(F.col("value")[0], 4).alias("a"))


@query("s06_save_index", f"{WS} SELECT run_id, subfield, id, step, stage, time, id AS row, count(*) AS sites FROM snap GROUP BY ALL")
def _(spark, sf):
    """What is stored, from the index alone; two appends."""
    path, _ = _store(spark, sf)
    return SN.save_index(spark, path).select("run_id", "subfield", "id", "step", "stage", "time", "row", "sites")


@query("s09_read_positions", f"WITH {MESH} SELECT DISTINCT mesh_id, pid, round(x * 0.5, 6) AS x, round(y * 0.5, 6) AS y, round(z * 0.5, 6) AS z FROM pts JOIN (SELECT DISTINCT mesh_id, pid FROM corn WHERE region = 1) USING (mesh_id, pid)")
def _(spark, sf):
    """Sites of a stored subfield with their positions."""
    path, m = _store(spark, sf)
    pos = SN.read_positions(spark, path, m.points, "m", "m_1", factor=0.5)
    return pos.select("mesh_id", F.col("site")[0].alias("pid"), *[r(F.col("pos")[i]).alias(a) for i, a in enumerate("xyz")])


@query("s17_export_by_id", "SELECT event_id % 10 AS id, event_id AS site, value FROM events")
def _(spark, sf):
    path = scratch(spark)
    ev = table(spark, sf, "events").select((F.col("event_id") % 10).alias("id"), F.col("event_id").alias("site"), "value")
    SN.export_by_id(ev.filter("id < 4"), path)
    SN.export_by_id(ev, path, missing=True)
    return spark.read.parquet(path).select(F.col("id").cast("bigint").alias("id"), "site", "value")


@query("s18_dump_snapshots", f"{WS} SELECT run_id, subfield, id, count(*) + 8 AS lines, 'field    : m' AS first, '#End' AS last FROM snap GROUP BY ALL")
def _(spark, sf):
    m = part_mesh(spark, sf)
    d = SN.dump_snapshots(snapshots(spark, sf, m), m.points, 3)
    return d.groupBy("run_id", "subfield", "id").agg(F.count(F.lit(1)).alias("lines"), F.min_by("line", "place").alias("first"), F.max_by("line", "place").alias("last"))


@query("s19_probe_text", """WITH g AS (SELECT p_partkey % 10 AS ix, p_partkey % 200 // 10 AS iy, p_partkey // 200 AS iz, p_size AS v FROM part)
 SELECT iz, iy, ix, (CASE WHEN ix = 0 AND (iy > 0 OR iz > 0) THEN chr(10) ELSE '' END) || ix || ' ' || iy || ' ' || iz || ' ' || v AS line FROM g""")
def _(spark, sf):
    g = part_grid(spark, sf).withColumn("value", F.col("v")[1])
    return SN.probe_text(g, ["ix", "iy", "iz"], ["iz", "iy", "ix"])


@query("s20_append_sites", f"""{WS} SELECT printf('%g %.6f %.6f %.6f', s.time, x, y, z) AS line, count(*) AS n FROM snap s JOIN pts USING (mesh_id, pid) GROUP BY ALL""")
def _(spark, sf):
    m = part_mesh(spark, sf)
    s = snapshots(spark, sf, m).withColumn("pid", F.col("site")[0])
    s = lookup(s, m.points, ["mesh_id", "pid"])
    path = scratch(spark)
    SN.append_sites(s.filter("id < 1"), path)
    SN.append_sites(s.filter("id >= 1"), path)
    # The stored lines themselves, up to the values.
    stored = spark.read.text(path)
    return stored.select(F.substring_index("value", " ", 4).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("s21_provenance", "SELECT p_brand AS name, arg_max(p_name, p_partkey) AS value FROM part GROUP BY p_brand")
def _(spark, sf):
    path = scratch(spark)
    p = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("value"), F.col("p_partkey").alias("at"))
    SN.set_attr(p.filter("at % 2 = 0"), path)
    SN.set_attr(p.filter("at % 2 = 1"), path)
    return SN.get_attr(spark, path)


#: Files of a folder; folders are taken one after another, so the driver lists no more at once.
FILES = 1 << 16


def text_files(docs, path: str) -> list[str]:
    """Writes the texts of each doc_id to a file ``doc_id=...``, a separator behind each, and returns the folders. Tasks write the files themselves: Spark's writer makes
    a folder for each, and moves it once more at the end."""
    def put(batches):
        import pyarrow as pa

        system, top = GB.open_system(path)
        last, out, folders = None, None, set()
        for batch in batches:
            for k, name, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "text"))):
                if (k, name) != last:
                    if out:
                        out.close()
                    if k not in folders:
                        system.create_dir(f"{top}/{k}", recursive=True)
                    folders.add(k)
                    last, out = (k, name), system.open_output_stream(f"{top}/{k}/doc_id={name}")
                out.write(text + b"\x01")
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(folders), pa.int64())], ["folder"])

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    folder = F.pmod(F.xxhash64("doc_id"), F.lit(docs.count() // FILES + 1))
    rows = docs.select("doc_id", folder.alias("folder"), name.alias("name"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("folder", "name", "text")
    return [f"{path}/{r.folder}" for r in rows.mapInArrow(put, "folder bigint").distinct().collect()]


@query("s21_attach_files", "SELECT doc_id, sha256(text) AS sha2, strlen(text)::BIGINT AS length, md5(text) AS content FROM documents WHERE text <> ''")
def _(spark, sf):
    """Each text as a file of its own; what is kept is put together again from small chunks."""
    path = scratch(spark)
    for folder in text_files(table(spark, sf, "documents").filter("text <> ''"), path + "/in"):
        SN.attach_files(spark, folder, path, chunk=1000)
    # Each file ends with the writer's separator.
    kept = SN.attached_files(spark, path).groupBy("path", "length", "sha2").agg(F.array_sort(F.collect_list(F.struct("chunk", F.hex("content").alias("h")))).alias("c"))
    whole = F.unhex(F.array_join(F.transform("c", lambda x: x["h"]), ""))
    text = F.substring(whole, F.lit(1), (F.col("length") - 1).cast("int"))
    good = F.sha2(whole, 256) == F.col("sha2")
    return kept.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id"), F.when(good, F.sha2(text, 256)).alias("sha2"),
                       (F.col("length") - 1).alias("length"), F.md5(text).alias("content"))


_V4 = "v0 AS a, v1 AS b, v2 AS c, v3 AS d"


def _v4(s):
    return [F.col("v")[i].alias(n) for i, n in enumerate("abcd")]


@query("s10_read_meshes", f"""WITH {LOC}, dense AS (SELECT mesh_id, pid, row_number() OVER (PARTITION BY mesh_id ORDER BY pid) - 1 AS n FROM pts)
 SELECT mesh_id::VARCHAR AS mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY sid) - 1 AS sid, region, CASE WHEN svol < 0 THEN b ELSE a END AS a, CASE WHEN svol < 0 THEN a ELSE b END AS b, c, d FROM vol
 JOIN (SELECT mesh_id, sid, max(n) FILTER (k = 0) AS a, max(n) FILTER (k = 1) AS b, max(n) FILTER (k = 2) AS c, max(n) FILTER (k = 3) AS d FROM corn JOIN dense USING (mesh_id, pid) GROUP BY ALL) USING (mesh_id, sid)""")
def _(spark, sf):
    path = scratch(spark)
    ME.write_meshes(part_mesh(spark, sf, periodic=True), path)
    return ME.read_written_meshes(spark, path).simplices.select("mesh_id", "sid", "region", *_v4("v"))


@query("s15_write_meshes", f"""WITH {LOC}, {FACES} SELECT mesh_id::VARCHAR AS mesh_id, (SELECT count(*) FROM pts WHERE pts.mesh_id = m.mesh_id) AS points, (SELECT round(sum(x), 4) FROM pts WHERE pts.mesh_id = m.mesh_id) AS sx,
 (SELECT round(sum(abs(svol)), 4) FROM vol WHERE vol.mesh_id = m.mesh_id) AS volume FROM (SELECT DISTINCT mesh_id FROM cubes) m""")
def _(spark, sf):
    path = scratch(spark)
    ME.write_meshes(part_mesh(spark, sf), path)
    m = ME.read_written_meshes(spark, path)
    p = m.points.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("points"), r(F.sum(F.col("pos")[0]), 4).alias("sx"))
    return p.join(M.volumes(m).groupBy("mesh_id").agg(r(F.sum("volume"), 4).alias("volume")), "mesh_id")


@query("s11_read_mesh_store", f"""WITH {MESH}, side AS (SELECT mesh_id, (pid // 81) * 9 + pid % 9 AS gid, pid FROM pts WHERE pid % 81 // 9 IN (0, 8))
 SELECT mesh_id, gid, pid FROM side QUALIFY count(*) OVER (PARTITION BY mesh_id, gid) = 2""")
def _(spark, sf):
    path = scratch(spark)
    ME.write_mesh_store(part_mesh(spark, sf, periodic=True), path)
    return ME.read_mesh_store(spark, path).periodic


def _write_lines(df, path):
    """Rows (mesh_id, block, place, value) as one folder per mesh."""
    df = df.repartitionByRange("mesh_id", "block", "place").sortWithinPartitions("mesh_id", "block", "place")
    df.select("value", "mesh_id").write.partitionBy("mesh_id").text(path)


def _dense(spark, sf):
    m, _ = M.sort_mesh(part_mesh(spark, sf), 2)
    return m


def _row(df, block, place, value):
    return df.select("mesh_id", F.lit(block).alias("block"), place.cast("bigint").alias("place"), value.alias("value"))


def _text(a, plus=0):
    return F.array_join(F.transform(a, lambda x: (x + plus).cast("string")), " ")


def _count(df):
    return df.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"))


_DENSE = f"""WITH {MESH}, n AS (SELECT mesh_id, pid, row_number() OVER (PARTITION BY mesh_id ORDER BY z, pid) - 1 AS np FROM pts),
 ds AS (SELECT mesh_id, sid, region, max(np) FILTER (k = 0) AS a, max(np) FILTER (k = 1) AS b, max(np) FILTER (k = 2) AS c, max(np) FILTER (k = 3) AS d FROM corn JOIN n USING (mesh_id, pid) GROUP BY ALL)"""


@query("s12_read_netgen", f"{_DENSE} SELECT mesh_id::VARCHAR AS mesh_id, region, a, b, c, d FROM ds")
def _(spark, sf):
    m, path = _dense(spark, sf), scratch(spark)
    lines = _row(_count(m.points), 0, F.lit(0), F.col("n").cast("string")).unionByName(_row(m.points, 1, F.col("pid"), _text("pos")))
    lines = lines.unionByName(_row(_count(m.simplices), 2, F.lit(0), F.col("n").cast("string")))
    lines = lines.unionByName(_row(m.simplices, 3, F.col("sid"), F.concat(F.col("region").cast("string"), F.lit("  "), _text("v", 1))))
    _write_lines(lines, path)
    out = ME.read_meshes(spark, path + "/mesh_id=*", "netgen", folder=r"mesh_id=([^/]+)/")
    return out.simplices.select("mesh_id", "region", *_v4("v"))


@query("s13_read_gambit", f"{_DENSE} SELECT mesh_id::VARCHAR AS mesh_id, (4 - region)::INT AS region, a, b, c, d FROM ds")
def _(spark, sf):
    """Element numbers are listed by region from the last to the first; a fall begins a new group."""
    m, path = _dense(spark, sf), scratch(spark)
    from stepfield.plans.ordered import dense_ids
    s = dense_ids(m.simplices.withColumnRenamed("sid", "old"), ["mesh_id"], ["region", "old"], "number")
    listed = dense_ids(s.withColumn("_g", -F.col("region")), ["mesh_id"], ["_g", "number"], "o")
    c = _count(m.points).join(_count(m.simplices).withColumnRenamed("n", "e"), "mesh_id")
    top = c.select("mesh_id", F.posexplode(F.array(*[F.lit(f"header {i}") for i in range(6)], F.format_string("%d %d 3 1 3 3", "n", "e"), F.lit("end"), F.lit("nodes"))).alias("p", "v"))
    lines = _row(top, 0, F.col("p"), F.col("v")).unionByName(_row(m.points, 1, F.col("pid"), F.concat((F.col("pid") + 1).cast("string"), F.lit(" "), _text("pos"))))
    two = c.select("mesh_id", F.posexplode(F.array(F.lit("end"), F.lit("elements"))).alias("p", "v"))
    lines = lines.unionByName(_row(two, 2, F.col("p"), F.col("v")))
    lines = lines.unionByName(_row(s, 3, F.col("number"), F.concat((F.col("number") + 1).cast("string"), F.lit(" 6 4 "), _text("v", 1))))
    five = c.select("mesh_id", F.posexplode(F.array(*[F.lit("group")] * 5)).alias("p", "v"))
    lines = lines.unionByName(_row(five, 4, F.col("p"), F.col("v")))
    tens = listed.groupBy("mesh_id", F.floor(F.col("o") / 10).alias("l")).agg(F.array_sort(F.collect_list(F.struct("o", "number"))).alias("x"))
    lines = lines.unionByName(_row(tens, 5, F.col("l"), F.array_join(F.transform("x", lambda e: (e["number"] + 1).cast("string")), " ")))
    _write_lines(lines, path)
    out = ME.read_meshes(spark, path + "/mesh_id=*", "gambit", folder=r"mesh_id=([^/]+)/")
    return out.simplices.select("mesh_id", "region", *_v4("v"))


def _gmsh(spark, sf, path):
    m = _dense(spark, sf)
    lines = None
    for b, s in ((0, "$NOD"), (3, "$ENDNOD"), (4, "$ELM"), (8, "$ENDELM")):
        x = _row(_count(m.points), b, F.lit(0), F.lit(s))
        lines = x if lines is None else lines.unionByName(x)
    lines = lines.unionByName(_row(_count(m.points), 1, F.lit(0), F.col("n").cast("string")))
    lines = lines.unionByName(_row(m.points, 2, F.col("pid"), F.concat((F.col("pid") * 2 + 5).cast("string"), F.lit(" "), _text("pos"))))
    lines = lines.unionByName(_row(_count(m.simplices), 5, F.lit(0), F.col("n").cast("string")))
    tri = m.simplices.filter("sid % 9 = 0")
    ends = F.array_join(F.transform("v", lambda x: (x * 2 + 5).cast("string")), " ")
    lines = lines.unionByName(_row(tri, 6, F.col("sid"), F.concat(F.lit("1 2 1 1 3 "), F.array_join(F.slice(F.split(ends, " "), 1, 3), " "))))
    lines = lines.unionByName(_row(m.simplices, 7, F.col("sid"), F.concat((F.col("sid") + 1).cast("string"), F.lit(" 4 "), F.col("region").cast("string"), F.lit(" 1 4 "), ends)))
    _write_lines(lines, path)
    return path + "/mesh_id=*"


@query("s14_read_gmsh", f"{_DENSE} SELECT mesh_id::VARCHAR AS mesh_id, region, a, b, c, d FROM ds")
def _(spark, sf):
    out = ME.read_meshes(spark, _gmsh(spark, sf, scratch(spark)), "gmsh1", folder=r"mesh_id=([^/]+)/")
    return out.simplices.select("mesh_id", "region", *_v4("v"))


@query("s14_gmsh_report", f"WITH {MESH} SELECT mesh_id::VARCHAR AS mesh_id, 'type 2' AS what, count(*) AS n FROM simp WHERE sid % 9 = 0 GROUP BY mesh_id")
def _(spark, sf):
    return ME.gmsh_report(spark, _gmsh(spark, sf, scratch(spark)), r"mesh_id=([^/]+)/")


@query("s16_read_grids", """SELECT 'g0' AS grid_id, p_partkey % 10 AS ix, p_partkey % 200 // 10 AS iy, p_partkey // 200 AS iz, round(1 + 0.5 * (p_partkey % 10), 6)::DOUBLE AS x, round(2.0 * (p_partkey // 200), 6)::DOUBLE AS z,
 p_retailprice AS a, p_size::DOUBLE AS b FROM part""")
def _(spark, sf):
    path = scratch(spark)
    g = part_grid(spark, sf).withColumns({"grid_id": F.lit("g0"), "x": 1 + 0.5 * F.col("ix"), "y": F.col("iy") * 1.0, "z": 2.0 * F.col("iz")})
    GR.write_grids(g, path, (0.5, 1.0, 2.0))
    out = GR.read_grids(spark, path + "/grid_id=*", r"grid_id=([^/]+)/")
    return out.select("grid_id", "ix", "iy", "iz", r("x"), r("z"), F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


def _blocks(spark, sf, **only):
    """The parts as two binary grids of layers of 10 x 20 nodes, read by ranges of a few records."""
    path = scratch(spark)
    g = part_grid(spark, sf).withColumns({"x": 1 + 0.5 * F.col("ix"), "y": F.col("iy") * 1.0, "z": 2.0 * F.col("iz")})
    whole = g.groupBy("iz").count().filter("count = 200").select("iz").agg(F.max("iz")).first()[0]
    g = g.filter(F.col("iz") <= whole)
    two = g.withColumn("grid_id", F.explode(F.array(F.lit("g0"), F.lit("g1")))).withColumn("v", F.when(F.col("grid_id") == "g1", F.transform("v", lambda c: -c)).otherwise(F.col("v")))
    GB.write_grid_blocks(two, path, (0.5, 1.0, 2.0))
    return GB.read_grid_blocks(spark, path, split=1 << 12, **only)


_WHOLE = "full_layers AS (SELECT max(iz) AS top FROM (SELECT p_partkey // 200 AS iz FROM part GROUP BY 1 HAVING count(*) = 200))"
_NODES = """SELECT {id} AS grid_id, p_partkey % 10 AS ix, p_partkey % 200 // 10 AS iy, p_partkey // 200 AS iz, round(1 + 0.5 * (p_partkey % 10), 6)::DOUBLE AS x, round(2.0 * (p_partkey // 200), 6)::DOUBLE AS z,
 {sign} * p_retailprice AS a, {sign} * p_size::DOUBLE AS b FROM part, full_layers WHERE p_partkey // 200 <= top"""


@query("s16_grid_blocks", f"WITH {_WHOLE} {_NODES.format(id="'g0'", sign=1)} UNION ALL {_NODES.format(id="'g1'", sign=-1)}")
def _(spark, sf):
    """Binary grids, written and read again; one file is read by many tasks."""
    out = _blocks(spark, sf)
    return out.select("grid_id", "ix", "iy", "iz", r("x"), r("z"), F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query("s16_grid_layers", f"WITH {_WHOLE} SELECT grid_id, iz, count(*) AS n, round(sum(a), 4) AS a FROM ({_NODES.format(id="'g1'", sign=-1)}) WHERE iz <= 2 GROUP BY ALL")
def _(spark, sf):
    """Some layers of one grid: other files and records are not read."""
    out = _blocks(spark, sf, grids=["g1"], layers=(0, 2))
    return out.groupBy("grid_id", "iz").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("v")[0]), 4).alias("a"))
