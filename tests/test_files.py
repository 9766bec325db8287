import os
import pathlib
import struct

import pytest
from pyspark.sql import functions as F

from stepfield.checks import QUERIES, stores
from stepfield.sources import grids as GR
from stepfield.sources import runs as RU
from stepfield.sources import snapshots as SN
from stepfield.sources.lines import numbered_lines


def put(path, text):
    path.write_text(text)
    return str(path)


def test_runs_with_different_columns(spark, tmp_path):
    put(tmp_path / "one_dat.ndt", "#time m_0 m_1\n#<s> <> <>\n0 1 2\n1e-1  3 -4.5\n")
    put(tmp_path / "two_dat.ndt", "#time E\n#<s> <J>\n7 8\n")
    df = RU.read_runs(spark, str(tmp_path))
    assert df.columns[0] == "run_id" and set(df.columns[1:]) == {"time", "m_0", "m_1", "E"}
    got = {(r.run_id, r.time, r.m_1, r.E) for r in df.collect()}
    assert got == {("one", 0.0, 2.0, None), ("one", 0.1, -4.5, None), ("two", 7.0, None, 8.0)}
    cols = {(r.run_id, r["name"], r.pos, r.unit) for r in RU.read_columns(spark, str(tmp_path)).collect()}
    assert ("two", "E", 1, "J") in cols and ("one", "m_1", 2, "") in cols


def test_text_and_time_columns_stay(spark, tmp_path):
    put(tmp_path / "a.ndt", "# step  localtime  note\n# <> <> <>\n\n 1 2024/02/03-04:05:06 cold\n 2 2024/02/03-04:05:07 **\n")
    rows = RU.read_runs(spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.step, str(r.localtime), r.note) for r in rows] == [(1.0, "2024-02-03 04:05:06", "cold"), (2.0, "2024-02-03 04:05:07", "**")]
    df = spark.createDataFrame([("r", 1.0, rows[0].localtime, "x"), ("r", None, None, None)], "run_id string, v double, at timestamp_ntz, note string")
    RU.write_runs_text(df, str(tmp_path / "out"), ["v"])
    back = {(str(r.v), str(r.at), r.note) for r in RU.read_runs_text(spark, str(tmp_path / "out"), {"at": "string"}).collect()}
    assert back == {("1.0", "2024/02/03-04:05:06", "x"), ("nan", "-", "-")}


@pytest.mark.parametrize("row,reason", [("3", "width"), ("3 4 5", "width"), ("3 **", "number")])
def test_broken_rows_are_told(spark, tmp_path, row, reason):
    put(tmp_path / "a.ndt", f"#t v\n#<s> <>\n1 2\n{row}\n")
    with pytest.raises(Exception):
        RU.read_runs(spark, str(tmp_path)).collect()
    got = RU.rejected_rows(spark, str(tmp_path)).collect()
    assert [(r.line, r.value, r.reason) for r in got] == [(3, row, reason)]


def test_odt_needs_one_header(spark, tmp_path):
    put(tmp_path / "a.odt", "# ODT 1.0\n# Columns: {A b} c\n# Columns: d\n# Units: s m\n1 2\n")
    with pytest.raises(ValueError):
        RU.read_runs(spark, str(tmp_path), fmt="odt")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    put(tmp_path / "big.txt", "".join(f"line {i}\n" for i in range(5000)))
    put(tmp_path / "small.txt", "x\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = numbered_lines(spark, str(tmp_path)).filter("file like '%big%'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.value) for r in got) == [(i, f"line {i}") for i in range(5000)]


def test_append_refuses_other_columns(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", 1, 0.5)], "run_id string, step bigint, e double")
    RU.append_runs(df, path)
    with pytest.raises(ValueError):
        RU.append_runs(df.withColumnRenamed("e", "x"), path)
    RU.append_runs(df.select("e", "run_id", "step"), path)
    assert spark.read.parquet(path).count() == 2


def test_long_runs_become_several_files(spark, tmp_path):
    df = spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").cast("double").alias("t"), (F.col("id") / 3).alias("v"))
    path = str(tmp_path / "text")
    RU.write_runs_text(df, path, ["t"], rows_per_file=60, fmt="%25.17g")
    assert len(list((tmp_path / "text" / "run_id=r").glob("part*"))) > 4
    back = RU.read_runs_text(spark, path).orderBy("t").collect()
    assert [(r.t, r.v) for r in back] == [(float(i), i / 3) for i in range(500)]


def test_memory_log(spark, tmp_path):
    put(tmp_path / "x.log", "noise\nab Memory report: T= 1.5 VMEM= 300KB RSS= 200KB reading mesh \n")
    row = RU.read_memory_log(spark, str(tmp_path)).first()
    assert (row.time, row.vmem, row.rss, row.tag) == (1.5, 300, 200, "reading mesh")


STEP, BASE, SHAPE = (0.25, 0.5, 2.0), (-1.0, 3.0, 0.125), (7, 4)


def grid(spark, layers):
    """A polynomial vector field on a 7 x 4 x layers lattice with different steps."""
    n = SHAPE[0] * SHAPE[1]
    at = {"ix": F.col("id") % SHAPE[0], "iy": F.floor(F.col("id") / SHAPE[0]) % SHAPE[1], "iz": F.floor(F.col("id") / n)}
    rows = spark.range(n * layers).select(F.lit("g").alias("grid_id"), *[c.alias(k) for k, c in at.items()])
    rows = rows.withColumns({a: BASE[i] + F.col(f"i{a}") * STEP[i] for i, a in enumerate("xyz")})
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return rows.withColumn("v", F.array(x * y - z, 1 / (3 + x * x), y - 7 * z * z))


@pytest.mark.parametrize("layers", [1, 3])
def test_text_grid_round_trip(spark, tmp_path, layers):
    g = grid(spark, layers)
    GR.write_grids(g, str(tmp_path / "g"), STEP)
    back = GR.read_grids(spark, str(tmp_path / "g") + "/grid_id=*", r"grid_id=([^/]+)/")
    b = back.select("ix", "iy", "iz", F.col("x").alias("bx"), F.col("v").alias("w"))
    both = g.join(b, ["ix", "iy", "iz"]).collect()
    assert len(both) == 28 * layers
    assert all(r.x == r.bx and list(r.v) == list(r.w) for r in both)


@pytest.mark.parametrize("size", [4, 8])
@pytest.mark.parametrize("second", [True, False])
def test_binary_grid(spark, tmp_path, size, second):
    rows = sorted(grid(spark, 3).collect(), key=lambda r: (r.iz, r.iy, r.ix))
    mark = 1234567.0 if size == 4 else 123456789012345.0
    order = "<" if second else ">"
    kind = order + ("f" if size == 4 else "d")
    data = b"".join(struct.pack(kind, x) for x in [mark] + [c for r in rows for c in r.v])
    title = "# OOMMF OVF 2.0\n" if second else "# OOMMF: rectangular mesh v1.0\n"
    head = title + "# Begin: Header\n" + ("# valuedim: 3\n" if second else "# valuemultiplier: 1\n")
    for a, n, base, step in zip("xyz", (*SHAPE, 3), BASE, STEP):
        head += f"# {a}nodes: {n}\n# {a}base: {base}\n# {a}stepsize: {step}\n"
    head += f"# End: Header\n# Begin: Data Binary {size}\n"
    (tmp_path / "b.ovf").write_bytes(head.encode() + data + f"\n# End: Data Binary {size}\n".encode())
    back = {(r.ix, r.iy, r.iz): r for r in GR.read_binary_grids(spark, str(tmp_path)).collect()}
    assert len(back) == len(rows)
    for r in rows:
        stored = [struct.unpack(kind, struct.pack(kind, c))[0] for c in r.v]
        assert list(back[(r.ix, r.iy, r.iz)].v) == stored


def test_attached_files_come_back_from_chunks(spark, tmp_path):
    put(tmp_path / "f.txt", "0123456789" * 10 + "end")
    SN.attach_files(spark, str(tmp_path / "*.txt"), str(tmp_path / "s"), chunk=10)
    rows = sorted(SN.attached_files(spark, str(tmp_path / "s")).collect(), key=lambda r: (r.path, r.chunk))
    assert b"".join(bytes(r.content) for r in rows if r.path.endswith("f.txt")) == b"0123456789" * 10 + b"end"
    assert len([r for r in rows if r.path.endswith("f.txt")]) == 11 and {r.length for r in rows} == {103}


def test_many_small_files_are_few_tasks(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    for i in range(1000):
        put(tmp_path / "in" / f"f{i}.txt", str(i))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    SN.attach_files(spark, str(tmp_path / "in"), str(tmp_path / "s"))
    rows = SN.attached_files(spark, str(tmp_path / "s"))
    assert {(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in rows.collect()} == {(f"f{i}.txt", str(i).encode()) for i in range(1000)}
    assert len(rows.inputFiles()) <= 16 and spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_texts_are_written_to_bounded_folders(spark, tmp_path, monkeypatch):
    texts = [(i % 90, f"t{i % 45}") for i in range(180)] + [(None, "x")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stores, "FILES", 50)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    folders = stores.text_files(docs, f"{tmp_path}/in")
    got = {f: p.read_bytes() for folder in folders for f in os.listdir(folder) for p in [pathlib.Path(folder, f)]}
    assert len(folders) == 4 and len(got) == 91
    assert all(got[f"doc_id={i}"] == f"t{i % 45}\x01".encode() * 2 for i in range(90))
    assert got["doc_id=__HIVE_DEFAULT_PARTITION__"] == b"x\x01"
    docs.filter("doc_id is not null").write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert QUERIES["s21_attach_files"](spark, f"{tmp_path}/sf").count() == 90
