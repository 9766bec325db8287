"""Binary grid files by byte ranges (S-16).

A data source whose splits are ranges of bytes: each task reads the file's header and the records (one per node, of fixed size) that
begin in its range, so one large file is read by many tasks and held by none. Wanted grids choose files before they
are opened, wanted layers ``iz`` cut the ranges, as x runs fastest and layers are consecutive records. Both are options of the
read: Spark keeps pushed filters in the loaded table, so a second query on it without filters would miss rows.

Files are opened through Arrow's file systems, so paths may be local, ``file:`` or any scheme that Arrow knows. A wrong
check value, a header without its entries and a file that is too short are errors; a grid of no nodes has no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "grid_id string, ix bigint, iy bigint, iz bigint, x double, y double, z double, v array<double>"
#: Nodes read at a time; bytes within which a header ends.
ROWS, HEADER = 1 << 16, 1 << 20
# Fixed values of the format: the line before binary data, and the number that stands in front of them by its size.
_BEGIN = re.compile(rb"# Begin: Data Binary ([48])[ \t]*\r?\n", re.I)
CHECKS = {4: 1234567.0, 8: 123456789012345.0}


def open_system(path: str):
    """Arrow's file system for a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Head:
    """What a file's header says: nodes, position of node 0 and steps by axis, values per node, factor, number format, place of the data."""

    nodes: list[int]
    base: list[float]
    step: list[float]
    width: int
    factor: float
    kind: np.dtype
    start: int

    @property
    def many(self) -> int:
        return self.nodes[0] * self.nodes[1] * self.nodes[2]


def read_head(file, path: str, size: int) -> Head:
    plain = file.read_at(min(size, HEADER), 0)
    begin = _BEGIN.search(plain)
    if not begin:
        raise ValueError(f"{path}: no binary data")
    text = plain[:begin.start()].decode("latin-1")
    entries = {}
    for line in text.splitlines():
        key, found, value = line.lstrip("#").partition(":")
        if found:
            entries[key.strip().lower().replace(" ", "")] = value.strip()
    second = "v2" in text.splitlines()[0].lower() or "2.0" in text.splitlines()[0]
    kind = np.dtype(("<" if second else ">") + f"f{begin[1].decode()}")
    try:
        head = Head([int(entries[a + "nodes"]) for a in "xyz"], [float(entries[a + "base"]) for a in "xyz"], [float(entries[a + "stepsize"]) for a in "xyz"],
                    int(entries.get("valuedim", 3)), float(entries.get("valuemultiplier", 1)), kind, begin.end() + kind.itemsize)
    except KeyError as missing:
        raise ValueError(f"{path}: the header has no {missing}") from None
    if np.frombuffer(file.read_at(kind.itemsize, begin.end()), kind, 1)[0] != CHECKS[kind.itemsize]:
        raise ValueError(f"{path}: wrong check value")
    if head.start + head.many * head.width * kind.itemsize > size:
        raise ValueError(f"{path}: the data are cut off")
    return head


@dataclass
class ByteRange(ds.InputPartition):
    path: str
    size: int
    first: int
    last: int


class GridReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.grids = set(json.loads(options["grids"])) if "grids" in options else None
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[ds.InputPartition]:
        from pyarrow import fs

        system, path = open_system(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        hidden = lambda f: f.path[len(path):].lstrip("/").startswith((".", "_")) or f.base_name.startswith((".", "_"))
        wanted = [f for f in files if not hidden(f) and (self.grids is None or stem(f.path) in self.grids)]
        return [ByteRange(f.path, f.size, a, min(f.size, a + self.split)) for f in sorted(wanted, key=lambda f: f.path) for a in range(0, f.size, self.split)]

    def read(self, part: ByteRange | None) -> Iterator:
        import pyarrow as pa

        if part is None:  # there is no file
            return
        system, _ = open_system(self.path)
        with system.open_input_file(part.path) as file:
            head = read_head(file, part.path, part.size)
            record, layer = head.width * head.kind.itemsize, head.nodes[0] * head.nodes[1]
            # Records that begin in the range and lie in a wanted layer.
            first, last = (min(head.many, max(0, -(-(at - head.start) // record))) for at in (part.first, part.last))
            first, last = max(first, self.low * layer), min(last, (self.high + 1) * layer)
            for a in range(first, last, ROWS):
                b = min(last, a + ROWS)
                values = np.frombuffer(file.read_at((b - a) * record, head.start + a * record), head.kind).astype("f8") * head.factor
                n = np.arange(a, b)
                at = [n % head.nodes[0], n // head.nodes[0] % head.nodes[1], n // layer]
                pos = [base + i * step for base, i, step in zip(head.base, at, head.step)]
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * head.width, head.width, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([stem(part.path)] * len(n)), *map(pa.array, at), *map(pa.array, pos), v],
                                                 ["grid_id", "ix", "iy", "iz", "x", "y", "z", "v"])


class GridBlocks(ds.DataSource):
    """``spark.read.format("grid_blocks").load(path)``; options ``split`` (bytes of a task), ``grids`` (JSON), ``first`` and ``last`` (layers)."""

    @classmethod
    def name(cls) -> str:
        return "grid_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def read_grid_blocks(spark: SparkSession, path: str, split: int = 64 << 20, grids: list[str] | None = None, layers: tuple[int, int] | None = None) -> DataFrame:
    """Binary grids under a path as rows grid_id (the file's name), ix, iy, iz, x, y, z, v: all, or the named ones, in all layers or from the first to
    the last given; ``split``: bytes read by one task."""
    spark.dataSource.register(GridBlocks)
    reader = spark.read.format("grid_blocks").option("split", split)
    reader = reader if grids is None else reader.option("grids", json.dumps(grids))
    return (reader if layers is None else reader.option("first", layers[0]).option("last", layers[1])).load(path)


def write_grid_blocks(grid: DataFrame, path: str, spacing: tuple[float, float, float], size: int = 8) -> None:
    """One binary file ``<grid_id>.ovf`` per grid, written in order of the nodes by one task that holds a batch at a time.

    A file appears when it is whole; a task that is repeated writes it anew. A missing node, one that is there twice and
    values of unequal length are errors.
    """
    import pyarrow as pa

    axes = [F.max(f"i{a}") + 1 for a in "xyz"]
    heads = grid.groupBy("grid_id").agg(*[c.alias(f"n{a}") for a, c in zip("xyz", axes)], F.max(F.size("v")).alias("w"),
                                        *[F.min(F.struct(f"i{a}", a))[a].alias(f"b{a}") for a in "xyz"])
    rows = grid.select("grid_id", "ix", "iy", "iz", "v").join(heads, "grid_id").withColumn("n", (F.col("iz") * F.col("ny") + F.col("iy")) * F.col("nx") + F.col("ix"))
    rows = rows.select("grid_id", "n", "v", "w", *[f"{k}{a}" for k in "nb" for a in "xyz"])
    kind = np.dtype(f"<f{size}")

    def head(r: dict) -> bytes:
        lines = ["# OOMMF: rectangular mesh v2.0", "# Segment count: 1", "# Begin: Segment", "# Begin: Header", "# meshtype: rectangular", f"# valuedim: {r['w']}"]
        lines += [f"# {a}{name}: {value}" for a, step in zip("xyz", spacing) for name, value in
                  (("nodes", r["n" + a]), ("base", repr(float(r["b" + a]))), ("stepsize", repr(float(step))))]
        return "\n".join([*lines, "# End: Header", f"# Begin: Data Binary {size}", ""]).encode() + kind.type(CHECKS[size]).astype(kind).tobytes()

    def write(batches: Iterator) -> Iterator:
        system, folder = open_system(path)
        system.create_dir(folder, recursive=True)
        file = now = None

        def close():
            file.write(f"\n# End: Data Binary {size}\n# End: Segment\n".encode())
            file.close()
            if now["at"] != now["many"]:
                raise ValueError(f"grid {now['id']}: {now['at']} of {now['many']} nodes")
            system.move(now["temp"], f"{folder}/{now['id']}.ovf")
            return pa.RecordBatch.from_arrays([pa.array([now["id"]]), pa.array([now["at"]], pa.int64())], ["grid_id", "nodes"])

        for batch in batches:
            ids = batch.column("grid_id").to_pylist()
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(edges[:-1], edges[1:]):
                if now is None or now["id"] != ids[a]:
                    if now is not None:
                        yield close()
                    r = batch.slice(a, 1).to_pylist()[0]
                    now = {"id": ids[a], "at": 0, "many": r["nx"] * r["ny"] * r["nz"], "w": r["w"], "temp": f"{folder}/.{ids[a]}-{uuid.uuid4().hex}"}
                    file = system.open_output_stream(now["temp"])
                    file.write(head(r))
                part = batch.slice(a, b - a)
                values, n = part.column("v").flatten().to_numpy(), part.column("n").to_numpy()
                if len(values) != (b - a) * now["w"] or (n != np.arange(now["at"], now["at"] + b - a)).any():
                    raise ValueError(f"grid {now['id']}: nodes are missing or repeated, or their values differ in length")
                file.write(values.astype(kind).tobytes())
                now["at"] += b - a
        if now is not None:
            yield close()

    dealt = rows.repartition("grid_id").sortWithinPartitions("grid_id", "n")
    dealt.mapInArrow(write, "grid_id string, nodes bigint").write.format("noop").mode("overwrite").save()
