"""Vector-grid files (S-16)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.functions.text import fold_key
from stepfield.plans.ordered import dense_ids
from stepfield.sources.lines import file_stem, is_data, numbered_lines, tokens


def read_grid_headers(spark: SparkSession, path) -> DataFrame:
    """grid_id and a map of the header entries, keys in lower case without blanks."""
    lines = numbered_lines(spark, path).filter(F.col("value").rlike(r"^#\s*[^#:]+:"))
    return _headers(lines)


def _headers(lines):
    entry = lines.select(file_stem().alias("grid_id"), fold_key(F.regexp_extract("value", r"^#\s*([^:]+):", 1)).alias("k"),
                         F.trim(F.regexp_extract("value", r"^#\s*[^:]+:\s*(.*)$", 1)).alias("v"))
    # Sections and descriptions repeat their key; one of them is kept.
    once = entry.filter(~F.col("k").isin("begin", "end", "desc")).groupBy("grid_id", "k").agg(F.max("v").alias("v"))
    return once.groupBy("grid_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("header"))


def _place(df: DataFrame) -> DataFrame:
    """Indices and positions from the running number n, x fastest."""
    num = lambda k: F.col("header")[k].cast("double")
    nx, ny = num("xnodes").cast("bigint"), num("ynodes").cast("bigint")
    df = df.withColumns({"ix": F.col("n") % nx, "iy": F.floor(F.col("n") / nx).cast("bigint") % ny, "iz": F.floor(F.col("n") / (nx * ny)).cast("bigint")})
    pos = {a: num(f"{a}base") + F.col(f"i{a}") * num(f"{a}stepsize") for a in "xyz"}
    factor = F.coalesce(num("valuemultiplier"), F.lit(1.0))
    return df.withColumns(pos).select("grid_id", "ix", "iy", "iz", "x", "y", "z", F.transform("v", lambda c: c * factor).alias("v"))


def read_grids(spark: SparkSession, path, folder: str | None = None) -> DataFrame:
    """Text data blocks of many grid files as rows grid_id, ix, iy, iz, x, y, z, v."""
    lines = numbered_lines(spark, path, folder)
    heads = _headers(lines.filter(F.col("value").rlike(r"^#\s*[^#:]+:")))
    body = lines.filter(is_data()).select(file_stem().alias("grid_id"), "line", F.transform(tokens(), lambda t: t.try_cast("double")).alias("v"))
    start = body.groupBy("grid_id").agg(F.min("line").alias("_first"))
    return _place(body.join(start, "grid_id").withColumn("n", F.col("line") - F.col("_first")).join(heads, "grid_id"))


def read_binary_grids(spark: SparkSession, path) -> DataFrame:
    """The same for binary 4 and 8 data blocks. A file is one value, so it is limited to what one task
    can hold; larger grids come as text or as several files."""
    def parse(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                head, _, rest = bytes(content).partition(b"# Begin: Data Binary ")
                size = int(rest[:1])
                text = head.decode("latin-1").lower().replace(" ", "")
                second = "oommf:ovf2" in text or "oommfovf2.0" in text
                entries = dict(x[1:].split(":", 1) for x in text.splitlines() if x.startswith("#") and ":" in x)
                n = int(entries["xnodes"]) * int(entries["ynodes"]) * int(entries["znodes"])
                width = int(entries.get("valuedim", 3))
                data = rest[rest.index(b"\n") + 1:]
                kind = ("<" if second else ">") + f"f{size}"
                values = np.frombuffer(data, dtype=kind, count=1 + n * width)
                if abs(values[0] - (1234567.0 if size == 4 else 123456789012345.0)) > 0:
                    raise ValueError(f"{file}: wrong check value")
                yield pd.DataFrame({"file": file, "n": np.arange(n), "v": list(values[1:].reshape(n, width).astype("float64"))})

    files = spark.read.format("binaryFile").load(path)
    body = files.select("path", "content").mapInPandas(parse, "file string, n bigint, v array<double>").withColumn("grid_id", file_stem())
    # Header lines are text up to the data block; longer or broken lines behind it do not match.
    heads = _headers(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").rlike(r"^# [A-Za-z ]+: *[-+A-Za-z0-9. ]*$")))
    return _place(body.join(heads, "grid_id"))


def grid_lines(grid: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Text data blocks with header as rows (grid_id, place, line), x fastest."""
    rows = dense_ids(grid, ["grid_id"], ["iz", "iy", "ix"], "place")
    body = rows.select("grid_id", "place", F.array_join(F.transform("v", lambda c: c.cast("string")), " ").alias("line"))
    size = grid.groupBy("grid_id").agg(*[(F.max(f"i{a}") + 1).alias(f"n{a}") for a in "xyz"], *[F.min(a).alias(f"b{a}") for a in "xyz"], F.max(F.size("v")).alias("w"))
    keys = [F.lit("# OOMMF: rectangular mesh v2.0"), F.lit("# Begin: Header"), F.concat(F.lit("# valuedim: "), F.col("w").cast("string"))]
    for a, step in zip("xyz", spacing):
        keys += [F.concat(F.lit(f"# {a}nodes: "), F.col(f"n{a}").cast("string")), F.concat(F.lit(f"# {a}base: "), F.col(f"b{a}").cast("string")), F.lit(f"# {a}stepsize: {float(step)!r}")]
    keys += [F.lit("# End: Header"), F.lit("# Begin: Data Text")]
    top = size.select("grid_id", F.posexplode(F.array(*keys)).alias("p", "line")).select("grid_id", (F.col("p") - 100).cast("bigint").alias("place"), "line")
    end = size.select("grid_id", F.lit(2**62).cast("bigint").alias("place"), F.lit("# End: Data Text").alias("line"))
    return body.unionByName(top).unionByName(end)


def write_grids(grid: DataFrame, path: str, spacing: tuple[float, float, float]) -> None:
    """One folder per grid; its part files together are the grid file."""
    lines = grid_lines(grid, spacing).withColumn("_p", F.col("place"))
    lines.repartitionByRange("grid_id", "_p").sortWithinPartitions("grid_id", "_p").select("line", "grid_id").write.partitionBy("grid_id").text(path)
