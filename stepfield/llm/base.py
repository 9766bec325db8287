"""Helpers of the operators: columns by role, whole-text byte views, registry of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfield.session import shared_folder

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def lower_ascii_sql(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{UPPER.lower()}')"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The identity and text of each row; columns of other names go, whatever they are called."""
    return docs.select("doc_id", "text", *more)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, sig, text: rows that share a doc_id but not the text have different ``sig``."""
    return docs.select("doc_id", F.xxhash64("text").alias("sig"), "text")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id's text has remainder 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sampled(rows: DataFrame, label: str, counts: dict, most: int) -> DataFrame:
    """doc_id and label of at most ``most`` rows of each label: those whose ids have the smallest hashes.

    ``counts`` has the rows of each label; hashes far beyond the smallest ones go before the shuffle,
    so the tasks that rank a label get some multiple of ``most`` rows, whatever the size of the table.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    enough = [(k, int(min(1.0, (4 * most + 32) / n) * 2**53)) for k, n in counts.items()]
    near = rows.select("doc_id", label, h.alias("h"))
    if len(enough) <= 64:
        near = near.filter(F.col("h") <= F.create_map(*[F.lit(x) for pair in enough for x in pair])[F.col(label)])
    else:  # a map is searched entry by entry
        kind = rows.schema[label].dataType.simpleString()
        limits = rows.sparkSession.createDataFrame(enough, f"{label} {kind}, enough long")
        near = near.join(F.broadcast(limits), label).filter("h <= enough").select("doc_id", label, "h")
    order = Window.partitionBy(label).orderBy("h", "doc_id")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("doc_id", label).distinct()


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the submitter chose for the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and is not made twice."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary array and the n+1 offsets of its rows; null rows are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets.astype(np.int64)


def slabs(offsets: np.ndarray, size: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes and at most ``rows`` rows, at least one row each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, a + rows, max(a + 1, b))
        yield a, b
        a = b


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spaced(text: bytes, table: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about ``size`` bytes; ``table`` maps bytes between words to spaces."""
    if len(text) <= size:
        yield text.translate(table).split()
        return
    plain, at = text.translate(table), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
