"""Text files as rows that know their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?(?:nan|inf|NaN|Inf)"


def raw_lines(spark: SparkSession, path) -> DataFrame:
    """file, block (start of the split in the file), mark (rises within a split), value."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mark"), "value")


def numbered_lines(spark: SparkSession, path, folder: str | None = None) -> DataFrame:
    """file, line (from 0), value. Files stay splittable: lines are counted per split, and the splits
    of a file (one per 128 MB) are added up in their order. With ``folder`` (a pattern with one group)
    all files of a folder count as one, in name order, and ``file`` is the group."""
    raw = raw_lines(spark, path)
    splits = raw.groupBy("file", "block").agg(F.min("mark").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = F.col("file") if folder is None else F.regexp_extract("file", folder, 1)
    before = Window.partitionBy(whole).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return raw.join(splits, ["file", "block"]).select(
        whole.alias("file"), (F.col("mark") - F.col("_first") + F.col("_before")).alias("line"), "value")


def tokens(c="value"):
    return F.split(F.btrim(F.col(c), F.lit(" \t\r")), r"\s+")


def is_data(c="value"):
    """Are all tokens of the line numbers?"""
    return F.col(c).rlike(rf"^\s*(?:{NUMBER})(?:\s+(?:{NUMBER}))*\s*$")


def file_stem(c="file"):
    return F.regexp_extract(F.col(c), r"([^/]+?)(?:_dat)?(?:\.[^./]*)?$", 1)
