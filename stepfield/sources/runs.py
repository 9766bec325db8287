"""Run tables in files (S-01 … S-05, S-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.plans.skewed import demand, need
from stepfield.sources.lines import NUMBER, file_stem, numbered_lines, raw_lines, tokens

#: Form of a moment in a text column, and its pattern for the readers.
MOMENT, MOMENT_PATTERN = "yyyy/MM/dd-HH:mm:ss", r"^\d{4}/\d{2}/\d{2}-\d{2}:\d{2}:\d{2}$"


def _bare(c):
    """Line without a leading hash."""
    return F.regexp_replace(c, r"^\s*#", "")


def _words(c):
    return F.split(F.btrim(c, F.lit(" \t\r")), r"\s+")


def _is_row(first_line: int):
    """A row of data: behind the header by its line number, not blank and not a comment."""
    return (F.col("line") >= first_line) & (F.trim("value") != "") & ~F.ltrim("value").startswith("#")


def _top_lines(spark: SparkSession, path) -> DataFrame:
    """file, line, value of the first split of each file."""
    raw = raw_lines(spark, path).filter(F.col("block") == 0)
    first = raw.groupBy("file").agg(F.min("mark").alias("_first"))
    return raw.join(first, "file").select("file", (F.col("mark") - F.col("_first")).alias("line"), "value")


def read_headers(spark: SparkSession, path, fmt: str = "text", names_line: int = 0, units_line: int = 1) -> DataFrame:
    """One row per file: file, names, units, first (tokens of the first data row).

    Lines are counted from 0. A few values per file are kept, whatever the number of its lines.
    """
    top = _top_lines(spark, path)
    row = _is_row(0 if fmt == "odt" else max(names_line, units_line) + 1)
    first = F.min_by(tokens(), F.when(row, F.col("line"))).alias("first")
    if fmt == "odt":
        kind = F.when(F.col("value").startswith("# Columns:"), "names").when(F.col("value").startswith("# Units:"), "units")
        body = F.regexp_extract("value", r"^# (?:Columns|Units):(.*)$", 1)
        words = F.transform(F.regexp_extract_all(body, F.lit(r"(\{[^}]*\}|[^\s{}]+)"), F.lit(1)),
                            lambda w: F.translate(F.regexp_replace(w, "[{}]", ""), " ", "_"))
        marked = top.withColumns({"_k": kind, "_w": words})
        out = marked.groupBy("file").agg(
            F.count(F.when(F.col("_k") == "names", 1)).alias("_n"), F.count(F.when(F.col("_k") == "units", 1)).alias("_u"),
            F.min_by("_w", F.when(F.col("_k") == "names", F.col("line"))).alias("names"),
            F.min_by("_w", F.when(F.col("_k") == "units", F.col("line"))).alias("units"), first)
        demand(out, "_n <> 1 or _u <> 1", "a file needs exactly one Columns and one Units line")
        return out.select("file", "names", "units", "first")
    line = lambda k: F.max(F.when(F.col("line") == k, _words(_bare(F.col("value")))))
    return top.groupBy("file").agg(line(names_line).alias("names"), line(units_line).alias("units"), first)


def _types(heads: DataFrame) -> dict[str, str]:
    """Type of each column in the order of the files' headers, from the files' first data rows: double,
    timestamp, or text where any file has something else. One row per column comes to the driver."""
    token = F.col("c.first")
    kind = F.when(token.isNull(), 0).when(token.rlike(rf"^(?:{NUMBER})$"), 1).when(token.rlike(MOMENT_PATTERN), 2).otherwise(3)
    cells = heads.select(F.posexplode(F.arrays_zip("names", "first")).alias("pos", "c")).select(F.col("c.names").alias("name"), "pos", kind.alias("kind"))
    found = cells.filter("name is not null").groupBy("name").agg(F.min("pos").alias("pos"), F.collect_set(F.nullif("kind", F.lit(0))).alias("kinds"))
    return {row["name"]: {(2,): "timestamp_ntz", (3,): "string"}.get(tuple(row.kinds), "double" if set(row.kinds) <= {1} else "string")
            for row in found.orderBy("pos", "name").collect()}


def _cell(token, name: str, kind: str):
    """A token as a value; what can't be read stops the job."""
    if kind == "string":
        return token.alias(name)
    value = token.try_cast("double") if kind == "double" else F.try_to_timestamp(token, F.lit(MOMENT)).cast("timestamp_ntz")
    return F.when(token.isNull(), F.lit(None).cast(kind)).otherwise(need(value, f"unreadable {kind} in column {name}", kind)).alias(name)


def _rows(lines: DataFrame, heads: DataFrame, run_id, first_line: int, types: dict[str, str] | None) -> DataFrame:
    """run_id and every column of the files; rows that are too short or too long stop the job."""
    kinds = {**_types(heads), **(types or {})}
    layouts = heads.select("names").distinct().limit(2).collect()
    data = lines.filter(_is_row(first_line)).select("file", tokens().alias("t"))
    if len(layouts) == 1:
        names = list(layouts[0].names)
        t = need(F.col("t"), f"a row does not have {len(names)} tokens", "array<string>", F.size("t") == len(names))
        data = data.withColumn("t", t)
        return data.select(run_id, *[_cell(F.get("t", F.lit(i)), n, kinds[n]) for i, n in enumerate(names)])
    data = data.join(heads.select("file", "names"), "file")
    t = need(F.col("t"), "a row does not have as many tokens as its header", "array<string>", F.size("t") == F.size("names"))
    data = data.select("file", F.map_from_arrays("names", t).alias("t"))
    return data.select(run_id, *[_cell(F.col("t")[n], n, kind) for n, kind in kinds.items()])


def read_runs(spark: SparkSession, path, fmt: str = "text", names_line: int = 0, units_line: int = 1, types: dict[str, str] | None = None) -> DataFrame:
    """Many run tables as one DataFrame: run_id (file name), then every column found; NULL where a file lacks
    the column. ``types`` overrules the types told by the first data rows (double, timestamp_ntz, string).
    When all files agree on their columns the data need no join."""
    heads = read_headers(spark, path, fmt, names_line, units_line)
    return _rows(numbered_lines(spark, path), heads, file_stem().alias("run_id"), 0 if fmt == "odt" else max(names_line, units_line) + 1, types)


def rejected_rows(spark: SparkSession, path, fmt: str = "text", names_line: int = 0, units_line: int = 1) -> DataFrame:
    """file, line, value, reason of the rows that ``read_runs`` would stop at."""
    heads = read_headers(spark, path, fmt, names_line, units_line)
    numbers = [n for n, kind in _types(heads).items() if kind == "double"]
    rows = numbered_lines(spark, path).filter(_is_row(0 if fmt == "odt" else max(names_line, units_line) + 1))
    rows = rows.join(heads.select("file", "names"), "file").withColumn("t", tokens())
    bad = F.exists(F.arrays_zip("names", "t"), lambda c: c["names"].isin(numbers) & c["t"].try_cast("double").isNull())
    reason = F.when(F.size("t") != F.size("names"), "width").when(bad, "number")
    return rows.withColumn("reason", reason).filter("reason is not null").select("file", "line", "value", "reason")


def read_columns(spark: SparkSession, path, **kw) -> DataFrame:
    """Columns dimension: run_id, name, pos, unit (without its angle brackets)."""
    both = read_headers(spark, path, **kw).select(file_stem().alias("run_id"), F.posexplode(F.arrays_zip("names", "units")).alias("pos", "c"))
    return both.select("run_id", F.col("c.names").alias("name"), "pos", F.regexp_replace("c.units", "[<>]", "").alias("unit"))


def append_runs(df: DataFrame, path: str) -> None:
    """Append rows to a run store partitioned by run_id; once created its columns are fixed."""
    try:
        have = df.sparkSession.read.parquet(path).schema
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    if have is not None:
        unknown = set(df.columns) - set(have.names)
        missing = set(have.names) - set(df.columns)
        if unknown or missing:
            raise ValueError(f"unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in have])
    # Rows are dealt by all their values, so that a long run is written by all tasks.
    df.repartition(*df.columns).sortWithinPartitions("run_id").write.mode("append").partitionBy("run_id").parquet(path)


def write_runs_text(df: DataFrame, path: str, order: list[str], units: dict[str, str] | None = None, fmt: str = "%25.13g",
                    rows_per_file: int = 1_000_000) -> None:
    """Text tables, a folder per run: names line, units line, then the rows in order.

    Rows are range partitioned by (run, order), so a long run becomes several files, each with its header.
    Numbers are written as C's %g does, timestamps as ``MOMENT``, other columns as they are (a text with white
    space stops the job). NULL is ``nan`` in numbers and ``-`` elsewhere.
    """
    names = [c for c in df.columns if c != "run_id"]
    from stepfield.functions.units import general
    digits = int(fmt.strip("%g").split(".")[1])
    width = int(fmt.strip("%g").split(".")[0])
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def cell(c: str):
        if kinds[c] in ("timestamp", "timestamp_ntz"):
            text = F.coalesce(F.date_format(c, MOMENT), F.lit("-"))
        elif kinds[c] in ("string", "date", "boolean"):
            text = F.coalesce(F.col(c).cast("string"), F.lit("-"))
            text = need(text, f"column {c} has a text with white space, or an empty one", "string", text.rlike(r"^\S+$"))
        else:
            text = F.coalesce(general(F.col(c).cast("double"), digits), F.lit("nan"))
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))

    cells = [cell(c) for c in names]
    head = ["#" + " ".join(n.rjust(width) for n in names), "#" + " ".join(f"<{(units or {}).get(n, '')}>".rjust(width) for n in names)]
    parts = max(1, -(-df.count() // rows_per_file))
    lines = df.repartitionByRange(parts, "run_id", *order).sortWithinPartitions("run_id", *order).select(
        F.col("run_id").cast("string").alias("run_id"), F.concat_ws(" ", *cells).alias("value"))

    def with_headers(batches):
        last = None
        for pdf in batches:
            fresh = pdf["run_id"].ne(pdf["run_id"].shift()).to_numpy(copy=True)
            if len(pdf):
                fresh[0] = pdf["run_id"].iloc[0] != last
                last = pdf["run_id"].iloc[-1]
            pdf.loc[fresh, "value"] = "\n".join(head) + "\n" + pdf.loc[fresh, "value"]
            yield pdf

    out = lines.mapInPandas(with_headers, "run_id string, value string").withColumn("_n", F.monotonically_increasing_id())
    out.sortWithinPartitions("run_id", "_n").select("value", "run_id").write.partitionBy("run_id").text(path)


def read_runs_text(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Tables written by ``write_runs_text``, with run_id from the folder."""
    files = path + "/run_id=*"
    run_id = F.regexp_extract("file", r"run_id=([^/]+)/", 1).alias("run_id")
    return _rows(numbered_lines(spark, files), read_headers(spark, files), run_id, 2, types)


def memory_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(time, vmem, rss, tag) from ``Memory report: T=… VMEM=…KB RSS=…KB tag`` lines among others."""
    pattern = r"T=\s*([0-9.eE+-]+)\s*VMEM=\s*(\d+)\s*KB RSS=\s*(\d+)\s*KB\s*(.*)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    hits = lines.filter(F.col(column).contains("Memory report:") & F.col(column).rlike(pattern))
    keep = [c for c in lines.columns if c != column]
    return hits.select(*keep, part(1).cast("double").alias("time"), part(2).cast("bigint").alias("vmem"),
                       part(3).cast("bigint").alias("rss"), F.trim(part(4)).alias("tag"))


def read_memory_log(spark: SparkSession, path) -> DataFrame:
    return memory_log(raw_lines(spark, path).select("file", "value"))
