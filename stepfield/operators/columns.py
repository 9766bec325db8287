"""Column selection and arithmetic on wide run tables (P-01 … P-04, P-12, P-13, T-03, A-20, A-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.plans.ordered import Ordered


def resolve(columns: list[str], token, several: bool = False) -> list[str]:
    """Column names meant by a token: an index, else an exact name, else a part of one name."""
    if isinstance(token, int) or str(token).lstrip("-").isdigit():
        return [columns[int(token)]]
    if token in columns:
        return [token]
    found = [c for c in columns if token in c]
    if not found:
        raise ValueError(f"no column matches {token!r}; there are {columns}")
    if len(found) > 1 and not several:
        raise ValueError(f"{len(found)} columns contain {token!r}: {found}")
    return found


def select_cols(df: DataFrame, *tokens, several: bool = False) -> DataFrame:
    names = [n for t in tokens for n in resolve(df.columns, t, several)]
    return df.select(*names)


def scale_cols(df: DataFrame, factors: dict, selected: list | None = None) -> DataFrame:
    """Multiply columns by factors; with ``selected`` only those of them that are selected."""
    chosen = None if selected is None else {n for t in selected for n in resolve(df.columns, t)}
    out = {}
    for token, factor in factors.items():
        name = resolve(df.columns, token)[0]
        if chosen is None or name in chosen:
            out[name] = F.col(name) * float(factor)
    return df.withColumns(out)


def magnitude(df: DataFrame, names: str, prefix: str = "mod_") -> DataFrame:
    """Add the root of the sum of squares over all columns containing ``name_``, per listed name."""
    out = {}
    for name in names.split(","):
        stem = name if name.endswith("_") else name + "_"
        squares = [F.col(c) * F.col(c) for c in resolve(df.columns, stem, several=True)]
        total = squares[0]
        for s in squares[1:]:
            total = total + s
        out[prefix + stem.rstrip("_")] = F.sqrt(total)
    return df.withColumns(out)


def describe_cols(df: DataFrame, order: list[str], units: dict[str, str] | None = None) -> DataFrame:
    """Position, name, unit and first value (in ``order``) of every column: ``first`` for numbers, ``text`` for
    all others; one aggregate."""
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}
    first = df.agg(*[F.min_by(F.col(c).cast("double" if c in numbers else "string"), F.struct(*order)).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), F.lit((units or {}).get(c, "")).alias("unit"),
                     (F.col(c) if c in numbers else F.lit(None).cast("double")).alias("first"),
                     (F.lit(None).cast("string") if c in numbers else F.col(c)).alias("text")) for i, c in enumerate(df.columns)]
    return first.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def occurrences(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def short_list(df: DataFrame, by: list[str], order: list[str], limit: int = 10, tail: int = 3, **kw) -> DataFrame:
    """All rows of a list shorter than ``limit``, else its first ``limit - tail`` and last ``tail`` rows."""
    scan = Ordered(df, by, order, **kw).position("_up").position("_down", backwards=True)
    head = F.col("_up") <= limit - tail
    whole = F.col("_up") + F.col("_down") - 1 < limit
    return scan.df.filter(head | whole | (F.col("_down") <= tail)).drop("_up", "_down")


def order_fields(df: DataFrame, column: str = "field") -> DataFrame:
    """Names starting with m, then with M, then the others, each in alphabetical order."""
    c = F.col(column)
    rank = F.when(c.startswith("m"), 0).when(c.startswith("M"), 1).otherwise(2)
    return df.orderBy(rank, c)


def sample_max_mean(df: DataFrame, value: str, key: list[str], n: int, seed: int = 0, margin: float = 1.12) -> DataFrame:
    """Maximum times ``margin`` and mean over a repeatable sample of ``n`` rows chosen by key hash."""
    drawn = df.select(*key, value).orderBy(F.md5(F.concat_ws("-", F.lit(seed), *key)), *key).limit(n)
    return drawn.agg((F.max(value) * margin).alias("max"), F.avg(value).alias("mean"))
