"""Text helpers (H-19, H-20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfield.functions.units import bind
from stepfield.functions.vec import col


def fixed(x, digits: int) -> Column:
    """The C ``%.<digits>f`` text of a double below 2^63, rounded by its exact binary value (at most 6 digits).

    Java rounds the shortest decimal text instead, which differs at apparent ties. The whole part and the
    fraction of a double are exact; the fraction's product with 10^digits is taken together with its rounding
    error, so the comparison with one half is exact whatever the size.
    """
    ten, base = 10.0 ** digits, 10 ** digits

    def rounded(p):
        floor = F.floor(p["product"]).cast("double")
        excess = p["product"] - floor - 0.5
        odd = F.when(floor % 2 == 1, True).otherwise((p["whole"] % 2 == 1) & F.lit(digits == 0))
        up = (excess > -p["error"]) | ((excess == -p["error"]) & odd)
        return F.struct(p["whole"].alias("whole"), (floor + F.when(up, 1.0).otherwise(0.0)).cast("bigint").alias("rest"))

    def digits_of(n):
        carried = (n["whole"] + F.when(n["rest"] == base, 1).otherwise(0)).cast("string")
        return F.concat(carried, F.lit("."), F.lpad((n["rest"] % base).cast("string"), digits, "0"))

    def split(size):
        whole = F.floor(size).cast("bigint")
        rest = size - whole.cast("double")
        high = rest * 134217729.0 - (rest * 134217729.0 - rest)
        return F.struct(whole.alias("whole"), (rest * ten).alias("product"), ((high * ten - rest * ten) + (rest - high) * ten).alias("error"))

    def text(x):
        size = F.abs(x)
        return F.concat(F.when(x < 0, "-").otherwise(""), F.when(size < 2.0**63, bind(bind(split(size), rounded), digits_of)).otherwise(
            F.format_string(f"%.{digits}f", size)))

    return bind(col(x), text)


def fmt_time(t) -> Column:
    """Seconds as ``12.50 ps`` below 100 ps, else ``0.25 ns``."""
    ps = col(t) / 1e-12
    return F.when(ps < 100.0, F.concat(fixed(ps, 2), F.lit(" ps"))).otherwise(F.concat(fixed(ps / 1000.0, 2), F.lit(" ns")))


def norm_key(c) -> Column:
    """Option text: lower case, each run of blanks and underscores as one underscore."""
    return F.regexp_replace(F.lower(col(c)), r"[ \t_]+", "_")


def fold_key(c) -> Column:
    """Header key: lower case without blanks."""
    return F.regexp_replace(F.lower(col(c)), r"[ \t\n]", "")
