"""Physical units as data: a factor and seven integer exponents (P-08, P-09, H-17, H-18, H-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.functions.vec import col

# Order of the base units, and the derived units in terms of them.
BASE_UNITS = ["m", "kg", "s", "A", "K", "mol", "cd"]
DERIVED_UNITS = {
    "J": [2, 1, -2, 0, 0, 0, 0],
    "N": [1, 1, -2, 0, 0, 0, 0],
    "W": [2, 1, -3, 0, 0, 0, 0],
    "T": [0, 1, -2, -1, 0, 0, 0],
    "V": [2, 1, -3, -1, 0, 0, 0],
    "C": [0, 0, 1, 1, 0, 0, 0],
    "Ohm": [2, 1, -3, -2, 0, 0, 0],
    "H": [2, 1, -2, -2, 0, 0, 0],
}
_DIMS = {**{u: [int(i == k) for i in range(7)] for k, u in enumerate(BASE_UNITS)}, **DERIVED_UNITS}
_PART = r"(/?)\s*([A-Za-z]+)(?:\s*\^\s*\(?\s*([-+]?\d+)\s*\)?)?"


def dims_literal(dims) -> Column:
    return F.array(*[F.lit(int(d)) for d in dims])


def zero() -> Column:
    return dims_literal([0] * 7)


def parse_unit(text) -> Column:
    """Seven exponents of a unit text such as ``A/m`` or ``kg m^2 s^(-2)``; ``<…>`` is allowed,
    an unknown name is an error, and so is anything that isn't a unit with a whole power. A slash acts on the
    one unit after it."""
    given = col(text)
    text = F.regexp_replace(F.trim(F.regexp_replace(given, "^<(.*)>$", "$1")), r"^1(?![0-9.])\s*", "")
    readable = text.rlike(rf"^(?:{_PART}[\s*]*)*$")
    text = F.when(readable | text.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("not a unit: "), given)).cast("string"))
    table = F.create_map(*[x for u, d in _DIMS.items() for x in (F.lit(u), dims_literal(d))])
    marks = [F.regexp_extract_all(text, F.lit(_PART), F.lit(k)) for k in (1, 2, 3)]
    rows = F.arrays_zip(*[m.alias(n) for m, n in zip(marks, "sup")])

    def add(acc, r):
        dims = F.coalesce(table[r["u"]],
                          F.raise_error(F.concat(F.lit("unknown unit "), r["u"])).cast("array<int>"))
        power = F.when(r["p"] == "", F.lit(1)).otherwise(r["p"].try_cast("int"))
        signed = F.when(r["s"] == "/", -power).otherwise(power)
        return F.zip_with(acc, dims, lambda a, d: (a + d * signed).cast("int"))

    return F.aggregate(rows, zero(), add)


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once: the expression holds it in one place."""
    return F.transform(F.array(value), fn)[0]


def unit_text(dims, value=1.0) -> Column:
    """Dense text, ``<A/m>`` or ``<1e+06A/m>``: positive powers, then the negative ones after a slash."""
    value = value if isinstance(value, Column) else F.lit(float(value))

    def powers(dims, sign):
        named = [F.when(dims[i] * sign == 1, F.lit(u))
                 .when(dims[i] * sign > 1, F.concat(F.lit(u + "^"), (dims[i] * sign).cast("string")))
                 .otherwise(F.lit("")) for i, u in enumerate(BASE_UNITS)]
        return F.concat(*named)

    def join(up, down):
        return F.concat(up, F.when(down != "", F.concat(F.lit("/"), down)).otherwise(F.lit("")))

    unit = bind(col(dims), lambda d: join(powers(d, 1), powers(d, -1)))
    body = bind(unit, lambda u: F.when(value == 1.0, F.when(u == "", F.lit("1")).otherwise(u)).otherwise(
        F.concat(general(value), u)))
    return F.concat(F.lit("<"), body, F.lit(">"))


def general(x, digits: int = 6) -> Column:
    """The C ``%g`` text of a double: ``digits`` significant digits, exponent form when needed,
    no trailing zeros."""
    x = col(x)

    def layout(sci):
        exponent = F.split(sci, "e")[1].cast("int")
        mantissa = F.regexp_extract(sci, r"^-?([0-9.]+)e", 1)
        figures = F.regexp_replace(F.translate(mantissa, ".", ""), "0+$", "")
        sign = F.when(F.startswith(sci, F.lit("-")), "-").otherwise("")
        whole = F.rpad(F.substring(figures, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
        rest = F.substring(figures, exponent + 2, F.lit(400))
        fixed = F.when(exponent >= 0, F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))).otherwise(
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), figures))
        tail = F.substring(figures, F.lit(2), F.lit(400))
        power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
        short = F.concat(F.substring(figures, F.lit(1), F.lit(1)), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), power)
        return F.concat(sign, F.when((exponent < -4) | (exponent >= digits), short).otherwise(fixed))

    # The inner function binds the formatted text, so that it is made once.
    text = bind(F.format_string(f"%.{digits - 1}e", x), layout)
    return (F.when(x.isNull(), None).when(x == 0, "0").when(F.isnan(x), "nan")
            .when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text))


def quantity(value, dims) -> Column:
    return F.struct(col(value).cast("double").alias("value"), col(dims).alias("dims"))


def compatible(a, b) -> Column:
    """Same exponents; the number 0 goes with everything."""
    a, b = col(a), col(b)
    return (a["dims"] == b["dims"]) | (a["value"] == 0) | (b["value"] == 0)


def _need(ok, value, message):
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def in_units_of(q, unit) -> Column:
    """Number of ``unit`` in ``q``; incompatible units are an error."""
    q, unit = col(q), col(unit)
    return _need(compatible(q, unit), q["value"] / unit["value"], "incompatible units")


def q_add(a, b) -> Column:
    a, b = col(a), col(b)
    dims = F.when(a["value"] == 0, b["dims"]).otherwise(a["dims"])
    return quantity(_need(compatible(a, b), a["value"] + b["value"], "incompatible units"), dims)


def q_sub(a, b) -> Column:
    b = col(b)
    return q_add(a, quantity(-b["value"], b["dims"]))


def q_mul(a, b) -> Column:
    a, b = col(a), col(b)
    return quantity(a["value"] * b["value"], F.zip_with(a["dims"], b["dims"], lambda x, y: x + y))


def q_div(a, b) -> Column:
    a, b = col(a), col(b)
    return quantity(a["value"] / b["value"], F.zip_with(a["dims"], b["dims"], lambda x, y: x - y))


def q_pow(a, n: int) -> Column:
    if int(n) != n:
        raise ValueError("only integer powers")
    a = col(a)
    return quantity(F.pow(a["value"], F.lit(float(n))), F.transform(a["dims"], lambda d: d * int(n)))


def to_simulation(value, dims, scales: dict[str, float]) -> Column:
    """SI value to simulation units: times every base scale to the negative exponent."""
    dims = col(dims)
    out = col(value)
    for i, u in enumerate(BASE_UNITS):
        if u in scales:
            out = out * F.pow(F.lit(float(scales[u])), -dims[i])
    return out


def to_si(value, dims, scales: dict[str, float]) -> Column:
    dims = col(dims)
    out = col(value)
    for i, u in enumerate(BASE_UNITS):
        if u in scales:
            out = out * F.pow(F.lit(float(scales[u])), dims[i])
    return out


def convert_units(df: DataFrame, columns: dict[str, str], scales: dict[str, float], to: str = "simulation") -> DataFrame:
    """Convert the columns named in ``columns`` (name to unit text) between SI and simulation units."""
    step = to_simulation if to == "simulation" else to_si
    return df.withColumns({c: step(c, parse_unit(F.lit(u)), scales) for c, u in columns.items()})


def vector_text(quantities) -> Column:
    """``[0 123 0]<A/m>`` for an array of quantities; every one with its unit when they differ."""
    def number(q):
        return general(q["value"])

    def text(qs):
        live = F.filter(qs, lambda q: q["value"] != 0)
        first = F.coalesce(F.get(live, F.lit(0))["dims"], F.get(F.filter(qs, lambda q: q["dims"] != zero()), F.lit(0))["dims"], zero())

        def with_unit(dims):
            same = F.forall(live, lambda q: q["dims"] == dims)
            numbers = F.concat(F.lit("["), F.array_join(F.transform(qs, number), " "), F.lit("]"))
            mixed = F.concat(F.lit("["), F.array_join(F.transform(qs, lambda q: F.concat(number(q), unit_text(q["dims"]))), ", "), F.lit("]"))
            return F.when(same, F.concat(numbers, F.when(dims == zero(), F.lit("")).otherwise(unit_text(dims)))).otherwise(mixed)

        return bind(first, with_unit)

    return bind(col(quantities), text)
