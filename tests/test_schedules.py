"""Schedules, sequences and units against brute force and spelled-out cases."""

import random

import pytest
from pyspark.sql import functions as F

from stepfield.functions import sequences as Q
from stepfield.functions import text, units
from stepfield.functions.when import at, every, never, next_time
from stepfield.streaming.live import scheduled


def brute_next(due, after, limit=500):
    """The smallest whole number above ``after`` that is due."""
    return next((n for n in range(after + 1, limit) if due(n)), None)


@pytest.mark.parametrize("seed", range(6))
def test_every_by_brute_force(spark, seed):
    rng = random.Random(seed)
    step, first = rng.randint(1, 9), rng.randint(0, 12)
    last = None if seed % 2 else first + rng.randint(0, 40)
    due = lambda n: n >= first and (last is None or n <= last) and (n - first) % step == 0
    w = every("x", step, first=first, last=last)
    df = spark.range(70).withColumnRenamed("id", "x")
    for row in next_time(df.withColumn("m", w.matches()), w, "x").collect():
        assert row.m == due(row.x) and row.next == brute_next(due, row.x)


@pytest.mark.parametrize("seed", range(4))
def test_trees_of_two_variables_by_brute_force(spark, seed):
    """Sums of products of rules on x and y, against trying every following y."""
    rng = random.Random(100 + seed)
    terms = [(rng.randint(1, 4), rng.randint(0, 2), rng.randint(1, 7), rng.randint(0, 5)) for _ in range(rng.randint(1, 3))]
    w, due = None, lambda x, y: any(x >= b and (x - b) % a == 0 and y >= d and (y - d) % c == 0 for a, b, c, d in terms)
    for a, b, c, d in terms:
        term = every("x", a, first=b) & every("y", c, first=d)
        w = term if w is None else w | term
    df = spark.range(6 * 45).select((F.col("id") % 6).alias("x"), F.floor(F.col("id") / 6).alias("y"))
    for row in next_time(df.withColumn("m", w.matches()), w, "y").collect():
        assert row.m == due(row.x, row.y) and row.next == brute_next(lambda y: due(row.x, y), row.y)


def test_and_of_one_variable(spark):
    w = every("x", 4, first=2) & every("x", 6)
    for row in next_time(spark.range(60).withColumnRenamed("id", "x"), w, "x").collect():
        assert row.next == min(n for n in range(row.x + 1, 200) if n >= 2 and (n - 2) % 4 == 0 and n % 6 == 0)
    rng = random.Random(77)
    for _ in range(4):
        a, b, c, d, top = rng.randint(1, 12), rng.randint(0, 9), rng.randint(1, 12), rng.randint(0, 9), rng.randint(20, 60)
        w = every("x", a, first=b) & (every("x", c, first=d, last=top) | at("x", 33))
        due = lambda n: n >= b and (n - b) % a == 0 and (d <= n <= top and (n - d) % c == 0 or n == 33)
        for row in next_time(spark.range(50).withColumnRenamed("id", "x"), w, "x").collect():
            assert row.next == brute_next(due, row.x)
    far = every("x", 1) & every("x", 10**6, first=7)
    assert [r.next for r in next_time(spark.range(3).select((F.col("id") * 10**6).alias("x")), far, "x").collect()] == [7, 1000007, 2000007]
    odd = every("x", 2) & every("x", 2, first=1)
    assert all(r.next is None for r in next_time(spark.range(5).withColumnRenamed("id", "x"), odd, "x").collect())


def test_errors_and_never(spark):
    for bad in (lambda: every("x", 0), lambda: every("x", 1, first=3, last=2), lambda: every(3)):
        with pytest.raises(ValueError):
            bad()
    assert spark.range(3).filter(never.matches()).count() == 0
    with pytest.raises(ValueError):
        scheduled(spark.range(1), [("a", every("id", 1)), ("a", at("id", 3))])


def spelled_out(stretches):
    """A sequence from (start, step, count, end): count equal steps, then the end."""
    out = []
    for start, step, count, end in stretches:
        own = [start + i * step for i in range(count + 1)]
        own = own + [end] if abs(own[-1] - end) > 1e-9 else own[:-1] + [end]
        out += own[1:] if out else own
    return out


@pytest.mark.parametrize("spec,stretches", [
    ([2, 2.25, [], 4], [(2, 0.25, 8, 4)]),
    ([7, 5.5, [], -2], [(7, -1.5, 6, -2)]),
    ([1, 1.3, "...", 2], [(1, 0.3, 3, 2)]),
    ([0, 0.7, [], 4.9], [(0, 0.7, 7, 4.9)]),
    ([-1, [4], 1], [(-1, 0.5, 4, 1)]),
    ([0, [2], 3, 4, [], 6.5], [(0, 1.5, 2, 3), (3, 1, 3, 6.5)]),
    ([4, 3, [], 1, 1.5, [], 3], [(4, -1, 3, 1), (1, 0.5, 4, 3)]),
    ([11], [(11, 1, 0, 11)]),
])
def test_sequences(spark, spec, stretches):
    got, want = spark.range(1).select(Q.float_set(spec)).first()[0], spelled_out(stretches)
    assert len(got) == len(want) and all(abs(a - b) < 1e-12 for a, b in zip(got, want))
    assert got[-1] == want[-1]


def test_whole_steps_are_counted_despite_rounding(spark):
    for n in (3, 6, 7, 29, 57):
        got = spark.range(1).select(Q.float_set([0, 0.1, [], n * 0.1])).first()[0]
        assert len(got) == n + 1 and got[-1] == n * 0.1


def test_sequence_errors(spark):
    for bad in ([1, [], 3], [0, [2]], [[3], 1]):
        with pytest.raises(ValueError):
            Q.float_set(bad)
    with pytest.raises(Exception):
        spark.range(1).select(Q.float_set([0, 5, [], 3])).collect()


def test_lattice(spark):
    lat = Q.Lattice.parse("0,1,3/2/5,6,2")
    rows = lat.rows(spark).collect()
    assert lat.count == 6 == len(rows)
    assert sorted({(r.x, r.y, r.z) for r in rows}) == [(x, 2.0, z) for x in (0, 0.5, 1) for z in (5, 6)]
    # An axis of one point yields exactly its position.
    assert {r.iy for r in rows} == {0}
    near = spark.createDataFrame([(0.25,), (0.74,), (-0.3,)], "x double").select(lat.nearest(0, "x")).collect()
    assert [r[0] for r in near] == [1, 1, -1]


@pytest.mark.parametrize("values,want", [
    ([(7, "T"), (-2.5, "T")], "[7 -2.5]<kg/s^2A>"),
    ([(0, None), (4, "m")], "[0 4]<m>"),
    ([(0, None), (0, "s"), (8, "s")], "[0 0 8]<s>"),
    ([(25000000, "m/s"), (0, "m/s")], "[2.5e+07 0]<m/s>"),
    ([(3, None)], "[3]"),
    ([(3, "m"), (5, "kg")], "[3<m>, 5<kg>]"),
])
def test_vector_text(spark, values, want):
    qs = F.array(*[units.quantity(F.lit(float(v)), units.zero() if u is None else units.parse_unit(F.lit(u))) for v, u in values])
    assert spark.range(1).select(units.vector_text(qs)).first()[0] == want


def test_general_format(spark):
    xs = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 1e-5, 0.0001, 1e300, -3.25e-7, 99999.96, 100.0, 0.1]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(units.general("x")).collect()] == ["%g" % x for x in xs]
    assert [r[0] for r in df.select(units.general("x", 13)).collect()] == ["%.13g" % x for x in xs]


def test_unit_errors(spark):
    one = spark.range(1)
    for text in ("parsec", "m^(1/2)", "A/m*??3", "m 2", "^2"):
        with pytest.raises(Exception):
            one.select(units.parse_unit(F.lit(text))).collect()
    a, b = [units.quantity(F.lit(1.0), units.parse_unit(F.lit(u))) for u in ("m", "s")]
    with pytest.raises(Exception):
        one.select(units.q_add(a, b)).collect()
    with pytest.raises(ValueError):
        units.q_pow(a, 0.5)
    got = one.select(units.unit_text(units.parse_unit(F.lit("T m/A"))), units.unit_text(units.parse_unit(F.lit("A/m")), 1e6)).first()
    assert tuple(got) == ("<mkg/s^2A^2>", "<1e+06A/m>")


def test_norm_key(spark):
    got = spark.createDataFrame([("Save  Fields",), ("save_fields",)], "k string").select(text.norm_key("k")).collect()
    assert {r[0] for r in got} == {"save_fields"}


def test_fixed_format(spark):
    xs = [0.105, 0.115, 2.675, 1.005, -0.125, 0.375, 12345.678, 0.0, 99.995, -3.14159, 0.004999, 1e12 + 0.125, 2.0**53 + 2, 2.0**62, 4503599627370497.5, -0.0005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(text.fixed("x", 2)).collect()] == ["%.2f" % x for x in xs]
    assert [r[0] for r in df.select(text.fixed("x", 6)).collect()] == ["%.6f" % x for x in xs]


def test_lcm_of_large_numbers(spark):
    import math

    from stepfield.functions import vec
    pairs = [(2**40 * 3, 2**41), (9007199254740993, 3), (0, 5), (-6, 4), (3**30, 3**29 * 7)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert [r[0] for r in df.select(vec.lcm("a", "b")).collect()] == [math.lcm(a, b) for a, b in pairs]
