"""Queries on wide run tables and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.checks.base import EVENTS, event_runs, query, r, table
from stepfield.functions import geometry as g
from stepfield.functions import sequences, text, units, vec
from stepfield.functions.when import at, every, is_integer, next_deltas, next_time, where_when
from stepfield.operators import columns as C
from stepfield.operators import runs as R


def line_runs(spark, sf):
    return table(spark, sf, "lineitem")


@query("p01_select_cols", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax FROM lineitem")
def _(spark, sf):
    return C.select_cols(line_runs(spark, sf), 0, "l_linenumber", "extended", "tax")


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p02_describe_cols", f"""WITH c AS (SELECT column_name AS name, (row_number() OVER (ORDER BY column_index) - 1)::INTEGER AS pos FROM duckdb_columns() WHERE table_name = 'lineitem'),
 f AS (SELECT * FROM lineitem ORDER BY {_KEYS} LIMIT 1),
 v AS (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM f) ON COLUMNS(*) INTO NAME name VALUE v)
 SELECT pos, name, CASE name WHEN 'l_orderkey' THEN 'key' WHEN 'l_quantity' THEN 'pieces' ELSE '' END AS unit,
 CASE WHEN name IN ({", ".join(f"'{n}'" for n in _NUMBERS)}) THEN v::DOUBLE END AS first, CASE WHEN name NOT IN ({", ".join(f"'{n}'" for n in _NUMBERS)}) THEN v END AS text
 FROM c JOIN v USING (name)""")
def _(spark, sf):
    return C.describe_cols(line_runs(spark, sf), _KEYS.split(", "), {"l_orderkey": "key", "l_quantity": "pieces"})


@query("p03_scale_cols", """SELECT l_orderkey, l_linenumber, round(l_quantity * 2.5, 6) AS l_quantity,
 round(l_discount * 100, 6) AS l_discount, l_tax FROM lineitem""")
def _(spark, sf):
    df = C.scale_cols(line_runs(spark, sf), {"quantity": 2.5, "l_discount": 100, "l_tax": 7}, selected=["l_quantity", "l_discount"])
    return df.select("l_orderkey", "l_linenumber", r("l_quantity"), r("l_discount"), "l_tax")


@query("p04_magnitude", """SELECT l_orderkey, l_linenumber,
 round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax), 6) AS mod_m, round(abs(l_extendedprice), 6) AS mod_h FROM lineitem""")
def _(spark, sf):
    named = line_runs(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("m_0"), F.col("l_discount").alias("m_1"),
                                        F.col("l_tax").alias("m_2"), F.col("l_extendedprice").alias("h_0"))
    return C.magnitude(named, "m,h").select("l_orderkey", "l_linenumber", r("mod_m"), r("mod_h"))


@query("run_report", f"""WITH {EVENTS}, n AS (SELECT *, lead(event_type) OVER (PARTITION BY run_id ORDER BY us, event_id) AS nx FROM ev)
 SELECT run_id, event_id, event_type, round(value * 1000.0, 6) AS value, round(sqrt(value*value + time*time), 3) AS mod_v FROM n
 WHERE nx IS NULL OR nx <> event_type""")
def run_report(spark, sf):
    """Flagship: last row of each stage of each run, scaled, with a magnitude."""
    last = R.last_of(event_runs(spark, sf), "event_type", ["run_id"], ["us", "event_id"])
    wide = last.select("run_id", "event_id", "event_type", "value", F.col("value").alias("v_0"), F.col("time").alias("v_1"))
    out = C.scale_cols(C.magnitude(wide, "v"), {"value": 1000.0})
    return out.select("run_id", "event_id", "event_type", r("value"), r("mod_v", 3))


@query("p12_vec_filter", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))), 6) AS n,
 round(embedding[2]::DOUBLE, 6) AS y, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)) - embedding[2]::DOUBLE*embedding[2]::DOUBLE), 5) AS p FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", r(vec.vec_filter("v", "norm")).alias("n"), r(vec.vec_filter("v", "component,y")).alias("y"),
                    r(vec.vec_filter("v", "projection,1"), 5).alias("p"))


@query("p13_complex_filter", """SELECT vec_id, round(sqrt(embedding[1]::DOUBLE**2 + embedding[2]::DOUBLE**2), 6) AS n,
 round(embedding[1]::DOUBLE, 6) AS re, round(embedding[2]::DOUBLE, 6) AS im FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.struct(F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im")).alias("c"))
    return e.select("vec_id", *[r(vec.complex_filter("c", m)).alias(n) for m, n in (("norm", "n"), ("real", "re"), ("imag", "im"))])


@query("t03_short_list", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u,
 count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, event_id FROM n WHERE c < 10 OR u <= 7 OR u > c - 3""")
def _(spark, sf):
    return C.short_list(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("t04_order_fields", """SELECT name, row_number() OVER (ORDER BY CASE WHEN starts_with(name, 'm') THEN 0 WHEN starts_with(name, 'M') THEN 1 ELSE 2 END, name) AS place
 FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.col("p_type").alias("name")).union(p.select(F.lower("p_type"))).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    from stepfield.plans.ordered import Ordered
    ranked = C.order_fields(names, "name").withColumn("_k", F.when(F.col("name").startswith("m"), 0).when(F.col("name").startswith("M"), 1).otherwise(2))
    return Ordered(ranked, [], ["_k", "name"]).position("place").df.drop("_k")


@query("a20_occurrences", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return C.occurrences(line_runs(spark, sf), "l_suppkey")


@query("a29_sample_max_mean", """SELECT round(max(value) * 1.12, 6) AS max, round(avg(value), 6) AS mean
 FROM (SELECT value FROM events ORDER BY md5('7-' || event_id), event_id LIMIT 1000)""")
def _(spark, sf):
    return C.sample_max_mean(table(spark, sf, "events"), "value", ["event_id"], 1000, seed=7).select(r("max"), r("mean"))


# Scheduling

_CLOCK = "clk AS (SELECT l_orderkey, l_linenumber, l_partkey AS step, l_suppkey AS stage_step FROM lineitem)"


def clock(spark, sf):
    return line_runs(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("step"), F.col("l_suppkey").alias("stage_step"))


@query("p26_where_when", f"""WITH {_CLOCK} SELECT * FROM clk WHERE (step >= 3 AND step <= 1500 AND (step - 3) % 7 = 0)
 OR (stage_step = 5) OR (step % 4 = 0 AND stage_step >= 1 AND (stage_step - 1) % 6 = 0)""")
def _(spark, sf):
    w = every("step", 7, first=3, last=1500) | at("stage_step", 5) | (every("step", 4) & every("stage_step", 6, first=1))
    return where_when(clock(spark, sf), w)


@query("p27_next_time", f"""WITH {_CLOCK} SELECT l_orderkey, l_linenumber, step, stage_step,
 CASE WHEN step < 1500 AND (CASE WHEN step < 3 THEN 3 ELSE ((step - 3) // 7 + 1) * 7 + 3 END) <= 1500
  THEN (CASE WHEN step < 3 THEN 3 ELSE ((step - 3) // 7 + 1) * 7 + 3 END)::DOUBLE END AS n1,
 least((step // 10 + 1) * 10, CASE WHEN step < 1000 THEN 1000 END)::DOUBLE AS n2,
 CASE WHEN stage_step % 2 = 0 THEN (step // 5 + 1) * 5 END::DOUBLE AS n3,
 ((step // 12) + 1) * 12.0::DOUBLE AS n4 FROM clk""")
def _(spark, sf):
    df = next_time(clock(spark, sf), every("step", 7, first=3, last=1500), "step", "n1")
    df = next_time(df, every("step", 10) | at("step", 1000), "step", "n2")
    df = next_time(df, every("step", 5) & every("stage_step", 2), "step", "n3")
    return next_time(df, every("step", 4) & every("step", 6), "step", "n4")


@query("st08_next_deltas", f"""WITH {_CLOCK} SELECT l_orderkey, l_linenumber, step, stage_step,
 (least((step // 10 + 1) * 10, (step // 7 + 1) * 7) - step)::DOUBLE AS delta FROM clk""")
def _(spark, sf):
    return next_deltas(clock(spark, sf), [every("step", 10), every("step", 7), every("stage_step", 3)], "step")


@query("h13_is_integer", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity % 3 = 0")
def _(spark, sf):
    return line_runs(spark, sf).filter(is_integer((1.0 / F.lit(3.0)) * F.col("l_quantity"))).select("l_orderkey", "l_linenumber", "l_partkey")


# Scalar functions

@query("h01_vectors", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)), 6) AS n2,
 round(embedding[1]::DOUBLE*embedding[4]::DOUBLE + embedding[2]::DOUBLE*embedding[5]::DOUBLE + embedding[3]::DOUBLE*embedding[6]::DOUBLE, 6) AS d,
 round(embedding[1]::DOUBLE / sqrt(embedding[1]::DOUBLE**2 + embedding[2]::DOUBLE**2 + embedding[3]::DOUBLE**2), 6) AS u, round(embedding[2]::DOUBLE * 3, 6) AS s FROM embeddings""")
def _(spark, sf):
    e = _pairs(spark, sf)
    return e.select("vec_id", r(vec.norm2("embedding")).alias("n2"), r(vec.dot("a", "b", 3)).alias("d"),
                    r(vec.unit("a", 3)[0]).alias("u"), r(vec.scale("a", 3.0)[1]).alias("s"))


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", "label", "embedding", F.slice("embedding", 1, 3).alias("a"), F.slice("embedding", 4, 3).alias("b"), F.slice("embedding", 7, 3).alias("c"))


_ABC = ("emb AS (SELECT vec_id, label, " + ", ".join(f"embedding[{3 * i + j + 1}]::DOUBLE AS {n}{j}" for i, n in enumerate("abcd") for j in range(3)) + " FROM embeddings)")


@query("h02_project", f"WITH {_ABC} SELECT vec_id, round((a0*b0+a1*b1+a2*b2)/sqrt(a0*a0+a1*a1+a2*a2), 6) AS p FROM emb")
def _(spark, sf):
    return _pairs(spark, sf).select("vec_id", r(vec.project("a", "b", 3)).alias("p"))


@query("h03_cross", f"WITH {_ABC} SELECT vec_id, round(a1*b2-a2*b1, 8) AS x, round(a2*b0-a0*b2, 8) AS y, round(a0*b1-a1*b0, 8) AS z FROM emb")
def _(spark, sf):
    v = _pairs(spark, sf).select("vec_id", vec.cross("a", "b").alias("v"))
    return v.select("vec_id", *[r(F.col("v")[i], 8).alias(n) for i, n in enumerate("xyz")])


@query("h04_dist2", f"WITH {_ABC} SELECT vec_id, round((a0-b0)**2+(a1-b1)**2+(a2-b2)**2, 8) AS d FROM emb")
def _(spark, sf):
    return _pairs(spark, sf).select("vec_id", r(vec.dist2("a", "b"), 8).alias("d"))


def _abcd(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[3 * i + j].cast("double").alias(f"{n}{j}") for i, n in enumerate("abcd") for j in range(3)])


def _p(n, d=3):
    return [F.col(f"{n}{j}") for j in range(d)]


@query("h06_tri_area", f"""WITH {_ABC} SELECT vec_id, round(abs((b0-a0)*(c1-a1)-(b1-a1)*(c0-a0))/2, 8) AS flat,
 round(sqrt(((b1-a1)*(c2-a2)-(b2-a2)*(c1-a1))**2+((b2-a2)*(c0-a0)-(b0-a0)*(c2-a2))**2+((b0-a0)*(c1-a1)-(b1-a1)*(c0-a0))**2)/2, 8) AS space FROM emb""")
def _(spark, sf):
    return _abcd(spark, sf).select("vec_id", r(g.tri_area(_p("a", 2), _p("b", 2), _p("c", 2)), 8).alias("flat"),
                                   r(g.tri_area(_p("a"), _p("b"), _p("c")), 8).alias("space"))


@query("h08_tri_angles", f"""WITH {_ABC} SELECT vec_id, round(degrees(acos(least(1, greatest(-1, ((b0-a0)*(c0-a0)+(b1-a1)*(c1-a1))
 /(sqrt((b0-a0)**2+(b1-a1)**2)*sqrt((c0-a0)**2+(c1-a1)**2)))))), 5) AS alpha, 180.0::DOUBLE AS total FROM emb""")
def _(spark, sf):
    x, y, z = g.tri_angles(_p("a", 2), _p("b", 2), _p("c", 2))
    return _abcd(spark, sf).select("vec_id", r(x, 5).alias("alpha"), r(x + y + z, 4).alias("total"))


@query("h10_safe_ratio", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0 ELSE round(abs(-2.0 * l_tax / l_discount), 6) END::DOUBLE AS q FROM lineitem""")
def _(spark, sf):
    return line_runs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", r(vec.safe_ratio("l_tax", "l_discount", -2.0)).alias("q"))


@query("h11_normalise", f"""WITH {_ABC} SELECT vec_id, round(a0/sqrt(a0*a0+a1*a1+a2*a2), 6) AS x, round(a1/sqrt(a0*a0+a1*a1+a2*a2), 6) AS y,
 round(a2/sqrt(a0*a0+a1*a1+a2*a2), 6) AS z FROM emb""")
def _(spark, sf):
    v = _pairs(spark, sf).select("vec_id", vec.normalise("a", 3).alias("v"))
    return v.select("vec_id", *[r(F.col("v")[i]).alias(n) for i, n in enumerate("xyz")])


@query("h12_epsilon_delta", """SELECT l_orderkey, l_linenumber, l_partkey, ((j-i)*(k-i)*(k-j)//2)::INT AS e, (i = j)::INT AS d FROM
 (SELECT *, (l_orderkey % 3)::INT AS i, (l_partkey % 3)::INT AS j, (l_suppkey % 3)::INT AS k FROM lineitem)""")
def _(spark, sf):
    i, j, k = [(F.col(c) % 3) for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    return line_runs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", vec.epsilon(i, j, k).alias("e"), vec.delta(i, j).alias("d"))


@query("h19_fmt_time", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 3e-12 / 1e-12 < 100 THEN printf('%.2f ps', l_quantity * 3e-12 / 1e-12)
 ELSE printf('%.2f ns', l_quantity * 3e-12 / 1e-12 / 1000) END AS t FROM lineitem""")
def _(spark, sf):
    return line_runs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", text.fmt_time(F.col("l_quantity") * 3e-12).alias("t"))


@query("h20_norm_key", r"SELECT p_partkey, regexp_replace(lower(p_type || '  ' || p_name || '_ X'), '[ \t_]+', '_', 'g') AS k FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.norm_key(F.concat("p_type", F.lit("  "), "p_name", F.lit("_ X"))).alias("k"))


@query("h21_round_sig", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_extendedprice = 0 THEN 0 ELSE
 round(l_extendedprice * 10.0 ** (2 - floor(log10(abs(l_extendedprice))))) / 10.0 ** (2 - floor(log10(abs(l_extendedprice)))) END, 6)::DOUBLE AS s FROM lineitem""")
def _(spark, sf):
    return line_runs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", r(vec.round_sig("l_extendedprice", 3)).alias("s"))


@query("h22_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, gcd(l_partkey, l_suppkey)::BIGINT AS g, lcm(l_partkey, l_suppkey)::BIGINT AS l,
 factorial(l_linenumber)::BIGINT AS f, round(radians(l_quantity), 6) AS rad, round(degrees(l_tax), 6) AS deg FROM lineitem""")
def _(spark, sf):
    return line_runs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", vec.gcd("l_partkey", "l_suppkey").alias("g"), vec.lcm("l_partkey", "l_suppkey").alias("l"),
                                       F.factorial("l_linenumber").alias("f"), r(vec.rad("l_quantity")).alias("rad"), r(vec.deg("l_tax")).alias("deg"))


@query("h14_float_set", """WITH s AS (SELECT p_partkey, [0.0, 1.0] || [x * 1.0 for x in range(2, p_size + 2)] || [p_size + 1.5] || [p_size + 1.5 + (i / 4.0) for i in range(1, 5)] AS v FROM part)
 SELECT p_partkey, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v)::DOUBLE, 6) AS x FROM s""")
def _(spark, sf):
    size = F.col("p_size").cast("double")
    v = sequences.float_set([0, 1, [], size + 1.5, [4], size + 2.5])
    return table(spark, sf, "part").select("p_partkey", F.posexplode(v).alias("pos", "x")).select("p_partkey", F.col("pos").cast("bigint").alias("pos"), r("x"))


@query("h15_vector_set", """WITH s AS (SELECT p_partkey, [x * 1.0 for x in range(0, p_size + 2)] AS v FROM part), u AS (SELECT p_partkey, unnest(v)::DOUBLE AS n FROM s)
 SELECT p_partkey, round(n, 6) AS n, round(n / 3.0, 6) AS x, round(n * 2 / 3.0, 6) AS y FROM u""")
def _(spark, sf):
    v = sequences.vector_set([0, 1, [], F.col("p_size").cast("double") + 1.0], [1.0, 2.0, 2.0])
    e = table(spark, sf, "part").select("p_partkey", F.explode(v).alias("w"))
    return e.select("p_partkey", r(vec.norm("w", 3)).alias("n"), r(F.col("w")[0]).alias("x"), r(F.col("w")[1]).alias("y"))


_UNIT = "CASE p_partkey % 4 WHEN 0 THEN 'A/m' WHEN 1 THEN 'm^2 s^(-2)' WHEN 2 THEN 'J/m^3' ELSE '<T>' END"


def _unit_col():
    k = F.col("p_partkey") % 4
    return F.when(k == 0, "A/m").when(k == 1, "m^2 s^(-2)").when(k == 2, "J/m^3").otherwise("<T>")


@query("h17_units", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-1,0,0,1,0,0,0' WHEN 1 THEN '2,0,-2,0,0,0,0' WHEN 2 THEN '-1,1,-2,0,0,0,0' ELSE '0,1,-2,-1,0,0,0' END AS dims,
 CASE p_partkey % 4 WHEN 0 THEN '<A/m>' WHEN 1 THEN '<m^2/s^2>' WHEN 2 THEN '<kg/ms^2>' ELSE '<kg/s^2A>' END AS unit FROM part""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", units.parse_unit(_unit_col()).alias("d"))
    return d.select("p_partkey", F.array_join("d", ",").alias("dims"), units.unit_text("d").alias("unit"))


@query("p08_convert_units", """SELECT p_partkey, round(p_retailprice * 1e-9 / 1e-6, 6) AS a, round(p_retailprice * 1e-6 * 1e-6 / (1e-9*1e-9) / 1e6, 6) AS b FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") / 1e6).alias("b"))
    out = units.convert_units(p, {"a": "A/m", "b": "m^2 s^(-2)"}, {"m": 1e-9, "s": 1e-6, "A": 1e-6}, to="simulation")
    return out.select("p_partkey", r("a").alias("a"), r("b").alias("b"))


# a: SI A/m = value * A^-1 * m; with m = 1e-9 and A = 1e-6 the factor is 1e6 * 1e-9. b: m^-2 * s^2.


@query("p09_in_units_of", "SELECT p_partkey, round(p_retailprice / 250.0, 6) AS n, p_partkey % 4 = 0 AS ok FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("q", units.quantity("p_retailprice", units.parse_unit(F.lit("A/m"))))
    p = p.withColumn("u", units.quantity(F.lit(250.0), units.parse_unit(F.lit("A m^(-1)")))).withColumn("o", units.quantity(F.lit(1.0), units.parse_unit(_unit_col())))
    return p.select("p_partkey", r(units.in_units_of("q", "u")).alias("n"), units.compatible("q", "o").alias("ok"))


@query("h18_quantities", """SELECT p_partkey, round(p_retailprice + 5, 6) AS s, round(p_retailprice * p_size, 6) AS p, '<A^2/m^2>' AS pu,
 round(p_retailprice / p_size, 6) AS q, '<1>' AS qu, round(p_size * p_size, 6)::DOUBLE AS w FROM part""")
def _(spark, sf):
    am = units.parse_unit(F.lit("A/m"))
    p = table(spark, sf, "part").select("p_partkey", units.quantity("p_retailprice", am).alias("a"), units.quantity("p_size", am).alias("b"), units.quantity(F.lit(5.0), am).alias("five"))
    p = p.select("p_partkey", units.q_add("a", "five").alias("s"), units.q_mul("a", "b").alias("p"), units.q_div("a", "b").alias("q"), units.q_pow("b", 2).alias("w"))
    return p.select("p_partkey", r(F.col("s.value")).alias("s"), r(F.col("p.value")).alias("p"), units.unit_text("p.dims").alias("pu"),
                    r(F.col("q.value")).alias("q"), units.unit_text("q.dims").alias("qu"), r(F.col("w.value")).alias("w"))


@query("h26_vector_text", "SELECT p_partkey, printf('[0 %d 0]<A/m>', p_size) AS t FROM part")
def _(spark, sf):
    am = units.parse_unit(F.lit("A/m"))
    q = F.array(units.quantity(F.lit(0.0), units.zero()), units.quantity("p_size", am), units.quantity(F.lit(0.0), units.zero()))
    return table(spark, sf, "part").withColumn("q", q).select("p_partkey", units.vector_text("q").alias("t"))


@query("h25_bodies", f"""WITH {_ABC} SELECT vec_id, round(1 - greatest(abs(a0-0.05)/0.2, abs(a1)/0.1, abs(a2)/0.15), 6) AS box,
 round(1 - (a0/0.2)**2 - (a1/0.1)**2 - (a2/0.3)**2, 6) AS ellipsoid,
 round(least(1 - 2*abs((a2+0.2)/0.4 - 0.5), 0.3 - 0.2*(a2+0.2)/0.4 - sqrt(a0*a0+a1*a1)), 6) AS frustum,
 round(least(1 - 2*abs((a2+0.2)/0.4 - 0.5), (0.2*(1-(a2+0.2)/0.4))**2 - ((a0 - 0.1*(1-(a2+0.2)/0.4)*cos(8*pi()*(a2+0.2)/0.4))**2
   + (a1 - 0.1*(1-(a2+0.2)/0.4)*sin(8*pi()*(a2+0.2)/0.4))**2)), 6) AS helix FROM emb""")
def _(spark, sf):
    a = _p("a")
    return _abcd(spark, sf).select(
        "vec_id", r(g.in_box(a, [-0.15, -0.1, -0.15], [0.25, 0.1, 0.15])).alias("box"), r(g.in_ellipsoid(a, [0.2, 0.1, 0.3])).alias("ellipsoid"),
        r(g.in_frustum(a, [0, 0, -0.2], 0.3, [0, 0, 0.2], 0.1)).alias("frustum"), r(g.in_helix(a, [0, 0, -0.2], 0.1, [0, 0, 0.2], 0.2)).alias("helix"))


@query("h24_transforms", f"""WITH {_ABC} SELECT vec_id, round(a0*cos(0.5) - a1*sin(0.5) + 1, 6) AS x, round((a0*sin(0.5) + a1*cos(0.5)) * 2, 6) AS y,
 round(a2, 6) AS z, round(a1*cos(0.5) - a2*sin(0.5), 6) AS ry FROM emb""")
def _(spark, sf):
    p = _pairs(spark, sf).withColumn("w", vec.rotate("a", 3, 0.5, (0, 1)))
    return p.select("vec_id", r(vec.shift("w", [1.0, 0, 0])[0]).alias("x"), r(vec.scale_by("w", [1.0, 2.0, 1.0])[1]).alias("y"),
                    r(F.col("w")[2]).alias("z"), r(vec.rotate_about("a", [2.0, 0.0, 0.0], 0.5)[1]).alias("ry"))
