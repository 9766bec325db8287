"""Registry of queries with their SQL, and the views of the given tables they run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.operators.mesh import Mesh
from stepfield.plans.skewed import lookup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked (and a test compares it to brute force)."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, digits: int = 6):
    """Rounded double without negative zero, under the column's own name."""
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


# Run tables: events of a user are one run; their time is epoch seconds.

def epoch_us(c):
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def event_runs(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", epoch_us("ts").alias("us"),
        (epoch_us("ts") / 1e6).alias("time"), "event_type", "value")


EVENTS = "ev AS (SELECT user_id AS run_id, event_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS time, event_type, value FROM events)"


# Meshes: part rows are the unit cubes of four blocks, eight by eight across and as long as the table
# makes them; each cube is cut into six tetrahedra around its diagonal. Point ids are x*81 + y*9 + z.
# The points are shifted a little by a rule on their id, so that no two cubes look alike.

_ORDERS = [(81, 9, 1), (81, 1, 9), (9, 81, 1), (9, 1, 81), (1, 81, 9), (1, 9, 81)]


#: Cubes of a task. A row of the table becomes 24 corners and 24 faces, and a file may be read by a single task.
CUBES = 1 << 14


def spread(cubes: DataFrame, rows: int) -> DataFrame:
    """The cubes in as many partitions as their number asks for, neighbours together: eight layers of a mesh lie in one."""
    return cubes.repartition(max(1, -(-rows // CUBES)), "mesh_id", F.floor(F.col("c") / 512))


def part_mesh(spark, sf, flat: bool = False, periodic: bool = False) -> Mesh:
    c = F.floor(F.col("p_partkey") / 4).cast("bigint")
    part = table(spark, sf, "part")
    cubes = spread(part.select(
        (F.col("p_partkey") % 4).alias("mesh_id"), c.alias("c"),
        F.when(F.col("p_size") <= 17, 1).when(F.col("p_size") <= 34, 2).otherwise(3).alias("region")), part.count())
    base = (F.floor(F.col("c") / 64) * 81 + F.floor(F.col("c") % 64 / 8) * 9 + F.col("c") % 8).cast("bigint")
    tets = F.array(*[F.array(base, base + a, base + a + b, base + a + b + e) for a, b, e in _ORDERS])
    simplices = cubes.select("mesh_id", "c", "region", F.posexplode(tets).alias("k", "v")).select(
        "mesh_id", (F.col("c") * 6 + F.col("k")).alias("sid"), "region", "v")
    ids = simplices.select("mesh_id", F.explode("v").alias("pid")).distinct()
    x, y, z = F.floor(F.col("pid") / 81), F.floor(F.col("pid") % 81 / 9), F.col("pid") % 9
    if flat:
        pos = [x.cast("double"), y.cast("double"), z.cast("double")]
    else:
        pos = [x + (F.col("pid") * 7 % 11) / 50.0, y + (F.col("pid") * 5 % 13) / 60.0, z + (F.col("pid") * 3 % 7) / 40.0]
    points = ids.select("mesh_id", "pid", F.array(*pos).alias("pos"))
    groups = None
    if periodic:
        # Points on the first and last layer across are images of each other.
        side = ids.filter(y.isin(0, 8)).select("mesh_id", (x * 9 + z).cast("bigint").alias("gid"), "pid")
        both = side.groupBy("mesh_id", "gid").count().filter("count = 2").drop("count")
        groups = lookup(side, both, ["mesh_id", "gid"])
    return Mesh(points, simplices, 3, groups)


_ORDER_ROWS = ", ".join(f"({k}, {a}, {a + b})" for k, (a, b, _) in enumerate(_ORDERS))

MESH = f"""cubes AS (SELECT p_partkey % 4 AS mesh_id, p_partkey // 4 AS c,
    CASE WHEN p_size <= 17 THEN 1 WHEN p_size <= 34 THEN 2 ELSE 3 END AS region FROM part),
orders6(k, s1, s2) AS (VALUES {_ORDER_ROWS}),
corner0 AS (SELECT mesh_id, c, region, (c // 64) * 81 + (c % 64 // 8) * 9 + c % 8 AS b FROM cubes),
simp AS (SELECT mesh_id, c * 6 + k AS sid, region, b AS v0, b + s1 AS v1, b + s2 AS v2, b + 91 AS v3 FROM corner0, orders6),
corn AS (SELECT mesh_id, sid, region, 0 AS k, v0 AS pid FROM simp UNION ALL SELECT mesh_id, sid, region, 1, v1 FROM simp
    UNION ALL SELECT mesh_id, sid, region, 2, v2 FROM simp UNION ALL SELECT mesh_id, sid, region, 3, v3 FROM simp),
pts AS (SELECT mesh_id, pid, pid // 81 + (pid * 7 % 11) / 50.0::DOUBLE AS x, pid % 81 // 9 + (pid * 5 % 13) / 60.0::DOUBLE AS y,
    pid % 9 + (pid * 3 % 7) / 40.0::DOUBLE AS z FROM (SELECT DISTINCT mesh_id, pid FROM corn))"""

# Coordinates of the four vertices, signed volume, faces, edges and regions of points.
_XYZ = ", ".join(f"max({a}) FILTER (k = {k}) AS {a}{k}" for k in range(4) for a in "xyz")
_PIDS = ", ".join(f"max(pid) FILTER (k = {k}) AS v{k}" for k in range(4))
LOC = MESH + f""",
loc AS (SELECT mesh_id, sid, region, {_PIDS}, {_XYZ} FROM corn JOIN pts USING (mesh_id, pid) GROUP BY mesh_id, sid, region),
vol AS (SELECT *, ((x1-x0)*((y2-y0)*(z3-z0)-(z2-z0)*(y3-y0)) - (y1-y0)*((x2-x0)*(z3-z0)-(z2-z0)*(x3-x0))
    + (z1-z0)*((x2-x0)*(y3-y0)-(y2-y0)*(x3-x0))) / 6.0 AS svol FROM loc)"""

_FACES = " UNION ALL ".join(
    f"SELECT mesh_id, sid, region, list_sort([v{a}, v{b}, v{c}]) AS face FROM simp" for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)))
FACES = f"""fac AS ({_FACES}),
ftab AS (SELECT mesh_id, face, count(*) AS n, min(sid) AS sid_a, max(sid) AS sid_b, min(region) AS low, max(region) AS high
    FROM fac GROUP BY mesh_id, face)"""
EDGES = """edg AS (SELECT DISTINCT mesh_id, least(a.pid, b.pid) AS src, greatest(a.pid, b.pid) AS dst
    FROM corn a JOIN corn b USING (mesh_id, sid) WHERE a.k < b.k)"""
ELEN = """elen AS (SELECT e.mesh_id, src, dst, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS length
    FROM edg e JOIN pts a ON a.mesh_id = e.mesh_id AND a.pid = src JOIN pts b ON b.mesh_id = e.mesh_id AND b.pid = dst)"""
PREG = """preg AS (SELECT DISTINCT mesh_id, pid, region FROM corn
    UNION SELECT mesh_id, unnest(face), -1 FROM ftab WHERE n = 1)"""
QUAL = """len6 AS (SELECT mesh_id, sid, region, abs(svol) AS v,
    sqrt((x0-x1)**2+(y0-y1)**2+(z0-z1)**2) AS e01, sqrt((x0-x2)**2+(y0-y2)**2+(z0-z2)**2) AS e02,
    sqrt((x0-x3)**2+(y0-y3)**2+(z0-z3)**2) AS e03, sqrt((x1-x2)**2+(y1-y2)**2+(z1-z2)**2) AS e12,
    sqrt((x1-x3)**2+(y1-y3)**2+(z1-z3)**2) AS e13, sqrt((x2-x3)**2+(y2-y3)**2+(z2-z3)**2) AS e23 FROM vol),
heron AS (SELECT *, (e12+e13+e23)/2 AS h0, (e02+e03+e23)/2 AS h1, (e01+e03+e13)/2 AS h2, (e01+e02+e12)/2 AS h3,
    e01*e23 AS p, e02*e13 AS q, e03*e12 AS s FROM len6),
qual AS (SELECT mesh_id, sid, region, 3 * (3*v/(sqrt(h0*(h0-e12)*(h0-e13)*(h0-e23))+sqrt(h1*(h1-e02)*(h1-e03)*(h1-e23))
    +sqrt(h2*(h2-e01)*(h2-e03)*(h2-e13))+sqrt(h3*(h3-e01)*(h3-e02)*(h3-e12))))
    / (sqrt((p+q+s)*(p+q-s)*(p-q+s)*(q+s-p))/(24*v)) AS quality FROM heron)"""


# Snapshots: four saves of a vector per site and region on the part mesh, values from the embeddings.

def snapshots(spark, sf, mesh: Mesh | None = None) -> DataFrame:
    from stepfield.operators.mesh import corners
    mesh = mesh or part_mesh(spark, sf)
    emb = table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("value"))
    n = emb.agg(F.max("vec_id") + F.lit(1)).first()[0]
    sites = corners(mesh).select("mesh_id", "region", "pid").distinct()
    rows = sites.withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    rows = rows.withColumn("vec_id", (F.col("pid") * 3 + F.col("id") * 11 + F.col("mesh_id")) % n)
    return lookup(rows, emb, ["vec_id"]).select(
        F.concat(F.lit("run"), "mesh_id").alias("run_id"), "mesh_id", F.lit("m").alias("field"),
        F.concat(F.lit("m_"), "region").alias("subfield"), "id", (F.col("id") * 10).alias("step"),
        F.floor(F.col("id") / 2).alias("stage"), (F.col("id") * 0.5).alias("time"), F.array("pid").alias("site"), "value")


def subfield_where(spark, mesh: Mesh) -> DataFrame:
    """Regions of each subfield of ``snapshots``."""
    return mesh.simplices.select("mesh_id", "region").distinct().withColumn("subfield", F.concat(F.lit("m_"), "region"))


SNAP = """snap AS (SELECT 'run' || s.mesh_id AS run_id, s.mesh_id, 'm' AS field, 'm_' || s.region AS subfield, s.region, i AS id,
    i * 10 AS step, i // 2 AS stage, i * 0.5::DOUBLE AS time, s.pid, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c
    FROM (SELECT DISTINCT mesh_id, region, pid FROM corn) s, range(4) t(i), embeddings e
    WHERE e.vec_id = (s.pid * 3 + i * 11 + s.mesh_id) % (SELECT max(vec_id) + 1 FROM embeddings))"""


def xyz_out(c="value", names=("a", "b", "c"), digits=6):
    """Three rounded component columns of a vector column."""
    return [r(F.col(c)[i], digits).alias(n) for i, n in enumerate(names)]
