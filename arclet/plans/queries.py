"""Queries over the test tables, each with the SQL that gives the same rows.

Stars come from supplier, source-plane points from lineitem, trajectories from nation, light curves from events. Places are
multiples of powers of two where sums or edges decide, so that both engines decide alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import imf
from ..functions.model import Box, Vec
from ..operators import events as E
from ..operators import maps as M
from ..operators import products as P
from ..operators import series as S
from ..operators import spatial as J
from ..operators import trace as T
from ..sources import lattice as L
from ..sources import lines as N
from ..sources import stars as ST
from ..streaming import commands as CM
from ..streaming import frames as FR
from .session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Fixtures, and their SQL.

SMOOTH, SHEAR = 0.3, 0.2
WIDTH = HEIGHT = 96
CELLS = Box(Vec(0.0, 0.0), Vec(6.0, 8.0), 24, 32)
PLANE = Box(Vec(26.0, 5.0), Vec(52.0, 10.0), 52, 20)
RADIUS = 1.5
RAW = 64.0


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stars(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("star_id"), (((k * 37) % 101 - 50) * 0.25 + 0.015625).alias("x"), (((k * 53) % 97 - 48) * 0.25 + 0.015625).alias("y"), ((k % 7) * 0.125 + 0.5).alias("mass")
    )


STARS = """stars AS (SELECT s_suppkey AS star_id, ((s_suppkey * 37) % 101 - 50) * 0.25::DOUBLE + 0.015625 AS x,
    ((s_suppkey * 53) % 97 - 48) * 0.25::DOUBLE + 0.015625 AS y, (s_suppkey % 7) * 0.125::DOUBLE + 0.5 AS mass FROM supplier)"""


def lattice(spark):
    return L.ray_lattice(spark, WIDTH, HEIGHT, 0.125, 0.125)


LATTICE = f"lattice AS (SELECT range AS ray_id, (range % {WIDTH} - {WIDTH // 2}) * 0.125::DOUBLE AS x, (range // {WIDTH} - {HEIGHT // 2}) * 0.125::DOUBLE AS y FROM range({WIDTH * HEIGHT}))"


def traced(spark, sf_dir):
    return T.micro_trace(lattice(spark), stars(spark, sf_dir), SMOOTH, SHEAR)


TRACED = f"""{STARS}, {LATTICE},
met AS (SELECT ray_id, l.x, l.y, l.x - s.x AS dx, l.y - s.y AS dy, mass AS m FROM lattice l, stars s),
sums AS (SELECT ray_id, x, y, sum(m * dx / (dx * dx + dy * dy)) AS ax, sum(m * dy / (dx * dx + dy * dy)) AS ay,
    sum(m * (dy * dy - dx * dx) / ((dx * dx + dy * dy) * (dx * dx + dy * dy))) AS p, sum(2 * m * dx * dy / ((dx * dx + dy * dy) * (dx * dx + dy * dy))) AS c FROM met GROUP BY ALL),
rays AS (SELECT ray_id, x, y, {1 - SHEAR - SMOOTH}::DOUBLE * x - ax AS bx, {1 + SHEAR - SMOOTH}::DOUBLE * y - ay AS yb, ({1 - SHEAR - SMOOTH}::DOUBLE - p) * ({1 + SHEAR - SMOOTH}::DOUBLE + p) - c * c AS det FROM sums)"""


def lens_places(spark, sf_dir):
    """Places in the lens plane, one for each line item, and what lens each is behind."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (k * 8 + n).alias("ray_id"), ((k % 193 - 96) * 0.0625).alias("x"), ((F.col("l_partkey") % 161 - 80) * 0.0625).alias("y"),
    )


PLACES = """places AS (SELECT l_orderkey * 8 + l_linenumber AS ray_id, (l_orderkey % 193 - 96) * 0.0625::DOUBLE AS x, (l_partkey % 161 - 80) * 0.0625::DOUBLE AS y FROM lineitem)"""


def points(spark, sf_dir):
    """Source-plane points of lineitem with their places in the lens plane and a parity."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 64 * 0.25).alias("x"),
        (F.col("l_suppkey") % 32 * 0.25).alias("y"),
        (F.col("l_quantity") + F.col("l_linenumber") * 0.125).alias("bx"),
        (F.round(F.col("l_discount") * 100) + F.col("l_linenumber") * 0.0625).alias("by"),
        F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1).cast("byte").alias("parity"),
    )


POINTS = """pts AS (SELECT l_partkey % 64 * 0.25::DOUBLE AS x, l_suppkey % 32 * 0.25::DOUBLE AS y, l_quantity + l_linenumber * 0.125::DOUBLE AS bx,
    round(l_discount * 100) + l_linenumber * 0.0625::DOUBLE AS yb, CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS parity FROM lineitem)"""
GRID = "grid AS (SELECT (range % 52)::INT AS px, (range // 52)::INT AS py, (range % 52) * 1.0::DOUBLE AS qx, (range // 52) * 0.5::DOUBLE AS qy FROM range(1040))"
NEAR = f"(bx - qx) * (bx - qx) + (yb - qy) * (yb - qy) <= {RADIUS * RADIUS}"
DISKS = f"WITH {POINTS}, {GRID} SELECT px, py, count(*) AS m0 FROM pts JOIN grid ON {NEAR} GROUP BY px, py"


def curves(spark, sf_dir, trials=(0,)):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts")) - 1).alias("sample_idx"), F.col("value").alias("v"))
    t = c.withColumn("trial", F.explode(F.array(*map(F.lit, trials))))
    return t.select("trial", "line_id", "sample_idx", (F.col("v") * (1 + F.col("trial") * ((F.col("sample_idx") * 7) % 5) * 0.125)).alias("v"))


def curve_sql(trials=(0,)):
    return f"""base AS (SELECT user_id AS line_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS sample_idx, value AS v FROM events),
curves AS (SELECT trial, line_id, sample_idx, v * (1 + trial * ((sample_idx * 7) % 5) * 0.125::DOUBLE) AS v FROM base, (VALUES {', '.join(f'({t})' for t in trials)}) AS t(trial))"""


CURVES, TRIALS = curve_sql(), curve_sql((0, 1, 2))
OVER = "(PARTITION BY trial, line_id ORDER BY sample_idx)"


def trajectories(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        k.alias("curve_id"), ((k * 7) % 13 - 6).cast("double").alias("ax"), ((k * 5) % 7 - 3).cast("double").alias("ay"), ((k % 5) + 1).cast("double").alias("dx"), ((k % 3) * 0.5 + 0.25).alias("dy")
    )


TRACK_BOX = Box(Vec(20.0, 5.0), Vec(64.0, 20.0))
CLIPPED = """lines AS (SELECT n_nationkey::BIGINT AS curve_id, ((n_nationkey * 7) % 13 - 6)::DOUBLE AS ax, ((n_nationkey * 5) % 7 - 3)::DOUBLE AS ay, (n_nationkey % 5 + 1)::DOUBLE AS dx, (n_nationkey % 3) * 0.5::DOUBLE + 0.25 AS dy FROM nation),
t AS (SELECT *, list_sort([(-12 - ax) / dx, (-5 - ay) / dy, (52 - ax) / dx, (15 - ay) / dy]) AS ts FROM lines),
ends AS (SELECT curve_id, ax + ts[2] * dx AS x0, ay + ts[2] * dy AS y0, ax + ts[3] * dx AS x1, ay + ts[3] * dy AS y1 FROM t)"""
SAMPLED = f"""{CLIPPED},
n AS (SELECT *, floor(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 0.75)::INT AS n FROM ends),
track AS (SELECT curve_id, i::INT AS sample_idx, x0 + (x1 - x0) * coalesce(i::DOUBLE / nullif(n - 1, 0), 0) AS qx, y0 + (y1 - y0) * coalesce(i::DOUBLE / nullif(n - 1, 0), 0) AS qy FROM n, LATERAL (SELECT unnest(range(n)) AS i) r WHERE n > 0)"""


def track(spark, sf_dir):
    return N.interpolate_lines(N.clip_lines(trajectories(spark, sf_dir), TRACK_BOX), 0.75)


def counts_map(spark, sf_dir):
    """A dense map: points per cell of one unit by one unit."""
    box = Box(Vec(26.0, 6.0), Vec(52.0, 12.0), 52, 12)
    p = points(spark, sf_dir).select((F.floor("bx")).cast("int").alias("px"), F.floor("by").cast("int").alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("value"))
    return J.densified(p, L.query_lattice(spark, box)).withColumn("value", F.col("value").cast("double"))


DENSE = f"""{POINTS}, cnt AS (SELECT floor(bx)::INT AS px, floor(yb)::INT AS py, count(*) AS value FROM pts GROUP BY ALL),
cells AS (SELECT (range % 52)::INT AS px, (range // 52)::INT AS py FROM range(624)),
map AS (SELECT px, py, coalesce(value, 0)::DOUBLE AS value FROM cells LEFT JOIN cnt USING (px, py))"""


def r6(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def half_up(c, digits):
    """As SQL rounds a double: the product with the power of ten to the nearest whole number, halves away from 0; F.round() takes the
    double's decimal digits, which differ from that where a half is meant."""
    t = F.abs(c) * F.lit(float(10**digits))
    whole = F.floor(t)
    return F.signum(c) * (whole + F.when(t - whole >= 0.5, 1).otherwise(0)) / F.lit(float(10**digits)) + F.lit(0.0)


# Tracing.


@query(f"""WITH {TRACED}, b AS (SELECT floor((bx + 3) / 0.25)::INT AS px, floor((yb + 4) / 0.25)::INT AS py, bx, yb FROM rays)
SELECT px, py, count(*) AS m0 FROM b WHERE px BETWEEN 0 AND 23 AND py BETWEEN 0 AND 31 AND bx > -3 + px * 0.25::DOUBLE AND yb > -4 + py * 0.25::DOUBLE GROUP BY px, py""")
def cell_map(spark, sf_dir):
    return J.cell_bins(traced(spark, sf_dir), CELLS)


@query(f"WITH {TRACED} SELECT ray_id, round(bx, 6) + 0.0 AS bx, round(yb, 6) + 0.0 AS \"by\" FROM rays")
def ray_trace_micro(spark, sf_dir):
    return T.micro_trace(lattice(spark), stars(spark, sf_dir), SMOOTH, SHEAR, False, "sql").select("ray_id", r6("bx", "bx"), r6("by", "by"))


@query(ORACLE["ray_trace_micro"])
def ray_trace_kernel(spark, sf_dir):
    return T.micro_trace(lattice(spark), stars(spark, sf_dir), SMOOTH, SHEAR, False, "kernel").select("ray_id", r6("bx", "bx"), r6("by", "by"))


@query(f"WITH {TRACED} SELECT ray_id, round(bx, 6) + 0.0 AS bx, round(yb, 6) + 0.0 AS \"by\", round(det, 3) + 0.0 AS det FROM rays")
def ray_trace_cells(spark, sf_dir):
    """Far stars by the moments of their cells."""
    t = T.micro_trace(lattice(spark), stars(spark, sf_dir), SMOOTH, SHEAR, True, "cells")
    return t.select("ray_id", r6("bx", "bx"), r6("by", "by"), (F.round("det", 3) + F.lit(0.0)).alias("det"))


@query(f"WITH {TRACED} SELECT CASE WHEN abs(det) < 1e-3 THEN 0 WHEN det > 0 THEN 1 ELSE -1 END AS parity, count(*) AS n FROM rays GROUP BY 1")
def jacobian_parity(spark, sf_dir):
    return traced(spark, sf_dir).groupBy(F.col("parity").cast("int").alias("parity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PLACES} SELECT ray_id, round({1 - SHEAR}::DOUBLE * x - {SMOOTH}::DOUBLE * x, 6) + 0.0 AS bx, round({1 + SHEAR}::DOUBLE * y - {SMOOTH}::DOUBLE * y, 6) + 0.0 AS \"by\" FROM places")
def star_free_map(spark, sf_dir):
    bx, by = T.smooth_map(F.col("x"), F.col("y"), SMOOTH, SHEAR)
    return lens_places(spark, sf_dir).select("ray_id", r6(bx, "bx"), r6(by, "by"))


@query(f"""WITH {PLACES}, e AS (SELECT *, x * sin(0.4) + y * cos(0.4) AS u, y * sin(0.4) - x * cos(0.4) AS v FROM places),
s AS (SELECT *, sqrt(0.64::DOUBLE * u * u + v * v) AS s FROM e),
d AS (SELECT ray_id, x, y, coalesce(atan(0.6::DOUBLE * u / nullif(s, 0)) * (1.5::DOUBLE / 0.6), 0) AS ex, coalesce(atanh(0.6::DOUBLE * v / nullif(s, 0)) * (1.5::DOUBLE / 0.6), 0) AS ey FROM s)
SELECT ray_id, round(x - (ex * sin(0.4) - ey * cos(0.4) + 0.1 * cos(0.6) * x + 0.1 * sin(0.6) * y), 6) + 0.0 AS bx,
       round(y - (ex * cos(0.4) + ey * sin(0.4) + 0.1 * sin(0.6) * x - 0.1 * cos(0.6) * y), 6) + 0.0 AS "by" FROM d""")
def ray_trace_macro(spark, sf_dir):
    return T.macro_trace(lens_places(spark, sf_dir), 1.5, 0.8, 0.4, 0.1, 0.3).select("ray_id", r6("bx", "bx"), r6("by", "by"))


@query(f"""WITH {TRACED}, f AS (SELECT ray_id, sum(m * (dx * dx - dy * dy) / (dx * dx + dy * dy)) AS re, sum(2 * m * dx * dy / (dx * dx + dy * dy)) AS im FROM met GROUP BY ray_id)
SELECT ray_id, round(0.49::DOUBLE - ((0.2::DOUBLE + re) * (0.2::DOUBLE + re) + im * im), 4) + 0.0 AS value FROM f""")
def caustic_characteristic(spark, sf_dir):
    out = T.caustic_characteristic(lattice(spark), stars(spark, sf_dir), 0.3, 0.2)
    return out.select("ray_id", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query(f"WITH {TRACED} SELECT ray_id FROM rays WHERE (bx - 0.5) * (bx - 0.5) + (yb - 0.25) * (yb - 0.25) <= 1")
def connecting_rays(spark, sf_dir):
    return J.connecting_rays(traced(spark, sf_dir), 0.5, 0.25, 1.0)


@query(f"WITH {TRACED} SELECT DISTINCT (ray_id % {WIDTH})::INT AS px, (ray_id // {WIDTH})::INT AS py FROM rays WHERE (bx - 0.5) * (bx - 0.5) + (yb - 0.25) * (yb - 0.25) <= 1")
def frame_pixels(spark, sf_dir):
    return J.frame_pixels(traced(spark, sf_dir), 0.5, 0.25, 1.0, WIDTH)


@query(f"""WITH {TRACED}, f AS (SELECT range AS frame, -2 + 0.3::DOUBLE * range * 0.5 AS qx, 0.25 + 0.1::DOUBLE * range * 0.5 AS qy FROM range(40))
SELECT frame, count(*) AS n FROM f JOIN rays ON (bx - qx) * (bx - qx) + (yb - qy) * (yb - qy) <= 0.25 GROUP BY frame""")
def animation_frames(spark, sf_dir):
    frames = FR.positions(spark.range(40).withColumnRenamed("id", "frame"), Vec(-2.0, 0.25), Vec(0.3, 0.1), 0.5)
    return FR.frame_rays(frames, traced(spark, sf_dir), 0.5).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS e, value AS v FROM events),
g AS (SELECT *, count(*) FILTER (e IN ('signup', 'error')) OVER w AS part, last_value(CASE WHEN e = 'signup' THEN v END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN e = 'click' THEN v / 8 END IGNORE NULLS) OVER w AS vx,
  last_value(CASE WHEN e = 'signup' THEN 0 WHEN e = 'error' THEN v END IGNORE NULLS) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
h AS (SELECT *, coalesce(t0, 0) + 0.1::DOUBLE * count(*) FILTER (e = 'view') OVER (PARTITION BY user_id, part ORDER BY seq) AS t FROM g)
SELECT user_id::VARCHAR AS session, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS frame, round(t, 8) + 0.0 AS t, round(coalesce(x, 0) + coalesce(vx, 0) * t, 8) + 0.0 AS qx,
  round(coalesce(x, 0) / 2 - coalesce(vx, 0) / 2 * t, 8) + 0.0 AS qy FROM h WHERE e IN ('signup', 'view', 'purchase')""")
def animation_commands(spark, sf_dir):
    """The frames that the events of each user show, taken as commands to an animation of their own."""
    from pyspark.sql import Window as W

    kind = F.create_map(*[F.lit(x) for pair in {"signup": "place", "error": "time", "view": "step", "click": "velocity", "purchase": "show"}.items() for x in pair])
    e, v = F.col("event_type"), F.col("value")
    a = F.when(e == "click", v / 8).when(e == "view", F.lit(None)).otherwise(v)
    b = F.when(e == "signup", v / 2).when(e == "click", -v / 16)
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), seq.alias("seq"), kind[e].alias("command"), a.alias("a"), b.alias("b"))
    # Values have eight digits at most.
    return CM.frames_of_table(rows).select("session", "seq", "frame", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("t", "qx", "qy")])


# Stars.


@query(f"WITH {STARS} SELECT star_id, x + (star_id % 5) * 0.25::DOUBLE * 2 AS x, y - (star_id % 3) * 0.5::DOUBLE * 2 AS y FROM stars")
def star_motion(spark, sf_dir):
    s = stars(spark, sf_dir).withColumn("vx", F.col("star_id") % 5 * 0.25).withColumn("vy", F.col("star_id") % 3 * -0.5)
    return ST.moved(s, 2.0).select("star_id", "x", "y")


@query(f"WITH {STARS} SELECT star_id, x, y, mass FROM stars WHERE x * x + y * y <= 36 UNION ALL SELECT star_id + 1000000, y, x, mass FROM stars WHERE star_id < 10")
def star_replenish(spark, sf_dir):
    s = stars(spark, sf_dir)
    more = s.where("star_id < 10").select((F.col("star_id") + 1000000).alias("star_id"), F.col("y").alias("x"), F.col("x").alias("y"), "mass")
    return ST.replenished(s, more, 6.0)


@query("""WITH c AS (SELECT c_nationkey AS cluster, c_custkey AS star_id, (c_custkey % 16) * 0.25::DOUBLE + 0.125 AS mass FROM customer),
r AS (SELECT *, sum(mass) OVER (PARTITION BY cluster ORDER BY star_id) AS running FROM c),
e AS (SELECT cluster, arg_min(star_id, (abs(running - 20), star_id)) AS e FROM r GROUP BY cluster)
SELECT r.cluster, count(*) AS stars, max(running) AS mass FROM r JOIN e USING (cluster) WHERE star_id <= e GROUP BY r.cluster""")
def cluster_cutoff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("star_id"), (F.col("c_custkey") % 16 * 0.25 + 0.125).alias("mass"))
    return ST.cluster_cutoff(c, 20.0).groupBy("cluster").agg(F.count(F.lit(1)).alias("stars"), F.max("running").alias("mass"))


_KROUPA = imf.PowerLaw.named("Kroupa_2001_Modified")
_MASS = "(p_partkey % 200 + 1) * 0.01::DOUBLE"


@query(f"""WITH m AS (SELECT p_partkey, {_MASS} AS m FROM part)
SELECT p_partkey, round(CASE WHEN m >= 0.08 AND m < 0.5 THEN m ** -1.3 WHEN m >= 0.5 AND m <= 1.5 THEN {float(_KROUPA.coeffs[1])!r}::DOUBLE * m ** -2.7 ELSE 0 END, 6) + 0.0 AS density FROM m""")
def imf_density(spark, sf_dir):
    m = F.col("p_partkey") % 200
    return table(spark, sf_dir, "part").select("p_partkey", r6(imf.density_column((m + 1) * F.lit(0.01), _KROUPA), "density"))


_A = [float(imf.power_integral(_KROUPA.limits[i], p)) for i, p in enumerate(_KROUPA.powers)]
_CUM = [float(c * (imf.power_integral(b, p) - imf.power_integral(a, p))) for c, p, a, b in zip(_KROUPA.coeffs, _KROUPA.powers, _KROUPA.limits, _KROUPA.limits[1:])]


@query(f"""WITH u AS (SELECT p_partkey, ((p_partkey * 37) % 1009) / 1009.0::DOUBLE * {sum(_CUM)!r}::DOUBLE AS x FROM part)
SELECT p_partkey, round(CASE WHEN x >= {_CUM[0]!r}::DOUBLE THEN (((x - {_CUM[0]!r}::DOUBLE) / {float(_KROUPA.coeffs[1])!r}::DOUBLE + {_A[1]!r}::DOUBLE) * -1.7) ** (1 / -1.7::DOUBLE)
    ELSE ((x + {_A[0]!r}::DOUBLE) * -0.3) ** (1 / -0.3::DOUBLE) END, 6) + 0.0 AS mass FROM u""")
def imf_inverse_cdf(spark, sf_dir):
    u = (F.col("p_partkey") * 37 % 1009) / F.lit(1009.0)
    return table(spark, sf_dir, "part").select("p_partkey", r6(imf.sample_column(u, _KROUPA), "mass"))


@query("SELECT p_partkey, CASE WHEN m > 30 THEN 10.0 WHEN m > 8 THEN 1.4 WHEN m >= 0.8 THEN 0.6 ELSE m END::DOUBLE AS mass FROM (SELECT p_partkey, (p_partkey % 320) * 0.125::DOUBLE AS m FROM part)")
def evolved_mass(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", imf.evolved_column(F.col("p_partkey") % 320 * 0.125).alias("mass"))


_WK = imf.PowerLaw.named("Kroupa_2001")


def _wk_integral(low, high, weight):
    """The integral of the mass function between two SQL expressions."""
    parts = []
    for c, p, a, b in zip(_WK.coeffs, _WK.powers, _WK.limits[:-1], _WK.limits[1:]):
        lo, hi, q = f"greatest({low}, {float(a)!r}::DOUBLE)", high if b == float("inf") else f"least({high}, {float(b)!r}::DOUBLE)", float(p + weight + 1)
        parts.append(f"CASE WHEN {hi} > {lo} THEN {float(c)!r}::DOUBLE * (({hi}) ** {q!r}::DOUBLE - ({lo}) ** {q!r}::DOUBLE) / {q!r}::DOUBLE ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


@query(f"""WITH RECURSIVE b AS (SELECT c_custkey, 100 + c_custkey % 2000::DOUBLE AS total, 0.01::DOUBLE AS a, 100 + c_custkey % 2000::DOUBLE AS c, 0 AS k FROM customer
UNION ALL SELECT c_custkey, total, CASE WHEN below THEN m ELSE a END, CASE WHEN below THEN c ELSE m END, k + 1 FROM
  (SELECT *, (a + c) / 2 AS m, {_wk_integral('0.01::DOUBLE', '((a + c) / 2)', 1)} < total * {_wk_integral('((a + c) / 2)', 'total', 0)} AS below FROM b) WHERE k < {imf.BISECTIONS})
SELECT c_custkey, total, round((a + c) / 2, 4) AS top FROM b WHERE k = {imf.BISECTIONS}""")
def largest_stars(spark, sf_dir):
    """The largest star of clusters of given masses."""
    total = (F.lit(100) + F.col("c_custkey") % 2000).cast("double")
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", total.alias("total"), F.round(imf.largest_star_column(total, _WK), 4).alias("top"))


_SALPETER = imf.PowerLaw.named("Salpeter_1955")
_SP = [float(imf.power_integral(m, -2.3)) for m in _SALPETER.limits]


@query(f"""WITH c AS (SELECT n_nationkey AS cluster, 200 + n_nationkey * 7::DOUBLE AS total FROM nation),
e AS (SELECT *, ceil(2 * total * ({_SP[1] - _SP[0]!r}::DOUBLE) / ({float(imf.power_integral(10.0, -1.3) - imf.power_integral(0.4, -1.3))!r}::DOUBLE))::BIGINT AS n FROM c),
u AS (SELECT cluster, total, i AS star_id, ('0x' || substr(md5('11:' || cluster || ':' || i), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS u FROM e, LATERAL (SELECT unnest(range(n + 101)) AS i)),
m AS (SELECT *, ((u * {_SP[1] - _SP[0]!r}::DOUBLE + {_SP[0]!r}::DOUBLE) * -1.3::DOUBLE) ** (1 / -1.3::DOUBLE) AS mass FROM u),
r AS (SELECT *, sum(round(mass * {1 << 30})::BIGINT) OVER (PARTITION BY cluster ORDER BY star_id) - round(total * {1 << 30})::BIGINT AS past FROM m),
f AS (SELECT cluster, arg_min(star_id, (abs(past), star_id)) AS last FROM r GROUP BY cluster)
SELECT cluster, star_id, round(mass, 6) AS mass FROM r JOIN f USING (cluster) WHERE star_id <= last""")
def star_clusters(spark, sf_dir):
    """The stars of a cluster for each nation, drawn by tasks."""
    clusters = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), (F.col("n_nationkey") * 7 + 200).cast("double").alias("total"))
    return ST.star_clusters(clusters, _SALPETER, 11).select("cluster", "star_id", F.round("mass", 6).alias("mass"))


@query(f"""WITH m AS (SELECT p_partkey, {_MASS} AS m FROM part), e AS (SELECT *, (log10(m) + 0.5) / {(2 ** 0.5 * 0.4)!r}::DOUBLE AS z FROM m)
SELECT p_partkey, round(exp(-((log10(m) + 0.5) ** 2) / {2 * 0.4 ** 2!r}::DOUBLE) / m, 6) + 0.0 AS density,
  round({0.4 * 2.302585092994046 * (3.141592653589793 / 2) ** 0.5!r}::DOUBLE * sign(z) * sqrt(1 - exp(-z * z * ({4 / 3.141592653589793!r}::DOUBLE + {imf.WINITZKI}::DOUBLE * z * z) / (1 + {imf.WINITZKI}::DOUBLE * z * z))), 6) + 0.0 AS integral,
  (m > 1)::INT::DOUBLE AS above, (m >= 1)::INT::DOUBLE AS at_least FROM e""")
def log_normal_masses(spark, sf_dir):
    """The log-normal mass function and its integral by the elementary error function, and steps at one solar mass."""
    m = (F.col("p_partkey") % 200 + 1) * F.lit(0.01)
    cols = [r6(imf.log_normal_column(m, -0.5, 0.4), "density"), r6(imf.log_normal_integral_column(m, -0.5, 0.4), "integral"), imf.step_column(m - 1).alias("above"), imf.step_column(m - 1, True).alias("at_least")]
    return table(spark, sf_dir, "part").select("p_partkey", *cols)


# Lattices and lines.


@query(f"""WITH {POINTS}, mesh AS (SELECT (range % 21)::INT AS px, (range // 21)::INT AS py, 21 + (range % 21) * 0.5::DOUBLE AS qx, 3 + (range // 21) * 0.25::DOUBLE AS qy FROM range(357))
SELECT px, py, qx, qy, count(bx) AS n FROM mesh LEFT JOIN pts ON bx = qx AND yb = qy GROUP BY ALL""")
def pixel_mesh(spark, sf_dir):
    """A mesh from edge to edge, and how many points lie right on each of its nodes."""
    at = points(spark, sf_dir).groupBy(F.col("bx").alias("qx"), F.col("by").alias("qy")).agg(F.count(F.lit(1)).alias("n"))
    mesh = L.query_lattice(spark, Box(Vec(26.0, 5.0), Vec(10.0, 4.0), 21, 17), True)
    return mesh.join(at, ["qx", "qy"], "left").select("px", "py", "qx", "qy", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {POINTS} SELECT bx, yb AS \"by\", floor(bx / 0.5)::INT AS px, floor((10 - yb) / 0.25)::INT AS py, count(*) AS n FROM pts GROUP BY ALL")
def loc_to_pixel(spark, sf_dir):
    px, py = L.loc_to_pixel(F.col("bx"), F.col("by"), Box(Vec(26.0, 5.0), Vec(52.0, 10.0), 104, 40))
    return points(spark, sf_dir).groupBy("bx", "by", px.alias("px"), py.alias("py")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, (p_partkey % 104) * 0.5::DOUBLE AS x, 10 - (p_partkey % 40) * 0.25::DOUBLE AS y FROM part")
def pixel_to_loc(spark, sf_dir):
    x, y = L.pixel_to_loc(F.col("p_partkey") % 104, F.col("p_partkey") % 40, Box(Vec(26.0, 5.0), Vec(52.0, 10.0), 104, 40))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query(f"WITH {CLIPPED} SELECT curve_id, round(x0, 6) + 0.0 AS x0, round(y0, 6) + 0.0 AS y0, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1 FROM ends")
def line_clip(spark, sf_dir):
    return N.clip_lines(trajectories(spark, sf_dir), TRACK_BOX).select("curve_id", *[r6(c, c) for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {SAMPLED} SELECT curve_id, sample_idx, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy FROM track")
def line_interpolate(spark, sf_dir):
    return track(spark, sf_dir).select("curve_id", "sample_idx", r6("qx", "qx"), r6("qy", "qy"))


# Disks and cells.


@query(DISKS)
def disk_map_scatter(spark, sf_dir):
    return J.disk_join(points(spark, sf_dir), PLANE, RADIUS, strategy="scatter")


@query(DISKS)
def disk_map_cells(spark, sf_dir):
    return J.disk_join(points(spark, sf_dir), PLANE, RADIUS, strategy="cells")


@query(DISKS)
def disk_map_naive(spark, sf_dir):
    return J.disk_join(points(spark, sf_dir), PLANE, RADIUS, strategy="naive")


@query(DISKS.replace("FROM pts", "FROM (SELECT * FROM pts WHERE parity = 1) AS p"))
def parity_split(spark, sf_dir):
    return J.disk_join(T.with_parity(points(spark, sf_dir), "pos"), PLANE, RADIUS)


@query(f"WITH d AS ({DISKS}), {GRID} SELECT px, py, coalesce(m0, 0) / {RAW}::DOUBLE AS value FROM grid LEFT JOIN d USING (px, py)")
def magnification_map(spark, sf_dir):
    return P.magnification_map(points(spark, sf_dir), PLANE, RADIUS, RAW)


@query(f"""WITH {POINTS}, {GRID}, s AS (SELECT px, py, count(*) AS m0, sum(x - bx) AS m1, sum(y - yb) AS m2, sum((x - bx) * (x - bx)) AS m3, sum((x - bx) * (y - yb)) AS m4, sum((y - yb) * (y - yb)) AS m5
    FROM pts JOIN grid ON {NEAR} GROUP BY px, py)
SELECT px, py, k AS moment_index, coalesce([m0, m1, m2, m3, m4, m5][k + 1], 0)::DOUBLE AS value FROM grid LEFT JOIN s USING (px, py), (VALUES (0), (1), (2), (3), (4), (5)) AS t(k)""")
def moment_map(spark, sf_dir):
    return P.moment_map(points(spark, sf_dir), PLANE, RADIUS)


RADII = (1.5, 0.25, 2.5, 1.0, 2.0)
_EACH = " UNION ALL ".join(f"SELECT {i} AS trial, px, py, count(*) AS m0, sum(x - bx) AS m1, sum((y - yb) * (y - yb)) AS m5 FROM pts JOIN grid ON (bx - qx) * (bx - qx) + (yb - qy) * (yb - qy) <= {r * r} GROUP BY px, py" for i, r in enumerate(RADII))


@query(f"WITH {POINTS}, {GRID} {_EACH}")
def multi_radius_map(spark, sf_dir):
    """Trials that differ in their source's radius, from one pass over the rays."""
    return J.disk_join(points(spark, sf_dir), PLANE, RADII, (0, 1, 5)).select("trial", "px", "py", "m0", "m1", "m5")


@query(f"""WITH {SAMPLED}, {POINTS} {' UNION ALL '.join(f"SELECT {i} AS trial, curve_id, sample_idx, count(*) AS m0 FROM track JOIN pts ON (bx - qx) * (bx - qx) + (yb - qy) * (yb - qy) <= {r * r} GROUP BY ALL" for i, r in enumerate(RADII))}""")
def multi_radius_curves(spark, sf_dir):
    """The same for light curves."""
    return J.disk_points(points(spark, sf_dir), track(spark, sf_dir), RADII).select("trial", "curve_id", "sample_idx", "m0")


@query(f"""WITH {POINTS}, {GRID}, c AS (SELECT floor(bx)::INT AS px, floor(yb / 0.5)::INT AS py, count(*) AS n FROM pts WHERE parity = 0 AND bx > floor(bx) AND yb / 0.5 > floor(yb / 0.5) GROUP BY 1, 2)
SELECT px, py, coalesce(n, 0)::DOUBLE AS value FROM grid LEFT JOIN c USING (px, py)""")
def caustic_map(spark, sf_dir):
    return P.caustic_map(points(spark, sf_dir), PLANE)


@query(f"""WITH {SAMPLED}, {POINTS}, c AS (SELECT curve_id, sample_idx, count(*) AS n FROM track JOIN pts ON {NEAR} GROUP BY ALL)
SELECT curve_id AS line_id, sample_idx, round(qx, 6) + 0.0 AS x, round(qy, 6) + 0.0 AS y, coalesce(n, 0) / {RAW}::DOUBLE AS magnification FROM track LEFT JOIN c USING (curve_id, sample_idx)""")
def light_curve_counts(spark, sf_dir):
    return P.light_curves(points(spark, sf_dir), track(spark, sf_dir), RADIUS, RAW).select("line_id", "sample_idx", r6("x", "x"), r6("y", "y"), "magnification")


@query(f"""WITH {SAMPLED}, {POINTS}, c AS (SELECT curve_id, sample_idx, count(*) AS n FROM track JOIN pts ON {NEAR} GROUP BY ALL),
f AS (SELECT curve_id, qx AS fx, qy AS fy FROM track WHERE sample_idx = 0)
SELECT curve_id AS line_id, sample_idx, round(sqrt((qx - fx) * (qx - fx) + (qy - fy) * (qy - fy)) / 0.5, 6) + 0.0 AS distance, round(-2.5 * log10(n / {RAW}::DOUBLE), 6) + 0.0 AS magnitude
FROM track JOIN f USING (curve_id) LEFT JOIN c USING (curve_id, sample_idx)""")
def plottable_curves(spark, sf_dir):
    """Light curves as a plot shows them, with distances in a unit of their own."""
    c = P.light_curves(points(spark, sf_dir), track(spark, sf_dir), RADIUS, RAW).withColumnRenamed("magnification", "v")
    return S.plottables(c, 0.5, ("line_id",)).select("line_id", "sample_idx", r6("distance", "distance"), r6("magnitude", "magnitude"))


@query(f"WITH {POINTS}, e AS (SELECT min(bx) AS lo, max(bx) AS hi FROM pts) SELECT least(floor((bx - lo) / ((hi - lo) / 37))::INT, 36) AS bucket, count(*) AS n FROM pts, e GROUP BY 1")
def bucket_minmax(spark, sf_dir):
    return C.equal_width_bucket(points(spark, sf_dir), "bx", 37).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


# Series.


@query(f"WITH {CURVES} SELECT line_id, sample_idx, round(-2.5 * log10(v), 6) + 0.0 AS magnitude FROM curves")
def curve_magnitude(spark, sf_dir):
    return curves(spark, sf_dir).select("line_id", "sample_idx", r6(C.log_brightness(F.col("v")), "magnitude"))


@query(f"""WITH {SAMPLED}, f AS (SELECT *, first(qx) OVER (PARTITION BY curve_id ORDER BY sample_idx) AS fx, first(qy) OVER (PARTITION BY curve_id ORDER BY sample_idx) AS fy FROM track)
SELECT curve_id AS line_id, sample_idx, round(sqrt((qx - fx) * (qx - fx) + (qy - fy) * (qy - fy)), 6) + 0.0 AS distance FROM f""")
def distance_axis(spark, sf_dir):
    c = track(spark, sf_dir).select(F.col("curve_id").alias("line_id"), "sample_idx", F.col("qx").alias("x"), F.col("qy").alias("y"))
    return S.with_distance(c, ("line_id",)).select("line_id", "sample_idx", r6("distance", "distance"))


@query(f"WITH {CURVES} SELECT line_id, sample_idx, round(coalesce(lead(v) OVER {OVER}, v) - coalesce(lag(v) OVER {OVER}, v), 6) + 0.0 AS gradient FROM curves")
def sobel_1d(spark, sf_dir):
    return curves(spark, sf_dir).select("line_id", "sample_idx", r6(S.sobel(F.col("v")), "gradient"))


@query(f"WITH {CURVES} SELECT line_id, sample_idx, round(avg(v) OVER (PARTITION BY trial, line_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS smooth FROM curves")
def moving_average(spark, sf_dir):
    return curves(spark, sf_dir).select("line_id", "sample_idx", r6(S.moving_mean(F.col("v"), 3), "smooth"))


@query(f"""WITH {CURVES}, a AS (SELECT *, sum(v) OVER w / 5 AS m, sum(v * v) OVER w / 5 AS q FROM curves WINDOW w AS (PARTITION BY trial, line_id ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, q - m * m AS s, avg(q - m * m) OVER (PARTITION BY trial, line_id) AS n FROM a)
SELECT line_id, sample_idx, round(CASE WHEN s < n THEN m ELSE m + (s - n) / s * (v - m) END, 4) + 0.0 AS smooth FROM b""")
def wiener(spark, sf_dir):
    return S.wiener(curves(spark, sf_dir), 5).select("line_id", "sample_idx", (F.round("smooth", 4) + F.lit(0.0)).alias("smooth"))


@query(f"""WITH {CURVES}, d AS (SELECT *, v - 150 AS d FROM curves), t AS (SELECT *, coalesce((d + lag(d) OVER {OVER}) / 2, d) AS t FROM d),
n AS (SELECT *, CASE WHEN t > 0 AND NOT coalesce(lag(t > 0) OVER {OVER}, false) THEN 1 ELSE 0 END AS new FROM t), i AS (SELECT *, sum(new) OVER {OVER} AS island FROM n)
SELECT line_id, island::BIGINT AS island, min(sample_idx) AS s, max(sample_idx) + 1 AS e, round(sum(t), 6) + 0.0 AS area, round(max(t), 6) + 0.0 AS rise FROM i WHERE t > 0 GROUP BY line_id, island""")
def threshold_islands(spark, sf_dir):
    i = S.threshold_islands(curves(spark, sf_dir).withColumn("base", F.lit(150.0)))
    return i.select("line_id", "island", "s", "e", r6("area", "area"), r6("rise", "rise"))


@query(f"""WITH {CURVES}, d AS (SELECT *, ((v - lag(v, 3) OVER {OVER}) + (v - lead(v, 3) OVER {OVER})) / 2 AS d FROM curves)
SELECT line_id, sample_idx, round(d, 6) + 0.0 AS "drop" FROM d WHERE d > 100""")
def peak_candidates(spark, sf_dir):
    return S.peak_candidates(curves(spark, sf_dir), 6, 100.0).select("line_id", "sample_idx", r6("drop", "drop"))


@query(f"WITH {CURVES} SELECT line_id, arg_max(sample_idx, (v, -sample_idx)) AS peak, max(v) AS height, count(*) AS n FROM curves GROUP BY line_id")
def argmax_curve(spark, sf_dir):
    return S.peak_of(curves(spark, sf_dir)).select("line_id", "peak", "height", "n")


_PROMINENT = f"""WITH {CURVES}, p AS (SELECT line_id, sample_idx AS peak, v AS h FROM curves),
c AS (SELECT p.line_id, peak, h, sample_idx, v, abs(sample_idx - peak) AS far, sample_idx > peak AS rt FROM p JOIN curves USING (line_id)),
n AS (SELECT line_id, peak, min(far) FILTER (rt AND v > h) AS r, min(far) FILTER (NOT rt AND v > h) AS l FROM c GROUP BY ALL)
SELECT line_id, peak, round(max(h) - min(v), 6) + 0.0 AS prominence FROM c JOIN n USING (line_id, peak)
WHERE far = 0 OR (r IS NULL AND l IS NULL) OR (r IS NOT NULL AND (l IS NULL OR r <= l) AND rt AND far < r) OR (l IS NOT NULL AND (r IS NULL OR l < r) AND NOT rt AND far < l) GROUP BY line_id, peak"""


@query(_PROMINENT)
def prominence(spark, sf_dir):
    c = curves(spark, sf_dir)
    peaks = c.select("trial", "line_id", F.col("sample_idx").alias("peak"))
    return S.prominence_of(c, peaks).select("line_id", "peak", r6("prominence", "prominence"))


@query(_PROMINENT)
def prominence_chunks(spark, sf_dir):
    """The same with series in chunks, of which no task holds two."""
    return S.chunked_prominences(curves(spark, sf_dir), 48).select("line_id", "peak", r6("prominence", "prominence"))


@query(f"SELECT line_id, count(*) FILTER (prominence > 200) AS n FROM ({_PROMINENT}) GROUP BY line_id")
def prominences_above(spark, sf_dir):
    return S.prominences_above(curves(spark, sf_dir), 200.0).select("line_id", "n")


_MAGNITUDES = f"{CURVES}, mag AS (SELECT trial, line_id, sample_idx, -2.5 * log10(v) AS v FROM curves)"
_ASYMMETRY = f"""{_MAGNITUDES}, pk AS (SELECT line_id, arg_max(sample_idx, (v, -sample_idx)) AS p, count(*) AS n FROM mag GROUP BY line_id),
k AS (SELECT line_id, sample_idx - p AS k, least(p, n - p) - 1 AS half, v FROM mag JOIN pk USING (line_id)),
d AS (SELECT line_id, abs(k) AS far, max(v) FILTER (k > 0) - max(v) FILTER (k < 0) AS d FROM k WHERE k <> 0 AND abs(k) <= half GROUP BY ALL),
asym AS (SELECT line_id, coalesce(a, 0) AS asymmetry FROM (SELECT DISTINCT line_id FROM mag) LEFT JOIN (SELECT line_id, sqrt(sum(d * d * 10000)) AS a FROM d GROUP BY line_id) USING (line_id))"""


def _asymmetry(spark, sf_dir):
    return S.asymmetry(curves(spark, sf_dir).withColumn("v", C.log_brightness(F.col("v")))).select("line_id", "asymmetry")


@query(f"WITH {_ASYMMETRY} SELECT line_id, round(asymmetry, 4) + 0.0 AS asymmetry FROM asym")
def asymmetry(spark, sf_dir):
    return _asymmetry(spark, sf_dir).select("line_id", (F.round("asymmetry", 4) + F.lit(0.0)).alias("asymmetry"))


@query(f"WITH {_ASYMMETRY}, b AS (SELECT floor(round(asymmetry, 4) * 100 / 10000)::BIGINT AS bucket, round(asymmetry, 4) AS a FROM asym) SELECT bucket, floor(avg(a) * 1000 + 0.317) / 1000 AS mean, floor(stddev_pop(a) * 1000 + 0.317) / 1000 AS deviation, count(*) AS n FROM b GROUP BY bucket")
def asym_buckets(spark, sf_dir):
    a = _asymmetry(spark, sf_dir).withColumn("a", F.round("asymmetry", 4)).withColumn("part", F.col("a") / 10000)
    s = E.bucket_statistics(E.asymmetry_buckets(a, "part"), "a")
    # Whole thousandths, cut where means of a few four-digit numbers never lie.
    cut = lambda c: (F.floor(F.col(c) * 1000 + 0.317) / 1000).alias(c)
    return s.select("bucket", cut("mean"), cut("deviation"), "n")


@query(f"""WITH {_ASYMMETRY}, a AS (SELECT round(asymmetry, 4) AS a FROM asym), e AS (SELECT min(a) AS lo, max(a) AS hi FROM a)
SELECT round_even((a - lo) / ((hi - lo) / 8), 0)::INT AS class, count(*) AS n FROM a, e GROUP BY 1""")
def classification_table(spark, sf_dir):
    a = _asymmetry(spark, sf_dir).withColumn("asymmetry", F.round("asymmetry", 4))
    return E.classification(a, 8).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CURVES}, w AS (SELECT line_id, sample_idx, round(sum(v) OVER (PARTITION BY line_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS t FROM curves),
p AS (SELECT line_id, arg_max(sample_idx, (v, -sample_idx)) AS p, count(*) AS n FROM curves GROUP BY line_id)
SELECT line_id, arg_max(sample_idx, (t, -sample_idx)) AS s, least(arg_max(sample_idx, (t, -sample_idx)) + 10, max(n)) AS e FROM w JOIN p USING (line_id) WHERE sample_idx < p AND sample_idx >= p - 10 GROUP BY line_id""")
def trim_window(spark, sf_dir):
    return S.trim_window(curves(spark, sf_dir), 10).select("line_id", "s", "e")


#: Samples brighter than this are taken for peaks.
BRIGHT = 150


def _events(spark, sf_dir):
    peaks = curves(spark, sf_dir).where(f"v > {BRIGHT}").select("trial", "line_id", F.col("sample_idx").alias("peak"))
    return S.peak_slices(peaks, S.peak_of(curves(spark, sf_dir)), 6)


_EVENTS = f"""{TRIALS}, pk AS (SELECT line_id, sample_idx AS peak FROM curves WHERE trial = 0 AND v > {BRIGHT}),
ln AS (SELECT line_id, count(*) AS n FROM curves WHERE trial = 0 GROUP BY line_id),
iv AS (SELECT line_id, peak, greatest(0, peak - 6) AS s, least(peak + 6, n - 1) AS e FROM pk JOIN ln USING (line_id)),
ev AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY peak) - 1 AS event_id FROM iv WHERE e - s > 3),
al AS (SELECT line_id, event_id, trial, sample_idx - s AS pos, v FROM curves JOIN ev USING (line_id) WHERE sample_idx >= s AND sample_idx < e)"""


@query(f"WITH {_EVENTS} SELECT line_id, event_id, peak, s, e FROM ev")
def event_slices(spark, sf_dir):
    return _events(spark, sf_dir).select("line_id", "event_id", "peak", "s", "e")


def _aligned(spark, sf_dir):
    return E.align_events(curves(spark, sf_dir, (0, 1, 2)), _events(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT line_id, event_id, trial, pos, round(v, 6) + 0.0 AS v FROM al")
def align_events(spark, sf_dir):
    return _aligned(spark, sf_dir).select("line_id", "event_id", "trial", "pos", r6("v", "v"))


_SHIFTS = f"""{_EVENTS}, tp AS (SELECT line_id, event_id, trial, arg_max(pos, (v, -pos)) AS p FROM al GROUP BY ALL),
sh AS (SELECT line_id, event_id, t.trial, abs(t.p - r.p) AS shift FROM tp t JOIN (SELECT * FROM tp WHERE trial = 0) r USING (line_id, event_id))"""


@query(f"WITH {_SHIFTS} SELECT * FROM sh")
def peak_shift(spark, sf_dir):
    return E.peak_shifts(_aligned(spark, sf_dir))


@query(f"WITH {_SHIFTS} SELECT trial, least(shift, 9) AS bin, count(*) AS n FROM sh WHERE shift <= 10 GROUP BY 1, 2")
def shift_histogram(spark, sf_dir):
    return E.shift_histogram(E.peak_shifts(_aligned(spark, sf_dir)), 10)


@query(f"""WITH {_EVENTS}, w AS (SELECT line_id, event_id, pos, v - min(v) OVER k AS v, count(*) OVER k AS n, first(v) OVER (PARTITION BY line_id, event_id ORDER BY pos) AS a,
    first(v) OVER (PARTITION BY line_id, event_id ORDER BY pos DESC) AS b FROM al WHERE trial = 0 WINDOW k AS (PARTITION BY line_id, event_id)),
f AS (SELECT line_id, event_id, CASE WHEN a >= b THEN n - 1 - pos ELSE pos END AS p, v FROM w), t AS (SELECT line_id, event_id, arg_max(p, (v, -p)) AS top FROM f GROUP BY ALL)
SELECT line_id, event_id, p - top AS pos, round(v, 6) + 0.0 AS v FROM f JOIN t USING (line_id, event_id)""")
def sample_normalization(spark, sf_dir):
    a = _aligned(spark, sf_dir).where("trial = 0").drop("trial")
    return E.normalized_sample(a).select("line_id", "event_id", "pos", r6("v", "v"))


@query(f"WITH {TRIALS} SELECT line_id, sample_idx, max(v) FILTER (trial = 0) AS trial_0, round(max(v) FILTER (trial = 1), 6) AS trial_1, round(max(v) FILTER (trial = 2), 6) AS trial_2 FROM curves GROUP BY ALL")
def light_curve_matrix(spark, sf_dir):
    m = E.curve_matrix(curves(spark, sf_dir, (0, 1, 2)), (0, 1, 2))
    return m.select("line_id", "sample_idx", "trial_0", F.round("trial_1", 6).alias("trial_1"), F.round("trial_2", 6).alias("trial_2"))


@query(f"WITH {CURVES} SELECT line_id, sample_idx, v FROM curves UNION ALL SELECT line_id, sample_idx, v FROM curves WHERE v > {BRIGHT}")
def batch_union(spark, sf_dir):
    c = curves(spark, sf_dir).select("line_id", "sample_idx", "v")
    return E.append_tables(c, c.where(f"v > {BRIGHT}"))


@query(f"""WITH {CURVES}, z AS (SELECT line_id, sample_idx, v / 100 - 2 AS z FROM curves)
SELECT line_id, sample_idx, round(CASE WHEN z > 0.125 THEN 16 * (sqrt(z / 2 + 0.125) - sqrt(greatest(z / 2 - 0.125, 0))) WHEN z > -0.125 THEN 16 * sqrt(greatest(z / 2 + 0.125, 0)) ELSE 0 END + 0.5, 6) + 0.0 AS model FROM z""")
def caustic_crossing_model(spark, sf_dir):
    x = F.col("v")
    return curves(spark, sf_dir).select("line_id", "sample_idx", r6(C.caustic_crossing(x / 100, 2.0, 0.5, 2.0, 1.0, 0.5), "model"))


@query("SELECT p_partkey, round(abs(1 / nullif((1 - k) * (1 - k) - g * g, 0)), 6) + 0.0 AS magnification FROM (SELECT p_partkey, (p_partkey % 50) * 0.03125::DOUBLE AS k, (p_partkey % 23) * 0.0625::DOUBLE AS g FROM part)")
def magnification(spark, sf_dir):
    m = C.magnification(F.col("p_partkey") % 50 * 0.03125, F.col("p_partkey") % 23 * 0.0625)
    return table(spark, sf_dir, "part").select("p_partkey", r6(m, "magnification"))


@query(f"WITH {PLACES} SELECT ray_id, round(1.5 / nullif(2 * sqrt(0.64::DOUBLE * (x * sin(0.4) + y * cos(0.4)) * (x * sin(0.4) + y * cos(0.4)) + (y * sin(0.4) - x * cos(0.4)) * (y * sin(0.4) - x * cos(0.4))), 0), 6) + 0.0 AS k FROM places")
def sie_convergence(spark, sf_dir):
    return lens_places(spark, sf_dir).select("ray_id", r6(C.sie_convergence(F.col("x"), F.col("y"), 1.5, 0.8, 0.4), "k"))


# Maps.


@query(f"WITH {DENSE} SELECT px, py, round(-2.5 * log10(value + 0.001), 6) + 0.0 AS value FROM map")
def map_log_scale(spark, sf_dir):
    return M.scaled(counts_map(spark, sf_dir)).select("px", "py", r6("value", "value"))


@query(f"WITH {DENSE} SELECT 51 - px AS px, py, value FROM map")
def map_flip(spark, sf_dir):
    return M.flipped(counts_map(spark, sf_dir), 52)


@query(f"WITH {DENSE}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM map) SELECT least(floor((value - lo) / ((hi - lo) / 16))::INT, 15) AS bucket, count(*) AS n FROM map, e GROUP BY 1")
def map_histogram(spark, sf_dir):
    return M.histogram(counts_map(spark, sf_dir), 16)


_EDGES = """k AS (SELECT a, b, a * (2 - abs(b)) AS gx, b * (2 - abs(a)) AS gy FROM (VALUES (-1), (0), (1)) AS u(a), (VALUES (-1), (0), (1)) AS v(b)),
w AS (SELECT c.px, c.py, sum(k.gx * m.value) AS gx, sum(k.gy * m.value) AS gy FROM cells c, k JOIN {map} m ON m.px = least(greatest(c.px + k.a, 0), 51) AND m.py = least(greatest(c.py + k.b, 0), 11) GROUP BY ALL)"""


@query(f"WITH {DENSE}, {_EDGES.format(map='map')} SELECT px, py, abs(gx) + abs(gy) AS value FROM w")
def map_sobel(spark, sf_dir):
    return M.sobel_edges(counts_map(spark, sf_dir), 52, 12)


@query(f"""WITH {DENSE}, g AS (SELECT i - 4 AS o, exp(-0.5 * (i - 4) * (i - 4)) / (SELECT sum(exp(-0.5 * (i - 4) * (i - 4))) FROM range(9) AS t(i)) AS w FROM range(9) AS t(i)),
sx AS (SELECT c.px, c.py, sum(w * value) AS value FROM cells c, g JOIN map m ON m.px = least(greatest(c.px + g.o, 0), 51) AND m.py = c.py GROUP BY ALL),
sy AS (SELECT c.px, c.py, sum(w * value) AS value FROM cells c, g JOIN sx m ON m.px = c.px AND m.py = least(greatest(c.py + g.o, 0), 11) GROUP BY ALL), {_EDGES.format(map='sy')}
SELECT px, py, round(abs(gx) + abs(gy), 4) + 0.0 AS value FROM w""")
def map_smooth_edges(spark, sf_dir):
    return M.smooth_and_detect(counts_map(spark, sf_dir), 1.0, 52, 12).select("px", "py", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query(f"WITH {DENSE} SELECT range::INT AS sample_idx, px, py, value FROM range(41) JOIN map ON px = round_even(2 + range * (40::DOUBLE / 41), 0) AND py = round_even(1 + range * (9::DOUBLE / 41), 0)")
def line_slice(spark, sf_dir):
    return M.line_slice(counts_map(spark, sf_dir), (2.0, 1.0), (42.0, 10.0))


@query(f"""WITH {SAMPLED}, {POINTS}, c AS (SELECT DISTINCT floor(bx)::INT AS px, floor(yb / 0.5)::INT AS py FROM pts WHERE parity = 0 AND bx > floor(bx) AND yb / 0.5 > floor(yb / 0.5)),
at_pixel AS (SELECT curve_id, sample_idx, floor(qx)::INT AS px, floor(qy / 0.5)::INT AS py FROM track) SELECT curve_id, sample_idx, px, py FROM at_pixel JOIN c USING (px, py) WHERE px BETWEEN 0 AND 51 AND py BETWEEN 0 AND 19""")
def caustics_along_curve(spark, sf_dir):
    t = track(spark, sf_dir).select("curve_id", "sample_idx", F.floor("qx").cast("int").alias("px"), F.floor(F.col("qy") / 0.5).cast("int").alias("py"))
    return M.caustics_along(t, P.caustic_map(points(spark, sf_dir), PLANE)).select("curve_id", "sample_idx", "px", "py")


# Detectors. What depends on all that was found before is a recursion over a table of runs in SQL, one run or one decision at a time.


def _smooth_sql(sigma: str) -> str:
    """own: a Gaussian with a line's sigma, cut at four of it, over the line mirrored at its ends."""
    return f"""{CURVES}, n AS (SELECT line_id, count(*) AS n, {sigma} AS s FROM curves GROUP BY line_id), g AS (SELECT line_id, n, unnest(range(-floor(4 * s + 0.5)::INT, floor(4 * s + 0.5)::INT + 1)) AS o, s FROM n),
kw AS (SELECT *, exp(-0.5 * (o / s) ** 2) AS w, sum(exp(-0.5 * (o / s) ** 2)) OVER (PARTITION BY line_id) AS whole FROM g),
put AS (SELECT c.line_id, c.sample_idx, n, w / whole AS w, (((sample_idx + o) % (2 * n)) + 2 * n) % (2 * n) AS m FROM curves c JOIN kw USING (line_id)),
own AS (SELECT put.line_id, put.sample_idx, put.n, sum(w * v) AS sm FROM put JOIN curves c ON c.line_id = put.line_id AND c.sample_idx = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL)"""


_LINE = "(PARTITION BY line_id ORDER BY sample_idx)"


@query(f"""WITH RECURSIVE {_smooth_sql('1.1::DOUBLE')},
gr AS (SELECT line_id, sample_idx, n, coalesce(lead(sm) OVER {_LINE}, sm) - coalesce(lag(sm) OVER {_LINE}, sm) AS g FROM own),
sg AS (SELECT *, CASE WHEN g > 40 THEN 1 WHEN g < -40 THEN -1 ELSE 0 END AS side FROM gr),
isl AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY line_id, side ORDER BY sample_idx) AS island FROM sg),
edge AS (SELECT line_id, n, side, min(sample_idx) AS a, max(sample_idx) + 1 AS b, row_number() OVER (PARTITION BY line_id ORDER BY min(sample_idx)) AS k FROM isl WHERE side <> 0 GROUP BY line_id, n, side, island),
vs AS (SELECT line_id, list(v ORDER BY sample_idx) AS vs FROM curves GROUP BY line_id),
r AS (SELECT line_id, vs, 0::BIGINT AS k, 0::BIGINT AS free, []::BIGINT[] AS kept FROM vs
 UNION ALL SELECT line_id, vs, k, CASE WHEN skip THEN free ELSE b + 1 + CASE WHEN counts AND side > 0 THEN 5 ELSE 0 END END,
   CASE WHEN skip OR NOT counts THEN kept WHEN len(kept) = 0 OR top - kept[-1] > 5 THEN list_append(kept, top) WHEN vs[top + 1] > vs[kept[-1] + 1] THEN list_append(kept[:-2], top) ELSE kept END
 FROM (SELECT *, 0 < top AND top < n - 1 AND greatest(vs[top], vs[top + 2]) < vs[top + 1] AS counts FROM
  (SELECT *, low + list_position(vs[low + 1:high], list_max(vs[low + 1:high])) - 1 AS top FROM
   (SELECT r.line_id, vs, e.k, free, kept, side, b, n, greatest(a, free) >= b OR b = n AS skip,
      CASE WHEN side > 0 THEN greatest(a, free) ELSE greatest(0, greatest(a, free) - 5) END AS low, CASE WHEN side > 0 THEN least(b + 6, n) ELSE b + 1 END AS high
    FROM r JOIN edge e ON e.line_id = r.line_id AND e.k = r.k + 1)))),
fin AS (SELECT line_id, arg_max(kept, k) AS kept FROM r GROUP BY line_id), pk AS (SELECT DISTINCT line_id, unnest(kept) AS p FROM fin)
SELECT 0 AS trial, line_id, (row_number() OVER (PARTITION BY line_id ORDER BY p) - 1)::INT AS event_id, p::INT AS s, (p + 1)::INT AS e FROM pk""")
def sobel_detect(spark, sf_dir):
    return S.detect(curves(spark, sf_dir), "sobel", threshold=40.0, smoothing=1.1, min_separation=5, isolated=False)


@query(f"""WITH RECURSIVE {CURVES}, c AS (SELECT line_id, sample_idx AS i FROM (SELECT *, v - (lag(v, 3) OVER {OVER} + lead(v, 3) OVER {OVER}) / 2 AS d FROM curves) WHERE d > 100),
hit AS (SELECT line_id, min(i) AS i FROM c GROUP BY line_id UNION ALL SELECT h.line_id, min(c.i) AS i FROM hit h JOIN c ON c.line_id = h.line_id AND c.i >= h.i + 3 GROUP BY h.line_id, h.i),
top AS (SELECT h.line_id, h.i, arg_max(sample_idx, (v, -sample_idx)) AS p FROM hit h JOIN curves ON curves.line_id = h.line_id AND sample_idx >= h.i - 3 AND sample_idx < h.i + 3 GROUP BY ALL)
SELECT 0 AS trial, line_id, (row_number() OVER (PARTITION BY line_id ORDER BY i) - 1)::INT AS event_id, p::INT AS s, (p + 1)::INT AS e FROM top""")
def find_peaks(spark, sf_dir):
    return S.detect(curves(spark, sf_dir), "drop", width=6, least=100.0)


_BASE = f"""{_smooth_sql('count(*) * 3 / 55.0::DOUBLE')}, df AS (SELECT line_id, sample_idx, n, v - sm AS d FROM own JOIN curves USING (line_id, sample_idx))"""


@query(f"""WITH RECURSIVE {_BASE},
t AS (SELECT *, coalesce((d + lag(d) OVER {_LINE}) / 2, d) AS t FROM df), u AS (SELECT *, sum(t) OVER {_LINE} AS upto FROM t),
isl AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY line_id ORDER BY sample_idx) AS island FROM u WHERE t > 0),
rn AS (SELECT line_id, min(sample_idx) AS a, max(sample_idx) + 1 AS b, max(t) AS top FROM isl GROUP BY line_id, n, island HAVING max(sample_idx) + 1 < n),
ru AS (SELECT rn.line_id, a, b, top, p.upto AS ua, q.upto AS ub FROM rn JOIN u p ON p.line_id = rn.line_id AND p.sample_idx = a JOIN u q ON q.line_id = rn.line_id AND q.sample_idx = b),
ls AS (SELECT line_id, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb, list(top ORDER BY a) AS lt, list(ua ORDER BY a) AS lua, list(ub ORDER BY a) AS lub, count(*) AS m FROM ru GROUP BY line_id),
-- phase 0: a run by itself; 1: the chain grows; 2: it is cut back from its end; 3: an event.
st AS (SELECT line_id, 0 AS phase, 1::BIGINT AS k, 1::BIGINT AS e, 1::BIGINT AS j FROM ls
 UNION ALL SELECT line_id, CASE phase WHEN 0 THEN CASE WHEN worth THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN grows THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN j <= k THEN 3 ELSE 2 END ELSE 0 END,
   CASE WHEN phase = 0 AND NOT worth THEN k + 1 WHEN phase = 3 THEN e + 1 ELSE k END,
   CASE WHEN phase = 0 THEN k WHEN phase = 1 AND grows THEN e + 1 WHEN phase = 2 AND j > k AND weak THEN j - 1 ELSE e END,
   CASE WHEN phase = 1 THEN e WHEN phase = 2 THEN j - 1 ELSE j END
 FROM (SELECT st.*, lub[k] - lua[k] >= 50 OR lt[k] >= 100 AS worth,
     coalesce(e < m AND la[e + 1] - lb[e] < 5 AND (lub[e + 1] - lua[e + 1] >= 50 OR lt[e + 1] >= 100) AND la[e + 1] - la[k] < 40, false) AS grows,
     lub[e] - lua[j] <= 50 AND list_max(lt[j:e]) <= 100 AS weak FROM st JOIN ls USING (line_id) WHERE k <= m))
SELECT 0 AS trial, line_id, (row_number() OVER (PARTITION BY line_id ORDER BY k) - 1)::INT AS event_id, greatest(la[k] - 1, 0)::INT AS s, lb[e]::INT AS e FROM st JOIN ls USING (line_id) WHERE phase = 3""")
def find_events(spark, sf_dir):
    return S.detect(curves(spark, sf_dir), "threshold", area=50.0, height=100.0, max_length=40, stitch=5)


@query(f"""WITH RECURSIVE {_BASE},
isl AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY line_id ORDER BY sample_idx) AS island FROM df WHERE d >= 0 AND sample_idx < n - 1),
rn AS (SELECT line_id, greatest(0, min(sample_idx) - 1) AS a, max(sample_idx) + 2 AS b FROM isl GROUP BY line_id, island),
big AS (SELECT rn.line_id, a, b, row_number() OVER (PARTITION BY rn.line_id ORDER BY a) AS k FROM rn JOIN df ON df.line_id = rn.line_id AND sample_idx >= a AND sample_idx < b - 1 GROUP BY rn.line_id, a, b HAVING max(d) - min(d) > 50),
ds AS (SELECT line_id, list(d ORDER BY sample_idx) AS ds FROM df GROUP BY line_id),
r AS (SELECT line_id, k, a, b, false AS pair, 1 AS ev FROM big WHERE k = 1
 UNION ALL SELECT line_id, k, CASE WHEN joins THEN a ELSE na END, nb, joins, CASE WHEN joins THEN ev ELSE ev + 1 END
 FROM (SELECT r.line_id, big.k, r.a, r.ev, big.a AS na, big.b AS nb,
     NOT r.pair AND big.b - r.a < 30 AND big.a - r.b < 5 AND coalesce(list_max(list_transform(ds[r.b + 1:big.a], lambda x: abs(x))) < 200, true) AS joins
   FROM r JOIN big ON big.line_id = r.line_id AND big.k = r.k + 1 JOIN ds ON ds.line_id = r.line_id))
SELECT 0 AS trial, line_id, (ev - 1)::INT AS event_id, arg_max(a, k)::INT AS s, arg_max(b, k)::INT AS e FROM r GROUP BY line_id, ev""")
def isolate_events(spark, sf_dir):
    return S.detect(curves(spark, sf_dir), "isolate", tolerance=200.0, max_length=30, stitch=5, least=50.0)


@query(f"""WITH RECURSIVE {CURVES}, c AS (SELECT line_id, list(v) AS own, 0 AS k FROM curves GROUP BY line_id
UNION ALL SELECT line_id, list_filter(own, lambda x: abs(x - list_avg(own)) <= 1.5 * list_stddev_pop(own)), k + 1 FROM c WHERE k < 60)
SELECT line_id, round(list_avg(own), 4) + 0.0 AS mean, round(list_avg(own), 4) + 0.0 AS middle FROM c WHERE k = 60""")
def clipped_baseline(spark, sf_dir):
    return S.clipped_baselines(curves(spark, sf_dir), 1.5).select("line_id", half_up(F.col("mean"), 4).alias("mean"), half_up(F.col("middle"), 4).alias("middle"))


@query(f"""WITH {CURVES}, n AS (SELECT line_id, count(*) AS n FROM curves GROUP BY line_id), g AS (SELECT i - 8 AS o, exp(-0.125 * (i - 8) * (i - 8)) AS w FROM range(17) AS t(i)),
put AS (SELECT line_id, sample_idx, n, w / (SELECT sum(w) FROM g) AS w, (((sample_idx + o) % (2 * n)) + 2 * n) % (2 * n) AS m FROM curves JOIN n USING (line_id), g)
SELECT put.line_id, put.sample_idx, round(sum(w * v), 4) + 0.0 AS smooth FROM put JOIN curves c ON c.line_id = put.line_id AND c.sample_idx = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL""")
def gaussian_smooth(spark, sf_dir):
    return S.gaussian_smooth(curves(spark, sf_dir), 2.0).select("line_id", "sample_idx", (F.round("smooth", 4) + F.lit(0.0)).alias("smooth"))


# Parts of the above that are of use by themselves.


@query(f"""WITH {POINTS}, mesh AS (SELECT (range % 52)::INT AS px, (range // 52)::INT AS py, (range % 52) * (52.0::DOUBLE / 51) AS qx, (range // 52) * (10.0::DOUBLE / 19) AS qy FROM range(1040))
SELECT px, py, count(*) AS m0 FROM pts JOIN mesh ON {NEAR} GROUP BY px, py""")
def disk_mesh(spark, sf_dir):
    """Disks about a mesh that includes its far edges."""
    return J.disk_join(points(spark, sf_dir), PLANE, RADIUS, mesh=True)


@query(f"""WITH {POINTS}, n AS (SELECT count(*) AS n FROM pts), k AS (SELECT unnest([1, n // 4 + 1, n // 2, n]) AS k FROM n),
x AS (SELECT bx AS v, row_number() OVER (ORDER BY bx) AS k FROM pts), y AS (SELECT yb AS v, row_number() OVER (ORDER BY yb) AS k FROM pts)
SELECT 'bx' AS axis, k, v FROM x JOIN k USING (k) UNION ALL SELECT 'by', k, v FROM y JOIN k USING (k)""")
def kth_by_axis(spark, sf_dir):
    """The least, the greatest and two values between of each axis, by rank."""
    n = F.col("n")
    ranks = [F.lit(1), F.floor(n / 4) + 1, F.floor(n / 2), n]
    return J.order_statistics(points(spark, sf_dir), {"bx": ranks, "by": ranks}).select("axis", "k", "v")


@query(f"""WITH {POINTS}, r AS (SELECT bx, row_number() OVER (ORDER BY bx) AS k, count(*) OVER () AS n FROM pts),
cut AS (SELECT DISTINCT bx AS c FROM r, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS i) WHERE k = ceil(n * i / 8.0))
SELECT column_, min(bx) AS low, max(bx) AS high, count(*) AS n FROM (SELECT bx, (SELECT count(*) FROM cut WHERE c < bx)::INT AS column_ FROM pts) GROUP BY column_""".replace("column_", '"column"'))
def column_partitions(spark, sf_dir):
    """Columns of about equal size along x: their edges and how many points they hold."""
    return J.column_ranges(points(spark, sf_dir), "bx", 8)


@query(f"WITH {_EVENTS} SELECT line_id, event_id, min(v) AS low, max(v) AS high FROM al WHERE trial = 0 GROUP BY ALL")
def interval_extremes(spark, sf_dir):
    return S.interval_extremes(curves(spark, sf_dir), _events(spark, sf_dir)).select("line_id", "event_id", "low", "high")


_ENDS = "ends AS (SELECT n_nationkey AS line_id, n_nationkey % 5 + 1 AS n, n_nationkey * 0.5::DOUBLE AS x0, 1.0::DOUBLE AS y0, n_nationkey * 0.25::DOUBLE AS x1, n_nationkey * 2.0::DOUBLE AS y1 FROM nation)"
_SPREAD = f"{_ENDS}, spread AS (SELECT line_id, i::INT AS sample_idx, x0 + (x1 - x0) * coalesce(i::DOUBLE / nullif(n - 1, 0), 0) AS x, y0 + (y1 - y0) * coalesce(i::DOUBLE / nullif(n - 1, 0), 0) AS y FROM ends, LATERAL (SELECT unnest(range(n)) AS i) r)"


def _spread(spark, sf_dir):
    k = F.col("n_nationkey")
    ends = table(spark, sf_dir, "nation").select(k.alias("line_id"), (k % 5 + 1).alias("n"), (k * 0.5).alias("x0"), F.lit(1.0).alias("y0"), (k * 0.25).alias("x1"), (k * 2.0).alias("y1"))
    return S.curve_points(ends)


@query(f"WITH {_SPREAD} SELECT line_id, sample_idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM spread")
def curve_points(spark, sf_dir):
    return _spread(spark, sf_dir).select("line_id", "sample_idx", r6("x", "x"), r6("y", "y"))


@query(f"""WITH {_SPREAD}, d AS (SELECT s.line_id, s.sample_idx, sqrt((s.x - f.x) * (s.x - f.x) + (s.y - f.y) * (s.y - f.y)) AS d FROM spread s JOIN spread f ON f.line_id = s.line_id AND f.sample_idx = 0)
SELECT line_id, round(arg_max(d, sample_idx), 6) + 0.0 AS length, round(max(d) FILTER (sample_idx = 1), 6) + 0.0 AS density FROM d GROUP BY line_id""")
def curve_lengths(spark, sf_dir):
    return S.curve_lengths(_spread(spark, sf_dir), ("line_id",)).select("line_id", r6("length", "length"), r6("density", "density"))


@query(f"""WITH {_ASYMMETRY}, a AS (SELECT line_id, round(asymmetry, 4) AS a FROM asym), e AS (SELECT min(a) AS lo, max(a) AS hi FROM a)
SELECT line_id, round_even((a - lo) / ((hi - lo) / 8), 0)::INT AS class FROM a, e WHERE round_even((a - lo) / ((hi - lo) / 8), 0) IN (0, 2, 8)""")
def merge_buckets(spark, sf_dir):
    a = _asymmetry(spark, sf_dir).withColumn("asymmetry", F.round("asymmetry", 4))
    return E.merge_buckets(E.classification(a, 8), (0, 2, 8)).select("line_id", "class")


@query(f"""WITH {_ASYMMETRY}, a AS (SELECT line_id, round(asymmetry, 4) AS a FROM asym), e AS (SELECT min(a) AS lo, max(a) AS hi FROM a),
c AS (SELECT line_id, round_even((a - lo) / ((hi - lo) / 8), 0)::INT AS class FROM a, e)
SELECT line_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('5:' || line_id), line_id) AS n FROM c) WHERE n <= 3""")
def bucket_samples(spark, sf_dir):
    """Three curves of every class."""
    a = _asymmetry(spark, sf_dir).withColumn("asymmetry", F.round("asymmetry", 4))
    return E.bucket_samples(E.classification(a, 8), 3, 5).select("line_id", "class")


@query(f"""WITH {_SHIFTS}, pk2 AS (SELECT line_id, event_id, trial, arg_max(pos, (v, -pos)) AS p, count(*) AS n FROM al GROUP BY ALL),
k2 AS (SELECT line_id, event_id, trial, pos - p AS k, least(p, n - p) - 1 AS half, v FROM al JOIN pk2 USING (line_id, event_id, trial)),
d2 AS (SELECT line_id, event_id, trial, abs(k) AS far, max(v) FILTER (k > 0) - max(v) FILTER (k < 0) AS d FROM k2 WHERE k <> 0 AND abs(k) <= half GROUP BY ALL),
a2 AS (SELECT line_id, event_id, trial, sqrt(sum(d * d * 10000)) AS a FROM d2 GROUP BY ALL)
SELECT line_id, event_id, trial, shift, round(coalesce(a, 0), 3) + 0.0 AS asymmetry FROM sh LEFT JOIN a2 USING (line_id, event_id, trial)""")
def bulk_analysis(spark, sf_dir):
    b = E.bulk_analysis(curves(spark, sf_dir, (0, 1, 2)), _events(spark, sf_dir))
    return b.select("line_id", "event_id", "trial", "shift", (F.round("asymmetry", 3) + F.lit(0.0)).alias("asymmetry"))


@query(f"WITH {POINTS}, {GRID} SELECT px, py, round(coalesce(sum((x - bx) * (y - yb)), 0), 6) + 0.0 AS value FROM grid LEFT JOIN pts ON {NEAR} GROUP BY px, py")
def moment_selection(spark, sf_dir):
    return M.moment(P.moment_map(points(spark, sf_dir), PLANE, RADIUS), 4).select("px", "py", r6("value", "value"))


@query(f"""WITH {DENSE}, line AS (SELECT range::INT AS sample_idx, px, py, -2.5 * log10(value + 0.001) AS v FROM range(41) JOIN map ON px = round_even(2 + range * (40::DOUBLE / 41), 0) AND py = round_even(1 + range * (9::DOUBLE / 41), 0)),
f AS (SELECT px AS x0, py AS y0 FROM line WHERE sample_idx = 0)
SELECT sample_idx, round(v, 6) + 0.0 AS v, round(sqrt((px - x0) * (px - x0) + (py - y0) * (py - y0)), 6) + 0.0 AS distance FROM line, f""")
def drawn_curve(spark, sf_dir):
    """A line drawn on a map, as a light curve with its distance axis."""
    return S.with_distance(M.drawn_curve(M.scaled(counts_map(spark, sf_dir)), (2.0, 1.0), (42.0, 10.0))).select("sample_idx", r6("v", "v"), r6("distance", "distance"))


@query(f"""WITH {PLACES}, k AS (SELECT ray_id, x, y, 1.5 / nullif(2 * sqrt(0.64::DOUBLE * (x * sin(0.4) + y * cos(0.4)) * (x * sin(0.4) + y * cos(0.4)) + (y * sin(0.4) - x * cos(0.4)) * (y * sin(0.4) - x * cos(0.4))), 0) AS k FROM places)
SELECT ray_id, round(0.1::DOUBLE * cos(0.6) - k * ((x * x - y * y) / nullif(x * x + y * y, 0)), 6) + 0.0 AS g1, round(0.1::DOUBLE * sin(0.6) - k * (2 * x * y / nullif(x * x + y * y, 0)), 6) + 0.0 AS g2 FROM k""")
def sie_shear(spark, sf_dir):
    g1, g2 = C.sie_shear(F.col("x"), F.col("y"), 1.5, 0.8, 0.4, 0.1, 0.3)
    return lens_places(spark, sf_dir).select("ray_id", r6(g1, "g1"), r6(g2, "g2"))


@query(f"""WITH m AS (SELECT p_partkey, {_MASS} * 0.5 AS lo, {_MASS} AS hi FROM part),
c AS (SELECT *, greatest(lo, 0.08) AS a1, least(hi, 0.5) AS b1, greatest(lo, 0.5) AS a2, least(hi, 1.5) AS b2 FROM m)
SELECT p_partkey, round(CASE WHEN b1 > a1 THEN (b1 ** -0.3 - a1 ** -0.3) / -0.3 ELSE 0 END + CASE WHEN b2 > a2 THEN {float(_KROUPA.coeffs[1])!r}::DOUBLE * (b2 ** -1.7 - a2 ** -1.7) / -1.7 ELSE 0 END, 6) + 0.0 AS number,
  round(CASE WHEN b1 > a1 THEN (b1 ** 0.7 - a1 ** 0.7) / 0.7 ELSE 0 END + CASE WHEN b2 > a2 THEN {float(_KROUPA.coeffs[1])!r}::DOUBLE * (b2 ** -0.7 - a2 ** -0.7) / -0.7 ELSE 0 END, 6) + 0.0 AS mass FROM c""")
def imf_integral(spark, sf_dir):
    """Stars and their mass between two masses."""
    high = (F.col("p_partkey") % 200 + 1) * F.lit(0.01)
    return table(spark, sf_dir, "part").select("p_partkey", r6(imf.integral_column(high * 0.5, high, _KROUPA), "number"), r6(imf.integral_column(high * 0.5, high, _KROUPA, 1), "mass"))
