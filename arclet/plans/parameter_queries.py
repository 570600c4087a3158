"""Queries over parameters, units, seeded fields and files, each with the SQL that gives the same rows.

Lenses, sources and trials come from part and customer, stars from supplier, lines from nation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import cosmology as K
from ..functions.model import DOCUMENTS, Disk, Vec
from ..sources import documents as D
from ..sources import files as X
from ..sources import formats
from ..sources import lattice as L
from ..sources import lines as N
from ..sources import stars as ST
from .queries import CLIPPED, DENSE, ORACLE, PLACES, PLANE, QUERIES, SAMPLED, STARS, TRACK_BOX, counts_map, lens_places, query, r6, stars, table, track, trajectories
from .session import shared_folder, spread

__all__ = ["ORACLE", "QUERIES"]

# Lens scales.

MPC, UAS = 1e6 * K.PARSEC, D.ANGLES["uas"]


def _comoving_sql(z: str) -> str:
    """The same quadrature in SQL."""
    lam, out = 1 - K.OMEGA_MATTER - K.RADIATION, []
    for x, w in zip(*np.polynomial.legendre.leggauss(K.NODES)):
        a = f"(1 + {z} * {float((1 + x) / 2)!r}::DOUBLE)"
        out.append(f"{float(w)!r}::DOUBLE / sqrt({K.OMEGA_MATTER}::DOUBLE * {a} ** 3 + {K.RADIATION!r}::DOUBLE * {a} ** 4 + {lam!r}::DOUBLE)")
    return f"({K.HUBBLE_LENGTH / 2!r}::DOUBLE * {z} * ({' + '.join(out)}))"


_LENSES = f"""lenses AS (SELECT p_partkey, 0.1::DOUBLE + p_partkey % 37 * 0.02::DOUBLE AS zl, 0.3::DOUBLE + p_partkey % 37 * 0.02::DOUBLE + p_partkey % 11 * 0.15::DOUBLE AS zs,
  150000 + p_size * 5000::DOUBLE AS speed, 1 + p_partkey % 7::DOUBLE AS mass FROM part),
far AS (SELECT *, {_comoving_sql('zl')} AS cl, {_comoving_sql('zs')} AS cs FROM lenses),
d AS (SELECT *, cl / (1 + zl) AS dl, cs / (1 + zs) AS ds, (cs - cl) / (1 + zs) AS dls FROM far)"""


def lenses(spark, sf_dir):
    k = F.col("p_partkey")
    zl = F.lit(0.1) + k % 37 * F.lit(0.02)
    zs = F.lit(0.3) + k % 37 * F.lit(0.02) + k % 11 * F.lit(0.15)
    return table(spark, sf_dir, "part").select("p_partkey", zl.alias("zl"), zs.alias("zs"), (150000 + F.col("p_size") * F.lit(5000.0)).alias("speed"), (1 + k % 7).cast("double").alias("mass"))


def far_lenses(spark, sf_dir):
    return K.with_distances(spread(lenses(spark, sf_dir), "p_partkey"), F.col("zs"), F.col("zl"))


def known():
    """The distances of far_lenses()."""
    return F.col("d_l"), F.col("d_s"), F.col("d_ls")


@query(f"WITH {_LENSES} SELECT p_partkey, round(dl / {MPC!r}::DOUBLE, 4) AS d_lens, round(ds / {MPC!r}::DOUBLE, 4) AS d_source, round(dls / {MPC!r}::DOUBLE, 4) AS d_between FROM d")
def angular_distances(spark, sf_dir):
    """Distances to lens and source, and between them, in Mpc."""
    d = dict(zip(("d_lens", "d_source", "d_between"), known()))
    return far_lenses(spark, sf_dir).select("p_partkey", *[F.round(c / F.lit(MPC), 4).alias(n) for n, c in d.items()])


@query(f"""WITH {_LENSES} SELECT p_partkey, round(sqrt({4 * K.G * K.SOLAR_MASS / K.C**2!r}::DOUBLE * mass * dls / (dl * ds)) / {UAS!r}::DOUBLE, 6) AS theta_e,
  round({4 * math.pi / K.C**2!r}::DOUBLE * speed * speed * dls / ds / {D.ARCSEC!r}::DOUBLE, 6) AS ring,
  round({K.C**2 / (4 * math.pi * K.G) / K.SOLAR_MASS!r}::DOUBLE * ds * dl / dls * {1e-9 * D.ARCSEC**2!r}::DOUBLE, 4) AS density,
  round({K.G * K.SOLAR_MASS / K.C**2 * 1e9!r}::DOUBLE * mass / ds / {UAS!r}::DOUBLE, 8) AS r_g FROM d""")
def lens_scales(spark, sf_dir):
    """The Einstein angle of a star in microarcseconds, that of an isothermal sphere in arcseconds, the critical density in 10⁹ solar masses
    a square arcsecond, and the gravitational radius of 10⁹ times the mass in microarcseconds."""
    zl, zs, m = F.col("zl"), F.col("zs"), F.col("mass")
    return far_lenses(spark, sf_dir).select(
        "p_partkey", F.round(K.theta_e_column(zs, zl, m, known()) / F.lit(UAS), 6).alias("theta_e"), F.round(K.einstein_radius_column(F.col("speed"), zs, zl, known()) / F.lit(D.ARCSEC), 6).alias("ring"),
        F.round(K.critical_density_column(zs, zl, known()) * F.lit(1e-9 * D.ARCSEC**2), 4).alias("density"), F.round(K.gravitational_radius_column(m * F.lit(1e9), zs, known()[1]) / F.lit(UAS), 8).alias("r_g"),
    )


_UNITS = ("theta_E", "rad", "deg", "arcsec", "mas", "uas", "m", "km", "AU", "pc", "lyr", "r_g", "furlong")


@query(f"""WITH {_LENSES}, v AS (SELECT *, 1 + p_partkey % 9::DOUBLE AS value, [{', '.join(f"'{u}'" for u in _UNITS)}][p_partkey % {len(_UNITS)} + 1] AS unit, sqrt({4 * K.G * K.SOLAR_MASS / K.C**2!r}::DOUBLE * dls / (dl * ds)) AS theta FROM d),
a AS (SELECT p_partkey, unit, CASE unit WHEN 'theta_E' THEN value WHEN 'r_g' THEN value * {K.G * K.SOLAR_MASS / K.C**2 * 1e9!r}::DOUBLE * mass / ds / theta {' '.join(f"WHEN '{u}' THEN value * {s!r}::DOUBLE / theta" for u, s in D.ANGLES.items())}
  {' '.join(f"WHEN '{u}' THEN value * {s!r}::DOUBLE / ds / theta" for u, s in D.LENGTHS.items())} END AS angle FROM v)
SELECT p_partkey, unit, round(log10(angle), 8) + 0.0 AS angle FROM a""")
def unit_angles(spark, sf_dir):
    """Quantities of all units as Einstein angles (their logarithm, as they span thirty decades); an unknown unit gives null."""
    unit = F.get(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    angle = D.angle_column((1 + F.col("p_partkey") % 9).cast("double"), unit, F.col("zs"), F.col("zl"), F.col("mass") * F.lit(1e9), known())
    return far_lenses(spark, sf_dir).select("p_partkey", unit.alias("unit"), (F.round(F.log10(angle), 8) + F.lit(0.0)).alias("angle"))


# Fields.

_FIELDS = "fields AS (SELECT p_partkey, p_partkey % 16 * 0.0625::DOUBLE AS k, p_partkey % 23 * 0.0625::DOUBLE AS g, p_size * 2::DOUBLE AS percent, 1 + p_partkey % 5 * 0.25::DOUBLE AS r FROM part)"


@query(f"""WITH {_FIELDS}, w AS (SELECT *, 30 * nullif(abs(1 + g - k) / nullif(abs(1 - g - k), 0), 0) AS w FROM fields)
SELECT p_partkey, round(k * (1 - percent / 100), 8) + 0.0 AS smooth, round(k * percent / 100, 8) + 0.0 AS starry, round(w, 6) AS width, 20.0::DOUBLE AS height, round(w * 0.6, 6) AS starry_radius,
  round({math.pi!r}::DOUBLE * r * r / (w / 2000 * (20::DOUBLE / 2000)) * abs(1 / nullif((1 - k) * (1 - k) - g * g, 0)), 3) AS brightness FROM w""")
def field_scales(spark, sf_dir):
    """What follows from a field's convergence, shear and share of stars: split, ray window, starry disk and the star-free brightness."""
    k, g = F.col("p_partkey") % 16 * 0.0625, F.col("p_partkey") % 23 * 0.0625
    radius = 1 + F.col("p_partkey") % 5 * 0.25
    smooth, starry = C.convergence_split(k, F.col("p_size") * F.lit(2.0))
    width, height = C.ray_window(F.lit(30.0), F.lit(20.0), k, g)
    raw = C.raw_brightness(radius, width / 2000, height / 2000, k, g)
    cols = {"smooth": (smooth, 8), "starry": (starry, 8), "width": (width, 6), "height": (height, 6), "starry_radius": (width * F.lit(0.6), 6), "brightness": (raw, 3)}
    return table(spark, sf_dir, "part").select("p_partkey", *[(F.round(c, n) + F.lit(0.0)).alias(name) for name, (c, n) in cols.items()])


@query("""WITH t AS (SELECT c_custkey AS trial, c_custkey % 5 AS k, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey % 3 END AS g, c_mktsegment AS stars FROM customer)
SELECT trial, min(trial) OVER (PARTITION BY k, g, stars) AS rays_of FROM t""")
def ray_groups(spark, sf_dir):
    """Of each trial the first one whose traced rays serve it: equal in all but the source's size."""
    from pyspark.sql import Window as W

    k = F.col("c_custkey")
    mark = C.ray_print(k % 5, F.when(k % 7 > 0, F.col("c_nationkey") % 3), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(k.alias("trial"), F.min(k).over(W.partitionBy(mark)).alias("rays_of"))


@query("""SELECT p_partkey, 0.1::DOUBLE + p_partkey % 37 * 0.02::DOUBLE AS z_lens, 150 + p_size * 5::DOUBLE AS speed, 'km/s' AS unit, p_size * 0.5::DOUBLE AS direction, 100 + p_partkey % 50 AS nx FROM part""")
def parameter_documents(spark, sf_dir):
    """Parameters as JSON documents, and read back by the schema of their kind."""
    q = lambda value, unit: F.struct(value.cast("double").alias("values"), F.lit(unit).alias("unit"))
    polar = lambda value, direction: F.struct(q(value, "").alias("magnitude"), direction.alias("direction"))
    k, size = F.col("p_partkey"), F.col("p_size")
    lens = F.struct(
        polar(size * 0.01, size * 0.5).alias("ellipticity"), polar(size * 0.02, size * 0.25).alias("shear"), q(150 + size * 5, "km/s").alias("velocity_dispersion"), (F.lit(0.1) + k % 37 * F.lit(0.02)).alias("redshift")
    )
    vec = lambda x, y, unit: F.struct(x.alias("x"), y.alias("y"), F.lit(unit).alias("unit"))
    region = F.struct(vec(F.lit(0.0), F.lit(0.0), "uas").alias("center"), vec(F.lit(2.0), F.lit(2.0), "uas").alias("dims"), vec(100 + k % 50, F.lit(100), "").alias("resolution"))
    rows = table(spark, sf_dir, "part").select("p_partkey", lens.alias("lens"), region.alias("ray_region"))
    back = X.document_json(rows).select(F.from_json("value", f"p_partkey long, {DOCUMENTS['.param']}").alias("d"))
    own = "d.lens.velocity_dispersion"
    return back.select("d.p_partkey", F.col("d.lens.redshift").alias("z_lens"), F.col(f"{own}.values").alias("speed"), F.col(f"{own}.unit").alias("unit"), F.col("d.lens.ellipticity.direction").alias("direction"), F.col("d.ray_region.resolution.x").alias("nx"))


# Seeded fields: hashes in place of streams of random numbers.


def _u(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE)"


@query(f"""WITH {STARS} SELECT star_id, round(3 + 10 * sqrt({_u('5 r', 'star_id')}) * cos({2 * math.pi!r}::DOUBLE * {_u('5 t', 'star_id')}), 6) + 0.0 AS x,
  round(-2 + 10 * sqrt({_u('5 r', 'star_id')}) * sin({2 * math.pi!r}::DOUBLE * {_u('5 t', 'star_id')}), 6) + 0.0 AS y, mass FROM stars""")
def star_places(spark, sf_dir):
    """Stars put uniformly into a disk."""
    x, y = ST.disk_places(F.col("star_id"), Disk(Vec(3.0, -2.0), 10.0), 5)
    return stars(spark, sf_dir).select("star_id", r6(x, "x"), r6(y, "y"), "mass")


@query(f"""WITH {STARS}, u AS (SELECT star_id, 8 + 2 * sqrt(-2 * ln(1 - {_u('9 s', 'star_id')})) * cos({2 * math.pi!r}::DOUBLE * {_u('9 a', 'star_id')}) AS speed, {_u('9 x', 'star_id')} AS a, {_u('9 y', 'star_id')} AS b, {_u('9 z', 'star_id')} AS c FROM stars)
SELECT star_id, round(speed * a / sqrt(a * a + b * b + c * c), 6) + 0.0 AS vx, round(speed * b / sqrt(a * a + b * b + c * c), 6) + 0.0 AS vy FROM u""")
def star_velocities(spark, sf_dir):
    """Speeds of a normal distribution in directions of the positive octant, seen in the plane."""
    return ST.with_velocities(stars(spark, sf_dir), 8.0, 2.0, 9).select("star_id", r6("vx", "vx"), r6("vy", "vy"))


@query(f"""WITH l AS (SELECT c_custkey AS curve_id, ({_u('3 ax', 'c_custkey')} - 0.5) * 52 AS ax, ({_u('3 ay', 'c_custkey')} - 0.5) * 10 AS ay, ({_u('3 dx', 'c_custkey')} - 0.5) * 52 AS dx, ({_u('3 dy', 'c_custkey')} - 0.5) * 10 AS dy FROM customer),
t AS (SELECT *, list_sort([(0 - ax) / dx, (0 - ay) / dy, (52 - ax) / dx, (10 - ay) / dy]) AS ts FROM l)
SELECT curve_id, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay, round(sqrt((ts[3] - ts[2]) * (ts[3] - ts[2]) * (dx * dx + dy * dy)), 4) + 0.0 AS length FROM t""")
def random_lines(spark, sf_dir):
    """A seeded line for every customer, and how long its part between the slabs of a box is."""
    lines = N.lines_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("curve_id")), PLANE, 3)
    ends = N.clip_lines(lines, PLANE, ("ax", "ay"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return ends.select("curve_id", r6("ax", "ax"), r6("ay", "ay"), (F.round(length, 4) + F.lit(0.0)).alias("length"))


@query(f"""WITH {CLIPPED}, n AS (SELECT ends.*, floor(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / sqrt(dx * dx + dy * dy))::INT AS n FROM ends JOIN lines USING (curve_id))
SELECT curve_id, i::INT AS sample_idx, round(x0 + (x1 - x0) * coalesce(i::DOUBLE / nullif(n - 1, 0), 0), 6) + 0.0 AS qx, round(y0 + (y1 - y0) * coalesce(i::DOUBLE / nullif(n - 1, 0), 0), 6) + 0.0 AS qy FROM n, LATERAL (SELECT unnest(range(n)) AS i) r WHERE n > 0""")
def line_slices(spark, sf_dir):
    """Lines walked from edge to edge of a box in steps of their own."""
    return N.slice_lines(trajectories(spark, sf_dir), TRACK_BOX).select("curve_id", "sample_idx", r6("qx", "qx"), r6("qy", "qy"))


@query(f"WITH {SAMPLED} SELECT curve_id, count(*)::INT AS n, round(sum(qx), 5) + 0.0 AS qx, round(max(qy), 6) + 0.0 AS highest FROM track GROUP BY curve_id")
def curve_arrays(spark, sf_dir):
    """Batches as an array for each curve: its size, the sum of its places along x and the greatest along y."""
    p = N.ragged(track(spark, sf_dir))
    total = F.aggregate("points", F.lit(0.0), lambda s, q: s + q["qx"])
    return p.select("curve_id", F.size("points").alias("n"), (F.round(total, 5) + F.lit(0.0)).alias("qx"), r6(F.array_max(F.transform("points", lambda q: q["qy"])), "highest"))


@query(f"""WITH {PLACES}, plane AS (SELECT range AS ray_id, (range % 193 - 96) * 0.0625::DOUBLE AS x, (80 - range // 193) * 0.0625::DOUBLE AS y FROM range({193 * 161})), n AS (SELECT x, y, count(*) AS n FROM places GROUP BY ALL)
SELECT plane.ray_id, x, y, n FROM plane JOIN n USING (x, y)""")
def flipped_plane(spark, sf_dir):
    """The lens plane counted from its upper edge: the pixels that hold places, and how many."""
    held = lens_places(spark, sf_dir).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return L.ray_lattice(spark, 193, 161, 0.0625, 0.0625, True).join(held, ["x", "y"]).select("ray_id", "x", "y", "n")


# Files.


@query(f"WITH {STARS} SELECT row_number() OVER (ORDER BY star_id) - 1 AS row, x, y, mass FROM stars")
def star_file(spark, sf_dir):
    """Stars written as a binary table, a file a task, and read back by byte ranges."""
    path = shared_folder(spark)
    formats.write_table(stars(spark, sf_dir), path, ["star_id"])
    return formats.read_table(spark, path)


@query(f"WITH {SAMPLED} SELECT row_number() OVER (ORDER BY curve_id, sample_idx) - 1 AS row, curve_id::DOUBLE AS curve_id, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy FROM track")
def point_file(spark, sf_dir):
    """Points of curves through a binary table, each with its curve's number."""
    path = shared_folder(spark)
    columns = ("curve_id", "qx", "qy")
    formats.write_table(track(spark, sf_dir), path, ["curve_id", "sample_idx"], columns)
    return formats.read_table(spark, path, columns).select("row", "curve_id", r6("qx", "qx"), r6("qy", "qy"))


@query(f"WITH {DENSE} SELECT (row % 52)::INT AS px, (row // 52)::INT AS py, value FROM (SELECT row_number() OVER (ORDER BY py, px) - 1 AS row, value FROM map)")
def map_file(spark, sf_dir):
    """A map's values row by row in a binary table, and its pixels again by their numbers."""
    path = shared_folder(spark)
    formats.write_table(counts_map(spark, sf_dir), path, ["py", "px"], ["value"])
    px, py = L.index_to_pixel(F.col("row"), 52)
    return formats.read_table(spark, path, ["value"]).select(px.alias("px"), py.alias("py"), "value")
