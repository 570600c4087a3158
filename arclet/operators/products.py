"""What a simulation returns: magnification maps, moment maps, caustic maps, light curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Box
from ..sources.lattice import query_lattice
from .spatial import MOMENTS, cell_bins, densified, disk_join, disk_points
from .trace import with_parity


def magnification_map(rays: DataFrame, box: Box, r: float, raw: float, strategy: str = "auto", mesh: bool = False) -> DataFrame:
    """px, py, value: rays in each lattice point's disk, over those without stars; 0 where none is."""
    counts = disk_join(rays, box, r, (0,), strategy, mesh)
    whole = densified(counts, query_lattice(rays.sparkSession, box))
    return whole.select("px", "py", (F.col("m0") / F.lit(float(raw))).alias("value"))


def radius_maps(rays: DataFrame, box: Box, radii, raws, strategy: str = "auto") -> DataFrame:
    """trial, px, py, value: the magnification maps of several source radii, each over its own count without stars, from one pass over
    the rays; trial is the radius' place."""
    counts = disk_join(rays, box, list(radii), (0,), strategy)
    spark = rays.sparkSession
    trials = spark.range(len(raws)).select(F.col("id").cast("int").alias("trial"), F.get(F.array(*[F.lit(float(r)) for r in raws]), F.col("id").cast("int")).alias("_raw"))
    # One row for each radius, so the lattice is all that grows.
    whole = query_lattice(spark, box).select("px", "py").crossJoin(F.broadcast(trials))
    out = whole.join(counts, ["trial", "px", "py"], "left")
    return out.select("trial", "px", "py", (F.coalesce(F.col("m0"), F.lit(0)) / F.col("_raw")).alias("value"))


def radius_moments(rays: DataFrame, box: Box, radii, strategy: str = "auto") -> DataFrame:
    """trial, px, py, moment_index, value: all six sums for several radii from one pass over the rays."""
    sums = disk_join(rays, box, list(radii), tuple(MOMENTS), strategy)
    trials = rays.sparkSession.range(len(radii)).select(F.col("id").cast("int").alias("trial"))
    whole = query_lattice(rays.sparkSession, box).select("px", "py").crossJoin(F.broadcast(trials)).join(sums, ["trial", "px", "py"], "left")
    return whole.select("trial", "px", "py", F.posexplode(F.array(*[F.coalesce(F.col(f"m{k}").cast("double"), F.lit(0.0)) for k in MOMENTS])).alias("moment_index", "value"))


def moment_map(rays: DataFrame, box: Box, r: float, parity=None, strategy: str = "auto") -> DataFrame:
    """px, py, moment_index, value: all six sums from one pass over the rays."""
    sums = disk_join(with_parity(rays, parity), box, r, tuple(MOMENTS), strategy)
    whole = densified(sums, query_lattice(rays.sparkSession, box), fill=0.0)
    return whole.select("px", "py", F.posexplode(F.array(*[F.col(f"m{k}").cast("double") for k in MOMENTS])).alias("moment_index", "value"))


def caustic_map(rays: DataFrame, box: Box) -> DataFrame:
    """px, py, value: rays of parity 0 in each cell."""
    counts = cell_bins(with_parity(rays, 0), box)
    return densified(counts, query_lattice(rays.sparkSession, box)).select("px", "py", F.col("m0").cast("double").alias("value"))


def light_curves(rays: DataFrame, points: DataFrame, r: float, raw: float) -> DataFrame:
    """line_id, sample_idx, x, y, magnification for trajectory points (curve_id, sample_idx, qx, qy)."""
    counts = disk_points(rays, points, r)
    out = points.join(counts, ["curve_id", "sample_idx"], "left")
    value = F.coalesce(F.col("m0"), F.lit(0)) / F.lit(float(raw))
    return out.select(F.col("curve_id").alias("line_id"), "sample_idx", F.col("qx").alias("x"), F.col("qy").alias("y"), value.alias("magnification"))
