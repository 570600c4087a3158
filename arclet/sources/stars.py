"""Star tables: drawn from a mass function over a disk, moved, pruned, read and written."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.imf import PowerLaw, evolved_column, integral_column, sample_column
from ..functions.model import STAR, Disk, StarField


def mass_function(field: StarField) -> PowerLaw:
    """By name, else by limits and powers; a field of conversions alone starts from the 2001 Kroupa function."""
    if field.name:
        return PowerLaw.named(field.name)
    return PowerLaw(field.mass_limits, field.powers) if field.powers else PowerLaw.named("Kroupa_2001")


def disk_sample(n: int, disk: Disk, rng: np.random.RandomState) -> np.ndarray:
    """n places uniform in a disk."""
    r, t = disk.radius * np.sqrt(rng.rand(n)), 2 * math.pi * rng.rand(n)
    return np.column_stack((disk.center.x + r * np.cos(t), disk.center.y + r * np.sin(t)))


def draw_stars(field: StarField, disk: Disk, total_mass: float) -> pd.DataFrame:
    """A seeded star table on the driver: a field has thousands of stars, and one stream of random numbers."""
    rng = np.random.RandomState(field.seed % (1 << 32))
    masses = mass_function(field).cluster(total_mass, rng, field.conversions)
    at = disk_sample(len(masses), disk, rng)
    return pd.DataFrame({"star_id": np.arange(len(masses)), "x": at[:, 0], "y": at[:, 1], "mass": masses})


#: Stars in one block of a cluster's running sums.
BLOCK = 1 << 16
#: Parts of a solar mass that running sums count, so that their order doesn't matter.
MASS_PARTS = float(1 << 30)


def star_clusters(clusters: DataFrame, law: PowerLaw, seed: int, remnants=(), key: str = "cluster", total: str = "total") -> DataFrame:
    """key, star_id, mass: stars of clusters (key, total), whose masses add up to the totals as nearly as whole stars can.

    Stars are numbers whose masses follow from hashes, twice as many as are expected and a hundred more, cut where the running
    mass is nearest to the total. Running sums go by blocks: sums of blocks, then of the blocks before, and star by star in the
    one block of each cluster where the cut lies. So the same stars come out for any number of partitions, and none of them
    passes through the driver. remnants: masses after evolution count, see evolved().
    """
    top = F.least(F.lit(float(law.limits[-1])), F.col(total).cast("double"))
    law = PowerLaw(law.limits, law.powers)
    low = F.lit(float(law.limits[0]))
    expected = F.col(total) * F.try_divide(integral_column(low, top, law), integral_column(low, top, law, 1))
    rows = clusters.select(F.col(key), F.col(total).cast("double").alias("_total"), top.alias("_top"), F.coalesce(F.ceil(2 * expected), F.lit(0)).cast("long").alias("_n")).where(F.col("_total") > F.lit(float(law.limits[0])))
    # Blocks first, so that the numbers of one large cluster are made by many tasks.
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") + 100) / BLOCK)))).repartition(key, "_block")
    last = F.least(F.col("_block") * BLOCK + (BLOCK - 1), F.col("_n") + 100)
    rows = rows.withColumn("star_id", F.explode(F.sequence(F.col("_block") * BLOCK, last)))
    mass = sample_column(uniform(seed, F.col(key), F.col("star_id")), law, F.col("_top"))
    stars = rows.withColumn("mass", evolved_column(mass, tuple(remnants)) if remnants else mass).withColumn("_m", F.round(F.col("mass") * MASS_PARTS).cast("long"))
    stars = stars.withColumn("_goal", F.round(F.col("_total") * MASS_PARTS).cast("long"))
    blocks = stars.groupBy(key, "_block").agg(F.sum("_m").alias("_sum"), F.first("_goal").alias("_goal"))
    upto = F.sum("_sum").over(Window.partitionBy(key).orderBy("_block"))
    # The cut lies in the first block that reaches the total, or right before it; without one all stars stay.
    cut = blocks.withColumn("_upto", upto).where("_upto >= _goal").groupBy(key).agg(F.min("_block").alias("_cut"), F.min_by(F.col("_upto") - F.col("_sum"), "_block").alias("_before"))
    inside = stars.join(cut, key).where("_block = _cut")
    running = F.col("_before") + F.sum("_m").over(Window.partitionBy(key).orderBy("star_id"))
    ends = inside.withColumn("_far", F.abs(running - F.col("_goal"))).groupBy(key).agg(F.min(F.struct("_far", "star_id")).alias("_e"), F.min("star_id").alias("_first"), F.first(F.col("_goal") - F.col("_before")).alias("_left"))
    # The last star before the block may be nearer than any inside.
    end = ends.select(key, F.when(F.col("_left") <= F.col("_e._far"), F.col("_first") - 1).otherwise(F.col("_e.star_id")).alias("_end"))
    kept = stars.join(end, key, "left").where("_end is null or star_id <= _end")
    return kept.select(key, "star_id", "mass")


def disk_places(star_id: Column, disk: Disk, seed) -> tuple[Column, Column]:
    """x, y: places uniform in a disk, by hashes of star numbers."""
    r, t = F.lit(float(disk.radius)) * F.sqrt(uniform(f"{seed} r", star_id)), F.lit(2 * math.pi) * uniform(f"{seed} t", star_id)
    return F.lit(float(disk.center.x)) + r * F.cos(t), F.lit(float(disk.center.y)) + r * F.sin(t)


def star_field(spark: SparkSession, field: StarField, disk: Disk, total_mass: float) -> DataFrame:
    """star_id, x, y, mass of one field, made by tasks: masses as in star_clusters(), places uniform in the disk."""
    clusters = spark.createDataFrame([(0, float(total_mass))], "cluster int, total double")
    stars = star_clusters(clusters, mass_function(field), field.seed, field.conversions)
    return stars.select("star_id", *[c.alias(n) for c, n in zip(disk_places(F.col("star_id"), disk, field.seed), ("x", "y"))], "mass")


def star_table(spark: SparkSession, field: StarField, disk: Disk, total_mass: float) -> DataFrame:
    """draw_stars as a DataFrame. total_mass: convergence in stars times the disk's area over pi, in lens units."""
    return spark.createDataFrame(draw_stars(field, disk, total_mass), STAR)


def star_velocities(n: int, mean: float, sigma: float, seed: int) -> np.ndarray:
    """Speeds from a normal distribution in directions of the positive octant, seen in the plane."""
    rng = np.random.RandomState(seed % (1 << 32))
    speed, way = rng.normal(mean, sigma, n), rng.rand(n, 3)
    return (way / np.linalg.norm(way, axis=1, keepdims=True) * speed[:, None])[:, :2]


def with_velocities(stars: DataFrame, mean: float, sigma: float, seed: int) -> DataFrame:
    """Adds vx, vy as star_velocities() has them, by hashes of star_id: made where the stars are, without a join."""
    u = lambda name: uniform(f"{seed} {name}", F.col("star_id"))
    speed = F.lit(float(mean)) + F.lit(float(sigma)) * F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u("s"))) * F.cos(F.lit(2 * math.pi) * u("a"))
    a, b, c = u("x"), u("y"), u("z")
    length = F.greatest(F.sqrt(a * a + b * b + c * c), F.lit(1e-300))
    return stars.withColumns({"vx": speed * a / length, "vy": speed * b / length})


def moved(stars: DataFrame, t: float) -> DataFrame:
    """Stars after a time t of straight motion."""
    return stars.withColumn("x", F.col("x") + F.col("vx") * F.lit(t)).withColumn("y", F.col("y") + F.col("vy") * F.lit(t))


def within(stars: DataFrame, radius: float) -> DataFrame:
    """Stars inside a disk about the origin, its edge included."""
    return stars.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= F.lit(radius * radius))


def replenished(stars: DataFrame, more: DataFrame, radius: float) -> DataFrame:
    """Stars still inside, and new ones."""
    return within(stars, radius).unionByName(more, allowMissingColumns=True)


def cluster_cutoff(stars: DataFrame, total: float, keys=("cluster",), order: str = "star_id", mass: str = "mass") -> DataFrame:
    """Of each cluster the stars up to where the running mass is nearest to the total (the first such place), with that mass."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = stars.withColumn("running", F.sum(mass).over(w)).withColumn("_far", F.abs(F.col("running") - F.lit(total)))
    ends = s.groupBy(*keys).agg(F.min(F.struct("_far", order)).alias("e")).select(*keys, F.col(f"e.{order}").alias("_end"))
    return s.join(ends, list(keys)).where(F.col(order) <= F.col("_end")).drop("_far", "_end")
