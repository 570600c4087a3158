"""Trajectories: random lines, clipped to a box, sampled at steps; ragged points in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.model import Box


def lines_of(df: DataFrame, box: Box, seed: int, key: str = "curve_id") -> DataFrame:
    """A seeded line for each key: key, ax, ay (a point) and dx, dy (a direction), each within half the box's dimensions of 0. Made where
    the rows are; a key has the same line in any table."""
    side = {"ax": box.dims.x, "ay": box.dims.y, "dx": box.dims.x, "dy": box.dims.y}
    return df.select(key, *[((uniform(f"{seed} {c}", F.col(key)) - 0.5) * F.lit(float(d))).alias(c) for c, d in side.items()])


def random_lines(spark: SparkSession, box: Box, n: int, seed: int) -> DataFrame:
    """n lines as lines_of() makes them: curve_id, ax, ay, dx, dy."""
    return lines_of(spark.range(n).withColumnRenamed("id", "curve_id"), box, seed)


def clip_lines(lines: DataFrame, box: Box, keep=()) -> DataFrame:
    """curve_id, x0, y0, x1, y1, and columns to keep: where a line meets the box, by the second and third of its four slab parameters.

    A line along an axis has no parameter for the other one; its two are taken at infinity.
    """
    lx, ly, rx, ry = box.extent
    t = lambda edge, a, d: F.coalesce(F.try_divide(F.lit(edge) - F.col(a), F.col(d)), F.when(F.lit(edge) >= F.col(a), F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    ts = F.sort_array(F.array(t(lx, "ax", "dx"), t(ly, "ay", "dy"), t(rx, "ax", "dx"), t(ry, "ay", "dy")))
    c = lines.withColumn("ts", ts).withColumn("t1", F.col("ts")[1]).withColumn("t2", F.col("ts")[2])
    at = lambda a, d, s: F.col(a) + F.col(s) * F.col(d)
    return c.select("curve_id", *keep, at("ax", "dx", "t1").alias("x0"), at("ay", "dy", "t1").alias("y0"), at("ax", "dx", "t2").alias("x1"), at("ay", "dy", "t2").alias("y1"))


def interpolate_lines(ends: DataFrame, step: float | Column) -> DataFrame:
    """Points curve_id, sample_idx, qx, qy: whole steps of the length, from end to end inclusive; shorter lines have none."""
    step = step if isinstance(step, Column) else F.lit(step)
    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    n = ends.withColumn("n", F.floor(F.try_divide(length, step)).cast("int")).where("n > 0")
    p = n.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.coalesce(F.try_divide(F.col("sample_idx").cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0))
    return p.select("curve_id", "sample_idx", (F.col("x0") + (F.col("x1") - F.col("x0")) * part).alias("qx"), (F.col("y0") + (F.col("y1") - F.col("y0")) * part).alias("qy"))


def slice_lines(lines: DataFrame, box: Box) -> DataFrame:
    """Points of lines (curve_id, ax, ay, dx, dy), each in steps of its own (dx, dy), from where it enters the box to where it leaves; a
    line without a direction has none."""
    return interpolate_lines(clip_lines(lines, box, ("dx", "dy")), F.hypot("dx", "dy"))


def slice_region(spark: SparkSession, box: Box, a: tuple[float, float], d: tuple[float, float]) -> DataFrame:
    """slice_lines() of one line through a, in steps of d."""
    return slice_lines(spark.createDataFrame([(0, *map(float, a), *map(float, d))], "curve_id long, ax double, ay double, dx double, dy double"), box)


def ragged(points: DataFrame) -> DataFrame:
    """One row per curve: curve_id, points as an array of (qx, qy) in order. A curve's own points only."""
    g = points.groupBy("curve_id").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "qx", "qy"))).alias("p"))
    return g.select("curve_id", F.transform("p", lambda x: F.struct(x["qx"].alias("qx"), x["qy"].alias("qy"))).alias("points"))


def unragged(curves: DataFrame) -> DataFrame:
    """The inverse of ragged()."""
    p = curves.select("curve_id", F.posexplode("points").alias("sample_idx", "p"))
    return p.select("curve_id", "sample_idx", F.col("p.qx").alias("qx"), F.col("p.qy").alias("qy"))
