"""A moving source as a stream: a frame per tick, with what its disk lights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Vec
from ..operators.spatial import CELL_MARGIN


def ticks(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """frame, ts: numbered ticks of a clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("frame"), F.col("timestamp").alias("ts"))


def positions(frames: DataFrame, start: Vec, velocity: Vec, dt: float = 0.1) -> DataFrame:
    """frames (a batch or a stream with frame) with the source's place after frame * dt of straight motion."""
    t = F.col("frame") * F.lit(dt)
    return frames.withColumn("qx", F.lit(start.x) + F.lit(velocity.x) * t).withColumn("qy", F.lit(start.y) + F.lit(velocity.y) * t)


def frame_rays(frames: DataFrame, rays: DataFrame, r: float) -> DataFrame:
    """frame, ray_id: rays in each frame's disk. Rays are static and keyed by cell; frames are written nine times."""
    w = r * CELL_MARGIN
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = frames.withColumn("o", F.explode(near)).withColumn("cx", F.floor(F.col("qx") / F.lit(w)) + F.col("o.a")).withColumn("cy", F.floor(F.col("qy") / F.lit(w)) + F.col("o.b"))
    b = rays.withColumn("cx", F.floor(F.col("bx") / F.lit(w))).withColumn("cy", F.floor(F.col("by") / F.lit(w)))
    dx, dy = F.col("bx") - F.col("qx"), F.col("by") - F.col("qy")
    return q.join(b, ["cx", "cy"]).where(dx * dx + dy * dy <= F.lit(r * r)).select("frame", "ray_id")


def brightness_by_window(frames: DataFrame, rays: DataFrame, r: float, late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Rays lit in each time window of a stream of frames (frame, ts, qx, qy), late ones up to a watermark."""
    lit = frames.withWatermark("ts", late)
    w = r * CELL_MARGIN
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = lit.withColumn("o", F.explode(near)).withColumn("cx", F.floor(F.col("qx") / F.lit(w)) + F.col("o.a")).withColumn("cy", F.floor(F.col("qy") / F.lit(w)) + F.col("o.b"))
    b = rays.withColumn("cx", F.floor(F.col("bx") / F.lit(w))).withColumn("cy", F.floor(F.col("by") / F.lit(w)))
    dx, dy = F.col("bx") - F.col("qx"), F.col("by") - F.col("qy")
    return q.join(b, ["cx", "cy"]).where(dx * dx + dy * dy <= F.lit(r * r)).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("rays"))
