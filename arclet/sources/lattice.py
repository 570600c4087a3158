"""Lattices of rays, of query points and of cells, as ranges with arithmetic; pixels and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Box


def pixel_range(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """id from 0 to n - 1."""
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)


def ray_lattice(spark: SparkSession, width: int, height: int, dx: float, dy: float, flip_y: bool = False, partitions: int | None = None) -> DataFrame:
    """Rays by row: ray_id, x, y, centred with whole halves (integer division); flip_y counts rows from the top."""
    rays = pixel_range(spark, width * height, partitions)
    row = F.floor(F.col("id") / width)
    y = (F.lit(height // 2) - row) if flip_y else (row - F.lit(height // 2))
    return rays.select(F.col("id").alias("ray_id"), ((F.col("id") % width - F.lit(width // 2)) * F.lit(float(dx))).alias("x"), (y * F.lit(float(dy))).alias("y"))


def query_lattice(spark: SparkSession, box: Box, mesh: bool = False) -> DataFrame:
    """Query points px, py, qx, qy: at the lower left corner of each pixel, or, as a mesh, from edge to edge inclusive."""
    x0, y0, x1, y1 = box.extent
    nx, ny = box.nx, box.ny
    sx, sy = ((x1 - x0) / max(nx - 1, 1), (y1 - y0) / max(ny - 1, 1)) if mesh else ((x1 - x0) / nx, (y1 - y0) / ny)
    cells = pixel_range(spark, nx * ny).select((F.col("id") % nx).cast("int").alias("px"), F.floor(F.col("id") / nx).cast("int").alias("py"))
    return cells.select("px", "py", (F.lit(x0) + F.col("px") * F.lit(sx)).alias("qx"), (F.lit(y0) + F.col("py") * F.lit(sy)).alias("qy"))


def cell_lattice(spark: SparkSession, box: Box) -> DataFrame:
    """Cells px, py, x1, x2, y1, y2."""
    sx, sy = box.dims.x / box.nx, box.dims.y / box.ny
    c = query_lattice(spark, box)
    return c.select("px", "py", F.col("qx").alias("x1"), (F.col("qx") + F.lit(sx)).alias("x2"), F.col("qy").alias("y1"), (F.col("qy") + F.lit(sy)).alias("y2"))


def loc_to_pixel(x: Column, y: Column, box: Box) -> tuple[Column, Column]:
    """Pixel numbers of a place, y counted from the top; whole numbers by dropping fractions."""
    x0, y0, x1, y1 = box.extent
    px = F.floor((x - F.lit(x0)) / F.lit(box.step.x)).cast("int")
    py = F.floor((F.lit(y1) - y) / F.lit(box.step.y)).cast("int")
    return px, py


def pixel_to_loc(px: Column, py: Column, box: Box) -> tuple[Column, Column]:
    """The place of a pixel, y counted from the top."""
    x0, _, _, y1 = box.extent
    return F.lit(x0) + px * F.lit(box.step.x), F.lit(y1) - py * F.lit(box.step.y)


def index_to_pixel(p: Column, width: int) -> tuple[Column, Column]:
    """Column and row of a ray's number in a frame."""
    return (p % width).cast("int"), F.floor(p / width).cast("int")
