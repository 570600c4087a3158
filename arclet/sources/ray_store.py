"""Rays kept on disk in the order of a space-filling curve, with the box of each file, so that a region reads few files.

A store is a folder with rays, in files of ranges of the curve, and boxes, a row for each file. Rows of one file lie close
together in both directions, so that both the files that a region needs and, by Parquet's own figures, its row groups are
few. What is read is decided from boxes before any ray is: for a rectangle, or for all the disks about many points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Box
from ..plans.session import file_system

#: Bits of a place along each axis in the curve's key.
BITS = 16
#: Cells along the longer side of all boxes that many points are reduced to, at most.
CELLS = 256


def _spread(v: Column) -> Column:
    """The low 16 bits of a number at every other place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def curve_key(x: Column, y: Column, box: Box) -> Column:
    """The place on the curve through box: bits of both axes in turn. Beyond the box the nearest edge counts."""
    x0, y0, x1, y1 = box.extent
    top = (1 << BITS) - 1
    at = lambda c, a, b: F.least(F.greatest(F.floor((c - F.lit(float(a))) / F.lit(float(b - a)) * top), F.lit(0)), F.lit(top)).cast("long")
    return _spread(at(x, x0, x1)).bitwiseOR(F.shiftleft(_spread(at(y, y0, y1)), 1))


@dataclass
class FileBox:
    path: str
    x0: float
    y0: float
    x1: float
    y1: float


class RayStore:
    """A store that exists; see write_rays()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.read.parquet(f"{self.path}/rays").schema
        # A row for each file of the store, whose number is a parameter of writing it.
        self.boxes = [FileBox(f"{self.path}/rays/{r.file}", r.x0, r.y0, r.x1, r.y1) for r in spark.read.parquet(f"{self.path}/boxes").orderBy("file").collect()]

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rays")

    def _of(self, boxes: list[FileBox]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[b.path for b in boxes]) if boxes else self.spark.createDataFrame([], self.schema)

    def inside(self, box: Box, r: float = 0.0) -> DataFrame:
        """The rays within r of a box, from the files that may hold one."""
        x0, y0, x1, y1 = box.extent
        own = [b for b in self.boxes if b.x1 >= x0 - r and b.x0 <= x1 + r and b.y1 >= y0 - r and b.y0 <= y1 + r]
        return self._of(own).where((F.col("bx") >= F.lit(x0 - r)) & (F.col("bx") <= F.lit(x1 + r)) & (F.col("by") >= F.lit(y0 - r)) & (F.col("by") <= F.lit(y1 + r)))

    def near(self, points: DataFrame, r: float) -> DataFrame:
        """The rays of the files that may hold one within r of some of many points (qx, qy).

        Points are reduced to the cells they lie in, CELLS along the boxes' longer side at most (points beyond all boxes' reach
        need no file); each cell names the boxes within reach of it. What comes to the driver are numbers of files.
        """
        if not self.boxes:
            return self._of([])
        x0, y0 = min(b.x0 for b in self.boxes) - r, min(b.y0 for b in self.boxes) - r
        x1, y1 = max(b.x1 for b in self.boxes) + r, max(b.y1 for b in self.boxes) + r
        w = max(r, (x1 - x0) / CELLS, (y1 - y0) / CELLS, 1e-300)
        cells = points.where((F.col("qx") >= F.lit(x0)) & (F.col("qx") <= F.lit(x1)) & (F.col("qy") >= F.lit(y0)) & (F.col("qy") <= F.lit(y1)))
        cells = cells.select(F.floor((F.col("qx") - F.lit(x0)) / F.lit(w)).alias("cx"), F.floor((F.col("qy") - F.lit(y0)) / F.lit(w)).alias("cy")).distinct()
        # A cell's edges, a little wider for rounding.
        low = lambda c, o: F.lit(o) + (F.col(c) - F.lit(1e-6)) * F.lit(w) - F.lit(r)
        high = lambda c, o: F.lit(o) + (F.col(c) + F.lit(1 + 1e-6)) * F.lit(w) + F.lit(r)
        table = self.spark.createDataFrame([(i, b.x0, b.y0, b.x1, b.y1) for i, b in enumerate(self.boxes)], "file int, x0 double, y0 double, x1 double, y1 double")
        reach = table.agg(F.collect_list(F.struct("file", "x0", "y0", "x1", "y1")).alias("boxes"))
        near = lambda b: (b["x1"] >= low("cx", x0)) & (b["x0"] <= high("cx", x0)) & (b["y1"] >= low("cy", y0)) & (b["y0"] <= high("cy", y0))
        named = cells.crossJoin(F.broadcast(reach)).select(F.explode(F.transform(F.filter("boxes", near), lambda b: b["file"])).alias("file")).distinct()
        return self._of([self.boxes[r.file] for r in named.orderBy("file").collect()])


def write_rays(rays: DataFrame, path: str, box: Box, files: int = 200) -> RayStore:
    """Writes rays (..., bx, by) as a store of about so many files; box: where most rays end, which the curve runs through."""
    spark, path = rays.sparkSession, path.rstrip("/")
    keyed = rays.withColumn("_key", curve_key(F.col("bx"), F.col("by"), box))
    keyed.repartitionByRange(files, "_key").sortWithinPartitions("_key").drop("_key").write.mode("overwrite").parquet(f"{path}/rays")
    ends = [F.min("bx").alias("x0"), F.min("by").alias("y0"), F.max("bx").alias("x1"), F.max("by").alias("y1")]
    boxes = spark.read.parquet(f"{path}/rays").groupBy(F.col("_metadata.file_name").alias("file")).agg(*ends)
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")
    return RayStore(spark, path)


def has_rays(spark: SparkSession, path: str) -> bool:
    """Whether a store at path is whole: boxes are written last."""
    files, done = file_system(spark, f"{path.rstrip('/')}/boxes/_SUCCESS")
    return files.exists(done)
