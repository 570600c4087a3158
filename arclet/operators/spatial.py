"""Rays near query points: joins on disks and cells as equi-joins and group-bys, with counts and moments.

Every strategy decides by the same exact predicate, (bx - qx)² + (by - qy)² <= r²; they differ in how pairs are found.
scatter, for lattices: a ray names the few lattice points around it, nothing is joined. cells, for any points: both sides
get a cell key. naive: every pair, for tests.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import Box
from ..sources.lattice import query_lattice

#: What can be summed over a disk or cell, by moment index.
MOMENTS = {
    0: "count(1)",
    1: "sum(x - bx)",
    2: "sum(y - by)",
    3: "sum((x - bx) * (x - bx))",
    4: "sum((x - bx) * (y - by))",
    5: "sum((y - by) * (y - by))",
}
#: Cells are a little wider than the radius, so that rounding at an edge can't part a pair at that distance.
CELL_MARGIN = 1 + 1e-9


def _sums(moments) -> list:
    return [F.expr(MOMENTS[m]).alias(f"m{m}") for m in moments]


def _class_sums(pairs: DataFrame, keys, radii, moments) -> DataFrame:
    """keys, trial, m<k> of (ray, point) pairs for several radii at once: a row for each radius with a ray inside.

    A pair belongs to the class of the smallest radius that holds it. Sums by class are made in one aggregate, with a column
    for each class and moment, so that a point is one row of the one shuffle; a radius has the sums of its class and all
    smaller ones.
    """
    order = sorted(range(len(radii)), key=lambda i: radii[i])
    dx, dy = F.col("bx") - F.col("qx"), F.col("by") - F.col("qy")
    place = sum(((dx * dx + dy * dy > F.lit(radii[i] * radii[i])).cast("int") for i in order), F.lit(0))
    of = lambda m, k: F.expr(MOMENTS[m].replace("(", f"(CASE WHEN class = {k} THEN ", 1)[:-1] + " END)")
    sums = pairs.withColumn("class", place).where(F.col("class") < len(order)).groupBy(*keys).agg(
        *[(F.coalesce(of(m, k), F.lit(0)) if m else of(m, k)).alias(f"c{k}_{m}") for k in range(len(order)) for m in {0, *moments}]
    )
    upto = lambda k, m: sum((F.col(f"c{j}_{m}") for j in range(1, k + 1)), F.col(f"c0_{m}"))
    rows = [F.struct(F.lit(i).alias("trial"), upto(k, 0).alias("_n"), *[upto(k, m).alias(f"m{m}") for m in moments]) for k, i in enumerate(order)]
    return sums.select(*keys, F.explode(F.array(*rows)).alias("t")).where("t._n > 0").select(*keys, "t.trial", *[f"t.m{m}" for m in moments])


def _by_radius(pairs: DataFrame, keys, r, moments) -> DataFrame:
    """The sums of pairs within a radius, or of each of several."""
    return pairs.where(_inside(r)).groupBy(*keys).agg(*_sums(moments)) if isinstance(r, (int, float)) else _class_sums(pairs, keys, list(r), moments)


def _largest(r) -> float:
    return float(r) if isinstance(r, (int, float)) else float(max(r))


def _inside(r: float):
    dx, dy = F.col("bx") - F.col("qx"), F.col("by") - F.col("qy")
    return dx * dx + dy * dy <= F.lit(r * r)


def disk_lattice(rays: DataFrame, box: Box, r: float, moments=(0,), mesh: bool = False) -> DataFrame:
    """px, py and m<k> for lattice points with a ray in their disk: by scatter.

    Rays beyond the lattice and r go first. A ray makes about pi r² / (step x step) rows, which are summed in the task that
    made them, so what is shuffled is at most a row per task and lattice point. r may be several radii: rays are scattered once,
    at the largest, and there is a trial column, the radius' place in r; see _class_sums.
    """
    radii, r = r, _largest(r)
    x0, y0, x1, y1 = box.extent
    sx = (x1 - x0) / (max(box.nx - 1, 1) if mesh else box.nx)
    sy = (y1 - y0) / (max(box.ny - 1, 1) if mesh else box.ny)
    near = rays.where((F.col("bx") >= F.lit(x0 - r)) & (F.col("bx") <= F.lit(x1 + r)) & (F.col("by") >= F.lit(y0 - r)) & (F.col("by") <= F.lit(y1 + r)))
    # One point more on each side; the predicate decides.
    low = lambda c, o, s: F.greatest(F.lit(0), F.ceil((F.col(c) - F.lit(r + o)) / F.lit(s)).cast("int") - 1)
    high = lambda c, o, s, n: F.least(F.lit(n - 1), F.floor((F.col(c) + F.lit(r - o)) / F.lit(s)).cast("int") + 1)
    i = near.withColumn("i0", low("bx", x0, sx)).withColumn("i1", high("bx", x0, sx, box.nx)).withColumn("j0", low("by", y0, sy)).withColumn("j1", high("by", y0, sy, box.ny))
    i = i.where("i0 <= i1 and j0 <= j1").withColumn("px", F.explode(F.sequence("i0", "i1"))).withColumn("qx", F.lit(x0) + F.col("px") * F.lit(sx))
    j = i.where((F.col("bx") - F.col("qx")) * (F.col("bx") - F.col("qx")) <= F.lit(r * r)).withColumn("py", F.explode(F.sequence("j0", "j1"))).withColumn("qy", F.lit(y0) + F.col("py") * F.lit(sy))
    return _by_radius(j, ("px", "py"), radii, moments)


def disk_points(rays: DataFrame, points: DataFrame, r: float, keys=("curve_id", "sample_idx"), moments=(0,)) -> DataFrame:
    """keys and m<k> for points (keys, qx, qy) with a ray in their disk: by cells of the radius.

    A point is written nine times, a ray once; the join is on the cell. Spark broadcasts the points while they are few and
    shuffles by cell beyond; a crowded cell splits there under adaptive execution, as both inputs come by plain exchanges.
    r may be several radii, as in disk_lattice().
    """
    radii, r = r, _largest(r)
    w = r * CELL_MARGIN
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = points.withColumn("o", F.explode(near)).withColumn("cx", F.floor(F.col("qx") / F.lit(w)) + F.col("o.a")).withColumn("cy", F.floor(F.col("qy") / F.lit(w)) + F.col("o.b"))
    b = rays.withColumn("cx", F.floor(F.col("bx") / F.lit(w))).withColumn("cy", F.floor(F.col("by") / F.lit(w)))
    return _by_radius(b.join(q.select(*keys, "qx", "qy", "cx", "cy"), ["cx", "cy"]), keys, radii, moments)


def disk_naive(rays: DataFrame, points: DataFrame, r: float, keys=("px", "py"), moments=(0,)) -> DataFrame:
    """The same by comparing every ray with every point: the measure of the others, for small inputs."""
    return _by_radius(rays.join(points, _inside(_largest(r))), keys, r, moments)


def disk_join(rays: DataFrame, box: Box, r: float, moments=(0,), strategy: str = "auto", mesh: bool = False) -> DataFrame:
    """A lattice's disks by strategy: scatter, cells, naive, or auto: cells if a ray would meet over 4,096 lattice points."""
    sx, sy = box.dims.x / box.nx, box.dims.y / box.ny
    if strategy == "auto":
        strategy = "scatter" if 4 * _largest(r) ** 2 / (sx * sy) <= 4096 else "cells"
    if strategy == "scatter":
        return disk_lattice(rays, box, r, moments, mesh)
    points = query_lattice(rays.sparkSession, box, mesh)
    if strategy == "cells":
        return disk_points(rays, points, r, ("px", "py"), moments)
    if strategy == "naive":
        return disk_naive(rays, points, r, ("px", "py"), moments)
    raise ValueError("strategy is auto, scatter, cells or naive")


def cell_bins(rays: DataFrame, box: Box, moments=(0,)) -> DataFrame:
    """px, py and m<k> for cells with a ray inside; a ray on a cell's edge is in none."""
    x0, y0, x1, y1 = box.extent
    sx, sy = (x1 - x0) / box.nx, (y1 - y0) / box.ny
    k = rays.withColumn("px", F.floor((F.col("bx") - F.lit(x0)) / F.lit(sx)).cast("int")).withColumn("py", F.floor((F.col("by") - F.lit(y0)) / F.lit(sy)).cast("int"))
    k = k.where(f"px >= 0 and px < {box.nx} and py >= 0 and py < {box.ny}")
    inside = (F.col("bx") > F.lit(x0) + F.col("px") * F.lit(sx)) & (F.col("by") > F.lit(y0) + F.col("py") * F.lit(sy))
    return k.where(inside).groupBy("px", "py").agg(*_sums(moments))


def densified(values: DataFrame, whole: DataFrame, keys=("px", "py"), fill=0) -> DataFrame:
    """values for every key of whole, fill where there is none."""
    filled = values.columns[len(keys):] if values.columns[: len(keys)] == list(keys) else [c for c in values.columns if c not in keys]
    out = whole.select(*keys).join(values, list(keys), "left")
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in filled])


def connecting_rays(rays: DataFrame, x: float, y: float, r: float) -> DataFrame:
    """ray_id of the rays that end in one disk."""
    dx, dy = F.col("bx") - F.lit(x), F.col("by") - F.lit(y)
    return rays.where(dx * dx + dy * dy <= F.lit(r * r)).select("ray_id")


def frame_pixels(rays: DataFrame, x: float, y: float, r: float, width: int) -> DataFrame:
    """The lensed image of a source at one place: frame pixels that light comes through."""
    hit = connecting_rays(rays, x, y, r)
    return hit.select((F.col("ray_id") % width).cast("int").alias("px"), F.floor(F.col("ray_id") / width).cast("int").alias("py")).distinct()


def by_column(rays: DataFrame, n: int) -> DataFrame:
    """rays in n partitions of ranges of bx, of about equal size."""
    return rays.repartitionByRange(n, "bx")


def columns_near(edges: list[float], x: float, r: float) -> range:
    """Which of the columns between ascending edges a disk of radius r about x may meet; the outer columns have no outer edge."""
    return range(bisect_right(edges, x - r), bisect_right(edges, x + r) + 1)


def order_statistics(points: DataFrame, ranks: dict[str, list[Column]], bins: int = 1024) -> DataFrame:
    """axis, k, v: of each column named, the values at ranks (from 1, as columns of n, how many values it has); nulls don't count.

    Counts by bins of equal width, a bounded table, say which bin holds a rank; only the values of such bins are looked at
    again, as counts by distinct value. A rank beyond the last has no row. Nothing goes to the driver.
    """
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in ranks])).alias("t")).select("t.*").where("v is not null")
    ends = long.groupBy("axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    placed = long.join(F.broadcast(ends), "axis").withColumn("bin", place)
    upto = W.partitionBy("axis").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = placed.groupBy("axis", "bin").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).withColumn("upto", F.sum("m").over(upto))
    wanted = reduce(lambda out, c: F.when(F.col("axis") == c, F.array(*[k.cast("long") for k in ranks[c]])).otherwise(out), ranks, F.array().cast("array<bigint>"))
    held = counts.withColumn("k", F.explode(wanted)).where("k > upto - m and k <= upto").select("axis", "bin", "k", (F.col("k") - F.col("upto") + F.col("m")).alias("own"))
    near = placed.join(F.broadcast(held.select("axis", "bin").distinct()), ["axis", "bin"], "left_semi").groupBy("axis", "bin", "v").agg(F.count(F.lit(1)).alias("m"))
    near = near.withColumn("upto", F.sum("m").over(W.partitionBy("axis", "bin").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return near.join(F.broadcast(held), ["axis", "bin"]).where("own > upto - m and own <= upto").select("axis", "k", "v")


def column_ranges(points: DataFrame, column: str, parts: int) -> DataFrame:
    """column, low, high, n: points in columns of about equal size along an axis, cut at exact order statistics; equal values never
    part. The cuts are parts - 1 rows."""
    n = F.col("n")
    cuts = order_statistics(points, {column: [F.ceil(n * i / parts) for i in range(1, parts)]}).agg(F.array_sort(F.collect_set("v")).alias("cuts"))
    placed = points.where(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("column", F.size(F.filter("cuts", lambda c: c < F.col(column))))
    return placed.groupBy("column").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"))
