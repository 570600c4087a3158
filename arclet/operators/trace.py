"""From the lens plane to the source plane: point masses with smooth matter and shear, and one elliptical lens."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import share_code
from .multipole import star_fields

#: A Jacobian smaller than this counts as a caustic.
PARITY_LIMIT = 1e-3
#: Stars in one broadcast array; more are met in several, see micro_trace.
STARS_A_BLOCK = 200_000
#: Stars that the join by broadcast takes at most.
STARS_BY_JOIN = 20_000
#: Rays times stars that a Python worker holds at once, as doubles.
TILE = 1 << 21


def parity_of(det: Column) -> Column:
    """0 near a caustic, 1 or -1 by the sign; null where the Jacobian isn't a number."""
    return F.when(F.isnan(det) | det.isNull(), None).when(F.abs(det) < PARITY_LIMIT, 0).when(det > 0, 1).otherwise(-1).cast("byte")


def smooth_map(x: Column, y: Column, smooth: float, shear: float) -> tuple[Column, Column]:
    """The source place without stars."""
    return F.lit(1 - shear) * x - F.lit(smooth) * x, F.lit(1 + shear) * y - F.lit(smooth) * y


def micro_trace(rays: DataFrame, stars: DataFrame, smooth: float, shear: float, jacobian: bool = True, strategy: str = "kernel") -> DataFrame:
    """rays (ray_id, x, y) with bx, by and, if asked for, det and parity.

    strategy "kernel": arrays in Python workers, rays are read once and not shuffled at all; stars come by broadcast, in
    blocks of STARS_A_BLOCK. "sql", for few stars: every star meets every ray in a join by broadcast, and sums per ray are
    combined in the task that made them; rays are shuffled once, as partial sums. Stars are counted first, and beyond
    STARS_BY_JOIN the kernel does the work. "cells": as the kernel, but stars far from a ray count by the moments of
    their cells, so that a ray costs about as much for 10 ** 6 stars as for 10 ** 3; see multipole for the error. A ray at
    a star's place has no finite place and goes.
    """
    if strategy == "sql" and stars.limit(STARS_BY_JOIN + 1).count() > STARS_BY_JOIN:
        strategy = "kernel"
    if strategy == "kernel":
        share_code(rays.sparkSession)
        return _kernel(rays, stars, smooth, shear, jacobian)
    if strategy == "cells":
        return _lensed(star_fields(rays.select("ray_id", "x", "y"), star_blocks(stars)), smooth, shear, jacobian)
    if strategy != "sql":
        raise ValueError("strategy is sql, kernel or cells")
    s = F.broadcast(stars.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("mass").alias("m")))
    met = rays.select("ray_id", "x", "y").join(s, F.lit(True), "left")
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    r2 = dx * dx + dy * dy
    none = F.col("m").isNull()
    part = lambda v: F.when(none, F.lit(0.0)).otherwise(F.try_divide(v, r2))
    sums = [F.sum(part(F.col("m") * dx)).alias("ax"), F.sum(part(F.col("m") * dy)).alias("ay"), F.max(F.when(r2 == 0, 1).otherwise(0)).alias("hit")]
    if jacobian:
        quad = lambda v: F.when(none, F.lit(0.0)).otherwise(F.try_divide(v, r2 * r2))
        sums += [F.sum(quad(F.col("m") * (dy * dy - dx * dx))).alias("p"), F.sum(quad(F.lit(2.0) * F.col("m") * dx * dy)).alias("c")]
    t = met.groupBy("ray_id", "x", "y").agg(*sums).where("hit = 0")
    bx, by = smooth_map(F.col("x"), F.col("y"), smooth, shear)
    cols = ["ray_id", "x", "y", (bx - F.col("ax")).alias("bx"), (by - F.col("ay")).alias("by")]
    if not jacobian:
        return t.select(*cols)
    det = (F.lit(1 - shear - smooth) - F.col("p")) * (F.lit(1 + shear - smooth) + F.col("p")) - F.col("c") * F.col("c")
    return t.select(*cols, det.alias("det")).withColumn("parity", parity_of(F.col("det")))


def star_blocks(stars: DataFrame) -> list:
    """Stars as broadcast arrays (x, y, mass) of STARS_A_BLOCK rows, read to the driver block by block."""
    context, blocks, block = stars.sparkSession.sparkContext, [], []
    for s in stars.select("x", "y", "mass").toLocalIterator():
        block.append((s[0], s[1], s[2]))
        if len(block) == STARS_A_BLOCK:
            blocks.append(context.broadcast(np.array(block, float)))
            block = []
    return [*blocks, context.broadcast(np.array(block, float).reshape(-1, 3))] if block else blocks


def star_sums(places: DataFrame, stars: DataFrame, terms, names) -> DataFrame:
    """places (x, y, ...) with a column for each of names: sums over all stars. terms(dx, dy, r2, mass) gives an array for each name.

    One pass over places whatever the number of blocks; a worker holds TILE pairs at a time.
    """
    share_code(places.sparkSession)
    blocks = star_blocks(stars)

    def run(batches):
        for pdf in batches:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            sums = np.zeros((len(names), len(pdf)))
            wide = max(1, TILE // max(1, len(pdf)))
            for block in blocks:
                field = block.value
                for a in range(0, len(field), wide):
                    s = field[a : a + wide]
                    dx, dy = x[:, None] - s[:, 0], y[:, None] - s[:, 1]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        for total, part in zip(sums, terms(dx, dy, dx * dx + dy * dy, s[:, 2])):
                            total += part.sum(axis=1)
            yield pdf.assign(**dict(zip(names, sums)))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema], *[f"{n} double" for n in names]])
    return places.mapInPandas(run, schema)


def _kernel(rays: DataFrame, stars: DataFrame, smooth: float, shear: float, jacobian: bool) -> DataFrame:
    """The fields of all stars are added up, then places made of them."""

    def terms(dx, dy, r2, m):
        w = m / r2
        yield w * dx
        yield w * dy
        if jacobian:
            w = w / r2
            yield w * (dy * dy - dx * dx)
            yield 2 * w * dx * dy

    return _lensed(star_sums(rays.select("ray_id", "x", "y"), stars, terms, ("ax", "ay", "p", "c") if jacobian else ("ax", "ay")), smooth, shear, jacobian)


def _lensed(rays: DataFrame, smooth: float, shear: float, jacobian: bool) -> DataFrame:
    """Rays with the sums over stars as places in the source plane."""
    # What isn't a number comes back from pandas as null.
    rays = rays.where(F.col("ax").isNotNull() & F.col("ay").isNotNull() & ~F.isnan("ax") & ~F.isnan("ay"))
    bx, by = smooth_map(F.col("x"), F.col("y"), smooth, shear)
    cols = ["ray_id", "x", "y", (bx - F.col("ax")).alias("bx"), (by - F.col("ay")).alias("by")]
    if not jacobian:
        return rays.select(*cols)
    det = (F.lit(1 - shear - smooth) - F.col("p")) * (F.lit(1 + shear - smooth) + F.col("p")) - F.col("c") * F.col("c")
    return rays.select(*cols, det.alias("det")).withColumn("parity", parity_of(F.col("det")))


def with_parity(rays: DataFrame, parity: int | str | None) -> DataFrame:
    """Rays of one parity: -1, 0, 1 or "neg", "zero", "pos"; None or anything else keeps all."""
    parity = {"neg": -1, "zero": 0, "pos": 1}.get(parity, parity)
    return rays.where(F.col("parity") == parity) if parity in (-1, 0, 1) else rays


def caustic_characteristic(places: DataFrame, stars: DataFrame, convergence: float, shear: float) -> DataFrame:
    """places (x, y, ...) with value: (1 - convergence)² less the squared size of shear plus the sum of m u² / |u|².

    u is the offset as a complex number; its square and size are real columns. A star at the place itself adds nothing.
    Stars come by broadcast, as in micro_trace; places are not shuffled.
    """

    def terms(dx, dy, r2, m):
        w = np.where(r2 > 0, m / np.where(r2 > 0, r2, 1.0), 0.0)
        yield w * (dx * dx - dy * dy)
        yield 2 * w * dx * dy

    keys = places.columns
    t = star_sums(places, stars, terms, ("_re", "_im"))
    re = F.lit(shear) + F.col("_re")
    return t.select(*keys, (F.lit((1 - convergence) ** 2) - (re * re + F.col("_im") * F.col("_im"))).alias("value"))


def macro_trace(rays: DataFrame, b: float, axis_ratio: float = 1.0, angle: float = 0.0, shear: float = 0.0, shear_angle: float = 0.0) -> DataFrame:
    """rays (ray_id, x, y) with bx, by, behind a singular isothermal ellipse of Einstein angle b and external shear.

    axis_ratio 1 is a sphere. The deflection is turned back from the ellipse's axes by the inverse of the turn into them;
    at the origin it is 0.
    """
    x, y = F.col("x"), F.col("y")
    r = F.sqrt(x * x + y * y)
    sin, cos = math.sin(angle), math.cos(angle)
    if axis_ratio == 1.0:
        ax, ay = F.try_divide(x * b, r), F.try_divide(y * b, r)
    else:
        q = math.sqrt(1 - axis_ratio * axis_ratio)
        u, v = x * sin + y * cos, y * sin - x * cos
        s = F.sqrt(F.lit(axis_ratio * axis_ratio) * u * u + v * v)
        ex = F.atan(F.try_divide(F.lit(q) * u, s)) * (b / q)
        ey = F.atanh(F.try_divide(F.lit(q) * v, s)) * (b / q)
        ax, ay = ex * sin - ey * cos, ex * cos + ey * sin
    ax, ay = F.coalesce(ax, F.lit(0.0)), F.coalesce(ay, F.lit(0.0))
    sc, ss = shear * math.cos(2 * shear_angle), shear * math.sin(2 * shear_angle)
    return rays.select("ray_id", "x", "y", (x - (ax + F.lit(sc) * x + F.lit(ss) * y)).alias("bx"), (y - (ay + F.lit(ss) * x - F.lit(sc) * y)).alias("by"))
