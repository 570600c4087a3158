"""Maps in long form (px, py, value): scaling, mirroring, smoothing, edges, histograms, slices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import equal_width_bucket, log_brightness
from ..plans.session import share_code


def scaled(values: DataFrame, log: bool = True) -> DataFrame:
    """-2.5 log10(value + 0.001), or as it is."""
    return values.withColumn("value", log_brightness(F.col("value"), 0.001)) if log else values


def flipped(values: DataFrame, nx: int) -> DataFrame:
    """Mirrored left to right."""
    return values.withColumn("px", F.lit(nx - 1) - F.col("px"))


def convolved(values: DataFrame, kernel: list[tuple[int, int, float]], nx: int, ny: int) -> DataFrame:
    """A small kernel (dx, dy, weight) over a dense map, edge pixels repeated beyond the edges.

    Every pixel sends its value to the pixels whose window has it; a pixel on the edge stands for those beyond. Sums are
    combined before the one shuffle.
    """
    k = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in kernel])
    rx, ry = max(abs(a) for a, _, _ in kernel), max(abs(b) for _, b, _ in kernel)
    # The places that repeat an edge pixel: itself and, on an edge, up to the kernel's reach beyond.
    reach = lambda c, n, r: F.sequence(F.when(F.col(c) == 0, F.lit(-r)).otherwise(F.col(c)), F.when(F.col(c) == n - 1, F.lit(n - 1 + r)).otherwise(F.col(c)))
    at = values.withColumn("ax", F.explode(reach("px", nx, rx))).withColumn("ay", F.explode(reach("py", ny, ry))).withColumn("k", F.explode(k))
    to = at.select((F.col("ax") - F.col("k.a")).cast("int").alias("px"), (F.col("ay") - F.col("k.b")).cast("int").alias("py"), (F.col("value") * F.col("k.w")).alias("v"))
    return to.where(f"px between 0 and {nx - 1} and py between 0 and {ny - 1}").groupBy("px", "py").agg(F.sum("v").alias("value"))


#: Pixels along a tile's side.
TILE = 256


def tiled(values: DataFrame, halo: int, nx: int, ny: int, function, tile: int = TILE) -> DataFrame:
    """function of every tile of a dense map with so many pixels more on each side, edge pixels repeated beyond the map.

    function(array, y0, x0) gets the tile's array with its halo, whose first row and column are pixels y0 and x0, and gives
    an array of the tile alone. A pixel goes to its own tile and to those whose halo has it, in the one shuffle; a pixel
    that isn't there is 0, and of repeated ones the last counts.
    """
    share_code(values.sparkSession)
    whole = lambda c: F.floor(c / tile).cast("int")
    tiles = lambda c, n: F.sequence(F.greatest(whole(F.col(c) - halo), F.lit(0)), F.least(whole(F.col(c) + halo), F.lit((n - 1) // tile)))
    at = values.select("px", "py", F.col("value").cast("double").alias("value")).withColumn("tx", F.explode(tiles("px", nx))).withColumn("ty", F.explode(tiles("py", ny)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["tx"].iloc[0]) * tile, int(pdf["ty"].iloc[0]) * tile
        x1, y1 = min(x0 + tile, nx), min(y0 + tile, ny)
        left, low = max(0, x0 - halo), max(0, y0 - halo)
        part = np.zeros((min(ny, y1 + halo) - low, min(nx, x1 + halo) - left))
        part[pdf["py"].to_numpy() - low, pdf["px"].to_numpy() - left] = pdf["value"].to_numpy()
        more = [(low - (y0 - halo), y1 + halo - min(ny, y1 + halo)), (left - (x0 - halo), x1 + halo - min(nx, x1 + halo))]
        out = function(np.pad(part, more, "edge"), y0 - halo, x0 - halo)
        py, px = np.mgrid[y0:y1, x0:x1]
        return pd.DataFrame({"px": px.ravel().astype(np.int32), "py": py.ravel().astype(np.int32), "value": out.ravel()})

    return at.groupBy("tx", "ty").applyInPandas(run, "px int, py int, value double")


def _weights(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def _along(a: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis, where the window fits."""
    n = a.shape[axis] - len(w) + 1
    return sum(x * a.take(range(i, i + n), axis) for i, x in enumerate(w))


def _smoothed(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _along(_along(a, w, 1), w, 0)


def _edges(a: np.ndarray) -> np.ndarray:
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return np.abs(_along(_along(a, slope, 1), smooth, 0)) + np.abs(_along(_along(a, smooth, 1), slope, 0))


def gaussian_smoothed(values: DataFrame, sigma: float, nx: int, ny: int, tile: int = TILE) -> DataFrame:
    """Gaussian smoothing in x, then in y; the kernel is cut at four sigma."""
    w = _weights(sigma)
    return tiled(values, len(w) // 2, nx, ny, lambda a, *_: _smoothed(a, w), tile)


def sobel_edges(values: DataFrame, nx: int, ny: int, tile: int = TILE) -> DataFrame:
    """|horizontal| + |vertical| Sobel gradient."""
    return tiled(values, 1, nx, ny, lambda a, *_: _edges(a), tile)


def smooth_and_detect(values: DataFrame, sigma: float, nx: int, ny: int, tile: int = TILE) -> DataFrame:
    """The edges of the smoothed map: both in one pass over tiles."""
    w = _weights(sigma)

    def run(a, y0, x0):
        s = _smoothed(a, w)
        # Beyond the map it is the smoothed edge that is repeated, not the edge that is smoothed.
        rows, cols = np.clip(np.arange(s.shape[0]) + y0 + len(w) // 2, 0, ny - 1), np.clip(np.arange(s.shape[1]) + x0 + len(w) // 2, 0, nx - 1)
        return _edges(s[rows - y0 - len(w) // 2][:, cols - x0 - len(w) // 2])

    return tiled(values, len(w) // 2 + 1, nx, ny, run, tile)


def histogram(values: DataFrame, bins: int = 100) -> DataFrame:
    """bucket, n: counts in bins of equal width between the extremes, the last closed."""
    return equal_width_bucket(values, "value", bins).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def line_pixels(spark, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """sample_idx, px, py: a line's nearest pixels, about one a pixel's length; halves go to the even pixel."""
    n = max(1, int(math.hypot(b[0] - a[0], b[1] - a[1])))
    t = spark.range(n).select(F.col("id").cast("int").alias("sample_idx"))
    at = lambda p, q: F.bround(F.lit(float(p)) + F.col("sample_idx") * F.lit((q - p) / n)).cast("int")
    return t.select("sample_idx", at(a[0], b[0]).alias("px"), at(a[1], b[1]).alias("py"))


def line_slice(values: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """sample_idx, px, py, value along a line. The line is a few thousand rows at most, a pixel's length each."""
    return values.join(F.broadcast(line_pixels(values.sparkSession, a, b)), ["px", "py"]).select("sample_idx", "px", "py", "value")


def drawn_curve(values: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame | None:
    """The light curve of a line drawn from a to b on a map: line_id 0, sample_idx, x, y, v; series operators take it as it is. A
    line without a length has none."""
    if a == b:
        return None
    return line_slice(values, a, b).select(F.lit(0).alias("trial"), F.lit(0).cast("long").alias("line_id"), "sample_idx", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), F.col("value").alias("v"))


def is_caustic(values: DataFrame) -> DataFrame:
    return values.withColumn("caustic", F.col("value") > 0)


def caustics_along(samples: DataFrame, caustic_map: DataFrame) -> DataFrame:
    """Samples (..., px, py) whose pixel is on a caustic."""
    return samples.join(caustic_map.where("value > 0").select("px", "py"), ["px", "py"], "left_semi")


def moment(values: DataFrame, index: int) -> DataFrame:
    """One plane of a moment map (px, py, moment_index, value)."""
    return values.where(F.col("moment_index") == index).select("px", "py", "value")
