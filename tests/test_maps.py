"""Stencils on tiles against the same stencils as sums over pixels, and against whole arrays."""

import numpy as np
import pandas as pd
import pytest

from arclet.operators import maps as M


def dense(spark, a):
    py, px = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"px": px.ravel(), "py": py.ravel(), "value": a.ravel()}), "px int, py int, value double").repartition(3)


def array(df, a):
    pdf = df.toPandas()
    out = np.full(a.shape, np.nan)
    out[pdf["py"], pdf["px"]] = pdf["value"]
    assert len(pdf) == a.size
    return out


def windows(a, w, axis):
    r = len(w) // 2
    b = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], "edge")
    return sum(x * b.take(range(i, i + a.shape[axis]), axis) for i, x in enumerate(w))


def whole_edges(a):
    smooth, slope = [1, 2, 1], [-1, 0, 1]
    return abs(windows(windows(a, slope, 1), smooth, 0)) + abs(windows(windows(a, smooth, 1), slope, 0))


@pytest.mark.parametrize("tile", [1, 5, 256])
def test_tiles_give_what_the_whole_map_does(spark, tile):
    a = np.random.default_rng(tile).poisson(5, (11, 17)).astype(float)
    w = np.exp(-0.5 * (np.arange(-5, 6) / 1.3) ** 2)
    smooth = windows(windows(a, w / w.sum(), 1), w / w.sum(), 0)
    assert array(M.gaussian_smoothed(dense(spark, a), 1.3, 17, 11, tile), a) == pytest.approx(smooth)
    assert array(M.sobel_edges(dense(spark, a), 17, 11, tile), a) == pytest.approx(whole_edges(a))
    assert array(M.smooth_and_detect(dense(spark, a), 1.3, 17, 11, tile), a) == pytest.approx(whole_edges(smooth))


def test_tiles_take_one_shuffle_of_borders(spark):
    a = np.ones((40, 40))
    found = M.smooth_and_detect(dense(spark, a), 1.0, 40, 40, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # A kernel over pixels gives the same where tiles are not wanted.
    kernel = [(dx, dy, 1.0) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    assert array(M.convolved(dense(spark, a), kernel, 40, 40), a) == pytest.approx(9 * a)
