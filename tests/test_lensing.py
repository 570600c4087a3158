import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arclet.functions import cosmology, imf
from arclet.functions.model import Animation, Box, LensModel, MicroParameters, Polar, Simulation, SourceModel, StarField, Vec
from arclet.operators.products import magnification_map
from arclet.operators.spatial import cell_bins, connecting_rays, disk_join, disk_points
from arclet.operators.trace import macro_trace, micro_trace
from arclet.plans.trials import Engine, describe, load_result, load_simulation, overridden, run_simulation
from arclet.sources.lattice import cell_lattice, query_lattice, ray_lattice
from arclet.sources.lines import ragged, slice_region, unragged
from arclet.sources import stars as stars_module
from arclet.sources.stars import draw_stars, star_velocities

BOX = Box(Vec(0, 0), Vec(4, 4), 16, 16)


def star_frame(spark, rows):
    return spark.createDataFrame(rows, "star_id long, x double, y double, mass double")


def rays_at(spark, places):
    return spark.createDataFrame([(i, 0.0, 0.0, *p) for i, p in enumerate(places)], "ray_id long, x double, y double, bx double, by double")


def test_one_star_deflects_by_mass_over_distance(spark):
    rays = spark.createDataFrame([(0, 3.0, 4.0), (1, 0.0, 0.0)], "ray_id long, x double, y double")
    for strategy in ("sql", "kernel"):
        got = micro_trace(rays, star_frame(spark, [(0, 0.0, 0.0, 2.0)]), 0.0, 0.0, True, strategy).collect()
        assert len(got) == 1, "the ray at the star has no finite place"
        r = got[0]
        assert (r.bx, r.by) == pytest.approx((3 - 2 * 3 / 25, 4 - 2 * 4 / 25))
        assert r.det == pytest.approx(1 - (2 / 25) ** 2) and r.parity == 1


def test_without_stars_the_map_is_linear_and_magnifies_evenly(spark):
    rays = micro_trace(ray_lattice(spark, 200, 200, 0.05, 0.05), star_frame(spark, []), 0.3, 0.2)
    assert [r.parity for r in rays.select("parity").distinct().collect()] == [1]
    raw = math.pi * 0.25**2 / 0.05**2 / (0.5 * 0.9)
    inner = magnification_map(rays, Box(Vec(0, 0), Vec(2, 2), 4, 4), 0.25, raw)
    assert inner.agg(F.min("value"), F.max("value")).first() == pytest.approx((1, 1), abs=0.08)


def test_strategies_agree_and_edges_are_inclusive(spark):
    rng = np.random.RandomState(1)
    rays = rays_at(spark, [(3.0, 4.0), *(map(float, p) for p in rng.uniform(-3, 3, (400, 2)))])
    got = [sorted(disk_join(rays, BOX, 0.7, (0, 1), s).collect()) for s in ("scatter", "cells", "naive")]
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]] == [r[:3] for r in got[2]]
    assert [r.m1 for r in got[0]] == pytest.approx([r.m1 for r in got[1]])
    # A 3-4-5 triangle: exactly at the radius counts.
    assert connecting_rays(rays, 0.0, 0.0, 5.0).where("ray_id = 0").count() == 1
    one = disk_points(rays, spark.createDataFrame([(0, 0, 0.0, 0.0)], "curve_id long, sample_idx int, qx double, qy double"), 5.0)
    assert one.first().m0 == rays.where("bx * bx + by * by <= 25").count()


def test_cells_leave_out_edges_and_lose_nothing_else(spark):
    rays = rays_at(spark, [(0.0, 0.1), (0.1, 0.1), (0.1, 0.25), (9.0, 9.0), (-2.0, -2.0)])
    assert [(r.px, r.py, r.m0) for r in cell_bins(rays, BOX).collect()] == [(8, 8, 1)]


def test_moving_all_together_changes_nothing(spark):
    rng = np.random.RandomState(2)
    p = rng.randint(-40, 40, (300, 2)) / 16
    a = disk_join(rays_at(spark, p.tolist()), BOX, 0.5).orderBy("px", "py").collect()
    b = disk_join(rays_at(spark, (p + 8).tolist()), Box(Vec(8, 8), Vec(4, 4), 16, 16), 0.5).orderBy("px", "py").collect()
    assert a == b


def test_sphere_deflects_by_its_angle(spark):
    rays = spark.createDataFrame([(0, 3.0, 4.0), (1, 0.0, 0.0)], "ray_id long, x double, y double")
    r = {x.ray_id: x for x in macro_trace(rays, 1.0).collect()}
    assert (r[0].bx, r[0].by) == pytest.approx((3 - 0.6, 4 - 0.8)) and (r[1].bx, r[1].by) == (0.0, 0.0)


def test_turned_ellipse_is_the_ellipse_turned(spark):
    a, t = 0.6, 0.7
    x, y = 1.2, -0.4
    straight = macro_trace(spark.createDataFrame([(0, x, y)], "ray_id long, x double, y double"), 1.0, a, 0.0).first()
    c, s = math.cos(t), math.sin(t)
    # The angle turns the axes clockwise.
    turned = macro_trace(spark.createDataFrame([(0, x * c + y * s, y * c - x * s)], "ray_id long, x double, y double"), 1.0, a, t).first()
    assert (turned.bx, turned.by) == pytest.approx((straight.bx * c + straight.by * s, straight.by * c - straight.bx * s))


def test_lattices(spark):
    assert query_lattice(spark, BOX).agg(F.min("qx"), F.max("qx")).first() == (-2.0, 1.75)
    assert query_lattice(spark, BOX, True).agg(F.min("qx"), F.max("qx")).first() == (-2.0, 2.0)
    assert cell_lattice(spark, BOX).where("px = 0 and py = 0").first()[2:] == (-2.0, -1.75, -2.0, -1.75)
    assert ray_lattice(spark, 3, 3, 1, 1).agg(F.min("x"), F.max("x")).first() == (-1.0, 1.0)


def test_ragged_points_come_back(spark):
    p = slice_region(spark, Box(Vec(0, 0), Vec(2, 2)), (0.1, 0.2), (0.25, 0.125))
    assert sorted(unragged(ragged(p)).collect()) == sorted(p.collect()) and p.count() > 3


def test_mass_functions():
    law = imf.PowerLaw.named("Kroupa_2001_Modified")
    u = np.linspace(0, 0.999, 50)
    m = law.sample(u)
    whole = law.integral(*law.limits[[0, -1]])
    assert [law.integral(0.08, x) / whole for x in m] == pytest.approx(list(u), abs=1e-9)
    assert law.density(0.5 - 1e-12) == pytest.approx(law.density(0.5))
    assert law.normalized(100.0).integral(0.08, 1.5, 1) == pytest.approx(100)
    got = law.cluster(500.0, np.random.RandomState(3))
    assert abs(got.sum() - 500) < 1.5 and (got >= 0.08).all()
    assert imf.evolved([0.5, 0.8, 5, 9, 40]).tolist() == [0.5, 0.6, 0.6, 1.4, 10.0]
    old = imf.PowerLaw.named("Kroupa_2001").cluster(2000.0, np.random.RandomState(3), imf.REMNANTS)
    assert old.max() <= 10 and abs(old.sum() - 2000) <= 10
    assert 1 < imf.PowerLaw.named("Weidner_Kroupa_2004").largest_star(1000.0) < 1000


def test_cosmology():
    # Published distance of redshift 1 in this cosmology: about 1,630 Mpc.
    assert cosmology.angular_diameter_distance(1.0) / cosmology.PARSEC / 1e6 == pytest.approx(1650, rel=0.02)
    assert cosmology.theta_e(2.0, 0.5, 4) == pytest.approx(2 * cosmology.theta_e(2.0, 0.5))
    assert cosmology.critical_density(2.0, 0.5) > 0 and cosmology.einstein_radius(300e3, 2.0, 0.5) < 1e-4


def simulation():
    lens = LensModel(0.5, 0.0, Polar(0.0), Polar(0.0))
    micro = MicroParameters(SourceModel(2.0, 1e9, 0.4), lens, 20.0, Vec(0, 0), (60, 60), Box(Vec(0, 0), Vec(4, 4)), StarField(7, name="Kroupa_2001_Modified"), 0.3, 0.2)
    results = {"magmap": {"nx": 8, "ny": 8}, "momentmap": {"nx": 4, "ny": 4}, "causticmap": {"nx": 4, "ny": 4}, "lightcurves": {"seed": 1, "num_curves": 3, "step": 0.25}}
    return Simulation("small", micro, results, 2, "two radii", {1: {"source.radius": 0.2}})


def test_runs_with_an_index_give_the_same_and_trace_once(spark, tmp_path, monkeypatch):
    from arclet.plans import trials

    sim, index = simulation(), str(tmp_path / "index")
    run_simulation(spark, sim, str(tmp_path / "a"))
    run_simulation(spark, sim, str(tmp_path / "b"), index=index)
    monkeypatch.setattr(trials, "micro_trace", None)
    run_simulation(spark, sim, str(tmp_path / "c"), index=index)
    for kind in sim.results:
        a, b, c = (sorted(map(repr, load_result(spark, str(tmp_path / x), kind).drop("distance").collect())) for x in "abc")
        assert a and b == c and (a == b or kind == "momentmap")


def test_simulation_is_stored_and_read_by_trial(spark, tmp_path):
    sim, path = simulation(), str(tmp_path / "out.res")
    run_simulation(spark, sim, path)
    assert load_simulation(spark, path) == sim and "two radii" in describe(spark, path)
    m = load_result(spark, path, "magmap")
    assert m.groupBy("trial").count().collect()[0]["count"] == 64 and m.select("trial").distinct().count() == 2
    assert load_result(spark, path, "momentmap", 1).where("moment_index = 5").count() == 16
    assert load_result(spark, path, "lightcurves", 0).count() > 0
    with pytest.raises(IndexError):
        load_result(spark, path, "magmap", 2)
    with pytest.raises(KeyError):
        load_result(spark, path, "spectra")


def test_rays_are_reused_for_other_radii_only(spark):
    e, p = Engine(spark), simulation().parameters
    first = e.rays(p)
    assert e.rays(overridden(p, {"source.radius": 0.1, "source.mass": 5.0})) is first
    assert e.rays(overridden(p, {"percent_stars": 50.0})) is not first
    assert e.frame(Animation(p, Vec(0, 0), Vec(0.1, 0)), 2.0).count() >= 0
    e.close()
    with pytest.raises(ValueError):
        overridden(p, {"nothing": 1})


def test_draws_are_seeded():
    p = simulation().parameters
    a, b = draw_stars(p.stars, p.starry_region, 20.0), draw_stars(p.stars, p.starry_region, 20.0)
    assert a.equals(b) and len(a) > 5 and (np.hypot(a.x, a.y) <= p.starry_region.radius).all()
    assert (star_velocities(50, 5.0, 0.1, 1) >= 0).all()


def test_stream_of_frames_counts_as_a_batch(spark, tmp_path):
    from arclet.streaming.frames import brightness_by_window, frame_rays, positions

    rays = rays_at(spark, [(0.0, 0.0), (0.1, 0.0), (5.0, 5.0)])
    frames = spark.range(4).selectExpr("id as frame", "timestamp_seconds(id) as ts")
    frames.write.parquet(str(tmp_path / "frames"))
    batch = positions(frames, Vec(0, 0), Vec(1, 0), 0.1)
    stream = positions(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames")), Vec(0, 0), Vec(1, 0), 0.1)
    q = frame_rays(stream, rays, 0.2).writeStream.format("memory").queryName("lit").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(spark.table("lit").collect()) == sorted(frame_rays(batch, rays, 0.2).collect())
    assert brightness_by_window(batch, rays, 0.2).agg(F.sum("rays")).first()[0] == frame_rays(batch, rays, 0.2).count()


def test_many_stars_go_to_the_kernel_and_come_in_blocks(spark, monkeypatch):
    from arclet.operators import trace

    rays = ray_lattice(spark, 12, 12, 0.5, 0.5)
    stars = star_frame(spark, [(i, 0.1 + i * 0.3, -0.2 - i * 0.1, 1.0 + i) for i in range(7)])
    want = {r.ray_id: r for r in micro_trace(rays, stars, 0.3, 0.2, True, "sql").collect()}
    monkeypatch.setattr(trace, "STARS_A_BLOCK", 2)
    monkeypatch.setattr(trace, "STARS_BY_JOIN", 3)
    many = micro_trace(rays, stars, 0.3, 0.2, True, "sql")
    assert "Join" not in many._jdf.queryExecution().toString()
    got = {r.ray_id: r for r in many.collect()}
    assert set(got) == set(want) and all(got[i].bx == pytest.approx(want[i].bx) and got[i].det == pytest.approx(want[i].det) for i in want)


def test_rays_of_an_index_are_traced_once(spark, tmp_path, monkeypatch):
    from arclet.plans import trials

    sim = simulation()
    p = sim.parameters
    first = trials.Engine(spark, index=str(tmp_path / "i"), index_files=30)
    rays = sorted(map(tuple, first.rays(p).select("ray_id", "bx").collect()))
    monkeypatch.setattr(trials, "micro_trace", None)
    again = trials.Engine(spark, index=str(tmp_path / "i"))
    assert sorted(map(tuple, again.rays(p).select("ray_id", "bx").collect())) == rays and len(rays) > 0
    store = again._store
    points = spark.createDataFrame([(0, i, 0.1 * i - 1, 0.05 * i) for i in range(20)], "curve_id int, sample_idx int, qx double, qy double")
    few, every = again.rays_near(p, points, 0.2), again.rays(p)
    assert 0 < len(few.inputFiles()) < len(store.boxes) == len(every.inputFiles())
    keys = ("curve_id", "sample_idx", "m0")
    assert sorted(map(tuple, disk_points(few, points, 0.2).select(*keys).collect())) == sorted(map(tuple, disk_points(every, points, 0.2).select(*keys).collect()))
    box = Box(Vec(1.0, 1.0), Vec(1.0, 1.0), 8, 8)
    part = again.rays_inside(p, box, 0.1)
    assert 0 < len(part.inputFiles()) < len(store.boxes)
    assert sorted(map(tuple, disk_join(part, box, 0.1).collect())) == sorted(map(tuple, disk_join(every, box, 0.1).collect()))
    assert not again.rays_near(p, points.select("curve_id", "sample_idx", (F.col("qx") + 1e6).alias("qx"), "qy"), 0.2).inputFiles()


def test_kth_value_and_columns(spark):
    from arclet.operators import spatial

    rng = np.random.default_rng(0)
    v = np.concatenate((rng.exponential(5, 3000), np.full(2000, 1.5), [1e9]))
    p = spark.createDataFrame([(float(x),) for x in v], "bx double").union(spark.createDataFrame([(None,)], "bx double"))
    ranks = (1, 2, 701, 2501, 5000, 5001, 5002)
    p = p.withColumn("by", -F.col("bx"))
    for bins in (1, 16, 1024):
        got = {(r.axis, r.k): r.v for r in spatial.order_statistics(p, {c: [F.lit(k) for k in ranks] for c in ("bx", "by")}, bins).collect()}
        assert got == {**{("bx", k): np.sort(v)[k - 1] for k in ranks[:-1]}, **{("by", k): np.sort(-v)[k - 1] for k in ranks[:-1]}}
    assert spatial.order_statistics(p.limit(0), {"bx": [F.lit(1)]}).count() == 0
    parts = spatial.column_ranges(p, "bx", 4).orderBy("column").collect()
    # 2,000 equal values stay together.
    assert sum(r.n for r in parts) == len(v) and all(a.high < b.low for a, b in zip(parts, parts[1:])) and spatial.column_ranges(p.limit(0), "bx", 4).count() == 0
    assert list(spatial.columns_near([1.0, 2.0, 3.0], 1.5, 0.6)) == [0, 1, 2] and list(spatial.columns_near([], 0, 1)) == [0]


@pytest.mark.parametrize("name,total,top", [("Kroupa_2001", 1000.0, 51.0), ("Kroupa_2001", 1e4, 283.0), ("Salpeter_1955", 100.0, 6.8)])
def test_above_the_largest_star_lies_one(spark, name, total, top):
    law = imf.PowerLaw.named(name)
    x, high = law.largest_star(total), min(law.limits[-1], total)
    assert x == pytest.approx(top, rel=2e-3) and law.integral(law.limits[0], x, 1) / law.integral(x, high) == pytest.approx(total)
    got = spark.range(1).select(imf.largest_star_column(F.lit(total), law).alias("x")).first().x
    assert got == pytest.approx(x)


def test_clusters_are_the_same_for_any_partitions(spark):
    law, want = imf.PowerLaw.named("Kroupa_2001"), None
    clusters = [(1, 300.0), (2, 5000.0), (3, 0.005), (4, 40.0)]
    for partitions, block in ((1, 1 << 16), (5, 64), (3, 7)):
        stars_module.BLOCK, kept = block, stars_module.BLOCK
        df = spark.createDataFrame(clusters, "cluster int, total double").repartition(partitions)
        got = sorted(map(tuple, stars_module.star_clusters(df, law, 3).collect()))
        stars_module.BLOCK = kept
        want = want or got
        assert got == want
    by = {c: [m for k, _, m in want if k == c] for c in (1, 2, 3, 4)}
    for c, total in clusters[:2]:
        running = np.cumsum(by[c])
        # No star more or less comes nearer, and none is larger than the cluster.
        assert abs(running[-1] - total) <= abs(running[-2] - total) and running[-2] < total and max(by[c]) < total
    assert not by[3] and np.mean(np.array(by[2]) < 0.5) == pytest.approx(law.integral(0.01, 0.5) / law.integral(0.01, 5000), abs=0.02)
    old = stars_module.star_clusters(spark.createDataFrame(clusters[1:2], "cluster int, total double"), law, 3, imf.REMNANTS)
    assert old.agg(F.sum("mass"), F.max("mass")).first()[0] == pytest.approx(5000, abs=5) and old.agg(F.max("mass")).first()[0] <= 10


def test_several_radii_are_one_pass(spark):
    from arclet.functions.model import Box, Vec
    from arclet.operators import spatial

    rng = np.random.default_rng(2)
    rays = spark.createDataFrame(pd.DataFrame(np.round(rng.normal(0, 3, (500, 4)) * 8) / 8, columns=["x", "y", "bx", "by"]))
    box, radii = Box(Vec(0.0, 0.0), Vec(8.0, 8.0), 16, 16), [1.0, 0.25, 2.0, 1.0]
    for strategy in ("scatter", "cells", "naive"):
        got = sorted(map(tuple, spatial.disk_join(rays, box, radii, (0, 1, 4), strategy).select("trial", "px", "py", "m0", "m1", "m4").collect()))
        want = [(i, *r) for i, r0 in enumerate(radii) for r in spatial.disk_join(rays, box, r0, (0, 1, 4), strategy).select("px", "py", "m0", "m1", "m4").collect()]
        assert got == sorted(want)
    plan = spatial.disk_join(rays, box, radii, strategy="scatter")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_truncated_mass_functions_and_error_function():
    law = imf.PowerLaw.named("Kroupa_2001")
    cut = law.truncated(500.0)
    top = cut.limits[-1]
    assert cut.integral(0.01, 1e3, 1) == pytest.approx(500, rel=1e-6) and cut.density(top * 1.01) == 0 < cut.density(top * 0.99)
    assert cut.integral(0.02, top + 5) == pytest.approx(cut.integral(0.02, top))
    x = np.linspace(-3, 3, 25)
    assert imf.error(x) == pytest.approx([math.erf(a) for a in x], abs=4e-4) and imf.error_inverse(imf.error(x[6:19])) == pytest.approx(x[6:19])
    assert imf.half_at_zero([0.0, 2.0]).tolist() == [0.5, 1.0] and imf.inside([1, 2, 4.0], 1, 3).tolist() == [1, 1, 0]


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_cells_of_stars_are_as_good_as_all_stars(spark, n):
    rng = np.random.default_rng(n)
    field = np.column_stack((rng.normal(0, 12, n), rng.normal(3, 12, n), rng.uniform(0.1, 2, n)))
    stars = star_frame(spark, [(i, *map(float, s)) for i, s in enumerate(field)])
    # A ray at a star's place goes; two stars at one place are no trouble.
    stars = stars.unionByName(star_frame(spark, [(n, 1.0, 0.5, 1.0), (n + 1, 1.0, 0.5, 2.0)]))
    rays = ray_lattice(spark, 60, 40, 0.5, 0.25)
    want, got = (micro_trace(rays, stars, 0.3, 0.1, True, s).orderBy("ray_id").toPandas() for s in ("kernel", "cells"))
    assert got["ray_id"].tolist() == want["ray_id"].tolist() and len(got) == 60 * 40 - 1
    for c in ("bx", "by"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-9)
    assert got["det"].to_numpy() == pytest.approx(want["det"].to_numpy(), rel=1e-6, abs=1e-6)
    assert (got["parity"] == want["parity"]).mean() > 0.999


def test_far_cells_stay_within_their_error_bound():
    from arclet.operators import multipole

    rng = np.random.default_rng(5)
    s = rng.uniform(-1, 1, (500, 2)) @ [1, 1j]
    cells = multipole.Cells.of(np.column_stack((s.real, s.imag, rng.uniform(0.5, 1, 500))))
    for distance in (2.2, 3.0, 10.0, 1e4):
        t = distance * 2 ** 0.5 * np.exp(1j)
        z = t + rng.uniform(-0.05, 0.05, (50, 2)) @ [1, 1j]
        f, d = cells.field(z)
        exact = (cells.mass / (z[:, None] - cells.z)).sum(axis=1)
        bound = 2 * multipole.RATIO**multipole.TERMS / (1 - multipole.RATIO) ** 2 * (cells.mass / np.abs(t - cells.z)).sum() * 2
        assert np.abs(f - exact).max() <= bound + 1e-14 * np.abs(exact).max()
        slope = -(cells.mass / (z[:, None] - cells.z) ** 2).sum(axis=1)
        assert d == pytest.approx(slope, rel=1e-7)
