"""Column forms of parameters, seeded fields, and written tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arclet.functions import columns as C
from arclet.functions import cosmology as K
from arclet.functions.model import Box, Vec
from arclet.sources import documents as D
from arclet.sources import formats
from arclet.sources.lines import lines_of, slice_lines
from arclet.sources.stars import with_velocities


def test_lens_scales_of_columns_are_those_of_numbers(spark):
    rows = [(0.01, 0.05, 1.0, 2e5), (0.5, 2.0, 3.0, 3e5), (1.0, 9.9, 1e9, 1e5), (0.039, 1.695, 0.1, 2.1e5)]
    df = spark.createDataFrame(rows, "zl double, zs double, mass double, speed double")
    zl, zs, m = F.col("zl"), F.col("zs"), F.col("mass")
    got = df.select(K.distance_column(zs, zl), K.theta_e_column(zs, zl, m), K.einstein_radius_column(F.col("speed"), zs, zl), K.critical_density_column(zs, zl), K.gravitational_radius_column(m, zs)).collect()
    for (l, s, mass, speed), r in zip(rows, got):
        want = (K.angular_diameter_distance(s, l), K.theta_e(s, l, mass), K.einstein_radius(speed, s, l), K.critical_density(s, l), K.gravitational_radius(mass, s))
        assert tuple(r) == pytest.approx(want, rel=1e-8)
    odd = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (None, 0.5), (0.5, None)], "zl double, zs double")
    assert [r[0] for r in odd.select(K.theta_e_column(zs, zl, F.lit(1.0))).collect()] == [None] * 4
    assert [r[0] for r in odd.select(K.einstein_radius_column(F.lit(1e5), zs, zl)).collect()][0] is None


def test_units_of_columns_are_those_of_numbers(spark):
    units = D.Units(1.695, 0.039, 1e9)
    names = ["", "theta_E", "xi", "eta", "r_g", *D.ANGLES, *D.LENGTHS]
    df = spark.createDataFrame([(u,) for u in names], "unit string")
    got = df.select("unit", D.angle_column(F.lit(3.0), F.col("unit"), F.lit(1.695), F.lit(0.039), F.lit(1e9)).alias("a")).collect()
    assert {r.unit: r.a for r in got} == pytest.approx({u: units.angle(3.0, u) for u in names}, rel=1e-8)
    odd = spark.createDataFrame([("parsnip",), (None,)], "unit string").select(D.angle_column(F.lit(3.0), F.col("unit"), F.lit(1.695), F.lit(0.039), F.lit(1e9)))
    assert [r[0] for r in odd.collect()] == [None, 3.0]


def test_fields_without_a_window_are_null(spark):
    df = spark.createDataFrame([(0.25, 0.25), (0.25, 0.75), (1.25, 0.25), (None, 0.1)], "k double, g double")
    w, h = C.ray_window(F.lit(30.0), F.lit(20.0), F.col("k"), F.col("g"), 1.5)
    got = df.select(w, h, C.raw_brightness(F.lit(1.0), F.lit(0.1), F.lit(0.1), F.col("k"), F.col("g"))).collect()
    assert got[0][0] == pytest.approx(90) and got[0][1] == 30 and got[0][2] == pytest.approx(math.pi * 100 * 2)
    assert [r[0] for r in got[1:]] == [None] * 3 and got[1][2] is None
    prints = df.select(C.ray_print(F.col("k"), F.lit(1)), C.ray_print(F.lit(1), F.col("k"))).collect()
    assert len({x for r in prints for x in r}) == 6 and prints[0][0] == prints[1][0]


def test_velocities_follow_their_law_for_any_partitions(spark):
    s = spark.range(20000).withColumnRenamed("id", "star_id")
    a = with_velocities(s.repartition(7), 8.0, 2.0, 9).orderBy("star_id").toPandas()
    b = with_velocities(s.coalesce(1), 8.0, 2.0, 9).orderBy("star_id").toPandas()
    assert a.equals(b) and (a["vx"] > 0).mean() > 0.99
    # A direction's own share along an axis is 0.5 of the speed or so; both axes are alike.
    assert abs(a["vx"].mean() - a["vy"].mean()) < 0.1 and 3.5 < a["vx"].mean() < 4.5
    assert not with_velocities(s, 8.0, 2.0, 10).orderBy("star_id").toPandas().equals(b)


def test_lines_belong_to_their_keys(spark):
    box = Box(Vec(0, 0), Vec(4, 2))
    few, many = lines_of(spark.range(3), box, 1, "id"), lines_of(spark.range(100), box, 1, "id")
    assert few.exceptAll(many).isEmpty() and many.where("abs(ax) > 2 or abs(ay) > 1 or abs(dx) > 2 or abs(dy) > 1").isEmpty()
    still = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.5, 0.0)], "curve_id long, ax double, ay double, dx double, dy double")
    assert [r.curve_id for r in slice_lines(still, box).select("curve_id").distinct().collect()] == [1]


def test_tables_are_written_by_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") * 7 % 1000 * 0.5).alias("v"), F.when(F.col("id") != 3, F.col("id")).alias("w"))
    formats.write_table(df, path, columns=("v", "w"))
    assert len([f for f in (tmp_path / "t").iterdir()]) == df.rdd.getNumPartitions() > 1
    formats.write_table(df, path, ["k"], ("v", "w"))
    got = formats.read_table(spark, path, ("v", "w"), 64).orderBy("row").toPandas()
    assert got["v"].tolist() == [k * 0.5 for k in range(1000)] and np.isnan(got["w"][21]) and got["w"].isna().sum() == 1
    formats.write_table(df.limit(2), path, ["k"], ("v", "w"), "append")
    assert formats.read_table(spark, path, ("v", "w")).count() == 1002
    assert formats.read_table(spark, path, ("v", "w")).where("row >= 1000").count() == 2
    formats.write_table(df.limit(0), path, ["k"], ("v", "w"))
    assert formats.read_table(spark, path, ("v", "w")).count() == 0 and not list((tmp_path / "t").iterdir())


def test_a_job_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    formats.write_table(spark.range(5), path, ["id"], ("id",))
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no such star")).cast("double")).otherwise(F.col("id").cast("double")).alias("id"))
    with pytest.raises(Exception, match="no such star"):
        formats.write_table(bad, path, columns=("id",))
    assert formats.read_table(spark, path, ("id",)).orderBy("row").toPandas()["id"].tolist() == [0, 1, 2, 3, 4]
    assert all(f.name.startswith("part-") for f in (tmp_path / "t").iterdir())
