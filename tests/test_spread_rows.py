"""Much work on rows of few bytes, which a single task would else read."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arclet.functions import cosmology as K

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["largest_stars", "lens_scales", "unit_angles", "angular_distances"])
def test_rows_of_one_file_are_worked_on_by_several_tasks(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_row_has_one_quadrature_for_each_redshift(spark):
    df = K.with_distances(spark.createDataFrame([(0.5, 2.0)], "zl double, zs double").repartition(2), F.col("zs"), F.col("zl"))
    known = (F.col("d_l"), F.col("d_s"), F.col("d_ls"))
    zs, zl, m = F.col("zs"), F.col("zl"), F.lit(3.0)
    out = df.select(K.theta_e_column(zs, zl, m, known).alias("a"), K.critical_density_column(zs, zl, known).alias("b"), K.theta_e_column(zs, zl, m).alias("c"))
    a, b, c = out.first()
    assert a == c == pytest.approx(K.theta_e(2.0, 0.5, 3.0)) and b == pytest.approx(K.critical_density(2.0, 0.5))
    assert out.drop("c")._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 2
