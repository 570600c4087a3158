import json

import numpy as np
import pandas as pd
import pytest

from arclet.functions.model import Polar, Vec
from arclet.sources import files as X


def test_binary_tables_come_back(spark, tmp_path):
    stars = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, -1.0, 0.5, 0.25)], "star_id long, x double, y double, mass double")
    X.write_stars(stars, str(tmp_path / "stars"))
    assert sorted(X.read_stars(spark, str(tmp_path / "stars")).collect()) == sorted(stars.collect())
    points = pd.DataFrame({"curve_id": [0, 0, 1], "sample_idx": [0, 1, 0], "qx": [1.0, 2.0, 3.0], "qy": [4.0, 5.0, 6.0]})
    X.write_points(spark.createDataFrame(points, "curve_id long, sample_idx int, qx double, qy double").repartition(3), str(tmp_path / "points"))
    assert [tuple(r) for r in sorted(X.read_points(spark, str(tmp_path / "points"), 2).collect())] == list(points.itertuples(index=False, name=None))
    values = pd.DataFrame({"px": [0, 1, 0, 1], "py": [0, 0, 1, 1], "value": [1.0, 2.0, 3.0, 4.0]})
    X.write_values(spark.createDataFrame(values, "px int, py int, value double").repartition(3), str(tmp_path / "values"))
    assert X.read_values(spark, str(tmp_path / "values"), 2).where("px = 1 and py = 0").first().value == 2.0


def test_documents_are_read_by_ending_and_never_run(spark, tmp_path):
    doc = {"name": "s", "trial_count": 2, "variation": "raise SystemExit", "parameters": {"percent_stars": 40, "ray_count": {"x": 20, "y": 20, "unit": ""}}, "results": {"magmap": {"magmap_resolution": {"x": 5, "y": 6, "unit": ""}}}}
    (tmp_path / "a.sim").write_text(json.dumps(doc, indent=2))
    r = X.read_document(spark, str(tmp_path / "a.sim")).first()
    assert r.trial_count == 2 and r.results.magmap.magmap_resolution.y == 6 and "variation" not in r.asDict()
    (tmp_path / "a.anim").write_text(json.dumps({"start_position": {"x": 1, "y": 2, "unit": "rad"}}))
    assert X.read_document(spark, str(tmp_path / "a.anim")).first().start_position.y == 2.0
    for kind in (".mp", ".param"):
        (tmp_path / f"b{kind}").write_text(json.dumps({"lens": {"redshift": 0.5}}))
        assert X.read_document(spark, str(tmp_path / f"b{kind}")).first().lens.redshift == 0.5
    X.write_document(X.read_document(spark, str(tmp_path / "a.sim")), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        X.read_document(spark, str(tmp_path / "a.txt"))


def test_fits_image_comes_back():
    image = np.arange(12.0).reshape(3, 4)
    content = X.fits_bytes(image, {"MAGNIF": 1.5, "OBJECT": "it's", "LENSED": True})
    got, header = X.fits_image(content)
    assert (got == image).all() and header["MAGNIF"] == 1.5 and header["LENSED"] is True and len(content) % 2880 == 0


def test_fits_files_of_others_are_read(spark, tmp_path):
    cards = ["SIMPLE  =                    T / conforms", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "BSCALE  =                  0.5 / scale", "BZERO   =              1.0E+01",
             "BLANK   =               -32768", "OBJECT  = 'it''s / one'        / a name", "COMMENT free text = here", "EQUINOX ="]
    head = ("".join(c.ljust(80) for c in cards) + "END".ljust(80)).ljust(2880).encode()
    data = np.array([[0, 2, 4], [-2, -32768, 6]], ">i2").tobytes().ljust(2880, b"\0")
    image, header = X.fits_image(head + data)
    assert np.array_equal(image, [[10, 11, 12], [9, np.nan, 13]], equal_nan=True) and header["OBJECT"] == "it's / one" and header["BSCALE"] == 0.5
    (tmp_path / "a.fits").write_bytes(head + data)
    assert X.read_fits(spark, str(tmp_path / "a.fits")).where("px = 2 and py = 1").first().value == 13.0
    values = spark.createDataFrame([(x, y, x + 10.0 * y) for x in range(5) for y in range(4)], "px int, py int, value double").repartition(3)
    X.write_fits(values, str(tmp_path / "b.fits"), 5, 4, {"OBJECT": "map"})
    content = (tmp_path / "b.fits").read_bytes()
    assert content == X.fits_bytes(np.add.outer(10.0 * np.arange(4), np.arange(5.0)), {"OBJECT": "map"})
    assert X.fits_image(("".join(c.ljust(80) for c in ("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "END"))).ljust(2880).encode())[0] is None
    with pytest.raises(ValueError):
        X.fits_image(b"x" * 2880)


def test_vectors():
    assert (Vec(3, 4) * 2 - 1).x == 5 and Vec(3, 4).magnitude == 5 and Vec(1, 2).to("uas", 0.5).y == 4
    assert Polar(2.0, 0.0).cartesian.x == 2.0 and Vec(0, 5).direction == Vec(0, 1)


def test_large_tables_are_read_in_parts_by_number(spark, tmp_path):
    from arclet.sources import formats

    a = np.random.default_rng(0).normal(size=(1000, 3))
    (tmp_path / "t").mkdir()
    for k, part in enumerate((a[:700], a[700:700], a[700:])):
        (tmp_path / "t" / f"{k}.bin").write_bytes(part.tobytes())
    df = formats.read_table(spark, str(tmp_path / "t"), partition_bytes=24 * 150)
    assert df.rdd.getNumPartitions() == 5 + 2
    got = df.orderBy("row").toPandas()
    assert got["row"].tolist() == list(range(1000)) and (got[["x", "y", "mass"]].to_numpy() == a).all()
    stars = X.read_stars(spark, str(tmp_path / "t")).orderBy("star_id").toPandas()
    assert stars["star_id"].tolist() == list(range(1000)) and (stars[["x", "y", "mass"]].to_numpy() == a).all()
    (tmp_path / "t" / "3.bin").write_bytes(b"odd")
    with pytest.raises(Exception, match="no table"):
        formats.read_table(spark, str(tmp_path / "t")).count()


def test_results_are_read_by_trial_without_the_rest(spark, tmp_path):
    from arclet.sources import documents, formats

    calls = []

    def made(k):
        calls.append(k)
        return np.full((40, 5), float(k + 10 * calls.count(k)))

    path = str(tmp_path / "a.res")
    documents.write_results_file(spark, path, {"n": 3}, [[lambda k=k: made(k), np.arange(6.0) + k] for k in range(3)])
    assert calls == [0, 1, 2] and not (tmp_path / "a.res.part").exists()
    df = formats.read_results(spark, path, partition_bytes=40 * 10)
    assert df.rdd.getNumPartitions() == 3 * (4 + 1)
    one = df.where("trial = 1 and result = 0")
    assert one.rdd.getNumPartitions() == 4 and df.where("trial = 9").rdd.getNumPartitions() == 1
    pdf = one.orderBy("row", "column").toPandas()
    assert pdf["value"].tolist() == [11.0] * 200 and pdf["row"].tolist() == [i // 5 for i in range(200)] and set(pdf["trial"]) == {1}
    assert df.where("trial = 2 and result = 1 and column = 4").first().value == 6.0 and df.where("trial = 9").count() == 0
    every = sorted(map(tuple, df.collect()))
    assert every == sorted(map(tuple, documents.read_results_file(spark, path).collect()))
    assert documents.read_one_result(spark, path, 2, 1).tolist() == (np.arange(6.0) + 2).tolist()
