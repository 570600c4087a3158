import io
import json

import numpy as np
import pytest

from arclet.__main__ import main
from arclet.functions.model import macro_of, similar
from arclet.plans.trials import load_result
from arclet.sources import documents as D

UNIT = lambda v, u="": {"values": v, "unit": u}
POLAR = {"magnitude": UNIT(0.1), "direction": 90.0}
PARAMETERS = {
    "lens": {"redshift": 0.04, "velocity_dispersion": UNIT(215.0, "km / s"), "shear": POLAR, "ellipticity": POLAR},
    "source": {"redshift": 1.7, "mass": UNIT(1e9, "solMass"), "radius": UNIT(40.0, "r_g")},
    "star_generator": {"seed": 5, "mass_limits": [0.08, 0.5, 1.5], "powers": [-1.3, -2.7], "conversions": [[0.8, 0.6]]},
    "percent_stars": 5, "image_center": {"x": 0, "y": 0, "unit": "rad"}, "ray_count": {"x": 40, "y": 40, "unit": ""},
    "source_plane": {"center": {"x": 0, "y": 0, "unit": "theta_E"}, "dims": {"x": 4, "y": 4, "unit": "theta_E"}},
}
SIM = {"name": "n", "description": "d", "trial_count": 1, "variation": "raise SystemExit", "parameters": PARAMETERS, "results": {"magmap": {"magmap_resolution": {"x": 4, "y": 4, "unit": ""}}, "lightcurves": {"seed": 1, "num_curves": 2, "sample_density": UNIT(4.0, "1 / theta_E")}}}


def test_units_become_einstein_angles():
    u = D.Units(1.7, 0.04, 1e9)
    assert u.angle(3, "theta_E") == 3 and u.angle(u.theta_e, "rad") == pytest.approx(1)
    assert u.angle(1, "arcsec") == pytest.approx(1e6 * u.angle(1, "uas")) and 0 < u.angle(1, "r_g") < 1
    assert u.angle(1, "pc") == pytest.approx(u.angle(3.0856775814913674e13, "km"))
    with pytest.raises(ValueError):
        u.angle(1, "parrot")


def test_documents_run_from_the_command_line(spark, tmp_path):
    (tmp_path / "x.sim").write_text(json.dumps(SIM))
    main(["--run", str(tmp_path / "x.sim"), "--outfile", str(tmp_path / "out")])
    assert load_result(spark, str(tmp_path / "out"), "magmap", 0).count() == 16
    assert load_result(spark, str(tmp_path / "out"), "lightcurves").count() > 0


def test_parameters_open_by_ending(spark, tmp_path):
    (tmp_path / "a.mp").write_text(json.dumps(PARAMETERS))
    p = D.open_parameters(spark, str(tmp_path / "a.mp"))
    assert p.lens.velocity_dispersion == 215000 and p.stars.conversions == ((0.8, 0.6),) and similar(p, p)
    assert macro_of(p, 2.0).to_micro(5, p.image_center, 4.0, p.stars).source_plane.dims.x == 4.0
    (tmp_path / "a.param").write_text(json.dumps({**PARAMETERS, "ray_region": {"center": {"x": 0, "y": 0, "unit": "uas"}, "dims": {"x": 1, "y": 1, "unit": "arcsec"}, "resolution": {"x": 9, "y": 8, "unit": ""}}}))
    assert D.open_parameters(spark, str(tmp_path / "a.param")).ray_region.ny == 8
    (tmp_path / "a.anim").write_text(json.dumps({"parameters": PARAMETERS, "start_position": {"x": 1, "y": 2, "unit": "theta_E"}, "quasar_velocity": {"x": 0.5, "y": 0, "unit": "theta_E"}}))
    assert D.open_parameters(spark, str(tmp_path / "a.anim")).position(2.0).x == 2.0
    with pytest.raises(ValueError):
        D.open_parameters(spark, str(tmp_path / "a.doc"))


def test_results_files_come_back(spark, tmp_path):
    maps = [np.arange(6.0).reshape(2, 3), np.ones((2, 3))]
    blob = lambda a: (b := io.BytesIO(), np.save(b, a))[0].getvalue()
    head = json.dumps({"name": "n"}).encode()
    table = np.zeros((2, 1), np.int64)
    table[:, 0] = [0, len(blob(maps[0]))]
    content = head + blob(table) + b"".join(map(blob, maps))
    (tmp_path / "a.res").write_bytes(content)
    assert D.results_head(content) == {"name": "n"}
    got = D.read_results_file(spark, str(tmp_path / "a.res"))
    assert got.count() == 12 and got.where("trial = 0 and row = 1 and column = 2").first().value == 5.0


def test_results_files_are_written_and_read_one_by_one(spark, tmp_path):
    maps = [[np.arange(6.0).reshape(2, 3), lambda: np.ones(70_000)], [np.zeros((4, 4)), np.full((1, 2), 7.0)]]
    path = str(tmp_path / "b.res")
    D.write_results_file(spark, path, {"name": "é", "n": 3}, maps)
    assert D.results_head((tmp_path / "b.res").read_bytes()) == {"name": "é", "n": 3}
    for t, r in ((0, 0), (0, 1), (1, 0), (1, 1)):
        want = maps[t][r]() if callable(maps[t][r]) else maps[t][r]
        assert np.array_equal(D.read_one_result(spark, path, t, r), want)
    assert D.read_results_file(spark, path).where("trial = 1 and result = 1").agg({"value": "sum"}).first()[0] == 14.0
    D.write_results_file(spark, str(tmp_path / "e.res"), {}, [])
    assert D.read_results_file(spark, str(tmp_path / "e.res")).count() == 0
    with pytest.raises(ValueError):
        (tmp_path / "c.res").write_bytes(b"{}")
        D.read_one_result(spark, str(tmp_path / "c.res"), 0, 0)
