"""Simulations and parameters of JSON documents, in Einstein angles; results files with a JSON head."""

from __future__ import annotations

import io
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cosmology
from ..functions.model import Animation, Box, LensModel, MacroParameters, MicroParameters, Polar, Simulation, SourceModel, StarField, Vec
from ..plans.session import file_system, share_code

ARCSEC = math.pi / 180 / 3600
#: Radians in angles, metres in lengths; lengths are seen at the source's distance.
ANGLES = {"rad": 1.0, "deg": math.pi / 180, "arcsec": ARCSEC, "mas": 1e-3 * ARCSEC, "uas": 1e-6 * ARCSEC}
LENGTHS = {"m": 1.0, "km": 1e3, "AU": 1.495978707e11, "pc": cosmology.PARSEC, "lyr": 9.4607304725808e15}
#: A results file's JSON ends where its first array starts, with this byte.
ARRAY_START = b"\x93NUMPY"


class Units:
    """What units mean between one source and lens."""

    def __init__(self, z_source: float, z_lens: float, mass: float):
        self.z_source, self.mass, self.theta_e = z_source, mass, cosmology.theta_e(z_source, z_lens)

    def angle(self, value: float, unit: str) -> float:
        """In Einstein angles."""
        if unit in ("", "theta_E", "xi", "eta", None):
            return float(value)
        if unit == "r_g":
            return value * cosmology.gravitational_radius(self.mass, self.z_source) / self.theta_e
        if unit in ANGLES:
            return value * ANGLES[unit] / self.theta_e
        if unit in LENGTHS:
            return value * LENGTHS[unit] / cosmology.angular_diameter_distance(self.z_source) / self.theta_e
        raise ValueError(f"no unit {unit}")

    def quantity(self, q: dict) -> float:
        return self.angle(q["values"], q.get("unit", ""))

    def vector(self, v: dict) -> Vec:
        return Vec(self.angle(v["x"], v.get("unit", "")), self.angle(v["y"], v.get("unit", "")))


def angle_column(value: Column, unit: Column, z_source: Column, z_lens: Column, mass: Column, known=None) -> Column:
    """Units.angle() of columns: in Einstein angles of a solar mass. Null for a unit that isn't known. known: as cosmology's."""
    theta = cosmology.theta_e_column(z_source, z_lens, F.lit(1.0), known)
    far = known[1] if known else cosmology.distance_column(z_source)
    size = F.create_map(*[F.lit(x) for u in ANGLES.items() for x in u])[unit]
    length = F.create_map(*[F.lit(x) for u in LENGTHS.items() for x in u])[unit]
    out = F.when(unit.isNull() | unit.isin("", "theta_E", "xi", "eta"), value.cast("double"))
    out = out.when(unit == "r_g", value * cosmology.gravitational_radius_column(mass, z_source, far) / theta)
    return out.otherwise(F.coalesce(value * size / theta, value * length / far / theta))


def _polar(d: dict) -> Polar:
    return Polar(d["magnitude"]["values"], math.radians(d.get("direction", 0.0)))


def _lens(d: dict) -> LensModel:
    speed = d["velocity_dispersion"]
    return LensModel(d["redshift"], speed["values"] * (1000 if speed.get("unit", "").replace(" ", "") in ("km/s", "kms-1") else 1), _polar(d["shear"]), _polar(d["ellipticity"]))


def _start(d: dict):
    mass = d["source"]["mass"]["values"]
    units = Units(d["source"]["redshift"], d["lens"]["redshift"], mass)
    return units, SourceModel(d["source"]["redshift"], mass, units.quantity(d["source"]["radius"])), _lens(d["lens"])


def micro_parameters(d: dict, **more) -> MicroParameters:
    """Of the parameters of a .sim, .mp or .anim document. more: convergence, shear, window_buffer."""
    units, source, lens = _start(d)
    g = d["star_generator"]
    conversions = g.get("conversions") or ()
    conversions = conversions.items() if isinstance(conversions, dict) else conversions
    stars = StarField(g["seed"], tuple(g.get("mass_limits") or ()), tuple(g.get("powers") or ()), tuple((float(a), float(b)) for a, b in conversions), g.get("type") or "")
    plane, n = d["source_plane"], d["ray_count"]
    box = Box(units.vector(plane["center"]), units.vector(plane["dims"]))
    return MicroParameters(source, lens, d["percent_stars"], units.vector(d["image_center"]), (int(n["x"]), int(n["y"])), box, stars, **more)


def macro_parameters(d: dict) -> MacroParameters:
    units, source, lens = _start(d)
    r = d["ray_region"]
    return MacroParameters(source, lens, Box(units.vector(r["center"]), units.vector(r["dims"]), int(r["resolution"]["x"]), int(r["resolution"]["y"])))


def simulation(d: dict, overrides: dict | None = None, **more) -> Simulation:
    """Of a .sim document. Its variation is a script and is never run: what trials change is declared in overrides."""
    p, results = micro_parameters(d["parameters"], **more), {}
    for kind, name in (("magmap", "magmap_resolution"), ("causticmap", "caustic_resolution"), ("momentmap", "momentmap_resolution")):
        if own := (d.get("results") or {}).get(kind):
            results[kind] = {"nx": int(own[name]["x"]), "ny": int(own[name]["y"])}
    if own := (d.get("results") or {}).get("lightcurves"):
        units = _start(d["parameters"])[0]
        unit = own["sample_density"].get("unit", "").replace(" ", "").removeprefix("1/")
        results["lightcurves"] = {"seed": own["seed"], "num_curves": own["num_curves"], "step": units.angle(1 / own["sample_density"]["values"], unit)}
    return Simulation(d["name"], p, results, d["trial_count"], d.get("description", ""), overrides or {})


def animation(d: dict) -> Animation:
    units = _start(d["parameters"])[0]
    return Animation(micro_parameters(d["parameters"]), units.vector(d["start_position"]), units.vector(d["quasar_velocity"]))


READERS = {".sim": simulation, ".mp": micro_parameters, ".param": macro_parameters, ".anim": animation}


def open_parameters(spark: SparkSession, path: str):
    """What a document describes, by its ending."""
    for ending, reader in READERS.items():
        if path.endswith(ending):
            return reader(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    raise ValueError(f"{path} is no parameter document: {', '.join(READERS)}")


def read_results_file(spark: SparkSession, path: str) -> DataFrame:
    """trial, result, row, column, value of a file of a JSON head, a table of places (counted from its own end) and arrays.

    Pickled arrays are refused. A file is one task's work; read_one_result() reads one array of a large one.
    """

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                file = io.BytesIO(content)
                file.seek(content.index(ARRAY_START))
                table = np.lib.format.read_array(file, allow_pickle=False)
                first = file.tell()
                for (trial, result), at in np.ndenumerate(np.atleast_2d(table)):
                    file.seek(first + int(at))
                    a = np.atleast_2d(np.lib.format.read_array(file, allow_pickle=False)).astype(float)
                    a = a.reshape(-1, a.shape[-1])
                    r, c = np.indices(a.shape)
                    yield pd.DataFrame({"trial": trial, "result": result, "row": r.ravel(), "column": c.ravel(), "value": a.ravel()})

    share_code(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "trial int, result int, row int, column int, value double")


def results_head(content: bytes) -> dict:
    """The JSON head of such a file."""
    end = content.find(ARRAY_START)
    return json.loads(content[: end if end >= 0 else len(content)].decode())


#: Bytes copied at a time.
COPY_BYTES = 4 << 20


def _array_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, a, allow_pickle=False)
    return out.getvalue()


def write_results_file(spark: SparkSession, path: str, head: dict, results: list[list]) -> None:
    """A results file: head as JSON, a table of places by trial and result, and the arrays.

    results: of each trial its arrays, or functions that make them, each called once. Every trial has as many. Places count from
    the table's end, and are known when all arrays are made, so these go to a file beside it first and are copied behind the
    table; the driver holds one at a time.
    """
    fs, where = file_system(spark, path)
    _, beside = file_system(spark, f"{path}.part")
    places, at = [], 0
    part = fs.create(beside, True)
    try:
        for trial in results:
            places.append([])
            for a in trial:
                made = _array_bytes(np.asarray(a() if callable(a) else a, float))
                part.write(made)
                places[-1].append(at)
                at += len(made)
    finally:
        part.close()
    table = np.array(places, np.int64).reshape(len(results), len(results[0]) if results else 0)
    out, part = fs.create(where, True), fs.open(beside)
    try:
        out.write(json.dumps(head).encode() + _array_bytes(table))
        while more := bytes(part.readNBytes(COPY_BYTES)):
            out.write(more)
    finally:
        part.close()
        out.close()
    fs.delete(beside, False)


def read_one_result(spark: SparkSession, path: str, trial: int, result: int) -> np.ndarray:
    """One array of a results file: its head, its table and the array's own bytes are read, nothing else."""
    fs, where = file_system(spark, path)
    file = fs.open(where)
    try:

        def array_at(at: int) -> tuple[np.ndarray, int]:
            file.seek(at)
            start = bytes(file.readNBytes(10))
            size = 10 + int.from_bytes(start[8:10], "little")
            file.seek(at)
            form = io.BytesIO(bytes(file.readNBytes(size)))
            np.lib.format.read_magic(form)
            shape, _, kind = np.lib.format.read_array_header_1_0(form)
            if kind.hasobject:
                raise ValueError("pickled arrays are refused")
            n = int(np.prod(shape)) * kind.itemsize
            return np.lib.format.read_array(io.BytesIO(form.getvalue() + bytes(file.readNBytes(n))), allow_pickle=False), at + size + n

        text, at = b"", 0
        while (end := text.find(ARRAY_START)) < 0:
            more = bytes(file.readNBytes(1 << 16))
            if not more:
                raise ValueError(f"{path} is no results file")
            text += more
        table, first = array_at(end)
        return array_at(first + int(np.atleast_2d(table)[trial, result]))[0]
    finally:
        file.close()
