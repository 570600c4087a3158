"""Row and document types, and the small values that parameters are made of. Lengths are in the Einstein angle unless a unit says otherwise."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

STAR = T.StructType([T.StructField("star_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "mass")]])
RAY = T.StructType([T.StructField("ray_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "bx", "by")], T.StructField("parity", T.ByteType())])
POINT = T.StructType([T.StructField("curve_id", T.LongType()), T.StructField("sample_idx", T.IntegerType()), T.StructField("qx", T.DoubleType()), T.StructField("qy", T.DoubleType())])

_QUANTITY = "STRUCT<values: DOUBLE, unit: STRING>"
_VECTOR = "STRUCT<x: DOUBLE, y: DOUBLE, unit: STRING>"
_COUNT = "STRUCT<x: BIGINT, y: BIGINT, unit: STRING>"
_POLAR = f"STRUCT<magnitude: {_QUANTITY}, direction: DOUBLE>"
LENS = f"STRUCT<ellipticity: {_POLAR}, shear: {_POLAR}, velocity_dispersion: {_QUANTITY}, redshift: DOUBLE>"
SOURCE = f"STRUCT<redshift: DOUBLE, mass: {_QUANTITY}, radius: {_QUANTITY}>"
STAR_GENERATOR = (
    "STRUCT<seed: BIGINT, type: STRING, mass_limits: ARRAY<DOUBLE>, powers: ARRAY<DOUBLE>, conversions: ARRAY<ARRAY<DOUBLE>>, "
    f"mean_velocity: {_QUANTITY}, stderr_velocity: {_QUANTITY}, dt: {_QUANTITY}>"
)
REGION = f"STRUCT<center: {_VECTOR}, dims: {_VECTOR}>"
_MICRO = {
    "lens": LENS, "source": SOURCE, "star_generator": STAR_GENERATOR, "percent_stars": "DOUBLE", "source_plane": REGION, "image_center": _VECTOR, "ray_count": _COUNT,
}
MICRO = "STRUCT<" + ", ".join(f"{k}: {v}" for k, v in _MICRO.items()) + ">"
RESULTS = (
    f"STRUCT<magmap: STRUCT<magmap_resolution: {_COUNT}>, causticmap: STRUCT<caustic_resolution: {_COUNT}>, "
    f"momentmap: STRUCT<momentmap_resolution: {_COUNT}>, lightcurves: STRUCT<seed: BIGINT, num_curves: INT, sample_density: {_QUANTITY}>>"
)
#: Schemas of the documents by file name ending.
DOCUMENTS = {
    ".sim": f"name STRING, description STRING, trial_count INT, parameters {MICRO}, results {RESULTS}",
    ".mp": ", ".join(f"{k} {v}" for k, v in _MICRO.items()),
    ".param": f"lens {LENS}, source {SOURCE}, ray_region STRUCT<center: {_VECTOR}, dims: {_VECTOR}, resolution: {_COUNT}>",
    ".anim": f"parameters {MICRO}, start_position {_VECTOR}, quasar_velocity {_VECTOR}",
}


@dataclass(frozen=True)
class Vec:
    """A plane vector; operations are by component."""

    x: float
    y: float
    unit: str = "theta_E"

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: a / b)

    def _with(self, o, f):
        ox, oy = (o.x, o.y) if isinstance(o, Vec) else (o, o)
        return Vec(f(self.x, ox), f(self.y, oy), self.unit)

    @property
    def magnitude(self) -> float:
        return math.hypot(self.x, self.y)

    @property
    def direction(self) -> "Vec":
        return self / self.magnitude

    def to(self, unit: str, size: float) -> "Vec":
        """In another unit, one of which is size of this one's."""
        return Vec(self.x / size, self.y / size, unit)


@dataclass(frozen=True)
class Polar:
    """A vector by length and angle in radians; documents hold degrees."""

    magnitude: float
    direction: float = 0.0

    @property
    def cartesian(self) -> Vec:
        return Vec(self.magnitude * math.cos(self.direction), self.magnitude * math.sin(self.direction), "")

    def document(self) -> dict:
        return {"magnitude": {"values": self.magnitude, "unit": ""}, "direction": math.degrees(self.direction)}


@dataclass(frozen=True)
class Box:
    """A rectangle; with resolution, a grid of pixels over it."""

    center: Vec
    dims: Vec
    nx: int = 0
    ny: int = 0

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """x0, y0, x1, y1."""
        c, d = self.center, self.dims
        return c.x - d.x / 2, c.y - d.y / 2, c.x + d.x / 2, c.y + d.y / 2

    @property
    def area(self) -> float:
        return self.dims.x * self.dims.y

    @property
    def step(self) -> Vec:
        return Vec(self.dims.x / self.nx, self.dims.y / self.ny, self.dims.unit)


@dataclass(frozen=True)
class Disk:
    center: Vec
    radius: float

    @property
    def area(self) -> float:
        return math.pi * self.radius**2


@dataclass(frozen=True)
class LensModel:
    redshift: float
    velocity_dispersion: float
    shear: Polar
    ellipticity: Polar


@dataclass(frozen=True)
class SourceModel:
    """mass in solar masses, radius in the Einstein angle."""

    redshift: float
    mass: float
    radius: float


@dataclass(frozen=True)
class StarField:
    """How stars are drawn; conversions: pairs (least mass, mass of what it has become)."""

    seed: int
    mass_limits: tuple[float, ...] = ()
    powers: tuple[float, ...] = ()
    conversions: tuple[tuple[float, float], ...] = ()
    name: str = ""


@dataclass(frozen=True)
class MicroParameters:
    """One trial's parameters. convergence and shear are those at the image; percent_stars splits the convergence."""

    source: SourceModel
    lens: LensModel
    percent_stars: float
    image_center: Vec
    ray_count: tuple[int, int]
    source_plane: Box
    stars: StarField
    convergence: float = 0.7
    shear: float = 0.7
    window_buffer: float = 1.0

    @property
    def split(self) -> tuple[float, float, float]:
        """Smooth convergence, convergence in stars, shear."""
        part = self.percent_stars / 100
        return self.convergence * (1 - part), self.convergence * part, self.shear

    @property
    def ray_region(self) -> Box:
        """The part of the lens plane that covers the source plane: wider by the axis ratio of the smooth lens."""
        ratio = abs(1 - self.shear - self.convergence) / abs(1 + self.shear - self.convergence)
        d = self.source_plane.dims
        return Box(self.image_center, Vec(d.x / ratio, d.y, d.unit) * self.window_buffer, *self.ray_count)

    @property
    def starry_region(self) -> Disk:
        return Disk(Vec(0, 0), self.ray_region.dims.x * 0.6)

    @property
    def magnification(self) -> float:
        return abs(1 / ((1 - self.convergence) ** 2 - self.shear**2))

    @property
    def raw_brightness(self) -> float:
        """Rays that would hit the source without stars."""
        step = self.ray_region.step
        return math.pi * self.source.radius**2 / (step.x * step.y) * self.magnification

    def ray_print(self) -> str:
        """A fingerprint of all that the traced rays depend on; the source's radius and mass are not part of it."""
        own = asdict(self)
        own["source"] = own["source"]["redshift"]
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Simulation:
    """results: settings by kind, of magmap, causticmap, momentmap (nx, ny) and lightcurves (seed, num_curves, step).

    overrides: by trial number, fields of the parameters (source.radius and the like) that differ there.
    """

    name: str
    parameters: MicroParameters
    results: dict
    trial_count: int = 1
    description: str = ""
    overrides: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Animation:
    parameters: MicroParameters
    start: Vec
    velocity: Vec

    def position(self, t: float) -> Vec:
        return self.start + self.velocity * t


@dataclass(frozen=True)
class MacroParameters:
    """A whole lens: rays over a region of the sky, without single stars."""

    source: SourceModel
    lens: LensModel
    ray_region: Box

    @property
    def raw_brightness(self) -> float:
        return 1.0

    def to_micro(self, percent_stars: float, image_center: Vec, minor_axis: float, stars: StarField, **more) -> MicroParameters:
        """The field about one image: a square source plane of that side, with as many rays."""
        plane = Box(Vec(0, 0), Vec(minor_axis, minor_axis))
        return MicroParameters(self.source, self.lens, percent_stars, image_center, (self.ray_region.nx, self.ray_region.ny), plane, stars, **more)


def macro_of(p: MicroParameters, einstein_radius: float, pixels: tuple[int, int] = (2000, 2000)) -> MacroParameters:
    """The whole lens of a field: two Einstein radii wide, about the origin."""
    return MacroParameters(p.source, p.lens, Box(Vec(0, 0), Vec(2 * einstein_radius, 2 * einstein_radius), *pixels))


def similar(a: MicroParameters, b: MicroParameters) -> bool:
    """Whether rays traced for one serve the other."""
    return a.ray_print() == b.ray_print()
