"""Simulations: trials with declared overrides, reuse of traced rays, and a result store in Parquet."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Animation, Box, LensModel, MicroParameters, Polar, Simulation, SourceModel, StarField, Vec
from ..operators.products import caustic_map, light_curves, magnification_map, moment_map, radius_maps, radius_moments
from ..operators.series import with_distance
from ..operators.spatial import connecting_rays
from ..operators.trace import micro_trace
from ..sources.lattice import ray_lattice
from ..sources.lines import clip_lines, interpolate_lines, random_lines
from ..sources.ray_store import RayStore, has_rays, write_rays
from ..sources.stars import star_field

KINDS = ("magmap", "momentmap", "causticmap", "lightcurves")


def overridden(p: MicroParameters, changes: dict) -> MicroParameters:
    """Parameters with fields replaced by dotted name, as {"source.radius": 0.2}; unknown names are errors, code is never run."""
    for name, value in changes.items():
        head, _, rest = name.partition(".")
        if head not in {f.name for f in fields(p)}:
            raise ValueError(f"no parameter {name}")
        old = getattr(p, head)
        p = replace(p, **{head: overridden(old, {rest: value}) if rest and is_dataclass(old) else value})
    return p


def trial_parameters(sim: Simulation, trial: int) -> MicroParameters:
    if not 0 <= trial < sim.trial_count:
        raise IndexError(f"the simulation has {sim.trial_count} trials")
    return overridden(sim.parameters, sim.overrides.get(trial, {}))


class Engine:
    """Traces rays once for all trials that share what they depend on (all but the source's radius and mass).

    index: a folder that all executors see. Traced rays are kept there by their parameters' fingerprint, as a RayStore, for
    later sessions too: a map or a set of curves reads only files that may hold its rays, and a lost executor costs no
    trace. Without it rays are kept in memory.
    """

    def __init__(self, spark: SparkSession, strategy: str = "kernel", index: str | None = None, index_files: int = 200):
        self.spark, self.strategy, self.index, self.index_files = spark, strategy, index, index_files
        self._print: str | None = None
        self._rays: DataFrame | None = None
        self._store: RayStore | None = None

    def stars(self, p: MicroParameters) -> DataFrame:
        """The star field: its mass is the convergence in stars over the starry disk, in Einstein units."""
        disk = p.starry_region
        return star_field(self.spark, p.stars, disk, p.split[1] * disk.area / 3.141592653589793)

    def rays(self, p: MicroParameters) -> DataFrame:
        """All rays of the parameters, traced if they aren't there yet."""
        own = p.ray_print()
        if own != self._print:
            self.close()
            smooth, _, shear = p.split
            w, h = p.ray_count
            step = p.ray_region.step
            lattice = ray_lattice(self.spark, w, h, step.x, step.y)
            traced = lambda: micro_trace(lattice, self.stars(p), smooth, shear, True, self.strategy)
            if self.index:
                path = f"{self.index.rstrip('/')}/rays={own}"
                self._store = RayStore(self.spark, path) if has_rays(self.spark, path) else write_rays(traced(), path, p.source_plane, self.index_files)
            else:
                self._rays = traced().persist()
            self._print = own
        return self._store.all() if self._store else self._rays

    def rays_inside(self, p: MicroParameters, box: Box, r: float) -> DataFrame:
        """Rays that may end within r of a box; of a store only files that may hold one are read."""
        rays = self.rays(p)
        return self._store.inside(box, r) if self._store else rays

    def rays_near(self, p: MicroParameters, points: DataFrame, r: float) -> DataFrame:
        """The same for points (qx, qy)."""
        rays = self.rays(p)
        return self._store.near(points, r) if self._store else rays

    def result(self, p: MicroParameters, kind: str, settings: dict) -> DataFrame:
        """One result as a table of the store: px, py, moment_index, value, or line_id, sample_idx, x, y, distance, value."""
        plane, r = p.source_plane, p.source.radius
        if kind == "lightcurves":
            lines = random_lines(self.spark, plane, settings["num_curves"], settings["seed"])
            points = interpolate_lines(clip_lines(lines, plane), settings["step"])
            curves = with_distance(light_curves(self.rays_near(p, points, r), points, r, p.raw_brightness), ("line_id",))
            return curves.select("line_id", "sample_idx", "x", "y", "distance", F.col("magnification").alias("value"))
        box = Box(plane.center, plane.dims, settings["nx"], settings["ny"])
        rays = self.rays_inside(p, box, 0.0 if kind == "causticmap" else r)
        if kind == "magmap":
            return magnification_map(rays, box, r, p.raw_brightness).withColumn("moment_index", F.lit(0)).select("px", "py", "moment_index", "value")
        if kind == "momentmap":
            return moment_map(rays, box, r)
        if kind == "causticmap":
            return caustic_map(rays, box).withColumn("moment_index", F.lit(0)).select("px", "py", "moment_index", "value")
        raise ValueError(f"no result {kind}")

    def radius_result(self, trials: dict[int, MicroParameters], kind: str, settings: dict) -> DataFrame:
        """As result(), with a trial column, for trials whose parameters differ in the source's radius only: one pass over the rays."""
        numbers, ps = list(trials), list(trials.values())
        p, radii = ps[0], [x.source.radius for x in ps]
        box = Box(p.source_plane.center, p.source_plane.dims, settings["nx"], settings["ny"])
        rays = self.rays_inside(p, box, max(radii))
        if kind == "magmap":
            out = radius_maps(rays, box, radii, [x.raw_brightness for x in ps]).withColumn("moment_index", F.lit(0))
        elif kind == "momentmap":
            out = radius_moments(rays, box, radii)
        else:
            raise ValueError(f"{kind} is made trial by trial")
        number = F.get(F.array(*[F.lit(n) for n in numbers]), F.col("trial"))
        return out.select(number.alias("trial"), "px", "py", "moment_index", "value")

    def frame(self, a: Animation, t: float) -> DataFrame:
        """Rays that the source of an animation lights at a time."""
        at, r = a.position(t), a.parameters.source.radius
        return connecting_rays(self.rays_inside(a.parameters, Box(at, Vec(0.0, 0.0)), r), at.x, at.y, r)

    def close(self) -> None:
        if self._rays is not None:
            self._rays.unpersist()
        self._rays, self._store, self._print = None, None, None


def radius_groups(sim: Simulation) -> list[dict[int, MicroParameters]]:
    """Trials by what they share besides the source's radius, in order of their first."""
    groups: list[tuple[MicroParameters, dict[int, MicroParameters]]] = []
    for trial in range(sim.trial_count):
        p = trial_parameters(sim, trial)
        common = replace(p, source=replace(p.source, radius=0.0))
        own = next((g for c, g in groups if c == common), None)
        if own is None:
            groups.append((common, own := {}))
        own[trial] = p
    return [g for _, g in groups]


def run_simulation(spark: SparkSession, sim: Simulation, path: str, strategy: str = "kernel", index: str | None = None) -> None:
    """Writes every trial's results below path, as kind=<kind>/trial=<i> in Parquet, and a manifest in JSON.

    Trials that differ in the source's radius only have their maps made together, from one pass over the rays. index: a folder
    that keeps traced rays for later runs, see Engine.
    """
    engine = Engine(spark, strategy, index)
    for group in radius_groups(sim):
        for kind in sorted(sim.results, reverse=True):
            if kind in ("magmap", "momentmap") and len(group) > 1:
                rows = engine.radius_result(group, kind, sim.results[kind])
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trial").parquet(f"{path}/kind={kind}")
                continue
            for trial, p in group.items():
                engine.result(p, kind, sim.results[kind]).write.mode("overwrite").parquet(f"{path}/kind={kind}/trial={trial}")
    engine.close()
    spark.createDataFrame([(json.dumps(asdict(sim)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_simulation(spark: SparkSession, path: str) -> Simulation:
    return simulation_of(json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0]))


def simulation_of(d: dict) -> Simulation:
    """A Simulation of the dictionary that a manifest holds."""
    vec, polar = lambda v: Vec(**v), lambda v: Polar(**v)
    p = d["parameters"]
    lens = LensModel(p["lens"]["redshift"], p["lens"]["velocity_dispersion"], polar(p["lens"]["shear"]), polar(p["lens"]["ellipticity"]))
    plane = p["source_plane"]
    stars = StarField(**{**p["stars"], "mass_limits": tuple(p["stars"]["mass_limits"]), "powers": tuple(p["stars"]["powers"]), "conversions": tuple(map(tuple, p["stars"]["conversions"]))})
    micro = MicroParameters(
        SourceModel(**p["source"]), lens, p["percent_stars"], vec(p["image_center"]), tuple(p["ray_count"]),
        Box(vec(plane["center"]), vec(plane["dims"]), plane["nx"], plane["ny"]), stars, p["convergence"], p["shear"], p["window_buffer"],
    )
    return Simulation(d["name"], micro, d["results"], d["trial_count"], d["description"], {int(k): v for k, v in d["overrides"].items()})


def load_result(spark: SparkSession, path: str, kind: str, trial: int | None = None) -> DataFrame:
    """One kind of result, of one trial or all; only that trial's files are read. A kind that wasn't asked for is an error."""
    sim = load_simulation(spark, path)
    if kind not in sim.results:
        raise KeyError(f"{path} has no {kind}; it has {', '.join(sorted(sim.results))}")
    if trial is not None:
        trial_parameters(sim, trial)
    rows = spark.read.option("basePath", f"{path}/kind={kind}").parquet(f"{path}/kind={kind}")
    return rows if trial is None else rows.where(F.col("trial") == trial)


def describe(spark: SparkSession, path: str) -> str:
    sim = load_simulation(spark, path)
    return f"{sim.name}: {sim.description}\n{sim.trial_count} trials of {', '.join(sorted(sim.results))}"
