"""Distances in a flat universe with matter, radiation and a cosmological constant, and the lens scales that follow."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published WMAP five-year cosmology, and physical constants in SI units.
H0 = 70.2
OMEGA_MATTER = 0.277
T_CMB = 2.725
N_EFF = 3.04
C = 299792458.0
G = 6.6743e-11
SOLAR_MASS = 1.988409870698051e30
PARSEC = 3.0856775814913674e16
#: Photons and massless neutrinos, as shares of the critical density.
RADIATION = 2.4728e-5 * (T_CMB / 2.7255) ** 4 / (H0 / 100) ** 2 * (1 + 0.2271 * N_EFF)


def _comoving(z: float, steps: int = 2000) -> float:
    """Line-of-sight distance in metres, by Simpson's rule."""
    x = np.linspace(0.0, z, steps + 1)
    lam = 1 - OMEGA_MATTER - RADIATION
    f = 1 / np.sqrt(OMEGA_MATTER * (1 + x) ** 3 + RADIATION * (1 + x) ** 4 + lam)
    total = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (z / steps) / 3
    return C / (H0 * 1000 / (1e6 * PARSEC)) * total


def angular_diameter_distance(z: float, z_from: float = 0.0) -> float:
    """Metres, from z_from to z."""
    return (_comoving(z) - _comoving(z_from) if z_from else _comoving(z)) / (1 + z)


def theta_e(z_source: float, z_lens: float, mass: float = 1.0) -> float:
    """The Einstein angle of a point of that many solar masses, in radians."""
    d_l, d_s, d_ls = angular_diameter_distance(z_lens), angular_diameter_distance(z_source), angular_diameter_distance(z_source, z_lens)
    return math.sqrt(4 * G * mass * SOLAR_MASS * d_ls / (C**2 * d_l * d_s))


def einstein_radius(velocity_dispersion: float, z_source: float, z_lens: float) -> float:
    """Of an isothermal sphere with that velocity dispersion in m/s, in radians."""
    return 4 * math.pi * velocity_dispersion**2 * angular_diameter_distance(z_source, z_lens) / (angular_diameter_distance(z_source) * C**2)


def critical_density(z_source: float, z_lens: float) -> float:
    """Solar masses per square radian."""
    d_l, d_s, d_ls = angular_diameter_distance(z_lens), angular_diameter_distance(z_source), angular_diameter_distance(z_source, z_lens)
    return C**2 * d_s * d_l / (4 * math.pi * G * d_ls) / SOLAR_MASS


def gravitational_radius(mass: float, z: float) -> float:
    """Of so many solar masses, as an angle at that redshift."""
    return G * mass * SOLAR_MASS / C**2 / angular_diameter_distance(z)


#: Points of the quadrature of distances of columns: 1e-12 of the distance or less up to redshift 10.
NODES = 32
HUBBLE_LENGTH = C / (H0 * 1000 / (1e6 * PARSEC))


def comoving_column(z: Column) -> Column:
    """Line-of-sight distance in metres, by Gauss-Legendre quadrature; null for a null redshift."""
    lam = 1 - OMEGA_MATTER - RADIATION

    def term(x: Column, weight: Column) -> Column:
        a = F.lit(1.0) + z * (F.lit(1.0) + x) / F.lit(2.0)
        return weight / F.sqrt(F.lit(OMEGA_MATTER) * a * a * a + F.lit(RADIATION) * a * a * a * a + F.lit(lam))

    # Over an array: written out for each point, a few distances in one projection are more code than a method may have.
    places, weights = np.polynomial.legendre.leggauss(NODES)
    terms = F.zip_with(F.lit(places.tolist()), F.lit(weights.tolist()), term)
    return F.lit(HUBBLE_LENGTH / 2) * z * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def distance_column(z: Column, z_from: Column | None = None) -> Column:
    """angular_diameter_distance() of columns."""
    far = comoving_column(z)
    return (far if z_from is None else far - comoving_column(z_from)) / (F.lit(1.0) + z)


def with_distances(df: DataFrame, z_source: Column, z_lens: Column) -> DataFrame:
    """df with d_l, d_s, d_ls: to the lens, to the source and between them, by one quadrature for each redshift of a row."""
    far = df.withColumn("_lens", comoving_column(z_lens)).withColumn("_source", comoving_column(z_source))
    d = {"d_l": F.col("_lens") / (F.lit(1.0) + z_lens), "d_s": F.col("_source") / (F.lit(1.0) + z_source), "d_ls": (F.col("_source") - F.col("_lens")) / (F.lit(1.0) + z_source)}
    return far.withColumns(d).drop("_lens", "_source")


def _distances(z_source: Column, z_lens: Column, known) -> tuple[Column, Column, Column]:
    return known or (distance_column(z_lens), distance_column(z_source), distance_column(z_source, z_lens))


def theta_e_column(z_source: Column, z_lens: Column, mass: Column, known=None) -> Column:
    """theta_e() of columns; null unless the source is behind the lens. known: d_l, d_s, d_ls, if there are such columns."""
    d_l, d_s, d_ls = _distances(z_source, z_lens, known)
    return F.when((z_source > z_lens) & (z_lens > 0), F.sqrt(F.lit(4 * G * SOLAR_MASS / C**2) * mass * d_ls / (d_l * d_s)))


def einstein_radius_column(velocity_dispersion: Column, z_source: Column, z_lens: Column, known=None) -> Column:
    """einstein_radius() of columns; null unless the source is behind the lens."""
    _, d_s, d_ls = _distances(z_source, z_lens, known)
    share = d_ls / d_s
    return F.when(z_source > z_lens, F.lit(4 * math.pi / C**2) * velocity_dispersion * velocity_dispersion * share)


def critical_density_column(z_source: Column, z_lens: Column, known=None) -> Column:
    """critical_density() of columns; null unless the source is behind the lens."""
    d_l, d_s, d_ls = _distances(z_source, z_lens, known)
    return F.when((z_source > z_lens) & (z_lens > 0), F.lit(C**2 / (4 * math.pi * G) / SOLAR_MASS) * d_s * d_l / d_ls)


def gravitational_radius_column(mass: Column, z: Column, known: Column | None = None) -> Column:
    """gravitational_radius() of columns; null at redshift 0. known: the distance at that redshift, if there is such a column."""
    return F.when(z > 0, F.lit(G * SOLAR_MASS / C**2) * mass / (distance_column(z) if known is None else known))
