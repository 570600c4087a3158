"""Broken power laws of stellar masses: densities, integrals, sampling and clusters, in numpy and as Spark columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Break masses and slopes of the named mass functions.
NAMED = {
    "Salpeter_1955": ((0.4, 10.0), (-2.3,)),
    "Miller_Scalo_1979": ((0.1, 1.0, 10.0, math.inf), (-1.4, -2.5, -3.3)),
    "Kennicutt_1983": ((0.1, 1.0, math.inf), (-1.4, -2.5)),
    "Kroupa_2001": ((0.01, 0.08, 0.5, 1.0, math.inf), (-0.3, -1.3, -2.3, -2.3)),
    "Kroupa_2001_Modified": ((0.08, 0.5, 1.5), (-1.3, -2.7)),
    "Weidner_Kroupa_2004": ((0.01, 0.08, 0.5, 1.0, math.inf), (-0.3, -1.3, -2.3, -2.35)),
}
# Stars from this mass on have become remnants of that mass.
REMNANTS = ((0.8, 0.6), (8.0, 1.4), (30.0, 10.0))
#: Halvings of the interval that holds a largest star.
BISECTIONS = 60


def power_integral(m, power: float):
    """The antiderivative of m ** power."""
    m = np.asarray(m, float)
    return np.log(m) if power == -1 else m ** (power + 1) / (power + 1)


def power_integral_inverse(y, power: float):
    y = np.asarray(y, float)
    return np.exp(y) if power == -1 else (y * (power + 1)) ** (1 / (power + 1))


class PowerLaw:
    """A density k * c_i * m ** p_i on segments between limits, continuous at the breaks and 0 outside."""

    def __init__(self, limits, powers):
        self.limits = np.array(limits, float)
        self.powers = np.array(powers, float)
        self.k = 1.0
        coeffs = [1.0]
        for i in range(1, len(self.powers)):
            coeffs.append(coeffs[-1] * self.limits[i] ** (self.powers[i - 1] - self.powers[i]))
        self.coeffs = np.array(coeffs)

    @classmethod
    def named(cls, name: str) -> "PowerLaw":
        if name not in NAMED:
            raise ValueError(f"no mass function {name}; there are {', '.join(NAMED)}")
        return cls(*NAMED[name])

    def _segment(self, m):
        return np.clip(np.searchsorted(self.limits, m, side="right") - 1, 0, len(self.powers) - 1)

    def density(self, m, weight: int = 0):
        """The density at m, times m ** weight."""
        m = np.asarray(m, float)
        i = self._segment(m)
        inside = (m >= self.limits[0]) & (m <= self.limits[-1])
        return np.where(inside, self.k * self.coeffs[i] * m ** (self.powers[i] + weight), 0.0)

    def integral(self, low: float, high: float, weight: int = 0) -> float:
        """Of the density times m ** weight between two masses."""
        total = 0.0
        for c, p, a, b in zip(self.coeffs, self.powers, self.limits[:-1], self.limits[1:]):
            a, b = max(a, low), min(b, high)
            if b > a:
                total += c * float(power_integral(b, p + weight) - power_integral(a, p + weight))
        return self.k * total

    def normalized(self, total: float, low: float | None = None, high: float | None = None) -> "PowerLaw":
        """For a total mass between two masses, none above the total."""
        out = PowerLaw(self.limits, self.powers)
        low = max(self.limits[0], low if low is not None else self.limits[0])
        high = min(self.limits[-1], total, high if high is not None else math.inf)
        out.k = total / out.integral(low, high, 1)
        return out

    def truncated(self, total: float) -> "PowerLaw":
        """The density of a cluster of that total mass: normalised, and 0 above its largest star."""
        top = self.largest_star(total)
        out = self.normalized(total, high=top)
        inside = int(np.searchsorted(out.limits, top, side="left"))
        cut = PowerLaw(np.append(out.limits[:inside], top), out.powers[: max(inside, 1)])
        cut.k = out.k
        return cut

    def largest_star(self, total: float) -> float:
        """The mass of the largest star of a cluster of that total mass: above it lies one star, and below it the total.

        So the mass up to it over the number of stars from it to the largest possible one, which no star of the cluster
        passes, is the total; that quotient grows with it, and bisection finds it.
        """
        one = PowerLaw(self.limits, self.powers)
        low, high = self.limits[0], min(self.limits[-1], total)
        a, c = low, high
        for _ in range(BISECTIONS):
            b = (a + c) / 2
            a, c = (b, c) if one.integral(low, b, 1) < total * one.integral(b, high) else (a, b)
        return (a + c) / 2

    def sample(self, u, top: float | None = None):
        """Masses for uniform numbers in [0, 1), by inverting the cumulative number up to top."""
        top = min(self.limits[-1], top if top is not None else math.inf)
        ends = np.minimum(self.limits, top)
        mass = [c * float(power_integral(b, p) - power_integral(a, p)) if b > a else 0.0 for c, p, a, b in zip(self.coeffs, self.powers, ends[:-1], ends[1:])]
        cum = np.concatenate(([0.0], np.cumsum(mass)))
        x = np.asarray(u, float) * cum[-1]
        i = np.clip(np.searchsorted(cum, x, side="right") - 1, 0, len(self.powers) - 1)
        out = np.empty(x.shape)
        for s in range(len(self.powers)):
            own = i == s
            out[own] = power_integral_inverse((x[own] - cum[s]) / self.coeffs[s] + power_integral(ends[s], self.powers[s]), self.powers[s])
        return out

    def cluster(self, total: float, rng: np.random.RandomState, remnants=()) -> np.ndarray:
        """Masses that sum to the total as nearly as whole stars can; remnants: see evolved()."""
        if remnants:
            parts, have = [], 0.0
            while total - have > 3.0:
                part = evolved(self.cluster(total - have, rng), remnants)
                parts.append(part)
                have += part.sum()
            return np.concatenate(parts) if parts else np.zeros(0)
        top = min(self.limits[-1], total)
        expected = self.normalized(total).integral(self.limits[0], top)
        masses, count, have = [], round(expected) * 1.1, 0.0
        while have < total:
            new = self.sample(rng.rand(max(1, int(count))), top)
            masses.append(new)
            have += new.sum()
            count = expected * 0.1
        masses = np.concatenate(masses) if masses else np.zeros(0)
        return masses[: np.abs(np.cumsum(masses) - total).argmin() + 1] if masses.size else masses


def evolved(masses, remnants=REMNANTS):
    """Masses after stars from each remnant's least mass on have become it."""
    masses = np.asarray(masses, float)
    remnants = sorted(remnants.items() if isinstance(remnants, dict) else map(tuple, remnants), key=lambda r: float(r[0]))
    least, became = np.array([float(r[0]) for r in remnants]), np.array([float(r[1]) for r in remnants])
    i = np.searchsorted(least, masses, side="left") - 1
    return np.where(masses < least[0], masses, became[np.maximum(i, 0)])


def density_column(m: Column, law: PowerLaw, weight: int = 0) -> Column:
    """PowerLaw.density as a column."""
    out = F.lit(0.0)
    for c, p, a, b in reversed(list(zip(law.coeffs, law.powers, law.limits[:-1], law.limits[1:]))):
        inside = (m >= float(a)) & (m < float(b)) if b != law.limits[-1] else (m >= float(a)) & (m <= float(b))
        out = F.when(inside, F.lit(float(law.k * c)) * F.pow(m, F.lit(float(p + weight)))).otherwise(out)
    return out


def integral_column(low: Column, high: Column, law: PowerLaw, weight: int = 0) -> Column:
    """PowerLaw.integral as a column of two mass columns."""

    def grown(m, p):
        return F.ln(m) if p == -1 else F.pow(m, F.lit(p + 1)) / F.lit(p + 1)

    total = F.lit(0.0)
    for c, p, a, b in zip(law.coeffs, law.powers, law.limits[:-1], law.limits[1:]):
        lo, hi = F.greatest(low, F.lit(float(a))), F.least(high, F.lit(float(b)))
        total = total + F.when(hi > lo, F.lit(float(c)) * (grown(hi, float(p + weight)) - grown(lo, float(p + weight)))).otherwise(F.lit(0.0))
    return F.lit(float(law.k)) * total


def largest_star_column(total: Column, law: PowerLaw) -> Column:
    """PowerLaw.largest_star as a column of total masses: the interval is halved in an array's fold, row by row."""
    low = float(law.limits[0])
    one = PowerLaw(law.limits, law.powers)

    def halved(s, _):
        b = (s["a"] + s["c"]) / 2
        more = integral_column(F.lit(low), b, one, 1) < s["total"] * integral_column(b, s["high"], one)
        return F.struct(F.when(more, b).otherwise(s["a"]).alias("a"), F.when(more, s["c"]).otherwise(b).alias("c"), s["total"].alias("total"), s["high"].alias("high"))

    high = F.least(F.lit(float(law.limits[-1])), total.cast("double"))
    first = F.struct(F.lit(low).alias("a"), high.alias("c"), total.cast("double").alias("total"), high.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), first, halved, lambda s: (s["a"] + s["c"]) / 2)


def log_normal_column(m: Column, mean: float, sigma: float) -> Column:
    """log_normal() as a column."""
    z = F.log10(m) - F.lit(mean)
    return F.exp(-(z * z) / F.lit(2 * sigma**2)) / m


def step_column(x: Column, closed: bool = False) -> Column:
    """1 above 0, or from 0 on, else 0."""
    return (x >= 0 if closed else x > 0).cast("double")


def error_column(x: Column) -> Column:
    """error() as a column."""
    s = F.lit(WINITZKI) * x * x
    return F.signum(x) * F.sqrt(-F.expm1(-x * x * (F.lit(4 / math.pi) + s) / (F.lit(1.0) + s)))


def log_normal_integral_column(m: Column, mean: float, sigma: float) -> Column:
    """log_normal_integral() as a column, by error_column()."""
    z = (F.log10(m) - F.lit(mean)) / F.lit(math.sqrt(2) * sigma)
    return F.lit(sigma * math.log(10) * math.sqrt(math.pi / 2)) * error_column(z)


def sample_column(u: Column, law: PowerLaw, top: float | Column | None = None) -> Column:
    """PowerLaw.sample as a column of a uniform column; top may be a column too."""
    one = PowerLaw(law.limits, law.powers)
    ends = one.limits if isinstance(top, Column) else np.minimum(one.limits, min(one.limits[-1], top if top is not None else math.inf))
    mass = [c * float(power_integral(b, p) - power_integral(a, p)) if b > a else 0.0 for c, p, a, b in zip(one.coeffs, one.powers, ends[:-1], ends[1:])]
    cum = np.concatenate(([0.0], np.cumsum(mass)))
    x, out = u * (integral_column(F.lit(float(one.limits[0])), top, one) if isinstance(top, Column) else float(cum[-1])), None
    for s in range(len(one.powers)):
        p, y = float(one.powers[s]), (x - float(cum[s])) / float(one.coeffs[s]) + float(power_integral(ends[s], one.powers[s]))
        m = F.exp(y) if p == -1 else F.pow(y * (p + 1), F.lit(1 / (p + 1)))
        out = m if out is None else F.when(x >= float(cum[s]), m).otherwise(out)
    return out


def evolved_column(m: Column, remnants=REMNANTS) -> Column:
    out = m
    for least, became in sorted(remnants):
        out = F.when(m > least if least != min(remnants)[0] else m >= least, F.lit(float(became))).otherwise(out)
    return out


def log_normal(m, mean: float, sigma: float):
    """The log-normal density in log10 m, up to its factor."""
    m = np.asarray(m, float)
    return np.exp(-((np.log10(m) - mean) ** 2) / (2 * sigma**2)) / m


def log_normal_integral(m, mean: float, sigma: float):
    z = (np.log10(np.asarray(m, float)) - mean) / (math.sqrt(2) * sigma)
    return sigma * math.log(10) * math.sqrt(math.pi / 2) * np.vectorize(math.erf)(z)


def step_open(x):
    return (np.asarray(x, float) > 0).astype(float)


def step_closed(x):
    return (np.asarray(x, float) >= 0).astype(float)


def half_at_zero(x):
    """0.5 at 0 and 1 elsewhere."""
    return np.where(np.asarray(x, float) == 0, 0.5, 1.0)


def inside(m, low: float, high: float):
    """1 between two masses, both included, else 0."""
    return step_closed(np.asarray(m, float) - low) * step_closed(high - np.asarray(m, float))


#: Of the elementary approximation of the error function by Winitzki.
WINITZKI = 0.140012288686666


def error(x):
    """The error function, to about four digits, by an expression with an inverse."""
    x = np.asarray(x, float)
    s = WINITZKI * x * x
    return np.sign(x) * np.sqrt(-np.expm1(-x * x * (4 / np.pi + s) / (1 + s)))


def error_inverse(y):
    """The inverse of error(), up to a sign the root of a quadratic in the square."""
    y = np.asarray(y, float)
    log = np.log1p(-y * y)
    middle = 2 / (np.pi * WINITZKI) + log / 2
    return np.sign(y) * np.sqrt(np.sqrt(middle * middle - log / WINITZKI) - middle)
