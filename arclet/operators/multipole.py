"""Fields of very many point masses at very many places: far cells of stars by multipoles, near ones star by star.

In complex numbers the deflection at z is the conjugate of f(z), the sum of m / (z - s) over stars s; its derivative gives the
Jacobian. A cell of stars about c has moments M_k, the sums of m (s - c) ** k; all cells that are far from a tile of places
about t add to one Taylor series about t,

    b_l = (-1) ** l sum over cells and k of C(k + l, l) M_k / (t - c) ** (k + l + 1),

so that a place costs the TERMS of one series and the stars of the cells near it, whatever the number of stars.

A cell is far if the radii of cell and tile are RATIO of their distance at most. What TERMS terms leave out of f is then at most
2 RATIO ** TERMS / (1 - RATIO) ** 2 of the sum of m / |t - c| over far cells: 2e-9 of it for the values here.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
from pyspark.sql import DataFrame

from ..plans.session import share_code

TERMS = 32
RATIO = 0.5
#: Stars in a cell, about.
STARS_A_CELL = 32
#: Places times near stars that a worker holds at once, and far cells times terms.
TILE = 1 << 20
#: Of a series' term l, what a cell's moment k adds.
_BINOMIAL = np.array([[(-1.0) ** j * comb(k + j, j) for j in range(TERMS)] for k in range(TERMS)])


@dataclass
class Cells:
    """Stars in the order of their cells. A cell's own: centre, radius, moments scaled by powers of the cells' side."""

    z: np.ndarray
    mass: np.ndarray
    first: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    moments: np.ndarray
    side: float

    @classmethod
    def of(cls, stars: np.ndarray) -> "Cells":
        """stars: rows x, y, mass."""
        z, mass = stars[:, 0] + 1j * stars[:, 1], stars[:, 2]
        wide = max(float(np.ptp(stars[:, 0])), float(np.ptp(stars[:, 1]))) or 1.0
        side = wide / max(1.0, (len(stars) / STARS_A_CELL) ** 0.5)
        place = np.floor((z.real - z.real.min()) / side).astype(np.int64) << 32 | np.floor((z.imag - z.imag.min()) / side).astype(np.int64)
        order = np.argsort(place, kind="stable")
        z, mass, place = z[order], mass[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        own = np.cumsum(np.concatenate(([False], place[1:] != place[:-1])))
        # The middle of the stars' box, so that a cell of few stars is small.
        low = np.minimum.reduceat(z.real, first) + 1j * np.minimum.reduceat(z.imag, first)
        high = np.maximum.reduceat(z.real, first) + 1j * np.maximum.reduceat(z.imag, first)
        centre = (low + high) / 2
        u, moments = (z - centre[own]) / side, np.empty((len(first), TERMS), complex)
        power = mass.astype(complex)
        for k in range(TERMS):
            moments[:, k] = np.add.reduceat(power, first)
            power = power * u
        return cls(z, mass, np.append(first, len(z)), centre, np.maximum.reduceat(np.abs(z - centre[own]), first), moments, side)

    def series(self, t: complex, far: np.ndarray) -> np.ndarray:
        """The Taylor series about t, in units of the side, of the cells marked far."""
        total = np.zeros(TERMS, complex)
        at = np.flatnonzero(far)
        for a in range(0, len(at), max(1, TILE // TERMS)):
            own = at[a : a + max(1, TILE // TERMS)]
            v = (self.side / (t - self.centre[own]))[:, None]
            powers = v ** np.arange(TERMS)
            total += (((self.moments[own] * powers) @ _BINOMIAL) * (powers * v)).sum(axis=0)
        return total / self.side

    def field(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """f and its derivative at places; not a number at a star's place."""
        f, d = np.zeros(len(z), complex), np.zeros(len(z), complex)
        tile = np.floor(z.real / self.side).astype(np.int64) << 32 ^ np.floor(z.imag / self.side).astype(np.int64)
        order = np.argsort(tile, kind="stable")
        cuts = np.flatnonzero(np.diff(tile[order])) + 1
        for at in np.split(order, cuts):
            own = z[at]
            t = (own.real.min() + own.real.max()) / 2 + 0.5j * (own.imag.min() + own.imag.max())
            gap = np.abs(self.centre - t)
            far = (self.radius + np.abs(own - t).max()) <= RATIO * gap
            far &= gap > 0
            near = np.flatnonzero(~far)
            if far.any():
                series = self.series(t, far)
                u = (own - t) / self.side
                f[at] = np.polynomial.polynomial.polyval(u, series)
                d[at] = np.polynomial.polynomial.polyval(u, series[1:] * np.arange(1, TERMS)) / self.side
            stars = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in near]) if near.size else np.zeros(0, np.int64)
            for a in range(0, len(stars), max(1, TILE // len(own))):
                some = stars[a : a + max(1, TILE // len(own))]
                with np.errstate(divide="ignore", invalid="ignore"):
                    inverse = 1 / (own[:, None] - self.z[some])
                    f[at] += inverse @ self.mass[some]
                    d[at] -= (inverse * inverse) @ self.mass[some]
        return f, d


def star_fields(places: DataFrame, blocks: list) -> DataFrame:
    """places (x, y, ...) with ax, ay, p and c, the sums over stars that the lens equation needs; blocks: broadcast arrays of
    stars, see trace.star_blocks(). Places are read once and not shuffled; those of one batch that lie close share their series."""
    share_code(places.sparkSession)

    def run(batches):
        cells = None
        for pdf in batches:
            cells = cells or [Cells.of(b.value) for b in blocks]
            z = pdf["x"].to_numpy() + 1j * pdf["y"].to_numpy()
            f, d = np.zeros(len(z), complex), np.zeros(len(z), complex)
            for block in cells:
                more = block.field(z)
                f, d = f + more[0], d + more[1]
            yield pdf.assign(ax=f.real, ay=-f.imag, p=d.real, c=d.imag)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema], "ax double, ay double, p double, c double"])
    return places.mapInPandas(run, schema)
