"""Places: grid cells and an equal-area projection."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


@dataclass(frozen=True)
class Grid:
    """Rows from the top (ymax), columns from the left; cells are numbered by row from 1."""

    rows: int
    cols: int
    xmin: float
    xmax: float
    ymin: float
    ymax: float

    @property
    def width(self) -> float:
        return (self.xmax - self.xmin) / self.cols

    @property
    def height(self) -> float:
        return (self.ymax - self.ymin) / self.rows

    @property
    def cell_area(self) -> float:
        return self.width * self.height

    def row_col(self, x, y) -> tuple[Column, Column]:
        """0-based row and column; the outer edge belongs to the last ones, outside is null."""
        x, y = col(x), col(y)
        inside = x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax)
        row = F.least(F.floor((self.ymax - y) / self.height), F.lit(self.rows - 1))
        column = F.least(F.floor((x - self.xmin) / self.width), F.lit(self.cols - 1))
        return F.when(inside, row), F.when(inside, column)

    def cell(self, x, y) -> Column:
        row, column = self.row_col(x, y)
        return (row * self.cols + column + 1).cast("long")

    def center(self, cell) -> tuple[Column, Column]:
        at = col(cell) - 1
        return self.xmin + ((at % self.cols) + 0.5) * self.width, self.ymax - (F.floor(at / self.cols) + 0.5) * self.height


# The GRS 1980 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101


def albers(lon, lat, lon0: float, lat0: float, lat1: float, lat2: float, unit: float = 1000.0) -> tuple[Column, Column]:
    """Ellipsoidal Albers equal-area coordinates (Snyder 1987, equations 14-1 to 14-21)."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    sine = lambda d: math.sin(math.radians(d))
    q_of = lambda s, log: (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * log((1 - e * s) / (1 + e * s)))
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - e2 * sine(d) ** 2)
    q0, q1, q2 = (q_of(sine(d), math.log) for d in (lat0, lat1, lat2))
    n = (m(lat1) ** 2 - m(lat2) ** 2) / (q2 - q1) if lat1 != lat2 else sine(lat1)
    c = m(lat1) ** 2 + n * q1
    rho0 = SEMI_MAJOR * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(col(lat)))
    rho = SEMI_MAJOR * F.sqrt(F.lit(c) - n * q_of(s, F.log)) / n
    theta = n * F.radians(col(lon) - lon0)
    return rho * F.sin(theta) / unit, (F.lit(rho0) - rho * F.cos(theta)) / unit


def albers_inverse(x, y, lon0: float, lat0: float, lat1: float, lat2: float, unit: float = 1000.0, steps: int = 8) -> tuple[Column, Column]:
    """Longitude and latitude of Albers coordinates (Snyder 1987, equations 14-8 to 14-11 and
    3-16); each step of the latitude squares its error, from a few degrees down."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    sine = lambda d: math.sin(math.radians(d))
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - e2 * sine(d) ** 2)
    q0, q1, q2 = (q_of(sine(d)) for d in (lat0, lat1, lat2))
    n = (m(lat1) ** 2 - m(lat2) ** 2) / (q2 - q1) if lat1 != lat2 else sine(lat1)
    c = m(lat1) ** 2 + n * q1
    rho0 = SEMI_MAJOR * math.sqrt(c - n * q0) / n
    east, north = col(x) * unit, F.lit(rho0) - col(y) * unit
    sign = math.copysign(1.0, n)
    theta = F.atan2(sign * east, sign * north)
    q = (F.lit(c) - (east * east + north * north) * (n / SEMI_MAJOR) ** 2) / n

    def step(phi: Column, _) -> Column:
        s = F.sin(phi)
        part = 1 - e2 * s * s
        log = F.log((1 - e * s) / (1 + e * s)) / (2 * e)
        return phi + part * part / (2 * F.cos(phi)) * (q / (1 - e2) - s / part + log)

    start = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 2)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return F.degrees(theta) / n + lon0, F.degrees(phi)


def wkt_tree(text: str) -> list:
    """A coordinate system's well-known text as [name, part, ...]: parts are texts, numbers or trees."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_][A-Za-z_0-9]*|[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?|[\[\](),]', text)
    stack: list[list] = [[]]
    for k, t in enumerate(tokens):
        if t in "[(":
            continue
        if t in "])":
            done = stack.pop()
            if not stack:
                raise ValueError("unbalanced well-known text")
            stack[-1].append(done)
        elif t[0] == '"':
            stack[-1].append(t[1:-1].replace('""', '"'))
        elif re.match(r"[-+0-9.]", t):
            stack[-1].append(float(t))
        elif t != ",":
            if k + 1 < len(tokens) and tokens[k + 1] in "[(":
                stack.append([t.upper()])
            else:
                stack[-1].append(t)
    if len(stack) != 1 or not stack[0]:
        raise ValueError("unbalanced well-known text")
    return stack[0][0]


def unit_factor(wkt: str) -> float:
    """Metres of the linear unit of a projected system's well-known text; a geographic one has
    none and is an error. Without a unit, or with one that names no factor, 1, but for kilometres."""
    if not wkt.strip():
        return 1.0
    root = wkt_tree(wkt)
    if root[0] in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS"):
        raise ValueError("a projected coordinate system with linear units is needed")
    own = [p for p in root if isinstance(p, list)]
    # Newer texts give each axis its unit; the base system's unit is an angle and not looked at.
    units = [p for p in own if p[0] in ("UNIT", "LENGTHUNIT")] or [u for p in own if p[0] in ("CS", "AXIS") for u in p if isinstance(u, list) and u[0] in ("UNIT", "LENGTHUNIT")]
    for u in units:
        factor = next((x for x in u[1:] if isinstance(x, float)), None)
        if factor:
            return factor
        return 1000.0 if re.match("kilomet|km", u[1], re.I) else 1.0
    return 1.0
