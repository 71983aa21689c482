"""Distances between a focus point and a data point as column expressions. Null coordinates give null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (focus x, focus y, data x, data y) -> distance
Distance = Callable[[Column, Column, Column, Column], Column]

#: The ellipsoid of geographic coordinates (km).
EQUATOR, FLATTENING = 6378.137, 1 / 298.257223563


def euclidean(fx, fy, dx, dy) -> Column:
    return F.sqrt((fx - dx) * (fx - dx) + (fy - dy) * (fy - dy))


def chebyshev(fx, fy, dx, dy) -> Column:
    return F.greatest(F.abs(fx - dx), F.abs(fy - dy))


def manhattan(fx, fy, dx, dy) -> Column:
    return F.abs(fx - dx) + F.abs(fy - dy)


def minkowski(p: float, theta: float = 0.0) -> Distance:
    """Power ``p`` after the axes are turned by ``theta`` radians."""
    c, s = math.cos(theta), math.sin(theta)

    def of(fx, fy, dx, dy) -> Column:
        u, v = fx - dx, fy - dy
        a, b = F.abs(u * F.lit(c) - v * F.lit(s)), F.abs(u * F.lit(s) + v * F.lit(c))
        return F.pow(F.pow(a, F.lit(float(p))) + F.pow(b, F.lit(float(p))), F.lit(1.0 / p))

    return of


def turned(metric: Distance, theta: float) -> Distance:
    """A metric after the axes are turned by ``theta`` radians."""
    c, s = F.lit(math.cos(theta)), F.lit(math.sin(theta))
    return lambda fx, fy, dx, dy: metric(fx * c - fy * s, fx * s + fy * c, dx * c - dy * s, dx * s + dy * c)


def by_power(p: float, theta: float = 0.0) -> Distance:
    """The metric that a settings file's power stands for: 2 euclidean, 1 Chebyshev, -1 Manhattan, else Minkowski."""
    known = {2: euclidean, 1: chebyshev, -1: manhattan}.get(p)
    return minkowski(p, theta) if not known else turned(known, theta) if theta and p != 2 else known


def great_circle(fx, fy, dx, dy) -> Column:
    """Kilometres between longitude/latitude degrees on the ellipsoid (Andoyer-Lambert); 0 for equal points, null for antipodes."""
    same = ((fx == dx) & (fy == dy)) | ((fy == dy) & (F.abs(fx) + F.abs(dx) == 360))
    fx, fy = F.when(~same, fx), F.when(~same, fy)  # all that follows is evaluated for every pair, so Spark finds the common parts once
    half = lambda a, b, sign: F.radians(a + b if sign > 0 else a - b) / 2
    f, g, l = half(fy, dy, 1), half(fy, dy, -1), half(fx, dx, -1)
    s = F.pow(F.sin(g), 2) * F.pow(F.cos(l), 2) + F.pow(F.cos(f), 2) * F.pow(F.sin(l), 2)
    c = F.pow(F.cos(g), 2) * F.pow(F.cos(l), 2) + F.pow(F.sin(f), 2) * F.pow(F.sin(l), 2)
    w = F.atan(F.sqrt(F.try_divide(s, c)))
    r = F.try_divide(F.sqrt(s * c), w)
    h1, h2 = F.try_divide(3 * r - 1, 2 * c), F.try_divide(3 * r + 1, 2 * s)
    far = 2 * w * EQUATOR * (1 + FLATTENING * (h1 * F.pow(F.sin(f), 2) * F.pow(F.cos(g), 2) - h2 * F.pow(F.cos(f), 2) * F.pow(F.sin(g), 2)))
    return F.coalesce(far, F.when(same, F.lit(0.0)))


def one_dimensional(a, b) -> Column:
    return F.abs(a - b)


def space_time(space: Column, ft: Column, dt: Column, scale: float) -> Column:
    """Spatial distance and a time lag joined with weight ``scale``."""
    return F.sqrt(space * space + F.lit(float(scale)) * (ft - dt) * (ft - dt))
