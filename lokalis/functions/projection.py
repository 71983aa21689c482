"""Transverse Mercator by Krueger's series, both ways, as column expressions on the ellipsoid of ``distance``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import FLATTENING

#: Metres of the ellipsoid's equator, scale on the central meridian, false easting and (south of the equator) northing of the zones of six degrees.
EQUATOR, SCALE, EASTING, NORTHING = 6378137.0, 0.9996, 500_000.0, 10_000_000.0
#: Latitude up to which zones are used, and degrees from a zone's middle up to which the series holds.
MOST_LATITUDE, MOST_OFF = 84.0, 60.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = EQUATOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRIC = 2 * math.sqrt(N) / (1 + N)
#: The series' coefficients to the fourth power of the third flattening.
ALPHA = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4, 13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4, 61 / 240 * N**3 - 103 / 140 * N**4, 49561 / 161280 * N**4)
BETA = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4, 1 / 48 * N**2 + 1 / 15 * N**3 - 437 / 1440 * N**4, 17 / 480 * N**3 - 37 / 840 * N**4, 4397 / 161280 * N**4)
DELTA = (2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4, 7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4, 56 / 15 * N**3 - 136 / 35 * N**4, 4279 / 630 * N**4)


def zone_of(lon: Column) -> Column:
    """The zone, 1 to 60, of a longitude in degrees."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def middle(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, worked out once for each row however often later ones use them (a generated row is not merged into other projections)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def known(df: DataFrame, x: Column, y: Column, *drop: str) -> DataFrame:
    out = df.withColumns({"x": x, "y": y}).drop(*drop)
    return out.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


def to_zones(df: DataFrame, zone: int | None = None) -> DataFrame:
    """Longitude ``x`` and latitude ``y`` in degrees to metres, with ``zone`` (one for all rows, or each row's own) and ``south``; rows that cannot be projected are left out."""
    lon, lat = F.col("x").cast("double"), F.col("y").cast("double")
    out = df.withColumns({"zone": F.lit(zone).cast("int") if zone else zone_of(lon), "south": lat < 0})
    off = F.pmod(lon - middle(F.col("zone")) + 180, F.lit(360.0)) - 180
    out = staged(out.filter((F.abs(lat) <= MOST_LATITUDE) & (F.abs(off) <= MOST_OFF)), __phi=F.radians(lat), __lam=F.radians(off))
    s = F.sin("__phi")
    out = staged(out, __t=F.sinh(F.atanh(s) - F.lit(ECCENTRIC) * F.atanh(F.lit(ECCENTRIC) * s)))
    out = staged(out, __xi=F.atan2(F.col("__t"), F.cos("__lam")), __eta=F.atanh(F.sin("__lam") / F.sqrt(1 + F.col("__t") * F.col("__t"))))
    xi, eta = F.col("__xi"), F.col("__eta")
    north = sum((F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), xi)
    east = sum((F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), eta)
    metres = lambda c: F.lit(SCALE * RADIUS) * c
    return known(out, metres(east) + EASTING, metres(north) + F.when(F.col("south"), NORTHING).otherwise(0.0), "__phi", "__lam", "__t", "__xi", "__eta")


def from_zones(df: DataFrame) -> DataFrame:
    """Metres of ``zone`` and ``south`` back to degrees; rows that cannot be are left out."""
    up = F.col("y").cast("double") - F.when(F.col("south"), NORTHING).otherwise(0.0)
    out = staged(df, __xi=up / (SCALE * RADIUS), __eta=(F.col("x").cast("double") - EASTING) / (SCALE * RADIUS))
    xi, eta = F.col("__xi"), F.col("__eta")
    p = sum((F.lit(-b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), xi)
    q = sum((F.lit(-b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), eta)
    out = staged(out, __p=p, __q=q)
    out = staged(out, __c=F.asin(F.sin("__p") / F.cosh("__q")))  # conformal latitude
    phi = sum((F.lit(d) * F.sin(2 * j * F.col("__c")) for j, d in enumerate(DELTA, 1)), F.col("__c"))
    lon = middle(F.col("zone")) + F.degrees(F.atan2(F.sinh("__q"), F.cos("__p")))
    return known(out, F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(phi), "zone", "south", "__xi", "__eta", "__p", "__q", "__c")
