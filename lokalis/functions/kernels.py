"""Kernel weights of a distance ``d`` under a bandwidth ``b``, for columns and for numpy arrays. A bandwidth of 0 gives weight 1 at distance 0 and else 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("gaussian", "exponential", "bisquare", "tricube", "boxcar")
#: Kernels without weight beyond the bandwidth.
COMPACT = ("bisquare", "tricube", "boxcar")


def weight(name: str, d: Column, b: Column) -> Column:
    r = F.try_divide(d, b)
    inside = {
        "gaussian": F.exp(-(r * r) / 2),
        "exponential": F.exp(-r),
        "bisquare": (1 - r * r) * (1 - r * r),
        "tricube": (1 - r * r * r) * (1 - r * r * r) * (1 - r * r * r),
        "boxcar": F.lit(1.0),
    }[name]
    out = F.when(d > b, F.lit(0.0)).otherwise(inside) if name in COMPACT else inside
    return F.when(b > 0, out).otherwise(F.when(d == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def weights(name: str, d: np.ndarray, b: np.ndarray) -> np.ndarray:
    b = np.asarray(b, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = d / b
        if name == "gaussian":
            r *= r
            r *= -0.5
        out = {"gaussian": lambda: np.exp(r, out=r), "exponential": lambda: np.exp(-r), "bisquare": lambda: (1 - r**2) ** 2, "tricube": lambda: (1 - r**3) ** 3, "boxcar": lambda: np.ones_like(r)}[name]()
    if name in COMPACT:
        out = np.where(d > b, 0.0, out)
    if b.ndim == 0 and b > 0:
        return out
    return np.where(b > 0, out, (d == 0) * 1.0)
