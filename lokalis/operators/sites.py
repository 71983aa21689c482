"""Rows of one place taken together: what depends on distances alone is the same for all of them.

A site is a place (and time) with the number of rows there and their sums. Foci of one site share their result, and
data rows of one site are met once, with their sums; so the pairs grow with the places and not with the rows. Nothing
is left out: where all rows have places of their own, the sites are the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.sources.store import written

PLACE = ("x", "y")


def of(rows: DataFrame, sums: dict[str, Column] | None = None, by: tuple[str, ...] = PLACE) -> DataFrame:
    """A written table ``fid`` (a number of its own), the columns ``by`` and the named aggregates of each site."""
    found = rows.groupBy(*by).agg(*(c.alias(k) for k, c in sums.items())) if sums else rows.select(*by).distinct()
    return written(found.withColumn("fid", F.monotonically_increasing_id()).select("fid", *by, *(sums or {})))


def back(foci: DataFrame, found: DataFrame, own: DataFrame, by: tuple[str, ...] = PLACE, how: str = "left") -> DataFrame:
    """The rows ``found`` for sites (by their ``fid``) as rows of each of the foci ``own`` there."""
    placed = foci.select("fid", *by).withColumnRenamed("fid", "__site").join(found.withColumnRenamed("fid", "__site"), "__site").drop("__site")
    return own.select("fid", *by).join(placed, list(by), how).select("fid", *(f"`{c}`" for c in found.columns if c != "fid"))
