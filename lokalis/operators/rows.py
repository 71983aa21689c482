"""Filters, selections and field edits on feature tables, as column expressions in Spark SQL's grammar."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.sources.store import written


def combined(old: str | None, new: str, how: str = "replace") -> str:
    """A filter replaced by, and-ed or or-ed with a new one."""
    return new if how == "replace" or not old else f"({old}) {how.upper()} ({new})"


def where(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(F.expr(expression))


def in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows inside the rectangle, borders included: view extent, rectangle filter, identify."""
    return df.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def by_ids(df: DataFrame, ids: list[int]) -> DataFrame:
    return df.filter(F.col("fid").isin(ids))


def select_rows(df: DataFrame, expression: str = "true") -> DataFrame:
    """A boolean ``selected`` column; null expressions select nothing."""
    return df.withColumn("selected", F.coalesce(F.expr(expression), F.lit(False)))


def inverted(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", ~F.col("selected"))


def selected_first(df: DataFrame, key: str = "fid") -> DataFrame:
    return df.orderBy(F.desc("selected"), key)


def numbered(df: DataFrame, name: str, order: str | list[str]) -> DataFrame:
    """The row's place by ``order``, from 1: ranges are sorted apart and written, and only their sizes reach the driver."""
    by = [order] if isinstance(order, str) else order
    ranged = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not before:
        return ranged.withColumn(name, F.col("__at")).drop("__at")
    start = F.create_map(*(F.lit(v) for pair in before.items() for v in pair))
    return ranged.withColumn(name, start[part] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")


def calculated(df: DataFrame, field: str, expression: str, only: str | None = None, order: str = "fid") -> DataFrame:
    """Add or update ``field``; with ``only`` just where it holds. ``row_number`` stands for the row's place by ``order``."""
    rows = numbered(df, "row_number", order) if "row_number" in expression else df
    value = F.expr(expression)
    if only:
        value = F.when(F.expr(only), value.cast(df.schema[field].dataType) if field in df.columns else value).otherwise(F.col(field) if field in df.columns else F.lit(None))
    return rows.withColumn(field, value).drop(*(["row_number"] if "row_number" not in df.columns else []))


def cleared(df: DataFrame) -> DataFrame:
    """Nothing selected."""
    return df.withColumn("selected", F.lit(False))


def edited(df: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that differ from the row of the same ``fid`` in an earlier state of the table, or are new."""
    same = F.lit(True)
    for c in df.columns:
        if c in before.columns:
            same = same & F.col(f"now.`{c}`").eqNullSafe(F.col(f"was.`{c}`"))
    return df.alias("now").join(before.alias("was"), same & (F.col("now.fid") == F.col("was.fid")), "left_anti")


class StoredFilters:
    """Named filter expressions, kept as JSON text."""

    def __init__(self, text: str = "{}"):
        self.named: dict[str, str] = json.loads(text)

    def store(self, name: str, expression: str) -> None:
        self.named[name] = expression

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        return where(df, self.named[name])

    def text(self) -> str:
        return json.dumps(self.named, sort_keys=True)


def without_selected(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("selected"))


def add_field(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def drop_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def to_mercator(df: DataFrame) -> DataFrame:
    """Longitude and latitude degrees to spherical Mercator metres; null where a coordinate is null or the latitude is beyond the projection."""
    r = 6378137.0
    inside = F.col("x").isNotNull() & (F.abs("y") < 90)
    x, y = F.lit(r) * F.radians("x"), F.lit(r) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians("y") / 2))
    return df.withColumns({"x": F.when(inside, x), "y": F.when(inside, y)})


def from_mercator(df: DataFrame) -> DataFrame:
    r = 6378137.0
    return df.withColumn("x", F.degrees(F.col("x") / r)).withColumn("y", F.degrees(2 * F.atan(F.exp(F.col("y") / r)) - F.lit(1.5707963267948966)))
