"""Column-wise preparation of real vectors (id, v): dropping and scaling of columns.

Column statistics are one row of m structs, so applying them is a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_stats(rv: DataFrame) -> DataFrame:
    """One row ``cols``: an array of (low, high, bad) by position; bad where a value is NaN or null."""
    long = rv.select(F.posexplode("v").alias("pos", "x"))
    bad = F.col("x").isNull() | F.isnan("x")
    good = F.when(~bad, F.col("x"))
    by = long.groupBy("pos").agg(F.min(good).alias("low"), F.max(good).alias("high"), F.max(bad).alias("bad"))
    return by.agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high", "bad"))).alias("cols"))


def _applied(rv: DataFrame, keep, value) -> DataFrame:  # noqa: ANN001
    # one row of as many structs as a vector has elements
    rows = rv.where("id is not null and v is not null").join(F.broadcast(column_stats(rv)))
    pairs: Column = F.filter(F.arrays_zip("v", "cols"), lambda z: keep(z["cols"]))
    return rows.select("id", F.transform(pairs, lambda z: value(z["v"], z["cols"])).alias("v"))


def minmax(rv: DataFrame) -> DataFrame:
    """Columns scaled to 0..1; constant ones and those with a NaN or null are dropped."""
    return _applied(rv, lambda c: ~c["bad"] & (c["low"] < c["high"]), lambda x, c: (x - c["low"]) / (c["high"] - c["low"]))


def without_nan(rv: DataFrame) -> DataFrame:
    """Columns without a NaN or null."""
    return _applied(rv, lambda c: ~c["bad"], lambda x, c: x)


def width(rv: DataFrame) -> int:
    """Elements of a vector; 0 for an empty table."""
    got = rv.select(F.size("v").alias("m")).where("m >= 0").first()
    return got["m"] if got else 0


def complement(v: Column) -> Column:
    return F.transform(v, lambda x: 1 - x)


def squared(v: Column) -> Column:
    return F.transform(v, lambda x: x * x)
