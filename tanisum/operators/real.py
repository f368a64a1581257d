"""Set similarity and leave-one-out scores of real vectors (id, v) in 0..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("JT", "RR", "SM")


def sums(rv: DataFrame) -> DataFrame:
    """One row: ``n``, and arrays ``s`` and ``q`` of the columns' sums and sums of squares."""
    long = rv.select(F.posexplode("v").alias("pos", "x"))
    by = long.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    got = by.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s", "q"))).alias("t"))
    return got.select("n", F.col("t.s").alias("s"), F.col("t.q").alias("q"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _inner(s: Column, q: Column) -> Column:
    """Half of the sum of s^2 - q: the inner products of all pairs."""
    return _sum(F.zip_with(s, q, lambda a, b: a * a - b)) / 2


def _flipped(n: Column, s: Column, q: Column) -> Column:
    """The same for the complements."""
    return _sum(F.zip_with(s, q, lambda a, b: (n - a) * (n - a) - (n - 2 * a + b))) / 2


def isim(rv: DataFrame, kind: str = "JT") -> DataFrame:
    """``isim`` of the whole table; null for fewer than two vectors."""
    if kind not in KINDS:
        raise ValueError(f"unknown similarity {kind}; known are {', '.join(KINDS)}")
    n, s, q = F.col("n").cast("double"), F.col("s"), F.col("q")
    m = F.size("s").cast("double")
    ij = _inner(s, q)
    value = {
        "JT": F.try_divide(ij, (n - 1) * _sum(q) - ij),
        "RR": F.try_divide(2 * ij, m * n * (n - 1)),
        "SM": F.try_divide(2 * (ij + _flipped(n, s, q)), m * n * (n - 1)),
    }[kind]
    return sums(rv).select(value.alias("isim"))


def comp_sim(rv: DataFrame, kind: str = "JT") -> DataFrame:
    """``id``, ``comp_sim`` of every vector; null for fewer than three."""
    if kind not in KINDS:
        raise ValueError(f"unknown similarity {kind}; known are {', '.join(KINDS)}")
    # one row of two arrays
    rows = rv.where("id is not null and v is not null").join(F.broadcast(sums(rv)))
    less = F.col("n").cast("double") - 1
    m = F.size("s").cast("double")
    s = F.zip_with("s", "v", lambda a, x: a - x)
    q = F.zip_with("q", "v", lambda a, x: a - x * x)
    ij = _inner(s, q)
    value = {
        "JT": F.try_divide(ij, (less - 1) * _sum(q) - ij),
        "RR": F.try_divide(2 * ij, m * less * (less - 1)),
        "SM": F.try_divide(2 * (ij + _flipped(less, s, q)), m * less * (less - 1)),
    }[kind]
    return rows.select("id", F.when(less >= 2, value).alias("comp_sim"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def pair(kind: str, a: Column, b: Column, m: float | None = None) -> Column:
    """Similarity of two vectors; m: what RR and SM divide by, their length if not given."""
    size = F.lit(float(m)) if m else F.size(a).cast("double")
    if kind == "JT":
        d = dot(a, b)
        return F.try_divide(d, dot(a, a) + dot(b, b) - d)
    if kind == "RR":
        return F.try_divide(dot(a, b), size)
    if kind == "SM":
        return F.try_divide(dot(a, b) + _sum(F.zip_with(a, b, lambda x, y: (1 - x) * (1 - y))), size)
    raise ValueError(f"unknown similarity {kind}; known are {', '.join(KINDS)}")
