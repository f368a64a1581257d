"""Similarity of whole sets of fingerprints from the column sums alone.

One aggregate by bit gives ``stats``: the number of objects and the column
sums as an array of m numbers, one row in all or one a group. Everything else
is an expression over that row, so the cost is linear in the on-bits. 0/0
gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDICES = ("AC", "BUB", "Fai", "Gle", "Ja", "JT", "RT", "RR", "SM", "SS1", "SS2")


def _counted(m: int) -> Callable:
    """Sums of a task's rows, m + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(m + 1, np.int64)
        for b in batches:
            bits = b.column("on").flatten().to_numpy(zero_copy_only=False)
            if len(bits) and not 0 <= bits.min() <= bits.max() < m:
                raise ValueError(f"a bit is beyond the {m} expected")
            c[:m] += np.bincount(bits, minlength=m)[:m] if len(bits) else 0
            c[m] += b.num_rows
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == m, -1, at).astype(np.int32)), pa.array(c[at])], names=["bit", "x"])

    return run


def stats(fp: DataFrame, m: int, by: str | None = None) -> DataFrame:
    """``n`` and ``c`` (array of m sums), by group if ``by`` names a column; no row for an empty ungrouped table's groups. Bits beyond m raise."""
    keys = [by] if by else []
    # bit -1 counts the objects, all-zero ones too
    if by:
        bit = F.when((F.col("bit") >= -1) & (F.col("bit") < m), F.col("bit")).otherwise(F.raise_error(F.lit(f"a bit is beyond the {m} expected")).cast("int"))
        bits = fp.select(by, F.explode(F.array_append("on", F.lit(-1))).alias("bit")).select(by, bit.alias("bit"))
        counts = bits.groupBy(by, "bit").agg(F.count(F.lit(1)).alias("x"))
    else:
        counts = fp.select("on").mapInArrow(_counted(m), "bit int, x long").groupBy("bit").agg(F.sum("x").alias("x"))
    got = counts.groupBy(*keys).agg(F.sum(F.when(F.col("bit") == -1, F.col("x")).otherwise(0)).alias("n"), F.map_from_entries(F.collect_list(F.struct("bit", "x"))).alias("at"))
    zero = F.lit(0).cast("long")
    c = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.try_element_at("at", i), zero))
    return got.select(*keys, F.coalesce("n", zero).alias("n"), c.alias("c"))


def _total(c: Column, f) -> Column:  # noqa: ANN001
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def pairs(x: Column) -> Column:
    """Number of pairs among x things."""
    return x * (x - 1) / 2


def with_counters(s: DataFrame, k: float = 1) -> DataFrame:
    """Adds a, d, total_sim, total_dis and p, each column's share to the power 1/k."""
    if k <= 0:
        raise ValueError("k must be positive")
    n = F.col("n").cast("double")
    root = (lambda x: x) if k == 1 else (lambda x: F.pow(x, F.lit(1 / k)))
    s = s.withColumns({"a": _total(F.col("c"), lambda x: root(pairs(x))), "d": _total(F.col("c"), lambda x: root(pairs(n - x))), "total_dis": _total(F.col("c"), lambda x: root((n - x) * x))})
    return s.withColumn("total_sim", F.col("a") + F.col("d")).withColumn("p", F.col("total_sim") + F.col("total_dis"))


def index(name: str) -> Column:
    """One of INDICES over the counters' columns."""
    a, d, s, dis, p = (F.col(x) for x in ("a", "d", "total_sim", "total_dis", "p"))
    g = F.sqrt(a * d)
    ratio = F.try_divide
    table = {
        "AC": lambda: F.lit(2 / math.pi) * F.asin(F.sqrt(ratio(s, p))),
        "BUB": lambda: ratio(g + a, g + a + dis),
        "Fai": lambda: ratio(a + d / 2, p),
        "Gle": lambda: ratio(2 * a, 2 * a + dis),
        "Ja": lambda: ratio(3 * a, 3 * a + dis),
        "JT": lambda: ratio(a, a + dis),
        "RT": lambda: ratio(s, p + dis),
        "RR": lambda: ratio(a, p),
        "SM": lambda: ratio(s, p),
        "SS1": lambda: ratio(a, a + 2 * dis),
        "SS2": lambda: ratio(2 * s, p + s),
    }
    if name not in table:
        raise ValueError(f"unknown index {name}; known are {', '.join(INDICES)}")
    return table[name]()


def isim(fp: DataFrame, m: int, name: str = "JT", by: str | None = None, k: float = 1) -> DataFrame:
    """``isim`` of the whole table, or of each group."""
    got = with_counters(stats(fp, m, by), k)
    return got.select(*([by] if by else []), index(name).alias("isim"))


def all_indices(fp: DataFrame, m: int, by: str | None = None, k: float = 1) -> DataFrame:
    """All indices as columns."""
    got = with_counters(stats(fp, m, by), k)
    return got.select(*([by] if by else []), *[index(x).alias(x) for x in INDICES])


def centroids(s: DataFrame) -> DataFrame:
    """Majority bits of each row of stats: on where at least half of the objects have the bit."""
    on = F.array_compact(F.transform("c", lambda x, i: F.when((x * 2 >= F.col("n")) & (F.col("n") > 0), i)))
    return s.withColumn("on", on)


def merged(a: Column, b: Column) -> Column:
    """Sum of two column-sum arrays."""
    return F.zip_with(a, b, lambda x, y: x + y)
