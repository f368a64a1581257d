"""Similarity of a set without each of its objects; medoid and outlier.

From the column sums, leaving an object out changes the counters by sums over
its own on-bits only, so every score is a map over the rows with a one-row
table of m sums beside it: no shuffle of the rows. All numbers are whole until
the last division, so equal scores are equal exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .isim import _total, pairs, stats


def comp_sim(fp: DataFrame, m: int, name: str = "JT") -> DataFrame:
    """``id``, ``comp_sim`` of every object; null where it isn't defined (fewer than three objects)."""
    if name not in ("JT", "RR", "SM"):
        raise ValueError("comp_sim knows JT, RR and SM")
    n = F.col("n").cast("double")
    whole = stats(fp, m).select(
        "n",
        "c",
        _total(F.col("c"), pairs).alias("a_all"),
        _total(F.col("c"), lambda x: (n - 1 - x) * x).alias("dis_all"),
        _total(F.col("c"), lambda x: pairs(n - 1 - x)).alias("d_all"),
    )
    # one row of m numbers
    rows = fp.select("id", "on").join(F.broadcast(whole))
    rows = rows.withColumns({"k": F.size("on").cast("double"), "s": F.aggregate("on", F.lit(0.0), lambda acc, b: acc + F.get("c", b))})
    a = F.col("a_all") - (F.col("s") - F.col("k"))
    dis = F.col("dis_all") + 2 * F.col("s") - n * F.col("k")
    d = F.col("d_all") + (n - 1) * F.col("k") - F.col("s")
    every = F.lit(float(m)) * pairs(n - 1)
    value = {"JT": F.try_divide(a, a + dis), "RR": F.try_divide(a, every), "SM": F.try_divide(a + d, every)}[name]
    return rows.select("id", F.when(F.col("n") >= 3, value).alias("comp_sim"))


def medoid(scores: DataFrame) -> DataFrame:
    """The object whose absence lowers the similarity most; of equals the least id."""
    return scores.where("comp_sim is not null").orderBy("comp_sim", "id").limit(1)


def outlier(scores: DataFrame) -> DataFrame:
    """The object whose absence raises it most; of equals the least id."""
    return scores.where("comp_sim is not null").orderBy(F.desc("comp_sim"), "id").limit(1)
