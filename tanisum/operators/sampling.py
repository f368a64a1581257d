"""Samples chosen by score: most central, most outlying, both, by strata, by quota, at random.

Scores are (id, comp_sim) rows; null scores are left out. Order is by score,
then id. Ranks over the whole table come from a range sort whose partitions are
counted, so no task holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ranked_by(rows: DataFrame, *keys: Column | str) -> tuple[DataFrame, int]:
    """Rows with their 0-based ``rank`` in the order of the keys, and their number."""
    columns = rows.columns
    # the low 33 bits count the rows of a partition, the others tell the partition
    rows = materialize(rows.orderBy(*keys).withColumn("at", F.monotonically_increasing_id()), "ranked")
    place = F.shiftrightunsigned("at", 33)
    # one row a partition
    parts = rows.groupBy(place.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows"))
    rows = rows.withColumn("part", place).join(F.broadcast(parts), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    n = parts.agg(F.sum("rows")).first()[0] or 0
    return rows.select(*columns, rank.alias("rank")), n


def ranked(scores: DataFrame) -> tuple[DataFrame, int]:
    """Scores with their 0-based ``rank``, and their number."""
    return ranked_by(scores.where("comp_sim is not null").select("id", "comp_sim"), "comp_sim", "id")


def wanted(n: int, percentage: float) -> int:
    """Number of objects in a percentage of n, cut to a whole number."""
    if not 0 <= percentage <= 100:
        raise ValueError("percentage must be between 0 and 100")
    return int(n * percentage / 100)


def medoid_sample(scores: DataFrame, percentage: float = 10) -> DataFrame:
    """``id`` of the lowest scores."""
    rows, n = ranked(scores)
    return rows.where(F.col("rank") < wanted(n, percentage)).select("id")


def outlier_sample(scores: DataFrame, percentage: float = 10) -> DataFrame:
    """``id`` of the highest scores; none where the percentage comes to none."""
    rows, n = ranked(scores)
    return rows.where(F.col("rank") >= n - wanted(n, percentage)).select("id")


def extremes_sample(scores: DataFrame, percentage: float = 10) -> DataFrame:
    """``id``, ``side``: half of the percentage from either end; twice, where the halves overlap."""
    rows, n = ranked(scores)
    k = wanted(n, percentage / 2)
    sides = F.array_compact(F.array(F.when(F.col("rank") < k, F.lit("low")), F.when(F.col("rank") >= n - k, F.lit("high"))))
    return rows.select("id", F.explode(sides).alias("side"))


def stratified_sample(scores: DataFrame, percentage: float = 10, strata: int | None = None) -> DataFrame:
    """``ord``, ``id``: the i-th of every stratum in turn. Strata are even runs of the order, the first ones longer by one."""
    rows, n = ranked(scores)
    k = wanted(n, percentage)
    if k < 1:
        raise ValueError("the percentage comes to no object")
    strata = k if strata is None else strata
    if not 1 <= strata <= k:
        raise ValueError("strata must be between 1 and the sample's size")
    size, longer = divmod(n, strata)
    r, edge = F.col("rank"), longer * (size + 1)
    tile = F.when(r < edge, F.floor(r / (size + 1))).otherwise(longer + F.floor((r - edge) / size))
    pos = F.when(r < edge, r % (size + 1)).otherwise((r - edge) % size)
    # every stratum has the first ``size`` places, the first ones one more: the order follows from both numbers
    return rows.select((pos * strata + tile + 1).cast("int").alias("ord"), "id").where(F.col("ord") <= k)


def bin_of(score: Column, low: float, step: float, bins: int) -> Column:
    """Bin whose lower edge ``low + i * step`` is the last not above the score."""
    low, step = F.lit(low), F.lit(step)
    guess = F.greatest(F.least(F.floor(F.try_divide(score - low, step)), F.lit(bins - 1)), F.lit(0)) if bins > 1 else F.lit(0)
    guess = F.coalesce(guess, F.lit(bins - 1)).cast("int")
    # rounding puts the guess at most one off
    up = (guess + 1 < bins) & (low + (guess + 1) * step <= score)
    down = (guess > 0) & (low + guess * step > score)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def quota_sample(scores: DataFrame, percentage: float = 10, bins: int | None = None, hard_cap: bool = True) -> DataFrame:
    """``ord``, ``id``: the i-th of every bin in turn. Bins are even in score; a soft cap ends the last round.

    The driver sees the different sizes of bins only, less than sqrt(2 n) numbers.
    """
    rows, n = ranked(scores)
    k = wanted(n, percentage)
    bins = k if bins is None else bins
    if k < 1 or not 1 <= bins <= k:
        raise ValueError("the sample must hold at least one object a bin")
    low, high = rows.agg(F.min("comp_sim"), F.max("comp_sim")).first()
    step = (high - low) / bins
    rows = rows.withColumn("bin", bin_of(F.col("comp_sim"), low, step, bins))
    # a bin is a run of the order
    first = rows.groupBy("bin").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size"))
    rows = rows.join(F.broadcast(first) if bins <= 100_000 else first, "bin").withColumn("pos", F.col("rank") - F.col("first"))
    sizes = {r["size"]: r["n"] for r in first.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    reached = lambda rounds: sum(min(s, rounds) * m for s, m in sizes.items())
    rounds, most = 1, max(sizes)
    while rounds < most:  # the least number of rounds that gives k
        mid = (rounds + most) // 2
        rounds, most = (rounds, mid) if reached(mid) >= k else (mid + 1, most)
    rows, _ = ranked_by(rows.where(F.col("pos") < rounds).select("id", "pos", "bin"), "pos", "bin")
    got = rows.select((F.col("rank") + 1).cast("int").alias("ord"), "id")
    return got.where(F.col("ord") <= k) if hard_cap else got


def random_sample(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, those of the least seeded MD5 of their id; n is at most what one task can hold."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return rows.orderBy(key, "id").limit(n)
