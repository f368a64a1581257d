"""Standard deviation of the pairwise similarities, from co-occurrence counts or a sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import gathered
from . import compsim, pairwise, sampling
from .isim import pairs, stats


def cooccurrence(fp: DataFrame, m: int) -> DataFrame:
    """``i``, ``j``, ``c``: in how many objects bits i < j are both on; pairs that never are don't appear.

    Each task sums the bit products of its rows; m * m / 2 numbers a task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((m, m))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = pairwise._dense(b.column("on").slice(lo, 4096), m)
                gram += x.T @ x
        i, j = np.nonzero(np.triu(gram, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j].astype(np.int64))], names=["i", "j", "c"])

    return fp.select("on").mapInArrow(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c"))


def fast(fp: DataFrame, m: int, kind: str = "RR") -> DataFrame:
    """``sigma`` without pairs of objects: exact for RR and SM, an approximation for JT."""
    if kind not in ("RR", "SM", "JT"):
        raise ValueError("sigma knows RR, SM and JT")
    # one row of m sums
    whole = stats(fp, m)
    n = F.col("n").cast("double")
    c = lambda i: F.get("c", i).cast("double")
    both = cooccurrence(fp, m).withColumnRenamed("c", "cij")
    if kind == "SM":
        every = fp.sparkSession.range(m).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).where("i < j")
        both = every.join(both, ["i", "j"], "left").withColumn("cij", F.coalesce("cij", F.lit(0)))
    x = F.col("cij").cast("double")
    joint = pairs(x)
    if kind == "SM":
        ci, cj = c(F.col("i")), c(F.col("j"))
        joint = joint + pairs(n - ci - cj + x) + pairs(ci - x) + pairs(cj - x)
    joint_sum = both.join(F.broadcast(whole)).agg(F.sum(joint).alias("joint"))
    t = pairs(n)
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda acc, v: acc + f(v.cast("double")))
    p = (lambda v: F.try_divide(pairs(v) + pairs(n - v), t)) if kind == "SM" else (lambda v: F.try_divide(pairs(v), t))
    s1, s2 = total(p), total(lambda v: p(v) * p(v))
    # sum of p (1 - p) plus twice the covariances
    var = s1 - s2 + 2 * (F.try_divide(F.coalesce("joint", F.lit(0.0)), t) - (s1 * s1 - s2) / 2)
    by = total(lambda v: F.try_divide(t - pairs(n - v), t)) if kind == "JT" else F.lit(float(m))
    return whole.join(F.broadcast(joint_sum)).select(F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), by).alias("sigma"))


def stratified(fp: DataFrame, m: int, n: int = 50, kind: str = "JT") -> DataFrame:
    """Mean and std of the pairs of a stratified sample of about n objects."""
    scores = compsim.comp_sim(fp, m, kind)
    count = fp.count()
    picked = sampling.stratified_sample(scores, min(100.0, n * 100 / max(1, count)))
    return pairwise.average(gathered(fp, picked), m, kind)


def at_random(fp: DataFrame, m: int, n: int = 50, kind: str = "JT", seed: int = 1) -> DataFrame:
    """Mean and std of the pairs of a random sample of n objects."""
    return pairwise.average(sampling.random_sample(fp, n, seed), m, kind)
