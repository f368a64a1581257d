"""Online use: live set similarity of a stream, and clusters that grow batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster.batch import FEATURES, clustered
from ..cluster.criteria import criterion
from ..operators.isim import index, with_counters


def live_sums(fp: DataFrame, m: int) -> DataFrame:
    """``bit``, ``x``: running column sums of a stream of fingerprints; bit -1 counts objects. For complete mode."""
    bits = F.explode(F.array_append(F.filter("on", lambda b: (b >= 0) & (b < m)), F.lit(-1)))
    return fp.select(bits.alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("x"))


def windowed_sums(fp: DataFrame, m: int, ts: str, width: str, late: str) -> DataFrame:
    """The same by event-time window; rows later than ``late`` are dropped. For append or update mode."""
    bits = F.explode(F.array_append(F.filter("on", lambda b: (b >= 0) & (b < m)), F.lit(-1)))
    rows = fp.withWatermark(ts, late).select(F.window(ts, width).alias("window"), bits.alias("bit"))
    return rows.groupBy("window", "bit").agg(F.count(F.lit(1)).alias("x"))


def isim_of(sums: DataFrame, m: int, name: str = "JT") -> DataFrame:
    """``n``, ``isim`` from the sums that a stream has written."""
    got = sums.agg(F.max(F.when(F.col("bit") == -1, F.col("x")).otherwise(0)).alias("n"), F.map_from_entries(F.collect_list(F.struct("bit", "x"))).alias("at"))
    zero = F.lit(0).cast("long")
    c = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.try_element_at("at", i), zero))
    return with_counters(got.select("n", c.alias("c"))).select("n", index(name).alias("isim"))


class OnlineClusters:
    """Clusters of a stream of fingerprints, kept as a snapshot of features a batch.

    Use ``update`` with foreachBatch. A batch's snapshot is named by its number,
    so a batch that is run again writes the same one. Re-inserting features
    builds another tree than going on in memory would.
    """

    def __init__(self, path: str, m: int, *, method: str = "tolerance", threshold: float = 0.65, tolerance: float = 0.05, branching: int = 50):
        self.path, self.m, self.branching = path, m, branching
        self.accept = criterion(method, threshold, tolerance)

    def _at(self, batch: int) -> str:
        return os.path.join(self.path, f"batch={batch:012d}")

    def update(self, fp: DataFrame, batch: int) -> None:
        spark = fp.sparkSession
        m = self.m
        dense = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.array_contains("on", i).cast("long"))
        new = fp.select(F.lit(0).cast("long").alias("grp"), F.col("id").alias("pos"), F.lit(1).cast("long").alias("n"), dense.alias("ls"), F.array("id").alias("ids"))
        old = self.snapshot(spark, batch - 1)
        if old is not None:
            # features of earlier batches go first, as they were ordered
            old = old.select(F.lit(0).cast("long").alias("grp"), (F.col("ord") - (1 << 40)).cast("long").alias("pos"), "n", "ls", "ids")
            new = old.unionByName(new)
        clustered(new, m, self.accept, self.branching, "grp").drop("grp").write.mode("overwrite").parquet(self._at(batch))

    def snapshot(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """Clusters after a batch; None before the first."""
        return None if batch < 0 else spark.read.schema(FEATURES).parquet(self._at(batch))
