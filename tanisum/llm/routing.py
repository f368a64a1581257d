"""Sending rows of a key to tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

#: Tables of split keys up to this many rows are broadcast, longer ones are joined by shuffle.
SMALL = 50_000


def split_keys(rows: DataFrame, by: str, block_rows: int) -> tuple[DataFrame, int, int]:
    """Keys with more than block_rows rows and their number of blocks; how many; and the number of all keys."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    got = counts.agg(F.sum(F.when(F.col("n") > block_rows, 1).otherwise(0)).alias("hot"), F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    hot = counts.where(F.col("n") > block_rows).select(by, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    return hot, got["hot"] or 0, max(1, min(got["keys"] or 1, max(shuffle_width(rows.sparkSession), -(-(got["rows"] or 0) // block_rows) * 2)))


def with_blocks(rows: DataFrame, by: str, salt: str, block_rows: int) -> tuple[DataFrame, int, bool]:
    """Adds blocks (1 for keys of bounded size) and block (by a hash of salt); a number of tasks that suits; whether any key is cut."""
    hot, n, width = split_keys(rows.select(by), by, block_rows)
    if not n:
        return rows.withColumns({"blocks": F.lit(1), "block": F.lit(0)}), width, False
    rows = rows.join(F.broadcast(hot) if n <= SMALL else hot, by, "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.col(salt)), F.col("blocks").cast("long")).cast("int")), width * 2, True


def cells_by_key(rows: DataFrame, by: str, salt: str, block_rows: int) -> tuple[DataFrame, bool]:
    """Rows with a cell (c1 <= c2) of their key, and whether any key is cut; rows of two blocks share exactly one cell."""
    rows, width, cut = with_blocks(rows, by, salt, block_rows)
    one = F.col("blocks") == 1
    other = F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("partner", other)
    rows = rows.withColumns({"c1": F.least("block", "partner"), "c2": F.greatest("block", "partner")}).drop("partner", "blocks")
    return rows.repartition(width, by, "c1", "c2"), cut


def join_hot(rows: DataFrame, right: DataFrame, keys: list[str], number: str, limit: int) -> DataFrame:
    """Inner join with right, one row a key, whose column ``number`` tells the rows of its key: keys of more than limit rows are broadcast.

    There are no more than rows / limit of them; beyond SMALL they are joined by shuffle like the others.
    """
    others = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(number) > limit).withColumn("is_hot", F.lit(True))
    n = hot.limit(SMALL + 1).count()
    if not n or n > SMALL:
        return rows.join(right, keys)
    seen = rows.join(F.broadcast(hot), keys, "left")
    cold = seen.where("is_hot is null").select(*rows.columns).join(right.where(F.col(number) <= limit), keys)
    return seen.where("is_hot").select(*rows.columns, *others).unionByName(cold.select(*rows.columns, *others))
