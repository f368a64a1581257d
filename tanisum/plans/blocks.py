"""All-against-all work in blocks: rows are cut by a hash, and each task gets two blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, id_col: str, block_rows: int) -> DataFrame:
    """Rows with a cell (c1 <= c2) and their own block; two blocks share exactly one cell.

    The work is quadratic in the rows by nature; tasks are bounded by two blocks.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumns({"c1": F.least("block", "other"), "c2": F.greatest("block", "other")}).drop("other").repartition(max(1, blocks * (blocks + 1) // 2), "c1", "c2")
