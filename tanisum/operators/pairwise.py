"""Similarities of pairs: averages, matrices, one against many, nearest of a query set.

Pairs are inherently quadratic; they run in blocks of bounded size, as matrix
products over unpacked bits or vectors. RR and SM averages need no pairs at
all: they equal the set's index (see isim).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import to_packed
from ..plans.blocks import block_pairs

BLOCK = 2000
KINDS = ("JT", "RR", "SM")


def _dense(column: pa.ChunkedArray, m: int) -> np.ndarray:
    """Rows of on-bits as a 0/1 matrix."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = rows.offsets.to_numpy()
    x = np.zeros((len(rows), m))
    bits = rows.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    x[np.repeat(np.arange(len(rows)), np.diff(off)), bits.astype(np.int64)] = 1
    return x


def _real(column: pa.ChunkedArray, m: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, m)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


def pair_values(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Similarity of every row of x with every row of y; NaN where it is 0/0."""
    m = x.shape[1]
    dot = x @ y.T
    if kind == "JT":
        return _ratio(dot, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - dot)
    if kind == "RR":
        return _ratio(dot, np.float64(m))
    return _ratio(dot + (1 - x) @ (1 - y).T, np.float64(m))


def _kind(name: str) -> str:
    if name not in KINDS:
        raise ValueError(f"unknown similarity {name}; known are {', '.join(KINDS)}")
    return name


def _per_cell(rows: DataFrame, value: str, m: int, kind: str, read: Callable, emit: Callable, schema: str) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        c1, c2 = key[0].as_py(), key[1].as_py()
        t = t.sort_by("id")
        block = t["block"].to_numpy()
        ids, x = t["id"].to_numpy(), read(t[value], m)
        a, b = (block == c1), (block == c2)
        s = pair_values(x[a], x[b], kind)
        i, j = ids[a][:, None], ids[b][None]
        if c1 == c2:
            n = len(s)
            keep = np.triu(np.ones((n, n), bool), 1)
        else:
            keep = np.ones(s.shape, bool)
        return emit(np.minimum(i, j), np.maximum(i, j), s, keep & ~np.isnan(s))

    return block_pairs(rows.select("id", value), "id", BLOCK).groupBy("c1", "c2").applyInArrow(run, schema)


def _average(rows: DataFrame, value: str, m: int, kind: str, read: Callable) -> DataFrame:
    def emit(i, j, s, keep) -> pa.Table:  # noqa: ANN001
        v = s[keep]
        return pa.table({"n": [len(v)], "total": [float(v.sum())], "square": [float((v * v).sum())]})

    parts = _per_cell(rows, value, m, _kind(kind), read, emit, "n long, total double, square double")
    got = parts.agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("q"))
    mean = F.try_divide(F.col("t"), F.col("n"))
    return got.select(mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))).alias("std"))


def average(fp: DataFrame, m: int, kind: str = "JT") -> DataFrame:
    """``mean`` and population ``std`` over all pairs of objects; 0/0 pairs don't count, no pair gives nulls."""
    return _average(fp, "on", m, kind, _dense)


def average_real(rv: DataFrame, m: int, kind: str = "JT") -> DataFrame:
    """The same of real vectors (id, v) of m elements, as they are; see normalize for scaling first."""
    return _average(rv, "v", m, kind, _real)


def matrix(fp: DataFrame, m: int, kind: str = "JT") -> DataFrame:
    """``i``, ``j``, ``sim`` for i < j, and 1 on the diagonal; pairs of 0/0 are left out."""

    def emit(i, j, s, keep) -> pa.Table:  # noqa: ANN001
        return pa.table({"i": np.broadcast_to(i, s.shape)[keep], "j": np.broadcast_to(j, s.shape)[keep], "sim": s[keep]})

    pairs = _per_cell(fp, "on", m, _kind(kind), _dense, emit, "i long, j long, sim double")
    return pairs.unionAll(fp.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("sim")))


def tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two arrays of packed words; null for 0/0."""
    count = lambda x: F.aggregate(x, F.lit(0), lambda acc, w: acc + F.bit_count(w))
    both = count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return F.try_divide(both.cast("double"), count(a) + count(b) - both)


def against(packed: DataFrame, query: DataFrame) -> DataFrame:
    """``id``, ``sim`` of every row of packed (id, words) with the one row of query (words)."""
    one = query.select(F.col("words").alias("query_words")).limit(1)
    return packed.join(F.broadcast(one)).select("id", tanimoto(F.col("words"), F.col("query_words")).alias("sim"))


def tanimoto_mixed(on: Column, words: Column, m: int) -> Column:
    """Tanimoto similarity of on-bits with packed words."""
    return tanimoto(to_packed(on, m), words)


def nearest(fp: DataFrame, queries: DataFrame, m: int, k: int = 5, kind: str = "JT") -> DataFrame:
    """``id``, ``neighbour``, ``sim``, ``rank``: for each query the k most similar other objects, ties by id."""
    _kind(kind)
    asks = fp.join(queries.select("id").distinct(), "id", "left_semi").select("id", "on")
    # rows are cut into blocks, and so are those that ask; only blocks meet
    db, qb = (max(1, -(-t.count() // BLOCK)) for t in (fp, asks))
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.lit(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    rows = fp.select("id", "on", F.lit(False).alias("asks"), own(db).alias("d"), every(qb).alias("q"))
    rows = rows.unionByName(asks.select("id", "on", F.lit(True).alias("asks"), every(db).alias("d"), own(qb).alias("q")))
    rows = rows.select("id", "on", "asks", F.explode("d").alias("c1"), "q").select("id", "on", "asks", "c1", F.explode("q").alias("c2"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        q, ids, x = t["asks"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), _dense(t["on"], m)
        s = pair_values(x[q], x[~q], kind)
        s[(ids[q][:, None] == ids[~q][None]) | np.isnan(s)] = -1
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(s, order, 1)
        keep = top >= 0
        return pa.table({"id": pa.array(np.repeat(ids[q], keep.sum(1)), pa.int64()), "neighbour": pa.array(ids[~q][order[keep]] if order.size else np.zeros(0, np.int64), pa.int64()), "sim": pa.array(top[keep], pa.float64())})

    cells = rows.repartition(min(db * qb, 100_000), "c1", "c2").groupBy("c1", "c2")
    found = cells.applyInArrow(lambda t: run(t), "id long, neighbour long, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
