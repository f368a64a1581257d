"""Clustering tables: exactly in one tree, or in rounds of many.

The tree is order-dependent, so rows enter by id. ``exact`` gives each group to
one task and suits groups of bounded size; ``rounds`` clusters ranges of rows
first, then ever larger bins of what came out, and the last tree gets clusters
only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import ranked_by
from ..session import materialize
from .criteria import criterion
from .tree import Feature, fit, poles

FEATURES = "ord int, n long, ls array<long>, ids array<long>"


def _singles(ids: Sequence[int], on: Sequence[Sequence[int]], m: int) -> list[Feature]:
    out = []
    for i, bits in zip(ids, on, strict=True):
        if len(bits) and not 0 <= min(bits) <= max(bits) < m:
            raise ValueError(f"object {i} has a bit beyond the {m} expected")
        ls = np.zeros(m, np.int64)
        ls[bits] = 1
        out.append(Feature(1, ls, [i]))
    return out


def _table(features: list[Feature], **more: object) -> pa.Table:
    k = len(features)
    columns = {c: pa.array([v] * k, v.type) if isinstance(v, pa.Scalar) else [v] * k for c, v in more.items()}
    return pa.table(
        columns
        | {
            "ord": pa.array(range(k), pa.int32()),
            "n": pa.array([f.n for f in features], pa.int64()),
            "ls": pa.array([f.ls for f in features], pa.list_(pa.int64())),
            "ids": pa.array([f.ids for f in features], pa.list_(pa.int64())),
        }
    )


def _read(t: pa.Table) -> list[Feature]:
    return [Feature(n, np.array(ls, np.int64), ids) for n, ls, ids in zip(t["n"].to_pylist(), t["ls"].to_pylist(), t["ids"].to_pylist(), strict=True)]


def size_class(n: int) -> int:
    """Features of more objects come first, in these classes."""
    return sum(n >= x for x in (254, 65534, 4294967294))


def by_class(features: list[Feature]) -> list[Feature]:
    return sorted(features, key=lambda f: (-size_class(f.n), -f.n))


def exact(fp: DataFrame, m: int, *, by: str | None = None, method: str = "diameter", threshold: float = 0.65, tolerance: float = 0.05, branching: int = 50) -> DataFrame:
    """``ord``, ``n``, ``ls``, ``ids`` of each cluster, largest first, of each group of ``by`` if given.

    One task holds a group; use rounds for more than a task can hold.
    """
    accept = criterion(method, threshold, tolerance)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        found = fit(_singles(t["id"].to_pylist(), t["on"].to_pylist(), m), m, accept, branching)
        return _table(found, **({by: t[by][0]} if by else {}))

    keys = fp.select("id", "on", F.col(by) if by else F.lit(0).alias("one"))
    schema = (f"`{by}` {dict(fp.dtypes)[by]}, " if by else "") + FEATURES
    return keys.groupBy(by or "one").applyInArrow(lambda t: run(t), schema)


def clustered(features: DataFrame, m: int, accept: Callable, branching: int, group: str) -> DataFrame:
    """Features (grp, pos, n, ls, ids) of each group through one tree, in order of pos."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        return _table(by_class(fit(_read(t), m, accept, branching)), grp=key[0])

    return features.groupBy(group).applyInArrow(run, f"{group} long, {FEATURES}")


def _queued(features: DataFrame, bins: int) -> DataFrame:
    """Features put into bins of ``bins`` groups, ordered by size class, group, size and least id."""
    grade = sum((F.col("n") >= x).cast("int") for x in (254, 65534, 4294967294))
    rows = features.withColumns({"source": F.col("grp"), "grp": F.floor(F.col("grp") / bins), "grade": grade})
    order = Window.partitionBy("grp").orderBy(F.desc("grade"), "source", F.desc("n"), F.array_min("ids"))
    return rows.withColumn("pos", F.row_number().over(order)).select("grp", "pos", "n", "ls", "ids")


def rounds(
    fp: DataFrame,
    m: int,
    *,
    rows_per_part: int = 10_000,
    bin_size: int = 10,
    threshold: float = 0.65,
    tolerance: float = 0.05,
    branching: int = 50,
    double_init: bool = True,
    only_first: bool = False,
) -> DataFrame:
    """``ord``, ``n``, ``ls``, ``ids`` of the clusters of all rows, largest first.

    Parts are runs of the order of ids. Each is clustered by diameter; its
    largest cluster is broken up and all goes once more through a tolerance
    tree. Bins of ``bin_size`` parts are joined by tolerance trees until one is
    left. Only the least id of a part's cluster goes on to later trees; the
    others are found again by a join. With only_first the parts' own clusters
    come back, with their part as ``grp``.
    """
    features = _parts(fp, m, rows_per_part, threshold, tolerance, branching, double_init)
    if only_first:
        return features
    last = _joined(features, m, bin_size, threshold, tolerance, branching)
    of = features.select(F.array_min("ids").alias("first"), "ids")
    own = last.select("ord", F.explode("ids").alias("first")).join(of, "first").groupBy("ord").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return last.drop("ids").join(own, "ord").select("ord", "n", "ls", "ids")


def round_assignments(fp: DataFrame, m: int, *, rows_per_part: int = 10_000, bin_size: int = 10, threshold: float = 0.65, tolerance: float = 0.05, branching: int = 50, double_init: bool = True) -> DataFrame:
    """``id``, ``cluster_id`` as of rounds, without gathering a cluster's ids in one row."""
    features = _parts(fp, m, rows_per_part, threshold, tolerance, branching, double_init)
    last = _joined(features, m, bin_size, threshold, tolerance, branching)
    of = features.select(F.array_min("ids").alias("first"), "ids")
    return assignments(last.select("ord", "ids")).withColumnRenamed("id", "first").join(of, "first").select(F.explode("ids").alias("id"), "cluster_id")


def _parts(fp: DataFrame, m: int, rows_per_part: int, threshold: float, tolerance: float, branching: int, double_init: bool) -> DataFrame:
    """Features of each part (grp)."""
    first, second = criterion("diameter", threshold), criterion("tolerance", threshold, tolerance)

    def start(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        singles = _singles(t["id"].to_pylist(), t["on"].to_pylist(), m)
        found = fit(singles, m, first, branching)
        if double_init and found:
            mine = set(found[0].ids)
            again = [f for f in singles if f.ids[0] in mine]
            found = fit([*by_class(found[1:]), *again], m, second, branching)
        return _table(by_class(found), grp=key[0])

    rows, _ = ranked_by(fp.select("id", "on"), "id")
    parts = rows.select(F.floor(F.col("rank") / rows_per_part).alias("grp"), "id", "on")
    return materialize(parts.groupBy("grp").applyInArrow(start, f"grp long, {FEATURES}"), "round-1")


def _joined(features: DataFrame, m: int, bin_size: int, threshold: float, tolerance: float, branching: int) -> DataFrame:
    """The last tree's features; their ids are the least ones of the parts' clusters."""
    second = criterion("tolerance", threshold, tolerance)
    left = (features.agg(F.max("grp")).first()[0] or 0) + 1
    features = features.withColumn("ids", F.array(F.array_min("ids")))
    turn = 2
    while True:
        features = materialize(clustered(_queued(features, bin_size), m, second, branching, "grp"), f"round-{turn}")
        left, turn = -(-left // bin_size), turn + 1
        if left <= 1:
            return features.drop("grp")


def assignments(clusters: DataFrame) -> DataFrame:
    """``id``, ``cluster_id`` from 1 on, the largest cluster first, as the clusters of one tree are numbered."""
    return clusters.select((F.col("ord") + 1).alias("cluster_id"), F.explode("ids").alias("id")).select("id", "cluster_id")


def halves(fp: DataFrame, m: int) -> DataFrame:
    """``id``, ``half``: the sides that a node holding these objects would split into. For as many as a node has."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        bits = np.array([f.bits for f in _singles(t["id"].to_pylist(), t["on"].to_pylist(), m)])
        pole, one, two = poles(bits)
        left = (one > two) | (np.arange(len(bits)) == pole)
        return pa.table({"id": t["id"], "half": pa.array(np.where(left, "left", "right"))})

    return fp.select("id", "on", F.lit(0).alias("one")).groupBy("one").applyInArrow(lambda t: run(t), "id long, half string")


def checked(clusters: DataFrame, threshold: float) -> DataFrame:
    """``bit``, ``total``, ``objects``, ``ids``, ``similar``: column sums, sizes and different ids over all clusters, and whether sets of several objects keep the threshold."""
    n = F.col("n").cast("double")
    one = F.aggregate("ls", F.lit(0.0), lambda acc, x: acc + x)
    two = F.aggregate("ls", F.lit(0.0), lambda acc, x: acc + x * x)
    shared = (two - one) / 2
    rows = clusters.select("n", "ls", "ids", ((F.col("n") < 2) | (F.try_divide(shared, shared + n * one - two) >= threshold)).alias("good"))
    whole = rows.agg(F.sum("n").alias("objects"), F.coalesce(F.bool_and("good"), F.lit(False)).alias("similar"))
    ids = rows.select(F.explode("ids").alias("id")).agg(F.countDistinct("id").alias("ids"))
    sums = rows.select(F.posexplode("ls").alias("bit", "x")).groupBy("bit").agg(F.sum("x").alias("total"))
    # one row each
    return sums.join(F.broadcast(whole)).join(F.broadcast(ids)).select("bit", "total", "objects", "ids", "similar")


def complete(found: DataFrame, fp: DataFrame) -> bool:
    """Whether every object has a cluster."""
    return fp.select("id").join(found.select("id"), "id", "left_anti").isEmpty()


def centroids(clusters: DataFrame) -> DataFrame:
    """Clusters with ``on``, the bits that at least half of their objects have."""
    return clusters.withColumn("on", F.array_compact(F.transform("ls", lambda x, i: F.when(x * 2 >= F.col("n"), i))))


def largest_broken_up(clusters: DataFrame, fp: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """All clusters but the largest, and the largest one's objects as features of their own."""
    from ..model import to_dense

    top = clusters.orderBy(F.desc("n"), "ord").limit(1)
    rest = clusters.join(top.select("ord"), "ord", "left_anti")
    ids = top.select(F.explode("ids").alias("id"))
    singles = fp.join(ids, "id", "left_semi").select(F.lit(1).cast("long").alias("n"), to_dense(F.col("on"), m).cast("array<long>").alias("ls"), F.array("id").alias("ids"))
    return rest, singles
