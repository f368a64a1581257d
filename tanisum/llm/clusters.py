"""Groups of similar records: components of exact links.

Sets that are similar enough differ in few tokens, so in no more of the
parities of their tokens by hashed bucket. Within a block, products of parity
rows leave out the pairs that differ in too many; the others are checked
exactly unless they are in one component already. Sets too long for that, and
keys too large for a block, meet under their first shared rare tokens, as in
``simjoin``. So no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import components, roots
from .pieces import Bits, Sets, dense_ids, distinct_sets, pieces, token_buckets
from .quantize import DIM, project
from .routing import SMALL, join_hot, with_blocks
from .simjoin import linked_rows, routed_sets

#: Records of a set, or of a group, that are handled in one task.
MEMBERS = 10_000
#: Parities of a set, and rows that are compared with as many others at a time.
PARITIES, TILE = 256, 2048
#: Pairs that are checked at a time.
CHECKED = 500_000


def _rows(df: DataFrame, id_col: str, text_col: str, by: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(by).alias("by"), F.col(text_col).alias("text"))
    return rows.where("id is not null and by is not null and text is not null")


def _few_apart(sets: Sets, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of row pairs, all those among them that can have similarity >= t."""
    n = sets.sizes
    order = np.argsort(n, kind="stable")
    sets, n = sets.take(order), n[order]
    parity = np.zeros((len(n), PARITIES), np.float32)
    for lo in range(0, len(n), TILE):
        part = sets.take(np.arange(lo, min(len(n), lo + TILE)))
        spots = part.rows * PARITIES + token_buckets(part.tokens, PARITIES)
        parity[lo : lo + TILE] = np.bincount(spots, minlength=len(part.sizes) * PARITIES).reshape(-1, PARITIES) & 1
    # apart <= (na + nb) (1 - t) / (1 + t), and at least |pa| + |pb| - 2 pa.pb
    need = ((parity.sum(1) - n * ((1 - t) / (1 + t))) / 2).astype(np.float32)
    for lo in range(0, len(n), TILE):
        hi = min(len(n), lo + TILE)
        end = int(np.searchsorted(n, n[hi - 1] / t + 1e-6, side="right"))
        for lo2 in range(lo, end, TILE):
            hi2 = min(end, lo2 + TILE)
            both = parity[lo:hi] @ parity[lo2:hi2].T
            both -= need[lo2:hi2]
            i, j = np.divmod(np.flatnonzero(both >= need[lo:hi, None] - 1e-2), hi2 - lo2)
            if lo == lo2:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), CHECKED):
                yield order[i[k : k + CHECKED] + lo], order[j[k : k + CHECKED] + lo2]


def linked_block(sets: Sets, t: float) -> np.ndarray:
    """Least member of each row's component, where distinct rank-ordered sets of similarity >= t are linked."""
    n = sets.sizes
    # longer sets differ in most parities that there are, similar or not
    most = PARITIES * (1 + t) / (6 * max(1 - t, 1e-9))
    short = np.flatnonzero(n <= most)
    bits = Bits(sets, int(sets.tokens.max(initial=0)) + 1)
    root = np.arange(len(n))
    for a, b in _few_apart(sets.take(short), t):
        a, b = short[a], short[b]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        link = bits.similarity(a, b) >= t
        if link.any():
            root = roots(len(n), root[a[link]], root[b[link]])[root]
    if len(short) < len(n):
        near = np.flatnonzero(n >= t * most - 1e-6)
        own = near[linked_rows(sets.take(near), t)]
        root = roots(len(n), np.concatenate([np.arange(len(n)), near]), np.concatenate([root, own]))
    return root


def link_block(strings: list[str | None], ids: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its group) for every record of a block that has company."""
    sets = pieces(strings)
    some = np.flatnonzero(sets.sizes > 0)
    some = some[np.argsort(ids[some], kind="stable")]
    sets, ids = sets.take(some), ids[some]
    if len(ids) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rep, group = distinct_sets(sets)
    own, _ = dense_ids(sets.take(rep))
    root = linked_block(own, t)[group]
    first = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(first, root, ids)
    many = np.bincount(root, minlength=len(rep))[root] > 1
    return ids[many], first[root[many]]


def similarity_groups(df: DataFrame, *, id_col: str, text_col: str, by: str, threshold: float = 0.7, block_rows: int = 32_000) -> DataFrame:
    """``id``, ``first_id`` of every record in a group of two or more; first_id is the group's least id.

    Within a value of ``by``, records of similarity >= threshold belong
    together, as do those joined by a chain of such records. Rows with a null
    id, ``by`` or text, or without pieces, are in no group; copies are records
    of their own; other columns aren't read. No link is missed. Values of
    ``by`` with more than ``block_rows`` rows are sent out under rare tokens
    that similar records share, and their partial groups are joined over the
    whole table. Empty tables give an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = _rows(df, id_col, text_col, by)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        a, first = link_block(table["text"].to_pylist(), table["id"].to_numpy(), threshold)
        return pa.table({"id": pa.array(a, pa.int64()), "first_id": pa.array(first, pa.int64())})

    blocked, width, cut = with_blocks(rows, "by", "id", block_rows)
    whole = blocked.where("blocks = 1").select("id", "by", "text").repartition(width, "by")
    done = whole.groupBy("by").applyInArrow(link, "id long, first_id long")
    if not cut:
        return done
    return done.unionByName(_large(blocked.where("blocks > 1").select("id", "by", "text"), threshold, block_rows))


def _large(rows: DataFrame, t: float, block_rows: int) -> DataFrame:
    """Groups within keys of any size: equal sets are linked once, in the cells they meet in, and links joined to components."""
    key = ["by", "h1", "h2"]
    members, sets_, cells, opened = routed_sets(rows.withColumn("side", F.lit(0)), t, block_rows)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        sets, start = opened(table)
        ids = table["first"].to_numpy()
        root = linked_rows(sets, t, start)
        first = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(first, root, ids)
        first = first[root]
        return pa.table({"id": ids[first != ids], "first_id": first[first != ids]})

    stars = cells.groupBy("by", "cell", "c1", "c2").applyInArrow(link, "id long, first_id long")
    found = components(stars.select(F.col("id").alias("u"), F.col("first_id").alias("v")))
    found = found.unionByName(found.select(F.col("root").alias("id")).distinct().withColumn("root", F.col("id")))
    rooted = sets_.select(*key, F.col("first").alias("id"), "n").join(found, "id", "left").where("root is not null or n > 1")
    rooted = rooted.select(*key, "n", F.coalesce("root", "id").alias("first_id"))
    return join_hot(members.select(*key, "id"), rooted, key, "n", MEMBERS).select("id", "first_id").distinct()


def described(df: DataFrame, groups: DataFrame, *, id_col: str, text_col: str, typical: int = 3) -> DataFrame:
    """``first_id``, ``n`` and ``typical`` of each group: the ids nearest its centroid, nearest first.

    Groups of up to MEMBERS records are described in one task each; of larger
    ones, sums and the nearest records are taken in parts first.
    """
    dims = [f"x{i}" for i in range(DIM)]
    schema = "first_id long, n long, typical array<long>"

    def told(t: pa.Table) -> pa.RecordBatch:
        """Whole groups, sorted."""
        group, ids = t["first_id"].to_numpy(), t["id"].to_numpy()
        x = project(pieces(t["text"].to_pylist())).astype(np.float64)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        n = np.diff(np.concatenate([start, [len(group)]]))
        mean = np.repeat(np.add.reduceat(x, start, axis=0) / n[:, None], n, axis=0)
        apart = np.round(((x - mean) ** 2).sum(1), 6)
        o = np.lexsort((ids, apart, group))
        top = np.arange(len(o)) - np.repeat(start, n) < typical
        off = np.concatenate([[0], np.cumsum(np.minimum(n, typical))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(group[start]), pa.array(n), pa.ListArray.from_arrays(pa.array(off), pa.array(ids[o[top]]))], names=["first_id", "n", "typical"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            group = held["first_id"].to_numpy()
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if whole:
                yield told(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield told(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = project(pieces(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("first_id"), *[pa.array(c) for c in x.T]], names=["id", "first_id", *dims])

    text = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(groups.join(text, "id").select("id", "first_id", "text"), "grouped")
    hot = rows.groupBy("first_id").count().where(F.col("count") > MEMBERS).select("first_id")
    some = hot.limit(SMALL + 1).count()
    hot = F.broadcast(hot) if some <= SMALL else hot
    cold = rows.join(hot, "first_id", "left_anti") if some else rows
    got = cold.select("id", "first_id", "text").repartition("first_id").sortWithinPartitions("first_id", "id").mapInArrow(small, schema)
    if not some:
        return got
    vectors = rows.join(hot, "first_id", "left_semi").select("id", "first_id", "text").mapInArrow(run, "id long, first_id long, " + ", ".join(f"{c} float" for c in dims))
    means = vectors.groupBy("first_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in dims])
    apart = F.round(sum((F.col(c) - F.col(f"m{c}")) ** 2 for c in dims), 6)
    # one row a hot group
    near = vectors.join(F.broadcast(means) if some <= SMALL else means, "first_id").select("first_id", "n", "id", apart.alias("apart"))
    # the rank's limit applies before the shuffle too
    rank = F.row_number().over(Window.partitionBy("first_id").orderBy("apart", "id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= typical)
    top = near.groupBy("first_id", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("t"))
    return got.unionByName(top.select("first_id", "n", F.transform("t", lambda x: x["id"]).alias("typical")))
