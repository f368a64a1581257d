"""The most similar records for every record, by additive quantisation.

Piece vectors are projected, encoded by beam search over residual codebooks
fitted on a bounded sample, and kept as codes with the norms of their sums. A
query scores the codes of the rows in the cells nearest to it by lookup tables;
the best of them are ranked again by exact similarity. Copies share one code and are told
apart after ranking, so they cost no places.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cells import Cells, deepened
from .pieces import Bits, Sets, dense_ids, distinct_sets, pieces, set_hashes
from .quantize import Codebooks, encode, project, train
from .routing import SMALL, with_blocks

#: Rows of a cell of a large key, on average.
CELL_ROWS = 200
#: Scores that are made at a time.
SCORES = 2_000_000

SCHEMA = "id long, neighbour long, similarity double"


class Index(NamedTuple):
    """What every task needs: codebooks, and the cells whose rows a query looks at."""

    books: Codebooks
    cells: Cells


def unit(sets: Sets) -> np.ndarray:
    x = project(sets)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _shortlists(x: np.ndarray, codes: np.ndarray, norms: np.ndarray, cb: Codebooks, mine: np.ndarray, near: np.ndarray, size: int):
    """Chunks of rows and their ``size`` candidates (-1: none) of least estimated distance.

    mine: list of each row, -1 where it can't be found; near: lists each row looks at.
    """
    books, words, _ = cb.words.shape
    order = np.argsort(mine, kind="stable")
    start = np.searchsorted(mine[order], np.arange(int(max(mine.max(initial=0), near.max(initial=0))) + 2))
    number = np.diff(start)
    # in the order of lists, whose rows are read one after another
    offsets = np.ascontiguousarray((codes[order] + np.arange(books) * words).astype(np.int32).T)
    length = norms[order]
    count = number[near].sum(1)
    asks = np.argsort(count, kind="stable")
    asks = asks[count[asks] > 0]
    lo = 0
    while lo < len(asks):
        # rows with about as many candidates
        hi = lo + max(1, int(SCORES // max(1, count[asks[min(len(asks) - 1, lo + 4096)]])))
        rows = asks[lo : min(hi, lo + 4096)]
        lo += len(rows)
        width = number[near[rows]]
        each = width.sum(1)
        total = np.repeat(start[near[rows]].ravel(), width.ravel())
        begin = np.cumsum(width.ravel()) - width.ravel()
        at = total + np.arange(len(total)) - np.repeat(begin, width.ravel())
        who = np.repeat(np.arange(len(rows)), each)
        table = (-2 * (x[rows] @ cb.flat.T)).ravel()
        score = length[at]
        base = (who * (books * words)).astype(np.int32)
        for m in range(books):
            score += table[base + offsets[m][at]]
        most = int(each.max())
        place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        k = min(size, most)
        cand = np.full((len(rows), most), -1, np.int32)
        cand[who, place] = at
        if most > k:
            grid = np.full((len(rows), most), np.inf, np.float32)
            grid[who, place] = score
            cand = np.take_along_axis(cand, np.argpartition(grid, k - 1, axis=1)[:, :k], 1)
        yield rows, np.where(cand >= 0, order[cand], -1)


def neighbour_rows(own: Sets, raw: Sets, index: Index, k: int, least: float, first_id: np.ndarray, lists: int, size: int, db: np.ndarray | None = None):
    """Best k other rows of each distinct set by (similarity down, first_id up): row, neighbour, similarity.

    db: rows that may be found, by all others and without cells; otherwise all may, through the ``lists`` nearest cells.
    """
    x = unit(raw)
    codes, norms = encode(x, index.books)
    bits = Bits(own, int(own.tokens.max(initial=0)) + 1)
    if db is None:
        near = index.cells.nearest(x, lists)
        mine = near[:, 0]
    else:
        near, mine = np.zeros((len(x), 1), np.int64), np.where(db, 0, -1)
    out = []
    for rows, cand in _shortlists(x, codes, norms, index.books, mine, near, size):
        a, b = np.repeat(rows, cand.shape[1]), cand.ravel()
        a, b = a[b >= 0], b[b >= 0]
        na, nb = own.sizes[a], own.sizes[b]
        keep = (a != b) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9)
        a, b = a[keep], b[keep]
        s = bits.similarity(a, b)
        good = (s >= least) & (s > 0)
        out.append((a[good], b[good], s[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
    if db is None:
        # who finds a row is also found by it
        n = np.int64(len(x))
        code, at = np.unique(np.concatenate([a * n + b, b * n + a]), return_index=True)
        a, b, s = code // n, code % n, np.concatenate([s, s])[at]
    o = np.lexsort((first_id[b], -s, a))
    a, b, s = a[o], b[o], s[o]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[top], b[top], s[top]


def search_block(strings: list[str | None], ids: np.ndarray, index: Index, k: int, least: float, lists: int, size: int):
    """k best neighbours of every record among the others: id, neighbour, similarity."""
    sets = pieces(strings)
    some = np.flatnonzero(sets.sizes > 0)
    sets, ids = sets.take(some), ids[some]
    o = np.argsort(ids, kind="stable")
    sets, ids = sets.take(o), ids[o]
    rep, group = distinct_sets(sets)
    if not len(rep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    raw = sets.take(rep)
    own, _ = dense_ids(raw)
    members = np.argsort(group, kind="stable")  # ids ascend within a group
    off = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(rep)))])
    a, b, s = neighbour_rows(own, raw, index, k, least, ids[members[off[:-1]]], lists, size)
    # a set's own records come first; k + 1 of a set's records are all a query can keep
    every = np.arange(len(rep))
    a, b, s = np.concatenate([every, a]), np.concatenate([every, b]), np.concatenate([np.ones(len(rep)), s])
    c = np.minimum(off[b + 1] - off[b], k + 1)
    src = np.repeat(np.arange(len(b)), c)
    nb = ids[members[off[b[src]] + np.arange(len(src)) - np.repeat(np.cumsum(c) - c, c)]]
    a, s = a[src], s[src]
    o = np.lexsort((nb, -s, a))
    a, nb, s = a[o], nb[o], s[o]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    a, nb, s = a[rank <= k], nb[rank <= k], s[rank <= k]
    at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(rep)))])
    c = np.diff(at)[group]
    rec = np.repeat(np.arange(len(ids)), c)
    j = at[group[rec]] + np.arange(len(rec)) - np.repeat(np.cumsum(c) - c, c)
    rec, nb, s = rec[ids[rec] != nb[j]], nb[j][ids[rec] != nb[j]], s[j][ids[rec] != nb[j]]
    top = np.arange(len(rec)) - np.searchsorted(rec, rec) < k
    return ids[rec[top]], nb[top], s[top]


def fit(rows: DataFrame, sample_rows: int, books: int, words: int, coarse: int) -> tuple[Index, np.ndarray]:
    """Codebooks and cells from the sample_rows rows of least hash of their id (or all), and their vectors."""
    n = rows.count()
    share = min(1.0, 1.2 * (sample_rows + 100) / max(1, n))
    order = F.xxhash64("id", F.lit(5))
    picked = rows.where(F.pmod(order, F.lit(1_000_000)) <= int(share * 1_000_000)).select("text", order.alias("h")).orderBy("h", "text").limit(sample_rows)
    sets = pieces([r["text"] for r in picked.collect()])
    x = unit(sets.take(np.flatnonzero(sets.sizes > 0)))
    first = train(x, 1, max(1, min(coarse, len(x) // 4)), 6).words[0]
    return Index(train(x, books, words), Cells((first,))), x


def _large(rows: DataFrame, index: Index, k: int, least: float, lists: int, size: int, block_rows: int) -> DataFrame:
    """Neighbours within keys of any size: equal sets are searched once, in the cells that they and their neighbours are in."""
    spark = rows.sparkSession
    by_type = dict(rows.dtypes)["by"]
    known = spark.sparkContext.broadcast(index)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pieces(b.column("text").to_pylist())
            one, two = (h.view(np.int64) for h in set_hashes(sets))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(one), pa.array(two)], names=["by", "id", "text", "h1", "h2"]).filter(pa.array(sets.sizes > 0))

    key = ["by", "h1", "h2"]
    members = rows.select("by", "id", "text").dropDuplicates(["by", "id"]).mapInArrow(hashed, f"by {by_type}, id long, text string, h1 long, h2 long")
    members = materialize(members, "members")
    # a query keeps no more than k + 1 records of a set
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    ids = members.select(*key, "id").withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sets_ = members.groupBy(*key).agg(F.min("text").alias("text"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    sets_ = materialize(sets_, "sets")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = known.value.cells.nearest(unit(pieces(b.column("text").to_pylist())), lists)
            w = near.shape[1]
            # as one that may be found, in its own cell; as one that asks, in all
            at = pa.array(np.concatenate([np.arange(len(near)), np.repeat(np.arange(len(near)), w)]))
            role = np.concatenate([np.ones(len(near), np.int32), np.zeros(w * len(near), np.int32)])
            cell = np.concatenate([near[:, 0], near.ravel()])
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(cell), pa.array(role)], names=[*b.schema.names, "cell", "db"])

    spread = sets_.select(*key, "first", "text").mapInArrow(placed, f"by {by_type}, h1 long, h2 long, first long, text string, cell long, db int")
    spread = materialize(spread, "cells")
    # cells of many rows are cut into blocks of those that ask by blocks of those that may be found
    sizes = spread.groupBy("by", "cell").agg(F.sum("db").alias("d"), F.sum(1 - F.col("db")).alias("q"))
    big = sizes.where((F.col("d") > block_rows) | (F.col("q") > block_rows)).select("by", "cell", F.ceil(F.col("d") / block_rows).alias("d"), F.ceil(F.col("q") / block_rows).alias("q"))
    spread = spread.join(F.broadcast(big) if big.limit(SMALL + 1).count() <= SMALL else big, ["by", "cell"], "left").na.fill(1, ["d", "q"])
    at = F.xxhash64("h1", "h2")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1)
    mine = lambda n: F.array(F.pmod(at, F.greatest(F.col(n), F.lit(1))))
    spread = spread.withColumn("c1", F.explode(F.when(F.col("db") == 1, mine("d")).otherwise(every("d")))).withColumn("c2", F.explode(F.when(F.col("db") == 1, every("q")).otherwise(mine("q"))))

    def search(key: tuple, t: pa.Table) -> pa.Table:
        h1, h2, first, db = (t[c].to_numpy() for c in ("h1", "h2", "first", "db"))
        raw = pieces(t["text"].to_pylist())
        own, _ = dense_ids(raw)
        db = db == 1
        a, b, s = neighbour_rows(own, raw, known.value, k + 1, least, first, lists, size, db) if db.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ask = ~db[a] & ((h1[a] != h1[b]) | (h2[a] != h2[b]))
        a, b, s = a[ask], b[ask], s[ask]
        return pa.table({"by": t["by"].take(pa.array(a)), "h1": h1[a], "h2": h2[a], "n1": h1[b], "n2": h2[b], "first": first[b], "similarity": s})

    grouped = spread.select("by", "cell", "c1", "c2", "h1", "h2", "first", "text", "db").groupBy("by", "cell", "c1", "c2")
    found = grouped.applyInArrow(search, f"by {by_type}, h1 long, h2 long, n1 long, n2 long, first long, similarity double")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("similarity"), "first"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select(*key, "n1", "n2", "similarity")
    same = sets_.where("n > 1").select(*key, F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.lit(1.0).alias("similarity"))
    found = found.unionByName(same).join(ids.select("by", F.col("h1").alias("n1"), F.col("h2").alias("n2"), "ids"), ["by", "n1", "n2"])
    # at most (k + 1)^2 rows a set
    best = found.select(*key, "similarity", F.explode("ids").alias("neighbour")).groupBy(*key).agg(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour")).alias("best"))
    best = best.join(sets_.select(*key, "n"), key).select(*key, F.slice(F.sort_array("best"), 1, k + 1).alias("best"), F.ceil(F.col("n") / block_rows).alias("parts"))
    # sets with many records, some at a time
    hot = sets_.where(F.col("n") > block_rows).select(*key, F.ceil(F.col("n") / block_rows).alias("parts"))
    hot = F.broadcast(hot) if hot.limit(SMALL + 1).count() <= SMALL else hot
    who = members.select(*key, "id").join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0).cast("long"))).drop("parts")
    best = best.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    got = who.join(best, [*key, "part"]).select("id", F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("best"))
    return got.select("id", F.explode("best").alias("b")).select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.s")).alias("similarity"))


def nearest_records(
    df: DataFrame,
    *,
    id_col: str,
    text_col: str,
    by: str,
    k: int = 5,
    min_similarity: float = 0.0,
    sample_rows: int = 8000,
    books: int = 8,
    words: int = 64,
    coarse: int = 256,
    lists: int = 20,
    shortlist: int = 128,
    block_rows: int = 24_000,
) -> DataFrame:
    """Rows ``id``, ``neighbour``, ``similarity``: the k most similar other records with equal ``by``.

    Ranked by similarity of the piece sets, then by the neighbour's id. Records
    below ``min_similarity``, or without a shared piece, are no neighbours.
    Rows with a null id, ``by`` or text, or without pieces, take no part; ids
    should be unique, rows that repeat one count once. Other columns aren't
    read. The index is approximate: a neighbour outside the ``lists`` nearest
    of ``coarse`` cells, or the ``shortlist`` best codes in them, is missed if
    it misses the record too; every row is indexed. A value of ``by`` with more
    than ``block_rows`` rows gets finer cells, about one for 200 rows, and its rows are sent to the
    cells they look at, of each of which the best quarter of ``shortlist``
    codes are ranked again, so its work grows with its rows. Empty tables give an
    empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(by).alias("by"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and by is not null and text is not null")
    sc = rows.sparkSession.sparkContext
    fitted, sample = fit(rows, sample_rows, books, words, coarse)
    index = sc.broadcast(fitted)

    def search(key: tuple, t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        at = np.unique(ids, return_index=True)[1]
        text = t["text"].to_pylist()
        a, b, s = search_block([text[i] for i in at], ids[at], index.value, k, min_similarity, lists, shortlist)
        return pa.table({"id": pa.array(a, pa.int64()), "neighbour": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    blocked, width, cut = with_blocks(rows, "by", "id", block_rows)
    whole = blocked.where("blocks = 1").select("id", "by", "text").repartition(width, "by")
    found = whole.groupBy("by").applyInArrow(search, SCHEMA)
    if not cut:
        return found
    large = blocked.where("blocks > 1")
    most = large.groupBy("by").count().agg(F.max("count")).first()[0]
    fine = fitted._replace(cells=deepened(sample, fitted.cells.levels[0], most, CELL_ROWS))
    return found.unionByName(_large(large.select("by", "id", "text"), fine, k, min_similarity, lists, max(k + 1, shortlist // 4), block_rows))
