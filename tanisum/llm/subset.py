"""A varied subset: a cluster-feature tree a task, Ward linkage over the entries, one record a group.

Each task absorbs its rows into the leaf entries of a cluster-feature tree.
Trees of all tasks are merged into one of bounded size, whose entries lead
entries to cells; cells that are still too large are divided again the same
way. Ward linkage merges the entries of a cell; the cheapest merges over all
cells are taken until the wanted number of groups is left. An entry weighs
log2(1 + its records), so large groups and often repeated records get no more
than their due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .cftree import Tree
from .pieces import distinct_sets, mix64, pieces
from .quantize import DIM, nearest, project

#: Entries a summary keeps: at least LEAST, and FACTOR for each record wanted of those it has seen.
LEAST, FACTOR = 1024, 5
#: Rows after which a task begins another summary, which bounds its memory.
ROWS = 200_000
#: Most entries that Ward linkage takes at once.
CELL = 3000
#: Entries of one block of a cell when the cell is divided, and parts it is divided into: the whole table, other cells.
BLOCK, PARTS, FEWER = 20_000, 1024, 64
#: Groups that are left, for each one wanted, before groups of all cells meet again.
SPARE = 2
#: Divided cells whose centres are broadcast (12 MB); more are joined by shuffle.
SMALL = 500


class Summary:
    """The tree of a task's rows and the entry of each row seen."""

    def __init__(self, share: float):
        self.share, self.seen, self.tree = share, 0, Tree(DIM)
        self.place = np.zeros(0, np.int64)

    def add(self, x: np.ndarray, n: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        """Vectors, how many rows have each, and the vector of each row."""
        n = np.ones(len(x)) if n is None else n.astype(np.float64)
        self.seen += int(n.sum())
        at = self.tree.insert(x * n[:, None].astype(np.float32), n, n * (x.astype(np.float64) ** 2).sum(1))
        self.place = np.concatenate([self.place, at if of is None else at[of]])
        most = max(LEAST, int(FACTOR * self.share * self.seen))
        if self.tree.count > 2 * most:
            self.place = self.tree.condense(most)[self.place]


def _sums(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, DIM)


def _packed(total: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in total.astype(np.float64)], pa.binary())


def _merged(t: pa.Table, parts: int) -> pa.Table:
    """Summaries merged into a tree, and as many of its nodes as ``parts`` allows."""
    n, total = t["n"].to_numpy().astype(np.float64), _sums(t["total"])
    tree = Tree(DIM)
    mean = (total / n[:, None]).astype(np.float64)
    # a summary of unknown spread counts as if all of it were at its centre
    tree.insert(total.astype(np.float32), n, n * (mean**2).sum(1))
    tree.condense(parts)
    return pa.table({"n": pa.array(tree.n), "total": _packed(tree.total)})


def _nearest_part(cell: np.ndarray, x: np.ndarray, centers: dict[int, np.ndarray], turn: int) -> np.ndarray:
    """The part of its cell that each vector is in; cells without centres stay."""
    out = cell.copy()
    for c in np.unique(cell):
        if int(c) in centers:
            rows = np.flatnonzero(cell == c)
            at, _ = nearest(x[rows].astype(np.float32), centers[int(c)])
            key = mix64(np.array([c], np.int64).view(np.uint64), 50 + turn) + at.astype(np.uint64)
            out[rows] = (mix64(key, 51) >> np.uint64(1)).view(np.int64)
    return out


def _divided(entries: DataFrame) -> DataFrame:
    """Entries (entry, n, w, total) with a ``cell`` of at most CELL entries, neighbours in the same one.

    Blocks of a large cell are summarised by trees, whose nodes merge into one
    tree; its entries are the parts' centres. Cells whose entries no centres
    tell apart are cut by a hash.
    """
    spark = entries.sparkSession
    entries = entries.withColumn("cell", F.lit(0).cast("long"))
    kind = "entry long, n long, w double, total binary, cell long"
    last, turn = None, 0
    while True:
        sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
        sizes = materialize(sizes, "cells")
        left = sizes.agg(F.count(F.lit(1)).alias("cells"), F.sum("size").alias("entries"), (F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("usual")).first()
        if not left["cells"]:
            return entries
        # two numbers a cell
        sizes = F.broadcast(sizes) if left["cells"] <= 100_000 else sizes
        if last is not None and left["usual"] > 0.9 * last:
            part = F.xxhash64("cell", F.pmod(F.xxhash64("entry"), F.ceil(F.col("size") / CELL * 1.2)))
            part = F.when(F.col("size").isNull(), F.col("cell")).otherwise(part)
            entries = materialize(entries.join(sizes, "cell", "left").select("entry", "n", "w", "total", part.alias("cell")), "celled")
            last, turn = None, turn + 1
            continue
        last, parts = left["usual"], PARTS if turn == 0 else FEWER
        large = entries.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("entry"), F.ceil(F.col("size") / BLOCK)))
        width = max(1, min(4096, 2 * left["entries"] // BLOCK + left["cells"]))

        def merged(key: tuple, t: pa.Table) -> pa.Table:
            size = t["size"][0].as_py()
            got = _merged(t, max(2, min(parts, -(-size // (CELL // 3)))))
            return got.append_column("cell", pa.array([key[0].as_py()] * len(got), pa.int64())).append_column("size", pa.array([size] * len(got), pa.int64()))

        schema = "n double, total binary, cell long, size long"
        tops = materialize(large.repartition(width, "cell", "block").groupBy("cell", "block").applyInArrow(merged, schema), "tops")
        # summaries of a cell's blocks are merged BLOCK at a time until one tree can take them all
        while (most := tops.groupBy("cell").count().agg(F.max("count")).first()[0] or 0) > BLOCK:
            salted = tops.withColumn("block", F.pmod(F.xxhash64("total"), F.lit(-(-most // BLOCK))))
            tops = materialize(salted.groupBy("cell", "block").applyInArrow(merged, schema), "tops")
        centers = materialize(tops.repartition(min(width, left["cells"]), "cell").groupBy("cell").applyInArrow(merged, schema), "centers")
        if left["cells"] <= SMALL:
            held: dict[int, list] = {}
            for r in centers.toLocalIterator():
                held.setdefault(r["cell"], []).append(np.frombuffer(r["total"]) / r["n"])
            known = spark.sparkContext.broadcast({c: np.array(v, np.float32) for c, v in held.items()})

            def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = _sums(b.column("total")) / b.column("n").to_numpy()[:, None]
                    at = _nearest_part(b.column("cell").to_numpy(), x, known.value, turn)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("entry", "n", "w", "total")), pa.array(at)], names=["entry", "n", "w", "total", "cell"])

            entries = materialize(entries.select("entry", "n", "w", "total", "cell").mapInArrow(placed, kind), "celled")
        else:
            small = entries.join(sizes.select("cell"), "cell", "left_anti").select("entry", "n", "w", "total", "cell")
            spread = centers.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1)))

            def parted(key: tuple, rows: pa.Table, ways: pa.Table) -> pa.Table:
                c = {key[0].as_py(): (_sums(ways["total"]) / ways["n"].to_numpy()[:, None]).astype(np.float32)}
                at = _nearest_part(rows["cell"].to_numpy(), _sums(rows["total"]) / rows["n"].to_numpy()[:, None], c, turn)
                return pa.table({c: rows[c] for c in ("entry", "n", "w", "total")} | {"cell": pa.array(at)})

            divided = large.groupBy("cell", "block").cogroup(spread.groupBy("cell", "block")).applyInArrow(parted, kind)
            entries = materialize(small.unionByName(divided), "celled")
        turn += 1


def ward(centers: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, a, b) of Ward linkage by nearest-neighbour chains, ascending; b joins a."""
    m = len(centers)
    x = centers.astype(np.float64)
    sq = (x**2).sum(1)
    w = weight.astype(np.float64)
    d = sq[:, None] + sq[None] - 2 * x @ x.T
    d = np.maximum(d, 0) * (w[:, None] * w[None] / (w[:, None] + w[None]))
    np.fill_diagonal(d, np.inf)
    alive = np.ones(m, bool)
    out: list[tuple[float, int, int]] = []
    chain: list[int] = []
    at = 0
    for _ in range(m - 1):
        if not chain:
            while not alive[at]:
                at += 1
            chain = [at]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        h = float(d[a, b])
        out.append((h, a, b))
        # Lance-Williams update for Ward
        row = ((w[a] + w) * d[a] + (w[b] + w) * d[b] - w * h) / (w[a] + w[b] + w)
        row[~alive] = np.inf
        row[a] = row[b] = np.inf
        w[a] += w[b]
        alive[b] = False
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        if chain and not alive[chain[-1]]:
            chain = [c for c in chain if alive[c]]
    # a merge never costs less than those that made its parts
    return sorted(out, key=lambda t: t[0])


def _edge(rows: DataFrame, value: str, wanted: int, rounds: int) -> tuple[float, float, int]:
    """Ends of a narrow range that holds the ``wanted``-th least value, and how many values are below it."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    bins, below = 4096, 0
    if low is None:
        return 0.0, 0.0, 0
    for _ in range(rounds):
        if high <= low:
            break
        width = (high - low) / bins
        inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
        at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
        run, got = below, {r["b"]: r["n"] for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(got):
            if run + got[b] >= wanted:
                low, high, below = low + b * width, low + (b + 1) * width, run
                break
            run += got[b]
        else:
            break
        if got[b] == 1:
            break
    return low, high, rows.where(F.col(value) < low).count()


def _cut(trees: DataFrame, merges: int) -> Column:
    """Which merges are among the cheapest ``merges`` of all, ties by a hash."""
    if merges <= 0:
        return F.lit(False)
    low, high, below = _edge(trees, "height", merges, 4)
    sure, edge = F.col("height") < low, (F.col("height") >= low) & (F.col("height") <= high)
    ties = trees.where(edge)
    if ties.count() <= merges - below:
        return sure | edge
    place = F.pmod(F.xxhash64("cell", "step"), F.lit(1 << 52)).cast("double")
    first, last, under = _edge(ties.select(place.alias("place")), "place", merges - below, 5)
    return sure | (edge & ((place < first) if under >= merges - below else (place <= last)))


def _agglomerated(entries: DataFrame, number: int, k: int) -> DataFrame:
    """Entries (entry, n, w, total) with the group (grp) that the cheapest merges put them in, k groups in all, and the group's n, w and total."""
    entries = _divided(entries).repartition(max(1, min(4096, 3 * number // CELL)), "cell")

    def linked(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("entry")
        merges = ward(_sums(t["total"]) / t["n"].to_numpy()[:, None], t["w"].to_numpy())
        m = len(merges)
        return pa.table({"cell": pa.array([key[0].as_py()] * m, pa.int64()), "height": pa.array([x[0] for x in merges], pa.float64()), "step": pa.array(range(m), pa.int64()), "a": pa.array(t["entry"].to_numpy()[[x[1] for x in merges]] if m else [], pa.int64()), "b": pa.array(t["entry"].to_numpy()[[x[2] for x in merges]] if m else [], pa.int64())})

    trees = materialize(entries.groupBy("cell").applyInArrow(linked, "cell long, height double, step long, a long, b long"), "ward")
    taken = trees.where(_cut(trees, number - k))

    def grouped(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("entry")
        entry = left["entry"].to_numpy()
        right = right.sort_by("step")
        root = np.arange(len(entry))
        a, b = np.searchsorted(entry, right["a"].to_numpy()), np.searchsorted(entry, right["b"].to_numpy())

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        while (root[root] != root).any():
            root = root[root]
        n, w, total = np.zeros(len(entry), np.int64), np.zeros(len(entry)), np.zeros((len(entry), DIM))
        for out, values in ((n, left["n"].to_numpy()), (w, left["w"].to_numpy()), (total, _sums(left["total"]))):
            np.add.at(out, root, values)
        return pa.table({"entry": entry, "grp": entry[root], "n": n[root], "w": w[root], "total": _packed(total[root])})

    return entries.groupBy("cell").cogroup(taken.groupBy("cell")).applyInArrow(grouped, "entry long, grp long, n long, w double, total binary")


def varied_subset(df: DataFrame, *, id_col: str, text_col: str, share: float = 0.01) -> DataFrame:
    """``id`` of the chosen records and ``n_group``, the records each stands for.

    Chooses round(share * records with pieces), at least one if there is any;
    fewer only if fewer different records exist. Rows with a null id or text,
    or without pieces, are left out; repeated rows count as records; other
    columns aren't read; an empty table gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    schema = pa.schema([("kind", pa.int32()), ("entry", pa.int64()), ("n", pa.int64()), ("total", pa.binary()), ("id", pa.int64()), ("text", pa.string())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        summary, ids, texts = Summary(share), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            all_ids, all_texts = np.concatenate(ids), [t for part in texts for t in part]
            entry = base + summary.place
            for lo in range(0, len(entry), 10_000):
                k = len(entry[lo : lo + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(entry[lo : lo + k]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(all_ids[lo : lo + k]), pa.array(all_texts[lo : lo + k], pa.string())], schema=schema)
            tree = summary.tree
            for lo in range(0, tree.count, 2000):
                n = tree.n[lo : lo + 2000].astype(np.int64)
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(base + lo + np.arange(k)), pa.array(n), _packed(tree.total[lo : lo + k]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], schema=schema)

        for b in batches:
            text = b.column("text").to_pylist()
            id_ = b.column("id").to_numpy()
            for lo in range(0, len(text), 4096):
                sets = pieces(text[lo : lo + 4096])
                some = np.flatnonzero(sets.sizes > 0)
                if not len(some):
                    continue
                sets = sets.take(some)
                rep, of = distinct_sets(sets)
                one = sets.take(rep)
                summary.add(project(one) / np.sqrt(one.sizes)[:, None].astype(np.float32), np.bincount(of), of)
                ids.append(id_[lo + some])
                texts.append([text[lo + i] for i in some])
                if summary.seen >= ROWS:
                    yield from flush()
                    base += summary.tree.count
                    summary, ids, texts = Summary(share), [], []
        if ids:
            yield from flush()

    made = materialize(rows.mapInArrow(summarise, "kind int, entry long, n long, total binary, id long, text string"), "entries")
    entries = made.where("kind = 0").select("entry", "n", "total")
    got = entries.agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("records")).first()
    empty = df.sparkSession.createDataFrame([], "id long, n_group long")
    if not got["entries"]:
        return empty
    k = max(1, round(share * got["records"]))
    entries = entries.withColumn("w", F.log2(1 + F.col("n")))
    more = SPARE * k
    if got["entries"] > 2 * more:
        # groups of all cells meet once more in fewer cells, so that what lies on both sides of a border can merge
        first = materialize(_agglomerated(entries, got["entries"], more), "groups")
        groups = first.where("entry = grp").drop("grp")
        last = _agglomerated(groups, more, k).withColumnRenamed("entry", "part")
        groups = first.select("entry", F.col("grp").alias("part")).join(last, "part").drop("part")
    else:
        groups = _agglomerated(entries, got["entries"], k)
    groups = groups.select("entry", "grp", F.col("n").alias("n_group"), "total")
    members = made.where("kind = 1").select("entry", "id", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pieces(b.column("text").to_pylist())
            rep, of = distinct_sets(sets)
            x = (project(sets.take(rep)) / np.sqrt(np.maximum(sets.sizes[rep], 1))[:, None].astype(np.float32))[of]
            mean = (_sums(b.column("total")) / b.column("n_group").to_numpy()[:, None]).astype(np.float32)
            apart = ((x - mean) ** 2).sum(1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("n_group"), b.column("id"), pa.array(np.round(apart, 6))], names=["grp", "n_group", "id", "apart"])

    near = members.join(groups, "entry").select("grp", "n_group", "id", "text", "total").mapInArrow(measured, "grp long, n_group long, id long, apart double")
    best = near.groupBy("grp").agg(F.min(F.struct("apart", "id")).alias("best"), F.max("n_group").alias("n_group"))
    return best.select(F.col("best.id").alias("id"), "n_group")
