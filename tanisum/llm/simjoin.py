"""All similar pairs between set-valued records: an adaptive extended-prefix join.

Every record's tokens are ordered from rare to frequent. Two sets with
similarity >= t share at least j tokens among the first
``n - ceil(t n) + j`` of each, for j = 1, 2, 3. A record is posted under each
single token of its 1-prefix where that token's list is short; where it is
long and another token is cheaper than comparing its rows, under combinations
with a second token of the 2-prefix, and where that list is long too, under
combinations of three. Two similar sets always meet
under the combination of their first shared tokens, so nothing is lost, and
frequent tokens never post alone. Meetings pass a length filter, then shared
tokens are counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import roots
from .pieces import Bits, Sets, dense_ids, distinct_sets, mix64, ordered_ids, pieces, set_hashes, token_buckets
from .routing import SMALL, cells_by_key, with_blocks

#: Lists up to this length are joined as they are; longer ones get another token.
SHORT_LIST = 300
#: Combinations that are made at a time.
EXPANDED = 1_000_000
#: Pairs of records that are made at a time.
PAIRS = 500_000


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.concatenate([start, [len(keys)]]))


class Postings(NamedTuple):
    """Rows under combinations of ``level`` tokens, sorted by key, then by before."""

    level: int
    key: np.ndarray
    #: The token next before the last one that isn't in the combination, plus 1; 0 if there is none.
    before: np.ndarray
    row: np.ndarray
    #: Place of the combination's last token in the row.
    pos: np.ndarray


def _depth(t: float) -> int:
    """Longest combinations: sets that differ share at least t / (1 - t) tokens."""
    return 3 if t >= 0.75 else 2 if t > 0.5 + 1e-9 else 1


def _base(n: np.ndarray, t: float) -> np.ndarray:
    """A 1-prefix has one token more than this."""
    return np.maximum(n - np.ceil(t * n - 1e-9).astype(np.int64), 0)


def _expand(rows: np.ndarray, first: np.ndarray, level: int, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All token positions first <= p < base + level of the given rows."""
    k = np.maximum(np.minimum(base[rows] + level, n[rows]) - first, 0)
    src = np.repeat(np.arange(len(rows)), k)
    return src, np.arange(len(src)) - np.repeat(np.cumsum(k) - k - first, k)


def _postings(sets: Sets, t: float, start: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] | None = None) -> Iterator[Postings]:
    """Postings of each level, for rank-ordered distinct sets; lists of one row are left out.

    start: (level, key, row, pos) to begin with instead of all single tokens of the 1-prefixes.
    """
    n = sets.sizes
    base = _base(n, t)
    depth = _depth(t)
    tokens = sets.tokens.astype(np.int64)
    narrow = tokens.max(initial=0) < (1 << 20) - 1

    def lists(key: np.ndarray, before: np.ndarray, row: np.ndarray, pos: np.ndarray, level: int) -> Iterator[Postings]:
        if narrow:  # one sort; keys that clash in 44 bits cost some checks
            key &= np.uint64(2**64 - 2**20)
            order = np.argsort(key | before.astype(np.uint64))
        else:
            order = np.lexsort((before, key))
        key, before, row, pos = key[order], before[order], row[order], pos[order]
        begin, length = _runs(key)
        size = np.repeat(length, length)
        # another token must cost less than comparing the list's rows
        left = np.maximum(np.minimum(base[row] + level + 1, n[row]) - pos - 1, 0)
        cost = np.repeat(np.add.reduceat(left, begin), length) if len(left) else left
        more = (size > SHORT_LIST) & (cost < size * (size - 1) // 2) & (level < depth)
        done = (size > 1) & ~more
        yield Postings(level, key[done], before[done], row[done], pos[done])
        if not more.any():
            return
        key, before, row, pos = key[more], before[more], row[more], pos[more]
        # combinations of different lists never meet, so lists are expanded some at a time
        begin, length = _runs(key)
        total = np.concatenate([[0], np.cumsum(np.add.reduceat(left[more], begin))])
        lo = 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + EXPANDED, side="right")) - 1)
            at = slice(begin[lo], begin[hi - 1] + length[hi - 1])
            src, nxt = _expand(row[at], pos[at] + 1, level + 1, base, n)
            mine, last = row[at][src], pos[at][src]
            token = sets.off[mine] + nxt
            deeper = mix64(key[at][src] ^ tokens[token].astype(np.uint64), 11 + level)
            yield from lists(deeper, np.where(nxt - 1 > last, tokens[token - 1] + 1, before[at][src]), mine, nxt, level + 1)
            lo = hi

    if start is None:
        rows = np.flatnonzero(n > 0)
        src, pos = _expand(rows, np.zeros(len(rows), np.int64), 1, base, n)
        row = rows[src]
        at = sets.off[row] + pos
        start = [(1, mix64(tokens[at].astype(np.uint64), 11), row, pos)]
    for level, key, row, pos in start:
        # tokens before a single one aren't in the combination; of longer ones that is known only as they are made
        before = np.where(pos > 0, tokens[sets.off[row] + pos - 1] + 1, 0) if level == 1 else np.zeros(len(row), np.int64)
        yield from lists(key.copy(), before, row, pos, level)


def _meetings(p: Postings, n: np.ndarray, t: float, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of row pairs, with the place of the combination's last token in the first row, whose first shared tokens can be the combination they meet under.

    Rows of a list with the same token before its last one share that token
    too, so they meet under an earlier combination and not here. Meetings that
    fail the length filter, or that have skipped more tokens than two similar
    sets can differ by, are left out.
    """
    if not len(p.key):
        return
    start, length = _runs(p.key)
    end = np.repeat(start + length, length)
    new = np.concatenate([[True], (p.key[1:] != p.key[:-1]) | (p.before[1:] != p.before[:-1])])
    inner = np.flatnonzero(new)
    inner_end = np.repeat(np.concatenate([inner[1:], [len(p.key)]]), np.diff(np.concatenate([inner, [len(p.key)]])))
    pos = np.arange(len(p.key))
    first = np.where(p.before == 0, pos + 1, inner_end)
    count = end - first
    total = np.cumsum(count)
    differ = (1 - t) / (1 + t)
    lo = 0
    while lo < len(pos):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step, side="right")))
        c = count[lo:hi]
        src = np.repeat(pos[lo:hi], c)
        dst = np.arange(len(src)) + np.repeat(first[lo:hi] - (np.cumsum(c) - c), c)
        a, b = p.row[src], p.row[dst]
        na, nb = n[a], n[b]
        keep = (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9) & (p.pos[src] + p.pos[dst] - 2 * (p.level - 1) <= differ * (na + nb) + 1e-9)
        yield a[keep], b[keep], p.pos[src][keep]
        lo = hi


def similar_rows(sets: Sets, t: float, bits: Bits | None = None, start: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of row pairs a < b of distinct rank-ordered sets with similarity >= t, and the similarity.

    A pair comes out where the combination it meets under is that of its first
    shared tokens, so once only.
    """
    n = sets.sizes
    if bits is None:
        bits = Bits(sets, int(sets.tokens.max(initial=0)) + 1)
    tokens = sets.tokens.astype(np.int64)
    for p in _postings(sets, t, start):
        for a, b, pos in _meetings(p, n, t):
            s = bits.similarity(a, b)
            good = np.flatnonzero(s >= t)
            a, b, s, last = a[good], b[good], s[good], tokens[sets.off[a[good]] + pos[good]]
            first = bits.nth_shared(a, b, p.level) == last
            a, b, s = a[first], b[first], s[first]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b), s


def linked_rows(sets: Sets, t: float, start: list | None = None) -> np.ndarray:
    """Least member of each row's component, where distinct rank-ordered sets of similarity >= t are linked.

    Pairs within a component that is known already aren't compared.
    """
    n = sets.sizes
    bits = Bits(sets, int(sets.tokens.max(initial=0)) + 1)
    root = np.arange(len(n))
    for p in _postings(sets, t, start):
        for a, b, _ in _meetings(p, n, t):
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            link = bits.similarity(a, b) >= t
            if link.any():
                root = roots(len(n), root[a[link]], root[b[link]])[root]
    return root


def _expand_members(ga: np.ndarray, gb: np.ndarray, s: np.ndarray, members: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of groups -> pairs of their members, PAIRS or so at a time, however large a group is."""
    ca, cb = off[ga + 1] - off[ga], off[gb + 1] - off[gb]
    total = np.concatenate([[0], np.cumsum(ca * cb)])
    for lo in range(0, int(total[-1]), PAIRS):
        k = np.arange(lo, min(int(total[-1]), lo + PAIRS))
        src = np.searchsorted(total, k, side="right") - 1
        k -= total[src]
        yield members[off[ga[src]] + k // cb[src]], members[off[gb[src]] + k % cb[src]], s[src]


def join_block(strings: list[str | None], ids: np.ndarray, side: np.ndarray, t: float, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of the similar pairs of one block; two: only pairs whose sides differ, side 0 first."""
    sets = pieces(strings)
    some = np.flatnonzero(sets.sizes > 0)
    sets, ids, side = sets.take(some), ids[some], side[some]
    rep, group = distinct_sets(sets)
    # a row that repeats an id and a set adds nothing
    o = np.lexsort((group, ids, side))
    new = np.concatenate([[True], (group[o][1:] != group[o][:-1]) | (ids[o][1:] != ids[o][:-1]) | (side[o][1:] != side[o][:-1])])[: len(o)]
    one = np.sort(o[new])
    sets, ids, side = sets.take(one), ids[one], side[one]
    o = np.lexsort((ids, side if two else np.zeros(len(ids))))
    twice = (ids[o][1:] == ids[o][:-1]) & (not two or side[o][1:] == side[o][:-1])
    repeated = np.zeros(len(ids), bool)
    repeated[o[1:][twice]] = repeated[o[:-1][twice]] = True
    rep, group = distinct_sets(sets)
    own, _ = dense_ids(sets.take(rep))
    members = np.argsort(group, kind="stable")
    off = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(rep)))])
    every = np.arange(len(rep))
    copies = every[np.diff(off) > 1]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for x, y, s in _expand_members(copies, copies, np.ones(len(copies)), members, off):
            keep = (side[x] < side[y]) if two else (ids[x] < ids[y])
            yield x[keep], y[keep], s[keep]
        for a, b, sim in similar_rows(own, t):
            for x, y, s in _expand_members(a, b, sim, members, off):
                keep = (side[x] != side[y]) if two else (ids[x] != ids[y])
                x, y, s = x[keep], y[keep], s[keep]
                swap = side[x] > side[y] if two else ids[x] > ids[y]
                yield np.where(swap, y, x), np.where(swap, x, y), s

    again = []
    for x, y, s in found():
        more = repeated[x] | repeated[y]
        yield ids[x[~more]], ids[y[~more]], s[~more]
        if more.any():
            again.append((ids[x[more]], ids[y[more]], s[more]))
    if again:
        # ids with several sets: each pair once, with its greatest similarity
        a, b, s = map(np.concatenate, zip(*again, strict=True))
        o = np.lexsort((-s, b, a))
        a, b, s = a[o], b[o], s[o]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        yield a[new], b[new], s[new]


def _counts(rows: DataFrame, of, size: int) -> np.ndarray:  # noqa: ANN001
    """Sums over all rows of the counts that ``of`` gives for a batch, in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += of(b)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    got = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


class Router(NamedTuple):
    """Counts in tables of fixed size that decide under which combinations a row of a large key is sent out."""

    t: float
    frequency: np.ndarray
    single: np.ndarray
    double: np.ndarray
    long: int

    def keys(self, b: pa.RecordBatch, upto: int = 3) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, key, row, place of the last token) of the rows of a batch (text, bh)."""
        sets, vocab = ordered_ids(pieces(b.column("text").to_pylist()), self.frequency)
        n = sets.sizes
        base = _base(n, self.t)
        tokens = vocab[sets.tokens].astype(np.uint64) if len(vocab) else sets.tokens.astype(np.uint64)
        bh = b.column("bh").to_numpy().view(np.uint64)
        rows = np.flatnonzero(n > 0)
        src, pos = _expand(rows, np.zeros(len(rows), np.int64), 1, base, n)
        row = rows[src]
        key = mix64(mix64(tokens[sets.off[row] + pos], 61) + bh[row], 62)
        out = []
        for level, table in ((1, self.single), (2, self.double), (3, None)):
            if level == upto or level == _depth(self.t) or table is None:
                out.append((level, key, row, pos))
                break
            more = table[(key & np.uint64(len(table) - 1)).astype(np.int64)] > self.long
            out.append((level, key[~more], row[~more], pos[~more]))
            key, row, pos = key[more], row[more], pos[more]
            src, nxt = _expand(row, pos + 1, level + 1, base, n)
            row, key = row[src], key[src]
            key, pos = mix64(key ^ tokens[sets.off[row] + nxt], 62 + level), nxt
        return out


#: Sizes of the router's tables: 2 and 8 MB.
FREQUENCIES, LISTS = 1 << 18, 1 << 20
#: Copies of a set that one task expands.
MEMBERS = 10_000


class Routed(NamedTuple):
    """Rows with the hashes of their sets, the distinct sets, and these in the cells in which all similar ones meet."""

    members: DataFrame
    sets: DataFrame
    cells: DataFrame
    #: Sets of a cell's table, and the postings to begin with.
    opened: Callable[[pa.Table], tuple[Sets, list]]


def routed_sets(rows: DataFrame, t: float, block_rows: int) -> Routed:
    """Keys of any size: equal sets once, in cells of combinations of rare tokens."""
    spark = rows.sparkSession
    by_type = dict(rows.dtypes)["by"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pieces(b.column("text").to_pylist())
            one, two_ = set_hashes(sets)
            keep = pa.array(sets.sizes > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(one.view(np.int64)), pa.array(two_.view(np.int64))], names=[*b.schema.names, "h1", "h2"]).filter(keep)

    key = ["by", "h1", "h2"]
    members = rows.select("by", "id", "side", "text").mapInArrow(hashed, f"by {by_type}, id long, side int, text string, h1 long, h2 long")
    members = materialize(members, "members")
    reps = members.groupBy(*key).agg(F.min("text").alias("text"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("bh", F.xxhash64("by"))
    reps = materialize(reps, "sets")

    def frequencies(b: pa.RecordBatch) -> np.ndarray:
        return np.bincount(token_buckets(pieces(b.column("text").to_pylist()).tokens, FREQUENCIES), minlength=FREQUENCIES)

    def listed(router: Router, level: int):  # noqa: ANN202
        def of(b: pa.RecordBatch) -> np.ndarray:
            found = [k for at, k, _, _ in router.keys(b, level) if at == level]
            return np.bincount((found[0] & np.uint64(LISTS - 1)).astype(np.int64), minlength=LISTS) if found else np.zeros(LISTS, np.int64)

        return of

    none = np.zeros(1, np.int64)
    texts = reps.select("text", "bh")
    router = Router(t, _counts(texts, frequencies, FREQUENCIES), none, none, block_rows)
    router = router._replace(single=_counts(texts, listed(router, 1), LISTS))
    posts = int(router.single.sum())
    if (router.single > block_rows).any():
        router = router._replace(double=_counts(texts, listed(router, 2), LISTS))
        posts += int(router.double.sum())
    cells = max(1, -(-2 * posts // block_rows))
    held = spark.sparkContext.broadcast(router)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                got = held.value.keys(b)
                row, k, pos = (np.concatenate([g[i] for g in got]) for i in (2, 1, 3))
                level = np.concatenate([np.full(len(g[1]), g[0]) for g in got])
                cell = (mix64(k, 71) % np.uint64(cells)).astype(np.int64)
                o = np.lexsort((cell, row))
                row, k, pos, level, cell = row[o], k[o], pos[o], level[o], cell[o]
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])[: len(row)])
                off = pa.array(np.concatenate([start, [len(row)]]).astype(np.int32))
                # place and level of the last token in one number
                spots = pa.ListArray.from_arrays(off, pa.array(pos * 4 + level))
                keys = pa.ListArray.from_arrays(off, pa.array(k.view(np.int64)))
                at = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("by", "h1", "h2", "n", "first", "text")), pa.array(cell[start]), keys, spots], names=["by", "h1", "h2", "n", "first", "text", "cell", "keys", "spots"])

    schema = f"by {by_type}, h1 long, h2 long, n long, first long, text string, cell long, keys array<long>, spots array<long>"
    routed = reps.select("by", "h1", "h2", "n", "first", "text", "bh").mapInArrow(posted, schema)
    # lists that no three tokens make short enough are cut into blocks
    routed = materialize(routed, "posted").withColumn("key", F.struct("by", "cell"))
    parts, _ = cells_by_key(routed, "key", "h1", 2 * block_rows)

    def opened(table: pa.Table) -> tuple[Sets, list]:
        sets, _ = ordered_ids(pieces(table["text"].to_pylist()), held.value.frequency)
        keys, spots = table["keys"].combine_chunks(), table["spots"].combine_chunks()
        row = np.repeat(np.arange(len(table)), np.diff(keys.offsets.to_numpy()))
        k, spot = keys.flatten().to_numpy().view(np.uint64), spots.flatten().to_numpy()
        return sets, [(level, k[spot % 4 == level], row[spot % 4 == level], spot[spot % 4 == level] // 4) for level in (1, 2, 3)]

    return Routed(members, reps, parts.drop("key"), opened)


def _large_pairs(rows: DataFrame, t: float, block_rows: int, two: bool) -> DataFrame:
    """Pairs within keys of any size: equal sets are joined once."""
    by_type = dict(rows.dtypes)["by"]
    key = ["by", "h1", "h2"]
    members, reps, cells, opened = routed_sets(rows, t, block_rows)

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        crossing = key[2].as_py() != key[3].as_py()
        block = table["block"].to_numpy()
        h1, h2, n = (table[c].to_numpy() for c in ("h1", "h2", "n"))
        sets, start = opened(table)
        own_by = table["by"]
        for a, b, s in similar_rows(sets, t, start=start):
            if crossing:
                cross = block[a] != block[b]
                a, b, s = a[cross], b[cross], s[cross]
            yield pa.RecordBatch.from_arrays([own_by.take(pa.array(a)).combine_chunks(), *map(pa.array, (h1[a], h2[a], n[a], h1[b], h2[b], n[b], s))], names=["by", "a1", "a2", "na", "b1", "b2", "nb", "similarity"])

    grouped = cells.groupBy("by", "cell", "c1", "c2")
    pairs = grouped.applyInArrow(join, f"by {by_type}, a1 long, a2 long, na long, b1 long, b2 long, nb long, similarity double")
    same = reps.where("n > 1").select("by", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("n").alias("na"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("n").alias("nb"), F.lit(1.0).alias("similarity"))
    pairs = pairs.unionByName(same)
    if two:
        turned = pairs.select("by", *[F.col(x).alias(y) for x, y in (("b1", "a1"), ("b2", "a2"), ("nb", "na"), ("a1", "b1"), ("a2", "b2"), ("na", "nb"))], "similarity").where("a1 <> b1 or a2 <> b2")
        pairs = pairs.unionByName(turned)
    # sets with many copies are expanded some copies at a time
    hot = reps.where(F.col("n") > MEMBERS).select(*key, F.ceil(F.col("n") / MEMBERS).alias("parts"))
    hot = F.broadcast(hot) if hot.limit(SMALL + 1).count() <= SMALL else hot
    who = members.select(*key, "id", "side").join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0))).drop("parts")
    for x in ("a", "b"):
        mine = who.where(F.col("side") == (0 if x == "a" else 1)) if two else who
        mine = mine.select("by", F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("part").alias(f"{x}part"), F.col("id").alias(f"{x}_id"))
        pairs = pairs.withColumn(f"{x}part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n{x}") / MEMBERS) - 1)))
        pairs = pairs.join(mine, ["by", f"{x}1", f"{x}2", f"{x}part"])
    if not two:
        pairs = pairs.where("a_id < b_id or (a_id > b_id and (a1 <> b1 or a2 <> b2))")
        pairs = pairs.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "similarity")
    else:
        pairs = pairs.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), "similarity")
    # rows that repeat an id
    return pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def similar_pairs(
    df: DataFrame, other: DataFrame | None = None, *, id_col: str, text_col: str, by: str, threshold: float = 0.8, block_rows: int = 24_000
) -> DataFrame:
    """All pairs of rows with equal ``by`` whose texts' piece sets have Tanimoto similarity >= threshold.

    Within df: ``id_a < id_b``. With other: ``id_a`` from df and ``id_b`` from
    other. Rows with a null id, ``by`` or text, and texts whose plain form is
    shorter than a piece, pair with nothing. Copies are rows of their own;
    rows that repeat an id give each pair of ids once, with its greatest
    similarity, and no pair of an id with itself (across two tables, equal ids
    are different records). Other columns are not read, whatever their names.
    A value of ``by`` with up to ``block_rows`` rows is joined in one task;
    rows of a larger one are sent out under their rare tokens, or combinations
    of two or three where a token has more than ``block_rows`` rows, so its
    work grows with its rows and not with their square. Empty tables give an
    empty result.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be above 0.5 and at most 1")

    def prepared(d: DataFrame, side: int) -> DataFrame:
        d = d.select(F.col(id_col).cast("long").alias("id"), F.col(by).alias("by"), F.col(text_col).alias("text"))
        d = d.where("id is not null and by is not null and text is not null")
        return d.withColumn("side", F.lit(side))

    rows = prepared(df, 0) if other is None else prepared(df, 0).unionByName(prepared(other, 1))
    two = other is not None

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for a, b, s in join_block(table["text"].to_pylist(), table["id"].to_numpy(), table["side"].to_numpy(), threshold, two):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["id_a", "id_b", "similarity"])

    blocked, width, cut = with_blocks(rows, "by", "id", block_rows)
    whole = blocked.where("blocks = 1").select("id", "by", "text", "side").repartition(width, "by")
    found = whole.groupBy("by").applyInArrow(join, "id_a long, id_b long, similarity double")
    if not cut:
        return found
    return found.unionByName(_large_pairs(blocked.where("blocks > 1").select("id", "by", "text", "side"), threshold, block_rows, two))
