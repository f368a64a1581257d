"""Records that differ only in how two fields are written, or in the fields' order.

The UTF-8 bytes of each field stream through a skip-and-fold table into a
rolling polynomial hash, one character a step for all rows at a time; no
canonical string is built. Only hashes are grouped. Rows whose pair of hashes
occurs more than once are then sorted by it with their texts, and each is
compared with its group's first row by two pointers that skip what doesn't
count. Rows that only share the hash are grouped again under other constants
until none is left.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .pieces import fold_table, mix64

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of a text that one row of the stepping arrays takes; longer texts are cut and their hashes put together.
SEGMENT = 64
#: A group is cut into parts beyond this share of the rows (and HOT_LEAST), so there are at most 1000 such groups.
HOT_SHARE, HOT_LEAST = 1e-3, 1000
#: Words of 64 bits of the filter for hashes that occur more than once (8 MB); a full filter costs time, never rows.
FILTER_WORDS = 1 << 20
_END = np.uint32(0xFFFFFFFF)


class Texts(NamedTuple):
    """Strings as a view of their bytes; null ones are empty."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.data, self.start[rows], self.end[rows])


def texts_of(column: pa.Array | list) -> Texts:
    """A view of an Arrow column, or of a list of strings."""
    column = pa.array(column, pa.string()) if isinstance(column, list) else column
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(4, np.uint8)
    start, end = off[:-1], off[1:]
    if column.null_count:
        end = np.where(column.is_valid().to_numpy(zero_copy_only=False), end, start)
    return Texts(raw, start, end)


@functools.cache
def _narrow() -> np.ndarray:
    """The skip-and-fold table for bytes that are a character of their own."""
    return fold_table()[:128].copy()


def _character(data: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded character (0: skipped) at each position, and its number of bytes."""
    b = data[np.minimum(pos, len(data) - 1)]
    code = _narrow()[b & 0x7F]
    wide = np.flatnonzero(b >= 0x80)
    size = np.ones(len(pos), np.int64)
    if len(wide):
        lead, p = b[wide].astype(np.uint32), pos[wide]
        n = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        point = lead & (np.uint32(0x7F) >> n.astype(np.uint32))
        for k in range(1, 4):
            more = np.flatnonzero(n > k)
            point[more] = (point[more] << np.uint32(6)) | (data[np.minimum(p[more] + k, len(data) - 1)] & np.uint32(0x3F))
        code[wide] = fold_table()[np.minimum(point, 0x10FFFF)]
        size[wide] = n
    return code, size


def rolling_hashes(strings: pa.Array | list | Texts, seed: int = 0, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash (mod 2^64, cut to ``bits``) of each string's counting characters, and their number."""
    t = strings if isinstance(strings, Texts) else texts_of(strings)
    base = np.uint64((_BASE + 2 * seed) & (2**64 - 1))
    narrow = np.where(_narrow() > 0, mix64(_narrow(), seed + 21), 0).astype(np.uint64)
    # segments begin where a character does
    k = np.maximum(-(-(t.end - t.start) // SEGMENT), 1)
    owner = np.repeat(np.arange(len(k)), k)
    first = np.cumsum(k) - k
    pos = t.start[owner] + SEGMENT * (np.arange(len(owner)) - first[owner])
    for _ in range(3):
        inside = (pos > t.start[owner]) & (pos < t.end[owner])
        pos += inside & ((t.data[np.minimum(pos, len(t.data) - 1)] & 0xC0) == 0x80)
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    stop = np.where(last, t.end[owner], np.concatenate([pos[1:], [0]]))
    h, count = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.int64)
    rows, sums, number = np.arange(len(owner)), h, count
    while len(rows):
        for _ in range(8):
            code, size = _character(t.data, pos)
            low = code < 128
            value = narrow[np.where(low, code, 0)]
            if not low.all():
                value = np.where(low, value, mix64(code, seed + 21))
            counts = (code != 0) & (pos < stop)
            sums = np.where(counts, sums * base + value, sums)
            number = number + counts
            pos = pos + size
        h[rows], count[rows] = sums, number
        on = pos < stop
        rows, pos, stop, sums, number = rows[on], pos[on], stop[on], sums[on], number[on]
    # put segments together: each is moved up by the characters after it
    whole = np.add.reduceat(count, first) if len(first) else count
    after = np.repeat(whole + np.concatenate([[0], np.cumsum(whole)[:-1]]) if len(whole) else whole, k) - np.cumsum(count)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(after.max(initial=0)), base)]), dtype=np.uint64)
    total = np.add.reduceat(h * powers[after], first) if len(first) else h
    out = mix64(total + whole.astype(np.uint64), seed + 22)
    return (out if bits == 64 else out & np.uint64((1 << bits) - 1)), whole


def same_text(left: Texts | list, right: Texts | list) -> np.ndarray:
    """Whether the counting characters of each pair of strings agree: two pointers a pair that skip what doesn't count."""
    a, b = (x if isinstance(x, Texts) else texts_of(x) for x in (left, right))
    ra, rb = memoryview(a.data), memoryview(b.data)
    bounds = zip(a.start.tolist(), a.end.tolist(), b.start.tolist(), b.end.tolist(), strict=True)
    same = np.fromiter((ra[i:j] == rb[k:m] for i, j, k, m in bounds), bool, len(a.start))  # byte for byte
    rows = np.flatnonzero(~same)
    p, q, pe, qe = a.start[rows], b.start[rows], a.end[rows], b.end[rows]
    while len(rows):
        x, dx = _character(a.data, p)
        y, dy = _character(b.data, q)
        x, y = np.where(p < pe, x, _END), np.where(q < qe, y, _END)
        skip_x, skip_y = x == 0, y == 0
        both = ~(skip_x | skip_y)
        agree = both & (x == y)
        same[rows[agree & (x == _END)]] = True
        p = p + np.where(skip_x | agree, dx, 0)
        q = q + np.where(skip_y | agree, dy, 0)
        on = ~both | (agree & (x != _END))
        rows, p, q, pe, qe = rows[on], p[on], q[on], pe[on], qe[on]
    return same


def _keys(b: pa.RecordBatch, seed: int, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unordered pair of hashes of each row, and which rows have enough characters."""
    x, nx = rolling_hashes(b.column("a"), seed, bits)
    y, ny = rolling_hashes(b.column("b"), seed, bits)
    x, y = x.view(np.int64), y.view(np.int64)
    return np.minimum(x, y), np.maximum(x, y), (nx >= least) & (ny >= least)


def _bit(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix64(lo.view(np.uint64) ^ mix64(hi.view(np.uint64), 41), 42) & np.uint64(64 * FILTER_WORDS - 1)


def _repeated(rows: DataFrame, seed: int, bits: int, least: int) -> DataFrame:
    """lo, hi, n of the hash pairs that more than one row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, ok = _keys(b, seed, bits, least)
            yield pa.RecordBatch.from_arrays([pa.array(lo[ok]), pa.array(hi[ok])], names=["lo", "hi"])

    return rows.select("a", "b").mapInArrow(run, "lo long, hi long").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _filter(groups: DataFrame) -> np.ndarray:
    """A bit for each hash pair of groups, in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bit(b.column("lo").to_numpy(), b.column("hi").to_numpy()))
            word = at >> np.uint64(6)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(at)])
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word[start].astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    # at most FILTER_WORDS rows
    got = groups.select("lo", "hi").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_WORDS, np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


_VERIFIED = "first_id long, copy_id long, ok boolean, lo long, hi long, part int, a string, b string"


def _verified(rows: DataFrame) -> DataFrame:
    """Rows (id, lo, hi, part, a, b), sorted by lo, hi, part, id in their partitions -> each later row's agreement with the first of its part.

    The first rows of parts of groups that were cut come out with their texts, as copies of themselves.
    """
    schema = pa.schema([("first_id", pa.int64()), ("copy_id", pa.int64()), ("ok", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64()), ("part", pa.int32()), ("a", pa.string()), ("b", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the first row of the group that the last batch ended in
        last = None  # and the id of its last row
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            ids, lo, hi, part = (t[c].to_numpy() for c in ("id", "lo", "hi", "part"))
            new = np.ones(len(ids), bool)
            new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (part[1:] != part[:-1])
            ref = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            once = ids != ids[ref]
            once[1:] &= new[1:] | (ids[1:] != ids[:-1])
            if held is not None and len(ids) > 1 and not new[1] and ids[1] == last:
                once[1] = False
            last = ids[-1]
            rows_ = np.flatnonzero(once)
            to = ref[rows_]
            a, b = texts_of(t["a"]), texts_of(t["b"])
            ok = same_text(a.take(rows_), a.take(to)) & same_text(b.take(rows_), b.take(to))
            rest = np.flatnonzero(~ok)
            if len(rest):
                x, y = rows_[rest], to[rest]
                ok[rest] = same_text(a.take(x), b.take(y)) & same_text(b.take(x), a.take(y))
            n = len(rows_)
            text = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[to], ids[rows_], ok, lo[rows_], hi[rows_], part[rows_])), text, text], schema=schema)
            heads = np.flatnonzero(new & (part >= 0))
            heads = heads[heads > 0] if held is not None else heads
            if len(heads):
                at = pa.array(heads)
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (ids[heads], ids[heads], np.ones(len(heads), bool), lo[heads], hi[heads], part[heads])), *(t[c].take(at).combine_chunks() for c in ("a", "b"))], schema=schema
                )
            held = t.slice(int(ref[-1]), 1).combine_chunks().to_batches()[0]

    return rows.mapInArrow(run, _VERIFIED)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("lo", "hi", "part", "id", "a", "b").repartition("lo", "hi", "part").sortWithinPartitions("lo", "hi", "part", "id")


def _round(rows: DataFrame, number: int, seed: int, bits: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that agree, and ids of rows that share a hash with their first row but not the text."""
    sc = rows.sparkSession.sparkContext
    groups = materialize(_repeated(rows, seed, bits, least), "copy-groups")
    limit = max(HOT_LEAST, HOT_SHARE * number)
    hot = groups.where(F.col("n") > limit).withColumn("parts", F.ceil(F.col("n") / F.lit(limit)).cast("int")).drop("n")
    table = sc.broadcast(_filter(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, ok = _keys(b, seed, bits, least)
            at = _bit(lo, hi)
            ok &= (table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lo), pa.array(hi), b.column("a"), b.column("b")], names=["id", "lo", "hi", "a", "b"]).filter(pa.array(ok))

    flagged = rows.mapInArrow(run, "id long, lo long, hi long, a string, b string")
    # at most 1000 rows of numbers; groups that aren't cut have part -1
    flagged = flagged.join(F.broadcast(hot), ["lo", "hi"], "left")
    flagged = flagged.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"), F.lit(-1)))
    got = materialize(_verified(_sorted(flagged)), "copy-pairs")
    cold = got.where("part = -1")
    pairs, rest = cold.where("ok").select("first_id", "copy_id"), cold.where("not ok").select(F.col("copy_id").alias("id"))
    if hot.isEmpty():
        return pairs, rest
    # first rows of the parts against each other: no more than parts
    cut = got.where("part >= 0")
    heads = cut.where("a is not null").select("lo", "hi", F.lit(-1).alias("part"), F.col("first_id").alias("id"), "a", "b")
    tops = materialize(_verified(_sorted(heads)).select("lo", "hi", "first_id", "copy_id", "ok"), "copy-heads")
    # groups of which any two rows don't agree are taken apart in the next round
    odd = F.broadcast(cut.where("not ok").select("lo", "hi").unionByName(tops.where("not ok").select("lo", "hi")).distinct())
    top = F.broadcast(tops.where("ok").select(F.col("copy_id").alias("first_id"), F.col("first_id").alias("top")))
    sure = cut.join(odd, ["lo", "hi"], "left_anti").join(top, "first_id", "left")
    linked = sure.select(F.coalesce("top", "first_id").alias("first_id"), "copy_id").where("first_id <> copy_id")
    ids = cut.join(odd, ["lo", "hi"], "left_semi").select(F.col("copy_id").alias("id"))
    return pairs.unionByName(linked), rest.unionByName(ids)


def copies(df: DataFrame, *, id_col: str, first_col: str, second_col: str, least: int = 4, bits: int = 64) -> DataFrame:
    """One row ``first_id``, ``copy_id`` for each record beyond the first (smallest id) of its set of copies.

    Two records are copies if the plain forms of their two fields are the same
    two strings, in either order. Records with a null id, or a field that is
    null or has fewer than ``least`` counting characters, are nobody's copies.
    Other columns aren't read, whatever their names. Repeated ids count as
    repeated rows of one record and give no pair of it with itself. Empty
    tables give an empty result.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(first_col).alias("a"), F.col(second_col).alias("b"))
    source = source.where("id is not null and a is not null and b is not null")
    rows, parts, seed, number = source, [], 0, df.count()
    while True:
        pairs, rest = _round(rows, number, seed, bits, least)
        parts.append(pairs)
        rest = rest.distinct()
        if rest.isEmpty():
            break
        rows, seed, bits = source.join(rest, "id", "left_semi"), seed + 1, min(64, bits * 2)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out


def collapse(df: DataFrame, pairs: DataFrame, *, id_col: str) -> DataFrame:
    """``first_id`` of every record or set of copies, and ``n_copies``, the records it stands for."""
    sizes = pairs.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    ids = df.select(F.col(id_col).cast("long").alias("first_id")).where("first_id is not null")
    kept = ids.join(pairs.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return kept.join(sizes, "first_id", "left").select("first_id", F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
