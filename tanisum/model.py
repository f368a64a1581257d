"""Data model: fingerprints as rows of on-bits, and conversions from and to other layouts.

The working layout is ``id BIGINT, on ARRAY<INT>`` (ascending positions of the
1-bits). The number of bits, ``m``, is metadata. Rows with a null id or null
bits are dropped by the conversions; an all-zero row has an empty array.
Repeated ids are objects of their own unless ``distinct_ids`` is applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def from_signs(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Bit j is on where element j is above zero; null and NaN elements are off."""
    x = F.transform(F.col(vec_col), lambda v, i: F.when((v > 0) & ~F.isnan(v), i))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.array_compact(x).alias("on"))


def from_dense(df: DataFrame, id_col: str, bits_col: str) -> DataFrame:
    """From an array of 0 and 1."""
    on = F.array_compact(F.transform(F.col(bits_col), lambda v, i: F.when(v != 0, i)))
    return df.where(F.col(id_col).isNotNull() & F.col(bits_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), on.alias("on"))


def from_long(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """From (id, bit) rows, repeated ones once; ids adds objects without any bit."""
    got = df.where("id is not null and bit is not null").groupBy("id").agg(F.sort_array(F.collect_set(F.col("bit").cast("int"))).alias("on"))
    if ids is None:
        return got
    none = F.array().cast("array<int>")
    return ids.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("on", none).alias("on"))


def unpacked(words: Column, m: int) -> Column:
    """On-bits of packed words; bits from m on are padding."""
    bits = F.sequence(F.lit(0), F.lit(m - 1))
    return F.filter(bits, lambda i: F.getbit(F.get(words, F.floor(i / WORD).cast("int")), i % WORD) == 1)


def from_packed(df: DataFrame, id_col: str, words_col: str, m: int) -> DataFrame:
    """From 64-bit words, lowest bit first; bits from m on are padding. Batches are unpacked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = -(-m // WORD)
        for b in batches:
            words = b.column("words")
            off = words.offsets.to_numpy()
            n = np.diff(off)
            flat = words.flatten().to_numpy(zero_copy_only=False)
            table = np.zeros((len(n), k), np.int64)
            place = np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)
            some = place < k
            table[np.repeat(np.arange(len(n)), n)[some], place[some]] = flat[some]
            row, bit = np.nonzero(np.unpackbits(table.view(np.uint8), axis=1, bitorder="little")[:, :m])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(bit.astype(np.int32)))], names=["id", "on"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(words_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(words_col).alias("words")).mapInArrow(run, "id long, on array<int>")


def to_packed(on: Column, m: int) -> Column:
    """64-bit words of on-bits."""
    words = F.sequence(F.lit(0), F.lit(-(-m // WORD) - 1))

    def word(w: Column) -> Column:
        mine = F.filter(on, lambda b: F.floor(b / WORD).cast("int") == w)
        one = F.lit(1).cast("long")
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, (b % WORD).cast("int"))))

    return F.transform(words, word)


def to_dense(on: Column, m: int) -> Column:
    """Array of m zeros and ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.array_contains(on, i).cast("int"))


def dense_rows(fp: DataFrame, m: int) -> DataFrame:
    """``id``, ``row``: all fingerprints as arrays of m zeros and ones, a batch at a time. Bits beyond m raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = b.column("on")
            bits = on.flatten().to_numpy(zero_copy_only=False)
            if len(bits) and not 0 <= bits.min() <= bits.max() < m:
                raise ValueError(f"a bit is beyond the {m} expected")
            x = np.zeros((b.num_rows, m), np.int32)
            x[np.repeat(np.arange(b.num_rows), np.diff(on.offsets.to_numpy())), bits] = 1
            ends = pa.array((np.arange(b.num_rows + 1) * m).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["id", "row"])

    return fp.select("id", "on").mapInArrow(run, "id long, row array<int>")


def to_long(fp: DataFrame) -> DataFrame:
    """(id, bit) rows of the 1-bits."""
    return fp.select("id", F.explode("on").alias("bit"))


def flipped(on: Column, m: int) -> Column:
    """On-bits of the complement."""
    return F.array_except(F.sequence(F.lit(0), F.lit(m - 1)), on)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def resized(values: Column, m: int) -> Column:
    """An array of numbers cut or filled with zeros to m elements, for rows of another width; operators refuse bits beyond theirs."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0).cast("long"), m)), 1, m)


def distinct_ids(fp: DataFrame) -> DataFrame:
    """One row for each id: of repeated ids the least array."""
    value = next(c for c in fp.columns if c != "id")
    return fp.groupBy("id").agg(F.min(value).alias(value))


def gathered(fp: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among the given ones."""
    return fp.join(ids.select("id"), "id", "left_semi")
