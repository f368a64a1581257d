"""Plain forms and piece sets of many strings at once, as flat numpy arrays.

The *plain form* drops white space, quotation marks, commas, semicolons and
vertical bars, reads every dash as ``-`` and lower-cases letters. The *pieces*
of a string are the distinct 4-character substrings of its plain form. Null and
empty strings have an empty plain form and no pieces.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np

Q = 4
_ASCII_BITS = 7


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> folded code point, 0 for skipped ones."""
    table = np.arange(0x110000, dtype=np.uint32)
    # fixed values: characters that don't count, besides white space
    zero_width = "᠎​‌‍‎‏⁠﻿"
    marks = "\"'`´,;|«»‘’‚‛“”„‟′″‴‵‶‷‹›ʹʺʻʼ❛❜❝❞「」『』〝〞〟＂＇"
    dashes = "−⁃˗⁻₋"
    for i in range(0x3000 + 0x100):
        c = chr(i)
        low = c.lower()
        if len(low) == 1:
            table[i] = ord(low)
        elif low:
            table[i] = ord(low[0])
        if c.isspace() or c in zero_width or c in marks:
            table[i] = 0
        elif c in dashes or unicodedata.category(c) == "Pd":
            table[i] = ord("-")
    for i in range(0xFE00, 0xFFFF):
        c = chr(i)
        if c in zero_width or c in marks:
            table[i] = 0
        elif unicodedata.category(c) == "Pd":
            table[i] = ord("-")
        elif len(c.lower()) == 1:
            table[i] = ord(c.lower())
    for lo, hi in ((0xA640, 0xABC0), (0x10400, 0x10D00), (0x118A0, 0x11900), (0x16E40, 0x16E80), (0x1E900, 0x1E944)):
        for i in range(lo, hi):
            low = chr(i).lower()
            if len(low) == 1:
                table[i] = ord(low)
    table[0] = 0
    return table


def code_points(strings: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in one array, and where each string begins (n + 1 offsets)."""
    lens = np.fromiter((0 if s is None else len(s) for s in strings), np.int64, len(strings))
    joined = "".join("" if s is None else s for s in strings)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return cps, np.concatenate([[0], np.cumsum(lens)])


def fold(strings: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all strings and offsets of the plain forms."""
    cps, off = code_points(strings)
    folded = fold_table()[cps]
    keep = folded != 0
    at = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], at[off]


def plain(strings: list[str | None]) -> list[str]:
    codes, off = fold(strings)
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fixed 64-bit finalizer (multiply-xorshift) of uint64 values."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sets(NamedTuple):
    """Rows of distinct tokens, ascending in each row: tokens[off[i]:off[i + 1]]."""

    tokens: np.ndarray
    off: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1, dtype=np.int64), self.sizes)

    def take(self, rows: np.ndarray) -> Sets:
        n = self.sizes[rows]
        off = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(off[-1]) - np.repeat(off[:-1], n) + np.repeat(self.off[:-1][rows], n)
        return Sets(self.tokens[at], off)


def _unique_pairs(rows: np.ndarray, tokens: np.ndarray, n: int) -> Sets:
    key = np.sort((rows.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    got = (key >> np.uint64(32)).astype(np.int64)
    return Sets((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(got, minlength=n))]))


def pieces(strings: list[str | None]) -> Sets:
    """Distinct pieces of each string as 32-bit tokens: exact for ASCII, hashed above it."""
    codes, off = fold(strings)
    n = len(off) - 1
    if len(codes) < Q:
        return Sets(np.zeros(0, np.uint32), np.zeros(n + 1, np.int64))
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    same = rows[: len(codes) - Q + 1] == rows[Q - 1 :]
    wide = codes.max(initial=0) >= 1 << _ASCII_BITS
    m = len(codes) - Q + 1
    token = np.zeros(m, np.uint64)
    for k in range(Q):
        token = (token << np.uint64(_ASCII_BITS)) | (codes[k : m + k].astype(np.uint64) & np.uint64(127))
    if wide:
        high = np.zeros(m, bool)
        full = np.zeros(m, np.uint64)
        for k in range(Q):
            c = codes[k : m + k].astype(np.uint64)
            high |= c > 127
            full = full * np.uint64(0x100000001B3) + c
        top = np.uint64(1 << 31)
        token = np.where(high, top | (mix64(full) >> np.uint64(33)), token)
    return _unique_pairs(rows[:m][same], token[same], n)


def set_hashes(sets: Sets) -> list[np.ndarray]:
    """Two 64-bit hashes of each set, whatever its tokens' order."""
    sums = []
    for seed in (1, 2):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets.tokens.astype(np.uint64), seed), dtype=np.uint64)])
        sums.append(c[sets.off[1:]] - c[sets.off[:-1]])
    return sums


def distinct_sets(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Representative row of every distinct set, and the index of its representative for each row."""
    n = len(sets.off) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = set_hashes(sets)
    key = np.rec.fromarrays([sums[0], sums[1], sets.sizes.astype(np.int64)])
    order = np.lexsort((np.arange(n), key.f2, key.f1, key.f0))
    k = key[order]
    new = np.concatenate([[True], (k.f0[1:] != k.f0[:-1]) | (k.f1[1:] != k.f1[:-1]) | (k.f2[1:] != k.f2[:-1])])
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def dense_ids(sets: Sets) -> tuple[Sets, np.ndarray]:
    """Tokens renumbered 0.. by (document frequency, token), ascending in each row; and the frequencies."""
    vocab, inv = np.unique(sets.tokens, return_inverse=True)
    df = np.bincount(inv, minlength=len(vocab))
    order = np.lexsort((vocab, df))
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    return _unique_pairs(sets.rows, rank[inv], len(sets.off) - 1), df[order]


def ordered_ids(sets: Sets, frequency: np.ndarray) -> tuple[Sets, np.ndarray]:
    """Tokens renumbered 0.. by (frequency of their hashed bucket, token); and the tokens. One order for all batches."""
    vocab, inv = np.unique(sets.tokens, return_inverse=True)
    order = np.lexsort((vocab, frequency[token_buckets(vocab, len(frequency))]))
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    return _unique_pairs(sets.rows, rank[inv], len(sets.off) - 1), vocab[order]


def token_buckets(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashed bucket of each token, below n, a power of two."""
    return (mix64(tokens.astype(np.uint64), 31) & np.uint64(n - 1)).astype(np.int64)


class Bits:
    """Sets as bit rows; counts shared tokens of many pairs exactly.

    A vocabulary too wide for ``limit`` bytes is taken in slabs, one at a time.
    """

    def __init__(self, sets: Sets, width: int, limit: int = 1 << 28):
        self.sets, self.sizes = sets, sets.sizes
        n = max(1, len(sets.off) - 1)
        self.words = max(1, min(-(-width // 64), limit // 8 // n))
        self.slabs = max(1, -(-width // (64 * self.words)))
        self.bits = self._slab(0) if self.slabs == 1 else None

    def _slab(self, k: int) -> np.ndarray:
        flat = np.zeros((len(self.sets.off) - 1) * self.words, np.uint64)
        rows, tokens = self.sets.rows, self.sets.tokens
        if self.slabs > 1:
            lo = 64 * self.words * k
            inside = (tokens >= lo) & (tokens < lo + 64 * self.words)
            rows, tokens = rows[inside], tokens[inside] - np.uint32(lo)
        at = rows * self.words + (tokens >> np.uint32(6)).astype(np.int64)
        bit = np.uint64(1) << (tokens & np.uint32(63)).astype(np.uint64)
        if len(at):  # tokens ascend in a row, so equal words are adjacent
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            flat[at[new]] = np.bitwise_or.reduceat(bit, new)
        return flat.reshape(-1, self.words)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        step = max(1, (1 << 19) // self.words)
        for k in range(self.slabs):
            bits = self._slab(k) if self.bits is None else self.bits
            for s in range(0, len(a), step):
                both = bits[a[s : s + step]] & bits[b[s : s + step]]
                out[s : s + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return out

    def nth_shared(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """The k-th least token (from 1) that both rows of each pair have; -1 where they share fewer."""
        out = np.full(len(a), -1, np.int64)
        left = np.full(len(a), k, np.int64)
        step = max(1, (1 << 18) // self.words)
        for slab in range(self.slabs):
            bits = self._slab(slab) if self.bits is None else self.bits
            open_ = np.flatnonzero(out < 0)
            for s in range(0, len(open_), step):
                rows = open_[s : s + step]
                both = bits[a[rows]] & bits[b[rows]]
                run = np.cumsum(np.bitwise_count(both), axis=1, dtype=np.int64)
                here = run[:, -1] >= left[rows]
                left[rows[~here]] -= run[~here, -1]
                if not here.any():
                    continue
                rows, both, run = rows[here], both[here], run[here]
                at = (run >= left[rows, None]).argmax(1)
                each = np.arange(len(rows))
                word = both[each, at]
                skip = left[rows] - (run[each, at] - np.bitwise_count(word))
                for j in range(1, k):
                    word = np.where(skip > j, word & (word - np.uint64(1)), word)
                low = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                out[rows] = 64 * (self.words * slab + at) + low
        return out

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        o = self.shared(a, b)
        return o / np.maximum(self.sizes[a] + self.sizes[b] - o, 1)
