"""Additive quantisation of set vectors: projection, codebooks, beam-search encoding, lookup tables.

A set's 0/1 vector is projected by fixed random signs to ``DIM`` numbers, which
keeps squared distances. It is then written as the sum of one full-dimensional
codeword from each of several codebooks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .pieces import Sets, mix64, token_buckets

DIM = 96


def project(sets: Sets, dim: int = DIM, weights: np.ndarray | None = None) -> np.ndarray:
    """Row sums of the tokens' fixed sign vectors, scaled so that squared lengths are kept on average.

    weights: of hashed buckets of tokens; their number is a power of two.
    """
    vocab, inv = np.unique(sets.tokens, return_inverse=True)
    signs = np.empty((len(vocab), dim), np.float32)
    for j in range(0, dim, 64):
        h = mix64(vocab.astype(np.uint64), 100 + j // 64)
        w = min(64, dim - j)
        signs[:, j : j + w] = 1 - 2 * ((h[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    signs *= np.float32(dim**-0.5)
    if weights is not None:
        signs *= weights[token_buckets(vocab, len(weights))].astype(np.float32)[:, None]
    n = len(sets.off) - 1
    out = np.zeros((n, dim), np.float32)
    if len(vocab) <= 4096:
        step = max(1, (1 << 22) // max(1, len(vocab)))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            a, b = sets.off[lo], sets.off[hi]
            hot = np.zeros((hi - lo, len(vocab)), np.float32)
            hot[np.repeat(np.arange(hi - lo), np.diff(sets.off[lo : hi + 1])), inv[a:b]] = 1
            out[lo:hi] = hot @ signs
        return out
    some = np.flatnonzero(sets.sizes > 0)
    step = max(1, (1 << 18) // max(1, int(sets.sizes.mean())))
    for lo in range(0, len(some), step):
        rows = some[lo : lo + step]
        part = Sets(inv.astype(np.int64), sets.off).take(rows)
        # rows of any length, in bounded pieces
        for a in range(0, len(part.tokens), 1 << 19):
            b = min(len(part.tokens), a + (1 << 19))
            owner = np.searchsorted(part.off, np.arange(a, b), side="right") - 1
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[rows[owner[start]]] += np.add.reduceat(signs[part.tokens[a:b]], start, axis=0)
    return out


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the squared distance."""
    at = np.empty(len(x), np.int64)
    d = np.empty(len(x), np.float32)
    half = 0.5 * (centers**2).sum(1)
    k = max(1, step // max(1, len(centers)))
    for lo in range(0, len(x), k):
        s = x[lo : lo + k] @ centers.T - half
        at[lo : lo + k] = s.argmax(1)
        d[lo : lo + k] = (x[lo : lo + k] ** 2).sum(1) - 2 * s[np.arange(len(s)), at[lo : lo + k]]
    return at, np.maximum(d, 0)


class Codebooks(NamedTuple):
    #: (books, words, DIM)
    words: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[-1])


def train(x: np.ndarray, books: int = 8, words: int = 64, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Residual codebooks: k-means on what the earlier codebooks leave, each over all dimensions."""
    rng = np.random.default_rng(seed)
    rest = x.astype(np.float32).copy()
    out = np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        if not len(rest):
            break
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            at, _ = nearest(rest, c)
            n = np.bincount(at, minlength=words)
            hot = np.zeros((len(rest), words), np.float32)
            hot[np.arange(len(rest)), at] = 1
            mean = hot.T @ rest / np.maximum(n, 1)[:, None]
            c = np.where(n[:, None] > 0, mean, rest[rng.choice(len(rest), words)])
        at, _ = nearest(rest, c)
        out[m] = c
        rest -= c[at]
    return Codebooks(out)


def encode(x: np.ndarray, cb: Codebooks, beam: int = 4, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row by beam search, and the stored squared norms of the sums of their codewords."""
    books, words, _ = cb.words.shape
    flat = cb.flat
    gram = flat @ flat.T
    own = np.diag(gram)
    cross = {(j, m): np.ascontiguousarray(2 * gram[j * words : (j + 1) * words, m * words : (m + 1) * words]) for m in range(books) for j in range(m)}
    codes = np.empty((len(x), books), np.uint8)
    norms = np.empty(len(x), np.float32)
    for lo in range(0, len(x), step):
        dots = x[lo : lo + step] @ flat.T
        n = len(dots)
        gain = (own - 2 * dots).reshape(n, books, words)  # change of the squared error by one word alone
        path = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)
        for m in range(books):
            score = cost[:, :, None] + gain[:, None, m]
            for j in range(m):
                score += cross[j, m][path[:, :, j]]
            b = score.shape[1]
            score = score.reshape(n, b * words)
            k = min(beam, b * words) if m + 1 < books else 1
            best = np.argpartition(score, k - 1, axis=1)[:, :k] if k > 1 else score.argmin(1)[:, None]
            cost = np.take_along_axis(score, best, 1)
            old, new = best // words, best % words
            path = np.concatenate([np.take_along_axis(path, old[:, :, None], 1), new[:, :, None]], 2)
        codes[lo : lo + step] = path[:, 0]
        chosen = path[:, 0] + np.arange(books) * words
        norms[lo : lo + step] = cost[:, 0] + 2 * np.take_along_axis(dots, chosen, 1).sum(1)
    return codes, norms
