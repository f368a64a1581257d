"""Cells of a residual quantiser, and the nearest ones of each vector."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .quantize import nearest, train

#: Words of a level below the first.
WORDS = 256


class Cells(NamedTuple):
    """Centres of each level; those below the first are of what the level above leaves."""

    levels: tuple[np.ndarray, ...]

    @property
    def number(self) -> int:
        return int(np.prod([len(c) for c in self.levels]))

    def nearest(self, x: np.ndarray, w: int, step: int = 1 << 21) -> np.ndarray:
        """Ids of the w nearest cells of each row (fewer if there are fewer), nearest first; level by level, w at each."""
        w = min(w, self.number)
        widest = max(len(self.levels[0]), w * max((len(c) for c in self.levels[1:]), default=1))
        out = np.empty((len(x), w), np.int64)
        rows = max(1, step // widest)
        for lo in range(0, len(x), rows):
            part = x[lo : lo + rows]
            ids, cost, total = None, None, None
            for level in self.levels:
                own = 0.5 * (level**2).sum(1)
                gain = own - part @ level.T
                if ids is None:
                    score, base = gain, np.zeros((len(part), 1), np.int64)
                else:
                    # |x - a - b|^2 / 2 = what a costs + what b costs alone + a.b
                    score = (cost[:, :, None] + gain[:, None] + (total @ level.T)).reshape(len(part), -1)
                    base = ids
                k = min(w, score.shape[1])
                at = np.argpartition(score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.broadcast_to(np.arange(k), score.shape)
                cost = np.take_along_axis(score, at, 1)
                o = np.argsort(cost, axis=1, kind="stable")
                at, cost = np.take_along_axis(at, o, 1), np.take_along_axis(cost, o, 1)
                old, new = at // len(level), at % len(level)
                ids = np.take_along_axis(base, old, 1) * len(level) + new
                total = level[new] if total is None else np.take_along_axis(total, old[:, :, None], 1) + level[new]
            out[lo : lo + rows] = ids
        return out


def deepened(sample: np.ndarray, first: np.ndarray, rows: int, each: int) -> Cells:
    """Cells below the given centres, about one for ``each`` of the given number of rows; fitted on a bounded sample."""
    levels, number = [first], len(first)
    rest = sample - first[nearest(sample, first)[0]] if len(sample) else sample
    while number * each < rows and len(levels) < 4 and len(sample):
        words = min(WORDS, max(2, -(-rows // (number * each))))
        level = train(rest, 1, words, 6).words[0]
        rest = rest - level[nearest(rest, level)[0]]
        levels.append(level)
        number *= words
    return Cells(tuple(levels))
