"""When two bit features may merge.

A criterion takes the merged feature and its two parts, each as (number of
objects, column sums). Similarities of single objects and of all-zero ones are
NaN, and comparisons with NaN are false.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Part = tuple[int, np.ndarray]
Criterion = Callable[[Part, Part, Part], bool]


def set_similarity(part: Part) -> float:
    """JT similarity of the objects behind a feature."""
    n, ls = part
    x = ls.astype(np.float64)
    one, two = float(x.sum()), float(x @ x)
    shared = (two - one) / 2
    below = shared + n * one - two
    return shared / below if below else np.nan


def majority(part: Part) -> np.ndarray:
    """Bits that at least half of the objects have."""
    return part[1] * 2 >= part[0]


def _grown(part: Part, more: np.ndarray) -> float:
    """Similarity of the objects with a newcomer, to the objects themselves, as the newcomer's share."""
    n, ls = part
    with_it = set_similarity((n + 1, ls + more))
    return with_it * (n + 1) - set_similarity(part) * (n - 1)


def criterion(name: str, threshold: float, tolerance: float = 0.05) -> Criterion:
    """radius, diameter, tolerance or tolerance_tough."""

    def radius(new: Part, old: Part, nominee: Part) -> bool:
        return bool(_grown(new, majority(new).astype(np.int64)) >= 2 * threshold)

    def diameter(new: Part, old: Part, nominee: Part) -> bool:
        return bool(set_similarity(new) >= threshold)

    def tolerant(new: Part, old: Part, nominee: Part) -> bool | None:
        """The cases the tolerance criteria share; None where they differ."""
        if set_similarity(new) < threshold:
            return False
        if nominee[0] > 1:
            return None
        return True if old[0] == 1 else bool(_grown(old, nominee[1]) / 2 >= set_similarity(old) - tolerance)

    def lenient(new: Part, old: Part, nominee: Part) -> bool:
        got = tolerant(new, old, nominee)
        return True if got is None else got

    def tough(new: Part, old: Part, nominee: Part) -> bool:
        got = tolerant(new, old, nominee)
        if got is not None:
            return got
        a, b = old[0], nominee[0]
        total = set_similarity(new) * (a + b) * (a + b - 1)
        within = set_similarity(old) * a * (a - 1) + set_similarity(nominee) * b * (b - 1)
        return bool((total - within) / (2 * a * b) >= set_similarity(old) - tolerance)

    known: dict[str, Criterion] = {"radius": radius, "diameter": diameter, "tolerance": lenient, "tolerance_tough": tough}
    if name not in known:
        raise ValueError(f"unknown criterion {name}; known are {', '.join(known)}")
    return known[name]
