"""The clustering tree: bit features in, clusters out. Plain numpy, one task."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from .criteria import Criterion, majority


@dataclass
class Feature:
    """Objects summed up: their number, column sums and ids."""

    n: int
    ls: np.ndarray
    ids: list[int]
    below: Node | None = None
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.refresh()

    def refresh(self) -> None:
        self.bits = np.packbits(majority((self.n, self.ls)))

    def take(self, other: Feature, with_ids: bool) -> None:
        self.n += other.n
        self.ls = self.ls + other.ls
        if with_ids:
            self.ids.extend(other.ids)
        self.refresh()


def closeness(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Tanimoto similarity of packed rows with one; NaN for two empty ones."""
    both = np.bitwise_count(bits & one).sum(axis=1, dtype=np.int64)
    any_ = np.bitwise_count(bits | one).sum(axis=1, dtype=np.int64)
    return np.divide(both, any_, out=np.full(len(bits), np.nan), where=any_ > 0)


def poles(bits: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The row farthest from the rows' centre, and all rows' closeness to it and to the row farthest from it."""
    sums = np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    centre = np.packbits(majority((len(bits), sums)))
    first = int(np.argmin(closeness(bits, centre)))
    to_first = closeness(bits, bits[first])
    second = int(np.argmin(to_first))
    return first, to_first, closeness(bits, bits[second])


class Node:
    """Up to ``width`` features; their packed centroids stand beside them for the search."""

    def __init__(self, width: int, leaf: bool, n_bytes: int):
        self.leaf, self.features = leaf, []
        self.table = np.zeros((width + 1, n_bytes), np.uint8)
        self.before: Node | None = None
        self.after: Node | None = None

    def append(self, f: Feature) -> None:
        self.table[len(self.features)] = f.bits
        self.features.append(f)

    def replace(self, i: int, f: Feature) -> None:
        self.features[i] = f
        self.table[i] = f.bits

    @property
    def bits(self) -> np.ndarray:
        return self.table[: len(self.features)]


class Tree:
    """Features go in one by one; where they come to rest depends on their order."""

    def __init__(self, m: int, accept: Criterion, branching: int = 50):
        if branching < 2:
            raise ValueError("branching must be at least 2")
        self.m, self.accept, self.branching = m, accept, branching
        self.n_bytes = -(-m // 8)
        self.root = self._node(True)
        self.first = self.root

    def _node(self, leaf: bool) -> Node:
        return Node(self.branching, leaf, self.n_bytes)

    def insert(self, f: Feature) -> None:
        halves = self._insert(self.root, f)
        if halves:
            self.root = self._node(False)
            for h in halves:
                self.root.append(h)

    def _insert(self, node: Node, f: Feature) -> tuple[Feature, Feature] | None:
        """The two halves of the node if it had to be split."""
        if not node.features:
            node.append(f)
            return None
        i = int(np.argmax(closeness(node.bits, f.bits)))
        near = node.features[i]
        if node.leaf:
            both = (near.n + f.n, near.ls + f.ls)
            if self.accept(both, (near.n, near.ls), (f.n, f.ls)):
                near.take(f, True)
                node.table[i] = near.bits
                return None
            node.append(f)
        else:
            halves = self._insert(near.below, f)
            if halves is None:
                near.take(f, False)
                node.table[i] = near.bits
                return None
            node.replace(i, halves[0])
            node.append(halves[1])
        return self._split(node) if len(node.features) > self.branching else None

    def _split(self, node: Node) -> tuple[Feature, Feature]:
        pole, one, two = poles(node.bits)
        left, right = self._node(node.leaf), self._node(node.leaf)
        for j, f in enumerate(node.features):
            (left if j == pole or one[j] > two[j] else right).append(f)
        if node.leaf:
            self._relink(node, left, right)
        return self._summary(left), self._summary(right)

    def _summary(self, node: Node) -> Feature:
        n = sum(f.n for f in node.features)
        ls = sum((f.ls for f in node.features), np.zeros(self.m, np.int64))
        return Feature(n, ls, [], node)

    def _relink(self, old: Node, left: Node, right: Node) -> None:
        left.after, right.after = right, old.after
        left.before, right.before = old.before, left
        if old.after is not None:
            old.after.before = right
        if self.first is old:
            self.first = left
            return
        old.before.after = left

    def clusters(self) -> list[Feature]:
        """Features of all leaves in leaf order."""
        out: list[Feature] = []
        at: Node | None = self.first
        while at is not None:
            out += at.features
            at = at.after
        return out


def fit(features: Iterable[Feature], m: int, accept: Criterion, branching: int = 50) -> list[Feature]:
    """Clusters of the features in the given order, the largest first; of equals in leaf order."""
    tree = Tree(m, accept, branching)
    for f in features:
        tree.insert(Feature(f.n, f.ls, list(f.ids)))
    return sorted(tree.clusters(), key=lambda f: -f.n)
