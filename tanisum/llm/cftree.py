"""A cluster-feature tree: (number, vector sum, squared sum) summaries of vectors, found through a tree of centroids.

Whole batches go down the tree together. A leaf holds up to LEAF entries, an
inner node up to WIDTH nodes; fuller ones split along the axis between their
two poles. Summaries go in like vectors do, so trees of different tasks merge
by inserting the entries of one into another.
"""

from __future__ import annotations

import numpy as np

LEAF, WIDTH = 48, 32


def _halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of x in parts of at most ``most``, split again and again between two far apart rows."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        mine = x[rows]
        one = mine[((mine - mine.mean(0)) ** 2).sum(1).argmax()]
        two = mine[((mine - one) ** 2).sum(1).argmax()]
        along = mine @ (two - one)
        left = along < (one @ (two - one) + two @ (two - one)) / 2
        if not len(rows) // 8 <= left.sum() <= len(rows) - len(rows) // 8:
            left = np.zeros(len(rows), bool)
            left[np.argsort(along, kind="stable")[: len(rows) // 2]] = True
        todo += [rows[left], rows[~left]]
    return out


class Node:
    """A leaf with entries, or an inner node with nodes and their sums."""

    __slots__ = ("entries", "kids", "n", "total")

    def __init__(self, entries: np.ndarray | None = None, kids: list[Node] | None = None):
        self.entries, self.kids = entries, kids or []
        self.n = self.total = None


class Tree:
    """Entries join while their radius stays within ``limit`` (squared), which grows when there are too many of them."""

    def __init__(self, dim: int):
        self.limit, self.dim, self.count = 0.0, dim, 0
        self._n, self._square = np.zeros(256), np.zeros(256)
        self._total = np.zeros((256, dim), np.float32)
        self.root = Node(np.zeros(0, np.int64))

    @property
    def n(self) -> np.ndarray:
        return self._n[: self.count]

    @property
    def total(self) -> np.ndarray:
        return self._total[: self.count]

    @property
    def square(self) -> np.ndarray:
        return self._square[: self.count]

    def _centroids(self, entries: np.ndarray) -> np.ndarray:
        return self._total[entries] / self._n[entries, None].astype(np.float32)

    def _append(self, n: np.ndarray, total: np.ndarray, square: np.ndarray) -> np.ndarray:
        at = np.arange(self.count, self.count + len(n))
        self.count += len(n)
        if self.count > len(self._n):
            more = max(self.count, 2 * len(self._n)) - len(self._n)
            self._n, self._square = (np.concatenate([v, np.zeros(more)]) for v in (self._n, self._square))
            self._total = np.concatenate([self._total, np.zeros((more, self.dim), np.float32)])
        self._n[at], self._total[at], self._square[at] = n, total, square
        return at

    def _sums(self, node: Node) -> tuple[float, np.ndarray]:
        if node.entries is not None:
            return float(self._n[node.entries].sum()), self._total[node.entries].sum(0)
        return float(node.n.sum()), node.total.sum(0)

    def _inner(self, kids: list[Node]) -> Node:
        node = Node(kids=kids)
        sums = [self._sums(k) for k in kids]
        node.n, node.total = np.array([s[0] for s in sums]), np.array([s[1] for s in sums])
        return node

    def _split(self, node: Node) -> list[Node]:
        if node.entries is not None:
            if len(node.entries) <= LEAF:
                return [node]
            return [Node(node.entries[part]) for part in _halves(self._centroids(node.entries), LEAF)]
        if len(node.kids) <= WIDTH:
            return [node]
        return [self._inner([node.kids[i] for i in part]) for part in _halves(node.total / node.n[:, None], WIDTH)]

    def _grown(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = self._split(self._inner(nodes))
        return nodes[0]

    def insert(self, total: np.ndarray, n: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Puts in vectors (n = 1) or summaries; the entry of each."""
        place = np.empty(len(n), np.int64)
        x = total / n[:, None].astype(np.float32)

        def down(node: Node, rows: np.ndarray) -> list[Node]:
            if node.entries is None:
                c = (node.total / node.n[:, None]).astype(np.float32)
                at = (x[rows] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
                order = np.argsort(at, kind="stable")
                hit, start = np.unique(at[order], return_index=True)
                kids: list[Node] = []
                changed = False
                for k, part in zip(hit.tolist(), np.split(rows[order], start[1:]), strict=True):
                    got = down(node.kids[k], part)
                    node.n[k] += n[part].sum()
                    node.total[k] += total[part].sum(0)
                    changed |= len(got) > 1
                    node.kids[k] = got[0]
                    kids += [] if len(got) == 1 else got[1:]
                    if len(got) > 1:
                        node.n[k], node.total[k] = self._sums(got[0])
                if changed:
                    more = self._inner(kids)
                    node.kids = node.kids + kids
                    node.n, node.total = np.concatenate([node.n, more.n]), np.concatenate([node.total, more.total])
                return self._split(node)
            entry = np.full(len(rows), -1)
            if len(node.entries):
                c = self._centroids(node.entries)
                e = node.entries[(x[rows] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)]
                both = self._n[e] + n[rows]
                radius = (self._square[e] + square[rows]) / both - ((self._total[e] + total[rows]) ** 2).sum(1) / both**2
                entry = np.where(radius <= self.limit + 1e-7, e, -1)
                in_ = entry >= 0
                np.add.at(self._n, entry[in_], n[rows[in_]])
                np.add.at(self._total, entry[in_], total[rows[in_]])
                np.add.at(self._square, entry[in_], square[rows[in_]])
            new = rows[entry < 0]
            entry[entry < 0] = made = self._append(n[new], total[new], square[new])
            place[rows] = entry
            node.entries = np.concatenate([node.entries, made])
            return self._split(node)

        if len(n):
            self.root = self._grown(down(self.root, np.arange(len(n))))
        return place

    def leaves(self) -> list[np.ndarray]:
        todo, out = [self.root], []
        while todo:
            node = todo.pop()
            if node.entries is None:
                todo += node.kids
            else:
                out.append(node.entries)
        return out

    def condense(self, most: int) -> np.ndarray:
        """Merges entries of a leaf that are each other's best partner, the cheapest first, until ``most`` are left; the new entry of each old one."""
        moved = np.arange(self.count)
        while self.count > most:
            a, b, cost = [], [], []
            for e in self.leaves():
                if len(e) < 2:
                    continue
                n, t, s = self._n[e], self._total[e].astype(np.float64), self._square[e]
                both = n[:, None] + n
                own = (t**2).sum(1)
                r = (s[:, None] + s) / both - (own[:, None] + own + 2 * t @ t.T) / both**2
                np.fill_diagonal(r, np.inf)
                best = r.argmin(1)
                i = np.flatnonzero((best[best] == np.arange(len(e))) & (np.arange(len(e)) < best))
                a.append(e[i])
                b.append(e[best[i]])
                cost.append(r[i, best[i]])
            if a:
                a, b, cost = np.concatenate(a), np.concatenate(b), np.concatenate(cost)
                some = np.argsort(cost, kind="stable")[: self.count - most]
                a, b = a[some], b[some]
                self.limit = max(self.limit, float(cost[some].max()))
                root = np.arange(self.count)
                root[b] = a
                for values in (self._n, self._total, self._square):
                    values[a] += values[b]
                kept, inv = np.unique(root, return_inverse=True)
                m = len(kept)
                for values in (self._n, self._total, self._square):
                    values[:m] = values[kept]
                self.count, moved = m, inv[moved]
            # build the tree anew over what is left
            self.root = self._grown(self._split(Node(np.arange(self.count))))
        return moved

    def top(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the nodes of the deepest level with at most ``most`` nodes, or of the entries if they are no more."""
        if self.count <= most:
            return self.n, self.total
        level = [self.root]
        while level[0].entries is None and sum(len(x.kids) for x in level) <= most:
            level = [k for x in level for k in x.kids]
        sums = [self._sums(x) for x in level]
        return np.array([s[0] for s in sums]), np.array([s[1] for s in sums])
