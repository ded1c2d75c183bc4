"""Signature tree over sets: nodes hold OR-combined token bitmaps and size ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF, FAN = 16, 8


class Forest:
    """Union-find over places ``0..n``."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class SignatureTree:
    """Levels of nodes over sets in order of size; ``sets`` are sorted arrays of 64-bit tokens.

    ``excess`` is the largest number of tokens that share a bit with an earlier token of their set, so
    two members of nodes A and B have at most popcount(A & B) + min(excess) tokens in common.
    """

    def __init__(self, sets: list[np.ndarray], places: np.ndarray, bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64), sizes))
        self.sets, self.places, sizes = [sets[i] for i in order], places[order], sizes[order]
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = s & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        excess = sizes - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, sizes, sizes, excess)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(maps), step)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))
            step = FAN
        if len(self.levels) == 1:
            self.levels.append(self.levels[0])

    def children(self, level: int, node: int) -> range:
        step = LEAF if level == 1 else FAN
        return range(node * step, min((node + 1) * step, len(self.levels[level - 1][0])))


def possible(a: tuple, i: slice | np.ndarray, b: tuple, j: slice | np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether members of nodes i of ``a`` and j of ``b`` can link, by their largest possible overlap."""
    both = np.bitwise_count(a[0][i][:, None] & b[0][j][None]).sum(2, dtype=np.int64) + np.minimum(a[3][i][:, None], b[3][j][None])
    low_a, high_a, low_b, high_b = a[1][i][:, None], a[2][i][:, None], b[1][j][None], b[2][j][None]
    overlap = np.minimum(both, np.minimum(high_a, high_b))
    return ((num + den) * overlap >= num * (low_a + low_b)) & (den * np.minimum(high_a, high_b) >= num * np.maximum(low_a, low_b))


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum()) if len(x) else 0
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


class Joined:
    """Which nodes of a tree have all their members in one component; components only grow, so what is found stays."""

    def __init__(self, tree: SignatureTree, forest: Forest):
        self.tree, self.forest = tree, forest
        self.one = [None, *(np.zeros(len(x[0]), bool) for x in tree.levels[1:])]

    def root(self, level: int, node: int) -> int | None:
        """The component of all members of a node, if there is one such."""
        if not level:
            return self.forest.root(int(self.tree.places[node]))
        below = self.tree.children(level, node)
        first = self.root(level - 1, below.start)
        if first is None or self.one[level][node]:
            return first
        if all(self.root(level - 1, i) == first for i in below):
            self.one[level][node] = True
            return first
        return None


def links(a: SignatureTree, b: SignatureTree, forest: Forest, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between members of two trees, or within one, that join what was not joined before.

    Node pairs are opened from the top, near ones first, while their largest possible overlap allows a link and
    their members are not all in one component; what survives is compared token by token.
    """
    same = a is b
    of_a = Joined(a, forest)
    of_b = of_a if same else Joined(b, forest)
    levels = len(a.levels) - 1, len(b.levels) - 1
    stack = [(levels[0], 0, levels[1], 0)]
    while stack:
        la, na, lb, nb = stack.pop()
        joined = of_a.root(la, na)
        if joined is not None and joined == of_b.root(lb, nb):
            continue
        if la == 1 and lb == 1:
            i, j = a.children(1, na), b.children(1, nb)
            apart = np.array([forest.root(int(u)) for u in a.places[i.start : i.stop]])[:, None] != np.array([forest.root(int(v)) for v in b.places[j.start : j.stop]])
            if not apart.any():
                continue
            may = possible(a.levels[0], slice(i.start, i.stop), b.levels[0], slice(j.start, j.stop), num, den)
            for p, q in np.argwhere(may & apart):
                p, q = p + i.start, q + j.start
                u, v = int(a.places[p]), int(b.places[q])
                if (same and p >= q) or u == v or forest.root(u) == forest.root(v):
                    continue
                if linked(a.sets[p], b.sets[q], num, den):
                    forest.join(u, v)
                    yield u, v
            continue
        if la >= lb:
            i, j, down_a, down_b = a.children(la, na), range(nb, nb + 1), la - 1, lb
            if same and la == lb:
                j, down_b = b.children(lb, nb), lb - 1
        else:
            i, j, down_a, down_b = range(na, na + 1), b.children(lb, nb), la, lb - 1
        may = possible(a.levels[down_a], slice(i.start, i.stop), b.levels[down_b], slice(j.start, j.stop), num, den)
        pairs = [(int(p) + i.start, int(q) + j.start) for p, q in np.argwhere(may)]
        stack += sorted(((down_a, p, down_b, q) for p, q in pairs if not same or p <= q), key=lambda x: -abs(x[1] - x[3]))
