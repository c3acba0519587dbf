"""A tree of cells over a cloud of points in any number of dimensions, and searches in it.

The tree splits a bounded sample at medians, each time along the axis on which the sample is widest; equal points are never
parted, so a place with many copies is one cell. Its leaves are cells; every node knows the box and the number of all the
points below it, once these have been counted. The tree is small: LEAVES cells at most, whatever the cloud's size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Most cells of a tree, and points of the sample for each.
LEAVES, SAMPLED = 1 << 15, 8


@dataclass
class Tree:
    axis: np.ndarray  # of each node; -1 for a leaf
    value: np.ndarray  # points with a smaller or equal coordinate are on the left
    left: np.ndarray  # the right child is the next one; a leaf's cell
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    count: np.ndarray | None = None

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        todo = np.arange(len(points))
        while len(todo):
            at = node[todo]
            todo = todo[self.axis[at] >= 0]
            at = node[todo]
            node[todo] = self.left[at] + (points[todo, self.axis[at]] > self.value[at])
        return self.left[node]

    def measured(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Tree:
        """The tree with boxes and numbers of points, from those of the cells that hold any."""
        n, d = len(self.axis), low.shape[1]
        self.low, self.high, self.count = np.full((n, d), np.inf), np.full((n, d), -np.inf), np.zeros(n, np.int64)
        leaf = np.flatnonzero(self.axis < 0)
        place = np.empty(len(leaf), np.int64)
        place[self.left[leaf]] = leaf
        self.low[place[cell]], self.high[place[cell]], self.count[place[cell]] = low, high, count
        levels, level = [], np.zeros(min(1, n), np.int64)
        while len(level := level[self.axis[level] >= 0]):
            levels.append(level)
            level = np.concatenate([self.left[level], self.left[level] + 1])
        for level in reversed(levels):
            k = self.left[level]
            self.low[level] = np.minimum(self.low[k], self.low[k + 1])
            self.high[level] = np.maximum(self.high[k], self.high[k + 1])
            self.count[level] = self.count[k] + self.count[k + 1]
        return self

    def squared(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances of points from the boxes of nodes, one by one; infinite from an empty node. Rounding never
        makes one larger than the distance to a point in the box, as each term is computed the same way."""
        with np.errstate(invalid="ignore"):
            apart = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
            total = np.zeros(len(points))
            for c in range(points.shape[1]):
                total += apart[:, c] * apart[:, c]
        return np.where(self.count[node] > 0, total, np.inf)

    def seeds(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell): cells near each point that hold k points together (or all points)."""
        node = np.zeros(len(points), np.int64)
        todo = np.arange(len(points))
        while len(todo):  # down to the nearer child while it has k points
            todo = todo[self.axis[node[todo]] >= 0]
            left = self.left[node[todo]]
            nearer = left + (self.squared(points[todo], left + 1) < self.squared(points[todo], left))
            enough = self.count[nearer] >= k
            todo, nearer = todo[enough], nearer[enough]
            node[todo] = nearer
        return self.leaves(np.arange(len(points)), node)

    def leaves(self, point: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells with points below the nodes."""
        points, cells = [], []
        while len(node):
            some = self.count[node] > 0
            point, node = point[some], node[some]
            leaf = self.axis[node] < 0
            points.append(point[leaf])
            cells.append(self.left[node[leaf]])
            point, node = np.repeat(point[~leaf], 2), np.stack([self.left[node[~leaf]], self.left[node[~leaf]] + 1], 1).ravel()
        return (np.concatenate(points), np.concatenate(cells)) if points else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def within(self, points: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, squared distance of its box) of all cells that reach into each point's ball."""
        point, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found = []
        while len(node):
            far = self.squared(points[point], node)
            good = far <= d2[point]
            point, node, far = point[good], node[good], far[good]
            leaf = self.axis[node] < 0
            found.append((point[leaf], self.left[node[leaf]], far[leaf]))
            point, node = np.repeat(point[~leaf], 2), np.stack([self.left[node[~leaf]], self.left[node[~leaf]] + 1], 1).ravel()
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def grown(sample: np.ndarray, leaves: int) -> Tree:
    """A tree with `leaves` cells of about equal parts of the sample; fewer where equal points cannot be parted."""
    axis, value, left = [-1], [0.0], [0]
    open_ = [(0, np.arange(len(sample)), leaves)]
    while open_:
        node, rows, parts = open_.pop()
        if parts < 2 or len(rows) < 2:
            continue
        x = sample[rows]
        wide = x.max(0) - x.min(0)
        c = int(wide.argmax())
        if not wide[c] > 0:
            continue
        column = x[:, c]
        cut = np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2]
        if cut == column.max():  # the upper half is one place: it goes to the right
            cut = column[column < cut].max()
        right = column > cut
        axis[node], value[node], left[node] = c, cut, len(axis)
        for side in (~right, right):
            axis.append(-1)
            value.append(0.0)
            left.append(0)
            open_.append((len(axis) - 1, rows[side], parts // 2))
    tree = Tree(np.array(axis), np.array(value), np.array(left))
    leaf = np.flatnonzero(tree.axis < 0)
    tree.left[leaf] = np.arange(len(leaf))
    return tree


@dataclass
class Packed:
    """Points with the cells of a tree over all of them, in memory."""

    tree: Tree
    x: np.ndarray
    row: np.ndarray  # where each point stood
    cuts: np.ndarray  # where the points of each cell begin

    @staticmethod
    def of(x: np.ndarray, most: int = SAMPLED) -> Packed:
        """Cells have about `most` points, or those of one place."""
        tree = grown(x, max(1, len(x) // most))
        cell = tree.assign(x)
        row = np.argsort(cell, kind="stable")
        cells = np.arange(cell.max(initial=-1) + 1)
        return Packed(tree, x[row], row, np.searchsorted(cell[row], np.arange(len(cells) + 1))).boxed()

    def boxed(self) -> Packed:
        """With the boxes of the cells measured."""
        if len(self.x):
            ends = (f.reduceat(self.x, self.cuts[:-1]) for f in (np.minimum, np.maximum))
            self.tree.measured(np.arange(len(self.cuts) - 1), *ends, np.diff(self.cuts))
        return self

    def at(self, x: np.ndarray) -> Packed:
        """The same points at other places, each in the cell that it was in."""
        return Packed(replace(self.tree), x[self.row], self.row, self.cuts).boxed()

    def within(self, points: np.ndarray, point: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, row, squared distance) of all that stand in the cells that points meet."""
        many = self.cuts[cell + 1] - self.cuts[cell]
        point = np.repeat(point, many)
        at = np.arange(len(point)) + np.repeat(self.cuts[cell] - (np.cumsum(many) - many), many)
        d2 = np.zeros(len(point))
        for c in range(points.shape[1]):
            gap = points[point, c] - self.x[at, c]
            d2 += gap * gap
        return point, self.row[at], d2

    def close(self, points: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, row, squared distance) of those in each point's ball of squared radius `worst`."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1024, (1 << 20) // max(1, len(self.x)))
        for start in range(0, len(points) if len(self.x) else 0, step):
            some, far = points[start : start + step], worst[start : start + step]
            point, row, d2 = self.within(some, *self.tree.within(some, far)[:2])
            near = d2 <= far[point]
            found.append((point[near] + start, row[near], d2[near]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def nearest(self, points: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(point, row, squared distance, rank): the k nearest of each point, ties by row; ranks from 1. `bound`: a squared
        distance that these have at most."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for start in range(0, len(points) if len(self.x) else 0, 1024):
            some = points[start : start + 1024]
            point, _, d2 = self.within(some, *self.tree.seeds(some, k))
            order = np.lexsort((d2, point))
            point, d2 = point[order], d2[order]
            last = np.searchsorted(point, np.arange(len(some))) + k - 1
            worst = np.full(len(some), np.inf)
            there = last < np.searchsorted(point, np.arange(len(some)), "right")
            worst[there] = d2[last[there]]
            if bound is not None:
                worst = np.minimum(worst, bound[start : start + 1024])
            point, row, d2 = self.close(some, worst)
            order = np.lexsort((row, d2, point))
            point, row, d2 = point[order], row[order], d2[order]
            rank = np.arange(len(point)) - np.searchsorted(point, point) + 1
            near = rank <= k
            found.append((point[near] + start, row[near], d2[near], rank[near]))
        return tuple(np.concatenate(c) for c in zip(*found))
