"""Vantage-point trees over a block of points that a task, or the driver, holds.

A node's point is a member of its own; the others are halved by their distance to it. Each half keeps the least and the
greatest of these distances, so that the triangle inequality bounds how near anything in it can be. Bounds only ever
rule out; what they can't is compared in integers by the caller, who also says how distances between points are worked
out and how far they may be off.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Distances from one point to some, by their numbers.
Far = Callable[[int, np.ndarray], np.ndarray]


@dataclass
class Node:
    """A leaf has members; else there are a point and two halves with the range of their distances to it."""

    members: np.ndarray | None = None
    point: int = -1
    halves: tuple[Node, Node] | None = None
    ranges: tuple[tuple[float, float], tuple[float, float]] = ((0.0, np.inf), (0.0, np.inf))


def grow(members: np.ndarray, far: Far, leaf: int) -> Node:
    """A tree whose leaves have at most ``leaf`` members. Halves are equal whatever the distances, so points that lie
    in the same place split like any others."""
    if len(members) <= max(1, leaf):
        return Node(members)
    at = int(np.argmax(np.nan_to_num(far(int(members[0]), members))))
    point, rest = int(members[at]), np.delete(members, at)
    d = far(point, rest)
    order = np.argsort(d, kind="stable")
    cut = (len(rest) + 1) // 2
    parts = [order[:cut], order[cut:]]
    ranges = tuple((float(d[p].min()), float(d[p].max())) if len(p) else (np.inf, np.inf) for p in parts)
    return Node(None, point, tuple(grow(rest[p], far, leaf) for p in parts), ranges)


@dataclass
class Flat:
    """A tree as lists: its inner nodes' points, its leaves' members, and bounds on all leaves for blocks of queries."""

    root: Node
    points: list[int] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        def walk(node: Node) -> None:
            if node.members is not None:
                self.leaves.append(node.members)
                return
            self.points.append(node.point)
            for half in node.halves:
                walk(half)

        walk(self.root)

    def bounds(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distances that each query (rows of ``d``, its distances to ``points``) can have to
        what each leaf holds."""
        lower = np.zeros((len(d), len(self.leaves)))
        upper = np.full((len(d), len(self.leaves)), np.inf)
        seen = [0, 0]

        def walk(node: Node, lo: np.ndarray, hi: np.ndarray) -> None:
            if node.members is not None:
                lower[:, seen[1]], upper[:, seen[1]] = lo, hi
                seen[1] += 1
                return
            own = d[:, seen[0]]
            seen[0] += 1
            for half, (a, b) in zip(node.halves, node.ranges, strict=True):
                walk(half, np.fmax(lo, np.fmax(own - b, a - own)), np.fmin(hi, own + b))

        walk(self.root, np.zeros(len(d)), np.full(len(d), np.inf))
        return lower, upper


def dealt(root: Node, n: int, far: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The leaf that each of ``n`` other points belongs to; ``far`` gives their distances to a node's point. Each goes
    to the half on its side of the middle between both halves (see ``opened``)."""
    out = np.zeros(n, np.int32)
    seen = 0

    def walk(node: Node, at: np.ndarray) -> None:
        nonlocal seen
        if node.members is not None:
            out[at] = seen
            seen += 1
            return
        near = far(node.point, at) <= _middle(node)
        walk(node.halves[0], at[near])
        walk(node.halves[1], at[~near])

    walk(root, np.arange(n))
    return out


def _middle(node: Node) -> float:
    return (node.ranges[0][1] + min(node.ranges[1][0], 1e300)) / 2


def opened(node: Node) -> Node:
    """The tree with the ranges that hold for points dealt to it later, not only for those it was grown from."""
    if node.members is not None:
        return node
    middle = _middle(node)
    return Node(None, node.point, tuple(opened(h) for h in node.halves), ((0.0, middle), (middle, np.inf)))


def nearest(root: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x`` the number of its nearest entry, the lower one of a tie, and the squared distance.

    Integers throughout: branch and bound in blocks of rows. A half is entered unless its bound, rounded towards the
    row, lies beyond the best distance; one that just reaches it is entered, as it may hold a lower number.
    """
    own = np.full(len(x), -1)
    best = np.zeros(len(x), x.dtype)

    def offer(at: np.ndarray, entry: int) -> np.ndarray:
        gap = x[at] - entries[entry]
        d = (gap * gap).sum(1) if gap.shape[1] else np.zeros(len(at), x.dtype)
        better = (own[at] < 0) | (d < best[at]) | ((d == best[at]) & (entry < own[at]))
        best[at[better]] = d[better]
        own[at[better]] = entry
        return np.sqrt(d.astype(np.float64))

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.members is not None:
            for entry in node.members:
                offer(at, int(entry))
            return
        d = offer(at, node.point)
        near = d <= _middle(node)
        for half, side in ((0, near), (1, ~near)):
            visit(node.halves[half], at[side])
        for half, side in ((0, ~near), (1, near)):
            lo, hi = node.ranges[half]
            some, e = at[side], d[side]
            reach = np.sqrt(best[some].astype(np.float64))
            gap = np.maximum(e - hi, lo - e) if np.isfinite(lo) else np.full(len(e), np.inf)
            visit(node.halves[half], some[gap <= reach + 1e-12 * (e + min(hi, 1e300) + reach)])

    visit(root, np.arange(len(x)))
    return own, best
