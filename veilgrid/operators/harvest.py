"""Buckets (ranges and noisy counts) from node tables, bottom-up.

One task harvests one wanted combination: it gets that combination's nodes and those of the
combinations within it, which are anonymized aggregates, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.intervals import Range
from ..functions.noise import hash_string

Ranges = tuple[tuple[float, float], ...]
BUCKET = "goal string, bucket long, lo array<double>, hi array<double>, count long"


@dataclass
class TreeNode:
    combo: tuple[int, ...]
    depth: int
    cell: tuple[int, ...]
    grid: Ranges
    actual: Ranges
    low: bool
    stub: bool
    split: bool
    noisy: int
    half_low: tuple[bool, ...]
    children: list[TreeNode] = field(default_factory=list)

    @property
    def single(self) -> bool:
        return all(a == b for a, b in self.actual)

    @property
    def ranges(self) -> Ranges:
        """Grid ranges, but the value itself where there is only one."""
        return tuple(x if x[0] == x[1] else g for g, x in zip(self.grid, self.actual, strict=True))


def read_nodes(rows: Iterable) -> dict[tuple, TreeNode]:
    """Nodes by (combo, depth, cell), linked to their children in cell order."""
    out: dict[tuple, TreeNode] = {}
    for r in rows:
        combo = tuple(int(x) for x in r.combo.split("_"))
        node = TreeNode(combo, int(r.depth), tuple(int(x) for x in r.cell), tuple(zip(r.lo, r.hi, strict=True)), tuple(zip(r.amin, r.amax, strict=True)), bool(r.low), bool(r.is_stub), bool(r.split), int(r.noisy), tuple(bool(x) for x in r.half_low))
        out[node.combo, node.depth, node.cell] = node
    for key in sorted(out):
        combo, depth, cell = key
        parent = out.get((combo, depth - 1, tuple(c >> 1 for c in cell))) if depth else None
        if parent is not None:
            parent.children.append(out[key])
    return out


def adjust_counts(counts: list[int], target: int) -> list[int]:
    """Counts in proportion to a new total, truncated; what that loses adds up along the list, and each time more than one is lost, one comes back."""
    share = np.asarray(counts, float) * (target / sum(counts))
    down = np.floor(share)
    returned = np.maximum(np.ceil(np.cumsum(share - down)) - 1, 0)
    return (down + np.diff(returned, prepend=0)).astype(np.int64).tolist()


class Harvest:
    def __init__(self, nodes: dict[tuple, TreeNode], safe: set[int], seed: int):
        self.nodes, self.safe, self.rng = nodes, safe, np.random.default_rng(seed)
        self.done: dict[tuple, list[tuple[Ranges, int]]] = {}

    def buckets(self, node: TreeNode) -> list[tuple[Ranges, int]]:
        key = (node.combo, node.depth, node.cell)
        if key not in self.done:
            self.done[key] = self._branch(node) if node.split else self._leaf(node)
        return self.done[key]

    def _leaf(self, node: TreeNode) -> list[tuple[Ranges, int]]:
        if node.low and not (len(node.combo) == 1 and node.combo[0] in self.safe):
            return []
        if node.single or len(node.combo) == 1:
            return [(node.ranges, node.noisy)]
        return self._refine(node, node.noisy)

    def _branch(self, node: TreeNode) -> list[tuple[Ranges, int]]:
        below = [b for child in node.children for b in self.buckets(child)]
        total = sum(n for _, n in below)
        if 2 * total < node.noisy:
            if len(node.combo) == 1:
                return [(node.ranges, node.noisy)]
            return below + self._refine(node, node.noisy - total)
        return [(r, n) for (r, _), n in zip(below, adjust_counts([n for _, n in below], node.noisy), strict=True)]

    def _sub(self, node: TreeNode) -> list[list[tuple[Ranges, int]]]:
        """Buckets of each subnode, in the order of combinations(dimensions, k - 1)."""
        out = []
        for keep in combinations(range(len(node.combo)), len(node.combo) - 1):
            own = tuple(node.actual[i] for i in keep)
            if all(a == b for a, b in own):
                out.append([(own, node.noisy)])
                continue
            sub = self.nodes.get((tuple(node.combo[i] for i in keep), node.depth, tuple(node.cell[i] for i in keep)))
            out.append(self.buckets(sub) if sub is not None else [])
        return out

    def _refine(self, node: TreeNode, count: int) -> list[tuple[Ranges, int]]:
        whole = [(node.ranges, count)]
        k = len(node.combo)
        subsets = list(combinations(range(k), k - 1))
        sub = [[b for b in x if b[1] > 0] for x in self._sub(node)]
        if not all(sub):
            return whole
        smallest = []
        for d in range(k):
            hulls = []
            for keep, found in zip(subsets, sub, strict=True):
                if d in keep:
                    at = keep.index(d)
                    hulls.append((min(r[at][0] for r, _ in found), max(r[at][1] for r, _ in found)))
            smallest.append(min(hulls, key=lambda x: x[1] - x[0]))
        smallest = [self._compact(node, d, x) for d, x in enumerate(smallest)]
        inside = lambda r, d: smallest[d][0] <= r[0] and r[1] <= smallest[d][1]
        single: list[list[tuple[tuple[float, float], int]]] = [[] for _ in range(k)]
        several: list[list[tuple[Ranges, int]]] = []
        for keep, found in zip(subsets, sub, strict=True):
            for at, d in enumerate(keep):
                single[d] += [(r[at], n) for r, n in found if inside(r[at], d)]
            several.append([(r, n) for r, n in found if all(inside(r[at], d) for at, d in enumerate(keep))])
        if not all(single) or not all(several):
            return whole
        # the i-th row takes subnode i mod k, and the dimension it lacks from that dimension's list
        out: dict[Ranges, int] = {}
        for s in range(k):
            rows = len(range(s, count, k))
            lacking = k - s - 1
            for r, x in zip(self._draw(several[s], rows), self._draw(single[lacking], rows), strict=True):
                full = (*r[:lacking], x, *r[lacking:])
                out[full] = out.get(full, 0) + 1
        return list(out.items())

    def _draw(self, weighted: list[tuple], n: int) -> list:
        edges = np.cumsum([w for _, w in weighted])
        return [weighted[i][0] for i in np.searchsorted(edges, self.rng.integers(0, edges[-1], n), side="right")]

    @staticmethod
    def _compact(node: TreeNode, d: int, small: tuple[float, float]) -> tuple[float, float]:
        lo, hi = node.grid[d]
        if not node.split and node.stub:
            lower, upper = node.half_low[2 * d], node.half_low[2 * d + 1]
            if lower != upper:
                lo, hi = Range(lo, hi).half(lower)
        if lo < small[1] and small[0] < hi:
            return max(lo, small[0]), min(hi, small[1])
        return min(lo, small[0]), max(hi, small[1])


def harvest(family: DataFrame, salt: bytes, safe: set[int]) -> DataFrame:
    """Buckets of each goal in a family of node tables."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        goal = rows["goal"].iloc[0]
        nodes = read_nodes(rows.itertuples(index=False))
        combo = tuple(int(x) for x in goal.split("_"))
        root = nodes.get((combo, 0, (0,) * len(combo)))
        found = Harvest(nodes, safe, hash_string(goal + salt.hex())).buckets(root) if root else []
        found = [x for x in found if x[1] > 0]
        return pd.DataFrame({"goal": [goal] * len(found), "bucket": range(len(found)), "lo": [[float(a) for a, _ in r] for r, _ in found], "hi": [[float(b) for _, b in r] for r, _ in found], "count": [n for _, n in found]})

    return family.groupBy("goal").applyInPandas(one, BUCKET)
