"""Trees of nested ranges, built for all column combinations of one size at once.

A node is a row: combo (column numbers joined by "_"), depth, cell (its place on the grid of that
depth, a number for each dimension), the grid range, the range of its data, and what its protected
entities amount to.  A row's cells at all depths follow from its values alone, so rows never move
down: they are packed once into blocks, equal rows as one with a weight, and a pass over the blocks
counts the nodes of several depths.  With ids a block holds all rows of an entity, so that what
blocks count adds up; blocks are made for each kind of entities.  A node's subnodes are the
nodes of the smaller combinations with the same depth and projected cell, found by an equi-join.
Nodes with few packed rows are finished in one task, which gives the same statistics; whether a group is
low, and its noisy count, are column expressions over these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import Range, midpoint
from ..functions.noise import any_low, count_rows, hash_string, hash_strings, is_low_count, largest_kept, noise, noisy_row_limit, unsigned, xor_all
from ..functions.params import AnonymizationParams, BucketizationParams
from ..sources.tables import cut

Combo = tuple[int, ...]
#: What is counted of a node for one kind of entities (m: packed rows), and how it is finished.
_PAIR = "struct<entities:bigint,seed:bigint>"
COUNTS = f"combo string, depth int, cell array<bigint>, lo array<double>, hi array<double>, amin array<double>, amax array<double>, m bigint, n bigint, n_in bigint, kind int, entities bigint, rows bigint, unaccounted bigint, seed bigint, largest array<struct<n:bigint,h:bigint>>, halves array<{_PAIR}>, inner {_PAIR}"
FINISHED = COUNTS + ", is_stub boolean, split boolean"
#: Rows of a block of entities, and packed rows of a node that is finished, with all below it, in one task.
BLOCK, LOCAL_ROWS = 1 << 18, 200_000
#: Nodes of a combination that a pass counts at most, if it counts more than one depth.
AHEAD = 256
_FLIP = -(1 << 63)


def key_of(combo: Combo) -> str:
    return "_".join(map(str, combo))


def subcombos(combo: Combo) -> list[Combo]:
    return list(combinations(combo, len(combo) - 1))


def _mids(k: int) -> list[Column]:
    return [F.col("lo")[i] + (F.col("hi")[i] - F.col("lo")[i]) / 2 for i in range(k)]


def node_statistics(active: DataFrame, k: int, keep: int, unique: bool) -> DataFrame:
    """Aggregates by node.  Rows of outliers count, but don't stretch a node's data range or decide a split."""
    node = ["combo", "cell"]
    own = ~F.col("outlier")
    upper = [F.col("x")[i] >= m for i, m in enumerate(_mids(k))]
    shape = [F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count("*").alias("n"), F.count_if(own).alias("n_in")]
    shape += [F.array(*[f(F.when(own, F.col("x")[i])) for i in range(k)]).alias(name) for name, f in (("amin", F.min), ("amax", F.max))]
    shape.append(F.array(F.count_if(own & ~upper[0]), F.count_if(own & upper[0])).alias("half_in"))
    halves = [h for u in upper for h in (~u, u)]
    if unique:
        pid = F.col("pids")[0]
        xor = lambda c: F.coalesce(F.bit_xor(F.when(c, pid)), F.lit(0).cast("long"))
        entity = lambda c: F.struct(F.count_if(c & pid.isNotNull()).alias("entities"), xor(c).alias("seed"))
        kind = F.struct(F.count(pid).alias("entities"), F.count(pid).alias("rows"), F.count_if(pid.isNull()).alias("unaccounted"), xor(F.lit(True)).alias("seed"), F.array().cast("array<struct<n:bigint,h:bigint>>").alias("largest"), F.array(*[entity(h) for h in halves]).alias("halves"))
        inner = F.struct(F.count_if(own & pid.isNotNull()).alias("entities"), xor(own).alias("seed"))
        return active.groupBy(*node).agg(*shape, F.array(kind).alias("kinds"), F.array(inner).alias("inner"))
    shapes = active.groupBy(*node).agg(*shape)
    by_pid = active.select(*node, "outlier", F.posexplode("pids").alias("kind", "pid"), *[h.alias(f"h{i}") for i, h in enumerate(halves)])
    by_pid = by_pid.groupBy(*node, "kind", "pid").agg(F.count("*").alias("c"), F.bool_or(~F.col("outlier")).alias("inn"), *[F.bool_or(f"h{i}").alias(f"h{i}") for i in range(2 * k)])
    has = F.col("pid").isNotNull()
    xor = lambda c: F.coalesce(F.bit_xor(F.when(c & has, F.col("pid"))), F.lit(0).cast("long"))
    entity = lambda c: F.struct(F.count_if(c & has).alias("entities"), xor(c).alias("seed"))
    sums = by_pid.groupBy(*node, "kind").agg(F.count("pid").alias("entities"), F.sum(F.when(has, F.col("c")).otherwise(0)).alias("rows"), F.sum(F.when(has, 0).otherwise(F.col("c"))).alias("unaccounted"), xor(F.lit(True)).alias("seed"), F.array(*[entity(F.col(f"h{i}")) for i in range(2 * k)]).alias("halves"), entity(F.col("inn")).alias("inner"))
    # the largest contributions; Spark limits each group before the shuffle
    from pyspark.sql import Window

    order = Window.partitionBy(*node, "kind").orderBy(F.desc("c"), F.desc(F.col("pid").bitwiseXOR(F.lit(-(1 << 63)))))
    top = by_pid.filter(has).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).groupBy(*node, "kind").agg(F.sort_array(F.collect_list(F.struct("r", F.col("c").alias("n"), F.col("pid").alias("h")))).alias("t"))
    top = top.select(*node, "kind", F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"))).alias("largest"))
    each = sums.join(top, [*node, "kind"], "left").select(*node, "kind", "inner", F.struct("entities", "rows", "unaccounted", "seed", F.coalesce("largest", F.array().cast("array<struct<n:bigint,h:bigint>>")).alias("largest"), "halves").alias("s"))
    kinds_of = each.groupBy(*node).agg(F.transform(F.sort_array(F.collect_list(F.struct("kind", "s", "inner"))), lambda x: x["s"]).alias("kinds"), F.transform(F.sort_array(F.collect_list(F.struct("kind", "s", "inner"))), lambda x: x["inner"]).alias("inner"))
    return shapes.join(kinds_of, node)


class Rules:
    """What decides whether nodes of these combinations (of one size) split, what is low about them, and what they count."""

    def __init__(self, params: AnonymizationParams, buckets: BucketizationParams, unique: bool, safe: set[str], limits: dict[str, int], seeds: dict[str, int]):
        self.params, self.buckets, self.unique, self.safe, self.limits, self.seeds = params, buckets, unique, safe, limits, seeds

    def _of_combo(self, values: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[F.col("combo")]

    def split(self) -> Column:
        deep = (F.col("depth") <= self.buckets.precision_limit_depth_threshold) | (F.col("n_in") >= self._of_combo(self.limits))
        enough = F.col("combo").isin(*self.safe) if self.safe else F.lit(False)
        enough = enough | ~any_low("inner", self.params.salt, self.params.low_count_params)
        return deep & ~F.col("is_stub") & (F.col("amin") != F.col("amax")) & (F.col("n_in") > 1) & enough

    def split_here(self, combo: str, depth: int, is_stub: bool, single: bool, n_in: int, inner: list[tuple[int, int]]) -> bool:
        """The same in Python, for a node at hand."""
        if is_stub or single or n_in <= 1 or depth > self.buckets.precision_limit_depth_threshold and n_in < self.limits[combo]:
            return False
        return combo in self.safe or not is_low_count(self.params.salt, self.params.low_count_params, [(n, unsigned(seed)) for n, seed in inner])

    def judge(self, stats: DataFrame, k: int) -> DataFrame:
        """Node rows from statistics; in Python, as column expressions of so many hashes take half a millisecond a node."""
        return stats.select(*_ASKED).mapInArrow(self._judging(k), JUDGED)

    def _judging(self, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield self._judged(batch, k)

        return run

    def _judged(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        params, salt, suppress = self.params, self.params.salt, self.params.low_count_params
        known: dict[str, int] = {}

        def label(x: float) -> int:
            text = str(x)
            if text not in known:
                known[text] = hash_string(text)
            return known[text]

        combos, lo, hi, amin, amax, stub, split = (batch[c].to_pylist() for c in ("combo", "lo", "hi", "amin", "amax", "is_stub", "split"))
        kinds = batch["kinds"].flatten()
        entities, rows, unaccounted, seeds, largest, halves = kinds.flatten()
        entities, rows, unaccounted, seeds = (x.to_pylist() for x in (entities, rows, unaccounted, seeds))
        sizes = [0, *np.cumsum(largest.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
        counts, ids = (x.to_pylist() for x in largest.flatten().flatten())
        half_n, half_seed = (x.to_pylist() for x in halves.flatten().flatten())
        each = len(entities) // batch.num_rows
        low, stub_sub, noisy, half_low = [], [], [], []
        for i, combo in enumerate(combos):
            own = range(i * each, (i + 1) * each)
            pairs = [(entities[j], unsigned(seeds[j])) for j in own]
            single = amin[i] == amax[i]
            low.append(is_low_count(salt, suppress, pairs))
            stub_sub.append(stub[i] or is_low_count(salt, replace(suppress, low_threshold=self.buckets.singularity_low_threshold if single else self.buckets.range_low_threshold), pairs))
            seed = xor_all({t: label(t) for t in (a if a == b else midpoint(c, d) for a, b, c, d in zip(amin[i], amax[i], lo[i], hi[i], strict=True))}.values()) ^ self.seeds[combo]
            if self.unique:
                n = round(entities[own[0]] + noise(salt, "noise", params.layer_noise_sd, [seed, pairs[0][1]]))
            else:
                n = count_rows(params, seed, [(entities[j], rows[j], unaccounted[j], unsigned(seeds[j]), counts[sizes[j] : sizes[j + 1]], ids[sizes[j] : sizes[j + 1]]) for j in own])
            noisy.append(max(n, 1))
            # of stubs that don't split, the only ones that harvesting asks
            asked = stub[i] and not split[i]
            half_low.append([asked and is_low_count(salt, suppress, [(half_n[j * 2 * k + h], unsigned(half_seed[j * 2 * k + h])) for j in own]) for h in range(2 * k)])
        columns = {c: batch[c] for c in ("combo", "depth", "cell", "lo", "hi", "amin", "amax", "n")} | {"low": pa.array(low), "stub_sub": pa.array(stub_sub), "is_stub": batch["is_stub"], "split": batch["split"], "noisy": pa.array(noisy, pa.int64()), "half_low": pa.array(half_low, pa.list_(pa.bool_()))}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_ASKED = ["combo", "depth", "cell", "lo", "hi", "amin", "amax", "n", "kinds", "is_stub", "split"]
JUDGED = "combo string, depth int, cell array<bigint>, lo array<double>, hi array<double>, amin array<double>, amax array<double>, n bigint, low boolean, stub_sub boolean, is_stub boolean, split boolean, noisy bigint, half_low array<boolean>"


def _with_stubs(stats: DataFrame, combos: list[Combo], smaller: DataFrame | None) -> DataFrame:
    """A node is a stub if every subnode is missing or one that can't stand for it."""
    if smaller is None:
        return stats.withColumn("is_stub", F.lit(False))
    cases = F.lit(None).cast("array<struct<s:string,c:array<bigint>>>")
    for combo in combos:
        subs = [F.struct(F.lit(key_of(s)).alias("s"), F.array(*[F.col("cell")[combo.index(c)] for c in s]).alias("c")) for s in subcombos(combo)]
        cases = F.when(F.col("combo") == key_of(combo), F.array(*subs)).otherwise(cases)
    need = stats.select("combo", "depth", "cell", F.explode(cases).alias("sub")).select("combo", "depth", "cell", "sub.s", "sub.c")
    have = smaller.select(F.col("combo").alias("s"), "depth", F.col("cell").alias("c"), "stub_sub")
    stub = need.join(have, ["s", "depth", "c"], "left").groupBy("combo", "depth", "cell").agg(F.bool_and(F.coalesce("stub_sub", F.lit(True))).alias("is_stub"))
    return stats.join(stub, ["combo", "depth", "cell"])


class Packed:
    """Packed rows: x (values, a column each), w (rows that are equal), and for each kind of entities a and b.

    With ids, a is the id and b whether there is one; where each row is an entity of its own, the xor of
    the ids and how many there are.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.x, self.w, self.a, self.b = x, w, a, b

    def __len__(self) -> int:
        return len(self.w)

    def take(self, at: np.ndarray, columns: list[int] | None = None) -> Packed:
        x = self.x[at] if columns is None else self.x[np.ix_(at, columns)]
        return Packed(x, self.w[at], self.a[:, at], self.b[:, at])

    def dump(self) -> dict[str, bytes]:
        return {"x": np.ascontiguousarray(self.x, np.float64).tobytes(), "w": self.w.astype(np.int64).tobytes(), "a": np.ascontiguousarray(self.a, np.int64).tobytes(), "b": np.ascontiguousarray(self.b, np.int64).tobytes()}

    @staticmethod
    def load(blocks: list[tuple[bytes, bytes, bytes, bytes]]) -> Packed:
        """Of what dump gave, one or more."""
        ws = [np.frombuffer(w, np.int64) for _, w, _, _ in blocks]
        xs = [np.frombuffer(x, np.float64).reshape(len(w), -1) for (x, *_), w in zip(blocks, ws, strict=True)]
        ids = [[np.frombuffer(z[i], np.int64).reshape(-1, len(w)) for z, w in zip(blocks, ws, strict=True)] for i in (2, 3)]
        return Packed(np.concatenate(xs), np.concatenate(ws), *[np.concatenate(y, axis=1) for y in ids])


DUMP = "x binary, w binary, a binary, b binary"


class Grid:
    """Where the rows of one combination are, from its roots; rows outside the root of a single column count as outliers and go where its least or largest other value is."""

    def __init__(self, combo: Combo, roots: list[Range], ends: list[tuple[float, float] | None]):
        self.combo, self.lo, self.hi = combo, np.array([roots[c].lo for c in combo]), np.array([roots[c].hi for c in combo])
        self.ends = ends[combo[0]] if len(combo) == 1 else None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts of the root's size from its lower end, rows that always go up, outliers)."""
        outlier = np.zeros(len(x), bool)
        at = x
        if len(self.combo) == 1:
            outlier = ~((x[:, 0] == self.lo[0]) | (x[:, 0] >= self.lo[0]) & (x[:, 0] < self.hi[0]))
            if self.ends is not None and outlier.any():
                at = np.where(outlier[:, None], np.where(x < self.lo, *self.ends), x)
        size = np.where(self.hi > self.lo, self.hi - self.lo, 1.0)
        u = np.where(self.hi > self.lo, np.maximum((at - self.lo) / size, 0.0), 0.0)
        return u, u >= 1, outlier

    @staticmethod
    def cells(u: np.ndarray, top: np.ndarray, depth: int) -> np.ndarray:
        return np.where(top, (1 << min(depth, 62)) - 1, np.floor(np.ldexp(np.where(top, 0.0, u), depth)).astype(np.int64))

    def ranges(self, cells: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.ldexp(self.hi - self.lo, -depth)
        lo = self.lo + cells * size
        return lo, lo + size


def _grouped(cells: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal cells."""
    out = np.unique(cells[:, 0], return_inverse=True)[1]
    for i in range(1, cells.shape[1]):
        other = np.unique(cells[:, i], return_inverse=True)[1]
        out = np.unique(out * (int(other.max()) + 1) + other, return_inverse=True)[1]
    return out


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(values) else np.zeros(0, np.int64)


def _xors(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(values, starts) if len(values) else np.zeros(0, np.int64)


def _lists(size: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values)


def _wide(values: np.ndarray) -> pa.Array:
    return _lists(np.full(len(values), values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))


def _structs(**fields: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x).ravel(), pa.int64()) for x in fields.values()], list(fields))


def count_nodes(rows: Packed, grid: Grid, cells: np.ndarray, outlier: np.ndarray, depth: int, unique: bool, keep: int, kinds: list[int]) -> tuple[np.ndarray, np.ndarray, dict[int, dict]]:
    """(node of each row, cells of nodes, for each kind the columns of COUNTS but for combo, depth and kind) of rows at one depth.  Rows of outliers count, but don't stretch a node's data range or decide a split."""
    k = cells.shape[1]
    group = _grouped(cells)
    order = np.argsort(group, kind="stable")
    g = group[order]
    starts = np.flatnonzero(np.diff(g, prepend=-1))
    x, w, own = rows.x[order], rows.w[order], ~outlier[order]
    places = cells[order][starts]
    lo, hi = grid.ranges(places, depth)
    mid = midpoint(lo, hi)
    upper = x >= mid[g]
    masks = [m for i in range(k) for m in (~upper[:, i], upper[:, i])]
    shape = {"cell": places, "lo": lo, "hi": hi, "amin": np.minimum.reduceat(np.where(own[:, None], x, np.inf), starts), "amax": np.maximum.reduceat(np.where(own[:, None], x, -np.inf), starts), "m": np.diff(starts, append=len(g)), "n": _sums(w, starts), "n_in": _sums(np.where(own, w, 0), starts)}
    out = {}
    for kind in kinds:
        a, b = rows.a[kind][order], rows.b[kind][order]
        if unique:
            entities = lambda mask, a=a, b=b: (_sums(np.where(mask, b, 0), starts), _xors(np.where(mask, a, 0), starts))
            every = np.ones(len(g), bool)
            number, seed = entities(every)
            more = {"entities": number, "rows": number, "unaccounted": shape["n"] - number, "seed": seed, "largest": None, "halves": [entities(m) for m in masks], "inner": entities(own)}
        else:
            has = b > 0
            accounted = _sums(np.where(has, w, 0), starts)
            at = np.flatnonzero(has)
            at = at[np.lexsort((a[at], g[at]))]
            p, h = a[at], g[at]
            first = np.flatnonzero((np.diff(h, prepend=-1) != 0) | (np.diff(p, prepend=0) != 0) | (np.arange(len(p)) == 0))
            pg, pp, c = h[first], p[first], _sums(w[at], first)
            some = lambda mask, at=at, first=first: np.logical_or.reduceat(mask[at], first) if len(at) else np.zeros(0, bool)

            def entities(mask, pg=pg, pp=pp):
                number, seed = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
                here = np.flatnonzero(mask)
                if len(here):
                    begin = np.flatnonzero(np.diff(pg[here], prepend=-1))
                    number[pg[here][begin]] = np.diff(begin, append=len(here))
                    seed[pg[here][begin]] = _xors(pp[here], begin)
                return number, seed

            number, seed = entities(np.ones(len(pg), bool))
            turned = pp ^ np.int64(_FLIP)
            ranks = np.lexsort((turned, c, -pg))[::-1]  # by node, the largest first, then the largest id
            rank = np.arange(len(ranks)) - np.repeat(np.cumsum(number) - number, number)
            top = ranks[rank < keep]
            more = {"entities": number, "rows": accounted, "unaccounted": shape["n"] - accounted, "seed": seed, "largest": (np.minimum(number, keep), c[top], turned[top]), "halves": [entities(some(m)) for m in masks], "inner": entities(some(own))}
        out[kind] = shape | more
    return group, places, out


def _arrow(combo: str, depth: int, kind: int, got: dict, more: dict | None = None) -> pa.RecordBatch:
    """COUNTS, and more, of nodes."""
    n = len(got["n"])
    size, count, ids = got["largest"] or (np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    columns = {"combo": pa.array([combo] * n, pa.string()), "depth": pa.array(np.full(n, depth), pa.int32())}
    columns |= {name: _wide(got[name]) for name in ("cell", "lo", "hi", "amin", "amax")} | {name: pa.array(got[name], pa.int64()) for name in ("m", "n", "n_in")}
    columns |= {"kind": pa.array(np.full(n, kind), pa.int32())} | {name: pa.array(got[name], pa.int64()) for name in ("entities", "rows", "unaccounted", "seed")}
    halves = [np.stack([h[i] for h in got["halves"]], axis=1) for i in (0, 1)]
    columns |= {"largest": _lists(size, _structs(n=count, h=ids)), "halves": _lists(np.full(n, len(got["halves"])), _structs(entities=halves[0], seed=halves[1])), "inner": _structs(entities=got["inner"][0], seed=got["inner"][1])}
    columns |= {name: pa.array(x) for name, x in (more or {}).items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _member(cells: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row the place of its cell among the wanted ones (different), else -1."""
    both = _grouped(np.concatenate([wanted, cells]))
    of = np.full(int(both.max(initial=0)) + 1, -1)
    of[both[: len(wanted)]] = np.arange(len(wanted))
    return of[both[len(wanted):]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Packed]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["kind"][i].as_py(), Packed.load([tuple(batch[c][i].as_py() for c in "xwab")])


def _counting(todo: list[tuple[Grid, int, np.ndarray | None, int]], unique: bool, keep: int, inside: bool):
    """Blocks to COUNTS.  todo: grid, first depth, cells one depth above it that go on (all rows if None), depths; inside: without outliers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, block in _read(batches):
            for grid, depth, above, depths in todo:
                own = Packed(block.x[:, list(grid.combo)], block.w, block.a, block.b)
                u, top, outlier = grid.place(own.x)
                at = np.ones(len(own), bool)
                if above is not None:
                    at = _member(grid.cells(u, top, depth - 1), above) >= 0
                if inside:
                    at &= ~outlier
                if not at.all():
                    own, u, top, outlier = own.take(np.flatnonzero(at)), u[at], top[at], outlier[at]
                for d in range(depth, depth + depths) if len(own) else ():
                    _, _, got = count_nodes(own, grid, grid.cells(u, top, d), outlier, d, unique, keep, [kind])
                    yield _arrow(key_of(grid.combo), d, kind, got[kind])

    return run


def _sending(todo: list[tuple[Grid, int, np.ndarray, np.ndarray]]):
    """Blocks to the packed rows of nodes, with the nodes' numbers.  todo: grid, depth, cells, their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, block in _read(batches):
            for grid, depth, cells, numbers in todo if kind == 0 else ():
                u, top, _ = grid.place(block.x[:, list(grid.combo)])
                node = _member(grid.cells(u, top, depth), cells)
                order = np.argsort(node, kind="stable")
                order = order[np.searchsorted(node[order], 0):]
                starts = np.flatnonzero(np.diff(node[order], prepend=-1))
                made = [{"start": int(numbers[node[part[0]]])} | block.take(part, list(grid.combo)).dump() for part in np.split(order, starts[1:]) if len(part)]
                if made:
                    yield pa.RecordBatch.from_pylist(made, pa.schema([("start", pa.int64()), *[(c, pa.binary()) for c in "xwab"]]))

    return run


def _finishing(rules: Rules, starts: list[tuple[Grid, int]], has_smaller: bool, keep: int, kinds: int):
    """Packed rows of one node, and its subnodes from there down, to FINISHED of all nodes from there down."""

    def run(rows: pa.Table, subs: pa.Table) -> pa.Table:
        made: list[pa.RecordBatch] = []
        if rows.num_rows:
            grid, depth = starts[rows["start"][0].as_py()]
            combo = key_of(grid.combo)
            own = Packed.load(list(zip(*[rows[c].to_pylist() for c in "xwab"], strict=True)))
            stubs = {(s, d, *c): stub for s, d, c, stub in zip(*[subs[c].to_pylist() for c in ("s", "depth", "c", "stub_sub")], strict=True)}
            parts = [(key_of(s), [grid.combo.index(c) for c in s]) for s in subcombos(grid.combo)] if has_smaller else []
            u, top, outlier = grid.place(own.x)
            while len(own):
                group, places, got = count_nodes(own, grid, grid.cells(u, top, depth), outlier, depth, rules.unique, keep, list(range(kinds)))
                stub = np.array([bool(parts) and all(stubs.get((s, depth, *[c[i] for i in of]), True) for s, of in parts) for c in places.tolist()])
                inner = [list(zip(*[got[j]["inner"][i].tolist() for i in (0, 1)], strict=True)) for j in range(kinds)]
                single = (got[0]["amin"] == got[0]["amax"]).all(axis=1)
                split = np.array([rules.split_here(combo, depth, is_stub, one, n, [x[i] for x in inner]) for i, (is_stub, one, n) in enumerate(zip(stub.tolist(), single.tolist(), got[0]["n_in"].tolist(), strict=True))])
                made += [_arrow(combo, depth, j, got[j], {"is_stub": stub, "split": split}) for j in range(kinds)]
                at = split[group]
                own, u, top, outlier = own.take(np.flatnonzero(at)), u[at], top[at], outlier[at]
                depth += 1
        if not made:
            return _EMPTY
        return pa.Table.from_batches(made)

    return run


_PAIR_TYPE = pa.struct([("entities", pa.int64()), ("seed", pa.int64())])
_FLOATS, _LONG = pa.list_(pa.float64()), pa.int64()
_EMPTY = pa.schema([
    ("combo", pa.string()), ("depth", pa.int32()), ("cell", pa.list_(_LONG)), ("lo", _FLOATS), ("hi", _FLOATS), ("amin", _FLOATS), ("amax", _FLOATS), ("m", _LONG), ("n", _LONG), ("n_in", _LONG), ("kind", pa.int32()), ("entities", _LONG), ("rows", _LONG),
    ("unaccounted", _LONG), ("seed", _LONG), ("largest", pa.list_(pa.struct([("n", _LONG), ("h", _LONG)]))), ("halves", pa.list_(_PAIR_TYPE)), ("inner", _PAIR_TYPE), ("is_stub", pa.bool_()), ("split", pa.bool_())]).empty_table()


class TreeBuilder:
    """rows: pids array<long> and v array<double>, one entry for each encoded column; or, where each row is an entity of its own, equal rows as one: v, w (how many), e and s (how many ids, xor of these)."""

    def __init__(self, rows: DataFrame, names: list[str], roots: list[Range], params: AnonymizationParams, buckets: BucketizationParams, unique: bool, value_safe: list[bool] | None = None):
        self.rows, self.names, self.params, self.buckets, self.unique = rows, names, params, buckets, unique
        self.value_safe = value_safe or [False] * len(names)
        self.roots = list(roots)
        self.ends: list[tuple[float, float] | None] = [None] * len(names)
        self.levels: dict[int, DataFrame] = {}
        self.built: set[Combo] = set()
        self._pack()
        self._push_down()

    def _pack(self) -> None:
        """Rows to blocks (kind, packed rows): of entities of one kind, or, where each row is one, of equal rows."""
        columns, weighted = len(self.names), "w" in self.rows.columns
        self.total = int(self.rows.agg(F.sum("w") if weighted else F.count("*")).first()[0] or 0)
        values = [F.col("v")[i].alias(f"x{i}") for i in range(columns)]
        names = [f"x{i}" for i in range(columns)]
        if self.unique:
            self.kinds = 1
            one = self.rows.select(*values, "w", "e", "s") if weighted else self.rows.select(*values, F.lit(1).cast("long").alias("w"), F.when(F.col("pids")[0].isNotNull(), 1).otherwise(0).cast("long").alias("e"), F.coalesce(F.col("pids")[0], F.lit(0).cast("long")).alias("s"))
            rows = one.groupBy(*names).agg(F.sum("w").alias("w"), F.bit_xor("s").alias("a0"), F.sum("e").alias("b0")).withColumns({"kind": F.lit(0), "block": F.lit(0)})
        else:
            first = self.rows.select(F.size("pids")).first()
            self.kinds = first[0] if first else 1
            blocks = max(-(-self.total // BLOCK), min(16, -(-self.total // (BLOCK // 8))), 1)
            ids = [F.col("pids")[j].alias(f"a{j}") for j in range(self.kinds)]
            dealt = [F.struct(F.lit(j).alias("kind"), F.pmod(F.coalesce(F.when(F.col(f"a{j}").isNotNull(), F.xxhash64(f"a{j}")), F.xxhash64(*names)), F.lit(blocks)).cast("int").alias("block")) for j in range(self.kinds)]
            rows = self.rows.select(*ids, *values).select("*", F.explode(F.array(*dealt)).alias("_d")).select("_d.*", *[f"a{j}" for j in range(self.kinds)], *names)
            # one shuffle: equal rows are of one block
            rows = rows.repartition("kind", "block").groupBy("kind", "block", *[f"a{j}" for j in range(self.kinds)], *names).agg(F.count("*").alias("w"))
            rows = rows.withColumns({f"b{j}": F.when(F.col(f"a{j}").isNotNull(), 1).otherwise(0).cast("long") for j in range(self.kinds)} | {f"a{j}": F.coalesce(F.col(f"a{j}"), F.lit(0).cast("long")) for j in range(self.kinds)})
        kinds, schema = self.kinds, pa.schema([("kind", pa.int32()), ("m", pa.int64()), *[(c, pa.binary()) for c in "xwab"]])

        def packed(table: pa.Table) -> pa.RecordBatch:
            stack = lambda names, kind: np.stack([table[c].to_numpy() for c in names]).astype(kind)
            x = stack(names, np.float64).T if names else np.zeros((table.num_rows, 0))
            own = Packed(x, stack(["w"], np.int64)[0], stack([f"a{j}" for j in range(kinds)], np.int64), stack([f"b{j}" for j in range(kinds)], np.int64))
            return pa.RecordBatch.from_pylist([{"kind": table["kind"][0].as_py(), "m": len(own)} | own.dump()], schema)

        if self.unique:
            def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held, n = [], 0
                for batch in batches:
                    held.append(batch)
                    n += batch.num_rows
                    if n >= BLOCK:
                        yield packed(pa.Table.from_batches(held))
                        held, n = [], 0
                if n:
                    yield packed(pa.Table.from_batches(held))

            made = rows.mapInArrow(pieces, f"kind int, m bigint, {DUMP}")
        else:
            made = rows.groupBy("kind", "block").applyInArrow(lambda table: pa.Table.from_batches([packed(table)]), f"kind int, m bigint, {DUMP}")
        self.blocks = cut(made)
        self.size = int(self.blocks.filter("kind = 0").agg(F.sum("m")).first()[0] or 0)

    def _seed(self, combo: Combo) -> int:
        return hash_strings(self.names[c] for c in combo)

    def _rules(self, combos: list[Combo]) -> Rules:
        k = len(combos[0])
        keys = {key_of(c): c for c in combos}
        safe = {key for key, c in keys.items() if k == 1 and self.value_safe[c[0]]}
        limits = {key: noisy_row_limit(self.params.salt, self._seed(c), self.total, self.buckets.precision_limit_row_fraction) if k == 1 else 0 for key, c in keys.items()}
        return Rules(self.params, self.buckets, self.unique, safe, limits, {key: self._seed(c) for key, c in keys.items()})

    def _read_blocks(self) -> DataFrame:
        return self.blocks.select("kind", *"xwab")

    def _counted(self, todo: list[tuple[Grid, int, np.ndarray | None, int]], inside: bool = False) -> DataFrame:
        """Statistics of the nodes of these grids, with their kinds together; what blocks counted is added up."""
        keep, k = largest_kept(self.params), len(todo[0][0].combo)
        parts = self._read_blocks().mapInArrow(_counting(todo, self.unique, keep, inside), COUNTS)
        total = lambda c: F.sum(c).alias(c)
        pair = lambda c: F.struct(F.sum(c["entities"]).alias("entities"), F.bit_xor(c["seed"]).alias("seed"))
        sums = parts.groupBy("combo", "depth", "cell", "kind").agg(
            F.first("lo").alias("lo"), F.first("hi").alias("hi"), *[F.array(*[f(F.col(name)[i]) for i in range(k)]).alias(name) for name, f in (("amin", F.min), ("amax", F.max))],
            *map(total, ("m", "n", "n_in", "entities", "rows", "unaccounted")), F.bit_xor("seed").alias("seed"),
            F.slice(F.sort_array(F.flatten(F.collect_list("largest")), asc=False), 1, keep).alias("largest"), F.array(*[pair(F.col("halves")[i]) for i in range(2 * k)]).alias("halves"), pair(F.col("inner")).alias("inner"))
        return self._with_kinds(sums)

    def _with_kinds(self, counts: DataFrame) -> DataFrame:
        """One row of each node, from one for each kind of entities."""
        largest = F.transform("largest", lambda y: F.struct(y["n"].alias("n"), y["h"].bitwiseXOR(F.lit(_FLIP)).alias("h")))
        one = F.struct("entities", "rows", "unaccounted", "seed", largest.alias("largest"), "halves")
        rest = [c for c in counts.columns if c not in ("kind", "entities", "rows", "unaccounted", "seed", "largest", "halves", "inner")]
        if self.kinds == 1:
            return counts.select(*rest, F.array(one).alias("kinds"), F.array("inner").alias("inner"))
        node = ["combo", "depth", "cell"]
        each = F.sort_array(F.collect_list(F.struct("kind", one.alias("s"), "inner")))
        by = counts.groupBy(*node).agg(*[F.first(c).alias(c) for c in rest if c not in node], each.alias("_k"))
        return by.select(*rest, F.transform("_k", lambda x: x["s"]).alias("kinds"), F.transform("_k", lambda x: x["inner"]).alias("inner"))

    def _push_down(self) -> None:
        """Moves one-column roots into the half that holds all but a low count."""
        waiting = list(range(len(self.names)))
        low = lambda kinds: is_low_count(self.params.salt, self.params.low_count_params, [(x["entities"], unsigned(x["seed"])) for x in kinds])
        while waiting and self.total:
            combos = [(c,) for c in waiting]
            rules, depths = self._rules(combos), 1 + int(math.log2(AHEAD))
            found = {}
            for r in self._counted([(Grid(c, self.roots, self.ends), 0, None, depths) for c in combos], inside=True).select("combo", "depth", "cell", "amin", "amax", "n_in", "inner", "kinds").collect():
                found[int(r["combo"]), r["depth"], r["cell"][0]] = r
            moved = []
            for c in waiting:
                split = lambda r, depth, c=c: r is not None and rules.split_here(str(c), depth, False, r["amin"] == r["amax"], r["n_in"], [(x["entities"], x["seed"]) for x in r["inner"]])
                depth, cell = 0, 0
                while split(found.get((c, depth, cell)), 0):
                    if depth + 1 == depths:
                        moved.append(c)
                        break
                    below = [found.get((c, depth + 1, 2 * cell + h)) for h in (0, 1)]
                    gone = [r is None or not split(r, 1) and low(r["kinds"]) for r in below]
                    if gone[0] == gone[1]:
                        break
                    depth, cell = depth + 1, 2 * cell + int(gone[0])
                    self.roots[c] = self.roots[c].half(gone[0])
                if (r := found.get((c, depth, cell))) is not None:
                    self.ends[c] = r["amin"][0], r["amax"][0]
            waiting = moved

    def _ahead(self, active: int, k: int) -> int:
        """Depths that a pass counts."""
        return max(1, int(math.log2(max(1, AHEAD // active))) // k)

    def build(self, combos: list[Combo]) -> None:
        """All trees that these combinations need, smaller ones first."""
        need = {s for c in combos for k in range(1, len(c) + 1) for s in combinations(sorted(c), k)} - self.built
        for k in sorted({len(c) for c in need}):
            now = sorted(c for c in need if len(c) == k)
            rules, smaller = self._rules(now), self.levels.get(k - 1)
            grids = {key_of(c): Grid(c, self.roots, self.ends) for c in now}
            made: list[DataFrame] = []
            starts: list[tuple[Grid, int, tuple[int, ...]]] = []
            active: dict[str, tuple[int, np.ndarray | None]] = {key: (0, None) for key in grids}
            if self.size <= LOCAL_ROWS:
                starts, active = [(g, 0, (0,) * k) for g in grids.values()], {}
            while active:
                todo = [(grids[key], depth, above, self._ahead(1 if above is None else len(above) << k, k)) for key, (depth, above) in active.items()]
                stats = cut(_with_stubs(self._counted(todo), now, smaller).withColumn("split", rules.split()))
                by: dict[str, dict[int, dict[tuple, tuple[bool, int]]]] = {}
                for r in stats.select("combo", "depth", "cell", "split", "m").collect():
                    by.setdefault(r["combo"], {}).setdefault(r["depth"], {})[tuple(r["cell"])] = (r["split"], r["m"])
                kept, going = [], {}
                for grid, first, _, depths in todo:
                    key = key_of(grid.combo)
                    parents: set[tuple] | None = None
                    for depth in range(first, first + depths):
                        on = set()
                        for cell, (split, m) in by.get(key, {}).get(depth, {}).items():
                            if parents is not None and tuple(c >> 1 for c in cell) not in parents:
                                continue
                            if split and m <= LOCAL_ROWS:
                                starts.append((grid, depth, cell))
                                continue
                            kept.append((key, depth, list(cell)))
                            if split:
                                on.add(cell)
                        parents = on
                    if parents:
                        going[key] = first + depths, np.array(sorted(parents), np.int64)
                made.append(rules.judge(stats.join(F.broadcast(stats.sparkSession.createDataFrame(kept, "combo string, depth int, cell array<long>")), ["combo", "depth", "cell"], "left_semi"), k))
                active = going
            if starts:
                made.append(rules.judge(self._finished(rules, starts, smaller), k))
            nodes = made[0]
            for x in made[1:]:
                nodes = nodes.unionByName(x)
            self.levels[k] = cut(nodes if k not in self.levels else self.levels[k].unionByName(nodes))
            self.built |= set(now)

    def _finished(self, rules: Rules, starts: list[tuple[Grid, int, tuple[int, ...]]], smaller: DataFrame | None) -> DataFrame:
        """Statistics of these nodes and all below, a node and what is below it in one task."""
        spark = self.blocks.sparkSession
        by: dict[tuple[str, int], tuple[Grid, int, list]] = {}
        for i, (grid, depth, cell) in enumerate(starts):
            by.setdefault((key_of(grid.combo), depth), (grid, depth, []))[2].append((cell, i))
        todo = [(grid, depth, np.array([c for c, _ in own], np.int64), np.array([i for _, i in own])) for grid, depth, own in by.values()]
        rows = self._read_blocks().mapInArrow(_sending(todo), f"start bigint, {DUMP}")
        if smaller is None:
            subs = spark.createDataFrame([], "start long, s string, depth int, c array<long>, stub_sub boolean")
        else:
            need = [(i, key_of(s), depth, [cell[grid.combo.index(c)] for c in s]) for i, (grid, depth, cell) in enumerate(starts) for s in subcombos(grid.combo)]
            need = spark.createDataFrame(need, "start long, s string, first int, top array<long>")
            depths = F.filter(F.array(*[F.lit(d) for d in sorted({d for _, d, _ in starts})]), lambda d: d <= F.col("depth"))
            have = smaller.select(F.col("combo").alias("s"), "depth", F.col("cell").alias("c"), "stub_sub", F.explode(depths).alias("first")).withColumn("top", F.expr("transform(c, v -> shiftright(v, depth - first))"))
            subs = have.join(F.broadcast(need), ["s", "first", "top"]).select("start", "s", "depth", "c", "stub_sub")
        finish = _finishing(rules, [(grid, depth) for grid, depth, _ in starts], smaller is not None, largest_kept(self.params), self.kinds)
        # nodes are judged by all tasks: a large start has very many
        return self._with_kinds(rows.groupBy("start").cogroup(subs.groupBy("start")).applyInArrow(finish, FINISHED).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def nodes(self, combo: Combo) -> DataFrame:
        """The node table of one combination."""
        combo = tuple(sorted(combo))
        self.build([combo])
        return self.levels[len(combo)].filter(F.col("combo") == key_of(combo))

    def dump(self, combo: Combo) -> DataFrame:
        """A tree to read, a node a row, each followed by what is below it: (path, node); a path is one bit a dimension and level."""
        k = len(combo)
        bits = F.expr(f"array_join(transform(sequence(1, depth), d -> concat({', '.join(f'cast(shiftright(cell[{i}], depth - d) & 1 as string)' for i in range(k))})), '.')")
        path = F.when(F.col("depth") == 0, "").otherwise(bits)
        ranges = F.array_join(F.transform(F.arrays_zip("lo", "hi"), lambda x: F.format_string("[%s, %s)", x["lo"].cast("string"), x["hi"].cast("string"))), " x ")
        kind = F.when(F.col("split"), "branch").when(F.col("is_stub"), "stub").otherwise("leaf")
        text = F.concat(F.repeat(F.lit("  "), F.col("depth")), kind, F.lit(" "), ranges, F.lit(" rows "), F.col("noisy").cast("string"))
        return self.nodes(combo).select(path.alias("path"), text.alias("node")).orderBy("path")

    def family(self, combos: list[Combo]) -> DataFrame:
        """The nodes of these combinations and all their parts, once for each `goal` combination."""
        combos = [tuple(sorted(c)) for c in combos]
        self.build(combos)
        wanted: dict[str, list[str]] = {}
        for c in combos:
            for k in range(1, len(c) + 1):
                for s in combinations(c, k):
                    wanted.setdefault(key_of(s), []).append(key_of(c))
        every = None
        for k in range(1, max(map(len, combos)) + 1):
            every = self.levels[k] if every is None else every.unionByName(self.levels[k])
        goals = every.sparkSession.createDataFrame([(s, g) for s, gs in wanted.items() for g in gs], "combo string, goal string")
        return every.join(F.broadcast(goals), "combo")
