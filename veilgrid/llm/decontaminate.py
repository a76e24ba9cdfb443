"""Benchmark decontamination by an FM-index per training shard.

Each shard (a bounded slice of the documents that a task reads) is indexed and every window of
the benchmark is searched in it backwards.  A word that no benchmark item has cannot be part of
an occurrence, so only runs of benchmark words as long as the shortest window enter the index;
nothing that could match is left out.  The index is a suffix array's Burrows-Wheeler transform in
a wavelet matrix, whose ranks drive the backward search of all windows at once; occurrences are
located by walking to the nearest sampled suffix position, and overlapping ones merge into spans.

Defined cases: null and empty texts have no words and are never contaminated; an item of fewer
than `window` words is one window, an item of none is ignored; repeated rows or items count once
for each row and once for each item_id; a null item_id hits words and is listed as ''.
An empty benchmark hits nothing.  A broadcast holds a block of at most BLOCK_BYTES of the benchmark's
text (or one item): a benchmark of one block is searched in one pass over the documents, a larger one in a pass for
each block, whose hits are written, and merged by document at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import LOWER, binary_array, cut, encode_words, in_arrow, load, row_key, spans, steps, text_buffer

WINDOW = 10
BLOCK_BYTES = 16 << 20
SAMPLED = 8
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class WaveletMatrix:
    """Ranks of any symbol in a sequence, a bit of the symbol at a time."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, x = [], sequence
        for shift in range(bits - 1, -1, -1):
            bit = (x >> shift) & 1
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(x) - int(ones[-1])))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros_like(before)
        for shift, ones, zeros in self.levels:
            up = ((symbol >> shift) & 1).astype(bool)
            a, b = ones[begin], ones[before]
            begin = np.where(up, zeros + a, begin - a)
            before = np.where(up, zeros + b, before - b)
        return before - begin


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; s must end in a symbol smaller than all others."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
        if k >= n:
            return order


class FMIndex:
    """s: symbols from 2; 1 separates; a final 0 is added."""

    def __init__(self, s: np.ndarray, symbols: int):
        s = np.append(s, 0).astype(np.int64)
        sa = suffix_array(s)
        self.n = len(s)
        self.bwt = s[sa - 1]
        self.before = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=symbols), out=self.before[1:])
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols - 1).bit_length()))
        self.marked = sa % SAMPLED == 0
        self.sample = np.where(self.marked, sa, -1)

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns; a row holds a pattern from its last symbol to its first, then zeros."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for t in range(patterns.shape[1]):
            live = live[(lo[live] < hi[live]) & (patterns[live, t] > 0)]
            if not len(live):
                break
            c = patterns[live, t]
            both = self.before[np.concatenate([c, c])] + self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[: len(c)], both[len(c) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in s the suffixes of these rows start."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[at])
        while len(live):
            c = self.bwt[at[live]]
            at[live] = self.before[c] + self.tree.rank(c, at[live])
            walked[live] += 1
            live = live[~self.marked[at[live]]]
        return self.sample[at] + walked


class Windows:
    """The distinct windows of a block of items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({k for k, _ in items})
        number = {k: i for i, k in enumerate(self.names)}
        raw, at = text_buffer(pa.array([x for _, x in items], pa.large_string()))
        raw = LOWER[raw]
        start, end, first, mask = spans(raw, at, _WORD)
        ids, self.words = encode_words(raw, start, end, mask)
        found: dict[tuple[int, ...], set[int]] = {}
        for i, (k, _) in enumerate(items):
            w = ids[first[i] : first[i + 1]].tolist()
            for j in range(max(1, len(w) - window + 1)) if w else ():
                found.setdefault(tuple(w[j : j + window]), set()).add(number[k])
        self.length = np.array([len(x) for x in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, x in enumerate(found):
            self.patterns[i, : len(x)] = np.array(x[::-1]) + 2
        owners = [sorted(x) for x in found.values()]
        self.owner_at = np.append(0, np.cumsum([len(x) for x in owners])).astype(np.int64)
        self.owner = np.array([y for x in owners for y in x], np.int64)
        self.shortest = int(self.length.min()) if len(found) else 0

    def search(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, pattern) of each occurrence in documents of these word ids (-1: not a benchmark word)."""
        none = np.zeros(0, np.int64)
        if not self.shortest or not len(ids):
            return none, none, none
        known = ids >= 0
        opens = known.copy()
        opens[1:] &= ~known[:-1]
        closes = known.copy()
        closes[:-1] &= ~known[1:]
        edge = first[1:-1]
        edge = edge[(edge > 0) & (edge < len(ids))]
        opens[edge] |= known[edge]
        closes[edge - 1] |= known[edge - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        if not len(a):
            return none, none, none
        size = b - a + 1  # a separator after each run
        run_at = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(run_at - a, size)
        s = np.ones(len(place), np.int64)
        inside = np.ones(len(place), bool)
        inside[run_at + size - 1] = False
        s[inside] = ids[place[inside]] + 2
        index = FMIndex(s, len(self.words) + 2)
        lo, hi = index.count(self.patterns)
        n = hi - lo
        pattern = np.repeat(np.arange(len(n)), n)
        rows = np.arange(len(pattern)) - np.repeat(np.cumsum(n) - n - lo, n)
        return place[index.locate(rows)], self.length[pattern], pattern


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> Iterator[Windows]:
    held, size = [], 0
    for k, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text")).toLocalIterator():
        if not text:
            continue
        held.append((k, text))
        size += len(text.encode())
        if size >= most:
            yield Windows(held, window)
            held, size = [], 0
    if held:
        yield Windows(held, window)


class _Found:
    """Hits in the texts of a batch."""

    def __init__(self, batch: pa.RecordBatch, blocks: list[Windows]):
        self.batch = batch
        self.source, self.at = text_buffer(batch.column("text"))
        raw = LOWER[self.source]
        self.start, self.end, self.first, mask = spans(raw, self.at, _WORD)
        coded = binary_array(raw[mask], self.end - self.start).dictionary_encode() if len(self.start) else None
        self.change = np.zeros(len(self.start) + 1, np.int64)
        self.named: list[set[str]] = [set() for _ in range(batch.num_rows)]
        for w in blocks if coded is not None else ():
            of_word = pc.fill_null(pc.index_in(coded.dictionary, value_set=w.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            where, length, pattern = w.search(of_word[coded.indices.to_numpy(zero_copy_only=False)], self.first)
            self.add(where, where + length)
            n = w.owner_at[pattern + 1] - w.owner_at[pattern]
            item = w.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - w.owner_at[pattern], n)]
            doc = np.repeat(np.searchsorted(self.first, where, side="right") - 1, n)
            for x in np.unique(doc * len(w.names) + item).tolist():
                self.named[x // len(w.names)].add(w.names[x % len(w.names)])

    def add(self, lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(self.change, lo, 1)
        np.add.at(self.change, hi, -1)

    @property
    def hit(self) -> np.ndarray:
        return np.cumsum(self.change[:-1]) > 0

    def rows(self, with_text: bool) -> pa.RecordBatch:
        hit, first = self.hit, self.first
        total = np.append(0, np.cumsum(hit))
        n_hit = total[first[1:]] - total[first[:-1]]
        columns = {
            "doc_id": self.batch.column("doc_id"),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(x) for x in self.named], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in self.named], pa.string()),
            "contaminated": pa.array(n_hit > 0),
        }
        if with_text:
            columns = {c: self.batch.column(c) for c in self.batch.schema.names if c in ("doc_id", "text", "row")} | columns
            columns["clean_text"] = _without(self.batch.column("text"), self.source, self.at, self.start, self.end, first, hit, n_hit)
        return pa.RecordBatch.from_pydict(columns)


def _scan(shared: list, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield _Found(batch, [x.value for x in shared]).rows(with_text)

    return run


def _hits(shared):
    """(rid, lo, hi, items) of the documents that a block hits: merged spans of words, and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = _Found(batch, [shared.value])
            rid, hit, out = batch.column("rid").to_pylist(), found.hit, []
            for i in (i for i, x in enumerate(found.named) if x):
                step = np.diff(np.concatenate([[0], hit[found.first[i] : found.first[i + 1]], [0]]).astype(np.int8))
                out.append((rid[i], np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), sorted(found.named[i])))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], ["rid", "lo", "hi", "items"])

    return run


def _merged(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = _Found(batch, [])
            for i, (lo, hi, items) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "items")), strict=True)):
                if items:
                    found.named[i].update(items)
                    found.add(found.first[i] + np.array(lo, np.int64), found.first[i] + np.array(hi, np.int64))
            yield found.rows(with_text)

    return run


def _without(column: pa.Array, source, at, start, end, first, hit, n_hit) -> pa.Array:
    """The texts without their merged spans of hit words; those without a hit stay as they are."""
    out = column.to_pylist()
    for i in np.flatnonzero(n_hit).tolist():
        h = hit[first[i] : first[i + 1]]
        step = np.diff(np.concatenate([[0], h.view(np.int8), [0]]))
        a, b = np.flatnonzero(step == 1) + first[i], np.flatnonzero(step == -1) - 1 + first[i]
        cuts = np.concatenate([[at[i]], np.stack([start[a], end[b]], 1).ravel(), [at[i + 1]]]).tolist()
        out[i] = b"".join(source[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """A row per document; with_text keeps doc_id, text, row and adds clean_text, the text without its removal spans."""
    sc = docs.sparkSession.sparkContext
    found = StructType().add("n_words", LongType()).add("n_hit", LongType()).add("n_items", LongType()).add("items_sha256", StringType()).add("contaminated", BooleanType())
    if with_text:
        keep = docs.select("doc_id", "text", *[c for c in docs.columns if c == "row"])
        schema = StructType([*keep.schema, *found, StructField("clean_text", StringType())])
    else:
        keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        schema = StructType([keep.schema["doc_id"], *found])
    every = blocks(benchmark, window)
    first, second = next(every, None), next(every, None)
    if second is None:
        return keep.transform(in_arrow, _scan([sc.broadcast(first)] if first is not None else [], with_text), schema)
    rows = keep.withColumn("rid", row_key())
    hits = None
    for block in chain([first, second], every):
        shared = sc.broadcast(block)
        got = cut(rows.select("text", "rid").transform(in_arrow, _hits(shared), "rid long, lo array<long>, hi array<long>, items array<string>"), "hits")
        shared.unpersist()
        one = got.dropDuplicates(["rid"])
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("rid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi", "items")])  # of one text
    return rows.join(merged, "rid", "left").drop("rid").transform(in_arrow, _merged(with_text), schema)


def op8_benchmark_fm_index(spark, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} ws FROM benchmark),
p AS (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) i FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT item_id, least(10, len(ws)) n, array_to_string(ws[i:i+9], ' ') g FROM p),
d AS (SELECT doc_id, {_WORDS} ws FROM documents),
n AS (SELECT DISTINCT n FROM k),
g AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) i FROM d, n WHERE len(ws) >= n),
h AS (SELECT doc_id, item_id, g.i, g.n FROM (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') g FROM g) g JOIN k ON g.g = k.g AND g.n = k.n),
w AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""
