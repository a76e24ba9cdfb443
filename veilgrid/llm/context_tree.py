"""Language-model scoring by context-tree weighting of bytes.

A text is its bytes with A-Z lower-cased and an end symbol.  A byte is eight binary decisions;
each decision node has a context tree over the `DEPTH` preceding bytes, whose nodes hold
Krichevsky-Trofimov estimates.  The weighted probability of a node is half its own block
probability and half its children's product; a prediction mixes the estimates of all depths along
the context by the resulting posterior weights.  Mixing ends at the deepest context that training
has seen; a decision never seen at all costs one bit.

Nothing that grows with the corpus is broadcast or collected.  Each partition of texts sends its
distinct (context, byte) grams and its distinct words, with training counts, to counting buckets;
a bucket holds whole subtrees below two context bytes.  The nodes above (at most 256 contexts)
are summed by Spark, and the buckets then answer every partition with one figure for each gram
and word it sent.  Repeated grams (of a partition) and words (of a piece of it) are added up before
they are sent, so a hot one costs a row for each partition or piece.

The base score is that of additively smoothed words.  Defined cases: null is an empty text, which
has its end only; without training rows every decision costs one bit, and c, N and V are 0; rows
with a null doc_id train; repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary_array, cut, encode_words, hash_words, in_arrow, load, mix, parts_for, row_key, spans, steps, text_buffer, unzip_arrays, zip_arrays

DEPTH, TOP = 6, 2
TEXT_BYTES, BUCKET_BYTES = 3_500_000, 8_000_000
_STEP = 6 << 20
_END = b" "  # no word has a blank
_NODES = np.array([[1 << j | s >> (8 - j) for j in range(8)] for s in range(256)], np.int64)
_BITS = np.array([[s >> (7 - j) & 1 for j in range(8)] for s in range(256)], np.int64)
_RANKED = 1 << 20  # keys from which on a table of 16 million ranks costs less than it spares
_BLOCK = 1 << 16  # values of a step whose arrays stay below what workers map and unmap each time


def lgamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    z = x + 8
    down = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(down)


_FEW = 4096
_HALF, _WHOLE = lgamma(np.arange(_FEW) + 0.5), lgamma(np.arange(_FEW) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones, in any order: whole numbers, small ones looked up."""
    out, few = np.empty(a.shape), a + b < _FEW
    x, y = a[few].astype(np.int64), b[few].astype(np.int64)
    out[few] = _HALF[x] + _HALF[y] - _WHOLE[x + y] - np.log(np.pi)
    x, y = a[~few], b[~few]
    out[~few] = lgamma(x + 0.5) + lgamma(y + 0.5) - lgamma(x + y + 1) - np.log(np.pi)
    return out


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte and end (nearest context byte highest, the symbol lowest), and where each text's begin."""
    n = len(at) - 1
    s = np.full(len(raw) + n * (DEPTH + 1) + 1, 0xFF, np.uint8)
    first = at[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH + 1
    end = first + np.diff(at)
    valid = np.ones(len(s), bool)
    valid[0] = False
    valid[first[:, None] - np.arange(1, DEPTH + 1)] = False
    valid[end] = False
    s[valid] = LOWER[raw]
    valid[end] = True
    # the eight bytes that end with a symbol, the nearest context byte as second highest: the symbol moves to the lowest
    eight = np.ndarray(max(0, len(s) - 7), "<u8", s, strides=(1,))
    key, to = np.empty(len(raw) + n, np.int64), 0
    for lo in range(0, len(eight), _BLOCK):
        x = eight[lo : lo + _BLOCK][valid[lo + 7 : lo + 7 + _BLOCK]].astype(np.uint64)
        key[to : to + len(x)] = x & np.uint64(0x00FFFFFFFFFFFF00) | x >> np.uint64(56)
        to += len(x)
    return key, at[:-1] + np.arange(n)


def _argsorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    return order, np.append(True, key[1:] != key[:-1])


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and which of the ordered ones differ from the one before.

    Three bytes are ranked by a table, so that mostly a key and its place fit one number: sorting such
    numbers is several times as fast as np.argsort, which orders the others and few keys."""
    if len(key) < _RANKED:
        return _argsorted(key)
    bits = len(key).bit_length()
    rank = np.zeros(1 << 24, bool)
    for lo in range(0, len(key), _BLOCK):
        x = key[lo : lo + _BLOCK]
        rank[x >> 32] = True
        rank[x >> 8 & 0xFFFFFF] = True
    rank = np.cumsum(rank, dtype=np.int32) - np.int32(1)
    each = int(rank[-1]).bit_length()
    if 2 * each + 8 + bits > 63:
        return _argsorted(key)
    packed = np.empty(len(key), np.int64)
    for lo in range(0, len(key), _BLOCK):
        x = key[lo : lo + _BLOCK]
        packed[lo : lo + len(x)] = ((rank[x >> 32].astype(np.int64) << each | rank[x >> 8 & 0xFFFFFF]) << 8 | x & 255) << bits | np.arange(lo, lo + len(x))
    packed.sort()
    order, new = np.empty(len(key), np.int64 if bits > 31 else np.int32), np.ones(len(key), bool)
    for lo in range(0, len(key), _BLOCK):
        x = packed[lo : lo + _BLOCK + 1]
        order[lo : lo + _BLOCK] = x[:_BLOCK] & ((1 << bits) - 1)
        new[lo + 1 : lo + _BLOCK + 1] = x[1:] >> bits != x[:-1] >> bits
    return order, new


def _gram_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key >> (8 * (DEPTH + 1 - TOP))) % np.uint64(buckets)).astype(np.int64)


def _distinct(key: np.ndarray) -> np.ndarray:
    """By sorting, which is several times as fast on these keys as the hash table of np.unique."""
    key = np.sort(key)
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def _add_up(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(key, kind="stable")  # by merging what is in order
    key, count = key[order], count[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(count, begin) if len(key) else count


class Trees:
    """Context trees below TOP context bytes from distinct keys and counts, deepest first."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        seen = count > 0
        key, count = key[seen], count[seen]
        self.levels = {}
        node = ((key >> 8)[:, None] * 256 + _NODES[key & 255]).ravel()
        ones = (count[:, None] * _BITS[key & 255]).ravel()
        total, child = np.repeat(count, 8), None
        for d in range(DEPTH, TOP - 1, -1):
            ids, inverse = np.unique(node, return_inverse=True)
            ones = np.bincount(inverse, weights=ones, minlength=len(ids))
            total = np.bincount(inverse, weights=total, minlength=len(ids))
            own = log_kt(total - ones, ones)
            if child is None:
                weighted, stay = own, np.ones(len(ids))
            else:
                weighted = np.logaddexp(own, np.bincount(inverse, weights=child, minlength=len(ids))) - np.log(2)
                stay = np.exp(own - np.log(2) - weighted)
            self.levels[d] = (ids, total - ones, ones, stay)
            below = (ids, weighted)
            node, child = (ids >> 16) * 256 + (ids & 255), weighted  # of the context one byte shorter
        self.top = below

    def log10(self, key: np.ndarray, shallow: Shallow) -> np.ndarray:
        """log10 probability of the symbol of each key after its context."""
        symbol = key & 255
        node, bit = _NODES[symbol], _BITS[symbol]
        p, seen = np.full(node.shape, 0.5), np.zeros(node.shape, bool)
        for d in range(DEPTH, -1, -1):
            if d >= TOP:
                ids, zeros, ones, stay = self.levels[d]
                want = (key >> (8 * (DEPTH + 1 - d)))[:, None] * 256 + node
                where = np.minimum(np.searchsorted(ids, want), max(0, len(ids) - 1))
                here = ids[where] == want if len(ids) else np.zeros(node.shape, bool)
                if not len(ids):
                    continue
                a, b, w = zeros[where], ones[where], stay[where]
            else:
                context = (key >> (8 * DEPTH))[:, None] if d else np.zeros((len(key), 1), np.int64)
                a, b, w = (x[d][context, node] for x in (shallow.zeros, shallow.ones, shallow.stay))
                here = a + b > 0
            own = (np.where(bit, b, a) + 0.5) / (a + b + 1)
            p = np.where(here, np.where(seen, w * own + (1 - w) * p, own), p)
            seen |= here
        return np.log10(p).sum(axis=1)


class Shallow:
    """The nodes with fewer than TOP (2) context bytes, from (context, node, zeros, ones, children's log probability) rows."""

    def __init__(self, rows: list[tuple[int, int, float, float, float]]):
        zeros, ones, child = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for c, node, a, b, w in rows:
            zeros[c, node], ones[c, node], child[c, node] = a, b, w
        weighted, stay = self._mix(zeros, ones, child)
        root = [x.sum(axis=0, keepdims=True) for x in (zeros, ones, weighted)]
        self.zeros, self.ones, self.stay = [root[0], zeros], [root[1], ones], [self._mix(*root)[1], stay]

    @staticmethod
    def _mix(zeros, ones, child):
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, child) - np.log(2)
        return weighted, np.exp(own - np.log(2) - weighted)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in pieces that are the same whenever it is read."""
    got = [x for x in batches if x.num_rows]
    if got:
        table = pa.Table.from_batches(got).sort_by([("rid", "ascending"), ("train", "ascending")]).combine_chunks()
        yield from steps(table.to_batches(), most=_STEP)


def _words(batch: pa.RecordBatch):
    """Ids of a piece's words, where each text's begin, the distinct words (the end last), and the bucket of each."""
    raw, at = text_buffer(batch.column("text"))
    raw = LOWER[raw]
    start, end, first, mask = spans(raw, at)
    ids, words = encode_words(raw, start, end, mask)
    return ids, first, pa.concat_arrays([words.cast(pa.binary()), pa.array([_END], pa.binary())])


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, counts, part = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for seq, batch in enumerate(_pieces(batches)):
            part = batch.column("part")[0].as_py()
            train = batch.column("train").to_numpy(zero_copy_only=False)
            out: list[tuple[int, bytes]] = []
            key, first = grams(*text_buffer(batch.column("text")))
            doc_train = np.repeat(train, np.diff(np.append(first, len(key))))
            key <<= 1
            key |= ~doc_train
            key.sort()
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(begin, len(key)))
            key = key[begin]
            count[key & 1 == 1] = 0
            key >>= 1
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            have, counts = _add_up(np.append(have, key[begin]), np.append(counts, np.add.reduceat(count, begin)))
            ids, first, words = _words(batch)
            of_train = np.repeat(train, np.diff(first))
            count = np.bincount(ids[of_train], minlength=len(words))
            count[-1] = train.sum()
            raw, at = text_buffer(words)
            flat = raw.tobytes()
            for k, w in _by_bucket((hash_words(words) % np.uint64(buckets)).astype(np.int64)):
                out.append((buckets + k, zip_arrays(np.diff(at)[w].astype(np.int32), count[w].astype(np.int32), b"".join([flat[a:b] for a, b in zip(at[w].tolist(), at[w + 1].tolist(), strict=True)]))))
            yield _sent(out, part, seq)
        if part is not None:
            # the grams of all pieces in one, as if sent with the first
            yield _sent([(k, zip_arrays(np.diff(have[at], prepend=0), counts[at].astype(np.int32))) for k, at in _by_bucket(_gram_bucket(have, buckets))], part, 0)

    return run


def _sent(out: list[tuple[int, bytes]], part: int, seq: int) -> pa.RecordBatch:
    n = len(out)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array([b for _, b in out], pa.binary())], ["bucket", "part", "seq", "blob"])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by radix
    edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(bucket))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, int, bytes]]]:
    held = defaultdict(list)
    for b in batches:
        for k, part, seq, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "part", "seq", "blob")), strict=True):
            held[k].append((part, seq, blob))
    return held


def _total_grams(got: list[tuple[int, int, bytes]]):
    keys, counts = [], []
    for _, _, blob in got:
        k, c = unzip_arrays(blob, np.int64, np.int32)
        keys.append(np.cumsum(k))
        counts.append(c)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")  # by merging what is in order
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    begin, inverse = np.flatnonzero(new), np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return key[begin], np.add.reduceat(np.concatenate(counts).astype(float)[order], begin), inverse, [len(x) for x in keys]


def _total_words(got: list[tuple[int, int, bytes]]):
    parts = [unzip_arrays(blob, np.int32, np.int32, bytes) for _, _, blob in got]
    sizes = [x[0] for x in parts]
    coded = binary_array(np.frombuffer(b"".join(x[2] for x in parts), np.uint8), np.concatenate(sizes)).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(ids, weights=np.concatenate([x[1] for x in parts]), minlength=len(coded.dictionary)).astype(np.int64)
    return total, ids, [len(x) for x in sizes]


def _summarise(buckets: int):
    """Rows (context byte or -1, node, zeros or N, ones or V, log probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        for k in list(held):
            got = held.pop(k)
            if k < buckets:
                key, total, _, _ = _total_grams(got)
                trees = Trees(key, total)
                ids, zeros, ones, _ = trees.levels[TOP]
                columns = [ids >> 16, ids & 255, zeros, ones, trees.top[1]]
            else:
                total, _, _ = _total_words(got)
                columns = [np.array([-1]), np.array([0]), np.array([total.sum()]), np.array([(total > 0).sum()]), np.zeros(1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([np.asarray(c, float if i > 1 else np.int32) for i, c in enumerate(columns)], (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["context", "node", "zeros", "ones", "child"])

    return run


def _answer(buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        for k in list(held):
            got = held.pop(k)
            if k < buckets:
                key, total, inverse, sizes = _total_grams(got)
                trees, value = Trees(key, total), np.empty(len(key), np.float32)
                for lo in range(0, len(key), _BLOCK // 8):
                    value[lo : lo + _BLOCK // 8] = trees.log10(key[lo : lo + _BLOCK // 8], shared.value)
            else:
                value, inverse, sizes = _total_words(got)
            at = np.append(0, np.cumsum(sizes))
            blobs = [zip_arrays(value[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(got), pa.int32()), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "part", "seq", "answer"])

    return run


def _score(buckets: int, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[tuple[int, int], bytes] = {}
        texts = []
        for b in batches:
            has = np.asarray(b.column("answer").is_valid())
            a = b.filter(pa.array(has))
            for k, seq, blob in zip(*(a.column(c).to_pylist() for c in ("bucket", "seq", "answer")), strict=True):
                answers[seq, k] = blob
            texts.append(b.filter(pa.array(~has)))
        pieces, sorts, have = list(_pieces(texts)), [], np.zeros(0, np.int64)
        for batch in pieces:
            key, first = grams(*text_buffer(batch.column("text")))
            order, new = _ordered(key)
            sorts.append((order, new, key[order[new]], first))
            have = _distinct(np.append(have, sorts[-1][2]))
        value = np.empty(len(have), np.float32)
        for k, at in _by_bucket(_gram_bucket(have, buckets)):
            value[at] = unzip_arrays(answers.pop((0, k)), np.float32)[0]
        for seq, batch in enumerate(pieces):
            order, new, key, first = sorts[seq]
            sorts[seq] = None
            each = np.empty(len(order))
            each[order] = np.repeat(value[np.searchsorted(have, key)], np.diff(np.append(np.flatnonzero(new), len(new))))
            score = np.add.reduceat(each, first)
            size = np.diff(np.append(first, len(order)))
            ids, first, words = _words(batch)
            count = np.empty(len(words), np.int64)
            for k, at in _by_bucket((hash_words(words) % np.uint64(buckets)).astype(np.int64)):
                count[at] = unzip_arrays(answers.pop((seq, buckets + k)), np.int64)[0]
            part = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            base = np.bincount(doc, weights=part[ids], minlength=batch.num_rows) + part[-1]
            known = np.bincount(doc, weights=count[ids] > 0, minlength=batch.num_rows) + (count[-1] > 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "held_out": pa.array(~batch.column("train").to_numpy(zero_copy_only=False)),
                "n_tokens": pa.array(np.diff(first) + 1, pa.int64()),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(batch.num_rows, n), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / np.log10(2) / size),
            })

    return run


def score_texts(docs: DataFrame, train: F.Column) -> DataFrame:
    """Scores of all rows of docs by trees and words learnt from those where `train` holds."""
    spark = docs.sparkSession
    parts, buckets = parts_for(docs.select("text"), TEXT_BYTES), parts_for(docs.select("text"), BUCKET_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train")).withColumn("rid", row_key())
    rows = rows.withColumn("part", F.pmod("rid", F.lit(parts)).cast("int"))
    texts = rows.repartitionById(parts, F.col("part"))
    sent = cut(texts.transform(in_arrow, _send(buckets), "bucket int, part int, seq int, blob binary"), "grams")
    dealt = sent.repartitionById(2 * buckets, F.col("bucket"))
    summary = dealt.transform(in_arrow, _summarise(buckets), "context int, node int, zeros double, ones double, child double").groupBy("context", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("child")).collect()
    n, v = next(((int(r[2]), int(r[3])) for r in summary if r[0] == -1), (0, 0))
    shared = spark.sparkContext.broadcast(Shallow([tuple(r) for r in summary if r[0] >= 0]))
    answers = dealt.transform(in_arrow, _answer(buckets, shared), "bucket int, part int, seq int, answer binary")
    empty = {c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("text", "string"), ("train", "boolean"), ("rid", "long"))}
    both = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("bucket", "int"), ("seq", "int"), ("answer", "binary"))}).unionByName(answers.withColumns(empty))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return both.repartitionById(parts, F.col("part")).transform(in_arrow, _score(buckets, n, v), schema)


def op6_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return score_texts(load(spark, sf_dir, "documents"), ~held)
