"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document.  Consecutive windows whose smallest
hashed run of `minimiser` words is the same occurrence form a super-k-mer; it travels as one
packed string to the bucket that the minimiser names.  Equal windows have equal minimisers, so
each bucket can sort its windows alone and see every occurrence of each.  The sort is on a
64-bit hash, and runs of equal hashes are then compared word by word, so the result is exact.

Super-k-mers that a piece of a partition has several times are settled there: where a smaller
doc_id of the piece has the same words, all their windows repeat, and only where they stand
travels on.  A passage that a third of all documents have so reaches its bucket once a piece.

Words that stay keep the white space between them; around a cut, what stood on the side with a line break, or else on the right.

A word goes if some window over it also starts in a document with a smaller doc_id.  Windows
are judged on the input.  Defined cases: null and empty texts have no words; a text shorter
than a window keeps all; rows with equal doc_id never remove from each other; a null doc_id
counts as larger than every other; repeated rows get the same answer each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import binary_array, encode_words, hash_words, in_arrow, load, mix, parts_for, row_key, single_spaced, spans, steps, text_buffer, unzip_arrays, zip_arrays

WINDOW, MINIMISER = 13, 3
_LAST = np.iinfo(np.int64).max
#: Stored bytes of the input behind each bucket of windows and behind each partition of texts.
BUCKET_BYTES, TEXT_BYTES = 1_200_000, 2_000_000
#: Bytes of text whose super-k-mers are packed at once.
_PACKED = 2 << 20


def super_kmers(words: np.ndarray, first: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, hash of the minimiser) of every super-k-mer; words: a hash each; first: where documents begin, and the end."""
    n = len(words)
    doc_len = np.diff(first)
    per_doc = np.maximum(doc_len - window + 1, 0)
    if n < window or not per_doc.any():
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint64)
    mers = words.copy()
    for j in range(1, m):
        mers[: n - j] = mers[: n - j] * np.uint64(0xD6E8FEB86659FD93) + words[j:]
    mers = mix(mers[: n - m + 1])
    width = window - m + 1
    low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[: len(mers)] = mers
    where = np.arange(n, dtype=np.int32)
    span = 1
    while span < width:  # the leftmost smallest of 2 * span, or of the width
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        right = b < a
        low[:-step] = np.where(right, b, a)
        where[:-step] = np.where(right, where[step:], where[:-step])
        span += step
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per_doc)[:-1]]), per_doc) + np.arange(per_doc.sum())
    at = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(starts)) - 1
    return starts[begin], starts[finish] + window, low[starts[begin]]


def _send(window: int, m: int, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=_PACKED):
            raw, at = text_buffer(batch.column("text"))
            start, end, first, mask = spans(raw, at)
            if len(start) < window:
                continue
            ids, words = encode_words(raw, start, end, mask)
            begin, stop, least = super_kmers(hash_words(words)[ids], first, window, m)
            if not len(begin):
                continue
            text, at = single_spaced(raw, start, end, mask)
            bucket = (least % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            begin, stop, bucket = begin[order], stop[order], bucket[order]
            doc = np.searchsorted(first, begin, side="right") - 1
            doc_id, rid = _ids(batch)
            a, b = at[begin], at[stop]
            pieces = [text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            same = binary_array(np.frombuffer(b"".join(pieces), np.uint8), b - a).dictionary_encode()
            code = same.indices.to_numpy(zero_copy_only=False)
            smallest = np.full(len(same.dictionary), _LAST)
            np.minimum.at(smallest, code, doc_id[doc])
            known = doc_id[doc] > smallest[code]
            out = []
            if known.any():
                d = doc[known]
                for k, blob in _spans_by_part(rid[d], begin[known] - first[d], stop[known] - first[d], parts):
                    out.append((k % buckets, k, blob))
            sent = np.flatnonzero(~known)
            edges = np.append(np.flatnonzero(np.diff(bucket[sent], prepend=-1)), len(sent)).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = sent[lo:hi]
                d = doc[own]
                packed = b"".join([pieces[i] for i in own.tolist()])
                out.append((int(bucket[own[0]]), None, zip_arrays(np.diff(doc_id[d], prepend=0), np.diff(rid[d], prepend=0), (begin[own] - first[d]).astype(np.int32), (stop - begin)[own].astype(np.int32), packed, level=3)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "part", "blob"])

    return run


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False), batch.column("rid").to_numpy(zero_copy_only=False)


def _spans_by_part(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed spans) of ranges of words that go; ranges of a row that touch or overlap become one (each must reach further than the one before it)."""
    part = np.mod(rid, parts).astype(np.int32)
    order = np.lexsort((lo, rid, part))
    rid, lo, hi, part = rid[order], lo[order], hi[order], part[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(rid)) - 1
    rid, part, lo, hi = rid[begin], part[begin], lo[begin], hi[finish]
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[x]), zip_arrays(rid[x:y], lo[x:y].astype(np.int32), hi[x:y].astype(np.int32), level=3)


def repeated_windows(ids: np.ndarray, starts: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows (by first word; owner: its document) also start in a document with a smaller id.  Exact."""
    flags = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return flags
    code = mix(ids.astype(np.uint64) + np.uint64(0x51ED270B))
    h = np.zeros(len(starts), np.uint64)
    for j in range(window):
        h *= np.uint64(0x9E3779B97F4A7C55)
        h += code[starts + j]
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return flags
    touched = np.zeros(len(h), bool)
    touched[1:] |= same
    touched[:-1] |= same
    order, h = order[touched], h[touched]
    at = starts[order]
    same = h[1:] == h[:-1]
    equal = np.ones(len(same), bool)
    for j in range(window):
        equal &= ids[at[1:] + j] == ids[at[:-1] + j]
    if (same & ~equal).any():  # two windows share a hash: group by the words themselves
        rows = ids[at[:, None] + np.arange(window)]
        group = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
        same = group[1:] == group[:-1]
    begin = np.append(0, np.flatnonzero(~same) + 1)
    docs = owner[order]
    least = np.minimum.reduceat(docs, begin)
    flags[order] = docs > np.repeat(least, np.diff(np.append(begin, len(docs))))
    return flags


def _word_ids(raw: np.ndarray) -> np.ndarray:
    """An exact id for each of the words, every one of which a blank follows."""
    blank = raw == 0x20
    lengths = np.diff(np.flatnonzero(blank), prepend=-1) - 1
    return binary_array(raw[~blank], lengths).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _judge(window: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            known = np.asarray(batch.column("part").is_valid())
            if known.any():
                settled = batch.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([settled.column("part"), settled.column("blob")], ["part", "spans"])
            for k, part, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "blob")), strict=True):
                if part is None:
                    held[k].append(blob)
        for k in list(held):
            got = [unzip_arrays(x, np.int64, np.int64, np.int32, np.int32, bytes) for x in held.pop(k)]
            doc, rid = (np.concatenate([np.cumsum(x[i]) for x in got]) for i in (0, 1))
            pos, size = (np.concatenate([x[i] for x in got]).astype(np.int64) for i in (2, 3))
            raw = np.frombuffer(b"".join(x[4] for x in got), np.uint8)
            del got
            ids = _word_ids(raw)
            del raw
            first = np.cumsum(size) - size
            each = size - window + 1
            kmer = np.repeat(np.arange(len(size)), each)
            inside = np.arange(len(kmer)) - np.repeat(np.cumsum(each) - each, each)
            flags = repeated_windows(ids, first[kmer] + inside, doc[kmer], window)
            hit = np.flatnonzero(flags)
            if len(hit):
                at = pos[kmer[hit]] + inside[hit]
                found = list(zip(*_spans_by_part(rid[kmer[hit]], at, at + window, parts), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.binary())], ["part", "spans"])

    return run


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, found = [], [[], [], []]
        for batch in batches:
            has = np.asarray(batch.column("spans").is_valid())
            for blob in batch.column("spans").filter(pa.array(has)).to_pylist():
                for have, x in zip(found, unzip_arrays(blob, np.int64, np.int32, np.int32), strict=True):
                    have.append(x.astype(np.int64))
            rows = batch.filter(pa.array(~has))
            if rows.num_rows:
                texts.append(rows)
        key, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        order = np.argsort(key, kind="stable")
        key, lo, hi = key[order], lo[order], hi[order]
        for batch in steps(texts):
            yield _cut_words(batch, key, lo, hi, with_text)

    return run


def _cut_words(batch: pa.RecordBatch, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, with_text: bool) -> pa.RecordBatch:
    raw, text_at = text_buffer(batch.column("text"))
    start, end, first, mask = spans(raw, text_at)
    text, at = single_spaced(raw, start, end, mask)
    rid = batch.column("rid").to_numpy(zero_copy_only=False)
    n = batch.num_rows
    a, b = np.searchsorted(key, rid), np.searchsorted(key, rid, side="right")
    count = b - a
    row = np.repeat(np.arange(n), count)
    span = np.repeat(a - np.cumsum(count) + count, count) + np.arange(len(row))
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, first[row] + lo[span], 1)
    np.add.at(change, first[row] + hi[span], -1)
    gone = np.cumsum(change[:-1]) > 0
    total = np.append(0, np.cumsum(gone))
    removed = total[first[1:]] - total[first[:-1]]
    sha = []
    byte = at[first].tolist()
    flat = None
    for i, r in enumerate(removed.tolist()):
        if r == 0:
            out = text[byte[i] : byte[i + 1]][:-1]
        elif r == first[i + 1] - first[i]:
            out = b""
        else:
            if flat is None:
                flat = np.frombuffer(text, np.uint8)
            w = slice(first[i], first[i + 1])
            out = flat[byte[i] : byte[i + 1]][np.repeat(~gone[w], np.diff(at[first[i] : first[i + 1] + 1]))].tobytes()[:-1]
        sha.append(hashlib.sha256(out).hexdigest())
    columns = {"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
    if with_text:
        columns |= {"kept_text": _kept_texts(batch.column("text"), raw, text_at, start, end, first, gone, removed)}
    if "row" in batch.schema.names:
        columns["row"] = batch.column("row")
    return pa.RecordBatch.from_pydict(columns)


def _kept_texts(column: pa.Array, raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, gone: np.ndarray, removed: np.ndarray) -> pa.Array:
    """Texts without the words that go; one that loses nothing stays as it is."""
    out = column.to_pylist()
    for i in np.flatnonzero(removed).tolist():
        lo, hi = int(first[i]), int(first[i + 1])
        step = np.diff(np.concatenate([[0], ~gone[lo:hi], [0]]).astype(np.int8))
        begin, stop = (np.flatnonzero(step == 1) + lo).tolist(), (np.flatnonzero(step == -1) - 1 + lo).tolist()
        parts = []
        for n, (a, b) in enumerate(zip(begin, stop, strict=True)):  # runs of words that stay
            if n:
                left, right = (raw[x:y].tobytes() for x, y in ((end[stop[n - 1]], start[stop[n - 1] + 1]), (end[a - 1], start[a])))
                parts.append(left if b"\n" in left else right)
            elif a == lo:
                parts.append(raw[at[i] : start[a]].tobytes())
            parts.append(raw[start[a] : end[b]].tobytes())
        if stop and stop[-1] == hi - 1:
            parts.append(raw[end[hi - 1] : at[i + 1]].tobytes())
        out[i] = b"".join(parts).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, with_text: bool = True) -> DataFrame:
    """(rid, doc_id, n_words, n_removed, kept_sha256[, kept_text][, row]) of every row of docs; rid tells rows apart.

    rid is the doc_id where each row has one of its own, which packs well, and else common.row_key().  A struct column
    `row` of docs is carried along.
    """
    carried = [c for c in docs.columns if c == "row"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    shared = own.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    rows = own.withColumn("rid", row_key() if shared else F.col("doc_id"))
    buckets, parts = parts_for(docs.select("text"), BUCKET_BYTES), parts_for(docs.select("text"), TEXT_BYTES)
    packed = rows.select("doc_id", "text", "rid").transform(in_arrow, _send(window, minimiser, buckets, parts), "bucket int, part int, blob binary").repartitionById(buckets, F.col("bucket"))
    found = packed.transform(in_arrow, _judge(window, parts), "part int, spans binary")
    texts = rows.select(F.pmod("rid", F.lit(parts)).cast("int").alias("part"), "doc_id", "rid", "text", *carried, F.lit(None).cast("binary").alias("spans"))
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("doc_id", "rid", "text", *carried)]
    both = texts.unionByName(found.select("part", *none, "spans")).repartitionById(parts, F.col("part"))
    schema = StructType().add("rid", LongType()).add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType())
    if with_text:
        schema.add("kept_text", StringType())
    for c in carried:
        schema.add(rows.schema[c])
    return both.transform(in_arrow, _apply(with_text), schema)


def op5_super_kmer_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), with_text=False).drop("rid")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
g AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) i FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') k FROM g),
m AS (SELECT k, min(doc_id) f FROM h GROUP BY k),
hit AS (SELECT DISTINCT h.doc_id, unnest(generate_series(h.i, h.i + 12)) p FROM h JOIN m USING (k) WHERE m.f < h.doc_id),
x AS (SELECT doc_id, list(p) ps FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE (list_filter(list_transform(ws, lambda v, i: CASE WHEN list_contains(ps, i) THEN NULL ELSE v END), lambda v: v IS NOT NULL)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""
