"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the pre-token pattern is merged on its own.  A pre-token's bytes form a linked
list; every mergeable neighbouring pair waits in the bucket of its rank, and three levels of
64-bit words say which buckets hold something.  Find-first-set down the levels gives the lowest
rank, its bucket the leftmost position; entries whose pair has changed meanwhile are skipped.
The cost is near linear in the pre-token's length, however long it is.

Pre-tokens of up to SHORT bytes that a task has not seen yet are merged many at once: they share
one queue, whose buckets hold positions over all of them, and a bucket gives the leftmost
position of each pre-token in one vectorised step.  Pre-tokens don't interact, so each sees its
own merges in its own order.  Longer ones have a queue each.

Merged pre-tokens are remembered in a bounded table (REMEMBERED entries), which changes speed
only.  Defined cases: null and empty texts have no ids; ids of equal texts are equal; every byte
has a token, so decoding gives back exactly the text's UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, load, steps

REMEMBERED = 120_000
#: Longer pre-tokens are merged alone and not remembered.
SHORT = 64


class RankBits:
    """A set of ranks as three levels of 64-bit words; first() finds the least."""

    def __init__(self):
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def add(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The least rank, or -1."""
        top = self.top
        if not top:
            return -1
        b = (top & -top).bit_length() - 1
        mid = self.mid[b]
        a = b << 6 | (mid & -mid).bit_length() - 1
        low = self.low[a]
        return a << 6 | (low & -low).bit_length() - 1

    def remove(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)


class RankQueue(RankBits):
    """Positions by rank; pop() gives the lowest rank's leftmost position."""

    def __init__(self):
        super().__init__()
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.add(rank)

    def pop(self) -> tuple[int, int] | None:
        rank = self.first()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self.remove(rank)
        return rank, position


class PairRanks:
    """Rank of two neighbouring tokens, for arrays of them: every split of every token, in an open-addressed table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.int64)
        self.shift = np.uint64(64 - max(8, int(2 * len(keys) + 1).bit_length() + 1))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size + 512, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(size + 512, -1, np.int64)
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = self.values[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            own = left[free][first]
            self.keys[at], self.values[at] = key[own], value[own]
            placed = np.zeros(len(key), bool)
            placed[own] = True
            left = left[~placed[left]]
            slot[left] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the two don't make a token."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        left = np.flatnonzero((found != key) & (self.values[slot] >= 0))
        while len(left):
            slot[left] += 1
            s = slot[left]
            hit = self.keys[s] == key[left]
            out[left[hit]] = self.values[s[hit]]
            left = left[~hit & (self.values[s] >= 0)]
        return out


class Codec:
    """ranks: token bytes to id, as in a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.known = _Known(self)
        self._pairs: PairRanks | None = None

    @property
    def pairs(self) -> PairRanks:
        if self._pairs is None:
            self._pairs = PairRanks(self.ranks)
            self._bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
            self._two = self._pairs(np.repeat(np.maximum(self._bytes, 0), 256), np.tile(np.maximum(self._bytes, 0), 256))
        return self._pairs

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens, merged through one queue."""
        pairs = self.pairs
        size = np.array([len(x) for x in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n = len(raw)
        end = np.cumsum(size)
        piece = np.repeat(np.arange(len(pieces)), size)
        token = self._bytes[raw]
        after, prior = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1] = -1
        prior[end - size] = -1
        waiting = np.full(n, -1, np.int64)  # the rank of the pair that starts here
        waiting[:-1] = self._two[raw[:-1] * 256 + raw[1:]]
        waiting[end - 1] = -1
        alive = np.ones(n, bool)
        bits = RankBits()
        buckets: dict[int, list[np.ndarray]] = {}

        def push(positions: np.ndarray) -> None:
            rank = waiting[positions]
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.lexsort((positions, rank))
            positions, rank = positions[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            at = [0, *edges.tolist(), len(rank)]
            for r, lo, hi in zip(rank[at[:-1]].tolist(), at[:-1], at[1:], strict=True):
                if r in buckets:
                    buckets[r].append(positions[lo:hi])
                else:
                    buckets[r] = [positions[lo:hi]]
                    bits.add(r)

        push(np.flatnonzero(waiting >= 0))
        while (r := bits.first()) >= 0:
            held = buckets.pop(r)
            here = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            here = here[waiting[here] == r]  # the others are stale
            own = piece[here]
            first = np.ones(len(here), bool)
            first[1:] = own[1:] != own[:-1]
            if first.all():
                bits.remove(r)
            else:
                buckets[r] = [here[~first]]
                here = here[first]
            if not len(here):
                continue
            gone = after[here]
            beyond = after[gone]
            token[here] = r
            alive[gone] = False
            waiting[gone] = waiting[here] = -1
            after[here] = beyond
            more = beyond >= 0
            a, b = here[more], beyond[more]
            prior[b] = a
            before = prior[here]
            less = before >= 0
            c, d = before[less], here[less]
            left = np.concatenate([a, c])
            waiting[left] = pairs(token[left], token[np.concatenate([b, d])])
            push(left)
        ids = token[alive].astype("<u4").tobytes()
        at = 4 * np.append(0, np.cumsum(np.bincount(piece[alive], minlength=len(pieces))))
        return [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def learn(self, found: list[list[str]]) -> None:
        """Merges what is new and short in these pre-tokens at once."""
        known, ranks = self.known, self.ranks
        new = set().union(*found) - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*found)
        texts, pieces = [], []
        for x in new:
            raw = x.encode()
            if (whole := ranks.get(raw)) is not None:
                known[x] = struct.pack("<I", whole)
            elif len(raw) <= SHORT:
                texts.append(x)
                pieces.append(raw)
        if pieces:
            known.update(zip(texts, self.merge_all(pieces), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(x) for x in texts]
        self.learn(found)
        get = self.known.__getitem__
        for x in found:
            yield b"".join(map(get, x))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        after, prior = list(range(1, n + 2)), list(range(-1, n))
        waiting = [-1] * (n + 1)  # the rank of the pair that starts here
        queue, longest = RankQueue(), self.longest
        get = ranks.get
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                waiting[i] = r
                queue.push(r, i)
        while (found := queue.pop()) is not None:
            r, i = found
            if waiting[i] != r:
                continue
            j = after[i]
            k = after[j]
            waiting[j] = waiting[i] = -1
            after[i] = k
            if k < n:
                prior[k] = i
                end = after[k]
                if end - i <= longest and (r := get(piece[i:end])) is not None:
                    waiting[i] = r
                    queue.push(r, i)
            h = prior[i]
            if h >= 0:
                waiting[h] = -1
                if k - h <= longest and (r := get(piece[h:k])) is not None:
                    waiting[h] = r
                    queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.codec.merge(raw)
        out = struct.pack(f"<{len(ids)}I", *ids)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each process, file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _digest(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in steps(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in c.encode_all([x or "" for x in batch.column("text").to_pylist()]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in steps(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode_all([x or "" for x in batch.column("text").to_pylist()])]
            at = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return run


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            text = [None if x is None else b"".join(map(c.token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>)."""
    return docs.select("doc_id", "text").transform(in_arrow, _ids(*(vocabulary or default_vocabulary())), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").transform(in_arrow, _texts(*(vocabulary or default_vocabulary())), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(in_arrow, _digest(*(vocabulary or default_vocabulary())), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe_rank_queue(spark, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
