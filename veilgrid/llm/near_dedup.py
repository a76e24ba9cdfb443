"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text is the multiset of its five-word shingles, A-Z lower-cased.  Every unit of a shingle's
weight is a region at which darts are thrown: hashed arrivals along a rank axis, each on a hashed
coordinate.  The earliest dart on each of `BANDS * ROWS` coordinates makes the signature, so two
texts agree on a coordinate with a probability of their weighted Jaccard similarity.  A text's
first darts are found at once, unit by unit; only units that land a dart below the text's rank
limit throw again, so the work is the text's length plus the signature's.

Equal texts are joined first, and only one of each goes on.  Texts that agree on a band are
linked to the band's least, and the components of these links are verified exactly: within a
component, a representative is compared with every member, and members within the similarity join
it.  A link that is not found so stands between members of two groups that are no representatives
themselves, and by the triangle inequality of Jaccard distance each is within twice the distance of the other's
representative; just such members of one of the two groups, the one that has fewer, become representatives too.
Every link between candidates is thus found without comparing all pairs.  Members whose shingles
most others share come first, as they have the largest groups.
Components of up to ALONE_BYTES of shingles and ALONE_ROWS texts are verified in one task, larger
ones by rounds over all tasks.  Where many members are linked to nothing each would have to represent itself, so the
rounds end when one settles few; the members left over are compared with all others then, block by
block, which finds every link that the rounds have not.

A text is known in the graph by a number of its own, never by a doc_id.  Rows of one doc_id with
several texts join the classes of these.

Defined cases: a text of one to four words is one shingle; texts without a word are alike only if
equal; null texts are alone; the class of a document is the least doc_id of its class; rows with
equal doc_id share a class; a row with a null doc_id has the class of its text, which is null where
no member of the class has a doc_id (a null text with a null doc_id is alone with its like).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary_array, cut, hash_words, in_arrow, load, mix, parts_for, spans, steps, text_buffer
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: A component of up to so much is verified in one task, by a representative for each member that is linked to nothing.
ALONE_BYTES, ALONE_ROWS = 8 << 20, 4096
#: Representatives of one component compared in one round over all tasks.
ROUND = 16
#: Another round follows as long as one leaves no more than this share of the members that waited.
SETTLES = 0.75
#: What a block of a large component weighs and has of rows, about; blocks are compared by pairs.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 4096
#: Rows and columns of the matrices that count common units, pairs listed at once.
_TILE, _COLUMNS, _LISTED = 1024, 4096, 1 << 21
_STEP = 2 << 20


def shingles(raw: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each unit of weight, equal in two texts if both have that many of the shingle; where each text's begin."""
    raw = LOWER[raw]
    start, end, first, mask = spans(raw, at)
    words = np.diff(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    coded = binary_array(raw[mask], end - start).dictionary_encode()
    h = hash_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    width = np.minimum(words, n)
    each = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), each)
    begin = np.repeat(first[:-1] - np.cumsum(each) + each, each) + np.arange(len(doc))
    key = np.zeros(len(doc), np.uint64)
    padded = np.append(h, np.zeros(n, np.uint64))
    for j in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C55) + np.where(j < width[doc], padded[begin + j], np.uint64(0))
    key = mix(key + width[doc].astype(np.uint64))
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    place = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(place, np.diff(np.append(place, len(key))))
    key = mix(key + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return key, np.append(0, np.cumsum(each))


def dart_signatures(units: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k hashes for each text that has units (rows of zeros for the others)."""
    size = np.diff(first)
    out = np.zeros((len(size), k), np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    want = k * np.log(k) + 2 * k
    open_docs = np.flatnonzero(size)
    scale = 1.0
    while len(open_docs):  # a text with an empty coordinate throws again with twice the limit
        limit = np.zeros(len(size))
        limit[open_docs] = scale * want / size[open_docs]
        live = np.flatnonzero(limit[doc] > 0)
        state, d = units[live], doc[live]
        rank = np.zeros(len(live))
        docs, coordinates, ranks, darts = [], [], [], []
        throw = 0
        while len(state):
            throw += 1
            h = mix(state + np.uint64((throw * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank < limit[d]
            state, d, rank, h = state[inside], d[inside], rank[inside], h[inside]
            if len(h):
                dart = mix(h ^ np.uint64(0xA0761D6478BD642F))
                docs.append(d)
                coordinates.append((dart % np.uint64(k)).astype(np.int64))
                ranks.append(rank)
                darts.append(dart)
        cell = np.concatenate(docs) * k + np.concatenate(coordinates)
        ranks, darts = np.concatenate(ranks), np.concatenate(darts)
        best = np.full(len(size) * k, np.inf)
        np.minimum.at(best, cell, ranks)
        earliest = ranks == best[cell]
        flat = out.reshape(-1)
        flat[cell[earliest]] = darts[earliest]
        filled = np.isfinite(best.reshape(-1, k)[open_docs]).all(axis=1)
        open_docs = open_docs[~filled]
        scale *= 2
    return out


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=_STEP):
            units, first = shingles(*text_buffer(batch.column("text")))
            has = np.diff(first) > 0
            signature = dart_signatures(units, first, bands * rows)[has].reshape(-1, bands, rows)
            h = np.zeros(signature.shape[:2], np.uint64)
            for j in range(rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C55) + signature[:, :, j])
            h = mix(h + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * bands), pa.array(h.ravel()))
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), batch.column("k").filter(keep), lists, pa.array(np.diff(first)[has])], ["doc_id", "k", "bands", "units"])

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=_STEP):
        units, first = shingles(*text_buffer(batch.column("text")))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        units = units[np.lexsort((units, doc))]
        blobs = [units[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_pydict(columns | {"units": pa.array(blobs, pa.binary())})


def distances(rep: np.ndarray, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Jaccard distance of a sorted set to many."""
    size = np.diff(first)
    inside = rep[np.minimum(np.searchsorted(rep, units), len(rep) - 1)] == units
    total = np.append(0, np.cumsum(inside))
    common = total[first[1:]] - total[first[:-1]]
    return 1 - common / (size + len(rep) - common)


def link(ids: np.ndarray, sets: list[bytes], similarity: float) -> np.ndarray:
    """The least linked id of each member of one component; exact."""
    arrays = [np.frombuffer(x, np.uint64) for x in sets]
    size = np.array([len(x) for x in arrays])
    first = np.append(0, np.cumsum(size))
    _, of, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    central = np.add.reduceat(counts[of].astype(float), first[:-1]) / size
    turn = np.argsort(-central, kind="stable")  # members in the order that they may represent in
    at_turn = np.argsort(turn)
    far = 1 - similarity + 1e-12
    label = np.arange(len(ids))
    waiting, done, of_rep = np.ones(len(ids), bool), np.zeros(len(ids), bool), np.zeros(len(counts), bool)
    reps: list[tuple[int, np.ndarray, np.ndarray]] = []  # who has near members that are none, the members within twice the distance, how far they are
    while waiting.any() and (label != label[0]).any():
        r = int(turn[at_turn[waiting].min()])
        waiting[r] = False
        done[r] = True
        own = of[first[r] : first[r + 1]]
        of_rep[own] = True
        common = np.add.reduceat(of_rep[of].astype(np.int64), first[:-1])
        of_rep[own] = False
        d = 1 - common / (size + size[r] - common)
        near = np.flatnonzero(d <= far)
        waiting[near] = False
        joined = np.isin(label, label[near])
        label[joined] = label[joined].min()
        if done[near].all():
            continue  # all links of it and of its near members are known
        around = np.flatnonzero(d <= 2 * far)
        # members of another group and of this one may be linked, if neither is a representative
        for q, at, e in reps:
            if label[q] != label[r]:
                x = d[at]
                here, there = (at[(a <= far) & (b <= 2 * far) & ~done[at]] for a, b in ((x, e), (e, x)))
                if len(here) and len(there):
                    waiting[here if len(here) <= len(there) else there] = True
        reps.append((r, around, d[around]))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return least[label]


def _alone(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, ids, sets = None, [], []

        def ended():
            got = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got), pa.array(link(got, sets, similarity))], ["id", "class_id"])

        for batch in batches:
            for c, i, u in zip(*(batch.column(x).to_pylist() for x in ("component", "id", "units")), strict=True):
                if c != component and ids:
                    yield ended()
                    ids, sets = [], []
                component = c
                ids.append(i)
                sets.append(u)
        if ids:
            yield ended()

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[bool], np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbouring rows of one key: the key, each row's `left`, its id, all rows' units and where each row's begin."""
    now, left, ids, sets = None, [], [], []

    def ended():
        return now, left, np.array(ids, np.int64), np.frombuffer(b"".join(sets), np.uint64), np.append(0, np.cumsum([len(x) // 8 for x in sets]))

    for batch in batches:
        rows = zip(*(batch.column(x).to_pylist() for x in (*keys, "left", "id", "units")), strict=True)
        for *key, is_left, i, u in rows:
            if key != now and ids:
                yield ended()
                left, ids, sets = [], [], []
            now = key
            left.append(is_left)
            ids.append(i)
            sets.append(u)
    if ids:
        yield ended()


def _round(similarity: float):
    """Distances of the members of each block to its component's representatives of this round, which come first."""
    far = 1 - similarity + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, ids, units, first in _groups(batches, ("component", "block")):
            n = sum(left)
            for r in range(n):
                d = distances(units[first[r] : first[r + 1]], units[first[n] :], first[n:] - first[n])
                keep = np.flatnonzero(d <= 2 * far)
                yield pa.RecordBatch.from_arrays([pa.array(ids[n:][keep]), pa.array(np.full(len(keep), ids[r])), pa.array(d[keep])], ["id", "rep", "d"])

    return run


def shared_units(of: np.ndarray, first: np.ndarray, n: int, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
    """How many of n numbered units each set from a[0] to a[1] has in common with each from b[0] to b[1].

    Units of many sets are counted by products of matrices, those of few by listing the pairs that have them.
    """
    sides = [(of[first[x] : first[y]], np.repeat(np.arange(y - x), np.diff(first[x : y + 1]))) for x, y in (a, b)]
    rows = [y - x for x, y in (a, b)]
    often = [np.bincount(u, minlength=n) for u, _ in sides]
    pairs = often[0] * often[1]
    many = pairs * 256 > rows[0] * rows[1]
    out = np.zeros(rows, np.float32 if len(of) < 1 << 24 else np.float64)
    place = np.cumsum(many) - 1
    dense = [(place[u[many[u]]], r[many[u]]) for u, r in sides]
    for at in range(0, int(many.sum()), _COLUMNS):
        width = min(_COLUMNS, int(many.sum()) - at)
        parts = []
        for (u, r), size in zip(dense, rows, strict=True):
            here = (u >= at) & (u < at + width)
            parts.append(np.zeros((size, width), out.dtype))
            parts[-1][r[here], u[here] - at] = 1
        out += parts[0] @ parts[1].T
    few = (pairs > 0) & ~many
    u, r = (x[few[sides[0][0]]] for x in sides[0])
    v, q = (x[few[sides[1][0]]] for x in sides[1])
    order = np.argsort(v, kind="stable")
    q, begin = q[order], np.searchsorted(v[order], u)  # each unit of a stands with the run of b's rows that have it
    run = often[1][u]
    total = np.append(0, np.cumsum(run))
    flat = out.reshape(-1)
    at = 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _LISTED, side="right")) - 1)
        each = run[at:to]
        nth = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], each)
        flat += np.bincount(np.repeat(r[at:to], each) * rows[1] + q[np.repeat(begin[at:to], each) + nth], minlength=len(flat)).astype(out.dtype)
        at = to
    return out


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after joining those of i and j, pair by pair; a label is the least place that has it."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        open_pairs = low != high
        if not open_pairs.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, high[open_pairs], low[open_pairs])
        while (up != up[up]).any():
            up = up[up]
        label = up[label]


def _pairs(similarity: float):
    """Of two blocks, links that join all that are linked from one to the other (within it, for a block and itself)."""
    far = 1 - similarity + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), left, ids, units, first in _groups(batches, ("component", "i", "j")):
            n, size = len(ids) if i == j else sum(left), np.diff(first)
            _, of = np.unique(units, return_inverse=True)
            vocabulary, label = int(of.max()) + 1, np.arange(len(ids))
            tiles = [(x, min(x + _TILE, y)) for start, y in ((0, n), (n, len(ids))) for x in range(start, y, _TILE)]
            for a in tiles:
                for b in tiles:
                    if a[0] < n and (b[0] >= a[0] if i == j else b[0] >= n):
                        common = shared_units(of, first, vocabulary, a, b).astype(np.float64)
                        d = 1 - common / (size[slice(*a), None] + size[None, slice(*b)] - common)
                        x, y = np.nonzero(d <= far)
                        label = joined(label, x + a[0], y + b[0])
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    return run


def _blocks(rows: F.Column, units: F.Column) -> F.Column:
    return F.ceil(F.greatest(rows / BLOCK_ROWS, units * 8 / BLOCK_BYTES)).cast("int")


def _waiting_links(members: DataFrame, waiting: DataFrame, similarity: float) -> DataFrame:
    """(a, b): what joins the waiting members to all that they are linked to; every pair of blocks, one of them of waiting members, is compared."""
    rows = members.select("component", "id", "units").join(waiting.withColumn("w", F.lit(True)), ["component", "id"], "left").withColumn("w", F.coalesce("w", F.lit(False)))
    rows = cut(rows, "marked")
    sums = [_blocks(F.coalesce(F.sum(F.when(x, 1)), F.lit(0)), F.coalesce(F.sum(F.when(x, F.octet_length("units") / 8)), F.lit(0))).alias(n) for x, n in ((F.col("w"), "nw"), (~F.col("w"), "ns"))]
    sizes = cut(rows.groupBy("component").agg(*sums).filter("nw > 0"), "blocks")
    tasks = sizes.agg(F.sum(F.expr("nw * (nw + 1) / 2 + nw * ns"))).first()[0]
    own = F.pmod(F.xxhash64("id"), F.greatest(F.when(F.col("w"), F.col("nw")).otherwise(F.col("ns")), F.lit(1))).cast("int") + F.when(F.col("w"), 0).otherwise(F.col("nw"))
    dealt = rows.join(F.broadcast(sizes), "component").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("w"), F.col("nw") + F.col("ns")).otherwise(F.col("nw")) - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "id", "units")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(tasks), 100_000))
    dealt = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", F.desc("left"))
    return cut(dealt.transform(in_arrow, _pairs(similarity), "a long, b long"), "links")


def _large(members: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(id, class_id) of the members of components too large for a task: rounds of representatives as long as they settle many members, then all links of those left over."""
    far = 1 - similarity + 1e-12
    sizes = members.groupBy("component").agg(_blocks(F.count("*"), F.sum(F.octet_length("units") / 8)).alias("blocks"))
    members = cut(members.join(F.broadcast(sizes), "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).repartition(parts), "large")
    waiting, left = members.select("component", "id"), members.count()
    found = None
    while left:
        chosen = waiting.groupBy("component").agg(F.min("id").alias("id"), *[F.min_by("id", F.xxhash64("id", F.lit(i))).alias(f"r{i}") for i in range(ROUND - 1)])
        chosen = chosen.select("component", F.explode(F.array_distinct(F.array("id", *[f"r{i}" for i in range(ROUND - 1)]))).alias("id"))
        reps = members.join(F.broadcast(chosen), ["component", "id"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.lit(True))
        names = ["component", "block", "left", "id", "units"]
        dealt = reps.select(names).unionByName(members.withColumn("left", F.lit(False)).select(names))
        dealt = dealt.repartition(parts, "component", "block").sortWithinPartitions("component", "block", F.desc("left"))
        got = cut(dealt.transform(in_arrow, _round(similarity), "id long, rep long, d double"), "round")
        found = got if found is None else found.unionByName(got)
        # settled: a representative, or one linked to one, unless it may link two groups; a group of representatives only has no unknown links
        group = components(found.filter(F.col("d") <= far).select(F.col("id").alias("a"), F.col("rep").alias("b")), "groups").withColumnRenamed("component", "g")
        of_rep = found.select("rep").distinct().join(group, group["id"] == F.col("rep"), "left").select("rep", F.coalesce("g", "rep").alias("rep_g"))
        still_open = found.filter(F.col("d") <= far).join(found.select(F.col("rep").alias("id")).distinct(), "id", "left_anti").select("rep", F.lit(True).alias("open")).distinct()
        seen = found.join(of_rep, "rep").join(still_open, "rep", "left").groupBy("id").agg(F.min("d").alias("d"), F.countDistinct(F.when(F.col("open") | (F.col("d") <= far), F.col("rep_g"))).alias("groups"))
        settled = seen.filter((F.col("d") <= far) & (F.col("groups") == 1)).select("id").unionByName(found.select(F.col("rep").alias("id"))).distinct()
        before, waiting = left, cut(members.select("component", "id").join(settled, "id", "left_anti").select("component", "id"), "waiting")
        left = waiting.count()
        if left > SETTLES * before:
            break
    links = found.filter(F.col("d") <= far).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if left:  # links of settled members to each other are known, so those of the others are all that is missing
        links = links.unionByName(_waiting_links(members, waiting, similarity))
    group = components(links, "groups")
    return members.select("id").join(group, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"))


def text_key() -> F.Column:
    """128 bits that tell texts apart; a null text has its doc_id's."""
    digest = F.when(F.col("text").isNull(), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.sha2("text", 256))
    return F.unhex(F.substring(F.sha2(digest, 256), 1, 32))


def _same_document(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b): numbers of texts that share a doc_id; few, as most doc_ids have one text."""
    several = keyed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("k").alias("k"), F.max("k").alias("most")).filter("k <> most").select("doc_id", F.col("k").alias("least"))
    pairs = keyed.join(several, "doc_id").select("k", "least").distinct().filter("k <> least")
    first = ids.select(F.col("k").alias("least"), F.col("id").alias("b"))
    return pairs.join(ids.select("k", F.col("id").alias("a")), "k").join(first, "least").select("a", "b")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k) of every row, and (k, group, doc_id) of every distinct text: its group's number, and the least doc_id of its rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", text_key())
    # equal texts: the least doc_id of each, added up before the shuffle
    keyed = cut(own.select("doc_id", "k"), "texts")
    ids = cut(keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "ids")
    texts = own.filter(F.col("text").isNotNull())
    # copies are signed too, which spares a shuffle of the texts; one row of each text goes on
    chosen = ids.select(F.col("k").alias("_k"), F.col("doc_id").alias("_d"), "id")
    is_chosen = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    signed = cut(texts.transform(in_arrow, _bands(bands, rows), "doc_id long, k binary, bands array<long>, units long"), "bands")
    signed = cut(signed.join(chosen, is_chosen).select("id", "bands", "units").dropDuplicates(["id"]), "signed")
    banded = signed.select("id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least")
    links = banded.join(least, "band").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    member = components(links)
    sized = member.join(signed.select("id", "units"), "id")
    large = sized.groupBy("component").agg(F.sum("units").alias("units"), F.count("*").alias("n")).filter((F.col("units") * 8 > ALONE_BYTES) | (F.col("n") > ALONE_ROWS)).select("component", F.lit(True).alias("large"))
    member = cut(member.join(large, "component", "left").select("id", "component", F.coalesce("large", F.lit(False)).alias("large")), "members")
    wanted = member.join(ids, "id").select(F.col("k").alias("_k"), F.col("doc_id").alias("_d"), "id", "component", "large")
    sets = cut(texts.join(wanted, is_chosen).select("text", "id", "component", "large").transform(in_arrow, _units, "id long, component long, large boolean, units binary"), "units")
    parts = parts_for(docs.select("text"), 8_000_000)
    alone = sets.filter(~F.col("large")).dropDuplicates(["id"]).repartition(parts, "component").sortWithinPartitions("component", "id").select("component", "id", "units").transform(in_arrow, _alone(similarity), "id long, class_id long")
    if member.filter("large").limit(1).count():
        whole = cut(sets.filter("large").dropDuplicates(["id"]).select("component", "id", "units"), "whole")
        alone = alone.unionByName(_large(whole, similarity, parts))
    classes = cut(alone.filter("id <> class_id"), "classes")
    same = cut(_same_document(keyed, ids), "same")
    if same.limit(1).count():
        joined = components(classes.select(F.col("id").alias("a"), F.col("class_id").alias("b")).unionByName(same), "groups")
        classes = joined.select("id", F.col("component").alias("class_id"))
    return keyed, ids.join(classes, "id", "left").select("k", F.coalesce("class_id", "id").alias("group"), "doc_id")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id of the documents that it is linked to, directly or through others."""
    keyed, groups = near_groups(docs, similarity, bands, rows)
    groups = cut(groups, "grouped")
    # groups of one text need no sum; the others are a small part of it
    least = groups.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    of_text = groups.join(least, "group").select("k", "class_id")
    return keyed.join(of_text, "k").select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of docs for each class, with all its columns: of the least doc_id (a null one comes last), then of the least text key."""
    keyed, groups = near_groups(docs, similarity, bands, rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    best = cut(groups.groupBy("group").agg(F.min(order).alias("b")).select(F.col("b.k").alias("k"), F.col("b.doc_id").alias("doc_id")), "best")
    is_best = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    again = keyed.join(best.select(F.col("k").alias("_k"), F.col("doc_id").alias("_d")), is_best).groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.lit(True).alias("again"))
    best = cut(best.join(again, "k", "left").select("k", "doc_id", F.coalesce("again", F.lit(False)).alias("again")), "kept")
    names = [f"_{i}" for i in range(len(docs.columns))]
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    # the row travels as one struct, whatever its columns are called
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), F.struct(*[F.col(q).alias(n) for q, n in zip(quoted, names, strict=True)]).alias("row"))
    found = whole.join(best.select(F.col("k").alias("_k"), F.col("doc_id").alias("_d"), "again"), is_best)  # by both, so copies of a text don't meet
    # only rows that stand more than once are brought together
    kept = found.filter(~F.col("again")).select("row").unionByName(found.filter("again").dropDuplicates(["k"]).select("row"))
    return kept.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op2_dart_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(load(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, so for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT min(doc_id) id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM d),
g AS (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) i FROM w WHERE len(ws) > 0),
s AS (SELECT id, array_to_string(ws[i:i+4], ' ') k, count(*) c FROM g GROUP BY ALL),
z AS (SELECT id, sum(c) n FROM s GROUP BY id),
p AS (SELECT a.id a, b.id b, sum(least(a.c, b.c)) m FROM s a JOIN s b ON a.k = b.k AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 10 * m >= 8 * (x.n + y.n - m)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
k AS (SELECT id, min(c) c FROM r GROUP BY id)
SELECT doc_id, coalesce(c, doc_id)::BIGINT AS class_id FROM documents LEFT JOIN d USING (text) LEFT JOIN k USING (id)
"""
