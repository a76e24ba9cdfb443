"""Sharding of indivisible groups by Karmarkar-Karp differencing.

Equal texts are one group, whose size is added up before any shuffle.  Groups are dealt to
partitions; each starts from partial partitions with one group in one piece and repeatedly
combines the two with the largest spread, oppositely ordered, until one with PIECES pieces is
left.  While more than MOST_PARTS partitions have pieces, the pieces of FAN partitions at a time are
combined in a task to PIECES new ones, so a task holds a bounded number of items at any size of the
table.  The driver combines the last pieces to shards in the same way, together with each group that
is larger than 1 in LARGE of a shard's share: there are fewer than shards * LARGE of those, and
small pieces are left to balance them.

Law: bytes.  Size is the text's UTF-8 bytes plus 8.  No group is split, so one that is larger
than a shard's share makes that shard the largest.  Slots count each shard's rows from 0 without
gaps; they come from counts of (shard, slice) pairs, so no task holds a whole shard.

Defined cases: null texts have size 8 and are one group, apart from that of empty texts; repeated
rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_arrow, load, parts_for

SHARDS = 24
#: Groups with more than 1 in HOT rows are joined by broadcast: there are fewer than HOT of them.
HOT = 2000
#: Slices of a shard, each numbered by itself.
GROUP_BYTES = 64 << 20
#: Pieces that a partition's small groups are combined to.
PIECES, LARGE = 64, 64
#: Partitions whose pieces the driver combines at most, and those whose pieces a task does.
MOST_PARTS, FAN = 1024, 256


def difference(partials: list[tuple[np.ndarray, object]], shards: int) -> tuple[np.ndarray, list[list[object]]]:
    """(sizes, members of each shard) of the largest-differencing combination of partial partitions.

    A partial partition is (sizes ascending, a label); the result lists for each shard the
    (label, place in that partial partition) pairs that went there.
    """
    heap = []
    for n, (sizes, label) in enumerate(partials):
        heap.append((-(int(sizes[-1]) - int(sizes[0])), n, np.asarray(sizes, np.int64), (label,)))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        total = a + b[::-1]
        order = np.argsort(total, kind="stable")
        heapq.heappush(heap, (-int(total[order[-1]] - total[order[0]]), n, total[order], (x, y, order)))
        n += 1
    _, _, sizes, tree = heap[0]
    out: list[list[object]] = [[] for _ in range(shards)]
    todo = [(tree, np.arange(shards))]  # place in this partial partition -> shard
    while todo:
        node, shard = todo.pop()
        if len(node) == 1:
            for place, s in enumerate(shard.tolist()):
                out[s].append((node[0], place))
            continue
        x, y, order = node
        back = np.empty(shards, np.int64)
        back[order] = shard
        todo.append((x, back))
        todo.append((y, back[::-1]))
    return sizes, out


def single(size: int, shards: int) -> np.ndarray:
    """The partial partition with one item, in its last and largest place."""
    v = np.zeros(shards, np.int64)
    v[-1] = size
    return v


def _part(pieces: int):
    """Groups of one partition to its pieces; one partition in, one combination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        size = table.column("bytes").to_numpy()
        local = np.zeros(len(size), np.int32)
        partials = [(single(b, pieces), i) for i, b in enumerate(size.tolist())]
        for s, members in enumerate(difference(partials, pieces)[1]):
            local[[i for i, place in members if place == pieces - 1]] = s
        yield from table.append_column("local", pa.array(local)).to_batches()

    return run


def _merge_pieces(pieces: int):
    """Pieces (up, part, local, bytes) of several partitions to new ones, apart for each `up`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("up", "ascending"), ("part", "ascending"), ("local", "ascending")]).combine_chunks()
        up, size = table.column("up").to_numpy(), table.column("bytes").to_numpy()
        piece = np.zeros(len(size), np.int32)
        for own in np.split(np.arange(len(up)), np.flatnonzero(np.diff(up)) + 1):
            for s, members in enumerate(difference([(single(size[i], pieces), i) for i in own.tolist()], pieces)[1]):
                piece[[i for i, place in members if place == pieces - 1]] = s
        yield from table.append_column("piece", pa.array(piece)).to_batches()

    return run


def shard_groups(groups: DataFrame, shards: int = SHARDS, parts: int = 64) -> DataFrame:
    """groups (k, bytes, n) with the shard of each; they are read more than once."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_large = F.col("bytes") * (shards * LARGE) > total
    large = [(bytes(k), size) for k, size in groups.filter(is_large).select("k", "bytes").orderBy("k").collect()]  # fewer than shards * LARGE
    dealt = groups.filter(~is_large).withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    local = cut(dealt.transform(in_arrow, _part(PIECES), "k binary, bytes long, n long, part int, local int"), "local")
    level = local.groupBy("part", "local").agg(F.sum("bytes").alias("bytes"))
    path = []  # of each step: what pieces of it became
    while parts > MOST_PARTS:
        parts = -(-parts // FAN)
        grouped = cut(level, "level").select(F.pmod("part", F.lit(parts)).cast("int").alias("up"), "part", "local", "bytes")
        merged = cut(grouped.repartitionById(parts, F.col("up")).transform(in_arrow, _merge_pieces(PIECES), "up int, part int, local int, bytes long, piece int"), "merged")
        path.append(merged.select("part", "local", "up", "piece"))
        level = merged.groupBy(F.col("up").alias("part"), F.col("piece").alias("local")).agg(F.sum("bytes").alias("bytes"))
    sums = sorted(tuple(r) for r in level.collect())  # MOST_PARTS * PIECES at most
    items: list[tuple[np.ndarray, object]] = [(single(size, shards), (part, piece)) for part, piece, size in sums] + [(single(size, shards), k) for k, size in large]
    if not items:
        return groups.select("k", "bytes", "n", F.lit(0).alias("shard"))
    of_item = {label: s for s, members in enumerate(difference(items, shards)[1]) for label, place in members if place == shards - 1}
    of_pieces = spark.createDataFrame([(*k, s) for k, s in of_item.items() if isinstance(k, tuple)], "part int, local int, shard int")
    of_large = spark.createDataFrame([(bytearray(k), s) for k, s in of_item.items() if isinstance(k, bytes)], "k binary, shard int")
    where = F.broadcast(of_pieces)
    for step in reversed(path):  # from the last pieces down to those of the partitions
        where = step.join(where.select(F.col("part").alias("up"), F.col("local").alias("piece"), "shard"), ["up", "piece"]).select("part", "local", "shard")
    small = local.join(where, ["part", "local"]).select("k", "bytes", "n", "shard")
    return small.unionByName(groups.join(F.broadcast(of_large), "k").select("k", "bytes", "n", "shard"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"null").cast("binary")).alias("k"),
    )
    rows = cut(rows, "sizes")
    groups = cut(rows.groupBy("k").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    parts = parts_for(docs.select("text"), GROUP_BYTES)
    placed = cut(shard_groups(groups, shards, parts), "placed")
    total = rows.count()
    hot = placed.filter(F.col("n") * HOT > total).select("k", "shard")
    joined = rows.join(F.broadcast(hot), "k", "left")
    rest = placed.filter(F.col("n") * HOT <= total).select("k", F.col("shard").alias("of_rest"))
    done = joined.filter("shard is not null").unionByName(joined.filter("shard is null").drop("shard").join(rest, "k").withColumnRenamed("of_rest", "shard"))
    slices = parts_for(docs.select("text"), GROUP_BYTES)
    done = cut(done.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)).cast("int").alias("slice")), "shards")
    counts = done.groupBy("shard", "slice").agg(F.count("*").alias("rows"))  # shards * slices at most
    before = counts.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")
    return (
        done.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(before), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op1_karmarkar_karp_shards(spark, sf_dir: str) -> DataFrame:
    return shard_rows(load(spark, sf_dir, "documents"))
