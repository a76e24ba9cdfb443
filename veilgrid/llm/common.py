"""What the text operators share: Arrow byte buffers, word spans, partition counts, durable cuts.

Every operator takes only the columns it names out of its input, so further columns of any
name do no harm.  Words are found on UTF-8 bytes; all separators are ASCII, so a byte of a
longer character is never taken for one.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
IS_WORD = ~SPACES
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 8 << 20
#: Bytes that one batch between Spark and Python holds, unless one row does.
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Catalyst gives plans without statistics, such as rows made in the driver, a size near the largest long.
UNKNOWN = 1 << 60


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate, which for a file scan is the size of the files."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a plan without statistics
        return 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each holds about bytes_each of df as stored; never under the session's own number, which holds where the size is unknown."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return least if size >= UNKNOWN else max(least, min(size // bytes_each + 1, 100_000))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; outside a cluster, where none is named, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"veilgrid-{os.getuid()}")
    os.makedirs(path, exist_ok=True)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class _Made(threading.local):
    """Paths that this thread has written and nobody has removed."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What operators write to cut lineage within is removed at the end: results must be written by then."""
    before = len(_MADE.paths)
    try:
        yield
    finally:
        while len(_MADE.paths) > before:
            remove(spark, _MADE.paths.pop())


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark reads names, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def as_row(docs: DataFrame, but: tuple[str, ...] = ()) -> F.Column:
    """All columns but these as one struct `row`, whose fields are numbered: names do no harm there."""
    return F.struct(F.lit(True).alias("_"), *[F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(docs.columns) if c not in but]).alias("row")


def from_row(found: DataFrame, columns: list[str], **other: F.Column) -> DataFrame:
    """The columns of as_row again, some of them with another value."""
    return found.select(*[other[c].alias(c) if c in other else F.col(f"row._{i}").alias(c) for i, c in enumerate(columns)])


def _tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """function, after which the worker gives what it has freed back to the system: it is kept for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if tune := getattr(libc, "mallopt", None):
            tune(-3, 1 << 20)  # arrays from 1 MB on go back when they are freed
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(libc, "malloc_trim", None):
            trim(0)

    return run


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose batches are bounded in bytes as well as in rows, however long the texts are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    names = df.columns
    if any(set(c) & set(".`") for c in names):  # Spark would read these as paths

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return function(b.rename_columns(names) for b in batches)

        return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(_tidy(named), schema)
    return df.mapInArrow(_tidy(function), schema)


def zip_arrays(*arrays, level: int = 1) -> bytes:
    """Arrays by byte planes, where the high bytes of small numbers stand together; bytes as they are."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=level).compress(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts))


def unzip_arrays(blob: bytes, *types) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(types)
    at = 8 * n + np.append(0, np.cumsum(np.frombuffer(raw, np.int64, n)))
    parts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return [x if t is bytes else np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for x, t in zip(parts, types, strict=True)]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts and the last ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no piece holds more than `most` bytes of text unless one text does."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_buffer(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in raw, the index of each text's first word (and of the end), and the mask of word bytes."""
    mask = is_word[raw]
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(at), np.int64), mask
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = ~mask[:-1]
    inner = at[:-1]
    edge[inner[inner < n]] = True
    start = np.flatnonzero(mask & edge)
    edge[-1] = True
    edge[:-1] = ~mask[1:]
    inner = at[1:] - 1
    edge[inner[inner >= 0]] = True
    end = np.flatnonzero(mask & edge) + 1
    return start, end, np.searchsorted(start, at), mask


def binary_array(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of raw with these lengths, as an Arrow binary array without copying."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def encode_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """An exact id for every word and the distinct words by id."""
    coded = binary_array(raw[mask], end - start).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def single_spaced(raw: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Every word followed by one blank, and where each word starts in that (and the end)."""
    lengths = end - start
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = raw[mask]
    return out.tobytes(), at


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C55


def hash_words(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each of the (distinct) binary words."""
    raw, at = text_buffer(words)
    n = len(raw)
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(len(raw) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) * back[at[:-1]] + np.diff(at).astype(np.uint64))


def row_key() -> F.Column:
    """Tells rows apart by what an operator reads: equal only for repeated rows."""
    return F.xxhash64("doc_id", "text")
