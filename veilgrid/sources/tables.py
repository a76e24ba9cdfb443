"""Readers, writers and durable cuts."""

from __future__ import annotations

import json
import os
import secrets
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; only the empty string is null; text that is ISO 8601 throughout becomes timestamps."""
    df = spark.read.csv(path, header=True, inferSchema=True, nullValue="", timestampFormat="'none'", dateFormat="'none'")
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_to_timestamp(`{c}`)").isNull()).alias(f"b{i}") for i, c in enumerate(texts)], *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    stamps = [c for i, c in enumerate(texts) if bad[f"n{i}"] and not bad[f"b{i}"]]
    return df.withColumns({c: F.expr(f"cast(try_to_timestamp(`{c}`) as timestamp_ntz)") for c in stamps})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        raise OSError(f"can't read {path}") from e


def write_table(df: DataFrame, path: str) -> None:
    try:
        df.write.mode("overwrite").parquet(path)
    except Exception as e:
        raise OSError(f"can't write {path}") from e


class Folder:
    """A folder on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, str(path).rstrip("/") or "/"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def local(self) -> str | None:
        """Where it is for Python's own file functions, if it is on a local file system."""
        at = self._fs.makeQualified(self._at("")).toUri()
        return at.getPath() if at.getScheme() == "file" else None

    def is_dir(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._at(name)).isDirectory()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> Any:
        try:
            stream = self._fs.open(self._at(name))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        except Exception as e:
            raise OSError(f"can't read {self.path}/{name}") from e

    def write_json(self, value: Any, name: str) -> None:
        try:
            text = json.dumps(value, indent=1)
            stream = self._fs.create(self._at(name), True)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
        except Exception as e:
            raise OSError(f"can't write {self.path}/{name}") from e


def stored_salt(folder: str | Path | None = None) -> bytes:
    """Eight random bytes, made once for each user."""
    path = Path(folder or os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config")) / "veilgrid" / "salt.bin"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(secrets.token_bytes(8))
    return path.read_bytes()


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"veilgrid-{os.getuid()}")
    os.makedirs(path, exist_ok=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that loops don't grow their lineage."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with its place `n` from 0 in this order, by a range sort and the partitions' counts: no task holds all rows."""
    at = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r[0], r[1]) for r in at.groupBy(part.alias("p")).count().collect())
    total, before = 0, []
    for p, n in counts:
        before.append((int(p), total))
        total += n
    if not before:
        return at.withColumn("n", F.col("_id")).drop("_id")
    offsets = df.sparkSession.createDataFrame(before, "_p long, _before long")
    return at.withColumn("_p", part.cast("long")).join(F.broadcast(offsets), "_p").withColumn("n", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_id", "_before")
