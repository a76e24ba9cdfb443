"""A stored catalog of synthetic tables: one for each column and for every pair and triple, and larger ones that need no clustering.

A blob is a folder of Parquet tables, one for each number of columns, split by combo=<column
numbers>, with JSON metadata and a small Parquet table of measures; it holds no original data, no
ids and no salt.  Its folder may be on any file system that Spark writes to; a blob on a local one can be zipped.  A read takes the table of its columns, or stitches one from tables that there are.
"""

from __future__ import annotations

import shutil
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import AnonymizationParams, BucketizationParams
from ..operators.nodes import key_of
from ..operators.stitch import patch
from ..plans.clustering import Clusters, ClusteringContext, NoClustering, anneal, solve_with_features
from ..plans.features import select_features
from ..plans.synthesizer import Synthesizer, stitch
from .tables import Folder, read_table, write_table

VERSION = 1
#: Tables that are written at a time.
WRITERS = 8


@dataclass
class ClusterParams:
    sample_size: int = 1000
    default_max_weight: float = 15.0
    ml_max_weight: float = 15.0
    merge_threshold: float = 0.1
    solver_alpha: float = 0.01
    max_cluster_size: int = 10


class _Blob:
    def __init__(self, spark: SparkSession, name: str, folder: str | None):
        self.folder = Folder(spark, folder or ".")
        if not self.folder.is_dir():
            raise NotADirectoryError(str(folder))
        self.name = name
        self.path, self.archive = f".{name}.blob", f"{name}.blob.zip"  # within the folder

    def context(self, columns: list[int]) -> ClusteringContext:
        return ClusteringContext(self.matrix, self.entropy).shrink(columns)

    def targeted(self, columns: list[int], target: int) -> Clusters:
        """Clusters of these columns (numbered among themselves) for a target."""
        features = [columns.index(c) for c in self.features[target] if c in columns]
        return solve_with_features(columns.index(target), features, self.params.ml_max_weight, self.entropy[np.array(columns)])

    def untargeted(self, columns: list[int]) -> Clusters:
        return anneal(self.context(columns), self.params.default_max_weight, self.params.merge_threshold, self.params.solver_alpha)


class BlobBuilder(_Blob):
    def __init__(self, name: str, folder: str | None = None, force: bool = False, **cluster_params):
        super().__init__(SparkSession.builder.getOrCreate(), name, folder)
        if (self.folder.exists(self.path) or self.folder.exists(self.archive)) and not force:
            raise FileExistsError(f"{self.path}; force overwrites it")
        self.params = ClusterParams(**cluster_params)

    def write(self, df: DataFrame, pid_cols: list[str] | None = None, value_safe_columns: list[int | str] | None = None, anonymization_params: AnonymizationParams | None = None, bucketization_params: BucketizationParams | None = None, salt: bytes | None = None, zipped: bool | None = None) -> None:
        """zipped: into one file, which is what happens on a local file system unless it is False."""
        local = self.folder.local
        if zipped and local is None:
            raise ValueError("only a blob on a local file system can be zipped")
        self.folder.remove(self.path)
        self.folder.remove(self.archive)
        syn = Synthesizer(df, pid_cols, anonymization_params, bucketization_params, clustering=NoClustering(), value_safe_columns=value_safe_columns, salt=salt)
        n = len(syn.names)
        self.matrix, self.entropy = syn.measure(None)
        self.features = {}
        if n > 3:
            for c in range(n):
                found = select_features(syn.encoded, syn.names, c, sentinels=[e.sentinel for e in syn.encoders])
                self.features[c] = [syn.names.index(x) for x in found.features]
        else:
            self.features = {c: [x for x in range(n) if x != c] for c in range(n)}
        combos = [c for k in (1, 2, 3) if k <= max(2, self.params.max_cluster_size) for c in combinations(range(n), k)]
        larger: list[tuple[int, ...]] = []
        for c in combinations(range(n), 3):
            self._larger(c, n, larger)
        # all trees of one size are built together, whatever the number of combinations; their tables are then written several at a time
        tables = syn.materialize(combos + larger)
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda c: write_table(syn.named(tables[c], list(c)), f"{self.folder.path}/{self.path}/combo={key_of(c)}"), tables))
        anonymization = asdict(syn.params)
        anonymization.pop("salt")
        spark = df.sparkSession
        measures = [(i, j, round(float(self.matrix[i, j]), 2), round(float(self.entropy[i]), 2)) for i in range(n) for j in range(n)]
        write_table(spark.createDataFrame(measures, "x int, y int, dependence double, entropy double").coalesce(1), f"{self.folder.path}/{self.path}/measures")
        self.folder.write_json({"version": VERSION, "columns": syn.names, "cluster_params": asdict(self.params), "bucketization_params": asdict(syn.buckets), "anonymization_params": anonymization, "features": {str(k): v for k, v in self.features.items()}, "tables": [key_of(c) for c in combos + larger]}, f"{self.path}/metadata.json")
        if local is not None and zipped is not False:
            shutil.make_archive(f"{local}/{self.archive}".removesuffix(".zip"), "zip", f"{local}/{self.path}")
            self.folder.remove(self.path)

    def _larger(self, combo: tuple[int, ...], n: int, out: list[tuple[int, ...]]) -> None:
        for i in range(combo[-1] + 1, n):
            new = (*combo, i)
            if len(new) > self.params.max_cluster_size:
                return
            own = list(new)
            if not self.untargeted(own).derived or any(not self.targeted(own, t).derived for t in own):
                out.append(new)
                self._larger(new, n, out)


class BlobReader(_Blob):
    def __init__(self, spark: SparkSession, name: str, folder: str | None = None, cache: bool = True, **cluster_params):
        super().__init__(spark, name, folder)
        if not self.folder.exists(self.path):
            if not self.folder.exists(self.archive) or self.folder.local is None:
                raise FileNotFoundError(f"{self.folder.path}/{self.archive}")
            shutil.unpack_archive(f"{self.folder.local}/{self.archive}", f"{self.folder.local}/{self.path}", "zip")
        self.spark, self.cache = spark, cache
        meta = self.folder.read_json(f"{self.path}/metadata.json")
        self.columns: list[str] = meta["columns"]
        self.version = meta["version"]
        self.params = ClusterParams(**(meta["cluster_params"] | cluster_params))
        self.features = {int(k): v for k, v in meta["features"].items()}
        self.catalog = {tuple(int(x) for x in t.split("_")): f"{self.folder.path}/{self.path}/combo={t}" for t in meta["tables"]}
        n = len(self.columns)
        self.matrix, self.entropy = np.ones((n, n)), np.ones(n)
        for r in read_table(spark, f"{self.folder.path}/{self.path}/measures").collect():
            self.matrix[r["x"], r["y"]], self.entropy[r["x"]] = r["dependence"], r["entropy"]
        self._loaded: dict[tuple[int, ...], DataFrame] = {}
        self._record: list[dict] = []

    def stitch_record(self) -> list[dict]:
        """What the last read stitched."""
        return list(self._record)

    def read(self, columns: list[str] | None = None, target_column: str | None = None) -> DataFrame:
        """The columns asked for, in that order; all of them if none are named."""
        columns = list(self.columns if columns is None else columns)
        if missing := [c for c in columns if c not in self.columns]:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        if len(set(columns)) != len(columns):
            raise ValueError("columns named twice")
        if target_column is not None and target_column not in self.columns:
            raise ValueError(f"no such target column: {target_column}")
        self._record = []
        want = sorted(self.columns.index(c) for c in columns)
        target = None if target_column is None else self.columns.index(target_column)
        return self._assemble(want, target).select(*columns)

    def _assemble(self, want: list[int], target: int | None) -> DataFrame:
        if tuple(want) in self.catalog:
            return self._table(want)
        if target is not None and target not in want:
            target = None
        clusters = self.untargeted(want) if target is None else self.targeted(want, target)
        left = self._table([want[c] for c in clusters.initial])
        for _, on, new in clusters.derived:
            right = self._table([want[c] for c in on + new])
            if on:  # both sides first take the stitch columns' own joint values
                pivot = self._table([want[c] for c in on])
                left, right = self._stitch(pivot, left, False), self._stitch(pivot, right, False)
                left = self._stitch(left, right, True)
            else:
                left = self._patch(left, right)
        return left

    def _table(self, columns: list[int]) -> DataFrame:
        key = tuple(sorted(columns))
        if key in self._loaded:
            return self._loaded[key]
        if key not in self.catalog:
            return self._recover(key)
        df = read_table(self.spark, self.catalog[key])
        if self.cache:
            self._loaded[key] = df.cache()
        return df

    def _recover(self, key: tuple[int, ...]) -> DataFrame:
        """A table that isn't there, from two halves that share the column of most entropy."""
        pivot = max(key, key=lambda c: self.entropy[c])
        rest = [c for c in key if c != pivot]
        half = len(rest) // 2
        return self._stitch(self._table([*rest[:half], pivot]), self._table([*rest[half:], pivot]), True)

    def _stitch(self, left: DataFrame, right: DataFrame, shared: bool) -> DataFrame:
        self._record.append({"left": list(left.columns), "right": list(right.columns), "owner": "shared" if shared else "left"})
        return stitch(left, right, shared)

    def _patch(self, left: DataFrame, right: DataFrame) -> DataFrame:
        keyed = lambda df, at: df.select(F.xxhash64(*df.columns).alias("row"), *[F.col(c).alias(f"v{at + i}") for i, c in enumerate(df.columns)])
        out = patch(keyed(left, 0), keyed(right, len(left.columns)))
        names = [*left.columns, *right.columns]
        return out.select(*[F.col(f"v{i}").alias(c) for i, c in enumerate(names)])
