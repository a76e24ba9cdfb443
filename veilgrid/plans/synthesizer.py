"""The synthesizer: a table in, an anonymized table like it out."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode as enc
from ..functions.intervals import hull, null_sentinel, snap
from ..functions.noise import hashed_ids
from ..functions.params import AnonymizationParams, BucketizationParams, ColumnType, SuppressionParams, column_positions
from ..operators.harvest import harvest
from ..operators.measures import entropy as measure_entropy
from ..operators.measures import measure_all
from ..operators.microdata import decode, expand
from ..operators.nodes import TreeBuilder, key_of
from ..operators.stitch import StitchColumn, StitchOwner, stitch_rows
from ..sources.tables import cut, stored_salt
from .clustering import Clusters, ClusteringStrategy, DefaultClustering, MlClustering, should_sample


class Synthesizer:
    """df: the table; pid_cols: its columns of protected-entity ids, which are not synthesized.

    Without pid_cols each row is an entity of its own; its id is a hash of the row and of its
    number among equal rows, so it does not depend on partitions or order.
    """

    def __init__(
        self,
        df: DataFrame,
        pid_cols: list[str] | None = None,
        anonymization_params: AnonymizationParams | None = None,
        bucketization_params: BucketizationParams | None = None,
        target_column: int | str | None = None,
        clustering: ClusteringStrategy | None = None,
        value_safe_columns: list[int | str] | None = None,
        salt: bytes | None = None,
    ):
        if target_column is not None and clustering is not None:
            raise ValueError("give a target column or a clustering strategy, not both")
        pid_cols = list(pid_cols or [])
        column_positions(df.columns, pid_cols)
        data = df.drop(*pid_cols)
        self.names, self.schema = data.columns, data.schema
        safe = set(column_positions(self.names, value_safe_columns or []))
        if target_column is not None:
            column_positions(self.names, target_column)
        self.strategy = clustering or (MlClustering(target_column) if target_column is not None else DefaultClustering())
        params = anonymization_params or AnonymizationParams()
        if salt is not None:
            params = replace(params, salt=salt)
        elif not params.salt:
            params = replace(params, salt=stored_salt())
        self.params, self.buckets = params, bucketization_params or BucketizationParams()
        self.spark = df.sparkSession
        self.encoders, self.words = enc.fit(data, [i in safe for i in range(len(self.names))])
        if pid_cols:
            self._id_types = {c: df.schema[c].dataType.typeName() for c in pid_cols}
            if bad := [c for c, t in self._id_types.items() if t not in ("string", "integer", "long", "short", "byte")]:
                raise TypeError(f"ids must be integers or strings: {', '.join(bad)}")
            rows = df.withColumn("pids", F.array(*[self._hashed(c) for c in pid_cols]))
        else:
            rows = self._one_id_a_row(df)
        self.unique = not pid_cols
        self.encoded = cut(enc.encode(rows, self.encoders, self.words, ["pids"]))
        self._builder: TreeBuilder | None = None
        self._clusters: Clusters | None = None
        self._entropy: np.ndarray | None = None

    def _one_id_a_row(self, df: DataFrame) -> DataFrame:
        """pids from each row's hash and its number among equal rows, which are numbered within partitions first: no task gets all of them."""
        key = F.xxhash64(*[F.col(f"`{c}`") for c in self.names])
        rows = cut(df.select(*[f"`{c}`" for c in self.names]).withColumns({"_k": key, "_p": F.spark_partition_id()}))
        counts = rows.groupBy("_k", "_p").agg(F.count("*").alias("n"))
        before = counts.select("_k", "_p", (F.sum("n").over(Window.partitionBy("_k").orderBy("_p")) - F.col("n")).alias("_before"))
        again = F.row_number().over(Window.partitionBy("_k", "_p").orderBy("_k"))
        return rows.join(before, ["_k", "_p"]).withColumn("pids", F.array(F.xxhash64("_k", F.col("_before") + again)))

    def _hashed(self, column: str):
        """Integers reach Python without nulls (0 is none either), which would turn them into floats."""
        c = F.col(f"`{column}`")
        return hashed_ids(c if self._id_types[column] == "string" else F.coalesce(c.cast("long"), F.lit(0).cast("long")))

    @property
    def salt(self) -> bytes:
        return self.params.salt

    def column_id(self, column: int | str) -> int:
        return column_positions(self.names, column)[0]

    @property
    def builder(self) -> TreeBuilder:
        if self._builder is None:
            self._builder = TreeBuilder(self.encoded, self.names, [e.root for e in self.encoders], self.params, self.buckets, self.unique, value_safe=[e.value_safe for e in self.encoders])
        return self._builder

    @property
    def clusters(self) -> Clusters:
        if self._clusters is None:
            self._clusters, self._entropy = self.strategy.build_clusters(self)
        return self._clusters

    @clusters.setter
    def clusters(self, value: Clusters) -> None:
        self._clusters = value
        if self._entropy is None:
            self._entropy = np.ones(len(self.names))

    def measure(self, sample_size: int | None = 1000, entropy_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(dependence matrix, entropies), on a sample where that spares enough."""
        if entropy_only:
            return None, measure_entropy(self.builder)
        total = self.encoded.count()
        if sample_size is not None and should_sample(len(self.names), total, sample_size):
            few = cut(self.encoded.orderBy(F.xxhash64("pids", "v")).limit(sample_size))
            params = replace(self.params, low_count_params=SuppressionParams(2, 0.5, 1.0), layer_noise_sd=0.0)
            ends = few.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(len(self.names)) for n, f in (("a", F.min), ("b", F.max))]).first()
            roots = []
            for i in range(len(self.names)):
                x = hull(ends[f"a{i}"], ends[f"b{i}"])
                roots.append(snap(hull(*x, null_sentinel(x))))
            return measure_all(TreeBuilder(few, self.names, roots, params, self.buckets, self.unique))
        return measure_all(self.builder)

    def safe_words(self) -> dict[str, DataFrame]:
        """Strings that enough entities share: values of single-valued leaves above the low count."""
        strings = [i for i, e in enumerate(self.encoders) if e.kind is ColumnType.STRING]
        if not strings:
            return {}
        self.builder.build([(i,) for i in strings])
        out = {}
        for i in strings:
            e = self.encoders[i]
            own = self.builder.levels[1].filter((F.col("combo") == str(i)) & ~F.col("low") & (F.col("amin")[0] == F.col("amax")[0]) & (F.col("amin")[0] != F.lit(e.sentinel)))
            out[e.name] = own.select(F.bround(e.restore(F.col("amin")[0]), 0).cast("long").alias("n")).distinct()
        return out

    def safe_values(self) -> dict[str, DataFrame]:
        """The values that a value-safe column may show."""
        out = {}
        for i, e in enumerate(self.encoders):
            if e.value_safe and e.kind not in (ColumnType.STRING, ColumnType.BOOLEAN):
                x = F.col("v")[i]
                out[e.name] = cut(self.encoded.filter(x != e.sentinel).select(e.restore(x).alias("x")).distinct())
        return out

    def materialize(self, combos: list[tuple[int, ...]]) -> dict[tuple[int, ...], DataFrame]:
        """(row, v<c>, f<c>) of each combination, from one build of all their trees."""
        combos = [tuple(sorted(c)) for c in combos]
        buckets = cut(harvest(self.builder.family(combos), self.salt, {i for i, e in enumerate(self.encoders) if e.value_safe}))
        words, values = self.safe_words(), self.safe_values()
        out = {}
        for c in combos:
            rows = expand(buckets.filter(F.col("goal") == key_of(c)), c, f"{self.salt.hex()} {key_of(c)}")
            done = decode(rows, c, self.encoders, self.words, words, values)
            out[c] = done.select("row", *[f"{x}{i}" for i in c for x in "vf"])
        return out

    def named(self, rows: DataFrame, columns: list[int]) -> DataFrame:
        return rows.select(*[F.col(f"v{c}").cast(self.schema[c].dataType).alias(self.names[c]) for c in columns])

    def stitch_columns(self, columns: list[int]) -> list[StitchColumn]:
        entropy = self._entropy if self._entropy is not None else np.ones(len(self.names))
        out = []
        for c in sorted(columns, key=lambda c: (entropy[c], c)):
            e, root = self.encoders[c], self.builder.roots[c]
            unit = (e.scale if e.scaled else 1.0) if e.integral else None
            out.append(StitchColumn(c, root.lo, root.hi, unit, max(e.sentinel, enc.TOP)))
        return out

    def sample(self) -> DataFrame:
        """The synthetic table, columns in the input's order and types."""
        clusters = self.clusters
        if not self.names:
            return self.encoded.select()
        needed = [clusters.initial, *[s + d for _, s, d in clusters.derived]]
        tables = self.materialize(needed)
        table, have = tables[tuple(sorted(clusters.initial))], set(clusters.initial)
        for owner, stitch, new in clusters.derived:
            right = tables[tuple(sorted(stitch + new))]
            table = stitch_rows(table, right, self.stitch_columns(stitch), owner)
            have |= set(new)
        return self.named(table, sorted(have))


def describe_clusters(syn: Synthesizer) -> dict[str, list]:
    """Clusters by column names."""
    name = lambda cs: [syn.names[c] for c in cs]
    return {"initial": name(syn.clusters.initial), "derived": [(o.value, name(s), name(d)) for o, s, d in syn.clusters.derived]}


def stitch(left: DataFrame, right: DataFrame, shared: bool = True) -> DataFrame:
    """Two tables joined along the columns of equal name; with shared, values of these alternate between the sides, else they are the left's."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables share no column to stitch on")
    both = left.select(*common).unionByName(right.select(*common))
    names = common + [c for c in left.columns if c not in common] + [c for c in right.columns if c not in common]
    encoders, words = enc.fit(both)

    def side(df: DataFrame) -> DataFrame:
        from ..sources.tables import numbered

        keyed = numbered(df.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), "_h").withColumnRenamed("n", "row").drop("_h")
        keep = ["row", *df.columns]
        made = enc.encode(keyed, encoders, words, keep)
        values = [F.col(f"`{c}`").alias(f"v{names.index(c)}") for c in df.columns]
        floats = [(F.col("v")[common.index(c)] if c in common else F.lit(0.0)).alias(f"f{names.index(c)}") for c in df.columns]
        return cut(made.select("row", *values, *floats))

    l, r = side(left), side(right)  # noqa: E741
    entropy = {}
    for i, _ in enumerate(common):
        bins = l.select(F.floor(F.col(f"f{i}") * 64).alias("b")).groupBy("b").count()
        total = bins.agg(F.sum("count")).first()[0] or 1
        entropy[i] = bins.agg(F.sum(-(F.col("count") / total) * F.log2(F.col("count") / total))).first()[0] or 0.0
    columns = []
    for i in sorted(entropy, key=lambda i: (entropy[i], i)):
        e = encoders[i]
        columns.append(StitchColumn(i, e.root.lo, e.root.hi, (e.scale if e.scaled else 1.0) if e.integral else None, e.sentinel))
    if not l.limit(1).count() and not r.limit(1).count():
        out = l.join(r.drop(*[c for c in r.columns if c in l.columns]), F.lit(False), "inner")
    else:
        out = stitch_rows(l, r, columns, StitchOwner.SHARED if shared else StitchOwner.LEFT)
    types = {f.name: f.dataType for f in [*right.schema, *left.schema]}
    return out.select(*[F.col(f"v{i}").cast(types[c]).alias(c) for i, c in enumerate(names)])
