"""Columns to doubles in [0, 1) and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut, numbered
from .intervals import Range, checked, hull, null_sentinel, snap
from .params import ColumnType, column_type

TOP = 0.9999
_EPOCH = "timestamp_ntz'1800-01-01 00:00:00'"


@dataclass
class Encoder:
    """What one column needs in either direction."""

    name: str
    kind: ColumnType
    stored: T.DataType
    low: float = 0.0
    high: float = 0.0
    precision: int = 0
    sentinel: float = 1.0
    root: Range | None = None
    value_safe: bool = False

    @property
    def scaled(self) -> bool:
        return self.kind is not ColumnType.BOOLEAN

    @property
    def scale(self) -> float:
        return TOP / (self.high - self.low) if self.high > self.low else 1.0

    @property
    def integral(self) -> bool:
        return self.kind in (ColumnType.BOOLEAN, ColumnType.INTEGER, ColumnType.STRING)

    def normalise(self, value: Column) -> Column:
        return value * self.scale - F.lit(self.low * self.scale) if self.scaled else value

    def restore(self, value: Column) -> Column:
        return (value + F.lit(self.low * self.scale)) / self.scale if self.scaled else value


def to_float(name: str, kind: ColumnType, precision: int = 0) -> Column:
    """The unscaled double of a column; of a string only its null-ness is known here."""
    c = F.col(f"`{name}`")
    if kind is ColumnType.BOOLEAN:
        return c.cast("double")
    if kind is ColumnType.INTEGER:
        return c.cast("double")
    if kind is ColumnType.REAL:
        value = c.cast("double")
        return F.when(F.isnan(value), None).otherwise(F.bround(value, precision))
    if kind is ColumnType.TIMESTAMP:
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, cast(`{name}` as timestamp_ntz)) / 1e6")
    raise TypeError(kind)


def precision_of(name: str) -> Column:
    """Decimals that a real column needs: trailing zeros don't count, exponents do."""
    digits = F.regexp_extract(F.expr(f"cast(try_cast(`{name}` as decimal(38,18)) as string)"), r"\.([0-9]*?)0*$", 1)
    return F.coalesce(F.max(F.length(digits)), F.lit(0))


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """(word, n): the distinct strings in order."""
    return cut(numbered(df.select(F.col(f"`{name}`").alias("word")).filter("word is not null").distinct(), "word"))


def fit(df: DataFrame, value_safe: list[bool] | None = None) -> tuple[list[Encoder], dict[str, DataFrame]]:
    """Encoders of all columns, by two aggregates, and the dictionaries of string columns."""
    encoders = [Encoder(f.name, column_type(f.dataType), f.dataType, value_safe=bool(value_safe and value_safe[i])) for i, f in enumerate(df.schema)]
    reals = [e for e in encoders if e.kind is ColumnType.REAL]
    if reals:
        row = df.agg(*[precision_of(e.name).alias(f"p{i}") for i, e in enumerate(reals)]).first()
        for i, e in enumerate(reals):
            e.precision = int(row[f"p{i}"])
    words = {e.name: dictionary(df, e.name) for e in encoders if e.kind is ColumnType.STRING}
    plain = [e for e in encoders if e.kind is not ColumnType.STRING]
    if plain:
        row = df.agg(*[f(to_float(e.name, e.kind, e.precision)).alias(f"{n}{i}") for i, e in enumerate(plain) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, e in enumerate(plain):
            e.low, e.high = (0.0, 0.0) if row[f"a{i}"] is None else (float(row[f"a{i}"]), float(row[f"b{i}"]))
            if row[f"a{i}"] is None:
                e.sentinel, e.root = 1.0, snap(Range(0.0, 1.0))
    for e in encoders:
        if e.kind is ColumnType.STRING:
            e.high = float(max(0, words[e.name].count() - 1))
        if e.root is None:
            ends = checked(e.low, e.high) if not e.scaled else Range(0.0, e.high * e.scale - e.low * e.scale if e.high > e.low else 0.0)
            e.sentinel = null_sentinel(ends)
            e.root = snap(hull(*ends, e.sentinel))
    return encoders, words


def encode(df: DataFrame, encoders: list[Encoder], words: dict[str, DataFrame], keep: list[str]) -> DataFrame:
    """keep, then v: array<double> of all encoded columns, nulls as their sentinels."""
    values = []
    for i, e in enumerate(encoders):
        if e.kind is ColumnType.STRING:
            own = words[e.name].select(F.col("word").alias(f"_w{i}"), F.col("n").cast("double").alias(f"_n{i}"))
            df = df.join(own, F.col(f"`{e.name}`") == F.col(f"_w{i}"), "left")
            value = F.col(f"_n{i}")
        else:
            value = to_float(e.name, e.kind, e.precision)
        value = e.normalise(value) if e.high > e.low or not e.scaled else F.when(value.isNotNull(), 0.0)
        values.append(F.coalesce(value, F.lit(e.sentinel)))
    return df.select(*keep, F.array(*values).alias("v"))

