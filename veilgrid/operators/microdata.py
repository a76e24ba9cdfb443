"""Rows from buckets: each bucket gives `count` rows, every value drawn from its range by a keyed hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import Encoder
from ..functions.params import ColumnType

_EPOCH = "timestamp_ntz'1800-01-01 00:00:00'"


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) that is a function of its keys: 53 bits of their hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def expand(buckets: DataFrame, combo: tuple[int, ...], seed: str) -> DataFrame:
    """(row, f0..): the encoded values of every row, f of column c named f<c>; lo and hi of each as a<c>, b<c>."""
    rows = buckets.select("bucket", "lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("i"))
    rows = rows.withColumn("row", F.xxhash64(F.lit(seed), "bucket", "i"))
    made = []
    for d, c in enumerate(combo):
        lo, hi = F.col("lo")[d], F.col("hi")[d]
        made += [lo.alias(f"a{c}"), hi.alias(f"b{c}"), (lo + (hi - lo) * uniform(F.lit(seed), F.col("bucket"), F.col("i"), F.lit(c))).alias(f"f{c}")]
    return rows.select("row", "bucket", "i", *made)


def _round(value: Column, precision: int) -> Column:
    return F.bround(value, precision)


def decode(rows: DataFrame, combo: tuple[int, ...], encoders: list[Encoder], words: dict[str, DataFrame], safe_words: dict[str, DataFrame], safe_values: dict[str, DataFrame]) -> DataFrame:
    """Adds v<c>, the typed value, for each column, and sets f<c> to the encoded value of what was drawn."""
    for c in combo:
        e = encoders[c]
        f, lo, hi = F.col(f"f{c}"), F.col(f"a{c}"), F.col(f"b{c}")
        null = lo == F.lit(e.sentinel)
        if e.kind is ColumnType.STRING:
            rows = _decode_string(rows, c, e, words[e.name], safe_words.get(e.name))
            value = F.col(f"w{c}")
        elif e.kind is ColumnType.BOOLEAN:
            value = f >= 0.5
        else:
            raw = e.restore(f)
            if e.name in safe_values:
                rows = nearest(rows.withColumn(f"r{c}", raw), f"r{c}", safe_values[e.name], f"s{c}")
                raw = F.col(f"s{c}")
            if e.kind is ColumnType.REAL:
                value = _round(raw, e.precision)
            elif e.kind is ColumnType.INTEGER:
                value = F.bround(raw, 0).cast("long")
            else:
                value = F.expr(f"timestampadd(SECOND, cast(bround(t{c}, 0) as bigint), {_EPOCH})")
                rows = rows.withColumn(f"t{c}", raw)
        rows = rows.withColumn(f"v{c}", F.when(~null, value).cast(e.stored if not isinstance(e.stored, T.DecimalType) else e.stored))
        rows = rows.drop(f"w{c}", f"r{c}", f"s{c}", f"t{c}")
    return rows


#: Cells of equal width that allowed values are put in, at most, and parts of a cell's rows.
CELLS, PARTS = 1 << 16, 16


def nearest(rows: DataFrame, value: str, safe: DataFrame, out: str) -> DataFrame:
    """rows with `out`, the allowed value (column x of safe) that is nearest to `value`, ties to the lower.

    Within a cell rows and allowed values are merged in order, each row between the last value before it and the first
    after it; values of other cells come from a table with at most CELLS rows.  Rows of a cell are dealt to PARTS, each of which gets the cell's values.
    """
    ends = safe.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("x").alias("n")).first()
    if not ends["n"]:
        return rows.withColumn(out, F.lit(None).cast("double"))
    m = min(CELLS, ends["n"])
    width = (ends["b"] - ends["a"]) / m or 1.0
    cell = lambda x: F.least(F.lit(m - 1), F.greatest(F.lit(0), F.floor((x - ends["a"]) / width))).cast("int")
    low, high = np.full(m, np.inf), np.full(m, -np.inf)
    for c, a, b in safe.groupBy(cell(F.col("x")).alias("c")).agg(F.min("x"), F.max("x")).collect():
        low[c], high[c] = a, b
    below, above = np.append(-np.inf, np.maximum.accumulate(high)[:-1]), np.append(np.minimum.accumulate(low[::-1])[::-1][1:], np.inf)
    beside = rows.sparkSession.createDataFrame(pd.DataFrame({"_cell": np.arange(m, dtype=np.int32), "_below": below, "_above": above}))
    own = rows.withColumns({"_cell": cell(F.col(value)), "_part": F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int"), "_at": F.col(value), "_x": F.lit(None).cast("double")})
    allowed = safe.select(cell(F.col("x")).alias("_cell"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"), F.col("x").alias("_at"), F.col("x").alias("_x"))
    merged = own.unionByName(allowed, allowMissingColumns=True)
    order = Window.partitionBy("_cell", "_part").orderBy("_at", F.col("_x").isNull())
    before = F.last("_x", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # in reverse, as a frame up to the end takes the square of a part's rows
    reverse = Window.partitionBy("_cell", "_part").orderBy(F.desc("_at"), F.col("_x").isNull().desc())
    after = F.last("_x", ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumns({"_before": before, "_after": after}).filter(F.col("_x").isNull()).join(F.broadcast(beside), "_cell", "left")
    lower, upper = F.greatest("_before", "_below"), F.least("_after", "_above")
    v = F.col(value)
    best = F.when(v.isNull(), None).when(upper - v < v - lower, upper).otherwise(F.when(lower == float("-inf"), upper).otherwise(lower))
    return found.withColumn(out, best).drop("_cell", "_part", "_at", "_x", "_before", "_after", "_below", "_above")


def _decode_string(rows: DataFrame, c: int, e: Encoder, words: DataFrame, safe: DataFrame | None) -> DataFrame:
    """w<c>: an exact string where the range is one string or the drawn one is safe, else what the range's strings begin with, "*" and the number."""
    lo, hi = F.col(f"a{c}"), F.col(f"b{c}")
    top = int(e.high)
    first = F.greatest(F.lit(0), F.least(F.lit(top), F.ceil(e.restore(lo) - 1e-10).cast("long")))
    last = F.greatest(F.lit(0), F.least(F.lit(top), (F.ceil(e.restore(hi) - 1e-10) - 1).cast("long")))
    single = lo == hi
    rows = rows.withColumn("_x", F.when(single, F.bround(e.restore(lo), 0).cast("long")).otherwise(first))
    rows = rows.withColumn("_y", F.greatest("_x", F.when(single, F.col("_x")).otherwise(last)))
    pick = F.col("_x") + F.floor(uniform(F.lit("word"), F.col("row"), F.lit(c)) * (F.col("_y") - F.col("_x") + 1)).cast("long")
    rows = rows.withColumn("_n", pick)
    for at, name in (("_x", "_first"), ("_y", "_last"), ("_n", "_word")):
        rows = rows.join(words.select(F.col("n").alias(at), F.col("word").alias(name)), at, "left")
    if safe is not None:
        rows = rows.join(safe.select(F.col("n").alias("_n"), F.lit(True).alias("_safe")), "_n", "left")
    else:
        rows = rows.withColumn("_safe", F.lit(False))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length("_first"), F.length("_last")), F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.struct((acc["n"] + F.when(acc["on"] & (F.substr("_first", i, F.lit(1)) == F.substr("_last", i, F.lit(1))) & (F.substr("_first", i, F.lit(1)) != ""), 1).otherwise(0)).alias("n"), (acc["on"] & (F.substr("_first", i, F.lit(1)) == F.substr("_last", i, F.lit(1)))).alias("on")),
        lambda acc: F.substr(F.col("_first"), F.lit(1), acc["n"]),
    )
    exact = single | (F.col("_x") == F.col("_y")) & (e.high == 0) | F.coalesce("_safe", F.lit(False)) | F.lit(e.value_safe)
    rows = rows.withColumn(f"w{c}", F.when(exact, F.col("_word")).otherwise(F.concat(shared, F.lit("*"), F.col("_n").cast("string"))))
    # the drawn string's own place on the encoded scale
    return rows.withColumn(f"f{c}", F.when(lo == F.lit(e.sentinel), F.col(f"f{c}")).otherwise(e.normalise(F.col("_n").cast("double")))).drop("_x", "_y", "_n", "_first", "_last", "_word", "_safe")
