"""Sticky noise and anonymized counts: every draw is a function of a salt and of what is counted.

Hashes are unsigned 64-bit numbers in Python and the same bits as signed longs in Spark.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import xor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .params import AnonymizationParams, FlatteningInterval, SuppressionParams

_ALL = (1 << 64) - 1


def hash_bytes(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")


def hash_string(s: str) -> int:
    return hash_bytes(s.encode())


def hash_int(i: int) -> int:
    return hash_bytes((int(i) & _ALL).to_bytes(8, "little"))


def hash_pid(pid: object) -> int:
    """0 for a missing id (None, 0 and the empty string); others must be integers or strings."""
    if pid is None or pid == 0 or pid == "" or pid != pid:
        return 0
    if isinstance(pid, str):
        return hash_string(pid)
    if isinstance(pid, bool) or not hasattr(pid, "__index__"):
        raise NotImplementedError(f"ids of type {type(pid).__name__}")
    return hash_int(int(pid))


def hash_strings(strings: Iterable[str]) -> int:
    return xor_all(map(hash_string, set(strings)))


def xor_all(hashes: Iterable[int]) -> int:
    return reduce(xor, hashes, 0)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def unsigned(h: int) -> int:
    return int(h) & _ALL


@F.pandas_udf(T.LongType())
def hashed_ids(ids: pd.Series) -> pd.Series:
    """hash_pid of each id, null where it is missing; a batch's distinct ids are hashed once."""
    code, distinct = pd.factorize(ids)  # code -1: null
    hashes = [hash_pid(int(x) if isinstance(x, float) else x) for x in distinct]
    table = pd.array([None if h == 0 else signed(h) for h in hashes] + [None], dtype="Int64")
    return pd.Series(table[code])


@F.pandas_udf(T.LongType())
def hashed_labels(middles: pd.Series) -> pd.Series:
    """hash_strings of the numbers' texts, a node in a row."""
    known: dict[str, int] = {}

    def of(text: str) -> int:
        if text not in known:
            known[text] = hash_string(text)
        return known[text]

    return pd.Series([signed(xor_all(of(x) for x in {str(float(m)) for m in row})) for row in middles], dtype="Int64")


def salted(salt: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(salt + seed.to_bytes(8, "little")).digest()[:8], "little")


def step_seed(step: str, seed: int) -> int:
    return hash_string(step) ^ seed


def uniform_int(interval: FlatteningInterval, seed: int) -> int:
    return seed % (interval.upper - interval.lower + 1) + interval.lower


def normal(sd: float, seed: int) -> float:
    u1 = max((seed & 0x7FFFFFFF) / 0x7FFFFFFF, sys.float_info.epsilon)
    u2 = (seed >> 32 & 0x7FFFFFFF) / 0x7FFFFFFF
    return sd * math.sqrt(-2 * math.log(u1)) * math.sin(2 * math.pi * u2)


def noise(salt: bytes, step: str, sd: float, layers: Sequence[int]) -> float:
    return sum(normal(sd, step_seed(step, salted(salt, x))) for x in layers) if sd else 0.0


def is_low_count(salt: bytes, params: SuppressionParams, kinds: Sequence[tuple[int, int]]) -> bool:
    """kinds: (entities, xor of their hashes) for each kind of protected entity; one that is low is enough."""
    mean = params.low_threshold + params.low_mean_gap * params.layer_sd
    return any(n < params.low_threshold or n < noise(salt, "suppress", params.layer_sd, [seed]) + mean for n, seed in kinds)


def noisy_row_limit(salt: bytes, seed: int, rows: int, fraction: int) -> int:
    limit = rows // fraction
    spread = limit // 20
    return limit + uniform_int(FlatteningInterval(-spread, spread), step_seed("precision_limit", salted(salt, seed)))


def count_rows(params: AnonymizationParams, bucket_seed: int, kinds: Sequence[tuple[int, int, int, int, Sequence[int], Sequence[int]]]) -> int:
    """noisy_rows of flat_kinds, for a node at hand; 0 if any kind has too few entities.  kinds: entities, rows, unaccounted, seed, and the counts and signed ids of the largest contributions."""
    outlier, top, salt = params.outlier_count, params.top_count, params.salt
    most, loud = None, None
    for entities, rows, unaccounted, seed, counts, ids in kinds:
        if entities < outlier.lower + top.lower:
            return 0
        over = max(outlier.upper + top.upper - entities, 0)
        spared = min(outlier.upper - outlier.lower, max(over // 2, over - (top.upper - top.lower)))
        o, t = outlier.upper - spared, top.upper - over + spared
        s = salted(salt, xor_all(map(unsigned, ids[: o + t])))
        o = uniform_int(FlatteningInterval(outlier.lower, o), step_seed("outlier", s))
        t = uniform_int(FlatteningInterval(top.lower, t), step_seed("top", s))
        mean = sum(counts[o : o + t]) / t
        off = 0.0
        for n in counts[:o]:
            off += max(n - mean, 0.0)
        flat = rows - off
        sd = params.layer_noise_sd * max(flat / entities, 0.5 * mean)
        draw = noise(salt, "noise", sd, [bucket_seed, seed]) if params.layer_noise_sd else 0.0
        this, that = (off, flat + max(unaccounted - off, 0.0)), (sd, abs(draw), draw)
        most, loud = max(most or this, this), max(loud or that, that)
    return round(most[1] + loud[2])


# the same on columns, for plans that stay in the JVM


def seed_bytes(seed: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(seed, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)]))


def salted_column(salt: bytes, seed: Column) -> Column:
    digest = F.substring(F.sha2(F.concat(F.lit(salt), seed_bytes(seed)), 256), 1, 16)
    ordered = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(ordered, 16, -10).cast("long")


def normal_column(sd: Column | float, seed: Column) -> Column:
    u1 = F.greatest(seed.bitwiseAND(0x7FFFFFFF) / F.lit(float(0x7FFFFFFF)), F.lit(sys.float_info.epsilon))
    u2 = F.shiftrightunsigned(seed, 32).bitwiseAND(0x7FFFFFFF) / F.lit(float(0x7FFFFFFF))
    return sd * F.sqrt(-2 * F.log(u1)) * F.sin(2 * math.pi * u2)


def noise_column(salt: bytes, step: str, sd: Column | float, layers: Sequence[Column]) -> Column:
    seeds = [salted_column(salt, x).bitwiseXOR(F.lit(signed(hash_string(step)))) for x in layers]
    return sum((normal_column(sd, s) for s in seeds), F.lit(0.0))


def low_count_column(salt: bytes, params: SuppressionParams, count: Column, seed: Column, threshold: Column | int | None = None) -> Column:
    """Whether a kind's entities are too few; threshold: another one than the parameters'."""
    least = params.low_threshold if threshold is None else threshold
    mean = least + params.low_mean_gap * params.layer_sd
    draw = noise_column(salt, "suppress", params.layer_sd, [seed]) if params.layer_sd else F.lit(0.0)
    return (count < least) | (count < draw + mean)


def any_low(kinds: Column | str, salt: bytes, params: SuppressionParams, threshold: Column | int | None = None) -> Column:
    """Whether any kind (entities, seed) is low."""
    return F.exists(kinds, lambda x: low_count_column(salt, params, x["entities"], x["seed"], threshold))


def uniform_column(lower: Column | int, upper: Column | int, seed: Column) -> Column:
    """An integer from lower to upper, by the seed as an unsigned number."""
    size = (F.lit(upper) if isinstance(upper, int) else upper) - lower + 1
    whole = F.pmod(2 * (F.pmod(F.lit((1 << 63) - 1), size) + 1), size)  # 2**64 in these residues
    return F.pmod(F.pmod(seed, size) + F.when(seed < 0, whole).otherwise(0), size) + lower


def step_column(salt: bytes, step: str, seed: Column) -> Column:
    return salted_column(salt, seed).bitwiseXOR(F.lit(signed(hash_string(step))))


#: What is kept of one kind of entities in a group: how many, rows that have one, rows that have none, xor of hashes, largest contributions.
KIND = "struct<entities:bigint,rows:bigint,unaccounted:bigint,seed:bigint,largest:array<struct<n:bigint,h:bigint>>>"


def largest_kept(params: AnonymizationParams) -> int:
    """Contributions of a group that flattening can look at."""
    return params.outlier_count.upper + params.top_count.upper


def flat_kinds(kinds: Column | str, params: AnonymizationParams, bucket_seed: Column) -> Column:
    """For each kind (see KIND) the rows when the largest contributions are brought down to the mean of the next ones, what that takes off, and noise in proportion; null where entities are too few.

    Each step is a transform of its own, so that no draw is made twice.
    """
    outlier, top, salt = params.outlier_count, params.top_count, params.salt
    spare_outlier, spare_top = outlier.upper - outlier.lower, top.upper - top.lower

    def ranges(x: Column) -> Column:
        """The upper ends of both ranges; what the group lacks is taken off in halves, or off the one that has room."""
        over = F.greatest(outlier.upper + top.upper - x["entities"], F.lit(0))
        off = F.least(F.lit(spare_outlier), F.greatest(F.floor(over / 2), over - spare_top)).cast("int")
        return F.struct(x.alias("x"), (F.lit(outlier.upper) - off).cast("int").alias("o"), (F.lit(top.upper) - over.cast("int") + off).cast("int").alias("t"))

    def sizes(y: Column) -> Column:
        group = F.aggregate(F.slice(y["x"]["largest"], F.lit(1), y["o"] + y["t"]), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(c["h"]))
        return F.struct(y["x"].alias("x"), y["o"].alias("o"), y["t"].alias("t"), salted_column(salt, group).alias("s"))

    def drawn(y: Column) -> Column:
        draw = lambda lower, upper, step: uniform_column(lower, upper, y["s"].bitwiseXOR(F.lit(signed(hash_string(step))))).cast("int")
        return F.struct(y["x"].alias("x"), draw(outlier.lower, y["o"], "outlier").alias("o"), draw(top.lower, y["t"], "top").alias("t"))

    total = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, c: acc + c)
    counts = lambda part: F.transform(part, lambda c: c["n"].cast("double"))

    def level(y: Column) -> Column:
        return F.struct(y["x"].alias("x"), counts(F.slice(y["x"]["largest"], F.lit(1), y["o"])).alias("peaks"), (total(counts(F.slice(y["x"]["largest"], y["o"] + 1, y["t"]))) / y["t"]).alias("mean"))

    def flattened(y: Column) -> Column:
        return F.struct(y["x"].alias("x"), y["mean"].alias("mean"), total(F.transform(y["peaks"], lambda n: F.greatest(n - y["mean"], F.lit(0.0)))).alias("off"))

    def noised(y: Column) -> Column:
        flat = y["x"]["rows"] - y["off"]
        sd = params.layer_noise_sd * F.greatest(flat / y["x"]["entities"], 0.5 * y["mean"])
        return F.struct((flat + F.greatest(y["x"]["unaccounted"] - y["off"], F.lit(0.0))).alias("count"), y["off"].alias("flattening"), sd.alias("sd"), y["x"]["seed"].alias("seed"))

    def done(y: Column) -> Column:
        draw = noise_column(salt, "noise", y["sd"], [bucket_seed, y["seed"]]) if params.layer_noise_sd else F.lit(0.0)
        return F.struct(y["count"].alias("count"), y["flattening"].alias("flattening"), y["sd"].alias("sd"), draw.alias("noise"))

    def each(xs: Column, step) -> Column:
        return F.transform(xs, lambda y: F.when(y.isNotNull(), step(y)))

    enough = F.transform(kinds, lambda x: F.when(x["entities"] >= outlier.lower + top.lower, x))
    return reduce(each, (ranges, sizes, drawn, level, flattened, noised, done), enough)


def noisy_rows(flat: Column) -> Column:
    """Rows by the kind that loses most, with the loudest kind's noise; null if any kind has too few entities.  flat: of flat_kinds."""
    most = F.array_max(F.transform(flat, lambda x: F.struct(x["flattening"].alias("a"), x["count"].alias("b"))))["b"]
    loud = F.array_max(F.transform(flat, lambda x: F.struct(x["sd"].alias("a"), F.abs(x["noise"]).alias("b"), x["noise"].alias("c"))))["c"]
    return F.when(~F.exists(flat, lambda x: x.isNull()), F.bround(most + loud, 0).cast("long"))


def noisy_entities(params: AnonymizationParams, bucket_seed: Column, entities: Column, seed: Column) -> Column:
    """The count where every row is an entity of its own."""
    draw = noise_column(params.salt, "noise", params.layer_noise_sd, [bucket_seed, seed]) if params.layer_noise_sd else F.lit(0.0)
    return F.bround(entities + draw, 0).cast("long")


def money_round(value: Column) -> Column:
    """To the nearest of 1, 2, 5 and 10 times a power of ten, by the middles 1.5, 3.5 and 7.5."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    steps = sum((F.when(value >= unit * above, more).otherwise(0) for above, more in ((1.5, 1), (3.5, 3), (7.5, 5))), F.lit(1))
    return F.when(value < 1e-10, 0.0).otherwise(unit * steps)


def reported_sd(flat: Column) -> Column:
    """The loudest noise that was added, rounded up to a multiple of a round number near a twentieth of it."""
    sd = F.array_max(F.transform(flat, lambda x: x["sd"]))
    unit = money_round(sd * 0.05)
    return F.when(sd == 0, 0.0).otherwise(F.ceil(sd / unit) * unit)
