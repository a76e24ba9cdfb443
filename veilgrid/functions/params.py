"""Parameters, column types and argument checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class ColumnType(Enum):
    BOOLEAN = "boolean"
    INTEGER = "integer"
    REAL = "real"
    STRING = "string"
    TIMESTAMP = "timestamp"


@dataclass(frozen=True)
class FlatteningInterval:
    lower: int = 2
    upper: int = 5


@dataclass(frozen=True)
class SuppressionParams:
    low_threshold: int = 3
    layer_sd: float = 1.0
    low_mean_gap: float = 2.0


@dataclass(frozen=True)
class BucketizationParams:
    singularity_low_threshold: int = 5
    range_low_threshold: int = 15
    precision_limit_row_fraction: int = 10000
    precision_limit_depth_threshold: int = 15


@dataclass(frozen=True)
class AnonymizationParams:
    salt: bytes = b""
    low_count_params: SuppressionParams = field(default_factory=SuppressionParams)
    outlier_count: FlatteningInterval = field(default_factory=FlatteningInterval)
    top_count: FlatteningInterval = field(default_factory=FlatteningInterval)
    layer_noise_sd: float = 1.0


#: No noise anywhere: what SQL can state exactly.
NOISELESS = AnonymizationParams(
    low_count_params=SuppressionParams(layer_sd=0.0), outlier_count=FlatteningInterval(2, 2), top_count=FlatteningInterval(2, 2), layer_noise_sd=0.0
)


def column_type(kind: T.DataType) -> ColumnType:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ColumnType.INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return ColumnType.REAL
    if isinstance(kind, T.BooleanType):
        return ColumnType.BOOLEAN
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return ColumnType.TIMESTAMP
    if isinstance(kind, T.StringType):
        return ColumnType.STRING
    raise TypeError(f"columns of type {kind.simpleString()} can't be synthesized")


def column_positions(names: Sequence[str], wanted: int | str | Sequence[int | str]) -> list[int]:
    """Positions of columns given by name or number, but not both in one list."""
    if isinstance(wanted, (int, str)) and not isinstance(wanted, bool):
        wanted = [wanted]
    if not isinstance(wanted, (list, tuple)):
        raise TypeError("columns are named by a string, a number or a list of either")
    if all(isinstance(x, str) for x in wanted):
        if missing := [x for x in wanted if x not in names]:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        return [list(names).index(x) for x in wanted]
    if all(isinstance(x, int) and not isinstance(x, bool) for x in wanted):
        if missing := [x for x in wanted if not 0 <= x < len(names)]:
            raise ValueError(f"no such column numbers: {missing}")
        return list(wanted)
    raise TypeError("a list of columns holds names or numbers, not both")
