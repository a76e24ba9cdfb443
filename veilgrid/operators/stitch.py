"""Stitching: two tables joined row by row along ranges of the columns they share.

Both sides are split together into cells, halving one stitch column at a time as long as both
halves hold about equally many rows of either side.  Cells are relabelled a level at a time; a
level is one aggregate over cells.  Within a cell the sides are aligned in length, sorted by the
stitch columns and zipped.  Numbering is by range sorts over all cells together, so a cell of any
size is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, numbered


class StitchOwner(Enum):
    """Whose rows count where both sides have a column."""

    LEFT = "left"
    RIGHT = "right"
    SHARED = "shared"

    def __repr__(self) -> str:
        return self.value


@dataclass(frozen=True)
class StitchColumn:
    """A shared column: f<id> holds its encoded value on both sides."""

    id: int
    lo: float
    hi: float
    unit: float | None = None  # of integral columns: the least size of a cell
    top: float = float("inf")  # its largest value


#: Sides whose sizes differ by more aren't split.
ALIKE = 0.7


def _alike(a: Column, b: Column) -> Column:
    return (F.least(a, b) > 0) & (F.least(a, b) >= ALIKE * F.greatest(a, b))


def assign_cells(rows: DataFrame, columns: list[StitchColumn]) -> DataFrame:
    """rows (side, row, s array<double>, ...) with the cell of each, which follows from s: equal ones of a side go through all levels as one."""
    n = len(columns)
    grouped = rows.groupBy("side", "s").agg(F.count("*").alias("_n"))
    lo, hi = (F.array(*[F.lit(float(getattr(c, x))) for c in columns]) for x in ("lo", "hi"))
    active = grouped.withColumns({"cell": F.lit(""), "_lo": lo, "_hi": hi, "_next": F.lit(0), "_left": F.lit(n)})
    units = F.array(*[F.lit(c.unit if c.unit is not None else 0.0) for c in columns])
    tops = F.array(*[F.lit(float(c.top)) for c in columns])
    done: list[DataFrame] = []
    keep = grouped.columns
    step = 0
    while True:
        value, a, b = F.get("s", F.col("_next")), F.get("_lo", F.col("_next")), F.get("_hi", F.col("_next"))
        mid = a + (b - a) / 2
        left = F.col("side") == 0
        cells = active.groupBy("cell").agg(
            *[F.first(c).alias(c) for c in ("_lo", "_hi", "_next", "_left")],
            *[F.sum(F.when(side & half, F.col("_n")).otherwise(0)).alias(name) for name, side, half in (("ll", left, value < mid), ("lu", left, value >= mid), ("rl", ~left, value < mid), ("ru", ~left, value >= mid))],
        )
        size, unit = b - a, F.get(units, F.col("_next"))
        over = (F.col("_left") == 0) | (F.col("ll") + F.col("lu") <= 1) | (F.col("rl") + F.col("ru") <= 1)
        may = (unit == 0) | F.when(F.get(tops, F.col("_next")) == b, size >= unit).otherwise(size > unit)
        split = ~over & may & _alike(F.col("ll"), F.col("rl")) & _alike(F.col("lu"), F.col("ru"))
        put = lambda c, x: F.transform(F.col(c), lambda v, i: F.when(i == F.col("_next"), x).otherwise(v))
        no_lower, no_upper = may & ~over & (F.col("ll") + F.col("rl") == 0), may & ~over & (F.col("lu") + F.col("ru") == 0)
        verdict = cut(cells.select("cell", over.alias("_over"), split.alias("_split"), mid.alias("_mid"), no_lower.alias("_nl"), no_upper.alias("_nu")))
        if step and not verdict.limit(1).count():
            break
        on = active.join(verdict, "cell")
        done.append(on.filter("_over").select(*keep, "cell"))
        on = on.filter("not _over")
        upper = value >= F.col("_mid")
        on = on.select(
            *keep,
            F.when(F.col("_split"), F.concat("cell", F.when(upper, "1").otherwise("0"))).otherwise(F.col("cell")).alias("cell"),
            F.when(F.col("_split") & upper | ~F.col("_split") & F.col("_nl"), put("_lo", F.col("_mid"))).otherwise(F.col("_lo")).alias("_lo"),
            F.when(F.col("_split") & ~upper | ~F.col("_split") & F.col("_nu") & ~F.col("_nl"), put("_hi", F.col("_mid"))).otherwise(F.col("_hi")).alias("_hi"),
            ((F.col("_next") + 1) % n).alias("_next"),
            F.when(F.col("_split"), F.lit(n)).otherwise(F.col("_left") - 1).alias("_left"),
        )
        active = cut(on)
        step += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return cut(rows.join(cut(out.drop("_n")), ["side", "s"]).select(*rows.columns, "cell"))


def _rank(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The place of each row within its cell and side."""
    at = numbered(rows, "side", "cell", *order)
    first = at.groupBy("side", "cell").agg(F.min("n").alias("_first"))
    return at.join(first, ["side", "cell"]).withColumn(name, F.col("n") - F.col("_first")).drop("n", "_first")


def zip_cells(rows: DataFrame, owner: StitchOwner) -> DataFrame:
    """(cell, rank, l, r): rows of both sides, aligned in length, by their order along the stitch columns."""
    sizes = rows.groupBy("cell").agg(F.count_if(F.col("side") == 0).alias("nl"), F.count_if(F.col("side") == 1).alias("nr"))
    want = {StitchOwner.LEFT: F.col("nl"), StitchOwner.RIGHT: F.col("nr"), StitchOwner.SHARED: F.bround((F.col("nl") + F.col("nr")) / 2, 0).cast("long")}[owner]
    sizes = cut(sizes.filter("nl > 0 and nr > 0").withColumn("want", want))
    shuffled = _rank(rows.withColumn("_h", F.xxhash64("side", "row")), "r", "_h", "row").drop("_h").join(sizes, "cell")
    have = F.when(F.col("side") == 0, F.col("nl")).otherwise(F.col("nr"))
    kept = shuffled.filter(F.col("r") < F.col("want"))
    both = sizes.select("cell", "want", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("nl").alias("have")), F.struct(F.lit(1).alias("side"), F.col("nr").alias("have")))).alias("e")).select("cell", "want", "e.*")
    extra = both.filter("want > have").select("cell", "side", F.explode(F.expr("sequence(have, want - 1)")).alias("i"), "have")
    extra = extra.select("cell", "side", F.pmod(F.xxhash64("cell", "side", "i"), F.col("have")).alias("r"), F.col("i").alias("_i"))
    again = shuffled.join(extra, ["cell", "side", "r"]).withColumn("row", F.xxhash64("row", "_i")).drop("_i")
    every = kept.unionByName(again.select(*kept.columns))
    ranked = _rank(every, "rank", "s", "row")
    l = ranked.filter("side = 0").select("cell", "rank", F.col("data").alias("l"))  # noqa: E741
    return l.join(ranked.filter("side = 1").select("cell", "rank", F.col("data").alias("r")), ["cell", "rank"])


def _sided(df: DataFrame, side: int, columns: list[StitchColumn]) -> DataFrame:
    values = F.array(*[F.col(f"f{c.id}") for c in columns]) if columns else F.array().cast("array<double>")
    return df.select(F.lit(side).alias("side"), F.col("row").alias("row"), values.alias("s"), F.struct(*[c for c in df.columns if c[0] in "vf" and c[1:].isdigit()]).alias("data"))


def stitch_rows(left: DataFrame, right: DataFrame, columns: list[StitchColumn], owner: StitchOwner) -> DataFrame:
    """Two row tables (row, v<c>, f<c>) made one.  Without stitch columns the right one is dealt to the left one's rows."""
    ids = lambda df: [int(c[1:]) for c in df.columns if c[0] == "v" and c[1:].isdigit()]
    of_left, of_right = ids(left), ids(right)
    if not columns:
        return patch(left, right)
    l, r = _sided(left, 0, columns), _sided(right, 1, columns)  # noqa: E741
    any_left, any_right = l.limit(1).count(), r.limit(1).count()
    if any_left and not any_right:
        raise ValueError("the right side of a stitch has no rows")
    # the structs differ between the sides, so cells are assigned on keys and joined back
    keys = l.select("side", "row", "s").unionByName(r.select("side", "row", "s"))
    cells = assign_cells(keys, columns)
    wide = F.struct(*[F.col(f"l.{x}{c}").alias(f"{x}{c}") for c in of_left for x in "vf"])
    zipped = zip_cells(cells.withColumn("data", F.struct("side", "row")), owner)
    base = zipped.select("cell", "rank", F.coalesce(F.col("l.row")).alias("_l"), F.col("r.row").alias("_r"))
    # repeated rows keep the number of the row they repeat in `data`
    out = base.join(l.select(F.col("row").alias("_l"), F.col("data").alias("l")), "_l").join(r.select(F.col("row").alias("_r"), F.col("data").alias("r")), "_r")
    del wide
    pick_left = F.lit(owner is StitchOwner.LEFT) if owner is not StitchOwner.SHARED else F.col("rank") % 2 == 0
    made = []
    for c in sorted({*of_left, *of_right}):
        for x in "vf":
            if c in of_left and c in of_right:
                value = F.when(pick_left, F.col(f"l.{x}{c}")).otherwise(F.col(f"r.{x}{c}"))
            else:
                value = F.col(f"l.{x}{c}") if c in of_left else F.col(f"r.{x}{c}")
            made.append(value.alias(f"{x}{c}"))
    return cut(out.select(F.xxhash64("cell", "rank", "_l", "_r").alias("row"), *made))


def patch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left's rows with the columns of right's in hashed order, as often over as needed."""
    new = [c for c in right.columns if c[0] in "vf" and c[1:].isdigit() and c not in left.columns]
    n = right.count()
    if not n:
        if left.limit(1).count():
            raise ValueError("the right side of a patch has no rows")
        return left.join(right.select(*new), F.lit(False), "inner")
    l = numbered(left.withColumn("_h", F.xxhash64("row")), "_h", "row").drop("_h")  # noqa: E741
    r = numbered(right.select("row", *new).withColumn("_h", F.xxhash64("row", F.lit(1))), "_h", "row").select(F.col("n").alias("_at"), *new)
    return cut(l.withColumn("_at", F.when(F.col("n") < n, F.col("n")).otherwise(F.pmod(F.xxhash64("n"), F.lit(n)))).join(r, "_at").drop("_at", "n"))
