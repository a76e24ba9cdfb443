"""Trees from packed blocks."""

import pytest
from pyspark.sql import functions as F

from veilgrid.functions.noise import largest_kept
from veilgrid.operators import nodes
from veilgrid.operators.nodes import Grid, TreeBuilder, node_statistics
from veilgrid.plans.clustering import SingleClustering
from veilgrid.plans.synthesizer import Synthesizer


def _table(spark):
    return spark.range(400).select(F.when(F.col("id") % 7 != 0, F.col("id") % 90 + 1).alias("who"), (F.col("id") * 37 % 50).alias("x"), (F.col("id") % 3).alias("y"))


def test_ids_beside_missing_ones_are_whole(spark):
    """A tree that is finished in one task is that of SQL's statistics, where some rows have no id."""
    s = Synthesizer(_table(spark), ["who"], salt=b"s", clustering=SingleClustering())
    rows = s.encoded.select("pids", F.lit("0").alias("combo"), F.array(F.lit(0).cast("long")).alias("cell"), F.array(F.col("v")[0]).alias("x"), F.array(F.lit(0.0)).alias("lo"), F.array(F.lit(1.0)).alias("hi"), F.lit(False).alias("outlier"))
    said = node_statistics(rows, 1, largest_kept(s.params), False)
    b = s.builder
    rules = b._rules([(0,)])
    want = rules.judge(said.withColumns({"depth": F.lit(0), "is_stub": F.lit(False)}).withColumn("split", rules.split()), 1).first()
    got = b.nodes((0,)).filter("depth = 0").first()
    assert b.roots[0] == (0.0, 1.0)
    assert [got[c] for c in ("n", "low", "split", "noisy", "amin", "amax")] == [want[c] for c in ("n", "low", "split", "noisy", "amin", "amax")]


@pytest.mark.parametrize("ids", [["who"], None])
def test_passes_over_blocks_give_the_trees_of_one_task(spark, monkeypatch, ids):
    s = Synthesizer(_table(spark), ids, salt=b"s", clustering=SingleClustering())
    columns = ["combo", "depth", "cell", "lo", "hi", "amin", "amax", "n", "low", "is_stub", "split", "noisy", "half_low"]
    combo = tuple(range(len(s.names)))
    tree = lambda b: sorted(tuple(map(str, r)) for r in b.nodes(combo).select(*columns).collect())
    whole = tree(s.builder)
    monkeypatch.setattr(nodes, "LOCAL_ROWS", 20)
    monkeypatch.setattr(nodes, "BLOCK", 64)
    monkeypatch.setattr(nodes, "AHEAD", 4)
    again = TreeBuilder(s.encoded, s.names, [e.root for e in s.encoders], s.params, s.buckets, s.unique)
    assert tree(again) == whole


def test_equal_rows_are_packed_once(spark):
    s = Synthesizer(_table(spark).select("y"), salt=b"s", clustering=SingleClustering())
    assert (s.builder.total, s.builder.size) == (400, 3)


def test_outliers_follow_the_ends(spark):
    import numpy as np

    from veilgrid.functions.intervals import Range

    grid = Grid((0,), [Range(0.0, 1.0)], [(0.3, 0.6)])
    u, top, outlier = grid.place(np.array([[-5.0], [0.4], [7.0]]))
    assert u[:, 0].tolist() == [0.3, 0.4, 0.6] and not top.any() and outlier.tolist() == [True, False, True]


def test_rows_counted_at_hand_are_those_of_columns(spark):
    from veilgrid.functions.noise import KIND, count_rows, flat_kinds, hash_int, noisy_rows, signed, unsigned
    from veilgrid.functions.params import NOISELESS, AnonymizationParams

    made = []
    for g in range(1, 40):
        largest = sorted(((hash_int(g * 100 + i) % (g + 3) + 1, signed(hash_int(g * 100 + i))) for i in range(g)), reverse=True)
        made.append([(g, sum(n for n, _ in largest), g % 5, signed(hash_int(g)), largest[:10])] * (1 + g % 2))
    for params in (NOISELESS, AnonymizationParams(salt=b"s")):
        df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], f"i int, kinds array<{KIND}>")
        want = [r[0] or 0 for r in df.select("i", noisy_rows(flat_kinds("kinds", params, F.lit(77).cast("long"))).alias("n")).orderBy("i").select("n").collect()]
        assert [count_rows(params, 77, [(e, r, u, unsigned(s), [n for n, _ in top], [h for _, h in top]) for e, r, u, s, top in m]) for m in made] == want


def test_equal_keys_stitch_as_one_and_stay_whole(spark):
    from veilgrid.operators.stitch import StitchColumn, assign_cells

    rows = spark.range(64).select((F.col("id") % 2).cast("int").alias("side"), F.col("id").alias("row"), F.array((F.col("id") % 8 / 8).cast("double")).alias("s"))
    got = assign_cells(rows, [StitchColumn(0, 0.0, 1.0)])
    assert got.count() == 64 and got.groupBy("s").agg(F.countDistinct("cell").alias("n")).filter("n > 1").count() == 0


def test_nearest_has_no_frame_up_to_the_end(spark):
    from veilgrid.operators.microdata import nearest

    values = spark.range(40).select((F.col("id") * 1.5).alias("v"))
    safe = spark.range(5).select((F.col("id") * 10.0).alias("x"))
    out = nearest(values, "v", safe, "w")
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    rows = out.collect()
    assert len(rows) == 40 and all(r["w"] == min((abs(r["v"] - x), x) for x in (0.0, 10.0, 20.0, 30.0, 40.0))[1] for r in rows)
