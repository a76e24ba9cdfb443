import pytest
from pyspark.sql import functions as F

from veilgrid.functions.params import NOISELESS
from veilgrid.operators.nodes import TreeBuilder
from veilgrid.operators.stitch import StitchColumn, StitchOwner, patch, stitch_rows
from veilgrid.plans.clustering import NoClustering, SingleClustering
from veilgrid.plans.synthesizer import Synthesizer, stitch


@pytest.fixture(scope="module")
def trees(spark):
    df = spark.createDataFrame([(i % 8, float(i % 4), "cat_1" if i % 2 else "cat_2") for i in range(32)], "a long, b double, c string")
    return Synthesizer(df, anonymization_params=NOISELESS, salt=b"x", clustering=SingleClustering())


def test_noiseless_trees(trees):
    """Nodes, leaves, depth and leaf sizes that the rules give by hand."""
    trees.builder.build([(0, 1, 2)])
    want = {"0": (15, 8, 3, {4}), "1": (7, 4, 2, {8}), "2": (3, 2, 1, {16}), "0_1": (13, 8, 2, {4}), "0_1_2": (9, 8, 1, {4})}
    for k in (1, 2, 3):
        for r in trees.builder.levels[k].groupBy("combo").agg(F.count("*"), F.count_if(~F.col("split")), F.max("depth"), F.collect_set(F.when(~F.col("split"), F.col("n")))).collect():
            if r[0] in want:
                assert (r[1], r[2], r[3], set(r[4])) == want[r[0]]


def test_distributed_levels_give_the_same_trees(spark, trees, monkeypatch):
    import veilgrid.operators.nodes as nodes

    trees.builder.build([(0, 1)])
    key = ["combo", "depth", "cell", "n", "split", "is_stub", "noisy", "low", "amin"]
    local = {str(r) for r in trees.builder.levels[1].select(key).collect()}
    monkeypatch.setattr(nodes, "LOCAL_ROWS", 5)
    again = TreeBuilder(trees.encoded, trees.names, [e.root for e in trees.encoders], trees.params, trees.buckets, True)
    again.build([(0,), (1,), (2,)])
    assert {str(r) for r in again.levels[1].select(key).collect()} == local


def test_categories_without_noise_keep_their_counts(spark):
    df = spark.createDataFrame([("a", True)] * 20 + [("b", False)] * 15 + [("c", True)] * 10, "x string, y boolean")
    out = Synthesizer(df, anonymization_params=NOISELESS, salt=b"x", clustering=SingleClustering()).sample()
    assert sorted(map(tuple, out.groupBy("x", "y").count().collect())) == [("a", True, 20), ("b", False, 15), ("c", True, 10)]
    assert out.schema == df.schema


def test_few_entities_show_no_string(spark):
    df = spark.createDataFrame([(i % 20, f"secret{i % 20}") for i in range(200)], "pid long, s string")
    out = Synthesizer(df, ["pid"], salt=b"x", clustering=SingleClustering()).sample()
    assert not {r.s for r in out.collect()} & {f"secret{i}" for i in range(20)}


def test_nulls_and_types_survive(spark):
    rows = [(i % 5 if i % 3 else None, i / 10, None if i % 4 == 0 else f"t{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, r double, s string")
    out = Synthesizer(df, salt=b"x", clustering=NoClustering()).sample().toPandas()
    assert 40 < len(out) < 80 and out["i"].isna().any() and out["s"].isna().any() and out["r"].notna().all()
    with pytest.raises(TypeError):
        Synthesizer(spark.createDataFrame([([1],)], "a array<int>"), salt=b"x")


def test_stitch_owner_and_lengths(spark):
    made = lambda n, c: spark.createDataFrame([(i, i % 4, float(i % 4), i, float(i)) for i in range(n)], f"row long, v0 long, f0 double, v{c} long, f{c} double")
    on = [StitchColumn(0, 0.0, 4.0, 1.0, 3.0)]
    left = stitch_rows(made(40, 1), made(44, 2), on, StitchOwner.LEFT)
    assert left.count() == 40 and left.filter("v2 % 4 <> v0").count() == 0
    assert stitch_rows(made(40, 1), made(48, 2), on, StitchOwner.SHARED).count() == 44  # 10 and 12 rows in each of four cells
    with pytest.raises(ValueError):
        stitch_rows(made(4, 1), made(0, 2), on, StitchOwner.LEFT)
    dealt = patch(made(5, 1), made(3, 2).select("row", "v2", "f2"))
    assert dealt.count() == 5 and dealt.select("v2").distinct().count() == 3


def test_public_stitch(spark):
    left = spark.createDataFrame([(i % 3, f"l{i}") for i in range(30)], "k int, l string")
    right = spark.createDataFrame([(i % 3, f"r{i}") for i in range(30)], "k int, r string")
    out = stitch(left, right, shared=False)
    assert out.columns == ["k", "l", "r"] and out.count() == 30
    with pytest.raises(ValueError):
        stitch(left.select("l"), right)


def test_harvest_by_hand(spark):
    """One value; ranges of four; pairs refined from their columns' buckets."""
    from veilgrid.operators.harvest import harvest
    from veilgrid.operators.nodes import key_of

    def buckets(rows, schema, combo):
        s = Synthesizer(spark.createDataFrame(rows, schema), anonymization_params=NOISELESS, salt=b"x", clustering=SingleClustering())
        found = harvest(s.builder.family([combo]), b"x", set()).filter(F.col("goal") == key_of(combo)).collect()
        back = lambda x, i: round(float(s.encoders[i].low + x / s.encoders[i].scale), 6)
        return sorted((tuple((back(a, i), back(b, i)) for i, a, b in zip(combo, r.lo, r.hi)), r["count"]) for r in found)

    assert buckets([(1.0,)] * 12, "x double", (0,)) == [(((1.0, 1.0),), 12)]
    pairs = buckets([(float(i), float(j)) for i in range(12) for j in (1, 2, 3) for _ in range(5)], "x double, y double", (0, 1))
    assert sum(n for _, n in pairs) == 180 and all(lo == hi for r, _ in pairs for lo, hi in r)
    ranges = buckets([(float(i),) for i in range(12)], "x double", (0,))
    assert sum(n for _, n in ranges) == 12 and all(n >= 3 for _, n in ranges)
