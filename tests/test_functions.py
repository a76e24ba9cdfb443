import math
import random

import pytest

from veilgrid.functions.intervals import Range, checked, holds, hull, in_upper_half, inside, midpoint, null_sentinel, overlap, snap
from veilgrid.functions.noise import KIND, flat_kinds, hash_pid, hash_string, hash_strings, hashed_ids, hashed_labels, is_low_count, money_round, noise, noisy_entities, noisy_row_limit, noisy_rows, reported_sd, salted, signed, uniform_column, uniform_int, unsigned, xor_all
from veilgrid.functions.params import NOISELESS, AnonymizationParams, FlatteningInterval, SuppressionParams, column_positions


@pytest.mark.parametrize("raw", [(0, 1), (1, 2), (0, 0), (-3, 5), (0.3, 0.9), (10, 200), (-1e-3, 1e-3), (1.5, 1.5), (7, 9)])
def test_snapped_ranges_hold_theirs_on_the_grid(raw):
    lo, hi = snap(Range(*raw))
    assert lo <= raw[0] and raw[1] <= hi
    assert math.frexp(hi - lo)[0] == 0.5
    assert (lo / ((hi - lo) / 2)).is_integer()
    half = (hi - lo) / 2
    assert raw[0] == raw[1] or math.floor(raw[0] / (half / 2)) * (half / 2) + half < raw[1]


def test_range_algebra(spark):
    assert (midpoint(0, 4), Range(0, 4).half(True), Range(0, 4).half(False), hull(3, 1, 2)) == (2, (2, 4), (0, 2), (1, 3))
    with pytest.raises(ValueError):
        checked(2, 1)
    from pyspark.sql import functions as F

    rows = [(0.0, 4.0, 0.0, 1.0, 4.0), (0.0, 4.0, 4.0, 3.0, 5.0), (0.0, 4.0, 1.9, 4.0, 5.0), (4.0, 4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 2.0, 0.0, 4.0), (0.0, 4.0, None, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "lo double, hi double, v double, a double, b double")
    lo, hi, v, a, b = (F.col(c) for c in df.columns)
    got = [tuple(r) for r in df.select(F.coalesce(in_upper_half(v, lo, hi), F.lit(False)), F.coalesce(holds(lo, hi, v), F.lit(False)), inside(a, b, lo, hi), overlap(lo, hi, a, b)).collect()]
    assert got == [(False, True, True, True), (True, False, False, True), (False, True, False, False), (False, True, False, False), (True, True, True, True), (False, False, False, False)]


def test_null_sentinels_are_outside():
    assert (null_sentinel(Range(-2, 6)), null_sentinel(Range(-2, 0)), null_sentinel(Range(0, 0))) == (12, -4, 1.0)


def test_id_hashes_are_fixed():
    assert [hash_pid(x) for x in ("a", None, 1, "", 0)] == [3405396810240292928, 0, 18232024504446223411, 0, 0]
    assert hash_strings(["x", "y", "x"]) == hash_strings(["y", "x"])
    with pytest.raises(NotImplementedError):
        hash_pid(1.5)


def test_low_counts():
    sharp = SuppressionParams(layer_sd=0.0)
    assert is_low_count(b"", sharp, [(2, 7)]) and not is_low_count(b"", sharp, [(3, 7)])
    assert is_low_count(b"", sharp, [(9, 7), (2, 7)])
    noisy = SuppressionParams(3, 1.0, 2.0)
    shares = sum(is_low_count(b"s", noisy, [(5, random.Random(i).getrandbits(64))]) for i in range(2000)) / 2000
    assert 0.45 < shares < 0.55  # five is the mean of the threshold


def flattened(spark, params, *groups):
    """(rows, flattening of each kind, reported noise) of groups of kinds, each kind ({entity: rows}, rows without one)."""
    from pyspark.sql import functions as F

    def kind(counts, none=0):
        largest = sorted(((n, h) for h, n in counts.items()), reverse=True)
        return (len(counts), sum(counts.values()), none, signed(xor_all(counts)), [(n, signed(h)) for n, h in largest])

    rows = [(i, [kind(*k) for k in g]) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, f"g long, kinds array<{KIND}>").withColumn("flat", flat_kinds("kinds", params, F.lit(7).cast("long")))
    got = df.select("g", noisy_rows(F.col("flat")), F.transform("flat", lambda x: x["flattening"]), reported_sd(F.col("flat"))).orderBy("g").collect()
    return [tuple(r)[1:] for r in got]


def test_flattened_counts(spark):
    ones = {i: 1 for i in range(1, 11)}
    peaks = {1: 9, 2: 5, 3: 2, 4: 2, 5: 1}
    got = flattened(spark, NOISELESS, [(ones,)], [(peaks,)], [({1: 1, 2: 1},)], [({i: 1 for i in range(1, 6)}, 3)], [(peaks, 12)], [(ones,), (peaks,)], [(ones,), ({1: 1},)])
    assert [r[0] for r in got] == [10, 9, None, 8, 11, 9, None]
    assert got[1][1] == [10.0] and got[2][1] == [None] and got[0][2] == 0.0


def test_all_contributions_that_flattening_needs_count(spark):
    """More than ten of them, where the ranges say so."""
    wide = AnonymizationParams(low_count_params=SuppressionParams(layer_sd=0.0), outlier_count=FlatteningInterval(8, 8), top_count=FlatteningInterval(8, 8), layer_noise_sd=0.0)
    assert [r[0] for r in flattened(spark, wide, [({i: 10 for i in range(1, 31)},)], [({i: 10 for i in range(1, 16)},)])] == [300, None]


def test_flattening_ranges_shrink_with_the_group(spark):
    f = FlatteningInterval
    base = AnonymizationParams(salt=b"s", low_count_params=SuppressionParams(layer_sd=0.0), layer_noise_sd=0.0)
    falling = lambda n: {i: 2 ** (n - i) for i in range(1, n + 1)}

    def possible(counts, outliers, tops):
        n = sorted(counts.values(), reverse=True)
        return {sum(max(x - sum(n[o : o + t]) / t, 0) for x in n[:o]) for o in outliers for t in tops}

    got = flattened(spark, base, *[[(falling(n),)] for n in (3, 4, 7, 10, 14)])
    assert got[0][1] == [None] and set(got[1][1]) == possible(falling(4), [2], [2])
    assert set(got[2][1]) <= possible(falling(7), [2, 3, 4], [2, 3])
    assert all(set(g[1]) <= possible(falling(n), range(2, 6), range(2, 6)) for g, n in zip(got[3:], (10, 14)))
    other = AnonymizationParams(salt=b"s", low_count_params=SuppressionParams(layer_sd=0.0), outlier_count=f(2, 2), top_count=f(2, 9), layer_noise_sd=0.0)
    assert set(flattened(spark, other, [(falling(8),)])[0][1]) <= possible(falling(8), [2], range(2, 7))


def test_noise_of_counts_is_sticky(spark):
    """The same draws as by hand."""
    from pyspark.sql import functions as F

    params = AnonymizationParams(salt=b"abc", layer_noise_sd=1.5, outlier_count=FlatteningInterval(1, 1), top_count=FlatteningInterval(1, 1))
    counts = {hash_pid(i): 3 for i in range(40, 60)}
    seed = xor_all(counts)
    draw = noise(b"abc", "noise", 1.5 * 3, [7, seed])
    assert flattened(spark, params, [(counts,)])[0][0] == round(60 + draw)
    got = spark.range(1).select(noisy_entities(params, F.lit(7).cast("long"), F.lit(20).cast("long"), F.lit(signed(seed)))).first()[0]
    assert got == round(20 + noise(b"abc", "noise", 1.5, [7, seed]))


def test_row_limits_money_and_uniform_draws(spark):
    from pyspark.sql import functions as F

    assert all(abs(noisy_row_limit(b"x", s, 1_000_000, 1000) - 1000) <= 50 for s in range(200))
    values = [0.0, 1.0, 1.49, 1.5, 3.49, 3.5, 7.4, 7.5, 0.02, 0.036, 450.0, 760.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(money_round(F.col("x"))).collect()] == pytest.approx([0, 1, 1, 2, 2, 5, 5, 10, 0.02, 0.05, 500, 1000])
    flat = spark.createDataFrame([([(0.0,)],), ([(1.0,)],), ([(13.3,), (2.0,)],)], "f array<struct<sd:double>>")
    assert [r[0] for r in flat.select(reported_sd(F.col("f"))).collect()] == pytest.approx([0, 1.0, 13.5])
    seeds = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 123456789, -987654321]
    got = spark.createDataFrame([(s,) for s in seeds], "s long").select(*[uniform_column(2, u, F.col("s")) for u in (2, 5, 8)]).collect()
    assert [tuple(r) for r in got] == [tuple(uniform_int(FlatteningInterval(2, u), unsigned(s)) for u in (2, 5, 8)) for s in seeds]
    assert xor_all([]) == 0


def test_hashes_in_batches(spark):
    ids = [5, None, 0, 5, (1 << 62) + 1, -3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "i long").coalesce(1).selectExpr("coalesce(i, 0) i").select(hashed_ids("i")).collect()]
    assert got == [None if not x else signed(hash_pid(x)) for x in ids]
    text = [r[0] for r in spark.createDataFrame([("a",), (None,), ("",), ("a",)], "s string").select(hashed_ids("s")).collect()]
    assert text == [signed(hash_string("a")), None, None, signed(hash_string("a"))]
    middles = [[0.25, 0.25], [0.5, 1e-7], [-0.0, 0.0]]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in middles], "m array<double>").select(hashed_labels("m")).collect()]
    assert got == [signed(hash_strings(str(x) for x in m)) for m in middles]


def test_columns_by_name_or_number():
    assert column_positions(["a", "b"], "b") == [1] and column_positions(["a", "b"], [0]) == [0] and column_positions(["a"], []) == []
    for bad, error in (("x", ValueError), ([5], ValueError), (["a", 0], TypeError), (1.5, TypeError)):
        with pytest.raises(error):
            column_positions(["a", "b"], bad)


def test_noise_in_the_jvm_is_the_same(spark):
    from pyspark.sql import functions as F

    from veilgrid.functions.noise import low_count_column, noise, noise_column, salted_column, signed

    seeds = [0, 1, -1, 1 << 62, -(1 << 63), 1234567890123456789]
    df = spark.createDataFrame([(s,) for s in seeds], "s long")
    got = df.select("s", salted_column(b"abc", F.col("s")), noise_column(b"abc", "suppress", 2.0, [F.col("s")]), low_count_column(b"abc", SuppressionParams(), F.lit(5), F.col("s"))).collect()
    for s, a, b, low in got:
        u = s & (1 << 64) - 1
        assert a == signed(salted(b"abc", u))
        assert b == pytest.approx(noise(b"abc", "suppress", 2.0, [u]))
        assert low == is_low_count(b"abc", SuppressionParams(), [(5, u)])


def test_parameters_have_their_defaults():
    p = AnonymizationParams()
    assert (p.low_count_params.low_threshold, p.layer_noise_sd, p.outlier_count.upper) == (3, 1.0, 5)
