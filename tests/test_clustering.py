import numpy as np
import pytest

from veilgrid.operators.harvest import adjust_counts
from veilgrid.operators.stitch import StitchOwner
from veilgrid.plans.clustering import Clusters, ClusteringContext, build_clusters, should_sample, simplify, solve, solve_with_features, unmet


def blocks(n: int = 8) -> ClusteringContext:
    m = np.full((n, n), 0.05)
    for i in range(0, n, 2):
        m[i, i + 1] = m[i + 1, i] = 0.9
    np.fill_diagonal(m, 1.0)
    return ClusteringContext(m, np.full(n, 4.0))


def test_small_tables_are_one_cluster():
    assert solve(blocks(4)).initial == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        solve(blocks(4), max_weight=1.0)


def test_dependent_columns_share_a_cluster():
    c = solve(blocks(), max_weight=12.0)
    together = [set(c.initial), *[set(d) for _, _, d in c.derived]]
    assert all(any({i, i + 1} <= t for t in together) for i in range(0, 8, 2))
    assert sorted(x for t in together for x in t) == list(range(8))
    assert unmet(blocks(), c) < unmet(blocks(), build_clusters(blocks(), 12.0, 0.1, [0, 2, 4, 6, 1, 3, 5, 7])) + 1e-9


def test_simplify_merges_a_cluster_that_stitches_on_the_initial_one():
    c = simplify(Clusters([0], [(StitchOwner.SHARED, [0], [1, 2]), (StitchOwner.SHARED, [1], [3])]))
    assert (c.initial, len(c.derived)) == ([0, 1, 2], 1)


def test_features_are_chunked_by_weight():
    c = solve_with_features(0, [1, 2, 3], 6.0, np.ones(6), drop_non_features=False)
    assert c.initial == [0, 1, 2]
    assert c.derived == [(StitchOwner.SHARED, [0], [3]), (StitchOwner.LEFT, [0], [4]), (StitchOwner.LEFT, [0], [5])]
    assert len(solve_with_features(0, [1, 2, 3], 6.0, np.ones(6), True).derived) == 1


def test_sampling_pays_only_for_many_columns_and_rows():
    assert should_sample(10, 100_000, 1000) and not should_sample(2, 100_000, 1000) and not should_sample(10, 900, 1000)


def test_adjusted_counts_keep_the_total():
    assert adjust_counts([10, 10], 10) == [5, 5]
    assert sum(adjust_counts([3, 3, 3, 3], 10)) in (9, 10)
