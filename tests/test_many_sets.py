"""Pairs of many different contact sets: kernels that make distances row by row against those of a matrix, and what memory they take."""

import tracemalloc

import numpy as np
import pytest

from chainlake.operators import clusters as cl
from chainlake.operators import exploration as ex


def sets_of(seed, n=40, cells=30):
    rng = np.random.default_rng(seed)
    made = sorted({tuple(np.flatnonzero(rng.random(cells) < rng.choice([0.3, 0.6]))) for _ in range(n)})
    made = [np.array(c) for c in made if len(c) >= 3]
    return cl.ContactSets(made), rng.integers(1, 6, len(made))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("linkage", ["average", "single", "complete", "ward"])
def test_linkages_without_a_matrix(seed, linkage):
    sets, w = sets_of(seed)
    ks = [1, 2, 3, 5, 9]
    want, got = (cl.agglomerations(d, ks, linkage, w) for d in (sets.dense(), sets))
    assert all(want[k].tolist() == got[k].tolist() for k in ks)


@pytest.mark.parametrize("seed", range(4))
def test_scores_density_and_scaling_without_a_matrix(seed):
    sets, w = sets_of(seed)
    d, names = sets.dense(), ["silhouette", "calinski_harabasz", "davies_bouldin", "gap"]
    assert [x.tolist() for x in cl.best_counts(d, 3, names, weights=w)] == [x.tolist() for x in cl.best_counts(sets, 3, names, weights=w)]
    eps = cl.distance_quantile(d, 0.2, w)
    assert eps == cl.distance_quantile(sets, 0.2, w)
    assert cl.dbscan(d, eps, weights=w).tolist() == cl.dbscan(sets, eps, weights=w).tolist()
    assert np.allclose(cl.classical_scaling(d, weights=w), cl.classical_scaling(sets, weights=w), atol=1e-5)
    many, n = sets_of(seed, 200, 12)
    assert ex.component_count(many, n, block=16) == ex.principal_features(many.mask(), weights=n).shape[1]


def test_memory_grows_with_the_sets_and_not_their_square():
    rng = np.random.default_rng(5)
    sets = cl.ContactSets([np.array(c) for c in {tuple(np.sort(rng.choice(60, 8, replace=False)) + 60 * int(m)) for m in rng.integers(0, 4, 3500)}])
    assert len(sets) > sets.dense_limit
    w = np.ones(len(sets), dtype=int)
    tracemalloc.start()
    cuts = cl.streamed_agglomerations(sets, [2, 4], weights=w, cache_mb=8)
    cl.dbscan(sets, cl.distance_quantile(sets, 0.2, w), weights=w)
    cl.silhouette(sets, cuts[4], w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(sets) ** 2  # a matrix in single precision
