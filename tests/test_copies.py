"""Equal contact sets: kernels with weights against the same points one by one, and queries in which every record counts."""

import numpy as np
import pytest

from chainlake.operators import clusters as cl
from chainlake.operators import exploration as ex
from chainlake.plans import catalog

SCHEMA = "matrix_id bigint, protein1 string, protein2 string, proteins_in_model array<string>, pair_chains_tuple array<string>, rank int, is_contact array<array<boolean>>, pae array<array<float>>, min_plddt array<array<float>>, distance array<array<float>>"


@pytest.mark.parametrize("seed", range(5))
def test_weights_stand_for_copies(seed):
    rng = np.random.default_rng(seed)
    mask = np.unique(rng.random((9, 12)) < 0.5, axis=0)
    w = rng.integers(1, 6, len(mask))
    full = np.repeat(np.arange(len(mask)), w)
    x = mask.astype(float)
    common, size = x @ x.T, x.sum(axis=1)
    d = 1 - common / (size[:, None] + size - common)
    np.fill_diagonal(d, 0)
    every = d[np.ix_(full, full)]
    for k in (2, 3, 5):
        assert cl.agglomerate(d, k, weights=w)[full].tolist() == cl.agglomerate(every, k).tolist()
    labels = cl.agglomerate(d, 3, weights=w)
    assert np.isclose(cl.silhouette(d, labels, w), cl.silhouette(every, labels[full]))
    eps = cl.distance_quantile(d, 0.2, w)
    assert np.isclose(eps, np.quantile(every, 0.2))
    assert cl.dbscan(d, eps, weights=w)[full].tolist() == cl.dbscan(every, eps).tolist()
    f, g = ex.principal_features(x, weights=w)[full], ex.principal_features(x[full])
    assert f.shape == g.shape and np.allclose(f @ f.T, g @ g.T)


def test_every_record_has_a_label_and_counts(spark, tmp_path):
    cells = {"one": [(0, 0), (0, 1), (1, 0), (1, 1)], "near": [(0, 0), (0, 1), (1, 0)], "far": [(3, 3), (3, 2), (2, 3)]}
    rows = []
    for k, name in enumerate(["one"] * 5 + ["near"] * 2 + ["far"] * 3, 1):
        on = [[(i, j) in cells[name] for j in range(4)] for i in range(4)]
        rows.append((k, "P", "Q", ["P", "Q"], ["A", "B"], 1, on, [[1.0 if c else 20.0 for c in r] for r in on], [[90.0] * 4] * 4, [[4.0 if c else 20.0 for c in r] for r in on]))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pairwise_contact_matrices.parquet")
    for name in ("clu_1_agglomerative", "clu_1_dbscan", "clu_3_contact_clusters"):
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(r.matrix_id for r in got) == list(range(1, 11)), name
    table = catalog.queries()["clu_4_cluster_table"](spark, str(tmp_path)).collect()
    assert sum(r.n_models for r in table) == 10
