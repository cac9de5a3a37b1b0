import numpy as np

from chainlake.functions import geometry as geo
from chainlake.operators import exploration as ex


def test_small_clusters_are_absorbed():
    x = np.array([0.0] * 6 + [10.0] * 5 + [1.0])
    labels = np.array([0] * 6 + [1] * 5 + [2])
    assert ex.absorb_small(labels, np.abs(x[:, None] - x[None])).tolist() == [0] * 6 + [1] * 5 + [0]


def test_refinements():
    a, b = np.zeros((9, 9)), np.zeros((9, 9))
    a[:3, :3], b[1, 1] = 1, 1
    far = np.zeros((9, 9))
    far[8, 8] = 1
    assert len(ex.fraction_refined([b, a, far])) == 2
    assert len(ex.closeness_refined([a, b, far], threshold=3)) == 2
    assert ex.one_sided_closeness(np.zeros((2, 2)), a[:2, :2]) == float("inf")
    assert ex.without_single_outliers(np.array([0] * 10 + [1])).tolist() == [True] * 10 + [False]


def test_features_hold_the_variance():
    x = np.random.default_rng(0).random((20, 6))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    f = ex.principal_features(x)
    assert (f**2).sum() >= 0.95 * (z**2).sum() - 1e-9
    assert ex.principal_features(np.ones((3, 4))).shape == (3, 1)


def test_layout_brings_linked_ones_near():
    x = ex.force_layout(6, [(0, 1), (1, 2), (3, 4)])
    assert np.linalg.norm(x[0] - x[1]) < np.linalg.norm(x[0] - x[3])
    assert np.array_equal(x, ex.force_layout(6, [(0, 1), (1, 2), (3, 4)]))


def test_paths_grow_along_edges(spark):
    edges = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.5), ("X", "Y", 0.1), (None, "Z", 1.0)], "a string, b string, weight double")
    rows = ex.assembly_paths(spark, edges, n_paths=20).orderBy("path", "step").collect()
    assert {r.path for r in rows} == set(range(20)) and all(len(r.combo) == r.step + 2 for r in rows)
    assert all(set(r.combo) <= {"A", "B", "C"} or set(r.combo) <= {"X", "Y"} for r in rows)
    assert rows == ex.assembly_paths(spark, edges, n_paths=20).orderBy("path", "step").collect()
    assert ex.assembly_paths(spark, edges.where("false"), n_paths=3).count() == 0


def test_reference_rmsd_equals_numpy(spark):
    rng = np.random.default_rng(3)
    models = {k: rng.standard_normal((6, 3)) for k in range(4)}
    rows = [(k, "P", r, *map(float, p), 50.0 + k) for k, m in models.items() for r, p in enumerate(m)]
    got = ex.reference_rmsd(spark.createDataFrame(rows, "file_id int, prot string, res_no int, x double, y double, z double, bfactor double"), ["file_id"], ["prot"]).collect()
    assert {r.file_id: r.rmsd for r in got} == {k: round(geo.superpose(m, models[3])[2], 4) for k, m in models.items()}
