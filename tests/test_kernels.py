import math

import numpy as np
from pyspark.sql import functions as F

from chainlake.functions import geometry as g
from chainlake.functions import metrics as m
from chainlake.operators import clusters as cl
from chainlake.operators import lattice as la
from chainlake.operators import statistics as st

RNG = np.random.default_rng(1)


def test_superposition_undoes_a_motion():
    p = RNG.standard_normal((20, 3))
    q, r = np.linalg.qr(RNG.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    rot, t, rmsd = g.superpose(p @ q + 5, p)
    assert rmsd < 1e-9 and np.allclose((p @ q + 5) @ rot + t, p)


def test_pruned_superposition_ignores_an_outlier():
    p = RNG.standard_normal((30, 3)) * 10
    moved = p + 1.0
    moved[0] += 50
    r, t, _ = g.pruned_superposition(moved, p)
    assert np.allclose((moved @ r + t)[1:], p[1:], atol=1e-6)


def test_rotation_toward():
    points = g.rotation_toward(np.array([[1.0, 0, 0]]), np.array([1.0, 0, 0]), np.array([0, 2.0, 0]))
    assert np.allclose(points, [[0, 1, 0]])
    assert np.allclose(g.rotation_toward(np.eye(3), np.array([1.0, 0, 0]), np.array([-1.0, 0, 0]))[0], [-1, 0, 0])


def test_circle():
    a = np.linspace(0, 2 * np.pi, 7, endpoint=False)
    assert abs(g.fit_circle(np.column_stack([3 * np.cos(a), 3 * np.sin(a), np.full(7, 2.0)]))[1] - 3) < 1e-6


def test_linkage_finds_two_groups():
    x = np.concatenate([RNG.normal(0, 0.1, 6), RNG.normal(9, 0.1, 5)])
    d = np.abs(x[:, None] - x[None])
    for linkage in ("single", "complete", "average", "ward"):
        assert cl.agglomerate(d, 2, linkage).tolist() == [0] * 6 + [1] * 5
    assert len(set(cl.best_count(d, 1).tolist())) == 2
    assert set(cl.dbscan(d, 1.0).tolist()) == {0, 1}


def test_communities():
    w = np.zeros((8, 8))
    w[:4, :4], w[4:, 4:] = 1, 1
    w[3, 4] = w[4, 3] = 0.1
    np.fill_diagonal(w, 0)
    assert cl.constant_potts(w, 0.3).tolist() == [0] * 4 + [1] * 4


def test_scaling_keeps_distances():
    x = RNG.random((6, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    y = cl.smacof(d, rounds=3000, eps=1e-12)
    assert np.abs(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)) - d).max() < 0.05


def test_t_distribution():
    assert abs(st.t_quantile(0.975, 10) - 2.228139) < 1e-4
    assert abs(st.t_sf2(2.228139, 10) - 0.05) < 1e-6
    assert abs(st.incomplete_beta(2, 3, 0.5) - 0.6875) < 1e-10


def test_phi_and_p(spark):
    rows = [(True, True)] * 8 + [(False, False)] * 8 + [(True, False)] * 2 + [(False, True)] * 2 + [(None, True)]
    r = spark.createDataFrame(rows, "a boolean, b boolean").agg(*st.phi(F.col("a"), F.col("b"))).select("*", st.chi2_sf(20 * F.col("phi") * F.col("phi")).alias("p")).first()
    assert abs(r.phi - 0.6) < 1e-12 and abs(r.p - math.erfc(math.sqrt(20 * 0.36 / 2))) < 1e-12
    one = spark.createDataFrame([(True, True)], "a boolean, b boolean").agg(*st.phi(F.col("a"), F.col("b"))).first()
    assert one.phi is None


def test_ppv_and_intervals(spark):
    row = spark.range(1).select(
        m.ppv(F.lit(0.9)).alias("high"), m.ppv(F.lit(0.0)).alias("low"), m.in_interval(F.lit(1.0), m.parse_interval(F.lit("[0.5;1.0)"))).alias("open"),
        m.in_interval(F.lit(0.5), m.parse_interval(F.lit(" [0.5;inf) "))).alias("closed"), m.parse_interval(F.lit("nonsense")).alias("none"),
    ).first()
    assert (row.high, row.low, row.open, row.closed, row.none) == (0.98128027, 0.55890174, False, True, None)


def test_convergence_is_three_valued(spark):
    s = spark.createDataFrame([(["A"], True), (["A", "A"], False), (["B"], True), (["A", "B"], None), (["C"], True)], "combo array<string>, is_stable boolean")
    got = {tuple(r.combo): r.is_convergent for r in la.convergence(s, la.containment_edges(s)).collect()}
    assert got == {("A",): None, ("A", "A"): False, ("B",): None, ("A", "B"): None, ("C",): None}
    s2 = s.where("is_stable IS NOT NULL")
    assert {tuple(r.combo): r.is_convergent for r in la.convergence(s2, la.containment_edges(s2)).collect()}[("A",)] is True


def test_decomposition():
    assert la.decomposable({"A": 4, "B": 2}, [("A", "A", "B")])
    assert not la.decomposable({"A": 3, "B": 2}, [("A", "A", "B")])
