"""The named core queries without SQL, over whole small tables: each runs, and what must hold between them and with plain formulas holds."""

import math
from pathlib import Path

import numpy as np
import pytest

from chainlake.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
EMPTY = {"clu_8_domains"}  # the tables hold no record of a protein with itself


@pytest.fixture(scope="module")
def frame(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = catalog.queries()[name](spark, str(FOLDER)).toPandas()
        return held[name]

    return get


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(frame, name):
    assert (len(frame(name)) == 0) == (name in EMPTY)


def test_p_of_phi(frame):
    x = frame("sta_1_chi_squared")
    raw = frame("sta_1_phi").set_index(["a", "b", "partner"])
    plain = x[~x["dynamics"].isin(["Static", "Strong Positive", "Strong Negative"])]
    assert len(plain)
    for r in plain.itertuples():
        y = raw.loc[(r.a, r.b, r.partner)]
        n = y.n11 + y.n10 + y.n01 + y.n00
        assert r.phi == y.phi and abs(r.p - math.erfc(math.sqrt(n * y.phi**2 / 2))) < 2e-6
    assert set(x.loc[x["dynamics"] == "Static", "phi"]) <= {0.0} and set(x.loc[x["dynamics"] == "Strong Positive", "phi"]) <= {1.0}


def test_clashes_only_take_ranks_away(frame):
    plain, valid = (frame(n).set_index("combo")["n_ranks"] for n in ("grf_5_stability", "grf_5_valid_stability"))
    assert set(plain.index) == set(valid.index) and (valid <= plain.loc[valid.index]).all()


def test_orders_by_rmsd(frame):
    x = frame("srt_2_rmsd_order").sort_values(["protein", "traj_n"])
    for _, g in x.groupby("protein"):
        assert g["traj_n"].tolist() == list(range(1, len(g) + 1)) and g["value"].is_monotonic_increasing


def test_rmsd_by_an_independent_formula(frame, spark):
    """Kabsch by singular values alone: the least squared gap is |p|² + |q|² - 2 (s1 + s2 ± s3)."""
    from chainlake.plans import structures

    pts = structures._chain_points(spark, str(FOLDER)).toPandas()
    pts["n"] = pts["xyz"].map(len)
    got = frame("mat_7_superposition_rmsd").set_index(["file_id", "chain"])["rmsd"]
    for _, g in pts[pts["n"] >= 3].groupby(["prot_id", "n"]):
        g = g.assign(mean=[round(float(np.mean(p)), 9) for p in g["plddt"]]).sort_values(["mean", "file_id", "chain"], ascending=[False, True, False])
        q = np.stack([np.asarray(x) for x in g.iloc[0]["xyz"]])
        for r in g.itertuples():
            p = np.stack([np.asarray(x) for x in r.xyz])
            a, b = p - p.mean(axis=0), q - q.mean(axis=0)
            h = a.T @ b
            s = np.linalg.svd(h, compute_uv=False)
            s[2] *= np.sign(np.linalg.det(h)) or 1
            want = math.sqrt(max(((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(p), 0))
            assert abs(got[(r.file_id, r.chain)] - want) < 2e-3


def test_linkages_agree_with_one_another(frame):
    one, all_ = frame("clu_1_agglomerative").set_index("matrix_id")["label"], frame("clu_1_linkages").set_index("matrix_id")["average"]
    assert one.to_dict() == all_.to_dict()


def test_clusters_of_edges(frame):
    table, edges = frame("clu_4_cluster_table"), frame("grf_3_edges_with_clusters")
    n = table.groupby(["a", "b"]).size()
    for (a, b), g in edges.groupby(["a", "b"]):
        k = n.get((a, b), 0)
        assert len(g) == max(k, 1) and g["is_multivalent"].iloc[0] == (k > 1)
    assert len(frame("clu_3_contact_clusters")) == table["n_models"].sum()


def test_best_threshold_has_the_least_error(frame):
    x = frame("clu_6_threshold_sweep")
    assert x.groupby("metric").size().to_dict() == {m: 100 for m in ("iou", "contact_fraction", "mean_closeness", "median_closeness")}
    best = x[x["is_best"]].set_index("metric")["mse"]
    assert (best == x.groupby("metric")["mse"].min().loc[best.index]).all()
