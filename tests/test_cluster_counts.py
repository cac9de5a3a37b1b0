"""Numbers of clusters beyond four are found."""

import numpy as np

from chainlake.plans import catalog, structures

SCHEMA = "matrix_id bigint, protein1 string, protein2 string, proteins_in_model array<string>, pair_chains_tuple array<string>, rank int, is_contact array<array<boolean>>, pae array<array<float>>, min_plddt array<array<float>>, distance array<array<float>>"


def test_clusters_start_from_the_valency(spark, tmp_path, monkeypatch):
    rows = []
    for k in range(14):  # seven modes, two variants each
        on = [[i // 2 == k % 7 and (j < 3 or j == 3 + k // 7) for j in range(5)] for i in range(14)]
        rows.append((k, "P", "Q", ["P", "Q"], ["A", "B"], 1, on, None, [[90.0] * 5] * 14, None))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pairwise_contact_matrices.parquet")
    monkeypatch.setattr(structures, "_valency", lambda s, d: s.createDataFrame([("P", "Q", 5)], "a string, b string, valency bigint"))
    got = catalog.queries()["clu_3_contact_clusters"](spark, str(tmp_path)).collect()
    assert len({r.label for r in got}) == 7 and len({(r.matrix_id % 7, r.label) for r in got}) == 7


def test_six_kinds_of_curves(spark, monkeypatch):
    rows = [(6 * c + k, "A", "P", (np.eye(6)[k] * 90 + c * 0.1).tolist()) for k in range(6) for c in range(3)]
    monkeypatch.setattr(structures, "_chain_points", lambda s, d: s.createDataFrame(rows, "file_id bigint, chain string, prot_id string, plddt array<double>"))
    got = catalog.queries()["clu_7_curve_clusters"](spark, "").collect()
    assert len({r.cluster for r in got}) == 6
