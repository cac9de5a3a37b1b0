"""Contact records with missing matrices count like complete ones."""

import pytest
from pyspark.sql import functions as F

from chainlake.plans import catalog

ON, OFF = [[True, True, False], [False, True, False]], [[False] * 3] * 2
PAE, DIST, PLDDT = [[1.0, 7.0, 9.0], [7.5, 2.0, 1.0]], [[4.0, 7.9, 3.0], [5.0, 1.0, 8.0]], [[80.0] * 3] * 2
SCHEMA = """matrix_id bigint, protein1 string, protein2 string, proteins_in_model array<string>, pair_chains_tuple array<string>, rank int, length1 int, length2 int,
is_contact array<array<boolean>>, pae array<array<float>>, min_plddt array<array<float>>, distance array<array<float>>"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One pair, the same contacts (0,0), (0,1), (1,1) told in five ways; one record tells nothing."""
    given = [(ON, PAE, DIST), (None, PAE, DIST), (ON, None, DIST), (ON, PAE, None), (ON, None, None), (None, PAE, None)]
    rows = [(k, "P", "Q", ["P", "Q"], ["A", "B"], 1, 2, 3, on, pae, PLDDT, dist) for k, (on, pae, dist) in enumerate(given, 1)]
    path = tmp_path_factory.mktemp("incomplete")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/pairwise_contact_matrices.parquet")
    return str(path)


def test_all_told_contacts_count(spark, folder):
    rows = catalog.queries()["mat_1_contacts"](spark, folder).collect()
    assert sorted((r.matrix_id, r.i, r.j) for r in rows) == [(m, *c) for m in range(1, 6) for c in ((0, 0), (0, 1), (1, 1))]
    at = {(r.matrix_id, r.i, r.j): (r.pae, r.dist) for r in rows}
    assert at[1, 1, 1] == (2.0, 1.0) and at[3, 1, 1] == (None, 1.0) and at[4, 1, 1] == (2.0, None) and at[5, 1, 1] == (None, None)


def test_models_and_frequencies_count_them(spark, folder):
    assert catalog.queries()["mat_2_pair_matrices"](spark, folder).first().n_matrices == 5
    edge = catalog.queries()["rep_5_edge_summary"](spark, folder).first()
    assert (edge.n_cells, edge.mean_freq, edge.n_models) == (3, 1.0, 5)


def test_values_come_only_from_records_that_have_them(spark, folder):
    quality = catalog.queries()["mat_4_quality"](spark, folder).where(F.col("quality") > 0)
    assert sorted(r.matrix_id for r in quality.collect()) == [1, 2, 4]
