"""The report of problem 2 holds every pair of proteins, however rare."""

from chainlake.llm import queries


def test_rare_pairs_are_reported(spark, tmp_path):
    lists = [["A", " b"], ["B", "a", "A"], ["A", "C"], ["C", "D"], ["D", "E", None, " "], ["E", "F"]]
    marks = ["✔", "✔✔", "✔", "✔", "✔", "x"]
    rows = [(k, k, x, mark) for k, (x, mark) in enumerate(zip(lists, marks, strict=True))]
    spark.createDataFrame(rows, "row_id bigint, pred_id bigint, proteins_in_model array<string>, cluster string").write.parquet(f"{tmp_path}/pairwise_nmers_df.parquet")
    got = {(r.protein_a, r.protein_b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in queries.p2_pairs(spark, str(tmp_path)).collect()}
    assert got == {("A", "B"): (2, 3, 2, 5, 1.666667), ("A", "C"): (1, 3, 2, 5, 0.833333), ("C", "D"): (1, 2, 2, 5, 1.25), ("D", "E"): (1, 2, 1, 5, 2.5)}
    assert queries.p2_found(spark, str(tmp_path)).count() == 0
