"""Patterns of up to four words are scored."""

from chainlake.plans import catalog


def test_long_common_phrases_win(spark, tmp_path):
    rows = [("b", k, "zinc finger of", f"binding site {x}") for k, x in enumerate(["red", "blue", "green"])]
    spark.createDataFrame(rows, "p_brand string, p_partkey bigint, p_type string, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    row = catalog.queries()["agg_21_ngram_scores"](spark, str(tmp_path)).first()
    assert (row.pattern, row.score) == ("zinc finger binding site", 1.6)
