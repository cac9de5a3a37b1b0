"""Assembly paths over more edges than one table on the driver may hold."""

from pyspark.sql import functions as F

from chainlake.operators import exploration as ex


def test_paths_over_many_edges(spark):
    edges = spark.range(120_000).select(F.concat(F.lit("P"), F.col("id")).alias("a"), F.concat(F.lit("P"), F.col("id") + 1).alias("b"), F.lit(0.5).alias("weight"))
    rows = ex.assembly_paths(spark, edges, n_paths=3).collect()
    assert {r.path for r in rows} == {0, 1, 2} and all(len(r.combo) == r.step + 2 for r in rows)
    for r in rows:  # without gaps or with proteins that come again
        at = sorted({int(x[1:]) for x in r.combo})
        assert at == list(range(at[0], at[-1] + 1)) and r.score == 0.5
