"""Voxel joins at size: no table of points is sent to the driver, however small its files are."""

from chainlake.operators import contacts as c


def test_points_are_joined_by_shuffle(spark, tmp_path):
    rows = [(f, ch, r, float(r), 0.0, float(k)) for f in range(3) for k, ch in enumerate("AB") for r in range(5)]
    spark.createDataFrame(rows, "file_id int, chain string, res_no int, x double, y double, z double").write.parquet(f"{tmp_path}/points")
    near = c.near_points(spark.read.parquet(f"{tmp_path}/points"), ["file_id"], "chain", 1.0, ["res_no"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert near.count() == 15
