"""The index of fingerprints is 33 times as large as Spark's estimate, so its join must not be a broadcast."""

from lexigrain.llm.simhash import links


def test_links_are_not_joined_by_broadcast(spark, tmp_path):
    spark.createDataFrame([(0,), (1,), (15,), (-1,)], "fp long").write.parquet(f"{tmp_path}/fps")
    found = links(spark.read.parquet(f"{tmp_path}/fps"))
    assert sorted(sorted((r["a"], r["b"])) for r in found.distinct().collect()) == [[0, 1], [1, 15]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
