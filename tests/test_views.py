"""How the views spread out rows that become many."""

from voxelweave.plans import views


def test_lattices_are_made_by_more_than_a_task(spark, tmp_path):
    """A small file of suppliers comes in one task; each of its rows makes up to 2,197."""
    n = 3 * views.SPREAD_ROWS + 1
    spark.range(n).selectExpr("id as s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert views.view(spark, str(tmp_path), "spine").rdd.getNumPartitions() == 4
    blobs = views.view(spark, str(tmp_path), "blobs")
    plan = blobs._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(4)" in plan
    assert blobs.select("study").distinct().count() == n // 21 + 1
