"""What Spark would size too low is not broadcast."""

from orbitframe.plans.adapters import view


def test_keys_of_a_large_object_table_are_not_broadcast(spark, tmp_path):
    """The whole table passes the threshold, the share of it that a key column should have does not."""
    spark.range(20_000).selectExpr(
        "id AS p_partkey", "uuid() AS p_name", "uuid() AS p_brand", "uuid() AS p_type", "int(id % 50) AS p_size",
        "900D + rand() AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = lambda: view(spark, str(tmp_path), "satcat").select(
        "norad_id")._jdf.queryExecution().executedPlan().toString()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size // 2))
        assert "Broadcast" not in plan() and "SortMergeJoin" in plan()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size * 2))
        assert "BroadcastHashJoin" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
