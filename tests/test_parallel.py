from tessera.plans.parallel import SPREAD, spread


def test_spread_only_where_asked(spark):
    one = spark.range(0, 100, 1, 1).selectExpr("id", "id % 3 as k")
    before = spark.conf.get(SPREAD, None)
    spark.conf.unset(SPREAD)
    try:
        assert spread(one, "id") is one
        out = spread(one, ["k", "id"], partitions=6)
        assert out.rdd.getNumPartitions() == 6 and out.count() == 100
        assert "hashpartitioning(k" in out._jdf.queryExecution().executedPlan().toString()
        spark.conf.set(SPREAD, "5")
        assert spread(one).rdd.getNumPartitions() == 5
    finally:
        spark.conf.set(SPREAD, before) if before else spark.conf.unset(SPREAD)
