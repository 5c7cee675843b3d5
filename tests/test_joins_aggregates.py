import pytest
from conftest import plan, ran_plan, rows
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, layout


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (3, "z"), (None, "m")], "k int, r string")
    return left, right


@pytest.mark.parametrize("kind", joins.JOIN_TYPES)
def test_split_hot_gives_the_same_rows(sides, kind):
    left, right = sides
    if kind in ("left_semi", "left_anti"):
        plain = left.join(right, ["k"], kind)
    else:
        plain = left.join(right, ["k"], kind)
    assert rows(joins.equi_join(left, right, ["k"], kind)) == rows(plain)
    assert rows(joins.equi_join(left, right, ["k"], kind, split_hot=True).select(*plain.columns)) == rows(plain)


def test_shared_columns_need_a_preference(spark):
    left = spark.createDataFrame([(1, "old")], "k int, region string")
    right = spark.createDataFrame([(1, "new")], "k int, region string")
    with pytest.raises(ValueError, match="region"):
        joins.equi_join(left, right, ["k"])
    assert rows(joins.equi_join(left, right, ["k"], prefer="right")) == [(1, "new")]
    assert rows(joins.equi_join(left, right, ["k"], prefer="left")) == [(1, "old")]


def test_join_type_spellings():
    assert joins.join_type("LEFT_OUTER") == "left" and joins.join_type("anti") == "left_anti"
    with pytest.raises(ValueError, match="cross"):
        joins.join_type("cross")


def test_broadcast_only_below_the_limit(spark, folder):
    spark.range(1000).withColumn("v", F.col("id") * 2).write.parquet(f"{folder}/d")
    small = spark.read.parquet(f"{folder}/d")
    facts = spark.range(100000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(joins.lookup_join(facts, small, ["id"]))
        assert "SortMergeJoin" in plan(joins.lookup_join(facts, small, ["id"], limit_mb=0.0001))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_estimate_is_taken_after_pruning(spark, folder):
    wide = spark.range(1000).select("id", F.repeat(F.lit("x"), 500).alias("pad"))
    wide.write.parquet(f"{folder}/w")
    df = spark.read.parquet(f"{folder}/w")
    assert layout.estimated_bytes(df.select("id")) < layout.estimated_bytes(df)
    assert layout.broadcast_if_small(df, limit_mb=0) is df


def test_adaptive_execution_splits_a_hot_key_on_either_side(spark):
    hot = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    dim = spark.range(60000).select(F.col("id").alias("k"), F.lit("d").alias("name"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot, dim = hot.repartition(8), dim.repartition(8)
        left_hot = joins.equi_join(hot, dim, ["k"], "left")
        right_hot = joins.equi_join(dim, hot, ["k"], "left")
        split = joins.equi_join(dim, hot, ["k"], "left", split_hot=True)
        assert "skew=true" in ran_plan(left_hot)
        assert "skew=true" not in ran_plan(right_hot)
        assert "skew=true" in ran_plan(split)
        assert split.count() == right_hot.count()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_aggregate_names_expressions_and_functions(spark):
    df = spark.createDataFrame(
        [("2020-01-05", "a", 1, 5), ("2020-01-07", "a", 2, None), ("2020-02-01", "b", 3, 7)],
        "d string, g string, o int, v int",
    ).withColumn("d", F.to_date("d"))
    entries = [
        {"function": "count", "column": "v", "alias": "n"},
        {"function": "count", "column": "*", "alias": "rows"},
        {"function": "countDistinct", "column": "g"},
        {"function": "first", "column": "v", "order_by": "o", "alias": "first_v"},
        {"function": "last", "column": "o", "order_by": ["d", "o"], "alias": "last_o"},
    ]
    got = aggregates.aggregate(df, ["year(d)", "month(d)", "upper(g) AS g"], entries)
    assert got.columns == ["year", "month", "g", "n", "rows", "countDistinct_g", "first_v", "last_o"]
    assert rows(got) == [(2020, 1, "A", 1, 2, 1, 5, 2), (2020, 2, "B", 1, 1, 1, 7, 3)]


def test_aggregate_refuses_what_it_does_not_know(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregates.aggregate(df, ["a"], [{"function": "collect_list", "column": "a"}])
    with pytest.raises(ValueError, match="cannot group by"):
        aggregates.aggregate(df, ["nope"], [{"function": "count", "column": "*"}])
    with pytest.raises(ValueError, match="unknown metric"):
        aggregates.named_aggregate(df, ["a"], ["margin"])


def test_total_mismatch(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(3,)], "y int")
    assert rows(joins.total_mismatch(a, b, F.sum("x"), F.sum("y"))) == [(3, 3, True)]
    assert rows(joins.total_mismatch(a, b, F.count("x"), F.sum("y"))) == [(2, 3, False)]


def test_first_and_last_are_the_plain_functions(spark):
    df = spark.createDataFrame([(1, None), (1, 5)], "k int, v int").coalesce(1)
    entries = [{"function": f, "column": "v", "alias": f} for f in ("first", "last")]
    assert rows(aggregates.aggregate(df, ["k"], entries)) == [(1, None, 5)]


def test_a_hot_key_is_split_before_a_count_by_it(spark):
    from millrace.plans.runner import build
    from millrace.plans.spec import job_of

    spark.range(400_000).selectExpr("IF(id % 3 > 0, 7, id % 5000) AS customer_id", "uuid() AS pad").createOrReplaceTempView("v_hot")
    spark.range(5000).selectExpr("id AS customer_id", "id % 10 AS country").createOrReplaceTempView("v_people")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        job = job_of({"source": {"table": "v_hot"}, "transformations": [
            {"operation": "join", "right_table": "v_people", "join_key": "customer_id", "join_type": "left"},
            {"operation": "aggregate", "params": {"group_by": ["country"], "aggregations": [
                {"function": "count_distinct", "column": "customer_id", "alias": "n"},
                {"function": "max", "column": "pad", "alias": "pad"}]}},
        ]})
        assert "skew=true" in ran_plan(build(spark, job))
    finally:
        for k in settings:
            spark.conf.unset(k)
