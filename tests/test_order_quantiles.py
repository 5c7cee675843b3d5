import math
import random
from fractions import Fraction

import pytest
from conftest import plan, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ordering, quantiles


@pytest.fixture
def many_ranges(spark):
    """Small ranges are not joined, so that small data has several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def disc(values, p):
    """Smallest value with at least p * n of the n values at or below it."""
    ordered = sorted(v for v in values if v is not None)
    if not ordered:
        return None
    wanted = max(1, math.ceil(Fraction(str(p)) * len(ordered)))
    return float(ordered[wanted - 1])


CASES = {
    "different": lambda r: [r.random() for _ in range(4000)],
    "ties": lambda r: [r.randint(1, 5) for _ in range(4000)],
    "hot": lambda r: [7 if r.random() < 0.4 else r.randint(1, 10**6) for _ in range(4000)],
    "nulls": lambda r: [None if r.random() < 0.3 else r.gauss(0, 1) for _ in range(4000)],
    "one": lambda r: [3],
    "few": lambda r: [5, 1, 4, 2, 3, 9, 8],
    "thirty-five": lambda r: list(range(35)),
    "negative": lambda r: [r.randint(-50, 50) / 4 for _ in range(777)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_points_against_sorting(spark, name, accuracy):
    values = CASES[name](random.Random(11))
    other = [(i * 37) % 101 for i in range(len(values))]
    df = spark.createDataFrame(
        [(None if v is None else float(v), o) for v, o in zip(values, other)], "a double, b int"
    )
    got = quantiles.quantile_points(df, ["a", "b"], accuracy=accuracy).first()
    assert list(got.a) == [disc(values, p) for p in quantiles.QUINTILES]
    assert list(got.b) == [disc(other, p) for p in quantiles.QUINTILES]


def test_points_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "a double")
    assert list(quantiles.quantile_points(df, ["a"]).first().a) == [None] * 4
    scored = quantiles.add_quintile_scores(df, {"s": ("a", False)})
    assert scored.count() == 0


def test_sketch_points_are_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("a"))
    got = quantiles.quantile_points(df, ["a"], exact=False, accuracy=1000).first().a
    assert all(abs(v - 10000 * p) <= 20 for v, p in zip(got, quantiles.QUINTILES))


def test_scores_and_their_reverse(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "a double")
    got = quantiles.add_quintile_scores(df, {"up": ("a", False), "down": ("a", True)})
    by_value = {r.a: (r.up, r.down) for r in got.collect()}
    assert [by_value[float(i)][0] for i in range(1, 11)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [by_value[float(i)][1] for i in range(1, 11)] == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    assert by_value[None] == (5, 1)


def test_few_rows_of_a_bracket_reach_one_task(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("a"))
    ends = quantiles._brackets(df, ["a"], quantiles.QUINTILES, 10_000)
    counted = quantiles._counted_values(df, ["a"], ends, quantiles.QUINTILES)
    assert counted.count() < 200_000 / 200


@pytest.mark.parametrize("rows_of, n", [(23, 5), (3, 5), (100, 7), (5, 5)])
def test_ntile_equals_the_window_function(spark, many_ranges, rows_of, n):
    df = spark.range(rows_of).select("id", (F.col("id") * 13 % 4).alias("m"))
    expected = df.withColumn("b", F.ntile(n).over(Window.orderBy("m", "id")).cast("bigint"))
    got = ordering.ntile(df, ["m", "id"], n, "b")
    assert rows(got.select("id", "m", "b")) == rows(expected)


def test_global_rank_with_a_hot_value(spark, many_ranges):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("v"))
    got = ordering.global_rank(df, [{"column": "v", "descending": True}, "id"])
    expected = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).cast("bigint"))
    assert rows(got.select("id", "v", "rank")) == rows(expected)
    assert got.select("rank_total").distinct().first()[0] == 5000


def test_running_total_with_a_hot_group_and_null_group(spark, many_ranges):
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    df = spark.range(6000).select("id", group.alias("g"), F.nullif(F.col("id") % 11, F.lit(4)).alias("v"))
    got = ordering.running_total(df, ["g"], ["id"], {"upto": "v"})
    window = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("upto", F.coalesce(F.sum("v").over(window), F.lit(0)))
    assert rows(got) == rows(expected)


def test_a_hot_group_is_cut_into_ranges(spark, many_ranges):
    df = spark.range(8000).select("id", F.lit("only").alias("g"))
    sliced = ordering._in_slices(df.repartition(8), F.col("g"), F.col("id"))
    assert sliced.select("_slice").distinct().count() > 1


@pytest.mark.parametrize("strategy, kept", [("keep_first", "x"), ("keep_last", "z")])
def test_dedupe_keeps_one_by_order(spark, strategy, kept):
    df = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (1, 3, "z"), (2, 1, "q")], "k int, o int, v string")
    got = {r.k: r.v for r in ordering.dedupe(df, ["k"], ["o"], strategy).collect()}
    assert got == {1: kept, 2: "q"}
    assert ordering.dedupe(df, ["k"], ["o"], "keep_all").count() == 4
    with pytest.raises(ValueError):
        ordering.dedupe(df, ["k"], ["o"], "keep_some")


def test_dedupe_settles_ties_by_the_other_columns(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, None)], "k int, o int, v string")
    assert rows(ordering.dedupe(df, ["k"], ["o"])) == [(1, 1, None)]
    assert rows(ordering.dedupe(df, ["k"], ["o"], "keep_last")) == [(1, 1, "b")]


def test_dedupe_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(ordering.dedupe(df.repartition(4), ["k"], ["id"]))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_sort_puts_nulls_first_then_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    up = [r.a for r in ordering.sort_rows(df, ["a"]).collect()]
    down = [r.a for r in ordering.sort_rows(df, [{"column": "a", "descending": True}]).collect()]
    assert up == [None, 1, 2] and down == [2, 1, None]


def test_a_hot_sort_value_is_spread(spark):
    df = spark.range(20000).select(F.lit("same").alias("a"), "id").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = ordering.sort_rows(df, ["a"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pages_at_any_depth(spark):
    df = spark.range(1000)
    order = [{"column": "id", "descending": True}]
    assert ordering.page(df, order, limit=5000).count() == 1000
    assert [r.id for r in ordering.page(df, order, limit=2, offset=10).collect()] == [989, 988]
    assert [r.id for r in ordering.page(df, order, limit=3, offset=500).collect()] == [499, 498, 497]
    assert ordering.page(df, order, limit=3, offset=1000).collect() == []


def test_pages_of_ties_and_nulls_are_the_whole_listing(spark):
    df = spark.range(700).select(F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"), "id")
    order = [{"column": "k", "descending": True}]
    pages = [ordering.page(df, order, limit=70, offset=o).collect() for o in range(0, 700, 70)]
    listing = [r for p in pages for r in p]
    assert sorted(r.id for r in listing) == list(range(700))
    assert [r.k for r in listing] == sorted((r.k for r in listing), key=lambda k: (k is None, -(k or 0)))


def test_pages_in_descending_order_of_any_type(spark):
    df = spark.range(300).selectExpr(
        "id", "IF(id % 7 = 0, NULL, id % 11) AS whole", "IF(id % 5 = 0, double('NaN'), IF(id % 6 = 0, NULL, id % 4 - 1.5D)) AS frac",
        "date_add(DATE'2024-01-01', int(id % 9)) AS day", "string(id % 3) AS text", "CAST(id % 8 AS DECIMAL(9,2)) AS money",
    )
    for name in df.columns[1:]:
        order = [{"column": name, "descending": True}, "id"]
        wanted = [r.id for r in df.orderBy(F.col(name).desc(), "id").collect()]
        assert [r.id for r in ordering.page(df, order, limit=40, offset=120).collect()] == wanted[120:160]
