"""Places in an order, found by narrowing, against plain sorts and windows."""

import datetime
import decimal
import random

import pytest
from conftest import plan, ran_plan
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordering, selection
from millrace.operators.selection import Key

SCHEMA = (
    "i int, s string, d double, m decimal(12,2), t timestamp, n timestamp_ntz, y date, b binary, z boolean, "
    "st struct<a: int, b: string>, ar array<int>, u long"
)


def values(n, seed=3):
    r = random.Random(seed)
    t = datetime.datetime(2024, 3, 31, 1, 30)

    def maybe(value):
        return None if r.random() < 0.1 else value

    return [
        (
            maybe(r.choice([r.randint(-5, 5), r.randint(-(2**31), 2**31 - 1)])), maybe(r.choice(["", "a", "é", str(r.random())])),
            maybe(r.choice([float("nan"), float("inf"), -0.0, 0.0, r.random(), 1e300])), maybe(decimal.Decimal(r.randint(-999, 999)) / 100),
            maybe(t + datetime.timedelta(minutes=r.randint(0, 90))), maybe(t + datetime.timedelta(minutes=r.randint(0, 90))),
            maybe(datetime.date(1, 1, 1) + datetime.timedelta(days=r.randint(0, 700_000))), maybe(bytes([r.randint(0, 255)])),
            maybe(r.random() < 0.5), maybe((maybe(r.randint(0, 3)), maybe(r.choice("ab")))), maybe([maybe(r.randint(0, 2)), 1]), k,
        )
        for k in range(n)
    ]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(values(3000), SCHEMA).repartition(4).cache()


@pytest.fixture
def small_samples(monkeypatch):
    monkeypatch.setattr(selection, "SAMPLED", 64)


@pytest.mark.parametrize("name", "i s d m t n y b z st ar".split())
def test_every_type(spark, mixed, small_samples, name):
    down = name in "sdnb"
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # with an hour that comes twice
    try:
        keys = [Key(F.col(name), mixed.schema[name].dataType, down), Key(F.col("u"), T.LongType())]
        order = [k.sorting for k in keys]
        want = [r.u for r in mixed.orderBy(*order).select("u").collect()]
        for skip in (290, 2950):
            got = [r.u for r in selection.rows_at(mixed, keys, skip, 60, bound=100).select("u").collect()]
            assert got == want[skip : skip + 60], (name, skip)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ties_in_several_keys(spark, small_samples):
    r = random.Random(1)
    df = spark.createDataFrame([(r.randint(0, 2), r.choice([None, 1, 2]), r.choice("abc")) for _ in range(4000)], "a int, b int, c string")
    order = [{"column": "a", "descending": True}, "b", "c"]
    want = [tuple(x) for x in df.orderBy(F.desc("a"), "b", "c").collect()]
    for skip in (1330, 3990, 5000):
        got = ordering.page(df, order, limit=25, offset=skip, bound=50)
        assert [tuple(x) for x in got.collect()] == want[skip : skip + 25]
        assert "Window" not in plan(got)


def test_pages_make_up_the_listing(spark, small_samples):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), F.lit("x").alias("v"), (F.col("id") % 400).alias("w"))
    pages = [tuple(r) for at in range(0, 2000, 500) for r in ordering.page(df, ["k"], limit=500, offset=at, bound=60).collect()]
    assert sorted(pages) == sorted(tuple(r) for r in df.collect())


def test_equal_rows_are_only_counted(spark, small_samples):
    df = spark.range(5000).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    got = ordering.page(df, ["a"], limit=10, offset=4000, bound=50)
    assert "Sort" not in plan(got) and "TakeOrdered" not in plan(got) and got.count() == 10


def test_a_far_page_reads_what_it_needs(spark, folder, small_samples):
    spark.range(0, 50_000, 1, 8).select(F.xxhash64("id").alias("k"), "id").repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    got = ordering.page(df, ["k"], limit=20, offset=40_000, bound=500)
    assert [r.k for r in got.collect()] == [r.k for r in df.orderBy("k").offset(40_000).limit(20).collect()]
    assert "GreaterThan(k" in ran_plan(got).replace("OrEqual", "") and "Window" not in plan(got)


def test_empty_and_edges(spark):
    none = spark.createDataFrame([], "k int, v string")
    assert ordering.page(none, ["k"], limit=5).collect() == []
    one = spark.createDataFrame([(None, "a")], "k int, v string")
    assert ordering.page(one, ["k"], limit=5).count() == 1 and ordering.page(one, ["k"], limit=5, offset=1).count() == 0
    with pytest.raises(TypeError):
        selection.collectable(F.col("m"), T.MapType(T.StringType(), T.StringType()))


@pytest.mark.parametrize("bound", [40, 10_000])
def test_ntiles_of_several_orders(spark, mixed, small_samples, bound):
    orders = {"by_i": ["i", "u"], "by_s": ["s", "u"], "by_t": ["t", "d", "u"], "by_m": ["m", "u"]}
    got = ordering.ntiles(mixed.select("i", "s", "t", "d", "m", "u"), orders, 5, bound)
    windows = {f"w_{name}": F.ntile(5).over(Window.orderBy(*order)) for name, order in orders.items()}
    both = got.join(mixed.select("u", *[w.alias(n) for n, w in windows.items()]), "u")
    wrong = both.where(" OR ".join(f"{n} IS DISTINCT FROM w_{n}" for n in orders))
    assert both.count() == 3000 and wrong.count() == 0
    assert "Window" not in plan(got)


@pytest.mark.parametrize("n", [0, 1, 3, 5, 6])
def test_fewer_rows_than_buckets(spark, n):
    df = spark.range(n).select("id")
    got = {r.id: r.b for r in ordering.ntile(df, ["id"], 5, "b").collect()}
    want = {r.id: r.b for r in df.select("id", F.ntile(5).over(Window.orderBy("id")).alias("b")).collect()}
    assert got == want


def test_keys_at_ranks_with_ties(spark, small_samples):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50).cast("int").alias("v"))
    want = sorted(r.v for r in df.collect())
    ranks = [1, 500, 900, 2000, 4500, 5999, 6000, 6001]
    got = selection.keys_at(df, {"v": F.struct("v")}, {"v": ranks}, bound=40)["v"]
    found = spark.range(1).select(*[got[r]["v"].alias(str(r)) for r in got]).first().asDict()
    assert {int(r): v for r, v in found.items()} == {r: want[r - 1] for r in ranks[:-1]}
