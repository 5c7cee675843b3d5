"""Physical layout: the content must not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import layout
from millrace.operators.joins import lookup_join
from millrace.sources import files, versioned
from millrace.sources.files import Dataset
from millrace.sources.shared import fresh_path
from registry import query
from registry.views import customers, orders, rounded, sql, table

_LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"
    )


@query(
    "j4_l1_size_gated_broadcast",
    sql(
        """SELECT country, count(*) AS orders, round(CAST(sum(order_amount) AS DOUBLE), 2) AS revenue
        FROM v_orders JOIN v_customers USING (customer_id) GROUP BY 1""",
        "orders",
        "customers",
    ),
)
def size_gated_broadcast(spark: SparkSession, folder: str) -> DataFrame:
    places = customers(spark, folder).select("customer_id", "country")
    joined = lookup_join(orders(spark, folder), places, ["customer_id"], limit_mb=10)
    return rounded(
        joined.groupBy("country").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("order_amount").alias("revenue")
        ),
        2,
        "revenue",
    )


@query(
    "l2_cached_reuse",
    "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1",
)
def cached_reuse(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "cached")
    with layout.cached(_lines(spark, folder), "lines") as lines:
        for flag in ("A", "N", "R"):
            part = lines.filter(F.col("l_returnflag") == flag)
            files.write(part.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows")),
                        Dataset(path=path, mode="append"))
    return files.read(spark, Dataset(path=path))


@query("l3_repartition_for_write", _LINES)
def repartition_for_write(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "sized")
    sized = layout.repartition_for_write(_lines(spark, folder), 1, ["l_returnflag"])
    files.write(sized, Dataset(path=path, partition_by=("l_returnflag",)))
    return files.read(spark, Dataset(path=path)).select(*_lines(spark, folder).columns)


@query("l4_coalesce_small_output", _LINES)
def coalesce_small_output(spark: SparkSession, folder: str) -> DataFrame:
    spread = layout.repartition_for_write(_lines(spark, folder), 0.1)
    return layout.coalesce_small_output(spread, 4)


@query("l5_optimized_write", _LINES)
def optimized_write(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(layout.repartition_for_write(_lines(spark, folder)), path)
    versioned.compact(spark, path, ["l_partkey"])
    return versioned.read(spark, path)
