"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.columns import zero_fill
from millrace.operators.joins import lookup_join
from millrace.plans.runner import build
from millrace.plans.spec import job_of
from registry import query
from registry.views import (
    campaigns,
    customers,
    items,
    of_urgent,
    orders,
    payments,
    place,
    products,
    register,
    rounded,
    sql,
    table,
    translation,
)


@query(
    "j1_join_step",
    sql(
        """SELECT order_id, customer_id, customer_name, country
        FROM v_orders JOIN v_customers USING (customer_id)""",
        "orders",
        "customers",
    ),
)
def join_step(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders", "customers")
    step = {"operation": "join", "config": {"right_table": "v_customers", "on": "customer_id"}}
    df = build(spark, job_of({"source": place("orders"), "transformations": [step]}))
    return df.select("order_id", "customer_id", "customer_name", "country")


_SIDES = """
  WITH l AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey - 1 END AS k, c_nationkey FROM customer),
    r AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_custkey
        ELSE o_custkey + 1000000000000 END AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1)
"""


@query(
    "j2_join_types",
    _SIDES
    + """
  SELECT 'inner' AS kind, count(*) AS rows, count(c_nationkey) AS placed,
    round(CAST(sum(spent) AS DOUBLE), 2) AS spent FROM l JOIN r USING (k)
  UNION ALL SELECT 'left', count(*), count(c_nationkey), round(CAST(sum(spent) AS DOUBLE), 2)
    FROM l LEFT JOIN r USING (k)
  UNION ALL SELECT 'right', count(*), count(c_nationkey), round(CAST(sum(spent) AS DOUBLE), 2)
    FROM l RIGHT JOIN r USING (k)
  UNION ALL SELECT 'full', count(*), count(c_nationkey), round(CAST(sum(spent) AS DOUBLE), 2)
    FROM l FULL JOIN r USING (k)
  UNION ALL SELECT 'left_semi', count(*), count(c_nationkey), 0.0
    FROM l WHERE k IN (SELECT k FROM r)
  UNION ALL SELECT 'left_anti', count(*), count(c_nationkey), 0.0
    FROM l WHERE k NOT IN (SELECT k FROM r)""",
)
def join_types(spark: SparkSession, folder: str) -> DataFrame:
    left = (
        table(spark, folder, "customer")
        .select(
            F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey") - 1).alias("k"),
            "c_nationkey",
        )
    )
    right = (
        table(spark, folder, "orders")
        .groupBy(
            F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_custkey"))
            .otherwise(F.col("o_custkey") + 1_000_000_000_000)
            .alias("k")
        )
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    )
    results = []
    for kind in joins.JOIN_TYPES:
        joined = joins.equi_join(left, right, ["k"], kind)
        spent = F.sum("spent") if "spent" in joined.columns else F.lit(0)
        results.append(
            joined.agg(
                F.count(F.lit(1)).alias("rows"),
                F.count("c_nationkey").alias("placed"),
                spent.cast("double").alias("spent"),
            ).withColumn("kind", F.lit(kind))
        )
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    return rounded(merged, 2, "spent")


@query(
    "j3_j4_lookup_join",
    sql(
        """SELECT region, country, count(*) AS orders, round(CAST(sum(order_amount) AS DOUBLE), 2)
          AS revenue
        FROM v_orders LEFT JOIN v_customers USING (customer_id) GROUP BY ALL""",
        "orders",
        "customers",
    ),
)
def dimension_join(spark: SparkSession, folder: str) -> DataFrame:
    places = joins.pick_columns(customers(spark, folder), "customer_id", "country", "region")
    joined = lookup_join(orders(spark, folder), places, ["customer_id"], "left")
    return rounded(
        joined.groupBy("region", "country").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("order_amount").alias("revenue")
        ),
        2,
        "revenue",
    )


@query(
    "j5_left_join_zero_fill",
    sql(
        """SELECT customer_id, coalesce(order_count, 0) AS order_count,
          coalesce(round(CAST(spent AS DOUBLE), 2), 0) AS total_spend
        FROM v_customers LEFT JOIN (SELECT customer_id, count(order_id) AS order_count,
            sum(order_amount) AS spent FROM (SELECT * REPLACE (CASE WHEN order_status = 'delivered'
              AND priority = '1-URGENT' THEN customer_id END AS customer_id) FROM v_orders) GROUP BY 1)
          USING (customer_id)""",
        "orders",
        "customers",
    ),
)
def left_zero_fill(spark: SparkSession, folder: str) -> DataFrame:
    urgent = of_urgent(orders(spark, folder))
    totals = urgent.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"), F.sum("order_amount").alias("total_spend")
    )
    people = customers(spark, folder).select("customer_id")
    return rounded(zero_fill(joins.equi_join(people, totals, ["customer_id"], "left")), 2, "total_spend")


@query(
    "j6_star_join",
    sql(
        """SELECT year, product_category_name, count(*) AS rows,
          round(CAST(sum(payment_value) AS DOUBLE), 2) AS paid
        FROM v_orders JOIN v_payments USING (order_id) JOIN v_items USING (order_id)
          LEFT JOIN v_products USING (product_id) GROUP BY ALL""",
        "orders",
        "payments",
        "items",
        "products",
    ),
)
def star_join(spark: SparkSession, folder: str) -> DataFrame:
    sold = lookup_join(
        items(spark, folder).select("order_id", "product_id"),
        products(spark, folder).select("product_id", "product_category_name"),
        ["product_id"],
        "left",
    )
    paid = payments(spark, folder).select("order_id", F.col("payment_value").alias("paid"))
    bought = orders(spark, folder).select("order_id", "year")
    groups = ["year", "product_category_name"]
    return rounded(joins.star_join(bought, "order_id", paid, sold, groups, ["paid"]), 2, "paid")


@query(
    "j7_translation_join",
    sql(
        """SELECT product_id, product_category_name, product_category_name_english
        FROM v_products LEFT JOIN v_translation USING (product_category_name)""",
        "translation",
    ),
)
def translation_join(spark: SparkSession, folder: str) -> DataFrame:
    return lookup_join(
        products(spark, folder).select("product_id", "product_category_name"),
        translation(spark, folder),
        ["product_category_name"],
        "left",
    )


@query(
    "j8_result_join",
    sql(
        """SELECT customer_id, order_count, lines FROM
          (SELECT customer_id, count(*) AS order_count FROM v_orders GROUP BY 1)
          JOIN (SELECT customer_id, count(*) AS lines FROM v_items JOIN v_orders USING (order_id)
            GROUP BY 1) USING (customer_id)""",
        "orders",
        "items",
    ),
)
def result_join(spark: SparkSession, folder: str) -> DataFrame:
    bought = orders(spark, folder)
    counts = bought.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"))
    per_order = items(spark, folder).groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    lines = (
        per_order.join(bought.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id")
        .agg(F.sum("n").alias("lines"))
    )
    return joins.equi_join(counts, lines, ["customer_id"])


@query(
    "j9_orphans",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey - 1 END FROM customer)""",
)
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey") - 1)
    solvent = table(spark, folder, "customer").select(key.alias("c_custkey"))
    bought = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return joins.orphans(bought, solvent.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


@query(
    "j10_geo_lookup",
    """SELECT c_custkey, c_nationkey AS prefix, round(CAST(lat AS DOUBLE), 4) AS lat,
      round(CAST(lng AS DOUBLE), 4) AS lng
    FROM customer LEFT JOIN (SELECT s_nationkey AS c_nationkey,
        CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(s_acctbal) AS lat,
        CAST(sum(s_suppkey) AS DOUBLE) / count(s_suppkey) AS lng
      FROM supplier GROUP BY 1) USING (c_nationkey)""",
)
def geo_lookup(spark: SparkSession, folder: str) -> DataFrame:
    places = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("prefix"),
        F.col("s_acctbal").cast("decimal(18,2)").alias("lat"),
        F.col("s_suppkey").alias("lng"),
    )
    reduced = joins.one_row_per_key(
        places,
        ["prefix"],
        (F.sum("lat").cast("double") / F.count("lat")).alias("lat"),
        (F.sum("lng").cast("double") / F.count("lng")).alias("lng"),
    )
    people = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("prefix")
    )
    return rounded(lookup_join(people, reduced, ["prefix"], "left"), 4, "lat", "lng")


@query(
    "a16_reconciled_totals",
    sql(
        """SELECT round(CAST(sum(payment_value) AS DOUBLE), 2) AS left_total,
          round(CAST((SELECT sum(order_amount) FROM v_orders) AS DOUBLE), 2) AS right_total,
          sum(payment_value) = (SELECT sum(order_amount) FROM v_orders) AS passed
        FROM v_payments""",
        "payments",
    ),
)
def reconciled(spark: SparkSession, folder: str) -> DataFrame:
    result = joins.total_mismatch(
        payments(spark, folder),
        orders(spark, folder),
        F.sum("payment_value"),
        F.sum("order_amount"),
    )
    return rounded(result, 2, "left_total", "right_total")


@query(
    "j5_campaign_orders",
    sql(
        """SELECT campaign_id, coalesce(order_count, 0) AS order_count,
          coalesce(round(CAST(o.revenue AS DOUBLE), 2), 0) AS order_revenue
        FROM v_campaigns LEFT JOIN (SELECT campaign_id, count(order_id) AS order_count,
            sum(order_amount) AS revenue FROM v_orders WHERE contains(product_family, '_3')
            GROUP BY 1) o USING (campaign_id)""",
        "campaigns",
        "orders",
    ),
)
def campaign_orders(spark: SparkSession, folder: str) -> DataFrame:
    totals = (
        orders(spark, folder)
        .filter(F.col("product_family").contains("_3"))
        .groupBy("campaign_id")
        .agg(F.count("order_id").alias("order_count"), F.sum("order_amount").alias("order_revenue"))
    )
    base = campaigns(spark, folder).select("campaign_id")
    return rounded(
        zero_fill(joins.equi_join(base, totals, ["campaign_id"], "left")), 2, "order_revenue"
    )
