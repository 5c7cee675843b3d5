"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import safe_ratio
from millrace.operators import aggregates, distinct, quantiles
from millrace.plans import geo
from millrace.plans.runner import build
from millrace.plans.spec import job_of
from registry import query
from registry.views import (
    REFERENCE_DATE,
    campaigns,
    customers,
    dates_as_text,
    items,
    orders,
    place,
    register,
    rounded,
    sql,
    table,
)


@query(
    "a1_aggregate_step",
    sql(
        """SELECT priority, status, count(order_id) AS orders,
          count(DISTINCT customer_id) AS customers,
          round(CAST(sum(order_amount) AS DOUBLE), 2) AS revenue,
          round(CAST(sum(order_amount) AS DOUBLE) / count(order_amount), 4) AS mean_amount,
          CAST(min(order_date) AS VARCHAR) AS first_day, CAST(max(order_date) AS VARCHAR) AS last_day
        FROM v_orders GROUP BY ALL""",
        "orders",
    ),
)
def aggregate_step(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders")
    entries = [
        ("count", "order_id", "orders"),
        ("countDistinct", "customer_id", "customers"),
        ("sum", "order_amount", "revenue"),
        ("avg", "order_amount", "mean_amount"),
        ("min", "order_date", "first_day"),
        ("max", "order_date", "last_day"),
    ]
    step = {
        "operation": "aggregate",
        "params": {
            "group_by": ["priority", "status"],
            "aggregations": [{"function": f, "column": c, "alias": a} for f, c, a in entries],
        },
    }
    df = build(spark, job_of({"source": place("orders"), "transformations": [step]}))
    return dates_as_text(
        rounded(rounded(df, 2, "revenue"), 4, "mean_amount"), "first_day", "last_day"
    )


@query(
    "a2_group_by_expression",
    sql(
        """SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS year,
          CAST(month(order_purchase_timestamp) AS INTEGER) AS month,
          left(priority, 1) AS urgency, count(*) AS orders
        FROM v_orders GROUP BY ALL""",
        "orders",
    ),
)
def group_by_expression(spark: SparkSession, folder: str) -> DataFrame:
    groups = [
        "year(order_purchase_timestamp)",
        "month(order_purchase_timestamp)",
        "left(priority, 1) AS urgency",
    ]
    entry = {"function": "count", "column": "*", "alias": "orders"}
    return aggregates.aggregate(orders(spark, folder), groups, [entry])


@query(
    "a3_count",
    sql("SELECT customer_segment, count(email) AS emails FROM v_customers GROUP BY 1", "customers"),
)
def count(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).groupBy("customer_segment").agg(F.count("email").alias("emails"))


@query(
    "a4_sum",
    sql(
        "SELECT seller_id, round(CAST(sum(price) AS DOUBLE), 4) AS revenue FROM v_items GROUP BY 1",
        "items",
    ),
)
def total(spark: SparkSession, folder: str) -> DataFrame:
    entry = {"function": "sum", "column": "price", "alias": "revenue"}
    return rounded(aggregates.aggregate(items(spark, folder), ["seller_id"], [entry]), 4, "revenue")


@query(
    "a5_avg",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_quantity FROM lineitem GROUP BY ALL",
)
def average(spark: SparkSession, folder: str) -> DataFrame:
    entry = {"function": "avg", "column": "l_quantity", "alias": "avg_quantity"}
    df = aggregates.aggregate(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], [entry]
    )
    return rounded(df, 6, "avg_quantity")


@query(
    "a6_min_max",
    "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, max(value) AS top FROM events GROUP BY 1",
)
def min_max(spark: SparkSession, folder: str) -> DataFrame:
    entries = [
        {"function": "min", "column": "ts", "alias": "first_seen"},
        {"function": "max", "column": "ts", "alias": "last_seen"},
        {"function": "max", "column": "value", "alias": "top"},
    ]
    return aggregates.aggregate(table(spark, folder, "events"), ["user_id"], entries)


@query(
    "a7_count_distinct",
    sql(
        "SELECT seller_id, count(DISTINCT product_id) AS products FROM v_items GROUP BY 1",
        "items",
    ),
)
def count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    entry = {"function": "countDistinct", "column": "product_id", "alias": "products"}
    return aggregates.aggregate(items(spark, folder), ["seller_id"], [entry])


@query(
    "a8_conditional_count",
    """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchases,
      count(*) FILTER (event_type = 'view' AND value > 50) AS long_views FROM events GROUP BY 1""",
)
def conditional_count(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if((kind == "view") & (F.col("value") > 50)).alias("long_views"),
    )


@query(
    "a9_ratio_and_flag",
    sql(
        """SELECT region, round(CAST(sum(order_amount) AS DOUBLE) / count(DISTINCT customer_id), 4)
          AS revenue_per_customer, sum(order_amount) > 600000000 AS is_high_value
        FROM v_orders JOIN v_customers USING (customer_id) GROUP BY 1""",
        "orders",
        "customers",
    ),
)
def ratio_and_flag(spark: SparkSession, folder: str) -> DataFrame:
    per_customer = orders(spark, folder).groupBy("customer_id").agg(F.sum("order_amount").alias("spent"))
    places = customers(spark, folder).select("customer_id", "region")
    totals = per_customer.join(places, "customer_id").groupBy("region").agg(
        F.sum("spent").alias("revenue"), F.count_distinct("customer_id").alias("people")
    )
    return totals.select(
        "region",
        F.round(safe_ratio(F.col("revenue"), F.col("people")), 4).alias("revenue_per_customer"),
        (F.col("revenue") > 600000000).alias("is_high_value"),
    )


_RANKED = """
  SELECT {columns}
  FROM (SELECT *, row_number() OVER (ORDER BY amount) AS ra, row_number() OVER (ORDER BY orders) AS ro,
      count(*) OVER () AS n
    FROM (SELECT customer_id, CAST(sum(order_amount) AS DOUBLE) AS amount,
        CAST(count(*) AS DOUBLE) AS orders
      FROM v_orders GROUP BY 1))
"""
_POINTS = ", ".join(
    f"min({c}) FILTER (5 * {r} >= {i} * n) AS {c}_{i}"
    for c, r in (("amount", "ra"), ("orders", "ro"))
    for i in (1, 2, 3, 4)
)


def _customer_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).groupBy("customer_id").agg(
        F.sum("order_amount").alias("amount"), F.count(F.lit(1)).alias("orders")
    )


def _spread(points: DataFrame) -> DataFrame:
    return points.select(
        *[F.get(c, F.lit(i)).alias(f"{c}_{i + 1}") for c in ("amount", "orders") for i in range(4)]
    )


@query("a10_quantile_points", sql(_RANKED.format(columns=_POINTS), "orders"))
def quantile_points(spark: SparkSession, folder: str) -> DataFrame:
    df = _customer_amounts(spark, folder)
    return _spread(quantiles.quantile_points(df, ["amount", "orders"]))


@query(
    "a10_quantile_sketch",
    """SELECT metric, step, true AS within FROM (VALUES ('amount'), ('orders')) AS m(metric),
      (VALUES (0), (1), (2), (3)) AS s(step)""",
)
def quantile_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the rank of each point of the sketch is within the sketch's error bound."""
    df = _customer_amounts(spark, folder)
    points = quantiles.quantile_points(df, ["amount", "orders"], exact=False)
    found = None
    for metric in ("amount", "orders"):
        steps = points.select(F.posexplode(metric).alias("step", "point"), F.array(*map(F.lit, quantiles.QUINTILES)).alias("p"))
        bundle = steps.agg(F.array_sort(F.collect_list(F.struct("step", "point", F.get("p", F.col("step")).alias("p")))).alias("s")).scalar()
        value = F.col(metric).cast("double")
        ranks = df.select(value.alias("v"), F.explode(bundle).alias("s")).groupBy("s").agg(
            F.count_if(F.col("v") < F.col("s.point")).alias("below"),
            F.count_if(F.col("v") <= F.col("s.point")).alias("upto"), F.count("v").alias("n"),
        )
        wanted, error = F.col("s.p") * F.col("n"), F.col("n") / quantiles.ACCURACY + 1
        within = (F.col("below") - error <= wanted) & (wanted <= F.col("upto") + error)
        rows = ranks.select(F.lit(metric).alias("metric"), F.col("s.step").alias("step"), within.alias("within"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "a11_global_aggregate",
    """SELECT round(avg(l_quantity), 4) AS avg_quantity, round(avg(l_discount), 4) AS avg_discount,
      count(*) AS rows FROM lineitem""",
)
def global_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    entries = [
        {"function": "avg", "column": "l_quantity", "alias": "avg_quantity"},
        {"function": "avg", "column": "l_discount", "alias": "avg_discount"},
        {"function": "count", "column": "*", "alias": "rows"},
    ]
    df = aggregates.aggregate(table(spark, folder, "lineitem"), [], entries)
    return rounded(df, 4, "avg_quantity", "avg_discount")


@query(
    "a12_distinct_count",
    sql(
        "SELECT count(*) AS distinct_values FROM (SELECT DISTINCT country FROM v_customers)",
        "customers",
    ),
)
def distinct_count(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.distinct_count(customers(spark, folder), "country")


@query(
    "a13_named_metrics",
    sql(
        f"""SELECT priority, round(CAST(sum(order_amount) AS DOUBLE), 2) AS total_revenue,
          count(order_id) AS order_count,
          round(CAST(sum(order_amount) AS DOUBLE) / count(order_amount), 4) AS avg_order_value,
          count(DISTINCT customer_id) AS customer_count,
          round(CAST(sum(order_amount) AS DOUBLE) / count(DISTINCT customer_id), 4)
            AS avg_spend_per_customer,
          CAST(date_diff('day', max(order_date), DATE '{REFERENCE_DATE}') AS INTEGER) AS recency_days
        FROM v_orders GROUP BY 1""",
        "orders",
    ),
)
def named_metrics(spark: SparkSession, folder: str) -> DataFrame:
    names = [
        "total_revenue",
        "order_count",
        "avg_order_value",
        "customer_count",
        "avg_spend_per_customer",
        "recency_days",
    ]
    df = aggregates.named_aggregate(orders(spark, folder), ["priority"], names, REFERENCE_DATE)
    return rounded(
        rounded(df, 2, "total_revenue"), 4, "avg_order_value", "avg_spend_per_customer"
    )


@query(
    "a14_group_count",
    sql("SELECT product_family, count(*) AS count FROM v_campaigns GROUP BY 1", "campaigns"),
)
def group_count(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.group_count(campaigns(spark, folder), "product_family")


@query(
    "a15_two_level_rollup",
    sql(
        """SELECT country, round(CAST(sum(revenue) AS DOUBLE), 2) AS country_revenue,
          CAST(sum(people) AS BIGINT) AS total_customers
        FROM (SELECT country, region, sum(order_amount) AS revenue,
            count(DISTINCT customer_id) AS people
          FROM v_orders LEFT JOIN v_customers USING (customer_id) GROUP BY ALL) GROUP BY 1""",
        "orders",
        "customers",
    ),
)
def two_level_rollup(spark: SparkSession, folder: str) -> DataFrame:
    per_region = geo.geo_revenue(orders(spark, folder), customers(spark, folder))
    return rounded(geo.country_rollup(per_region), 2, "country_revenue")


@query(
    "a15_distinct_rollup",
    sql(
        """SELECT region, country, count(DISTINCT product_id) AS products FROM
          (SELECT region, country, product_id FROM v_items JOIN
            (SELECT s_suppkey AS seller_id, n_name AS country, r_name AS region FROM supplier
              JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) USING (seller_id))
        GROUP BY GROUPING SETS ((region, country), (region), ())""",
        "items",
    ),
)
def distinct_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Different products sold per country, region and in all, each level from the bitmaps of the one below;
    most products are sold from several countries and regions."""
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    )
    sold = items(spark, folder).select("seller_id", "product_id").join(places, "seller_id")
    per_country = distinct.group_bitmaps(sold, ["region", "country"], "product_id")
    per_region = distinct.united(per_country, ["region"])
    levels = [
        distinct.counted(per_country, ["region", "country"], "products"),
        distinct.counted(per_region, ["region"], "products").withColumn("country", F.lit(None).cast("string")),
        distinct.counted(per_region, [], "products").withColumns({c: F.lit(None).cast("string") for c in ("region", "country")}),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2]).select("region", "country", "products")
