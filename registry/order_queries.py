"""Windows, sorting, paging and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.plans import records, rfm
from millrace.plans.runner import build
from millrace.plans.spec import job_of
from registry import query
from registry.views import (
    REFERENCE_DATE,
    calls,
    customers,
    dates_as_text,
    items,
    orders,
    place,
    products,
    register,
    rounded,
    runs,
    sql,
    table,
)


@query(
    "w1_ntile_scores",
    sql(
        f"""SELECT *, r_score + f_score + m_score AS rfm_score,
          CASE WHEN r_score + f_score + m_score >= 13 THEN 'Champions'
            WHEN r_score + f_score + m_score >= 10 THEN 'Loyal Customers'
            WHEN r_score + f_score + m_score >= 7 THEN 'Potential Loyalists'
            WHEN r_score + f_score + m_score >= 4 THEN 'At Risk' ELSE 'Lost' END AS rfm_segment
        FROM (SELECT customer_id,
            6 - ntile(5) OVER (ORDER BY recency_days, customer_id) AS r_score,
            ntile(5) OVER (ORDER BY frequency, customer_id) AS f_score,
            ntile(5) OVER (ORDER BY monetary, customer_id) AS m_score
          FROM (SELECT customer_id, date_diff('day', max(order_date), DATE '{REFERENCE_DATE}')
              AS recency_days, count(order_id) AS frequency, sum(order_amount) AS monetary
            FROM v_orders GROUP BY 1))""",
        "orders",
    ),
)
def ntile_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_scores_by_rank(orders(spark, folder), REFERENCE_DATE).select(
        "customer_id", "r_score", "f_score", "m_score", "rfm_score", "rfm_segment"
    )


def _dedupe_sql(direction: str) -> str:
    tie = ", ".join(
        f"{c} {direction}"
        for c in ("ship_date", "seller_id", "price", "freight_value", "qty", "return_flag")
    )
    return sql(
        f"""SELECT order_id, product_id, order_item_id, seller_id, qty,
          CAST(ship_date AS VARCHAR) AS ship_date FROM (
          SELECT *, row_number() OVER (PARTITION BY order_id, product_id
            ORDER BY order_item_id {direction}, {tie}) AS n FROM v_items) WHERE n = 1""",
        "items",
    )


def _kept(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    df = items(spark, folder).select(
        "order_id",
        "product_id",
        "order_item_id",
        "ship_date",
        "seller_id",
        "price",
        "freight_value",
        "qty",
        "return_flag",
    )
    kept = ordering.dedupe(df, ["order_id", "product_id"], ["order_item_id"], strategy)
    shown = kept.select("order_id", "product_id", "order_item_id", "seller_id", "qty", "ship_date")
    return dates_as_text(shown, "ship_date")


@query("w2_keep_first", _dedupe_sql("ASC"))
def keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "keep_first")


@query("w2_keep_last", _dedupe_sql("DESC"))
def keep_last(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "keep_last")


@query(
    "w3_running_tokens",
    sql(
        """SELECT run_id, seq, model, input_tokens, output_tokens,
          input_tokens + output_tokens AS tokens,
          CAST(sum(input_tokens + output_tokens) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT)
            AS cumulative_tokens
        FROM v_calls""",
        "calls",
    ),
)
def running_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return records.usage_steps(calls(spark, folder))


@query(
    "w4_current_state",
    """SELECT user_id AS run_id, event_id, event_type AS status, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
      FROM events) WHERE n = 1""",
)
def current_state(spark: SparkSession, folder: str) -> DataFrame:
    moves = table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("status"), "ts"
    )
    return records.current_states(moves)


@query(
    "o1_sort_step",
    sql(
        """SELECT customer_id, country, customer_name FROM v_customers
        ORDER BY country ASC NULLS FIRST, customer_name DESC NULLS LAST, customer_id""",
        "customers",
    ),
)
def sort_step(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "customers")
    step = {
        "operation": "sort",
        "params": {
            "sort_columns": [
                {"column": "country"},
                {"column": "customer_name", "descending": True},
                "customer_id",
            ]
        },
    }
    df = build(spark, job_of({"source": place("customers"), "transformations": [step]}))
    return df.select("customer_id", "country", "customer_name")


@query(
    "o2_global_order",
    sql(
        """SELECT seller_id, round(CAST(sum(price) AS DOUBLE), 4) AS total_revenue FROM v_items
        GROUP BY 1 ORDER BY 2 DESC, 1""",
        "items",
    ),
)
def global_order(spark: SparkSession, folder: str) -> DataFrame:
    totals = items(spark, folder).groupBy("seller_id").agg(F.sum("price").alias("total_revenue"))
    return rounded(
        ordering.sort_rows(totals, [{"column": "total_revenue", "descending": True}, "seller_id"]),
        4,
        "total_revenue",
    )


@query(
    "o3_multi_key_sort",
    sql(
        """SELECT order_id, round(CAST(order_amount AS DOUBLE), 2) AS total,
          CAST(order_date AS VARCHAR) AS order_date FROM v_orders
        ORDER BY order_amount DESC, v_orders.order_date DESC, order_id""",
        "orders",
    ),
)
def multi_key_sort(spark: SparkSession, folder: str) -> DataFrame:
    df = orders(spark, folder).select("order_id", F.col("order_amount").alias("total"), "order_date")
    keys = [
        {"column": "total", "descending": True},
        {"column": "order_date", "descending": True},
        "order_id",
    ]
    return dates_as_text(rounded(ordering.sort_rows(df, keys), 2, "total"), "order_date")


@query(
    "o4_top_n",
    sql(
        """SELECT order_id, customer_id, round(CAST(order_amount AS DOUBLE), 2) AS amount FROM v_orders
        ORDER BY order_amount DESC, order_id LIMIT 10""",
        "orders",
    ),
)
def top_n(spark: SparkSession, folder: str) -> DataFrame:
    df = orders(spark, folder).select("order_id", "customer_id", F.col("order_amount").alias("amount"))
    return rounded(ordering.top_rows(df, 10, F.col("amount").desc(), F.col("order_id")), 2, "amount")


@query(
    "o5_top_one",
    sql(
        """SELECT region, round(CAST(sum(order_amount) AS DOUBLE), 2) AS revenue
        FROM v_orders JOIN v_customers USING (customer_id)
        GROUP BY 1 ORDER BY sum(order_amount) DESC, 1 LIMIT 1""",
        "orders",
        "customers",
    ),
)
def top_one(spark: SparkSession, folder: str) -> DataFrame:
    per_customer = orders(spark, folder).groupBy("customer_id").agg(F.sum("order_amount").alias("spent"))
    totals = (
        per_customer.join(customers(spark, folder).select("customer_id", "region"), "customer_id")
        .groupBy("region")
        .agg(F.sum("spent").alias("revenue"))
    )
    return rounded(
        ordering.top_rows(totals, 1, F.col("revenue").desc(), F.col("region")), 2, "revenue"
    )


@query(
    "o6_offset_page",
    sql(
        """SELECT run_id, status, submitted_at FROM v_runs
        ORDER BY submitted_at DESC, run_id LIMIT 1000 OFFSET 75""",
        "runs",
    ),
)
def offset_page(spark: SparkSession, folder: str) -> DataFrame:
    df = runs(spark, folder).select("run_id", "status", "submitted_at")
    newest_first = [{"column": "submitted_at", "descending": True}, "run_id"]
    return ordering.page(df, newest_first, limit=1000, offset=75)


@query(
    "o6_deep_page",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey
    LIMIT 100 OFFSET 30000""",
)
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    order = [
        {"column": "l_extendedprice", "descending": True},
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    ]
    return ordering.page(df, order, limit=100, offset=30000, bound=20_000)


@query(
    "o6_global_rank",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey,
      l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem""",
)
def every_rank(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    order = [{"column": "l_extendedprice", "descending": True}, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ordering.global_rank(df.select(*[o if isinstance(o, str) else o["column"] for o in order]), order).select(
        "l_orderkey", "l_linenumber", F.col("rank").cast("bigint")
    )


@query(
    "d1_dedupe_rows",
    "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
)
def dedupe_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return ordering.drop_duplicates(df)


@query(
    "d2_dedupe_subset",
    "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
)
def dedupe_subset(spark: SparkSession, folder: str) -> DataFrame:
    df = ordering.drop_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey"])
    return df.select("l_orderkey", "l_partkey")


@query(
    "d3_distinct_projection",
    sql("SELECT DISTINCT product_category_name, product_family FROM v_products", "products"),
)
def distinct_projection(spark: SparkSession, folder: str) -> DataFrame:
    return products(spark, folder).select("product_category_name", "product_family").distinct()
