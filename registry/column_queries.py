"""Filters, column steps and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import text
from millrace.operators import columns as ops
from millrace.operators.joins import pick_columns
from millrace.plans.runner import build, register_step
from millrace.plans.spec import job_of
from registry import query
from registry.views import (
    REFERENCE_DATE,
    campaigns,
    customers,
    items,
    orders,
    place,
    products,
    register,
    rounded,
    sql,
    table,
)


def _spec(spark: SparkSession, folder: str, view: str, *steps: dict) -> DataFrame:
    register(spark, folder, view)
    return build(spark, job_of({"source": place(view), "transformations": list(steps)}))


@query(
    "p1_filter_condition",
    sql(
        """SELECT order_id, round(CAST(order_amount AS DOUBLE), 2) AS order_amount FROM v_orders
        WHERE v_orders.order_amount > 250000 AND priority LIKE '1%'""",
        "orders",
    ),
)
def filter_condition(spark: SparkSession, folder: str) -> DataFrame:
    step = {
        "operation": "filter",
        "params": {"condition": "order_amount > 250000 AND priority LIKE '1%'"},
    }
    df = _spec(spark, folder, "orders", step).select("order_id", "order_amount")
    return rounded(df, 2, "order_amount")


@query(
    "p2_filter_column",
    sql(
        """SELECT customer_id, email FROM v_customers
        WHERE email IS NOT NULL AND customer_segment = 'BUILDING' AND country <> 'NATION_3'""",
        "customers",
    ),
)
def filter_column(spark: SparkSession, folder: str) -> DataFrame:
    return _spec(
        spark,
        folder,
        "customers",
        {"operation": "filter", "column": "email", "condition": "is_not_null"},
        {"operation": "filter", "column": "customer_segment", "condition": "== 'BUILDING'"},
        {"operation": "filter", "column": "country", "condition": "!= 'NATION_3'"},
    ).select("customer_id", "email")


@query(
    "p3_not_null_filter",
    sql("SELECT product_id FROM v_products WHERE product_category_name IS NOT NULL", "products"),
)
def not_null_filter(spark: SparkSession, folder: str) -> DataFrame:
    return ops.keep_not_null(products(spark, folder), "product_category_name").select("product_id")


@query("p4_substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def substring_filter(spark: SparkSession, folder: str) -> DataFrame:
    return ops.keep_containing(table(spark, folder, "part"), "p_name", "ring").select(
        "p_partkey", "p_name"
    )


@query(
    "p5_equality_and_filter",
    sql(
        """SELECT order_id FROM v_orders
        WHERE order_status = 'delivered' AND priority = '5-LOW'""",
        "orders",
    ),
)
def equality_filter(spark: SparkSession, folder: str) -> DataFrame:
    wanted = (F.col("order_status") == "delivered") & (F.col("priority") == "5-LOW")
    return orders(spark, folder).filter(wanted).select("order_id")


@query(
    "p6_fill_null_map",
    sql(
        """SELECT customer_id, coalesce(email, 'none') AS email, coalesce(country, '?') AS country
        FROM v_customers""",
        "customers",
    ),
)
def fill_null_map(spark: SparkSession, folder: str) -> DataFrame:
    step = {"operation": "fill_null", "params": {"fill_values": {"email": "none", "country": "?"}}}
    return _spec(spark, folder, "customers", step).select("customer_id", "email", "country")


@query(
    "p7_fill_null_column",
    sql("SELECT customer_id, coalesce(email, 'unknown') AS email FROM v_customers", "customers"),
)
def fill_null_column(spark: SparkSession, folder: str) -> DataFrame:
    step = {"operation": "fill_null", "column": "email", "value": "unknown"}
    return _spec(spark, folder, "customers", step).select("customer_id", "email")


@query(
    "p8_fill_by_type",
    sql(
        """SELECT campaign_id, coalesce(label, 'UNKNOWN') AS label,
          coalesce(conversions, 0) AS conversions
        FROM (SELECT campaign_id, conversions, nullif(product_family, 'FAMILY_2') AS label
          FROM v_campaigns)""",
        "campaigns",
    ),
)
def fill_by_type(spark: SparkSession, folder: str) -> DataFrame:
    df = campaigns(spark, folder).select(
        "campaign_id",
        "conversions",
        F.nullif(F.col("product_family"), F.lit("FAMILY_2")).alias("label"),
    )
    return ops.fill_by_type(df)


@query(
    "p9_zero_fill",
    sql(
        """SELECT campaign_id, coalesce(conversions, 0) AS conversions, label
        FROM (SELECT campaign_id, conversions, nullif(product_family, 'FAMILY_2') AS label
          FROM v_campaigns)""",
        "campaigns",
    ),
)
def zero_fill(spark: SparkSession, folder: str) -> DataFrame:
    df = campaigns(spark, folder).select(
        "campaign_id",
        "conversions",
        F.nullif(F.col("product_family"), F.lit("FAMILY_2")).alias("label"),
    )
    return ops.zero_fill(df)


@query(
    "p10_rename",
    "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation",
)
def rename(spark: SparkSession, folder: str) -> DataFrame:
    names = {"n_nationkey": "nation_id", "n_name": "nation", "no_such_column": "x"}
    return ops.rename_columns(table(spark, folder, "nation"), names)


@query(
    "p11_cast",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10,1)) AS VARCHAR) AS o_totalprice,
      TRY_CAST(o_orderpriority AS INTEGER) IS NULL AS o_orderpriority,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
    FROM orders""",
)
def cast(spark: SparkSession, folder: str) -> DataFrame:
    types = {"o_totalprice": "decimal(10,1)", "o_orderpriority": "int", "o_orderdate": "date"}
    return ops.cast_columns(table(spark, folder, "orders"), types).select(
        "o_orderkey",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.col("o_orderpriority").isNull().alias("o_orderpriority"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
    )


@query(
    "p12_enrich_list",
    sql(
        """SELECT order_id, order_amount >= 100000 AS large,
          CASE WHEN order_amount >= 100000 THEN 'L' ELSE 'S' END || '-' || status AS label
        FROM v_orders""",
        "orders",
    ),
)
def enrich_list(spark: SparkSession, folder: str) -> DataFrame:
    derived = [
        {"name": "large", "expression": "order_amount >= 100000"},
        {"name": "label", "expression": "concat(CASE WHEN large THEN 'L' ELSE 'S' END, '-', status)"},
    ]
    step = {"operation": "enrich", "params": {"derived_columns": derived}}
    return _spec(spark, folder, "orders", step).select("order_id", "large", "label")


@query(
    "p13_enrich_single",
    sql("SELECT order_id, order_amount > 300000 AS is_high_value FROM v_orders", "orders"),
)
def enrich_single(spark: SparkSession, folder: str) -> DataFrame:
    step = {"operation": "enrich", "column": "is_high_value", "value": "order_amount > 300000"}
    return _spec(spark, folder, "orders", step).select("order_id", "is_high_value")


@query(
    "p14_column_pruning",
    sql("SELECT customer_id, country, region FROM v_customers", "customers"),
)
def column_pruning(spark: SparkSession, folder: str) -> DataFrame:
    return pick_columns(customers(spark, folder), "customer_id", "country", "region")


@query(
    "p15_string_trim",
    "SELECT doc_id, trim(text) AS text, trim(lang) AS lang FROM documents",
)
def string_trim(spark: SparkSession, folder: str) -> DataFrame:
    padded = table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit(" "), "text", F.lit("   ")).alias("text"),
        F.concat(F.lit("  "), "lang", F.lit(" ")).alias("lang"),
    )
    return ops.trim_strings(padded)


@query(
    "p18_custom_step",
    sql(
        """SELECT order_id, round(CAST(order_amount AS DOUBLE), 2) AS order_amount FROM v_orders
        WHERE v_orders.order_amount BETWEEN 1000 AND 200000""",
        "orders",
    ),
)
def custom_step(spark: SparkSession, folder: str) -> DataFrame:
    register_step(
        "keep_between", lambda df, p, job: df.filter(C.col(p["column"]).between(p["low"], p["high"]))
    )
    step = {
        "operation": "keep_between",
        "params": {"column": "order_amount", "low": 1000, "high": 200000},
    }
    df = _spec(spark, folder, "orders", step).select("order_id", "order_amount")
    return rounded(df, 2, "order_amount")


@query(
    "f1_f2_dates",
    sql(
        f"""SELECT order_id, CAST(date_diff('day', order_date, DATE '{REFERENCE_DATE}') AS INTEGER)
          AS recency_days, year, month FROM v_orders""",
        "orders",
    ),
)
def dates(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).select(
        "order_id",
        C.recency_days(F.col("order_date"), REFERENCE_DATE).alias("recency_days"),
        F.year("order_date").alias("year"),
        F.month("order_date").alias("month"),
    )


@query(
    "f3_case_chain",
    sql(
        """SELECT order_id, CASE WHEN order_amount >= 300000 THEN 'gold'
          WHEN order_amount >= 100000 THEN 'silver' WHEN order_amount >= 50000 THEN 'bronze'
          ELSE 'none' END AS tier FROM v_orders""",
        "orders",
    ),
)
def case_chain(spark: SparkSession, folder: str) -> DataFrame:
    rungs = [(300000, "gold"), (100000, "silver"), (50000, "bronze")]
    return orders(spark, folder).select(
        "order_id", C.ladder(F.col("order_amount"), rungs, "none").alias("tier")
    )


@query(
    "f4_guarded_division",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_tax,
      round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0.0 END, 6) AS ratio
    FROM lineitem""",
)
def guarded_division(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_tax",
        F.round(C.guarded_ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"),
    )


@query(
    "f5_clamp",
    "SELECT c_custkey, least(5000.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal)) AS balance FROM customer",
)
def clamp(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey", C.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("balance")
    )


@query(
    "f6_f7_log_round",
    "SELECT event_id, round(ln(1 + value), 6) AS log_value, round(value, 1) AS short FROM events",
)
def log_round(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.round(F.log1p("value"), 6).alias("log_value"),
        F.round("value", 1).alias("short"),
    )


@query(
    "f8_contains_like",
    """SELECT doc_id, contains(text, 'the') AS has_the, text LIKE '%the%and%' AS the_and
    FROM documents""",
)
def contains_like(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").contains("the").alias("has_the"),
        F.col("text").like("%the%and%").alias("the_and"),
    )


@query(
    "f9_flag",
    "SELECT o_orderkey, o_totalprice > 200000 AS is_high_value FROM orders",
)
def flag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 200000).alias("is_high_value")
    )


@query(
    "f10_arithmetic",
    sql(
        """SELECT order_id, order_item_id, product_id, seller_id,
          round(CAST(price + freight_value AS DOUBLE), 4) AS item_revenue FROM v_items""",
        "items",
    ),
)
def arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        items(spark, folder).select(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            (F.col("price") + F.col("freight_value")).alias("item_revenue"),
        ),
        4,
        "item_revenue",
    )


@query(
    "f11_null_tests",
    sql(
        "SELECT customer_id, email IS NULL AS no_email, country IS NOT NULL AS placed FROM v_customers",
        "customers",
    ),
)
def null_tests(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).select(
        "customer_id",
        F.col("email").isNull().alias("no_email"),
        F.col("country").isNotNull().alias("placed"),
    )


@query(
    "f12_decimal_cast",
    "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS price FROM part",
)
def decimal_cast(spark: SparkSession, folder: str) -> DataFrame:
    return ops.cast_columns(
        table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("price")),
        {"price": "decimal(10,2)"},
    ).withColumn("price", F.col("price").cast("string"))


@query(
    "f13_sha256",
    "SELECT doc_id, sha256(text) AS checksum, left(sha256(text), 16) AS short_hash FROM documents",
)
def sha256(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        text.fingerprint(F.col("text")).alias("checksum"),
        text.fingerprint(F.col("text"), 16).alias("short_hash"),
    )


@query(
    "f14_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE WHEN event_type = 'view' THEN '{}'
        ELSE '{"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' END
        AS payload
    FROM events""",
)
def json_functions(spark: SparkSession, folder: str) -> DataFrame:
    parsed = table(spark, folder, "events").withColumn("p", F.from_json("props", "k int"))
    payload = F.when(
        F.col("event_type") != "view",
        F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("kind")),
    )
    return parsed.select("event_id", F.col("p.k").alias("k"), text.json_payload(payload).alias("payload"))


@query(
    "f15_path_equality",
    """SELECT page_id, rtrim(url, '/') AS path,
      rtrim(url || '//', '/') = rtrim(url, '/') AS same FROM pages""",
)
def path_equality(spark: SparkSession, folder: str) -> DataFrame:
    with_slash = F.concat("url", F.lit("//"))
    return table(spark, folder, "pages").select(
        "page_id",
        text.normal_path(F.col("url")).alias("path"),
        (text.normal_path(with_slash) == text.normal_path(F.col("url"))).alias("same"),
    )


@query(
    "f16_duration",
    """SELECT user_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's'
      ELSE CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' END AS duration
    FROM (SELECT user_id, event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s
      FROM events GROUP BY 1, 2)""",
)
def duration(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "events").groupBy("user_id", "event_type").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return spans.select("user_id", text.duration_label(F.col("first"), F.col("last")).alias("duration"))


@query(
    "f17_regex_extract",
    """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
      len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links,
      regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS first_link
    FROM pages""",
)
def regex_extract(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.size(links).cast("bigint").alias("links"),
        F.get(links, F.lit(0)).alias("first_link"),
    )
