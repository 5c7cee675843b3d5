"""The given tables in the shape the jobs expect, once as DataFrames and once as SQL text.

The mapping adds what the tables lack: missing values come from `nullif` on a value of the
table, ids of campaigns and persons are computed from keys. No rows are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One day after the last order date of the given tables.
REFERENCE_DATE = "2001-08-02"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(name: str) -> F.Column:
    return F.col(name).cast("decimal(18,2)")


def rounded(df: DataFrame, digits: int = 2, *names: str) -> DataFrame:
    """The named columns as doubles with `digits` decimals. A decimal is rounded as such: of doubles that
    stand for half a unit some lie above it and some below."""
    exact = {n for n, kind in df.dtypes if kind.startswith("decimal")}
    return df.withColumns({
        n: F.round(F.col(n), digits).cast("double") if n in exact else F.round(F.col(n).cast("double"), digits) for n in names
    })


def dates_as_text(df: DataFrame, *names: str) -> DataFrame:
    """The named dates as ISO text, which every engine hands over alike."""
    return df.withColumns({n: F.col(n).cast("date").cast("string") for n in names})


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.when(
                F.col("c_mktsegment") != "MACHINERY",
                F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string")),
            ).alias("email"),
            F.nullif(F.col("n_name"), F.lit("NATION_7")).alias("country"),
            F.col("r_name").alias("region"),
            F.floor(F.col("c_custkey") / 2).cast("bigint").alias("customer_unique_id"),
        )
    )


CUSTOMERS = """
v_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment,
    CASE WHEN c_mktsegment <> 'MACHINERY'
      THEN lower(c_mktsegment) || '-' || CAST(c_custkey AS VARCHAR) END AS email,
    nullif(n_name, 'NATION_7') AS country, r_name AS region,
    CAST(c_custkey // 2 AS BIGINT) AS customer_unique_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def orders(spark: SparkSession, folder: str) -> DataFrame:
    campaign = (F.col("o_custkey") % 100).cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        money("o_totalprice").alias("order_amount"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("canceled")
        .alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
        campaign.alias("campaign_id"),
        F.concat(F.lit("FAMILY_"), (campaign % 5).cast("string")).alias("product_family"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    )


ORDERS = """
v_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CAST(o_totalprice AS DECIMAL(18,2)) AS order_amount, CAST(o_orderdate AS DATE) AS order_date,
    o_orderdate AS order_purchase_timestamp, o_orderstatus AS status,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END
      AS order_status,
    o_orderpriority AS priority, CAST(o_custkey % 100 AS INTEGER) AS campaign_id,
    'FAMILY_' || CAST((o_custkey % 100) % 5 AS VARCHAR) AS product_family,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders)
"""


def of_urgent(bought: DataFrame) -> DataFrame:
    """Orders whose customer is only known if they were urgent and are delivered."""
    known = (F.col("order_status") == "delivered") & (F.col("priority") == "1-URGENT")
    return bought.withColumn("customer_id", F.when(known, F.col("customer_id")))


def items(spark: SparkSession, folder: str) -> DataFrame:
    full = money("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        (full * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("price"),
        (F.col("l_tax").cast("decimal(4,2)") * full).alias("freight_value"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


ITEMS = """
v_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
    l_suppkey AS seller_id,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS price,
    CAST(l_tax AS DECIMAL(4,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS freight_value,
    CAST(l_quantity AS INTEGER) AS qty, l_returnflag AS return_flag,
    CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem)
"""


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("product_category_name"),
        F.col("p_brand").alias("product_family"),
        money("p_retailprice").alias("list_price"),
    )


PRODUCTS = """
v_products AS (
  SELECT p_partkey AS product_id, nullif(p_type, 'PROMO') AS product_category_name,
    p_brand AS product_family, CAST(p_retailprice AS DECIMAL(18,2)) AS list_price
  FROM part)
"""


def translation(spark: SparkSession, folder: str) -> DataFrame:
    names = products(spark, folder).select("product_category_name").distinct()
    return names.where(F.col("product_category_name").isNotNull()).withColumn(
        "product_category_name_english", F.lower("product_category_name")
    )


TRANSLATION = """
v_translation AS (
  SELECT DISTINCT product_category_name, lower(product_category_name)
    AS product_category_name_english
  FROM v_products WHERE product_category_name IS NOT NULL)
"""


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Two payments per order, 1/4 and 3/4 of its amount in whole cents."""
    base = orders(spark, folder).select("order_id", "order_amount")
    first = F.floor(F.col("order_amount") / 4).cast("decimal(18,2)")
    parts = F.array(
        F.struct(F.lit(1).alias("payment_sequential"), first.alias("payment_value")),
        F.struct(
            F.lit(2).alias("payment_sequential"),
            (F.col("order_amount") - first).cast("decimal(18,2)").alias("payment_value"),
        ),
    )
    return base.select("order_id", F.inline(parts))


PAYMENTS = """
v_payments AS (
  SELECT order_id, 1 AS payment_sequential,
    CAST(floor(order_amount / 4) AS DECIMAL(18,2)) AS payment_value FROM v_orders
  UNION ALL
  SELECT order_id, 2 AS payment_sequential,
    order_amount - CAST(floor(order_amount / 4) AS DECIMAL(18,2)) AS payment_value FROM v_orders)
"""


def campaigns(spark: SparkSession, folder: str) -> DataFrame:
    amount = money("value")
    kind = F.col("event_type")
    campaign = F.get_json_object("props", "$.k").cast("int")
    family = F.concat(F.lit("FAMILY_"), (F.col("campaign_id") % 5).cast("string"))
    return (
        table(spark, folder, "events")
        .groupBy(campaign.alias("campaign_id"))
        .agg(
            F.count_if(kind == "view").alias("impressions"),
            F.count_if(kind == "click").alias("clicks"),
            F.nullif(F.count_if(kind == "purchase"), F.lit(20)).alias("conversions"),
            F.sum(F.when(kind == "purchase", amount)).alias("revenue"),
            F.sum(F.when(kind == "click", amount * F.lit("0.1").cast("decimal(2,1)"))).alias("spend"),
        )
        .withColumn("campaign_name", F.concat(F.lit("campaign-"), F.col("campaign_id").cast("string")))
        .withColumn("product_family", family)
        .withColumn("product_category", family)
        .withColumn("campaign_cost", F.col("spend"))
    )


CAMPAIGNS = """
v_campaigns AS (
  SELECT *, 'campaign-' || CAST(campaign_id AS VARCHAR) AS campaign_name,
    'FAMILY_' || CAST(campaign_id % 5 AS VARCHAR) AS product_family,
    'FAMILY_' || CAST(campaign_id % 5 AS VARCHAR) AS product_category, spend AS campaign_cost
  FROM (
    SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS campaign_id,
      count(*) FILTER (event_type = 'view') AS impressions,
      count(*) FILTER (event_type = 'click') AS clicks,
      nullif(count(*) FILTER (event_type = 'purchase'), 20) AS conversions,
      sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS revenue,
      sum(CAST(value AS DECIMAL(18,2)) * 0.1) FILTER (event_type = 'click') AS spend
    FROM events GROUP BY 1))
"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Usage records: one call per event."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("model"),
        F.round(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
    )


CALLS = """
v_calls AS (
  SELECT user_id AS run_id, event_id AS seq, event_type AS model,
    CAST(round(value * 100) AS BIGINT) AS input_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens
  FROM events)
"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run records: one run per event."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(kind == "view", "DONE")
        .when(kind == "click", "PARSING")
        .when(kind == "purchase", "TESTING")
        .when(kind == "signup", "FAILED")
        .otherwise("PENDING")
        .alias("status"),
        F.col("ts").alias("submitted_at"),
        F.col("user_id").alias("owner"),
    )


RUNS = """
v_runs AS (
  SELECT event_id AS run_id,
    CASE event_type WHEN 'view' THEN 'DONE' WHEN 'click' THEN 'PARSING'
      WHEN 'purchase' THEN 'TESTING' WHEN 'signup' THEN 'FAILED' ELSE 'PENDING' END AS status,
    ts AS submitted_at, user_id AS owner
  FROM events)
"""

_SQL = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "items": ITEMS,
    "products": PRODUCTS,
    "translation": TRANSLATION,
    "payments": PAYMENTS,
    "campaigns": CAMPAIGNS,
    "calls": CALLS,
    "runs": RUNS,
}
_NEEDS = {"payments": ("orders",), "translation": ("products",)}


def sql(body: str, *names: str) -> str:
    """A query text with the named views put before it as common table expressions."""
    wanted: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in wanted:
                wanted.append(needed)
    body = body.strip()
    if not wanted:
        return body
    parts = ",".join(_SQL[n].strip() for n in wanted)
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"


_FRAMES = {
    "customers": customers,
    "orders": orders,
    "items": items,
    "products": products,
    "translation": translation,
    "payments": payments,
    "campaigns": campaigns,
    "calls": calls,
    "runs": runs,
}


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views `v_<name>`, so that a job spec can name them as tables."""
    for name in names:
        _FRAMES[name](spark, folder).createOrReplaceTempView(f"v_{name}")


def place(name: str) -> dict[str, str]:
    """The view as a dataset of a job spec."""
    return {"table": f"v_{name}"}
