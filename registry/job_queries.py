"""The prebuilt analytics and the ready-made jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.plans import campaign, geo, intent, people, rfm, stories
from millrace.plans.runner import build, run
from millrace.plans.spec import job_of
from millrace.sources import files
from millrace.sources.files import Dataset
from millrace.sources.shared import fresh_path
from registry import query
from registry.views import (
    REFERENCE_DATE,
    campaigns,
    customers,
    dates_as_text,
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
)

TARGET_CATEGORY = "_3"


def _scored_sql(metrics: str, key: str, frequency_type: str = "BIGINT") -> str:
    """Quintile scores by exact rank over a query giving (key, recency_days, frequency, monetary)."""

    def score(column: str, descending: bool) -> str:
        rank = f"rank_{column}"
        steps = " ".join(
            f"WHEN {column} <= (SELECT min({column}) FROM q WHERE 5 * {rank} >= {i} * n)"
            f" THEN {6 - i if descending else i}"
            for i in (1, 2, 3, 4)
        )
        return f"CASE {steps} ELSE {1 if descending else 5} END"

    ranks = ", ".join(
        f"row_number() OVER (ORDER BY {c}) AS rank_{c}"
        for c in ("recency_days", "frequency", "monetary")
    )
    return f"""WITH m AS ({metrics}),
      q AS (SELECT *, count(*) OVER () AS n, {ranks} FROM m),
      scored AS (SELECT {key}, recency_days, frequency, monetary,
        {score('recency_days', True)} AS r_score, {score('frequency', False)} AS f_score,
        {score('monetary', False)} AS m_score FROM q),
      rfm AS (SELECT {key}, CAST(recency_days AS INTEGER) AS recency_days,
        CAST(frequency AS {frequency_type}) AS frequency, monetary, r_score, f_score, m_score,
        r_score + f_score + m_score AS rfm_score,
        CASE WHEN r_score + f_score + m_score >= 13 THEN 'Champions'
          WHEN r_score + f_score + m_score >= 10 THEN 'Loyal Customers'
          WHEN r_score + f_score + m_score >= 7 THEN 'Potential Loyalists'
          WHEN r_score + f_score + m_score >= 4 THEN 'At Risk' ELSE 'Lost' END AS rfm_segment
        FROM scored)"""


_METRICS = f"""SELECT customer_id,
    date_diff('day', max(order_date), DATE '{REFERENCE_DATE}') AS recency_days,
    count(order_id) AS frequency, sum(order_amount) AS monetary FROM v_orders GROUP BY 1"""
_RFM = _scored_sql(_METRICS, "customer_id")

_INTENT = f"""intent AS (SELECT *, CASE WHEN intent_score >= 30 THEN 'High Intent'
      WHEN intent_score >= 10 THEN 'Medium Intent' ELSE 'Low Intent' END AS intent_segment
    FROM (SELECT *, least(100.0, greatest(0.0, target_purchases * 10.0 + avg_spend / 500.0
        + category_diversity * 2.0 + ln(1 + total_orders) * 5.0)) AS intent_score
      FROM (SELECT customer_id, CAST(sum(order_amount) AS DOUBLE) / count(order_amount) AS avg_spend,
          count(order_id) AS total_orders, sum(order_amount) AS total_spent,
          count(*) FILTER (contains(product_family, '{TARGET_CATEGORY}')) AS target_purchases,
          count(DISTINCT product_family) AS category_diversity
        FROM v_intent_orders GROUP BY 1)))"""

# Orders with a category that varies within a customer and amounts in hundreds.
_INTENT_ORDERS = """v_intent_orders AS (SELECT order_id, customer_id,
    CAST(order_amount * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS order_amount, 'FAMILY_' || left(priority, 1)
    AS product_family FROM v_orders)"""


def _intent_orders(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).select(
        "order_id",
        "customer_id",
        (F.col("order_amount") * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(18,2)").alias("order_amount"),
        F.concat(F.lit("FAMILY_"), F.substring("priority", 1, 1)).alias("product_family"),
    )


def _rfm(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_scores(orders(spark, folder), REFERENCE_DATE)


def _intent(spark: SparkSession, folder: str) -> DataFrame:
    return intent.intent_scores(_intent_orders(spark, folder), TARGET_CATEGORY)


_RFM_SHOW = """customer_id, recency_days, frequency, round(CAST(monetary AS DOUBLE), 2) AS monetary,
  r_score, f_score, m_score, rfm_score, rfm_segment"""


@query("n1_rfm_scoring", sql(f"{_RFM} SELECT {_RFM_SHOW} FROM rfm", "orders"))
def rfm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_rfm(spark, folder), 2, "monetary")


@query(
    "n1_rfm_sketch",
    """SELECT count(DISTINCT o_custkey) AS customers, true AS close FROM orders""",
)
def rfm_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Scores from the sketch are at most one class from the exact ones."""
    names = ("r_score", "f_score", "m_score")
    exact = _rfm(spark, folder).select("customer_id", *[F.col(n).alias(f"exact_{n}") for n in names])
    sketch = rfm.rfm_scores(orders(spark, folder), REFERENCE_DATE, exact=False)
    near = [F.abs(F.col(n) - F.col(f"exact_{n}")) <= 1 for n in names]
    return sketch.join(exact, "customer_id").agg(
        F.count(F.lit(1)).alias("customers"), F.bool_and(near[0] & near[1] & near[2]).alias("close")
    )


_GEO = """geo AS (SELECT country, region, sum(order_amount) AS total_revenue,
    count(DISTINCT customer_id) AS unique_customers, count(order_id) AS order_count,
    CAST(sum(order_amount) AS DOUBLE) / count(order_amount) AS avg_order_value,
    CAST(sum(order_amount) AS DOUBLE) / count(DISTINCT customer_id) AS revenue_per_customer,
    sum(order_amount) > {high} AS is_high_value
  FROM v_orders LEFT JOIN v_customers USING (customer_id) GROUP BY ALL)"""

_GEO_SHOW = """country, region, round(CAST(total_revenue AS DOUBLE), 2) AS total_revenue,
  unique_customers, CAST(order_count AS BIGINT) AS order_count,
  round(avg_order_value, 4) AS avg_order_value,
  round(revenue_per_customer, 4) AS revenue_per_customer, is_high_value"""


@query(
    "n2_geo_revenue",
    sql(
        f"WITH {_GEO.format(high=10000)} SELECT {_GEO_SHOW} FROM geo ORDER BY total_revenue DESC",
        "orders",
        "customers",
    ),
)
def geo_revenue(spark: SparkSession, folder: str) -> DataFrame:
    df = geo.geo_revenue(orders(spark, folder), customers(spark, folder))
    return rounded(
        rounded(df, 2, "total_revenue"), 4, "avg_order_value", "revenue_per_customer"
    )


@query(
    "n2_geo_unknown_customers",
    sql(
        f"""WITH {_GEO.format(high=100000000).replace('v_customers USING',
        "(SELECT * REPLACE (CASE WHEN customer_segment <> 'BUILDING' THEN customer_id END AS customer_id) "
        "FROM v_customers) c USING")}
        SELECT {_GEO_SHOW} FROM geo""",
        "orders",
        "customers",
    ),
)
def geo_unknown_customers(spark: SparkSession, folder: str) -> DataFrame:
    known = customers(spark, folder).withColumn(
        "customer_id", F.when(F.col("customer_segment") != "BUILDING", F.col("customer_id"))
    )
    df = geo.geo_revenue(orders(spark, folder), known, 100000000.0, broadcast_mb=0)
    return rounded(
        rounded(df, 2, "total_revenue"), 4, "avg_order_value", "revenue_per_customer"
    )


def _kpi_sql(base: str, revenue: str, conversions: str) -> str:
    return f"""kpi AS (SELECT *, CASE WHEN roi_pct >= 2000 THEN 'A' WHEN roi_pct >= 1000 THEN 'B'
        WHEN roi_pct >= 0 THEN 'C' ELSE 'D' END AS campaign_grade
      FROM (SELECT *,
        CASE WHEN impressions > 0 THEN CAST({conversions} AS DOUBLE) / impressions ELSE 0.0 END
          AS conversion_rate,
        CASE WHEN impressions > 0 THEN CAST({revenue} AS DOUBLE) / impressions ELSE 0.0 END
          AS revenue_per_impression,
        CASE WHEN spend > 0 THEN CAST({revenue} - spend AS DOUBLE) / CAST(spend AS DOUBLE) ELSE 0.0
          END * 100 AS roi_pct
      FROM ({base})))"""


_KPI_BASE = """SELECT campaign_id, campaign_name, product_family, impressions, clicks,
    coalesce(conversions, 0) AS conversions, coalesce(revenue, 0) AS revenue,
    coalesce(spend, 0) AS spend
  FROM v_campaigns WHERE contains(product_family, 'FAMILY')"""
_KPI = _kpi_sql(_KPI_BASE, "revenue", "conversions")
_KPI_ORDERS = _kpi_sql(
    """SELECT c.* REPLACE (coalesce(conversions, 0) AS conversions, coalesce(spend, 0) AS spend),
      coalesce(order_count, 0) AS order_count, coalesce(total_revenue, 0) AS total_revenue
    FROM v_campaigns c LEFT JOIN (SELECT campaign_id, count(order_id) AS order_count,
        sum(order_amount) AS total_revenue FROM v_orders
        WHERE contains(product_family, '_3') GROUP BY 1)
      USING (campaign_id) WHERE contains(c.product_family, '_3')""",
    "total_revenue",
    "conversions",
)
_KPI_SHOW = """campaign_id, campaign_name, round(conversion_rate, 6) AS conversion_rate,
  round(revenue_per_impression, 6) AS revenue_per_impression, round(roi_pct, 4) AS roi_pct,
  campaign_grade"""


def _kpis(spark: SparkSession, folder: str) -> DataFrame:
    return campaign.campaign_kpis(campaigns(spark, folder), "FAMILY")


def _kpi_columns(df: DataFrame, *more: str) -> DataFrame:
    shown = df.select(
        "campaign_id",
        "campaign_name",
        "conversion_rate",
        "revenue_per_impression",
        "roi_pct",
        "campaign_grade",
        *more,
    )
    return rounded(rounded(shown, 6, "conversion_rate", "revenue_per_impression"), 4, "roi_pct")


@query("n3_campaign_kpis", sql(f"WITH {_KPI} SELECT {_KPI_SHOW} FROM kpi", "campaigns"))
def campaign_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return _kpi_columns(_kpis(spark, folder))


@query(
    "n4_campaign_kpis_with_orders",
    sql(
        f"""WITH {_KPI_ORDERS} SELECT {_KPI_SHOW}, order_count,
        round(CAST(total_revenue AS DOUBLE), 2) AS total_revenue FROM kpi""",
        "campaigns",
        "orders",
    ),
)
def campaign_kpis_with_orders(spark: SparkSession, folder: str) -> DataFrame:
    df = campaign.campaign_kpis(campaigns(spark, folder), "_3", orders(spark, folder))
    return rounded(_kpi_columns(df, "order_count", "total_revenue"), 2, "total_revenue")


@query(
    "n5_campaign_story",
    sql(
        """SELECT campaign_id, coalesce(order_count, 0) AS order_count,
          round(CAST(total_revenue AS DOUBLE), 2) AS total_revenue,
          round(coalesce(order_count, 0) / nullif(impressions, 0), 6) AS conversion_rate,
          round(CAST(total_revenue AS DOUBLE) / nullif(impressions, 0), 6) AS revenue_per_impression,
          round(CAST(total_revenue - campaign_cost AS DOUBLE) / CAST(campaign_cost AS DOUBLE) * 100, 4)
            AS roi_pct
        FROM v_campaigns LEFT JOIN (SELECT campaign_id, count(order_id) AS order_count,
          sum(order_amount) AS total_revenue FROM v_orders GROUP BY 1) USING (campaign_id)
        WHERE product_category = 'FAMILY_3'""",
        "campaigns",
        "orders",
    ),
)
def campaign_story(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "campaigns", "orders")
    job = job_of(stories.campaign_story(place("campaigns"), place("orders"), "FAMILY_3"))
    df = build(spark, job).select(
        "campaign_id",
        "order_count",
        "total_revenue",
        "conversion_rate",
        "revenue_per_impression",
        "roi_pct",
    )
    df = rounded(df, 6, "conversion_rate", "revenue_per_impression")
    return rounded(rounded(df, 2, "total_revenue"), 4, "roi_pct")


@query(
    "n6_intent_scoring",
    sql(
        f"""WITH {_INTENT_ORDERS}, {_INTENT} SELECT customer_id, round(avg_spend, 6) AS avg_spend,
          total_orders, round(CAST(total_spent AS DOUBLE), 2) AS total_spent, target_purchases,
          category_diversity, round(intent_score, 6) AS intent_score, intent_segment FROM intent""",
        "orders",
    ),
)
def intent_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(_intent(spark, folder), 6, "avg_spend", "intent_score"), 2, "total_spent")


@query(
    "n7_segment_distribution",
    sql(
        f"""{_RFM} SELECT rfm_segment, count(customer_id) AS customer_count,
          round(avg(CAST(monetary AS DOUBLE)), 2) AS avg_spend,
          round(avg(frequency), 1) AS avg_orders
        FROM rfm GROUP BY 1 ORDER BY 2 DESC""",
        "orders",
    ),
)
def segment_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.segment_distribution(_rfm(spark, folder))


@query(
    "n8_revenue_by_country",
    sql(
        f"""WITH {_GEO.format(high=10000)} SELECT country,
          round(CAST(sum(total_revenue) AS DOUBLE), 2) AS country_revenue,
          CAST(sum(unique_customers) AS BIGINT) AS total_customers
        FROM geo GROUP BY 1 ORDER BY sum(total_revenue) DESC, country LIMIT 5""",
        "orders",
        "customers",
    ),
)
def revenue_by_country(spark: SparkSession, folder: str) -> DataFrame:
    df = geo.geo_revenue(orders(spark, folder), customers(spark, folder))
    return rounded(geo.top_countries(df), 2, "country_revenue")


@query(
    "n9_campaign_summary",
    sql(
        f"""WITH {_KPI} SELECT round(avg(conversion_rate), 4) AS avg_conversion_rate,
          round(avg(roi_pct), 2) AS avg_roi_pct,
          round(avg(revenue_per_impression), 4) AS avg_rev_per_impression FROM kpi""",
        "campaigns",
    ),
)
def campaign_summary(spark: SparkSession, folder: str) -> DataFrame:
    return campaign.campaign_summary(_kpis(spark, folder))


@query(
    "n10_grade_breakdown",
    sql(f"WITH {_KPI} SELECT campaign_grade, count(*) AS count FROM kpi GROUP BY 1", "campaigns"),
)
def grade_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return campaign.grade_breakdown(_kpis(spark, folder))


@query(
    "n11_intent_distribution",
    sql(
        f"""WITH {_INTENT_ORDERS}, {_INTENT} SELECT intent_segment, count(*) AS customer_count,
          round(avg(intent_score), 1) AS avg_score,
          round(CAST(sum(total_spent) AS DOUBLE), 0) AS total_revenue FROM intent GROUP BY 1""",
        "orders",
    ),
)
def intent_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(intent.intent_distribution(_intent(spark, folder)), 0, "total_revenue")


_COMBINED = """combined AS (SELECT * FROM rfm JOIN (SELECT customer_id, intent_score, intent_segment
    FROM intent) USING (customer_id))"""


def _combined(spark: SparkSession, folder: str) -> DataFrame:
    return intent.with_intent(_rfm(spark, folder), _intent(spark, folder))


@query(
    "n12_rfm_by_intent",
    sql(
        f"""{_RFM}, {_INTENT_ORDERS}, {_INTENT}, {_COMBINED} SELECT rfm_segment, intent_segment,
          count(customer_id) AS count, round(avg(CAST(monetary AS DOUBLE)), 0) AS avg_spend
        FROM combined GROUP BY ALL ORDER BY 1, 2""",
        "orders",
    ),
)
def rfm_by_intent(spark: SparkSession, folder: str) -> DataFrame:
    return intent.segment_cross_table(_combined(spark, folder))


@query(
    "n13_high_value_targets",
    sql(
        f"""{_RFM}, {_INTENT_ORDERS}, {_INTENT}, {_COMBINED}
        SELECT customer_id, rfm_segment, intent_segment, round(CAST(monetary AS DOUBLE), 2)
          AS monetary, round(intent_score, 6) AS intent_score
        FROM combined WHERE rfm_segment = 'Champions' AND intent_segment = 'High Intent'
        ORDER BY combined.monetary DESC, customer_id LIMIT 10""",
        "orders",
    ),
)
def high_value_targets(spark: SparkSession, folder: str) -> DataFrame:
    df = intent.high_value_targets(_combined(spark, folder))
    return rounded(rounded(df, 2, "monetary"), 6, "intent_score")


@query(
    "n14_clean_customers",
    sql(
        """SELECT customer_id, coalesce(email, 'unknown@example.com') AS email,
          coalesce(country, 'UNKNOWN') AS country
        FROM v_customers WHERE nullif(customer_segment, 'BUILDING') IS NOT NULL""",
        "customers",
    ),
)
def clean_customers(spark: SparkSession, folder: str) -> DataFrame:
    known = F.when(F.col("customer_segment") != "BUILDING", F.col("customer_id"))
    customers(spark, folder).withColumn("customer_id", known).createOrReplaceTempView("v_raw_customers")
    job = job_of(stories.clean_customers({"table": "v_raw_customers"}))
    return build(spark, job).select("customer_id", "email", "country")


@query(
    "n15_customer_spend",
    sql(
        """SELECT customer_id, customer_name, email, country,
          coalesce(round(CAST(sum(order_amount) AS DOUBLE), 2), 0) AS total_spend,
          count(order_id) AS order_count
        FROM v_customers LEFT JOIN (SELECT * REPLACE (CASE WHEN order_status = 'delivered'
          AND priority = '1-URGENT' THEN customer_id END AS customer_id) FROM v_orders)
          USING (customer_id) GROUP BY ALL""",
        "orders",
        "customers",
    ),
)
def customer_spend(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "customers")
    urgent = of_urgent(orders(spark, folder))
    urgent.createOrReplaceTempView("v_urgent_orders")
    job = job_of(stories.customer_spend(place("customers"), {"table": "v_urgent_orders"}))
    return rounded(build(spark, job), 2, "total_spend")


@query(
    "n16_monthly_region_revenue",
    sql(
        """SELECT year, month, region, round(CAST(sum(order_amount) AS DOUBLE), 2) AS total_revenue,
          count(order_id) AS order_count,
          CAST(sum(order_amount) AS DOUBLE) / count(order_amount) AS avg_order_value
        FROM v_orders JOIN v_customers USING (customer_id) GROUP BY ALL""",
        "orders",
        "customers",
    ),
)
def monthly_region_revenue(spark: SparkSession, folder: str) -> DataFrame:
    regions = customers(spark, folder).select("customer_id", "region")
    placed = orders(spark, folder).join(regions, "customer_id")
    placed.createOrReplaceTempView("v_placed_orders")
    path = fresh_path(spark, "monthly")
    job = job_of(stories.monthly_region_revenue({"table": "v_placed_orders"}, {"path": path}))
    run(spark, job)
    return rounded(files.read(spark, Dataset(path=path)), 2, "total_revenue")


_LINES = """v_order_lines AS (SELECT l_orderkey AS order_id, l_partkey AS product_id,
    l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / l_quantity END AS unit_price,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total,
    CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month
  FROM lineitem)"""


@query(
    "n17_monthly_category_revenue",
    sql(
        f"""WITH {_LINES} SELECT year, month, category,
          round(CAST(sum(line_total) AS DOUBLE), 2) AS monthly_revenue, count(order_id) AS order_count
        FROM (SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY l_linenumber,
            unit_price, line_total, year, month) AS n
          FROM (SELECT order_id, product_id, l_linenumber, coalesce(unit_price, 0.0) AS unit_price,
              line_total, year, month, product_category_name AS category
            FROM v_order_lines LEFT JOIN v_products USING (product_id)))
        WHERE n = 1 GROUP BY ALL""",
        "products",
    ),
)
def monthly_category_revenue(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / F.col("l_quantity"))
    table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        "l_linenumber",
        unit.alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("line_total"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
    ).createOrReplaceTempView("v_order_lines")
    products(spark, folder).select(
        "product_id", F.col("product_category_name").alias("category")
    ).createOrReplaceTempView("v_categories")
    job = job_of(
        stories.monthly_category_revenue({"table": "v_order_lines"}, {"table": "v_categories"})
    )
    return rounded(build(spark, job), 2, "monthly_revenue")


@query(
    "n18_monthly_payments_by_category",
    sql(
        """SELECT year, month, product_category_name,
          round(CAST(sum(payment_value) AS DOUBLE), 2) AS total_revenue
        FROM v_orders JOIN v_payments USING (order_id) JOIN v_items USING (order_id)
          LEFT JOIN v_products USING (product_id)
        WHERE order_status = 'delivered' GROUP BY ALL""",
        "orders",
        "payments",
        "items",
        "products",
    ),
)
def monthly_payments_by_category(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders", "payments", "items", "products")
    job = job_of(
        stories.monthly_payments_by_category(
            place("orders"), place("payments"), place("items"), place("products")
        )
    )
    return rounded(build(spark, job), 2, "total_revenue")


@query(
    "n19_order_frequency",
    sql(
        """SELECT customer_unique_id, count(order_id) AS order_count,
          CASE WHEN count(order_id) >= 5 THEN 'loyal' WHEN count(order_id) >= 2 THEN 'repeat'
            ELSE 'one_time' END AS customer_segment
        FROM v_orders JOIN v_customers USING (customer_id) WHERE order_status = 'delivered'
        GROUP BY 1""",
        "orders",
        "customers",
    ),
)
def order_frequency(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders", "customers")
    return build(spark, job_of(stories.order_frequency(place("orders"), place("customers"))))


@query(
    "n20_delivered_orders",
    sql(
        """SELECT order_id, customer_id, order_status, CAST(order_date AS VARCHAR) AS order_date
        FROM v_orders
        WHERE order_status = 'delivered' AND order_id IS NOT NULL""",
        "orders",
    ),
)
def delivered_orders(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders")
    df = build(spark, job_of(stories.delivered_orders(place("orders"))))
    return dates_as_text(df.select("order_id", "customer_id", "order_status", "order_date"), "order_date")


@query(
    "n21_seller_revenue",
    sql(
        """SELECT seller_id, round(CAST(sum(price + freight_value) AS DOUBLE), 4) AS revenue
        FROM v_items JOIN v_orders USING (order_id) WHERE order_status = 'delivered'
        GROUP BY 1 ORDER BY 2 DESC, 1""",
        "items",
        "orders",
    ),
)
def seller_revenue(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "items", "orders")
    return rounded(build(spark, job_of(stories.seller_revenue(place("items"), place("orders")))), 4, "revenue")


_PERSON = _scored_sql(
    f"""SELECT customer_unique_id,
      date_diff('day', CAST(max(order_purchase_timestamp) AS DATE), DATE '{REFERENCE_DATE}')
        AS recency_days,
      count(DISTINCT order_id) AS frequency, sum(payment_value) AS monetary
    FROM v_orders JOIN v_payments USING (order_id) JOIN v_customers USING (customer_id) GROUP BY 1""",
    "customer_unique_id",
)


@query(
    "n22_person_rfm",
    sql(
        f"{_PERSON} SELECT {_RFM_SHOW.replace('customer_id', 'customer_unique_id')} FROM rfm",
        "orders",
        "payments",
        "customers",
    ),
)
def person_rfm(spark: SparkSession, folder: str) -> DataFrame:
    df = people.person_rfm(
        customers(spark, folder), orders(spark, folder), payments(spark, folder), REFERENCE_DATE
    )
    return rounded(df, 2, "monetary")


@query(
    "n23_monthly_revenue_english",
    sql(
        """SELECT year, month, product_category_name_english,
          round(CAST(sum(price) AS DOUBLE), 4) AS total_revenue
        FROM v_items JOIN v_orders USING (order_id) LEFT JOIN v_products USING (product_id)
          LEFT JOIN v_translation USING (product_category_name)
        WHERE order_status = 'delivered' GROUP BY ALL""",
        "items",
        "orders",
        "translation",
    ),
)
def monthly_revenue_english(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "items", "orders", "products", "translation")
    job = job_of(
        stories.monthly_revenue_english(
            place("items"), place("orders"), place("products"), place("translation")
        )
    )
    return rounded(build(spark, job), 4, "total_revenue")


@query(
    "n24_rfm_story",
    sql(
        f"""{_RFM}, last AS (SELECT customer_id, CAST(max(order_date) AS VARCHAR) AS last_order_date FROM v_orders
          GROUP BY 1) SELECT {_RFM_SHOW}, last_order_date FROM rfm JOIN last USING (customer_id)""",
        "orders",
    ),
)
def rfm_story(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders")
    job = job_of(stories.rfm_story(place("orders"), reference_date=REFERENCE_DATE))
    return dates_as_text(rounded(build(spark, job), 2, "monetary"), "last_order_date")


@query(
    "n25_order_enrichment",
    sql(
        f"""SELECT order_id, product_id, order_item_id, qty, seller_id,
          round(CAST(price AS DOUBLE), 4) AS total,
          CAST(date_diff('day', ship_date, DATE '{REFERENCE_DATE}') AS INTEGER) AS recency_days,
          date_diff('day', ship_date, DATE '{REFERENCE_DATE}') <= 30 AS is_recent,
          CAST(price AS DOUBLE) / qty AS revenue_per_item
        FROM v_items""",
        "items",
    ),
)
def order_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    items(spark, folder).select(
        "order_id",
        "product_id",
        "order_item_id",
        "qty",
        "seller_id",
        F.col("price").alias("total"),
        F.col("ship_date").alias("order_date"),
    ).createOrReplaceTempView("v_priced_lines")
    job = job_of(
        stories.order_enrichment({"table": "v_priced_lines"}, reference_date=REFERENCE_DATE)
    )
    df = build(spark, job).drop("order_date")
    return rounded(df, 4, "total")


@query(
    "r1_run_geo_story",
    sql(
        """SELECT country, region, round(CAST(sum(order_amount) AS DOUBLE), 2) AS total_revenue,
          count(DISTINCT customer_id) AS customer_count,
          round(CAST(sum(order_amount) AS DOUBLE) / count(DISTINCT customer_id), 4)
            AS avg_spend_per_customer, sum(order_amount) > 10000 AS is_high_value
        FROM v_orders LEFT JOIN v_customers USING (customer_id) GROUP BY ALL""",
        "orders",
        "customers",
    ),
)
def run_geo_story(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders", "customers")
    path = fresh_path(spark, "geo")
    run(spark, job_of(stories.geo_story(place("orders"), place("customers"), {"path": path})))
    df = files.read(spark, Dataset(path=path))
    return rounded(rounded(df, 2, "total_revenue"), 4, "avg_spend_per_customer")


@query(
    "r2_dialects",
    sql(
        """SELECT d.dialect, priority, count(order_id) AS order_count
        FROM v_orders CROSS JOIN (VALUES ('params'), ('config'), ('flat')) AS d(dialect)
        WHERE order_status = 'delivered' GROUP BY ALL""",
        "orders",
    ),
)
def dialects(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, "orders")
    counted = [{"function": "count", "column": "order_id", "alias": "order_count"}]
    wanted = {"condition": "order_status = 'delivered'"}
    grouped = {"group_by": ["priority"], "aggregations": counted}
    steps = {
        "params": [
            {"operation": "filter", "params": wanted},
            {"operation": "aggregate", "params": grouped},
        ],
        "config": [
            {"operation": "filter", "config": wanted},
            {"operation": "aggregate", "config": grouped},
        ],
        "flat": [
            {"operation": "filter", "column": "order_status", "condition": "== 'delivered'"},
            {"operation": "aggregate", "group_by": ["priority"], "metrics": ["order_count"]},
        ],
    }
    results = [
        build(spark, job_of({"source": place("orders"), "transformations": s})).withColumn(
            "dialect", F.lit(name)
        )
        for name, s in steps.items()
    ]
    return results[0].unionByName(results[1]).unionByName(results[2])


@query(
    "r4_rfm_from_path",
    sql(f"{_RFM} SELECT {_RFM_SHOW} FROM rfm", "orders"),
)
def rfm_from_path(spark: SparkSession, folder: str) -> DataFrame:
    path, output = fresh_path(spark, "orders"), fresh_path(spark, "rfm")
    files.write(orders(spark, folder), Dataset(path=path))
    rfm.run_rfm(spark, path, output, REFERENCE_DATE)
    return rounded(files.read(spark, Dataset(path=output, format="delta")), 2, "monetary")


# The shipped stories in the flat dialect, each over the given tables. Orders also carry a region of
# their own, which must not win over that of the customers.
def _story_place(spark: SparkSession, folder: str, name: str) -> dict[str, str]:
    if name == "customers":
        register(spark, folder, "customers")
        return place("customers")
    if name == "campaigns":
        register(spark, folder, "campaigns")
        return place("campaigns")
    orders(spark, folder).withColumn("region", F.lit("of the order")).createOrReplaceTempView("v_story_orders")
    return {"table": "v_story_orders"}


def _run_story(spark: SparkSession, story: dict) -> DataFrame:
    """Runs the story into a new table and reads that."""
    target = {"path": fresh_path(spark, "story"), "format": "delta", "mode": story.pop("mode", "overwrite")}
    run(spark, job_of(story | {"target": target}))
    return files.read(spark, Dataset(path=target["path"], format="delta"))


@query("r1_story_clean", sql(
    """SELECT customer_id, coalesce(email, 'unknown@example.com') AS email, coalesce(country, 'UNKNOWN') AS country
    FROM v_customers WHERE customer_id IS NOT NULL""", "customers"))  # fmt: skip
def story_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _run_story(spark, {
        "id": "story_clean", "source": _story_place(spark, folder, "customers"),
        "transformations": [
            {"operation": "filter", "column": "customer_id", "condition": "is_not_null"},
            {"operation": "fill_null", "column": "email", "value": "unknown@example.com"},
            {"operation": "fill_null", "column": "country", "value": "UNKNOWN"},
        ],
    }).select("customer_id", "email", "country")


@query("r1_story_join", sql(
    """SELECT customer_id, customer_name, email, country, round(CAST(sum(order_amount) AS DOUBLE), 2) AS total_spend,
      count(order_id) AS order_count FROM v_customers LEFT JOIN v_orders USING (customer_id) GROUP BY ALL""",
    "customers", "orders"))
def story_join(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run_story(spark, {
        "id": "story_join", "source": _story_place(spark, folder, "customers"),
        "transformations": [
            {"operation": "join", "right_table": _story_place(spark, folder, "orders")["table"],
             "join_key": "customer_id", "join_type": "left"},
            {"operation": "aggregate", "group_by": ["customer_id", "customer_name", "email", "country"],
             "metrics": ["total_spend", "order_count"]},
        ],
    }), 2, "total_spend")


@query("r1_story_monthly", sql(
    """SELECT year, month, 'of the order' AS region, round(CAST(sum(order_amount) AS DOUBLE), 2) AS total_revenue,
      count(order_id) AS order_count, round(CAST(sum(order_amount) AS DOUBLE) / count(order_amount), 2) AS avg_order_value
    FROM v_orders GROUP BY 1, 2""", "orders"))  # fmt: skip
def story_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run_story(spark, {
        "id": "story_monthly", "source": _story_place(spark, folder, "orders"),
        "transformations": [{"operation": "aggregate", "group_by": ["year", "month", "region"],
                             "metrics": ["total_revenue", "order_count", "avg_order_value"]}],
    }), 2, "total_revenue", "avg_order_value")


@query("r1_story_geo", sql(
    """SELECT country, region, round(CAST(sum(order_amount) AS DOUBLE), 2) AS total_revenue,
      count(DISTINCT customer_id) AS customer_count,
      round(CAST(sum(order_amount) AS DOUBLE) / count(DISTINCT customer_id), 2) AS avg_spend_per_customer,
      sum(order_amount) > 10000 AS is_high_value
    FROM v_orders LEFT JOIN v_customers USING (customer_id) GROUP BY ALL""", "orders", "customers"))  # fmt: skip
def story_geo(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run_story(spark, {
        "id": "story_geo", "source": _story_place(spark, folder, "orders"),
        "transformations": [
            {"operation": "join", "right_table": _story_place(spark, folder, "customers")["table"],
             "join_key": "customer_id", "join_type": "left"},
            {"operation": "aggregate", "group_by": ["country", "region"],
             "metrics": ["total_revenue", "customer_count", "avg_spend_per_customer"]},
            {"operation": "enrich", "column": "is_high_value", "value": "total_revenue > 10000"},
        ],
    }), 2, "total_revenue", "avg_spend_per_customer")


@query("r1_story_rfm", sql(
    f"""{_RFM} SELECT customer_id, recency_days, frequency AS order_count,
      round(CAST(monetary AS DOUBLE), 2) AS total_spend, rfm_score FROM rfm""", "orders"))  # fmt: skip
def story_rfm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run_story(spark, {
        "id": "story_rfm", "source": _story_place(spark, folder, "orders"), "mode": "merge",
        "reference_date": REFERENCE_DATE,
        "transformations": [
            {"operation": "aggregate", "group_by": ["customer_id"],
             "metrics": ["recency_days", "order_count", "total_spend"]},
            {"operation": "enrich", "column": "rfm_score", "value": "r_score + f_score + m_score"},
        ],
    }).select("customer_id", "recency_days", "order_count", "total_spend", "rfm_score"), 2, "total_spend")


@query("r1_story_campaign", sql(
    """SELECT campaign_id, campaign_name, product_category, CAST(round(sum(order_amount), 2) AS DOUBLE) AS total_revenue,
      count(order_id) AS order_count, max(impressions) AS impressions,
      CAST(round(max(campaign_cost), 2) AS DOUBLE) AS campaign_cost,
      round(CAST(sum(order_amount) - max(campaign_cost) AS DOUBLE) / CAST(max(campaign_cost) AS DOUBLE) * 100, 4) AS roi_pct
    FROM v_campaigns LEFT JOIN (SELECT order_id, campaign_id, order_amount FROM v_orders) USING (campaign_id)
    WHERE product_category = 'FAMILY_3' GROUP BY ALL""", "campaigns", "orders"))  # fmt: skip
def story_campaign(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(_run_story(spark, {
        "id": "story_campaign", "source": _story_place(spark, folder, "campaigns"), "mode": "merge",
        "transformations": [
            {"operation": "filter", "column": "product_category", "condition": "== 'FAMILY_3'"},
            {"operation": "join", "right_table": _story_place(spark, folder, "orders")["table"],
             "join_key": "campaign_id", "join_type": "left"},
            {"operation": "aggregate", "group_by": ["campaign_id", "campaign_name", "product_category"],
             "metrics": ["total_revenue", "order_count", "impressions", "campaign_cost"]},
            {"operation": "enrich", "column": "roi_pct", "value": "(total_revenue - campaign_cost) / campaign_cost * 100"},
        ],
    }), 2, "total_revenue", "campaign_cost"), 4, "roi_pct")


@query("n1_rfm_double", sql(f"{_RFM} SELECT {_RFM_SHOW} FROM rfm", "orders"))
def rfm_double(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts as doubles: one lazy plan, nothing is stored while it is built."""
    doubles = orders(spark, folder).withColumn("order_amount", F.col("order_amount").cast("double"))
    return rounded(rfm.rfm_scores(doubles, REFERENCE_DATE), 2, "monetary")


def _report(spark: SparkSession, label: str, job: dict) -> DataFrame:
    """The acceptance checks of a run as rows (run, check, passed, rows), with the rows it wrote."""
    told = run(spark, job_of(job))
    rows = told["validation"]["row_count"]
    found = [(label, c["check"], c["passed"], rows) for c in told["checks"]]
    return spark.createDataFrame(found, "run string, check string, passed boolean, rows long")


@query("v2_schema_check", """SELECT *, (SELECT count(*) FROM nation) AS rows FROM (VALUES ('strict', 'schema', true),
    ('lenient', 'schema', true), ('more columns', 'schema', false)) AS t(run, "check", passed)""")  # fmt: skip
def schema_check(spark: SparkSession, folder: str) -> DataFrame:
    whole = [{"name": f.name, "type": f.dataType.simpleString()} for f in table(spark, folder, "nation").schema.fields]
    found = None
    for label, columns, strictness in (("strict", whole, "strict"), ("lenient", whole[:1], "lenient"), ("more columns", whole[:1], "strict")):
        job = {
            "source": {"path": f"{folder}/nation.parquet"}, "target": {"path": fresh_path(spark, "checked")},
            "rules": [{"check": "schema", "columns": columns, "strictness": strictness}],
        }
        rows = _report(spark, label, job)
        found = rows if found is None else found.unionByName(rows)
    return found


@query("v12_rerun", """SELECT 'rerun' AS "check", true AS passed, count(DISTINCT o_custkey) AS rows FROM orders""")
def rerun(spark: SparkSession, folder: str) -> DataFrame:
    """The job's own check, and how many rows it was about."""
    told = run(spark, job_of({
        "source": {"path": f"{folder}/orders.parquet"}, "target": {"path": fresh_path(spark, "rerun")},
        "transformations": [{"operation": "aggregate", "group_by": ["o_custkey"], "aggregations": [
            {"function": "count", "column": "*", "alias": "n"}, {"function": "max", "column": "o_orderdate", "alias": "last"}]}],
        "rules": [{"check": "rerun"}],
    }))
    rows = [(c["check"], c["passed"], told["validation"]["row_count"]) for c in told["checks"]]
    return spark.createDataFrame(rows, '"check" string, passed boolean, rows long'.replace('"', "`"))


@query("v12_digest", """SELECT what, n AS rows, what IN ('as it is', 'other order') AS same FROM (
      SELECT 'as it is' AS what, count(*) AS n FROM lineitem UNION ALL SELECT 'other order', count(*) FROM lineitem
      UNION ALL SELECT 'one copy less', count(*) - 1 FROM lineitem UNION ALL SELECT 'one copy more', count(*) + 1 FROM lineitem
      UNION ALL SELECT 'one value changed', count(*) FROM lineitem)""")  # fmt: skip
def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the return flags and quantities of all items, of which many are equal, against those of
    the same rows with one copy less, more or changed."""
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    one = items.orderBy("l_returnflag", "l_quantity").limit(1)
    cases = {
        "as it is": items, "other order": items.repartition(7), "one copy more": items.unionByName(one),
        "one copy less": items.exceptAll(one), "one value changed": items.exceptAll(one).unionByName(one.withColumn("l_quantity", F.lit(-1.0))),
    }
    wanted = checks.digest_of(items)
    found = {what: checks.digest_of(df) for what, df in cases.items()}
    return spark.createDataFrame([(what, d[0], d == wanted) for what, d in found.items()], "what string, rows long, same boolean")


@query("r1_append_checks", """SELECT run, "check", true AS passed, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('first'), ('second'), ('merge')) AS r(run),
    (VALUES ('not_more_rows'), ('same_total:o_shippriority'), ('rerun')) AS c("check")""")  # fmt: skip
def append_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of appends and merges are about the rows of the run, not about the table."""
    path, found = fresh_path(spark, "appended"), None
    source = table(spark, folder, "orders").withColumn("o_shippriority", F.col("o_orderkey"))
    source.createOrReplaceTempView("v_append_source")
    for label, mode in (("first", "append"), ("second", "append"), ("merge", "merge")):
        place_of = {"path": path if mode == "append" else f"{path}-merged", "format": "delta", "mode": mode}
        rows = _report(spark, label, {
            "source": {"table": "v_append_source"}, "target": place_of | {"merge_keys": ["o_orderkey"]},
            "rules": [{"check": "not_more_rows"}, {"check": "same_total", "column": "o_shippriority"}, {"check": "rerun"}],
        })
        found = rows if found is None else found.unionByName(rows)
    return found
