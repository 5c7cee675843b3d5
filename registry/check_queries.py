"""Checks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.plans import campaign, intent, rfm
from registry import query
from registry.views import (
    REFERENCE_DATE,
    campaigns,
    customers,
    items,
    orders,
    payments,
    rounded,
    sql,
    table,
)


def _row(name: str, observed: str, expected: str = "0", passed: str | None = None) -> str:
    test = passed or f"{observed} = {expected}"
    return (
        f"SELECT '{name}' AS \"check\", {test} AS passed, CAST({observed} AS BIGINT) AS observed, "
        f"CAST({expected} AS BIGINT) AS expected"
    )


@query(
    "v1_output_summary",
    sql(
        "SELECT count(*) AS row_count, 'customer_id,country,region' AS columns, "
        "CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning_empty' END AS status FROM v_customers",
        "customers",
    ),
)
def output_summary(spark: SparkSession, folder: str) -> DataFrame:
    shown = checks.summary(customers(spark, folder).select("customer_id", "country", "region"))
    return shown.withColumn("columns", F.array_join("columns", ","))


@query(
    "v3_null_check",
    sql(
        _row("not_null:customer_id", "count(*) FILTER (customer_id IS NULL)")
        + " FROM v_customers UNION ALL "
        + _row("not_null:email", "count(*) FILTER (email IS NULL)")
        + " FROM v_customers UNION ALL "
        + _row("not_null:country", "count(*) FILTER (country IS NULL)")
        + " FROM v_customers",
        "customers",
    ),
)
def null_check(spark: SparkSession, folder: str) -> DataFrame:
    return checks.run_row_rules(
        customers(spark, folder), checks.not_null("customer_id", "email", "country")
    )


@query(
    "v4_not_empty",
    "SELECT 'not_empty' AS \"check\", count(*) > 0 AS passed, CAST(CASE WHEN count(*) > 0 THEN 0 "
    "ELSE 1 END AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected FROM lineitem",
)
def not_empty(spark: SparkSession, folder: str) -> DataFrame:
    return checks.run_row_rules(table(spark, folder, "lineitem"), [checks.not_empty()])


@query(
    "v5_allowed_values",
    sql(
        _row("allowed:status", "count(*) FILTER (status NOT IN ('F', 'O', 'P'))")
        + " FROM v_orders UNION ALL "
        + _row("allowed:priority", "count(*) FILTER (priority NOT IN ('1-URGENT', '2-HIGH'))")
        + " FROM v_orders",
        "orders",
    ),
)
def allowed_values(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        checks.allowed("status", ["F", "O", "P"]),
        checks.allowed("priority", ["1-URGENT", "2-HIGH"]),
    ]
    return checks.run_row_rules(orders(spark, folder), rules)


@query(
    "v6_not_more_rows",
    _row("not_more_rows", "(SELECT count(*) FROM orders)", "count(*)",
         "(SELECT count(*) FROM orders) <= count(*)") + " FROM lineitem",
)
def not_more_rows(spark: SparkSession, folder: str) -> DataFrame:
    return checks.not_more_rows(table(spark, folder, "orders"), table(spark, folder, "lineitem"))


@query(
    "v7_unique_key",
    sql(
        _row("unique:order_id,order_item_id", "count(*)")
        + """ FROM (SELECT order_id, order_item_id FROM v_items GROUP BY ALL HAVING count(*) > 1)
        UNION ALL """
        + _row("unique:order_id", "count(*)")
        + " FROM (SELECT order_id FROM v_orders GROUP BY ALL HAVING count(*) > 1)",
        "items",
        "orders",
    ),
)
def unique_key(spark: SparkSession, folder: str) -> DataFrame:
    return checks.stack(
        [
            checks.unique_key(items(spark, folder), ["order_id", "order_item_id"]),
            checks.unique_key(orders(spark, folder), ["order_id"]),
        ]
    )


@query(
    "v8_ranges",
    _row("range:l_discount", "count(*) FILTER (l_discount < 0 OR l_discount > 0.05)")
    + " FROM lineitem UNION ALL "
    + _row("range:l_extendedprice", "count(*) FILTER (l_extendedprice < 0)")
    + " FROM lineitem",
)
def ranges(spark: SparkSession, folder: str) -> DataFrame:
    rules = [checks.in_range("l_discount", 0, 0.05), checks.in_range("l_extendedprice", 0)]
    return checks.run_row_rules(table(spark, folder, "lineitem"), rules)


@query(
    "v9_all_keys_kept",
    sql(
        _row(
            "one_row_per:customer_id",
            "count(DISTINCT customer_id)",
            "(SELECT count(DISTINCT customer_id) FROM v_orders)",
        )
        + " FROM v_orders",
        "orders",
    ),
)
def all_keys_kept(spark: SparkSession, folder: str) -> DataFrame:
    source = orders(spark, folder)
    return checks.all_keys_kept(rfm.customer_metrics(source, REFERENCE_DATE), source, ["customer_id"])


@query(
    "v10_references",
    _row("references:p_partkey", "count(*)")
    + " FROM lineitem WHERE l_partkey NOT IN (SELECT CASE WHEN p_size > 10 THEN p_partkey ELSE -p_partkey - 1 END FROM part)",
)
def references(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    key = F.when(F.col("p_size") > 10, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1)
    parts = table(spark, folder, "part").select(key.alias("p_partkey"))
    return checks.no_orphans(lines, parts, ["p_partkey"])


@query(
    "v11_same_total",
    sql(
        """SELECT 'same_total:payment_value' AS "check",
          sum(payment_value) = (SELECT sum(order_amount) FROM v_orders) AS passed,
          round(CAST(sum(payment_value) AS DOUBLE), 2) AS observed,
          round(CAST((SELECT sum(order_amount) FROM v_orders) AS DOUBLE), 2) AS expected
        FROM v_payments""",
        "payments",
    ),
)
def same_total(spark: SparkSession, folder: str) -> DataFrame:
    df = checks.same_total(
        payments(spark, folder), orders(spark, folder), "payment_value", "order_amount"
    )
    return rounded(df, 2, "observed", "expected")


@query(
    "v13_business_rule",
    _row("rule:shipped_after_1996", "count(*) FILTER (NOT (l_shipdate > TIMESTAMP '1996-01-01'))")
    + " FROM lineitem UNION ALL "
    + _row("rule:taxed", "count(*) FILTER (NOT (l_tax > 0))")
    + " FROM lineitem",
)
def business_rule(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        checks.holds("shipped_after_1996", "l_shipdate > timestamp_ntz'1996-01-01'"),
        checks.holds("taxed", "l_tax > 0"),
    ]
    return checks.run_row_rules(table(spark, folder, "lineitem"), rules)


_STORIES = """stories AS (SELECT doc_id, source || '/' || lang AS id,
    substr(text, 1, strpos(text || chr(10), chr(10)) - 1) AS title, text AS description,
    string_split(text, chr(10)) AS acceptance_criteria, string_split(source || ' ' || lang, ' ') AS tags,
    CASE lang WHEN 'en' THEN 'public' WHEN 'fr' THEN 'secret' END AS data_classification
  FROM documents)"""


@query(
    "v14_story_rules",
    f"""WITH {_STORIES}, parts AS (SELECT doc_id, max(length(part)) AS longest FROM
      (SELECT doc_id, unnest(acceptance_criteria) AS part FROM stories) GROUP BY 1)
    SELECT doc_id, 'id' AS rule FROM stories WHERE NOT regexp_full_match(id, '[A-Za-z0-9_.-]+')
    UNION ALL SELECT doc_id, 'title' FROM stories WHERE length(title) NOT BETWEEN 1 AND 256
    UNION ALL SELECT doc_id, 'description' FROM stories WHERE length(description) NOT BETWEEN 1 AND 2000
    UNION ALL SELECT doc_id, 'acceptance_criteria' FROM stories JOIN parts USING (doc_id)
      WHERE len(acceptance_criteria) > 20 OR longest > 500
    UNION ALL SELECT doc_id, 'data_classification' FROM stories WHERE data_classification = 'secret'""",
)
def story_rules(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.split("text", "\n")
    submitted = table(spark, folder, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang").alias("id"),
        F.get(lines, F.lit(0)).alias("title"),
        F.col("text").alias("description"),
        lines.alias("acceptance_criteria"),
        F.array("source", "lang").alias("tags"),
        F.when(F.col("lang") == "en", "public")
        .when(F.col("lang") == "fr", "secret")
        .alias("data_classification"),
    )
    return checks.violations(submitted, checks.story_rules(), ["doc_id"])


@query(
    "v5_v8_analytics_checks",
    """SELECT "check", true AS passed,
      CASE "check" WHEN 'one_row_per:customer_id' THEN (SELECT count(DISTINCT o_custkey) FROM orders) ELSE 0 END AS observed
    FROM (VALUES ('range:r_score'), ('range:f_score'), ('range:m_score'),
      ('range:rfm_score'), ('allowed:rfm_segment'), ('range:intent_score'), ('allowed:intent_segment'),
      ('allowed:campaign_grade'), ('not_empty'), ('one_row_per:customer_id')) AS t("check")""",
)
def analytics_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The acceptance rules of the prebuilt analytics; every row must have passed = true."""
    bought = orders(spark, folder)
    scored = rfm.rfm_scores(bought, REFERENCE_DATE)
    wanted = intent.intent_scores(bought, "_3")
    graded = campaign.campaign_kpis(campaigns(spark, folder), "FAMILY")
    scores = [checks.in_range(c, 1, 5) for c in ("r_score", "f_score", "m_score")]
    found = checks.stack(
        [
            checks.run_row_rules(
                scored,
                [
                    *scores,
                    checks.in_range("rfm_score", 3, 15),
                    checks.allowed("rfm_segment", rfm.SEGMENT_NAMES),
                ],
            ),
            checks.run_row_rules(
                wanted,
                [
                    checks.in_range("intent_score", 0, 100),
                    checks.allowed("intent_segment", intent.SEGMENT_NAMES),
                ],
            ),
            checks.run_row_rules(
                graded, [checks.allowed("campaign_grade", campaign.GRADE_NAMES), checks.not_empty()]
            ),
            checks.all_keys_kept(scored, bought, ["customer_id"]),
        ]
    )
    return found.select("check", "passed", "observed")
