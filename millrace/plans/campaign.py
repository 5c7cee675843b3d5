"""Campaign key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import (
    AMOUNT_COLUMNS,
    COST_COLUMNS,
    PRODUCT_COLUMNS,
    col,
    guarded_ratio,
    ladder,
    pick_column,
)
from millrace.operators.columns import keep_containing, zero_fill
from millrace.plans.calling import frame, save
from millrace.sources.files import Dataset

# Lower bounds of the return on investment in percent and their grades.
GRADES = ((2000.0, "A"), (1000.0, "B"), (0.0, "C"))
LOWEST_GRADE = "D"
GRADE_NAMES = ("A", "B", "C", "D")


def campaign_kpis(
    campaigns: DataFrame, product: str, orders: DataFrame | None = None
) -> DataFrame:
    """Conversion rate, revenue per impression, return on investment and grade of the campaigns
    whose product holds `product`.

    With orders, revenue and order count come from the orders of that product; campaigns without
    orders stay with zero. Conversions fall back to the order count where there is no such column.
    """
    chosen = keep_containing(campaigns, pick_column(campaigns, *PRODUCT_COLUMNS), product)
    revenue = "revenue"
    if orders is not None:
        revenue = "total_revenue"
        chosen = chosen.join(_order_totals(orders, product), "campaign_id", "left")
    base = zero_fill(chosen)
    cost = col(pick_column(base, *COST_COLUMNS))
    conversions = col(pick_column(base, "conversions", "order_count"))
    earned = col(revenue)
    return (
        base.withColumn("conversion_rate", guarded_ratio(conversions, F.col("impressions")))
        .withColumn("revenue_per_impression", guarded_ratio(earned, F.col("impressions")))
        .withColumn("roi_pct", guarded_ratio(earned - cost, cost) * 100)
        .withColumn("campaign_grade", ladder(F.col("roi_pct"), GRADES, LOWEST_GRADE))
    )


def _order_totals(orders: DataFrame, product: str) -> DataFrame:
    bought = keep_containing(orders, pick_column(orders, *PRODUCT_COLUMNS), product)
    return bought.groupBy("campaign_id").agg(
        F.count(col("order_id")).alias("order_count"),
        F.sum(col(pick_column(orders, *AMOUNT_COLUMNS))).alias("total_revenue"),
    )


def run_campaign(
    spark: SparkSession,
    campaigns: DataFrame | str | Dataset,
    product: str,
    orders: DataFrame | str | Dataset | None = None,
    output: str | Dataset | None = None,
) -> DataFrame:
    """Campaign key figures from DataFrames or paths, written when an output is given."""
    bought = None if orders is None else frame(spark, orders)
    return save(campaign_kpis(frame(spark, campaigns), product, bought), output)


def campaign_summary(kpis: DataFrame) -> DataFrame:
    """Averages over all campaigns, one row."""
    return kpis.agg(
        F.round(F.avg("conversion_rate"), 4).alias("avg_conversion_rate"),
        F.round(F.avg("roi_pct"), 2).alias("avg_roi_pct"),
        F.round(F.avg("revenue_per_impression"), 4).alias("avg_rev_per_impression"),
    )


def grade_breakdown(kpis: DataFrame) -> DataFrame:
    """Campaigns per grade."""
    return (
        kpis.groupBy("campaign_grade").agg(F.count(F.lit(1)).alias("count")).orderBy("campaign_grade")
    )
