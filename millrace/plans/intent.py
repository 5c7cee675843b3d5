"""Purchase intent of customers for a target category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import (
    AMOUNT_COLUMNS,
    CATEGORY_COLUMNS,
    clamp,
    col,
    ladder,
    pick_column,
    safe_ratio,
)
from millrace.operators.ordering import top_rows
from millrace.plans.calling import frame, save
from millrace.sources.files import Dataset

# Weights of the score, its range, and the segments by lower bound.
TARGET_WEIGHT = 10.0
SPEND_DIVISOR = 500.0
DIVERSITY_WEIGHT = 2.0
ORDERS_WEIGHT = 5.0
SCORE_RANGE = (0.0, 100.0)
SEGMENTS = ((30.0, "High Intent"), (10.0, "Medium Intent"))
LOWEST_SEGMENT = "Low Intent"
SEGMENT_NAMES = ("High Intent", "Medium Intent", "Low Intent")


def intent_scores(orders: DataFrame, target: str) -> DataFrame:
    """Purchase figures, intent_score 0..100 and intent_segment per customer.

    Without a category column no order counts as a target purchase and the diversity is 1.
    """
    return _scored(_signals(orders, target))


def _signals(orders: DataFrame, target: str) -> DataFrame:
    amount = col(pick_column(orders, *AMOUNT_COLUMNS))
    figures = [
        safe_ratio(F.sum(amount), F.count(amount)).alias("avg_spend"),
        F.count(col("order_id")).alias("total_orders"),
        F.sum(amount).alias("total_spent"),
    ]
    name = pick_column(orders, *CATEGORY_COLUMNS, required=False)
    if name is None:
        no_category = [
            F.lit(0).cast("bigint").alias("target_purchases"),
            F.lit(1).cast("bigint").alias("category_diversity"),
        ]
        return orders.groupBy("customer_id").agg(*figures).select("*", *no_category)
    category = col(name)
    return orders.groupBy("customer_id").agg(
        *figures,
        F.count_if(category.contains(target)).alias("target_purchases"),
        F.count_distinct(category).alias("category_diversity"),
    )


def _scored(signals: DataFrame) -> DataFrame:
    raw = (
        F.col("target_purchases") * TARGET_WEIGHT
        + F.col("avg_spend") / SPEND_DIVISOR
        + F.col("category_diversity") * DIVERSITY_WEIGHT
        + F.log1p(F.col("total_orders")) * ORDERS_WEIGHT
    )
    return signals.withColumn("intent_score", clamp(raw, *SCORE_RANGE)).withColumn(
        "intent_segment", ladder(F.col("intent_score"), SEGMENTS, LOWEST_SEGMENT)
    )


def run_intent(
    spark: SparkSession,
    orders: DataFrame | str | Dataset,
    target: str,
    output: str | Dataset | None = None,
) -> DataFrame:
    """Intent scores from a DataFrame or path, written when an output is given."""
    return save(intent_scores(frame(spark, orders), target), output)


def intent_distribution(intent: DataFrame) -> DataFrame:
    """Customers, average score and revenue per intent segment, highest score first."""
    return (
        intent.groupBy("intent_segment")
        .agg(
            F.count(F.col("customer_id")).alias("customer_count"),
            F.round(F.avg("intent_score"), 1).alias("avg_score"),
            F.round(F.sum(F.col("total_spent")), 0).alias("total_revenue"),
        )
        .orderBy(F.col("avg_score").desc(), "intent_segment")
    )


def with_intent(rfm: DataFrame, intent: DataFrame) -> DataFrame:
    """RFM customers with their intent score and segment."""
    return rfm.join(intent.select("customer_id", "intent_score", "intent_segment"), "customer_id")


def segment_cross_table(combined: DataFrame) -> DataFrame:
    """Customers and average spend per pair of RFM and intent segment."""
    return (
        combined.groupBy("rfm_segment", "intent_segment")
        .agg(
            F.count(F.col("customer_id")).alias("count"),
            F.round(F.avg(F.col("monetary").cast("double")), 0).alias("avg_spend"),
        )
        .orderBy("rfm_segment", "intent_segment")
    )


def high_value_targets(combined: DataFrame, n: int = 10) -> DataFrame:
    """The n highest-spending Champions with High Intent."""
    chosen = combined.filter(
        (F.col("rfm_segment") == "Champions") & (F.col("intent_segment") == "High Intent")
    ).select("customer_id", "rfm_segment", "intent_segment", "monetary", "intent_score")
    return top_rows(chosen, n, F.col("monetary").desc(), F.col("customer_id"))
