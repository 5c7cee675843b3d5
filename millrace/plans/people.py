"""RFM figures per person, where one person may hold several customer ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import exact_sum, recency_days
from millrace.plans.rfm import score_metrics


def person_metrics(
    customers: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    reference_date: str | Column | None = None,
) -> DataFrame:
    """(customer_unique_id, recency_days, frequency, monetary): orders are counted once however
    many payments they have, and all payments are summed."""
    paid = payments.groupBy("order_id").agg(exact_sum(payments, "payment_value").alias("paid"))
    bought = orders.select("order_id", "customer_id", "order_purchase_timestamp").join(paid, "order_id")
    people = customers.select("customer_id", "customer_unique_id")
    return (
        bought.join(people, "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            recency_days(F.max("order_purchase_timestamp"), reference_date).alias("recency_days"),
            F.count_distinct("order_id").alias("frequency"),
            exact_sum(paid, "paid").alias("monetary"),
        )
    )


def person_rfm(
    customers: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    reference_date: str | Column | None = None,
) -> DataFrame:
    """Scores and segments per person."""
    return score_metrics(person_metrics(customers, orders, payments, reference_date))
