"""Grouped aggregation by name, and the metrics a job may ask for by name only."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import AMOUNT_COLUMNS, col, exact_sum, pick_column, recency_days, safe_ratio

# Functions that keep a fixed-size state per group, so a group may hold any share of the rows.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "countDistinct": F.count_distinct,
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "first": F.first,
    "last": F.last,
    "stddev": F.stddev,
    "variance": F.variance,
    "count_if": F.count_if,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
}

_CALL = re.compile(r"^\s*(\w+)\s*\(")


def group_column(df: DataFrame, text: str) -> Column:
    """A grouping column: a column name, `expression AS name`, or a call named after itself."""
    if text in df.columns:
        return col(text)
    aliased = re.match(r"^(?P<body>.+?)\s+as\s+(?P<name>\w+)\s*$", text, re.IGNORECASE | re.DOTALL)
    if aliased:
        return F.expr(aliased["body"]).alias(aliased["name"])
    call = _CALL.match(text)
    if call:
        return F.expr(text).alias(call[1].lower())
    raise ValueError(f"cannot group by {text!r}: not a column of {df.columns} and not a call")


def aggregate_column(entry: Mapping[str, Any]) -> Column:
    """Aggregate from `{function, column, alias}`; `column` may be `*` for count.

    `first`/`last` with `order_by` give the value at the smallest/largest `order_by`.
    """
    name = str(entry["function"])
    column = str(entry.get("column") or "*")
    alias = entry.get("alias") or (name if column == "*" else f"{name}_{column}")
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; one of {sorted(AGGREGATES)}")
    if column == "*":
        if name != "count":
            raise ValueError(f"aggregate {name!r} needs a column")
        return F.count(F.lit(1)).alias(alias)
    order = entry.get("order_by")
    if order and name in ("first", "last"):
        by = F.struct(*[col(o) for o in ([order] if isinstance(order, str) else order)])
        chosen = F.min_by(col(column), by) if name == "first" else F.max_by(col(column), by)
        return chosen.alias(alias)
    return AGGREGATES[name](col(column)).alias(alias)


def aggregate(
    df: DataFrame, group_by: Sequence[str], aggregations: Sequence[Mapping[str, Any]]
) -> DataFrame:
    """Group by names or expressions; no group columns gives one row for the whole frame."""
    return df.groupBy(*[group_column(df, g) for g in group_by]).agg(
        *[aggregate_column(a) for a in aggregations]
    )


def named_metric(df: DataFrame, name: str, reference_date: str | Column | None = None) -> Column:
    """The aggregate behind a metric name."""
    return _metric(df, name, reference_date).alias(name)


def _metric(df: DataFrame, name: str, reference_date: str | Column | None) -> Column:
    if name in ("total_revenue", "total_spend", "monetary"):
        return exact_sum(df, _amount_name(df))
    if name in ("order_count", "frequency"):
        return F.count(col("order_id"))
    if name == "avg_order_value":
        return safe_ratio(exact_sum(df, _amount_name(df)), F.count(col(_amount_name(df))))
    if name == "customer_count":
        return F.count_distinct(col("customer_id"))
    if name == "avg_spend_per_customer":
        return safe_ratio(exact_sum(df, _amount_name(df)), F.count_distinct(col("customer_id")))
    if name == "recency_days":
        return recency_days(F.max(col("order_date")), reference_date)
    if name in ("impressions", "clicks", "campaign_cost", "spend"):
        return F.max(col(name))  # constant within a campaign
    raise ValueError(f"unknown metric {name!r}")


def _amount_name(df: DataFrame) -> str:
    return pick_column(df, *AMOUNT_COLUMNS)


def named_aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    metrics: Sequence[str],
    reference_date: str | Column | None = None,
) -> DataFrame:
    """Group by with metrics given by name only."""
    return df.groupBy(*[group_column(df, g) for g in group_by]).agg(
        *[named_metric(df, m, reference_date) for m in metrics]
    )


def group_count(df: DataFrame, *names: str, alias: str = "count") -> DataFrame:
    """Rows per value of the columns."""
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias(alias))


def distinct_count(df: DataFrame, name: str, alias: str = "distinct_values") -> DataFrame:
    """Number of different values of a column, a NULL counting as one value."""
    return df.select(col(name)).distinct().agg(F.count(F.lit(1)).alias(alias))
