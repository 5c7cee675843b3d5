"""The ready-made jobs as specs for `plans.runner`.

Each function takes the places of its tables and returns a plain dict in one of the accepted
dialects. Where a job sums a fact table after joining it, the spec sums first (`right_steps`, or
an aggregate step ahead of the join): the result is the same, and neither a key with very many
rows nor a many-to-many join multiplies rows before they are summed.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from millrace.plans.rfm import score_metrics
from millrace.plans.runner import register_step

Place = str | Mapping[str, Any]


def _place(place: Place) -> dict[str, Any]:
    return {"path": place} if isinstance(place, str) else dict(place)


def _right(place: Place) -> dict[str, Any]:
    given = _place(place)
    return {
        "right_path": given.get("path"),
        "right_table": given.get("table"),
        "right_format": given.get("format"),
    }


def _job(name: str, source: Place, target: Place | None, steps: list[dict], **more: Any) -> dict[str, Any]:
    job = {"id": name, "source": _place(source), "transformations": steps} | more
    if target is not None:
        job["target"] = _place(target)
    return job


# Scores need the quintiles of the whole frame, which no single SQL expression can state.
register_step("rfm_scores", lambda df, p, job: score_metrics(df, exact=p.get("exact", True)))


def clean_customers(customers: Place, target: Place | None = None) -> dict[str, Any]:
    """Customers with an id; missing e-mail and country filled."""
    steps = [
        {"operation": "filter", "column": "customer_id", "condition": "is_not_null"},
        {"operation": "fill_null", "column": "email", "value": "unknown@example.com"},
        {"operation": "fill_null", "column": "country", "value": "UNKNOWN"},
    ]
    rules = [{"check": "not_null", "column": c} for c in ("customer_id", "email", "country")]
    rules.append({"check": "not_more_rows"})
    return _job("clean_customers", customers, target, steps, rules=rules)


def customer_spend(customers: Place, orders: Place, target: Place | None = None) -> dict[str, Any]:
    """Spend and order count of every customer, zero for those without orders."""
    per_customer = {
        "operation": "aggregate",
        "group_by": ["customer_id"],
        "metrics": ["total_spend", "order_count"],
    }
    steps = [
        {
            "operation": "join",
            "params": _right(orders)
            | {"join_keys": ["customer_id"], "join_type": "left", "right_steps": [per_customer]},
        },
        {
            "operation": "aggregate",
            "params": {
                "group_by": ["customer_id", "customer_name", "email", "country"],
                "aggregations": [
                    {"function": "sum", "column": "total_spend", "alias": "total_spend"},
                    {"function": "sum", "column": "order_count", "alias": "order_count"},
                ],
            },
        },
        {"operation": "fill_null", "params": {"fill_values": {"total_spend": 0, "order_count": 0}}},
    ]
    rules = [{"check": "references", "keys": ["customer_id"], "in": _place(customers)}]
    return _job("customer_spend", customers, target, steps, rules=rules)


def monthly_region_revenue(orders: Place, target: Place | None = None) -> dict[str, Any]:
    """Revenue, orders and average order per year, month and region."""
    steps = [
        {
            "operation": "aggregate",
            "group_by": ["year", "month", "region"],
            "metrics": ["total_revenue", "order_count", "avg_order_value"],
        }
    ]
    rules = [{"check": "same_total", "column": "total_revenue", "source_column": "order_amount"}]
    return _job(
        "monthly_region_revenue",
        orders,
        target,
        steps,
        rules=rules,
        partition_columns=["year", "month"],
    )


def geo_story(orders: Place, customers: Place, target: Place | None = None) -> dict[str, Any]:
    """Revenue and customers per country and region with a flag for high revenue."""
    # Summed per customer first: one row per customer meets the join, however hot the customer.
    steps = [
        {"operation": "aggregate", "group_by": ["customer_id"], "metrics": ["total_spend"]},
        {"operation": "join", "join_key": "customer_id", "join_type": "left", "prefer": "right"}
        | _right(customers),
        {
            "operation": "aggregate",
            "params": {
                "group_by": ["country", "region"],
                "aggregations": [
                    {"function": "sum", "column": "total_spend", "alias": "total_revenue"},
                    {"function": "count", "column": "customer_id", "alias": "customer_count"},
                ],
            },
        },
        {
            "operation": "enrich",
            "params": {
                "derived_columns": [
                    {
                        "name": "avg_spend_per_customer",
                        "expression": "try_divide(double(total_revenue), double(customer_count))",
                    },
                    {"name": "is_high_value", "expression": "total_revenue > 10000"},
                ]
            },
        },
    ]
    return _job("geo_story", orders, target, steps, requires_broadcast_join=True)


def campaign_story(
    campaigns: Place, orders: Place, product: str, target: Place | None = None
) -> dict[str, Any]:
    """Orders per impression, revenue per impression and return of one product's campaigns."""
    per_campaign = {
        "operation": "aggregate",
        "group_by": ["campaign_id"],
        "metrics": ["total_revenue", "order_count"],
    }
    quoted = product.replace("'", "''")
    steps = [
        {"operation": "filter", "column": "product_category", "condition": f"== '{quoted}'"},
        {
            "operation": "join",
            "params": _right(orders)
            | {"join_keys": ["campaign_id"], "join_type": "left", "right_steps": [per_campaign]},
        },
        {"operation": "fill_null", "column": "order_count", "value": 0},
        {
            "operation": "enrich",
            "params": {
                "derived_columns": [
                    {"name": "conversion_rate", "expression": "try_divide(order_count, impressions)"},
                    {
                        "name": "revenue_per_impression",
                        "expression": "try_divide(double(total_revenue), impressions)",
                    },
                    {
                        "name": "roi_pct",
                        "expression": "try_divide(double(total_revenue - campaign_cost),"
                        " double(campaign_cost)) * 100",
                    },
                ]
            },
        },
    ]
    return _job("campaign_story", campaigns, target, steps)


def monthly_category_revenue(
    order_lines: Place, products: Place, target: Place | None = None
) -> dict[str, Any]:
    """Line totals per year, month and category, one line per order and product.

    The lines are made unique before the join, spread by order and product: after a join on the
    product all lines of one product would be in one task. Products are made unique as well, so
    that the join adds no lines.
    """
    one_each = {
        "operation": "dedupe",
        "params": {"subset_cols": ["product_id"], "keep": "keep_first"},
    }
    steps = [
        {"operation": "fill_null", "params": {"fill_values": {"unit_price": 0.0}}},
        {
            "operation": "dedupe",
            "params": {"subset_cols": ["order_id", "product_id"], "keep": "keep_first"},
        },
        {
            "operation": "join",
            "params": _right(products)
            | {"join_keys": ["product_id"], "join_type": "left", "right_steps": [one_each]},
        },
        {
            "operation": "aggregate",
            "params": {
                "group_by": ["year", "month", "category"],
                "aggregations": [
                    {"function": "sum", "column": "line_total", "alias": "monthly_revenue"},
                    {"function": "count", "column": "order_id", "alias": "order_count"},
                ],
            },
        },
    ]
    rules = [{"check": "range", "column": "monthly_revenue", "low": 0}]
    return _job(
        "monthly_category_revenue",
        order_lines,
        target,
        steps,
        rules=rules,
        partition_columns=["year", "month"],
    )


def monthly_payments_by_category(
    orders: Place,
    payments: Place,
    items: Place,
    products: Place,
    target: Place | None = None,
    delivered: str = "delivered",
) -> dict[str, Any]:
    """Payments of delivered orders per year, month and product category.

    An order's payment counts once per item, as joining payments with items on the order does.
    That is payment total times item count, so the pairs are never made.
    """
    paid = {
        "operation": "aggregate",
        "config": {
            "group_by": ["order_id"],
            "aggregations": [{"function": "sum", "column": "payment_value", "alias": "paid"}],
        },
    }
    items_per_category = [
        {
            "operation": "join",
            "config": _right(products) | {"on": "product_id", "join_type": "left"},
        },
        {
            "operation": "aggregate",
            "config": {
                "group_by": ["order_id", "product_category_name"],
                "aggregations": [{"function": "count", "column": "*", "alias": "item_count"}],
            },
        },
    ]
    steps = [
        {"operation": "filter", "config": {"condition": f"order_status = '{delivered}'"}},
        {
            "operation": "join",
            "config": _right(payments) | {"on": "order_id", "join_type": "inner", "right_steps": [paid]},
        },
        {
            "operation": "join",
            "config": _right(items)
            | {"on": "order_id", "join_type": "inner", "right_steps": items_per_category},
        },
        {"operation": "enrich", "column": "fanned_out", "value": "paid * item_count"},
        {
            "operation": "aggregate",
            "config": {
                "group_by": [
                    "year(order_purchase_timestamp)",
                    "month(order_purchase_timestamp)",
                    "product_category_name",
                ],
                "aggregations": [
                    {"function": "sum", "column": "fanned_out", "alias": "total_revenue"}
                ],
            },
        },
    ]
    return _job(
        "monthly_payments_by_category",
        orders,
        target,
        steps,
        requires_broadcast_join=True,
        partition_columns=["year", "month"],
    )


def order_frequency(
    orders: Place, customers: Place, target: Place | None = None, delivered: str = "delivered"
) -> dict[str, Any]:
    """Delivered orders per person: one_time, repeat (2 to 4) or loyal (5 and more)."""
    steps = [
        {"operation": "filter", "config": {"condition": f"order_status = '{delivered}'"}},
        {
            "operation": "aggregate",
            "config": {
                "group_by": ["customer_id"],
                "aggregations": [{"function": "count", "column": "order_id", "alias": "orders"}],
            },
        },
        {
            "operation": "join",
            "config": _right(customers) | {"on": "customer_id", "join_type": "inner"},
        },
        {
            "operation": "aggregate",
            "config": {
                "group_by": ["customer_unique_id"],
                "aggregations": [{"function": "sum", "column": "orders", "alias": "order_count"}],
            },
        },
        {
            "operation": "enrich",
            "config": {
                "derived_columns": [
                    {
                        "name": "customer_segment",
                        "expression": "CASE WHEN order_count >= 5 THEN 'loyal'"
                        " WHEN order_count >= 2 THEN 'repeat' ELSE 'one_time' END",
                    }
                ]
            },
        },
    ]
    return _job("order_frequency", orders, target, steps)


def delivered_orders(
    orders: Place, target: Place | None = None, delivered: str = "delivered"
) -> dict[str, Any]:
    """Delivered orders that have an id."""
    steps = [
        {"operation": "filter", "column": "order_status", "condition": f"== '{delivered}'"},
        {"operation": "filter", "column": "order_id", "condition": "is_not_null"},
    ]
    rules = [{"check": "not_empty"}, {"check": "not_null", "column": "order_id"}]
    return _job("delivered_orders", orders, target, steps, rules=rules)


def seller_revenue(
    items: Place, orders: Place, target: Place | None = None, delivered: str = "delivered"
) -> dict[str, Any]:
    """Price and freight of delivered orders per seller, highest first."""
    only_delivered = {"operation": "filter", "column": "order_status", "condition": f"== '{delivered}'"}
    steps = [
        {
            "operation": "join",
            "params": _right(orders)
            | {"join_keys": ["order_id"], "join_type": "inner", "right_steps": [only_delivered]},
        },
        {"operation": "enrich", "column": "item_revenue", "value": "price + freight_value"},
        {
            "operation": "aggregate",
            "params": {
                "group_by": ["seller_id"],
                "aggregations": [
                    {"function": "sum", "column": "item_revenue", "alias": "revenue"}
                ],
            },
        },
        {
            "operation": "sort",
            "params": {"sort_columns": [{"column": "revenue", "descending": True}, "seller_id"]},
        },
    ]
    return _job("seller_revenue", items, target, steps)


def monthly_revenue_english(
    items: Place,
    orders: Place,
    products: Place,
    translation: Place,
    target: Place | None = None,
    delivered: str = "delivered",
) -> dict[str, Any]:
    """Item prices of delivered orders per year, month and English category name."""
    only_delivered = {"operation": "filter", "column": "order_status", "condition": f"== '{delivered}'"}
    total = [{"function": "sum", "column": "price", "alias": "price"}]
    steps = [
        {
            "operation": "join",
            "params": _right(orders)
            | {"join_keys": ["order_id"], "join_type": "inner", "right_steps": [only_delivered]},
        },
        {
            "operation": "aggregate",
            "params": {
                "group_by": [
                    "year(order_purchase_timestamp)",
                    "month(order_purchase_timestamp)",
                    "product_id",
                ],
                "aggregations": total,
            },
        },
        {
            "operation": "join",
            "params": _right(products) | {"join_keys": ["product_id"], "join_type": "left"},
        },
        {
            "operation": "join",
            "params": _right(translation)
            | {"join_keys": ["product_category_name"], "join_type": "left"},
        },
        {
            "operation": "aggregate",
            "params": {
                "group_by": ["year", "month", "product_category_name_english"],
                "aggregations": [{"function": "sum", "column": "price", "alias": "total_revenue"}],
            },
        },
    ]
    return _job(
        "monthly_revenue_english",
        items,
        target,
        steps,
        requires_broadcast_join=True,
        partition_columns=["year", "month"],
    )


def rfm_story(
    orders: Place, target: Place | None = None, reference_date: str | None = None
) -> dict[str, Any]:
    """RFM scores as a spec: metrics, missing spend as 0, recency, scores and segment."""
    today = "current_date()" if reference_date is None else f"date'{reference_date}'"
    steps = [
        {
            "operation": "aggregate",
            "params": {
                "group_by": ["customer_id"],
                "aggregations": [
                    {"function": "max", "column": "order_date", "alias": "last_order_date"},
                    {"function": "count", "column": "order_id", "alias": "frequency"},
                    {"function": "sum", "column": "order_amount", "alias": "monetary"},
                ],
            },
        },
        {"operation": "fill_null", "params": {"fill_values": {"monetary": 0.0}}},
        {
            "operation": "enrich",
            "params": {
                "derived_columns": [
                    {"name": "recency_days", "expression": f"datediff({today}, last_order_date)"}
                ]
            },
        },
        {"operation": "rfm_scores"},
    ]
    rules = [
        {"check": "not_null", "column": "rfm_segment"},
        {"check": "one_row_per", "keys": ["customer_id"]},
    ]
    return _job(
        "rfm_story", orders, target, steps, rules=rules, partition_columns=["rfm_segment"]
    )


def order_enrichment(
    orders: Place, target: Place | None = None, reference_date: str | None = None
) -> dict[str, Any]:
    """Orders with their age in days, a recent flag (30 days) and revenue per item."""
    today = "current_date()" if reference_date is None else f"date'{reference_date}'"
    steps = [
        {
            "operation": "enrich",
            "params": {
                "derived_columns": [
                    {"name": "recency_days", "expression": f"datediff({today}, order_date)"},
                    {"name": "is_recent", "expression": "recency_days <= 30"},
                    {
                        "name": "revenue_per_item",
                        "expression": "try_divide(double(total), double(qty))",
                    },
                ]
            },
        }
    ]
    return _job("order_enrichment", orders, target, steps)
