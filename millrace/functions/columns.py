"""Column lookup by candidate name and the reusable column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column names the input tables use for the same thing, best first.
AMOUNT_COLUMNS = ("total_amount", "order_amount")
CATEGORY_COLUMNS = ("category", "product_category", "product_family")
COST_COLUMNS = ("spend", "campaign_cost")
PRODUCT_COLUMNS = ("product_family", "product_category")


def pick_column(df: DataFrame, *candidates: str, required: bool = True) -> str | None:
    """First candidate that `df` has. Reads the schema only, so it starts no job."""
    present = set(df.columns)
    for name in candidates:
        if name in present:
            return name
    if required:
        raise ValueError(f"none of the columns {list(candidates)} exist; have {df.columns}")
    return None


def quoted(name: str) -> str:
    """Column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col(quoted(name))


def guarded_ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """numerator / denominator as double, `otherwise` when the denominator is null or <= 0."""
    quotient = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, quotient).otherwise(F.lit(otherwise))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def exact_sum(df: DataFrame, name: str) -> Column:
    """Sum of a column that doesn't depend on the order of its rows: doubles are added as decimals
    with six digits after the point, and the sum is a double again."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.sum(col(name).cast("decimal(32,6)")).cast("double")
    return F.sum(col(name))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]. A NULL value gives `low`: greatest() skips NULLs."""
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def ladder(value: Column, rungs: Sequence[tuple[float, str]], bottom: str) -> Column:
    """Label of the first rung (bound, label) with value >= bound, else `bottom`."""
    expression: Column | None = None
    for bound, label in rungs:
        branch = value >= F.lit(bound)
        expression = (
            F.when(branch, F.lit(label)) if expression is None else expression.when(branch, F.lit(label))
        )
    return F.lit(bottom) if expression is None else expression.otherwise(F.lit(bottom))


def recency_days(last_date: Column, reference_date: str | Column | None = None) -> Column:
    """Days from `last_date` to the reference date (today when it is not given)."""
    if reference_date is None:
        until = F.current_date()
    elif isinstance(reference_date, Column):
        until = reference_date
    else:
        until = F.lit(reference_date).cast("date")
    return F.datediff(until, last_date.cast("date"))


def snake_case(name: str, separator: str = "_") -> str:
    """`OrderTotal (USD)` -> `order_total_usd`."""
    words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name)
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", words)
    return separator.join(re.findall(r"[^\W_]+", words)).lower()


def round_half_up(value: Column, digits: int) -> Column:
    """A double rounded to `digits` decimals as most engines do it: scaled, rounded to a whole number, scaled back.

    Spark's own `round` goes by the shortest decimal text of the double, so that 3296.5499999999997, which is
    what 13186200 / 400000 * 100 gives, falls to 3296.5.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale, 0) / scale
