"""Equi-joins against secondary tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.operators.layout import BROADCAST_LIMIT_MB, broadcast_if_small

# The accepted join types. A cross join has no keys, so it is not one of them.
JOIN_TYPES = ("inner", "left", "right", "full", "left_semi", "left_anti")
_SPELLINGS = {
    "left_outer": "left",
    "leftouter": "left",
    "right_outer": "right",
    "rightouter": "right",
    "outer": "full",
    "full_outer": "full",
    "fullouter": "full",
    "semi": "left_semi",
    "leftsemi": "left_semi",
    "anti": "left_anti",
    "leftanti": "left_anti",
}


def join_type(name: str) -> str:
    """Spark's name of a join type, from any of its spellings."""
    wanted = _SPELLINGS.get(name.lower(), name.lower())
    if wanted not in JOIN_TYPES:
        raise ValueError(f"unknown join type {name!r}; one of {JOIN_TYPES}")
    return wanted


def equi_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    prefer: str | None = None,
    split_hot: bool = False,
) -> DataFrame:
    """Join on equally named keys.

    A non-key column that both sides have would be ambiguous afterwards: `prefer="right"` or
    `"left"` says whose copy stays; without it such a column is an error.

    Adaptive execution splits a key with very many rows in an inner join and on the preserved
    side of an outer join, but not on the other side. `split_hot` writes an outer join as an
    inner join plus the rows without a match, so that either side may hold such a key.
    """
    kind = join_type(how)
    if not keys:
        raise ValueError("a join needs at least one key")
    if kind in ("left_semi", "left_anti"):
        return left.join(right.select(*keys), list(keys), kind)
    shared = [c for c in left.columns if c in set(right.columns) - set(keys)]
    if shared and prefer == "right":
        left = left.drop(*shared)
    elif shared and prefer == "left":
        right = right.drop(*shared)
    elif shared:
        raise ValueError(f"columns {shared} are on both sides of the join; say whose to prefer")
    if split_hot and kind != "inner":
        return _outer_in_parts(left, right, list(keys), kind)
    return left.join(right, list(keys), kind)


def _outer_in_parts(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    parts = [left.join(right, keys, "inner")]
    if kind in ("left", "full"):
        parts.append(left.join(right.select(*keys).distinct(), keys, "left_anti"))
    if kind in ("right", "full"):
        parts.append(right.join(left.select(*keys).distinct(), keys, "left_anti"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    limit_mb: float = BROADCAST_LIMIT_MB,
    prefer: str | None = None,
    split_hot: bool = False,
) -> DataFrame:
    """Join whose right side is broadcast when its estimated size is within `limit_mb`.

    A larger right side joins by shuffle, where adaptive execution splits skewed partitions.
    """
    small = broadcast_if_small(right, limit_mb)
    return equi_join(left, small, keys, how, prefer=prefer, split_hot=split_hot)


def pick_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that a scan below reads no others."""
    return df.select(*[col(n) for n in names])


def one_row_per_key(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """A many-rows-per-key table reduced for use as a lookup side."""
    return df.groupBy(*keys).agg(*aggregates)


def star_join(
    facts: DataFrame,
    key: str,
    totals: DataFrame,
    parts: DataFrame,
    group_by: Sequence[str],
    sums: Sequence[str],
) -> DataFrame:
    """Sums over the join of `facts` with two tables that have many rows per key, without that join.

    `totals` is (key, measures); `parts` is (key, some of the group columns). Rows of the full join
    are the products of the row counts of a key, so each measure is summed once per key and
    multiplied by the number of parts: gives `group_by`, `rows` and the `sums`.
    """
    summed = totals.groupBy(key).agg(F.count(F.lit(1)).alias("_totals"), *[F.sum(col(s)).alias(s) for s in sums])
    inside = [c for c in group_by if c in parts.columns]
    counted = parts.groupBy(key, *inside).agg(F.count(F.lit(1)).alias("_parts"))
    joined = facts.join(summed, key).join(counted, key)
    return joined.groupBy(*group_by).agg(
        F.sum(F.col("_totals") * F.col("_parts")).alias("rows"),
        *[F.sum(col(s) * F.col("_parts")).alias(s) for s in sums],
    )


def orphans(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is missing in the dimension."""
    return equi_join(df, dimension, keys, "left_anti")


def total_mismatch(left: DataFrame, right: DataFrame, left_total: Column, right_total: Column) -> DataFrame:
    """One row (left_total, right_total, passed) comparing a total over two frames."""
    other = right.agg(right_total.alias("right_total")).scalar()
    return left.agg(left_total.alias("left_total")).select(
        "left_total", other.alias("right_total")
    ).withColumn("passed", F.col("left_total").eqNullSafe(F.col("right_total")))
