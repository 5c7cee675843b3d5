"""Sorting, paging, duplicates, and order-dependent values over frames of any size.

A window without partition columns, or with one group that holds a large share of the rows,
would put all those rows into one task. `global_rank` and `running_total` instead cut the whole
order into ranges of about equal size, whatever the groups are, and carry small totals between
the ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.operators.layout import file_count, row_hash
from millrace.operators.selection import BOUND, Key, buckets_by, keys_at, rows_at
from millrace.sources.shared import cut_lineage

_SLICE = "_slice"


def sort_columns(entries: Sequence[Mapping[str, Any] | str]) -> list[Column]:
    """Sort keys from names or `{column, descending}`; NULLs first ascending, last descending."""
    keys = []
    for entry in entries:
        if isinstance(entry, str):
            keys.append(col(entry).asc())
        else:
            key = col(entry["column"])
            keys.append(key.desc() if entry.get("descending") else key.asc())
    return keys


def sort_rows(df: DataFrame, entries: Sequence[Mapping[str, Any] | str]) -> DataFrame:
    """Globally sorted rows. Rows with equal keys are further ordered by a hash of the row, so
    that one value with very many rows is cut over several tasks."""
    return df.orderBy(*sort_columns(entries), row_hash(df))


def top_rows(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows in the order of `keys`, found per task before they are brought together."""
    return df.orderBy(*keys).limit(n)


def page(
    df: DataFrame, entries: Sequence[Mapping[str, Any] | str], *, limit: int, offset: int = 0, bound: int = BOUND
) -> DataFrame:
    """Rows offset + 1 to offset + limit of a listing, the same way at every depth.

    Rows that tie are further ordered by a hash of the row. The place of the page is narrowed down by
    counting, until at most `bound` rows have to be sorted.
    """
    wanted = [(e, False) if isinstance(e, str) else (e["column"], bool(e.get("descending"))) for e in entries]
    keys = [Key(col(name), df.schema[name].dataType, down) for name, down in wanted]
    return rows_at(df, [*keys, Key(row_hash(df), T.LongType())], offset, limit, bound)


def drop_duplicates(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """One row per value of the columns (any of its rows), or per whole row."""
    return df.dropDuplicates(list(names)) if names else df.dropDuplicates()


def dedupe(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    strategy: str = "keep_first",
) -> DataFrame:
    """One row per key: the first or last by `order_by`, ties settled by all other columns.

    Filtering a row number to 1 lets Spark keep one row per key in every task before the
    shuffle, so a key with very many copies costs no more than any other.
    """
    if strategy == "keep_all":
        return df
    if strategy not in ("keep_first", "keep_last"):
        raise ValueError(f"unknown dedupe strategy {strategy!r}")
    if not keys:
        return df.dropDuplicates()
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in keys and f.name not in order_by and _sortable(f.dataType)
    ]
    ordered = [col(c) for c in (*order_by, *rest)] or [col(c) for c in keys]
    if strategy == "keep_last":
        ordered = [c.desc() for c in ordered]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*ordered)
    return df.withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")


def _sortable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _sortable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_sortable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def latest_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of every key by `order_by`."""
    return dedupe(df, keys, order_by, "keep_last")


def _in_slices(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows with the number of their range in the order of `keys`, about 128 MB per range.

    The numbers must be the same in all uses, so the rows are stored first.
    """
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = file_count(df) or 0
    ranged = df.repartitionByRange(wanted, *keys) if wanted > default else df.repartitionByRange(*keys)
    return cut_lineage(ranged.withColumn(_SLICE, F.spark_partition_id()), "ranges")


def global_rank(
    df: DataFrame, order_by: Sequence[Mapping[str, Any] | str], name: str = "rank"
) -> DataFrame:
    """Rank 1..n of every row in a total order, plus `<name>_total` with n.

    `order_by` must end in a unique column. Beyond the rows themselves only one count per range
    is brought together.
    """
    keys = sort_columns(order_by)
    sliced = _in_slices(df, *keys)
    sizes = sliced.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("_size"))
    # One row per range, so this window and the broadcast below stay small.
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        _SLICE,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias(f"{name}_total"),
    )
    inside = F.row_number().over(Window.partitionBy(_SLICE).orderBy(*keys))
    return (
        sliced.join(F.broadcast(offsets), _SLICE)
        .withColumn(name, F.col("_before") + inside)
        .drop(_SLICE, "_before")
    )


def ntiles(df: DataFrame, buckets: Mapping[str, Sequence[str]], n: int, bound: int = BOUND) -> DataFrame:
    """`ntile(n)` over the whole frame for several orders `{new column: order}`.

    Each order must end in a unique column. The input is stored once; the keys of the last rows of the
    first n - 1 buckets are narrowed down for all orders together, and the rows are compared with them.
    """
    held = cut_lineage(df, "ntiles")
    size = held.count()
    small, more = divmod(size, n)
    ends = [k * small + min(k, more) for k in range(1, n)]
    orders = {name: F.struct(*[col(c) for c in order]) for name, order in buckets.items()}
    cuts = keys_at(held, orders, dict.fromkeys(orders, ends), bound)
    # Of fewer rows than buckets each has a bucket of its own; the others are empty.
    own = {name: [cuts[name][r] for r in dict.fromkeys(ends) if r in cuts[name]] for name in orders}
    return held.withColumns({name: buckets_by(order, own[name]) for name, order in orders.items()})


def ntile(df: DataFrame, order_by: Sequence[str], n: int, name: str) -> DataFrame:
    """`ntile(n)` over the whole frame in a total order, without one task for all rows."""
    return ntiles(df, {name: order_by}, n)


def running_total(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    totals: Mapping[str, str],
) -> DataFrame:
    """Cumulative sums `{new column: summed column}` per group in the order of `order_by`.

    A group may hold any share of the rows: it is cut into ranges, each range is summed on its
    own, and the sum of the earlier ranges of the group is added. Rows that tie on `order_by`
    should be settled by its last column.
    """
    groups = [col(c) for c in partition_by]
    order = [col(c).asc() for c in order_by]
    sliced = _in_slices(df, *[g.asc() for g in groups], *order)
    upto = Window.partitionBy(_SLICE, *groups).orderBy(*order)
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = _carried_sums(sliced, partition_by, totals)
    joined = _left_join_with_nulls(sliced, F.broadcast(carried), [_SLICE, *partition_by])

    def total(name: str, source: str) -> Column:
        before = F.coalesce(F.col(f"_carry_{name}"), F.lit(0))
        return (before + F.coalesce(F.sum(col(source)).over(upto), F.lit(0))).alias(name)

    return joined.select(
        *[col(c) for c in df.columns], *[total(name, source) for name, source in totals.items()]
    )


def _carried_sums(
    sliced: DataFrame, partition_by: Sequence[str], totals: Mapping[str, str]
) -> DataFrame:
    """Per range and group the sums of the group in earlier ranges, only for groups that lie in
    several ranges. Those are the first and the last group of a range, so there are at most two
    rows per range."""
    groups = [col(c) for c in partition_by]
    sums = sliced.groupBy(_SLICE, *groups).agg(
        *[F.sum(col(source)).alias(f"_sum_{name}") for name, source in totals.items()]
    )
    cut = sums.withColumn("_ranges", F.count(_SLICE).over(Window.partitionBy(*groups)))
    earlier = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return cut.where("_ranges > 1").select(
        _SLICE,
        *groups,
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in totals],
    )


def _left_join_with_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that also pairs NULL keys; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & col(k).eqNullSafe(col(f"_r_{k}"))
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])
