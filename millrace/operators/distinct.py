"""Counts of different keys that can be rolled up: exact bitmaps, joined by or.

A sum of distinct counts counts a key once per group it occurs in. Here the keys of a group are bits of
bitmaps of fixed size, so that the groups of a coarser level are the union of those below, and no level
needs the keys again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.operators.joins import lookup_join
from millrace.operators.ordering import global_rank

BITS, BLOCK = "bits", "block"


def numbered(df: DataFrame, key: str, alias: str = "number") -> DataFrame:
    """One row (key, number) per value of the key, numbered without gaps from 1; NULL has none.

    A bitmap block covers 32768 numbers in a row, so dense numbers make few blocks.
    """
    values = df.select(col(key)).where(col(key).isNotNull()).distinct()
    return global_rank(values, [key], alias).select(key, F.col(alias).cast("bigint").alias(alias))


def key_bitmaps(df: DataFrame, groups: Sequence[str], number: str) -> DataFrame:
    """Per group and block of numbers the bits of those that occur; NULLs don't count."""
    placed = df.where(col(number).isNotNull()).select(
        *[col(g) for g in groups], F.bitmap_bucket_number(number).alias(BLOCK), F.bitmap_bit_position(number).alias("position")
    )
    return placed.groupBy(*groups, BLOCK).agg(F.bitmap_construct_agg("position").alias(BITS))


def group_bitmaps(df: DataFrame, groups: Sequence[str], key: str) -> DataFrame:
    """`key_bitmaps` for keys of any type."""
    numbers = numbered(df, key)
    pairs = df.select(*[col(g) for g in groups], col(key)).distinct()
    return key_bitmaps(lookup_join(pairs, numbers, [key], "inner"), groups, "number")


def united(bitmaps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The bitmaps of a coarser level, whose groups are some of the columns."""
    return bitmaps.groupBy(*groups, BLOCK).agg(F.bitmap_or_agg(BITS).alias(BITS))


def counted(bitmaps: DataFrame, groups: Sequence[str], alias: str = "distinct_keys") -> DataFrame:
    """Different keys per group, of the bitmaps' own level or a coarser one; one row without groups."""
    one = united(bitmaps, groups)
    total = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(alias)
    return one.groupBy(*groups).agg(total) if groups else one.agg(total)
