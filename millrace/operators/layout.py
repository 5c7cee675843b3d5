"""Physical layout: size estimates, broadcast gating, file sizing, clustering, caching."""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.operators.selection import collectable, literal

log = logging.getLogger(__name__)

MEGABYTE = 1024 * 1024

# What the optimizer reports for data it knows nothing about.
_UNKNOWN_BYTES = 2**62

# Classes of a Z-order column at most (as bits), and sampled rows per class.
MOST_Z_BITS = 10
Z_SAMPLE_PER_CLASS = 32

# Size limits of the write and join helpers.
BROADCAST_LIMIT_MB = 10
TARGET_FILE_MB = 128
SMALL_OUTPUT_PARTITIONS = 10

# Estimated bytes of both sides that one task of a dealt join sorts; rows take several times that in memory.
JOIN_TASK_MB = 16


def estimated_bytes(df: DataFrame) -> int | None:
    """Size the optimizer expects after pruning, None where no estimate can be had."""
    if not hasattr(df, "_jdf"):  # a Connect session has no plan object
        return None
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_mb: float = BROADCAST_LIMIT_MB) -> DataFrame:
    """`df` with a broadcast hint when its estimate is within the limit, else unchanged.

    Without table statistics the estimate of a filter or aggregate is the size of its input,
    so it errs on the large side and an unhinted join is still open to adaptive execution, which goes by
    measured sizes. The estimate bounds nothing where rows are made, by an explode: such a frame is left to it.
    """
    size = estimated_bytes(df)
    if size is not None and size <= limit_mb * MEGABYTE and not _makes_rows(df):
        return F.broadcast(df)
    return df


def _makes_rows(df: DataFrame) -> bool:
    """Whether the plan turns rows into several."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.search(r"^[\s:+-]*(Generate|Expand)\b", plan, re.MULTILINE) is not None


def output_bytes(df: DataFrame) -> int | None:
    """Expected size of a result for cutting it into files, None where nothing is known.

    Without statistics the optimizer multiplies the sizes of the two sides of a join, which is
    far off for equi-joins; the result is then taken to be no larger than all inputs together.
    """
    size = estimated_bytes(df)
    if size is None:
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    inputs = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(i >= _UNKNOWN_BYTES for i in inputs):
        return None
    return min(size, sum(inputs))


def file_count(df: DataFrame, target_mb: float = TARGET_FILE_MB) -> int | None:
    """Number of output files of about `target_mb`, None without an estimate."""
    size = output_bytes(df)
    return None if size is None else max(1, math.ceil(size / (target_mb * MEGABYTE)))


def join_tasks(left: DataFrame, right: DataFrame, task_mb: float = JOIN_TASK_MB) -> int | None:
    """Tasks for a join of two large frames, so that what one of them sorts stays the same at any scale.

    None where adaptive execution is to choose: the right side is small enough to be broadcast, or a
    size isn't known, or rows are made.
    """
    sizes = [output_bytes(left), output_bytes(right)]
    if None in sizes or sizes[1] <= BROADCAST_LIMIT_MB * MEGABYTE or _makes_rows(left) or _makes_rows(right):
        return None
    return max(1, math.ceil(sum(sizes) / (task_mb * MEGABYTE)))


def repartition_for_write(
    df: DataFrame, target_mb: float = TARGET_FILE_MB, partition_by: Sequence[str] = ()
) -> DataFrame:
    """`df` spread for files of about `target_mb`.

    With partition columns the rows are rebalanced by them: adaptive execution splits a partition
    value that holds many rows over several tasks, where a plain hash repartition would not.
    """
    count = file_count(df, target_mb)
    if partition_by:
        keys = [col(c) for c in partition_by]
        return df.hint("rebalance", *([] if count is None else [count]), *keys)
    return df if count is None else df.repartition(count)


def coalesce_small_output(df: DataFrame, max_partitions: int = SMALL_OUTPUT_PARTITIONS) -> DataFrame:
    """At most `max_partitions` partitions, without a shuffle; never more than there are."""
    return df.coalesce(max_partitions)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row."""
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if _hashable(f.dataType)])


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return False
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, T.VariantType)


def cluster_rows(
    df: DataFrame, order_by: Sequence[str] = (), target_mb: float = TARGET_FILE_MB
) -> DataFrame:
    """Rows in files of about `target_mb`, near values together when `order_by` is given.

    With several columns the files follow a Z-order curve, so that a filter on any one of them
    skips files. The last range key is a hash of the row: a value that a large share of the rows
    has is cut over several files instead of filling one task.
    """
    count = file_count(df, target_mb)
    if not order_by:
        return repartition_for_write(df, target_mb)
    keys = [col(c) for c in order_by]
    hashed = row_hash(df)
    if len(order_by) > 1:
        curved = with_z_value(df, order_by, "_z")
        lead = [F.col("_z")]
    else:
        curved, lead = df, []
    order = [*lead, *keys, hashed]
    ranged = curved.repartitionByRange(*([] if count is None else [count]), *order)
    return ranged.sortWithinPartitions(*lead, *keys).select(*[col(c) for c in df.columns])


def with_z_value(df: DataFrame, names: Sequence[str], alias: str, bits: int | None = None) -> DataFrame:
    """Adds the interleaved bits of the rank classes of the columns.

    Every column is cut into 2^bits classes of about equal size, by whole values of any type that
    sorts. The bounds come from a random sample of rows, which is taken first; they are constants of the
    plan, so that no row carries them. Without `bits` there are about four cells per output file.
    """
    if bits is None:
        cells = 4 * (file_count(df) or 1)
        bits = max(4, min(MOST_Z_BITS, math.ceil(math.log2(cells) / len(names))))
    classes = 2**bits
    types = [df.schema[n].dataType for n in names]
    keys = df.select(*[col(n).alias(f"k{i}") for i, n in enumerate(names)])
    sample = keys.orderBy(F.rand(7)).limit(Z_SAMPLE_PER_CLASS * classes)

    def cuts(name: str, dtype: T.DataType) -> Column:  # of a sample of bounded size
        return F.transform(_bounds(F.array_sort(F.collect_list(name)), classes), lambda v: collectable(v, dtype))

    found = sample.agg(*[cuts(k, t).alias(k) for k, t in zip(keys.columns, types)]).first()
    bounds = [F.array(*[literal(v, t) for v in found[i]]) for i, t in enumerate(types)]
    ranks = {f"_c{i}": _class_of(col(n), bounds[i], bits) for i, n in enumerate(names)}
    spread = " | ".join(
        f"shiftleft(bigint(shiftright({c}, {bit}) & 1), {bit * len(names) + i})"
        for i, c in enumerate(ranks)
        for bit in range(bits)
    )
    return df.withColumns(ranks).withColumn(alias, F.expr(spread)).drop(*ranks)


def _bounds(values: Column, classes: int) -> Column:
    """The values that cut the sorted sample into classes."""
    cuts = F.sequence(F.lit(1), F.lit(classes - 1))

    def cut(ordered: Column) -> Column:
        return F.transform(cuts, lambda i: F.get(ordered, F.floor(i * F.size(ordered) / classes).cast("int")))

    return F.get(F.transform(F.array(values), cut), F.lit(0))


def _class_of(value: Column, bounds: Column, bits: int) -> Column:
    """How many bounds lie below the value, by halving; NULL is in class 0."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def halve(found: Column, step: Column) -> Column:
        return F.when(F.get(bounds, found + step - 1) < value, found + step).otherwise(found)

    return F.reduce(steps, F.lit(0), halve)


def zone_map(written: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per file of rows that were read from files: `file`, `rows` and the range `<name>_min`, `<name>_max` of
    the columns, which is what a filter on them goes by."""
    ends = [f(col(n)).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))]
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends)


def files_touched(zones: DataFrame, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """For a filter on each of the columns, from a low to a high value: (column, files, touched), where
    the files that aren't touched can't hold such a row and are skipped."""
    counted = zones.agg(
        F.count(F.lit(1)).alias("files"),
        *[F.count_if((F.col(f"{n}_max") >= F.lit(low)) & (F.col(f"{n}_min") <= F.lit(high))).alias(f"t{i}") for i, (n, (low, high)) in enumerate(ranges.items())],
    )
    entries = [F.struct(F.lit(n).alias("column"), F.col("files"), F.col(f"t{i}").alias("touched")) for i, n in enumerate(ranges)]
    return counted.select(F.inline(F.array(*entries)))


@contextmanager
def cached(df: DataFrame, label: str = "unnamed") -> Iterator[DataFrame]:
    """`df` persisted for the length of the block; for a frame that feeds several actions."""
    log.info("caching %s", label)
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()
        log.info("released %s", label)
