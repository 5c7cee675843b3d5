"""Update, delete and merge as DataFrame operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col, quoted
from millrace.operators import layout

_HIT = "_hit"
_SLOT = "_slot"


class MergeConflict(ValueError):
    """Several source rows match one target row."""


def update_where(df: DataFrame, condition: str, assignments: Mapping[str, str]) -> DataFrame:
    """Columns set from SQL expressions where the condition is true. Every right-hand side sees
    the old row; a row whose condition is false or NULL stays as it is."""
    unknown = set(assignments) - set(df.columns)
    if unknown:
        raise ValueError(f"cannot update unknown columns {sorted(unknown)}")
    chosen = F.expr(condition)
    return df.select(
        *[
            F.when(chosen, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(col(f.name)).alias(f.name)
            if f.name in assignments
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def delete_where(df: DataFrame, condition: str) -> DataFrame:
    """Rows where the condition is not true; a NULL condition keeps the row."""
    return df.filter(~F.coalesce(F.expr(condition), F.lit(False)))


def update_columns_of(
    source: DataFrame, keys: Sequence[str], update_columns: Sequence[str] | None
) -> list[str]:
    """The columns a merge updates: the given ones, else all that are not keys."""
    return list(update_columns or [c for c in source.columns if c not in keys])


def conflicting_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur in several source rows and in the target."""
    repeated = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    return repeated.select(*keys).join(target.select(*keys), list(keys), "left_semi")


def check_merge_source(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> None:
    """Raise MergeConflict when a target row would be matched by several source rows.

    The target is read only when the source repeats a key at all.
    """
    repeated = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    if repeated.isEmpty():
        return
    clash = conflicting_keys(source, target, keys).take(1)
    if clash:
        raise MergeConflict(f"several source rows match the target row with key {clash[0].asDict()}")


def merge_rows(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    update_columns: Sequence[str] | None = None,
    insert_all: bool = True,
    delete_unmatched: bool = False,
    evolve: bool = False,
    keep_old_when_null: bool = False,
    checked: bool = True,
) -> DataFrame:
    """The target after a merge of `source` on equal keys (a NULL key matches nothing).

    Matched rows take the update columns from the source, source rows without a match are
    inserted (`insert_all`), target rows without a match are dropped (`delete_unmatched`).
    `evolve` adds columns only the source has; without it they are an error.
    `keep_old_when_null` leaves a column alone where the source holds NULL.

    The target is joined from the left and never needs a full outer join: a small source is
    broadcast and the target is not shuffled at all. Two large sides are dealt to as many tasks as
    their size asks for, rows without a key to all of them; all rows of one key are sorted in one task.
    """
    missing = [c for c in source.columns if c not in target.columns]
    if missing and not evolve:
        raise ValueError(f"source columns {missing} are not in the target")
    if checked:
        check_merge_source(source, target, keys)
    for name in missing:
        target = target.withColumn(name, F.lit(None).cast(source.schema[name].dataType))
    updated = set(update_columns_of(source, keys, update_columns))
    same_types = all(target.schema[k].dataType == source.schema[k].dataType for k in keys)
    tasks = layout.join_tasks(target, source) if same_types else None
    if tasks is not None:
        target, source = _dealt(target, keys, tasks), _dealt(source, keys, tasks)
        keys = [*keys, _SLOT]
    kept = _updated_target(target, source, keys, updated, delete_unmatched, keep_old_when_null)
    if not insert_all:
        return kept.drop(_SLOT)
    if tasks is None:
        present = target.select(*keys).join(source.select(*keys), list(keys), "left_semi").distinct()
        inserts = source.join(present, list(keys), "left_anti")
    else:  # the optimizer would move a semi or an anti join before the dealing
        present = target.select(*keys).join(source.select(*keys), list(keys)).distinct().withColumn(_HIT, F.lit(True))
        inserts = source.join(present, list(keys), "left").where(col(_HIT).isNull()).drop(_HIT)
    return kept.unionByName(inserts, allowMissingColumns=True).drop(_SLOT)


def _dealt(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """`df` in so many partitions by its keys and `_slot`, which is 0 but for rows without a key: these match
    nothing, so a hash of the row spreads them."""
    keyless = F.expr(" OR ".join(f"{quoted(k)} IS NULL" for k in keys))
    slotted = df.withColumn(_SLOT, F.when(keyless, layout.row_hash(df)).otherwise(F.lit(0).cast("long")))
    return slotted.repartition(tasks, *[col(k) for k in keys], F.col(_SLOT))


def _updated_target(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    updated: set[str],
    inner: bool,
    keep_old_when_null: bool,
) -> DataFrame:
    values = [c for c in target.columns if c in updated]
    changes = source.select(
        *[col(k).alias(f"_key_{k}") for k in keys],
        *[col(c).alias(f"_new_{c}") for c in values],
        F.lit(True).alias(_HIT),
    )
    matched = F.expr(" AND ".join(f"{quoted(k)} = {quoted('_key_' + k)}" for k in keys))
    joined = target.join(changes, matched, "inner" if inner else "left")

    def new_value(name: str) -> Column:
        fresh = col(f"_new_{name}").cast(target.schema[name].dataType)
        if keep_old_when_null:
            return F.coalesce(fresh, col(name)).alias(name)
        return F.when(col(_HIT), fresh).otherwise(col(name)).alias(name)

    return joined.select(*[new_value(c) if c in values else col(c) for c in target.columns])


def patch_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known keys take every non-NULL source value; unknown keys are left out."""
    return merge_rows(target, source, keys, insert_all=False, keep_old_when_null=True)


def unknown_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows that `patch_rows` leaves out, to be reported."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def append_rows(current: DataFrame, added: DataFrame) -> DataFrame:
    """Both frames by column name; a column that one of them lacks is NULL there."""
    return current.unionByName(added, allowMissingColumns=True)
