"""Checks of a result against its acceptance rules.

Row-wise rules (nulls, allowed values, ranges, predicates, sizes) become aggregates over one
scan. Rules about keys or other tables need a grouping or a join and run as their own plan.
Every check gives rows (check, passed, observed, expected).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col


@dataclass(frozen=True)
class RowRule:
    """A rule that holds when the aggregate `bad` over all rows is 0."""

    name: str
    bad: Column


def not_null(*names: str) -> list[RowRule]:
    """No NULL in any of the columns."""
    return [RowRule(f"not_null:{n}", F.count_if(col(n).isNull())) for n in names]


def allowed(name: str, values: Sequence[Any]) -> RowRule:
    """Every value is one of `values`; NULL is not."""
    inside = F.coalesce(col(name).isin(list(values)), F.lit(False))
    return RowRule(f"allowed:{name}", F.count_if(~inside))


def in_range(name: str, low: float | None = None, high: float | None = None) -> RowRule:
    """No value below `low` or above `high`; NULLs pass."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (col(name) < F.lit(low))
    if high is not None:
        outside = outside | (col(name) > F.lit(high))
    return RowRule(f"range:{name}", F.count_if(outside))


def holds(label: str, predicate: str) -> RowRule:
    """The SQL predicate is true in every row; NULL counts as a failure."""
    return RowRule(f"rule:{label}", F.count_if(~F.coalesce(F.expr(predicate), F.lit(False))))


def not_empty() -> RowRule:
    """At least one row."""
    return RowRule("not_empty", F.when(F.count(F.lit(1)) > 0, 0).otherwise(1))


_RESULT = "check string, passed boolean, observed bigint, expected bigint"


def run_row_rules(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """All rules over one scan of `df`: observed is the number of offending rows."""
    counts = df.agg(*[r.bad.cast("bigint").alias(f"r{i}") for i, r in enumerate(rules)])
    entries = [
        F.struct(
            F.lit(r.name).alias("check"),
            (F.col(f"r{i}") == 0).alias("passed"),
            F.col(f"r{i}").alias("observed"),
            F.lit(0).cast("bigint").alias("expected"),
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*entries)))


def _verdict(df: DataFrame, name: str, observed: str, expected: Column, passed: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        passed.alias("passed"),
        F.col(observed).cast("bigint").alias("observed"),
        expected.cast("bigint").alias("expected"),
    )


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """No key value in more than one row; observed is the number of repeated keys."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = repeated.agg(F.count(F.lit(1)).alias("repeated"))
    name = "unique:" + ",".join(keys)
    return _verdict(counted, name, "repeated", F.lit(0), F.col("repeated") == 0)


def no_orphans(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key exists in the dimension; observed is the number of rows without a match."""
    loose = df.select(*keys).join(dimension.select(*keys), list(keys), "left_anti")
    counted = loose.agg(F.count(F.lit(1)).alias("loose"))
    name = "references:" + ",".join(keys)
    return _verdict(counted, name, "loose", F.lit(0), F.col("loose") == 0)


def all_keys_kept(output: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As many output rows as there are different keys in the source."""
    wanted = source.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    counted = output.agg(F.count(F.lit(1)).alias("rows")).withColumn("wanted", wanted)
    name = "one_row_per:" + ",".join(keys)
    return _verdict(counted, name, "rows", F.col("wanted"), F.col("rows") == F.col("wanted"))


def not_more_rows(output: DataFrame, source: DataFrame) -> DataFrame:
    """The output has at most as many rows as the source."""
    limit = source.agg(F.count(F.lit(1))).scalar()
    counted = output.agg(F.count(F.lit(1)).alias("rows")).withColumn("most", limit)
    return _verdict(counted, "not_more_rows", "rows", F.col("most"), F.col("rows") <= F.col("most"))


def same_total(
    output: DataFrame, source: DataFrame, output_column: str, source_column: str
) -> DataFrame:
    """The sum of a column equals the sum of a source column: (check, passed, observed, expected)
    with the two sums."""
    wanted = source.agg(F.sum(col(source_column))).scalar()
    return output.agg(F.sum(col(output_column)).alias("observed")).select(
        F.lit(f"same_total:{output_column}").alias("check"),
        F.col("observed").eqNullSafe(wanted).alias("passed"),
        F.col("observed"),
        wanted.alias("expected"),
    )


def stack(results: Sequence[DataFrame]) -> DataFrame:
    """Check results under one another."""
    return reduce(DataFrame.unionByName, results)


def summary(df: DataFrame) -> DataFrame:
    """One row (row_count, columns, status): `ok`, or `warning_empty` without rows."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        names.alias("columns"),
        F.when(F.col("row_count") > 0, "ok").otherwise("warning_empty").alias("status"),
    )


def schema_problems(df: DataFrame, expected: T.StructType, *, strict: bool = True) -> list[str]:
    """Differences from the expected schema. Strict also reports additional columns; lenient
    asks only that the expected columns exist with their types."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    problems = [f"missing column {n}" for n in want if n not in have]
    problems += [
        f"column {n} is {have[n]}, expected {t}" for n, t in want.items() if n in have and have[n] != t
    ]
    if strict:
        problems += [f"unexpected column {n}" for n in have if n not in want]
    return problems


def _hashed(value: Column, dtype: T.DataType) -> Column:
    """The value in a form that can be hashed whatever it holds."""
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(value)
        return F.sort_array(F.transform(entries, lambda e: F.struct(F.to_json(F.struct(e["key"])).alias("k"), F.to_json(F.struct(e["value"])).alias("v"))))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.VariantType)):
        return F.to_json(F.struct(value))
    return value


def multiset_digest(df: DataFrame) -> list[Column]:
    """Aggregates that tell one multiset of rows from another, whatever their order: the number of rows and
    the exact sums of two 64-bit hashes of each. They add up over parts, so they can be observed while
    rows are written, and a row missing, added or changed shows, also one of several equal ones."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    values = [_hashed(col(f.name), f.dataType) for f in fields]
    absent = [col(f.name).isNull() for f in fields]  # a hash passes over NULL
    hashes = [F.xxhash64(F.lit(seed), *values, *absent) for seed in (1, 2)]
    sums = [F.coalesce(F.sum(h.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")) for h in hashes]
    return [x.alias(f"digest_{i}") for i, x in enumerate((F.count(F.lit(1)), *sums))]


def digest_of(df: DataFrame) -> tuple:
    """The multiset digest of a frame, from one scan without a shuffle."""
    return tuple(df.agg(*multiset_digest(df)).first())


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Both frames hold the same rows, as often; used to prove that a rerun changes nothing."""
    if sorted(left.dtypes) != sorted(right.dtypes):
        return False
    return digest_of(left) == digest_of(right)


# The field limits of a submitted job description.
STORY_LIMITS: Mapping[str, Any] = {
    "id_pattern": r"(?U)^[\w\-\.]+\z",
    "id_length": (1, 128),
    "title_length": (1, 256),
    "description_length": (1, 2000),
    "criteria_count": 20,
    "criterion_length": 500,
    "tag_count": 20,
    "tag_length": 50,
    "classifications": ("public", "internal", "confidential", "restricted"),
}


def text_rule(name: str, low: int, high: int, pattern: str | None = None) -> Column:
    """True when the text is present, low..high characters long and matches the pattern."""
    fine = F.char_length(col(name)).between(low, high)
    if pattern is not None:
        fine = fine & col(name).rlike(pattern)
    return F.coalesce(fine, F.lit(False))


def list_rule(name: str, most: int, longest: int) -> Column:
    """True when the list is missing, or has at most `most` items of at most `longest` characters."""
    items = col(name)
    fine = (F.size(items) <= most) & F.forall(items, lambda x: F.char_length(x) <= longest)
    return items.isNull() | F.coalesce(fine, F.lit(False))


def violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row (keys, rule) per broken rule of every row."""
    broken = F.array_compact(
        F.array(*[F.when(~fine, F.lit(name)) for name, fine in rules.items()])
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def story_rules() -> dict[str, Column]:
    """Rules for rows (id, title, description, acceptance_criteria, tags, data_classification)."""
    limits = STORY_LIMITS
    classes = list(limits["classifications"])
    return {
        "id": text_rule("id", *limits["id_length"], limits["id_pattern"]),
        "title": text_rule("title", *limits["title_length"]),
        "description": text_rule("description", *limits["description_length"]),
        "acceptance_criteria": list_rule(
            "acceptance_criteria", limits["criteria_count"], limits["criterion_length"]
        ),
        "tags": list_rule("tags", limits["tag_count"], limits["tag_length"]),
        "data_classification": col("data_classification").isNull()
        | col("data_classification").isin(classes),
    }
