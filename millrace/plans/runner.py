"""Runs a job spec: read, fold the steps into one lazy DataFrame, write, check."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, checks, columns, joins, ordering
from millrace.operators.layout import BROADCAST_LIMIT_MB, repartition_for_write
from millrace.plans.rfm import add_missing_scores
from millrace.plans.spec import JobSpec, SpecError, Step, dataset_of
from millrace.sources import files, versioned
from millrace.sources.files import Dataset
from millrace.sources.schema import declared_schema, snake_case_columns, standard_types
from millrace.sources.shared import cut_lineage, temporary_copies

StepFunction = Callable[[DataFrame, Mapping[str, Any], JobSpec], DataFrame]

_STEPS: dict[str, StepFunction] = {}

# Fixed value: partition columns of an output that names none, where standards are applied.
DEFAULT_PARTITIONS = ("year", "month")


def register_step(name: str, function: StepFunction) -> None:
    """Add a step type: a function of (DataFrame, step params, job) giving a DataFrame."""
    _STEPS[name.lower()] = function


def known_steps() -> list[str]:
    """Names of all step types."""
    return sorted(_STEPS)


def _aggregate(df: DataFrame, p: Mapping[str, Any], job: JobSpec) -> DataFrame:
    if p["aggregations"] and p["metrics"]:
        raise SpecError("give aggregations or metrics, not both")
    if p["aggregations"]:
        return aggregates.aggregate(df, p["group_by"], p["aggregations"])
    return aggregates.named_aggregate(df, p["group_by"], p["metrics"], job.reference_date)


def _join(df: DataFrame, p: Mapping[str, Any], job: JobSpec) -> DataFrame:
    right = files.read(df.sparkSession, dataset_of(p["right"]))
    right = apply_steps(right, replace(job, steps=tuple(p["right_steps"])))
    limit = BROADCAST_LIMIT_MB if job.broadcast_joins else 0
    return joins.lookup_join(
        df,
        right,
        p["keys"],
        p["how"],
        limit_mb=limit,
        prefer=p["prefer"] or _dimension(job, p),
        split_hot=p["split_hot"],
    )


def _dimension(job: JobSpec, p: Mapping[str, Any]) -> str:
    """Whose copy of a shared column stays: that of the table the key names (customer_id names
    customers); else the joined table's, which is looked up."""
    stems = {k.lower().removesuffix("_id") for k in p["keys"]}
    named = {
        side: str(place.get("table") or place.get("path") or "").rstrip("/").rsplit("/", 1)[-1].lower()
        for side, place in (("right", p["right"]), ("left", vars(job.source)))
    }
    return "left" if any(s in named["left"] and s not in named["right"] for s in stems) else "right"


def _enrich(df: DataFrame, p: Mapping[str, Any], job: JobSpec) -> DataFrame:
    used = {word for _, text in p["derived"] for word in re.findall(r"\w+", str(text))}
    return columns.derive_columns(add_missing_scores(df, used), p["derived"])


def _dedupe(df: DataFrame, p: Mapping[str, Any], job: JobSpec) -> DataFrame:
    if p["keep"] == "any":
        return ordering.drop_duplicates(df, p["columns"])
    return ordering.dedupe(df, p["columns"], p["order_by"], p["keep"])


register_step("filter", lambda df, p, job: columns.filter_rows(df, p["condition"]))
register_step("fill_null", lambda df, p, job: columns.fill_nulls(df, p["values"]))
register_step("rename", lambda df, p, job: columns.rename_columns(df, p["names"]))
register_step("cast", lambda df, p, job: columns.cast_columns(df, p["types"]))
register_step("enrich", _enrich)
register_step("fill_by_type", lambda df, p, job: columns.fill_by_type(df, **p))
register_step("zero_fill", lambda df, p, job: columns.zero_fill(df))
register_step("standard_types", lambda df, p, job: standard_types(df, **p))
register_step("sort", lambda df, p, job: ordering.sort_rows(df, p["columns"]))
register_step("upsert", lambda df, p, job: df)  # done by the write: the target merges
register_step("aggregate", _aggregate)
register_step("join", _join)
register_step("dedupe", _dedupe)


def check_steps(job: JobSpec) -> None:
    """Fail on an unknown step type before any job starts."""
    for step in _all_steps(job.steps):
        if step.operation not in _STEPS:
            raise NotImplementedError(
                f"unknown step {step.operation!r}; add it with register_step, have {known_steps()}"
            )


def _all_steps(steps: tuple[Step, ...]) -> list[Step]:
    found = []
    for step in steps:
        found.append(step)
        found.extend(_all_steps(tuple(step.params.get("right_steps") or ())))
    return found


def apply_steps(df: DataFrame, job: JobSpec) -> DataFrame:
    """All steps of the job in order, as one lazy DataFrame."""
    check_steps(job)
    return reduce(
        lambda current, step: _STEPS[step.operation](current, step.params, job), job.steps, df
    )


def build(spark: SparkSession, job: JobSpec, raw: DataFrame | None = None) -> DataFrame:
    """The job's output as a lazy DataFrame; also the dry run of a job. `raw` stands for the rows of
    its source, where they were read already."""
    check_steps(job)
    # Lets adaptive execution split a hot join key also where the next step groups by that key.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    source = files.read(spark, job.source) if raw is None else raw
    if job.standards:
        source = columns.trim_strings(snake_case_columns(source))
    return apply_steps(source, job)


def _with_default_partitions(job: JobSpec, output: DataFrame) -> Dataset:
    """The target; by the standards an output with these columns is partitioned by them."""
    present = set(DEFAULT_PARTITIONS) <= set(output.columns)
    if job.standards and present and not job.target.partition_by:
        return replace(job.target, partition_by=DEFAULT_PARTITIONS)
    return job.target


def rule_of(entry: Mapping[str, Any]) -> checks.RowRule:
    """Row rule from `{check, column, ...}`: not_null, allowed, range, holds, not_empty."""
    kind = entry["check"]
    if kind == "not_null":
        return checks.not_null(entry["column"])[0]
    if kind == "allowed":
        return checks.allowed(entry["column"], entry["values"])
    if kind == "range":
        return checks.in_range(entry["column"], entry.get("low"), entry.get("high"))
    if kind == "holds":
        return checks.holds(entry.get("label") or entry["predicate"], entry["predicate"])
    if kind == "not_empty":
        return checks.not_empty()
    raise SpecError(f"unknown acceptance check {kind!r}")


# Checks that need a grouping, a join or the source, so a plan of their own over the written rows.
FRAME_CHECKS = ("unique", "references", "not_more_rows", "same_total", "one_row_per")


def frame_check(
    spark: SparkSession, entry: Mapping[str, Any], output: DataFrame, source: DataFrame
) -> DataFrame:
    """Result rows of an acceptance check out of FRAME_CHECKS."""
    kind = entry["check"]
    if kind == "unique":
        return checks.unique_key(output, entry["keys"])
    if kind == "references":
        return checks.no_orphans(output, files.read(spark, dataset_of(entry["in"])), entry["keys"])
    if kind == "not_more_rows":
        return checks.not_more_rows(output, source)
    if kind == "one_row_per":
        return checks.all_keys_kept(output, source, entry["keys"])
    column = entry["column"]
    return checks.same_total(output, source, column, entry.get("source_column") or column)


def _frame_results(
    spark: SparkSession, job: JobSpec, written: DataFrame, source: DataFrame | None
) -> list[dict[str, Any]]:
    raw = files.read(spark, job.source) if source is None else source
    found = []
    for entry in job.rules:
        if entry["check"] in FRAME_CHECKS:
            row = frame_check(spark, entry, written, raw).first()
            found.append({"check": row.check, "passed": bool(row.passed), "observed": row.observed})
    return found


def _rerun_result(spark: SparkSession, job: JobSpec, source: DataFrame | None, written: tuple) -> dict[str, Any]:
    """The job computed once more, against the digest of the rows that were written."""
    again = build(spark, job) if source is None else apply_steps(source, job)
    same = checks.digest_of(again) == written
    return {"check": "rerun", "passed": same, "observed": int(not same)}


def _schema_results(job: JobSpec, output: DataFrame) -> list[dict[str, Any]]:
    """Checks of the output's columns, which need no rows."""
    found = []
    for entry in job.rules:
        if entry["check"] == "schema":
            strict = entry.get("strictness", "strict") == "strict"
            problems = checks.schema_problems(output, declared_schema(entry["columns"]), strict=strict)
            found.append({"check": "schema", "passed": not problems, "observed": len(problems), "problems": problems})
    return found


def run(
    spark: SparkSession,
    job: JobSpec,
    *,
    source_path: str | None = None,
    target_path: str | None = None,
    source: DataFrame | None = None,
) -> dict[str, Any]:
    """Run the job and report on it.

    The row count, all row rules and the digest for `rerun` are observed while the rows are written, so the
    output is neither computed nor read a second time; only FRAME_CHECKS read it, and `rerun` computes the
    job once more. All checks are
    about the rows of this run: those of an append or merge that such a check looks at are stored
    before they go into the table. Rows of a source with a quarantine folder that don't fit its schema
    are written there and counted in the report. `optimize_write` in the spec rebalances the output, and
    `auto_compact` compacts a versioned table after the write.
    """
    with temporary_copies(spark):
        return _run(spark, job, source_path, target_path, source)


def _run(
    spark: SparkSession, job: JobSpec, source_path: str | None, target_path: str | None, source: DataFrame | None
) -> dict[str, Any]:
    job = job.with_paths(source_path, target_path)
    if job.target is None:
        raise SpecError("the job has no target; use build() for a lazy result")
    check_steps(job)
    if job.table_operation in ("update", "delete"):
        return _change_table(spark, job)
    rules = [rule_of(r) for r in job.rules if r["check"] not in (*FRAME_CHECKS, "rerun", "schema")]
    if job.standards and not any(r["check"] == "not_empty" for r in job.rules):
        rules.append(checks.not_empty())
    raw, n_rejected = None, 0
    if source is None and job.source.quarantine is not None:
        raw, n_rejected = files.read_and_quarantine(spark, job.source)
    output = apply_steps(source, job) if source is not None else build(spark, job, raw)
    target = _with_default_partitions(job, output)
    sorted_last = bool(job.steps) and job.steps[-1].operation == "sort"
    if (target.partition_by or job.extras.get("optimize_write")) and not sorted_last:
        output = repartition_for_write(output, partition_by=target.partition_by)
    seen = Observation(job.name)
    metrics = [F.count(F.lit(1)).alias("row_count")]
    metrics += [r.bad.cast("bigint").alias(f"rule_{i}") for i, r in enumerate(rules)]
    proves = any(r["check"] == "rerun" for r in job.rules)
    if proves:
        metrics += checks.multiset_digest(output)
    output = output.observe(seen, *metrics)
    reads = any(r["check"] in FRAME_CHECKS for r in job.rules)
    of_this_run = reads and target.mode in ("append", "merge")
    if of_this_run:
        output = cut_lineage(output, "run")
    files.write(output, target, rebalance=False)
    found = seen.get
    row_count = int(found.get("row_count") or 0)
    report = [
        {"check": r.name, "passed": bad == 0, "observed": bad}
        for i, r in enumerate(rules)
        for bad in [_observed(found, i, r, row_count)]
    ]
    report += _schema_results(job, output)
    if reads:
        schema = None if target.format == "delta" else output.schema
        written = output if of_this_run else files.read(spark, replace(target, schema=schema))
        report += _frame_results(spark, job, written, source)
    if proves:
        digest = (row_count, found.get("digest_1") or 0, found.get("digest_2") or 0)
        report.append(_rerun_result(spark, job, source, digest))
    if job.extras.get("auto_compact") and target.format == "delta":
        versioned.compact(spark, target.path)
    return {
        "name": job.name,
        "version": job.version,
        "story_id": job.story_id,
        "source": job.source.table or job.source.path,
        "target": target.table or target.path,
        "validation": {
            "row_count": row_count,
            "columns": output.columns,
            "status": "ok" if row_count else "warning_empty",
        },
        "quarantined": n_rejected,
        "checks": report,
        "status": "success" if all(c["passed"] for c in report) else "checks_failed",
    }


def _observed(found: Mapping[str, Any], index: int, rule: checks.RowRule, row_count: int) -> int:
    value = found.get(f"rule_{index}")
    if value is None:  # nothing was written, so nothing was observed
        return 1 if rule.name == "not_empty" and row_count == 0 else 0
    return int(value)



def _change_table(spark: SparkSession, job: JobSpec) -> dict[str, Any]:
    """Table operations update and delete: `condition`, and for update `set`, of the spec."""
    path, condition = job.target.path, job.extras.get("condition")
    if not condition:
        raise SpecError(f"table operation {job.table_operation} needs a condition")
    if job.table_operation == "update":
        if not job.extras.get("set"):
            raise SpecError("table operation update needs set")
        number = versioned.update(spark, path, condition, job.extras["set"])
    else:
        number = versioned.delete(spark, path, condition)
    return {
        "name": job.name,
        "version": job.version,
        "story_id": job.story_id,
        "target": path,
        "table_version": number,
        "status": "success",
    }
