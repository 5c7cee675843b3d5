"""Job specs: what a job reads, its ordered steps, what it writes.

A step may be written in three ways, which all become one `Step`:

* `params`: `{operation, params: {...}}`
* `config`: the same with the key `config`; a join names its key with `on`
* flat: `{operation, column, condition | value}`, `join_table`/`join_key`, `group_by` + `metrics`
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from millrace.functions.columns import quoted
from millrace.operators.aggregates import AGGREGATES
from millrace.operators.joins import join_type
from millrace.sources.files import Dataset

# The step operations and the table operations of a spec.
OPERATIONS = (
    "filter",
    "join",
    "aggregate",
    "dedupe",
    "enrich",
    "upsert",
    "fill_null",
    "rename",
    "cast",
    "sort",
)
TABLE_OPERATIONS = ("create", "overwrite", "merge", "update", "delete")

_META = ("operation", "name", "description", "params", "config")
_COMPARISON = re.compile(
    r"^(==|=|!=|<>|<=>|<=|>=|<|>|like\b|rlike\b|in\b|not\b|between\b|is\b)", re.IGNORECASE
)


class SpecError(ValueError):
    """A spec that cannot be run, found before any job starts."""


@dataclass(frozen=True)
class Step:
    """One step in the single form the runner understands."""

    operation: str
    params: Mapping[str, Any]
    name: str = ""


@dataclass(frozen=True)
class JobSpec:
    """A whole job. `rules` are acceptance checks on the output, see `rule_of` and
    `frame_check` in `plans.runner`.

    `standards` applies the common rules: trimmed strings and snake_case names on read, left
    joins and keep_first duplicates where a step does not say otherwise, partitions by year and
    month where the target names none.
    """

    name: str
    source: Dataset
    target: Dataset | None = None
    steps: tuple[Step, ...] = ()
    story_id: str = ""
    version: str = "1.0.0"
    table_operation: str = "overwrite"
    broadcast_joins: bool = False
    rules: tuple[Mapping[str, Any], ...] = ()
    standards: bool = False
    reference_date: str | None = None
    extras: Mapping[str, Any] = field(default_factory=dict)

    def with_paths(self, source: str | None = None, target: str | None = None) -> JobSpec:
        """The same job on other paths."""
        changed = self
        if source is not None:
            changed = replace(changed, source=replace(self.source, path=source, table=None))
        if target is not None:
            base = self.target or Dataset(path=target)
            changed = replace(changed, target=replace(base, path=target, table=None))
        return changed


def _listed(value: Any) -> list[Any]:
    if value is None:
        return []
    return [value] if isinstance(value, (str, Mapping)) else list(value)


def lower_step(raw: Mapping[str, Any], *, standards: bool = False) -> Step:
    """One step of any dialect in the single form. Nothing a flat step carries is dropped."""
    operation = str(raw.get("operation", "")).lower()
    given: dict[str, Any] = {k: v for k, v in raw.items() if k not in _META and v is not None}
    given |= dict(raw.get("config") or {})
    given |= dict(raw.get("params") or {})
    lower = _LOWERING.get(operation)
    params = lower(given) if lower else given
    if operation == "join":
        params.setdefault("how", "left" if standards else "inner")
        params["how"] = join_type(params["how"])
    if operation == "dedupe" and params["keep"] is None:
        params["keep"] = "keep_first" if standards or params["order_by"] else "any"
    return Step(operation, params, str(raw.get("name") or ""))


def _filter(p: Mapping[str, Any]) -> dict[str, Any]:
    condition = str(p.get("condition") or "").strip()
    if not condition:
        raise SpecError("filter needs a condition")
    column = p.get("column")
    if not column:
        return {"condition": condition}
    return {"condition": column_condition(str(column), condition)}


def column_condition(column: str, condition: str) -> str:
    """SQL condition from a column and a bare comparison such as `== 'x'` or `is_not_null`."""
    word = condition.strip().lower()
    name = quoted(column)
    if word in ("is_not_null", "not_null"):
        return f"{name} IS NOT NULL"
    if word in ("is_null", "null"):
        return f"{name} IS NULL"
    if _COMPARISON.match(condition.strip()):
        return f"{name} {re.sub(r'^==', '=', condition.strip())}"
    return condition


def _fill(p: Mapping[str, Any]) -> dict[str, Any]:
    if p.get("fill_values"):
        return {"values": dict(p["fill_values"])}
    if "column" in p and "value" in p:
        return {"values": {p["column"]: p["value"]}}
    raise SpecError("fill_null needs fill_values, or column and value")


def _rename(p: Mapping[str, Any]) -> dict[str, Any]:
    if p.get("column_map"):
        return {"names": dict(p["column_map"])}
    if "column" in p and "value" in p:
        return {"names": {p["column"]: p["value"]}}
    raise SpecError("rename needs column_map")


def _cast(p: Mapping[str, Any]) -> dict[str, Any]:
    if p.get("cast_map"):
        return {"types": dict(p["cast_map"])}
    if "column" in p and ("type" in p or "value" in p):
        return {"types": {p["column"]: p.get("type") or p["value"]}}
    raise SpecError("cast needs cast_map")


def _aggregate(p: Mapping[str, Any]) -> dict[str, Any]:
    groups = [str(g) for g in _listed(p.get("group_by"))]
    aggregations = _listed(p.get("aggregations"))
    metrics = [str(m) for m in _listed(p.get("metrics"))]
    if not aggregations and not metrics:
        raise SpecError("aggregate needs aggregations or metrics")
    for entry in aggregations:
        if entry.get("function") not in AGGREGATES:
            raise SpecError(f"unknown aggregate function {entry.get('function')!r}")
    return {"group_by": groups, "aggregations": aggregations, "metrics": metrics}


def _join(p: Mapping[str, Any]) -> dict[str, Any]:
    location = p.get("right_path") or p.get("join_table")
    table = p.get("right_table")
    keys = _listed(p.get("join_keys") or p.get("on") or p.get("join_key"))
    if not location and not table:
        raise SpecError("join needs right_path, right_table or join_table")
    if not keys:
        raise SpecError("join needs join_keys, on or join_key")
    params: dict[str, Any] = {
        "right": {"path": location, "table": table, "format": p.get("right_format") or "parquet"},
        "keys": keys,
        "prefer": p.get("prefer"),
        "split_hot": bool(p.get("split_hot", False)),
        "right_steps": [lower_step(s) for s in _listed(p.get("right_steps"))],
    }
    kind = p.get("join_type") or p.get("how")
    if kind:
        params["how"] = kind
    return params


def _dedupe(p: Mapping[str, Any]) -> dict[str, Any]:
    columns = _listed(p.get("subset_cols") or p.get("columns") or p.get("column"))
    keep = p.get("keep") or p.get("strategy")
    if keep not in (None, "any", "keep_first", "keep_last", "keep_all"):
        raise SpecError(f"unknown dedupe strategy {keep!r}")
    return {"columns": columns, "keep": keep, "order_by": _listed(p.get("order_by"))}


def _enrich(p: Mapping[str, Any]) -> dict[str, Any]:
    derived = [(d["name"], d["expression"]) for d in _listed(p.get("derived_columns"))]
    if not derived and "column" in p and "value" in p:
        derived = [(p["column"], p["value"])]
    if not derived:
        raise SpecError("enrich needs derived_columns, or column and value")
    return {"derived": derived}


def _sort(p: Mapping[str, Any]) -> dict[str, Any]:
    entries = _listed(p.get("sort_columns") or p.get("column"))
    if not entries:
        raise SpecError("sort needs sort_columns")
    return {"columns": entries}


def _upsert(p: Mapping[str, Any]) -> dict[str, Any]:
    return {"merge_keys": _listed(p.get("merge_keys") or p.get("join_keys") or p.get("column"))}


_LOWERING = {
    "filter": _filter,
    "fill_null": _fill,
    "rename": _rename,
    "cast": _cast,
    "aggregate": _aggregate,
    "join": _join,
    "dedupe": _dedupe,
    "enrich": _enrich,
    "sort": _sort,
    "upsert": _upsert,
}


def dataset_of(raw: Mapping[str, Any] | str | Dataset, **defaults: Any) -> Dataset:
    """Dataset from a path or from `{path | table, format, options, schema, mode, ...}`."""
    if isinstance(raw, Dataset):
        return raw
    if isinstance(raw, str):
        return Dataset(path=raw, **defaults)
    values = defaults | dict(raw)
    hint = values.get("schema") or values.get("schema_hint")
    if isinstance(hint, Mapping):
        hint = [{"name": n, "type": t} for n, t in hint.items()]
    return Dataset(
        path=values.get("path"),
        table=values.get("table"),
        format=values.get("format") or "parquet",
        options=values.get("options") or {},
        schema=hint,
        mode=values.get("mode") or "overwrite",
        partition_by=tuple(_listed(values.get("partition_by"))),
        merge_keys=tuple(_listed(values.get("merge_keys"))),
        version=values.get("version"),
        quarantine=values.get("quarantine"),
        buckets=int(values.get("buckets") or 0),
    )


def job_of(raw: Mapping[str, Any], *, standards: bool = False) -> JobSpec:
    """JobSpec from a parsed story or spec; fails on anything that could not run."""
    if "source" not in raw or raw["source"] is None:
        raise SpecError("a job needs a source")
    steps = tuple(lower_step(s, standards=standards) for s in raw.get("transformations") or ())
    operation = raw.get("delta_operation") or raw.get("table_operation")
    target = raw.get("target")
    if target is not None:
        target = dataset_of(target)
        if raw.get("partition_columns") and not target.partition_by:
            target = replace(target, partition_by=tuple(raw["partition_columns"]))
        if operation == "merge" or any(s.operation == "upsert" for s in steps):
            target = replace(target, mode="merge", format="delta")
        elif operation == "create":
            target = replace(target, mode="create")
        keys = [k for s in steps if s.operation == "upsert" for k in s.params["merge_keys"]]
        if keys and not target.merge_keys:
            target = replace(target, merge_keys=tuple(keys))
        if target.mode == "merge":
            target = replace(target, format="delta", merge_keys=target.merge_keys or _grain(steps))
            if not target.merge_keys:
                raise SpecError("a merge target needs merge_keys")
    if operation is not None and operation not in TABLE_OPERATIONS:
        raise SpecError(f"unknown table operation {operation!r}")
    known = {"source", "target", "transformations", "delta_operation", "table_operation"}
    return JobSpec(
        name=str(raw.get("pipeline_name") or raw.get("id") or raw.get("name") or "job"),
        source=dataset_of(raw["source"]),
        target=target,
        steps=steps,
        story_id=str(raw.get("story_id") or raw.get("id") or ""),
        version=str(raw.get("pipeline_version") or "1.0.0"),
        table_operation=operation or "overwrite",
        broadcast_joins=bool(raw.get("requires_broadcast_join", False)),
        rules=tuple(raw.get("rules") or ()),
        standards=standards,
        reference_date=raw.get("reference_date"),
        extras={k: v for k, v in raw.items() if k not in known},
    )


def _grain(steps: Sequence[Step]) -> tuple[str, ...]:
    """Columns of which the output has one row each: the plain groups of its last aggregate."""
    groups: list[str] = []
    for step in steps:
        if step.operation == "aggregate":
            groups = list(step.params["group_by"])
        elif step.operation in ("join", "rename"):
            groups = []  # rows may repeat, or names change
    return tuple(groups) if all(re.fullmatch(r"\w+", g) for g in groups) else ()


def load_job(path: str, *, standards: bool = False) -> JobSpec:
    """JobSpec from a YAML or JSON file."""
    import json

    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        return job_of(json.loads(text), standards=standards)
    import yaml

    return job_of(yaml.safe_load(text), standards=standards)


def target_path(root: str, job_name: str) -> str:
    """Default place of a job's output."""
    return f"{root.rstrip('/')}/{job_name}/"

