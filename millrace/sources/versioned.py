"""Versioned tables: Parquet snapshots with history, time travel and maintenance.

Layout below the table path:

    data/_part=N/...   the rows written by version N, in folders by partition value if there are any, and
                       before that by the hash of the bucket columns if there are any
    history/           one row per version: operation, schema and the folders that make it up

A version is a list of parts: folders "N", or "N/column=value" of a partitioned table. Appending
writes only the new rows and lists the old parts again. Update, delete and merge find the parts that
hold a row they change and write only those anew; all others are listed again. A table in buckets of its
merge key so rewrites a bucket where one without partitions rewrites a whole write. A version exists
once its history row does, so a job that dies half-way leaves the table as it was. One writer at a time: there is no commit protocol between
concurrent writers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.operators import layout, mutations
from millrace.sources.schema import conform
from millrace.sources.shared import cut_lineage, delete_folder, folder_exists

PART, FOLDER, BUCKET = "_part", "_folder", "_bucket"
HISTORY_SCHEMA = (
    "version bigint, operation string, parameters string, committed_at timestamp, "
    "written_rows bigint, parts array<string>, schema string, partition_by array<string>, "
    "bucket_by array<string>, buckets int"
)

#: Keys of a merge source that are looked up as literals, which Parquet's Bloom filters can use.
KEYS_PUSHED = 10

# How long old versions stay and how many history rows are shown.
RETENTION_HOURS = 168
HISTORY_ROWS = 10


@dataclass(frozen=True)
class Version:
    """One committed version."""

    number: int
    parts: tuple[str, ...]
    schema: T.StructType
    partition_by: tuple[str, ...]
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0

    @property
    def folders(self) -> tuple[str, ...]:
        """Columns by which the rows of a part lie in folders."""
        return ((BUCKET,) if self.buckets else ()) + self.partition_by


def _data(path: str) -> str:
    return f"{path.rstrip('/')}/data"


def _history(path: str) -> str:
    return f"{path.rstrip('/')}/history"


def exists(spark: SparkSession, path: str) -> bool:
    """True when the table has at least one committed version."""
    return _latest_row(spark, path) is not None


def full_history(spark: SparkSession, path: str) -> DataFrame:
    """Every history row of the table."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(_history(path))


def history(spark: SparkSession, path: str, limit: int = HISTORY_ROWS) -> DataFrame:
    """The last operations, newest first."""
    return full_history(spark, path).orderBy(F.col("version").desc()).limit(limit)


def _latest_row(spark: SparkSession, path: str, version: int | None = None) -> Row | None:
    if not folder_exists(spark, _history(path)):
        return None
    rows = full_history(spark, path)
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    found = rows.orderBy(F.col("version").desc()).limit(1).collect()
    return found[0] if found else None


def version_of(spark: SparkSession, path: str, version: int | None = None) -> Version:
    """The given version, by default the latest."""
    row = _latest_row(spark, path, version)
    if row is None:
        wanted = "no version" if version is None else f"no version {version}"
        raise ValueError(f"{wanted} of a versioned table at {path}")
    return Version(
        row.version,
        tuple(row.parts),
        T.StructType.fromJson(json.loads(row.schema)),
        tuple(row.partition_by),
        tuple(row.bucket_by or ()),
        row.buckets or 0,
    )


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the latest."""
    found = version_of(spark, path, version)
    return _rows(spark, path, found, found.parts).drop(PART)


def _rows(spark: SparkSession, path: str, found: Version, parts: Sequence[str]) -> DataFrame:
    """Rows of some parts of a version with the number of the version that wrote them as last column."""
    stored = T.StructType([*found.schema.fields, T.StructField(PART, T.LongType())])
    if not parts:
        return spark.createDataFrame([], stored)
    base = _data(path)
    reader = spark.read.schema(stored).option("basePath", base)
    rows = reader.parquet(*[f"{base}/{PART}={n}" for n in parts])
    return rows.select(*[col(f.name) for f in stored.fields])


def _part_of(file: Column) -> Column:
    """The part that a data file lies in."""
    return F.regexp_extract(file, rf".*/{PART}=(\d+(?:/[^/]+=[^/]*)*)/[^/]*$", 1)


def _parts_of(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`rows` of the table, cut to `keys`, with the part of each, URL-encoded, as `_folder`."""
    return rows.select(*keys, _part_of(F.col("_metadata.file_path")).alias(FOLDER))


def _distinct_parts(found: DataFrame) -> tuple[str, ...]:
    """The parts that occur, one row per folder of the table at most."""
    return tuple(sorted(r[0] for r in found.select(FOLDER).distinct().collect()))


def write(
    df: DataFrame,
    path: str,
    *,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    overwrite_schema: bool = False,
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> int:
    """Write a new version in mode create, overwrite or append and return its number.

    Columns the table has and `df` lacks become NULL and new columns are added; with
    `overwrite_schema` an overwrite takes the columns of `df` alone. `bucket_by` and `buckets` deal the
    rows to folders by the hash of these columns, the merge keys; later versions keep them.
    """
    spark = df.sparkSession
    row = _latest_row(spark, path)
    if mode == "create" and row is not None:
        raise ValueError(f"a versioned table exists already at {path}")
    if mode not in ("create", "overwrite", "append"):
        raise ValueError(f"unknown write mode {mode!r}")
    if bool(bucket_by) != (buckets > 0):
        raise ValueError("bucket_by and buckets go together")
    wanted = Version(0, (), df.schema, tuple(partition_by), tuple(bucket_by), buckets)
    if row is None:
        return _commit(df, path, wanted, mode.upper(), {})
    current = version_of(spark, path, row.version)
    if not partition_by:
        wanted = replace(wanted, partition_by=current.partition_by)
    if not buckets:
        wanted = replace(wanted, bucket_by=current.bucket_by, buckets=current.buckets)
    if mode == "append" and wanted.partition_by != current.partition_by:
        raise ValueError(f"the table is partitioned by {current.partition_by}")
    if mode == "append" and (wanted.bucket_by, wanted.buckets) != (current.bucket_by, current.buckets):
        raise ValueError(f"the table has {current.buckets} buckets by {current.bucket_by}")
    if not overwrite_schema or mode == "append":
        df = conform(df, _merged_schema(current.schema, df.schema))
    kept = current.parts if mode == "append" else ()
    return _commit(df, path, replace(wanted, number=current.number + 1, parts=kept), mode.upper(), {})


def _merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    known = {f.name for f in old.fields}
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in known]])


def bucket(found: Version, rows: DataFrame) -> Column:
    """The bucket of a row, which may hold the bucket columns in other types than the table."""
    types = {f.name: f.dataType for f in found.schema.fields}
    return F.pmod(F.xxhash64(*[rows[c].try_cast(types[c]) for c in found.bucket_by]), F.lit(found.buckets)).cast("int")


def _commit(df: DataFrame, path: str, wanted: Version, operation: str, parameters: Mapping[str, Any]) -> int:
    """Write `df` as the parts of the wanted version, which also has the parts it lists already."""
    seen = Observation()
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    wanted = replace(wanted, schema=schema)
    rows = df.withColumn(BUCKET, bucket(wanted, df)) if wanted.buckets else df
    spread = layout.repartition_for_write(rows, partition_by=wanted.folders) if wanted.folders else rows
    observed = spread.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.mode("overwrite")
    if wanted.folders:
        writer = writer.partitionBy(*wanted.folders)
    for name in wanted.bucket_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    folder = f"{_data(path)}/{PART}={wanted.number}"
    writer.parquet(folder)
    written = int(seen.get.get("rows", 0))
    parts: tuple[str, ...] = (str(wanted.number),)
    if wanted.folders:
        files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        parts = _distinct_parts(files.select(_part_of(F.col("path")).alias(FOLDER))) if written else ()
    found = replace(wanted, parts=(*wanted.parts, *parts))
    return _record(df.sparkSession, path, found, operation, parameters, written)


def _record(
    spark: SparkSession,
    path: str,
    found: Version,
    operation: str,
    parameters: Mapping[str, Any],
    written: int,
) -> int:
    entry = (
        found.number,
        operation,
        json.dumps(dict(parameters), sort_keys=True),
        None,
        written,
        list(found.parts),
        found.schema.json(),
        list(found.partition_by),
        list(found.bucket_by),
        found.buckets,
    )
    record = spark.createDataFrame([entry], HISTORY_SCHEMA)
    stamped = record.withColumn("committed_at", F.current_timestamp())
    stamped.coalesce(1).write.mode("append").parquet(_history(path))
    return found.number


def _change_parts(
    spark: SparkSession,
    path: str,
    current: Version,
    touched: Sequence[str],
    change: Callable[[DataFrame], DataFrame],
    operation: str,
    parameters: Mapping[str, Any],
    *,
    adds_rows: bool = False,
) -> int:
    """New version with the touched parts changed and the others as they are."""
    number = current.number + 1
    kept = tuple(n for n in current.parts if n not in touched)
    if not touched and not adds_rows:
        unchanged = replace(current, number=number)
        return _record(spark, path, unchanged, operation, parameters, 0)
    changed = change(_rows(spark, path, current, touched).drop(PART))
    return _commit(changed, path, replace(current, number=number, parts=kept), operation, parameters)


def _touched_by(spark: SparkSession, path: str, current: Version, condition: str) -> Sequence[str]:
    if not current.parts:
        return ()
    found = _parts_of(_rows(spark, path, current, current.parts).where(condition))
    return tuple(map(unquote, _distinct_parts(found)))


def update(spark: SparkSession, path: str, condition: str, assignments: Mapping[str, str]) -> int:
    """New version with the assignments applied where the condition is true."""
    current = version_of(spark, path)
    return _change_parts(
        spark,
        path,
        current,
        _touched_by(spark, path, current, condition),
        lambda rows: mutations.update_where(rows, condition, assignments),
        "UPDATE",
        {"condition": condition, "set": dict(assignments)},
    )


def delete(spark: SparkSession, path: str, condition: str) -> int:
    """New version without the rows where the condition is true."""
    current = version_of(spark, path)
    return _change_parts(
        spark,
        path,
        current,
        _touched_by(spark, path, current, condition),
        lambda rows: mutations.delete_where(rows, condition),
        "DELETE",
        {"condition": condition},
    )


def merge(
    source: DataFrame,
    path: str,
    keys: Sequence[str],
    *,
    update_columns: Sequence[str] | None = None,
    insert_all: bool = True,
    delete_unmatched: bool = False,
    evolve: bool = False,
    keep_old_when_null: bool = False,
    partition_by: Sequence[str] = (),
    buckets: int = 0,
    tag: str | None = None,
) -> dict[str, Any]:
    """Merge into the table, or write the source as its first version when there is none.

    A merge reads the source several times, so its rows are computed once and stored first. A merge
    with a `tag` that the table's history holds already was done before and changes nothing. `buckets` is
    for the first version: its rows are dealt to so many folders by the hash of the keys.
    """
    spark = source.sparkSession
    if not keys:
        raise ValueError("a merge needs merge keys")
    if tag is not None and _holds_tag(spark, path, tag):
        return {"action": "done_before", "tag": tag, "version": version_of(spark, path).number}
    if not exists(spark, path):
        dealt = {"bucket_by": keys, "buckets": buckets} if buckets else {}
        number = write(source, path, mode="create", partition_by=partition_by, **dealt)
        rows = version_row(spark, path, number).written_rows
        return {"action": "initial_write", "rows": rows, "version": number}
    result = {
        "action": "merge",
        "merge_keys": list(keys),
        "update_columns": mutations.update_columns_of(source, keys, update_columns),
        "insert_all": insert_all,
        "delete_unmatched": delete_unmatched,
    }
    if tag is not None:
        result["tag"] = tag
    source = cut_lineage(source, "merge")
    current = version_of(spark, path)
    touched = current.parts
    if touched and not delete_unmatched:
        touched = _touched_by_keys(spark, path, current, source, keys)
    number = _change_parts(
        spark,
        path,
        current,
        touched,
        lambda rows: mutations.merge_rows(
            rows,
            source,
            keys,
            update_columns=update_columns,
            insert_all=insert_all,
            delete_unmatched=delete_unmatched,
            evolve=evolve,
            keep_old_when_null=keep_old_when_null,
        ),
        "MERGE",
        result,
        adds_rows=insert_all,
    )
    return result | {"version": number}


def _touched_by_keys(
    spark: SparkSession, path: str, current: Version, source: DataFrame, keys: Sequence[str]
) -> Sequence[str]:
    """The parts with a row of one of the source's keys. Of a table in buckets of (some of) the keys only the
    source's buckets are looked into."""
    parts: Sequence[str] = current.parts
    if current.buckets and set(current.bucket_by) <= set(keys):
        hit = {r[0] for r in source.select(bucket(current, source)).distinct().collect()}  # at most `buckets`
        parts = tuple(p for p in parts if int(p.split(f"{BUCKET}=")[1].split("/")[0]) in hit)
    if not parts:
        return ()
    held = _rows(spark, path, current, parts)
    few = source.select(*keys).limit(KEYS_PUSHED + 1).collect()
    if len(few) <= KEYS_PUSHED:
        for k in keys:
            held = held.where(col(k).isin([r[k] for r in few if r[k] is not None]))
    found = _parts_of(held, keys).join(source.select(*keys), list(keys), "left_semi")
    return tuple(map(unquote, _distinct_parts(found)))


def _holds_tag(spark: SparkSession, path: str, tag: str) -> bool:
    if not exists(spark, path):
        return False
    return not full_history(spark, path).where(F.get_json_object("parameters", "$.tag") == tag).isEmpty()


def version_row(spark: SparkSession, path: str, version: int | None = None) -> Row:
    """History row of a version."""
    row = _latest_row(spark, path, version)
    if row is None:
        raise ValueError(f"no such version of the table at {path}")
    return row


def compact(
    spark: SparkSession,
    path: str,
    order_by: Sequence[str] = (),
    target_mb: float = layout.TARGET_FILE_MB,
) -> int:
    """New version with the same rows in files of about `target_mb`, clustered by `order_by`."""
    current = version_of(spark, path)
    return _change_parts(
        spark,
        path,
        current,
        current.parts,
        lambda rows: layout.cluster_rows(rows, order_by, target_mb),
        "OPTIMIZE",
        {"order_by": list(order_by)},
    )


def zone_map(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Per data file of the latest version: rows and the range of each of the columns."""
    current = version_of(spark, path)
    return layout.zone_map(_rows(spark, path, current, current.parts), names)


def stale_parts(spark: SparkSession, path: str, retention_hours: float = RETENTION_HOURS) -> DataFrame:
    """Parts used only by versions that were replaced longer ago than the retention."""
    limit = F.current_timestamp() - F.make_interval(secs=F.lit(retention_hours * 3600.0))
    following = Window.orderBy("version")  # one row per version
    replaced = full_history(spark, path).withColumn("replaced_at", F.lead("committed_at").over(following))
    used = replaced.select(
        F.explode("parts").alias("part"),
        (F.col("replaced_at").isNull() | (F.col("replaced_at") >= limit)).alias("live"),
    )
    return (
        used.groupBy("part").agg(F.bool_or("live").alias("live")).filter("NOT live").select("part")
    )


def vacuum(
    spark: SparkSession, path: str, retention_hours: float = RETENTION_HOURS, *, dry_run: bool = True
) -> list[str]:
    """Parts that nothing recent uses; with `dry_run=False` their folders are deleted."""
    parts = sorted(r.part for r in stale_parts(spark, path, retention_hours).collect())
    if dry_run:
        return parts
    for part in parts:
        delete_folder(spark, f"{_data(path)}/{PART}={part}")
    return parts

