"""Batch reads and writes of files and registered tables, and rows that don't fit their schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.text import row_checksum
from millrace.operators.layout import repartition_for_write
from millrace.sources import versioned
from millrace.sources.schema import declared_schema
from millrace.sources.shared import cut_lineage

# The accepted formats and write modes.
READ_FORMATS = ("parquet", "csv", "json", "orc", "delta")
WRITE_FORMATS = ("parquet", "csv", "json", "orc", "delta")
WRITE_MODES = ("overwrite", "append", "merge", "create")

# Columns of a judged read: why a row doesn't fit, its text, and its file.
REASON, RECORD, FILE = "_reason", "_record", "_file"


@dataclass(frozen=True)
class Dataset:
    """Where a job reads from or writes to.

    `delta` stands for the versioned tables of `millrace.sources.versioned`. A `table` name is
    looked up in the session catalog instead of `path`. With `quarantine`, rows that don't fit the
    declared schema are left out of what is read and belong in the folder it names. `buckets` is the
    number of folders by the hash of the merge keys that a versioned table starts with.
    """

    path: str | None = None
    format: str = "parquet"
    table: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: Any = None
    mode: str = "overwrite"
    partition_by: tuple[str, ...] = ()
    merge_keys: tuple[str, ...] = ()
    version: int | None = None
    quarantine: str | None = None
    buckets: int = 0

    def __post_init__(self) -> None:
        if self.path is None and self.table is None:
            raise ValueError("a dataset needs a path or a table name")
        if self.format not in READ_FORMATS:
            raise ValueError(f"unknown format {self.format!r}; one of {READ_FORMATS}")
        if self.mode not in WRITE_MODES:
            raise ValueError(f"unknown write mode {self.mode!r}; one of {WRITE_MODES}")
        if self.quarantine is not None and (not self.schema or self.table is not None or self.format == "delta"):
            raise ValueError("a quarantine needs files with a declared schema")


def read(spark: SparkSession, source: Dataset) -> DataFrame:
    """The dataset as a lazy DataFrame."""
    if source.quarantine is not None:
        return fitting(read_judged(spark, source))
    if source.table is not None:
        return spark.table(source.table)
    if source.format == "delta":
        return versioned.read(spark, source.path, version=source.version)
    reader = spark.read.format(source.format).options(**_reader_options(source))
    schema = source.schema
    if schema:
        reader = reader.schema(declared_schema(schema))
    return reader.load(source.path)


def read_judged(spark: SparkSession, source: Dataset) -> DataFrame:
    """All rows of files with a declared schema, good and bad ones, from one read.

    `_reason` is NULL for a row that fits, `malformed` for a CSV or JSON record that has too few or too
    many fields or a value that is not of its type, and `missing:a,b` for a row with NULL in columns
    declared not nullable. `_record` holds the text of a malformed record, or the row as JSON, and `_file`
    where it comes from.
    """
    schema = declared_schema(source.schema)
    taken = {REASON, RECORD, FILE} & set(schema.names)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used for the verdict")
    texts = source.format in ("csv", "json")
    wanted = T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())]) if texts else schema
    options = _reader_options(source)
    if texts:
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD}
    rows = spark.read.format(source.format).options(**options).schema(wanted).load(source.path)
    rows = rows.select("*", F.col("_metadata.file_path").alias(FILE))
    if texts:  # the parser checks only the columns that are asked for; a generated row asks for all
        rows = rows.select(F.inline(F.array(F.struct(*[col(c) for c in rows.columns]))))
    record = F.col(RECORD) if texts else F.lit(None).cast("string")
    absent = F.array_compact(F.array(*[F.when(col(f.name).isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable]))
    reason = F.when(record.isNotNull(), F.lit("malformed"))
    if not all(f.nullable for f in schema.fields):
        reason = reason.when(F.size(absent) > 0, F.concat(F.lit("missing:"), F.array_join(absent, ",")))
    judged = rows.withColumn(REASON, reason)
    as_json = F.to_json(F.struct(*[col(n) for n in schema.names]))
    text = F.coalesce(record, F.when(F.col(REASON).isNotNull(), as_json))
    return judged.select(*[col(n) for n in schema.names], REASON, text.alias(RECORD), FILE)


def fitting(judged: DataFrame) -> DataFrame:
    """The good rows of a judged read."""
    return judged.where(F.col(REASON).isNull()).drop(REASON, RECORD, FILE)


def rejected(judged: DataFrame) -> DataFrame:
    """The bad rows of a judged read: `reason`, `record` and `file`."""
    return judged.where(F.col(REASON).isNotNull()).select(
        F.col(REASON).alias("reason"), F.col(RECORD).alias("record"), F.col(FILE).alias("file")
    )


def read_and_quarantine(spark: SparkSession, source: Dataset) -> tuple[DataFrame, int]:
    """The good rows, and the number of bad ones, which are written to the dataset's quarantine folder.

    The files are parsed once: the judged rows are stored, and both outcomes come from the stored rows.
    A later run replaces what is in the folder.
    """
    if source.quarantine is None:
        raise ValueError("the dataset names no quarantine folder")
    judged = cut_lineage(read_judged(spark, source), "judged")
    bad = rejected(judged)
    bad.write.mode("overwrite").parquet(source.quarantine)
    return fitting(judged), bad.count()


def _reader_options(source: Dataset) -> dict[str, str]:
    options = {str(k): str(v) for k, v in source.options.items()}
    if source.format == "csv":
        options = {"header": "true", "quote": '"', "escape": '"'} | options
    return options


def read_path(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    *,
    schema: T.StructType | Sequence[Mapping[str, Any]] | str | None = None,
    **options: Any,
) -> DataFrame:
    """Shorthand of `read` for a plain path."""
    return read(spark, Dataset(path=path, format=fmt, schema=schema, options=options))


def write(
    df: DataFrame,
    target: Dataset,
    *,
    delete_unmatched: bool = False,
    rebalance: bool = True,
) -> None:
    """Write `df` to the dataset in its mode. `merge` needs a versioned table and merge keys.

    Partitioned output is rebalanced by its partition columns, so that a task doesn't write a file for every
    value and a large value becomes several files; without `rebalance` the rows stay as they are dealt.
    """
    if target.format == "delta":
        if target.path is None:
            raise ValueError("a versioned table is addressed by its path")
        _write_versioned(df, target, delete_unmatched)
        return
    if target.mode == "merge":
        raise ValueError("mode merge needs format delta, a versioned table")
    mode = "errorifexists" if target.mode == "create" else target.mode
    if target.partition_by and rebalance:
        df = repartition_for_write(df, partition_by=target.partition_by)
    writer = df.write.format(target.format).mode(mode).options(**_writer_options(target))
    if target.partition_by:
        writer = writer.partitionBy(*target.partition_by)
    if target.table is not None:
        writer.saveAsTable(target.table)
    else:
        writer.save(target.path)


def _writer_options(target: Dataset) -> dict[str, str]:
    options = {str(k): str(v) for k, v in target.options.items()}
    if target.format == "csv":
        options = {"header": "true", "quote": '"', "escape": '"'} | options
    return options


def _write_versioned(df: DataFrame, target: Dataset, delete_unmatched: bool) -> None:
    if target.mode == "merge":
        versioned.merge(
            df,
            target.path,
            target.merge_keys,
            delete_unmatched=delete_unmatched,
            partition_by=target.partition_by,
            buckets=target.buckets,
        )
    else:
        dealt = {"bucket_by": target.merge_keys, "buckets": target.buckets} if target.buckets else {}
        versioned.write(df, target.path, mode=target.mode, partition_by=target.partition_by, **dealt)


def tag_rows(
    df: DataFrame,
    *,
    run_id: str,
    story_id: str,
    classification: str = "internal",
    environment: str = "production",
    managed_by: str = "millrace",
) -> DataFrame:
    """Rows with their audit columns and a SHA-256 checksum of the data columns."""
    checksum = row_checksum(df.columns)
    return df.withColumns(
        {
            "_checksum": checksum,
            "_classification": F.lit(classification),
            "_run_id": F.lit(run_id),
            "_story_id": F.lit(story_id),
            "_environment": F.lit(environment),
            "_managed_by": F.lit(managed_by),
        }
    )
