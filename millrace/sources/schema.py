"""Declared schemas, schema standards and schema discovery over folders of files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col, snake_case

# The standard formats and the standard decimal type.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DECIMAL_TYPE = "decimal(18,4)"

_SHORT_NAMES = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint"}


def declared_schema(fields: Sequence[Mapping[str, Any]] | T.StructType | str) -> T.StructType:
    """StructType from `[{name, type, nullable}]`, a DDL text or a StructType.

    A field type is a DDL type (`bigint`, `decimal(18,4)`) or a class name (`StringType`).
    """
    if isinstance(fields, T.StructType):
        return fields
    if isinstance(fields, str):
        return T.StructType.fromDDL(fields)
    schema = T.StructType()
    for entry in fields:
        schema.add(entry["name"], _data_type(str(entry["type"])), bool(entry.get("nullable", True)))
    return schema


def _data_type(text: str) -> T.DataType:
    bare = text.strip().removesuffix("()")
    if bare.endswith("Type"):
        bare = bare.removesuffix("Type").lower()
    return T.StructType.fromDDL(f"c {_SHORT_NAMES.get(bare.lower(), bare)}")["c"].dataType


def snake_case_columns(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every column renamed to snake_case; fails when two names meet."""
    names = [snake_case(c, separator) for c in df.columns]
    reject_duplicates(names)
    return df.toDF(*names)


def reject_duplicates(names: Iterable[str]) -> None:
    """Fail when a column name occurs twice, upper and lower case being the same."""
    seen: set[str] = set()
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"column name {name!r} would occur twice")
        seen.add(name.lower())


def standard_types(
    df: DataFrame,
    *,
    decimals: Sequence[str] = (),
    dates: Sequence[str] = (),
    timestamps: Sequence[str] = (),
) -> DataFrame:
    """Listed columns in the standard types; text that does not parse becomes NULL."""
    changes = {c: col(c).try_cast(DECIMAL_TYPE) for c in decimals}
    changes |= {c: F.try_to_date(col(c).cast("string"), DATE_FORMAT) for c in dates}
    changes |= {
        c: F.try_to_timestamp(col(c).cast("string"), F.lit(TIMESTAMP_FORMAT)) for c in timestamps
    }
    return df.withColumns(changes)


# The types a text column can be given. One of the first group holds all that an earlier
# one of it holds; a date also reads as a timestamp.
NUMBER_TYPES = ("int", "bigint", "decimal(38,0)", "double")
OTHER_TYPES = ("date", "timestamp", "boolean")
_BIT = {t: 1 << i for i, t in enumerate((*NUMBER_TYPES, *OTHER_TYPES))}
_ALL_BITS = sum(_BIT.values())
_DIGITS = r"^[+-]?[0-9]+$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^(NaN|[+-]?Inf|[+-]?Infinity)$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.]+(Z|[+-][0-9:]+)?$"
_TRUTH = r"^(?i)(true|false)$"


def _ruled_out(text: Column) -> Column:
    """Bits of the types as which a read of the text gives no value; NULL for NULL.

    Only texts of a type's shape are cast, because a cast that fails is slow.
    """

    def all_but(*kinds: str) -> Column:
        return F.lit(_ALL_BITS - sum(_BIT[k] for k in kinds))

    def fits(kind: str) -> Column:
        return text.try_cast(kind).isNotNull()

    number = F.when(fits("int"), all_but(*NUMBER_TYPES)).when(fits("bigint"), all_but(*NUMBER_TYPES[1:]))
    number = number.when(fits("decimal(38,0)"), all_but(*NUMBER_TYPES[2:])).otherwise(all_but("double"))
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(text.rlike(_DIGITS), number)
        .when(text.rlike(_NUMBER), F.when(fits("double"), all_but("double")).otherwise(all_but()))
        .when(text.rlike(_DAY), F.when(fits("date"), all_but("date", "timestamp")).otherwise(all_but()))
        .when(text.rlike(_MOMENT), F.when(fits("timestamp"), all_but("timestamp")).otherwise(all_but()))
        .when(text.rlike(_TRUTH), all_but("boolean"))
        .otherwise(all_but())
    )


def ruled_out(df: DataFrame) -> Column:
    """Aggregate over text columns: per column the bits of the types that not all of its values fit, NULL
    without values. The bits of parts of a table, joined by or, are those of the table."""
    return F.array(*[F.bit_or(_ruled_out(col(c))) for c in df.columns])


def narrowest_type(bits: int | None) -> str:
    """The narrowest type that all values fit; string for a column without values."""
    if bits is None:
        return "string"
    return next((t for t, bit in _BIT.items() if not bits & bit), "string")


def discover_schema(spark: SparkSession, path: str | Sequence[str], **options: Any) -> T.StructType:
    """Schema of headed CSV files from all their rows: a read with it turns no value into NULL."""
    table = _as_text(spark, path, options)
    return _typed(table.columns, table.select(ruled_out(table).alias("bits")).first().bits)


def _as_text(spark: SparkSession, path: str | Sequence[str], options: Mapping[str, Any]) -> DataFrame:
    return spark.read.options(**{"header": True, "quote": '"', "escape": '"'} | dict(options)).csv(path)


def _typed(names: Sequence[str], bits: Sequence[int | None]) -> T.StructType:
    schema = T.StructType()
    for name, found in zip(names, bits):
        schema.add(name, _data_type(narrowest_type(found)))
    return schema


#: Tables looked at by one job.
TABLES_PER_JOB = 64


def discover_tables(spark: SparkSession, root: str, *, glob: str = "*.csv", **options: Any) -> DataFrame:
    """One catalog row (name, path, format, columns) per folder right below `root` that has CSV files
    at any depth.

    Listing runs on Spark without opening file contents. Types are the narrowest that fit all rows of a
    table, whatever its size: one job joins, for every column of all tables, the types that its values
    rule out. What comes to the driver is one number per column. A table whose files hold
    nothing, not even a header, has no columns.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    prefix = base.split(":", 1)[-1] + "/"
    below = F.substring("path", F.instr("path", prefix) + len(prefix), F.length("path"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(below.alias("file"))
        .where(F.contains("file", F.lit("/")))  # a file right below the root has no table
        .select(F.split_part("file", F.lit("/"), F.lit(1)).alias("name"))
    )
    names = [r.name for r in files.distinct().orderBy("name").collect()]
    options = {"recursiveFileLookup": True, "pathGlobFilter": glob} | options
    with ThreadPoolExecutor(8) as pool:  # each reads a header
        tables = list(pool.map(lambda name: _as_text(spark, f"{base}/{name}", options), names))
    bits: dict[str, Sequence[int | None]] = {}
    for at in range(0, len(names), TABLES_PER_JOB):
        some = list(zip(names, tables))[at : at + TABLES_PER_JOB]
        parts = [t.select(F.lit(name).alias("name"), ruled_out(t).alias("bits")) for name, t in some if t.columns]
        if parts:
            bits |= {r.name: r.bits for r in reduce(DataFrame.unionByName, parts).collect()}
    entries = []
    for name, table in zip(names, tables):
        schema = _typed(table.columns, bits.get(name, ()))
        entries.append((name, f"{base}/{name}", "csv", [(f.name, f.dataType.simpleString()) for f in schema.fields]))
    layout = "name string, path string, format string, columns array<struct<name:string,type:string>>"
    return spark.createDataFrame(entries, layout)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`: missing ones NULL, others dropped, types cast.

    A value that does not fit the type of its column raises, it is not turned into NULL.
    """
    present = set(df.columns)

    def fitted(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = col(field.name)
        if df.schema[field.name].dataType == field.dataType:
            return value
        tried = value.try_cast(field.dataType)
        complaint = F.concat(F.lit(f"column {field.name}: cannot store "), value.cast("string"))
        checked = F.when(
            value.isNotNull() & tried.isNull(), F.raise_error(complaint).cast(field.dataType)
        )
        return checked.otherwise(tried).alias(field.name)

    return df.select(*[fitted(f) for f in schema.fields])


def merge_schemas(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of changed layouts stacked by column name; a column a frame lacks is NULL there."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged

