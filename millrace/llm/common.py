"""What several operators share: text columns as bytes, tables, stored copies, safe joins."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.shared import fresh_path

ROOT = str(Path(__file__).resolve().parents[2])
#: The white space of all contracts, as bytes.split() and bytes.translate() know it.
WHITE = b" \t\n\x0b\x0c\r"
#: A word, in the same terms.
WORD = r"[^\x20\x09-\x0D]+"
#: Size of an Arrow batch, and the setting for it.
BATCH_MB = 8
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the session was started in another folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """`mapInArrow` with batches of at most BATCH_MB.

    A task holds a batch several times over (Arrow in the JVM and in Python, and the Python values),
    so this bounds its memory whatever the size of the texts; a smaller limit of the session stays.
    """
    importable(df.sparkSession)
    conf = df.sparkSession.conf
    limit = re.match(r"(\d+)b?$", conf.get(BATCH_CONF))
    if limit and int(limit[1]) > BATCH_MB << 20:
        conf.set(BATCH_CONF, str(BATCH_MB << 20))
    return df.mapInArrow(function, schema)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """`df` written once to the shared folder and read back.

    Several uses then read the same rows; a lost executor can't change or recompute them.
    """
    importable(df.sparkSession)
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """`df` marked for broadcast if its counted `rows` are at most `bound`, else as it is."""
    return F.broadcast(df) if rows <= bound else df


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from Python lists or arrays in the schema's order."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def field_type(df: DataFrame, name: str) -> str:
    """Type of one column as text."""
    schema: StructType = df.schema
    return schema[name].dataType.simpleString()
