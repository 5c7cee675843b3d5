"""Both calling styles of the prebuilt analytics: DataFrames in, or paths in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import Dataset, read, write


def frame(spark: SparkSession, given: DataFrame | str | Dataset) -> DataFrame:
    """A DataFrame from a DataFrame, a Parquet path or a Dataset."""
    if isinstance(given, DataFrame):
        return given
    return read(spark, Dataset(path=given) if isinstance(given, str) else given)


def save(df: DataFrame, output: str | Dataset | None) -> DataFrame:
    """Write `df` when an output is given (a path means a versioned table); returns `df`."""
    if output is not None:
        write(df, Dataset(path=output, format="delta") if isinstance(output, str) else output)
    return df
