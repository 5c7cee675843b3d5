"""Filters and column steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.sources.schema import reject_duplicates

# What an unlisted NULL is filled with.
FILL_STRING = "UNKNOWN"
FILL_NUMERIC = 0

# Fixed value: what trimming removes, Unicode's space separators (Zs). Tabs and line ends aren't among them.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows where the SQL condition is true."""
    return df.filter(F.expr(condition))


def keep_not_null(df: DataFrame, *names: str) -> DataFrame:
    """Rows where none of the columns is NULL."""
    for name in names:
        df = df.filter(col(name).isNotNull())
    return df


def keep_containing(df: DataFrame, column: str, fragment: str) -> DataFrame:
    """Rows whose text holds `fragment` literally: % and _ are ordinary characters."""
    return df.filter(col(column).contains(fragment))


def fill_nulls(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """NULLs replaced per column. A value that does not fit its column type is refused by name."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, value in values.items():
        if name not in types:
            raise ValueError(f"fill_null: no column {name!r}; have {df.columns}")
        if not _fits(types[name], value):
            raise ValueError(
                f"fill_null: {value!r} does not fit column {name!r} ({types[name].simpleString()})"
            )
    return df.fillna(dict(values))


def _fits(dtype: T.DataType, value: Any) -> bool:
    if isinstance(dtype, T.StringType):
        return isinstance(value, (str, int, float))
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(dtype, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return False


def fill_by_type(df: DataFrame, text: str = FILL_STRING, number: float = FILL_NUMERIC) -> DataFrame:
    """NULL strings become `text`, NULL numbers become `number`."""
    return df.fillna(text).fillna(number)


def zero_fill(df: DataFrame) -> DataFrame:
    """NULL numbers become 0; other types stay."""
    return df.fillna(0)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed in order; a missing name is skipped, a doubled result is refused."""
    renamed = df.withColumnsRenamed(dict(names))
    reject_duplicates(renamed.columns)
    return renamed


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast to the given types; a value that does not parse becomes NULL."""
    return df.withColumns({name: col(name).try_cast(dtype) for name, dtype in types.items()})


def derive_columns(df: DataFrame, derived: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns from SQL expressions; a later one may use an earlier one."""
    for name, expression in derived:
        df = df.withColumn(name, F.expr(expression))
    return df


def trim_strings(df: DataFrame) -> DataFrame:
    """Every string column without leading and trailing spaces, those beyond ASCII included."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.trim(col(n), F.lit(SPACES)) for n in names}) if names else df
