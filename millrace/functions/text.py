"""Text expressions: checksums, JSON payloads, paths, durations and test-log fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import col

_FIELD_BREAK = "\u001f"
_NULL_MARK = "\u0000"


def fingerprint(value: Column, length: int = 64) -> Column:
    """Lower-case hex SHA-256 of a string, cut to `length` characters."""
    digest = F.sha2(value, 256)
    return digest if length >= 64 else F.substring(digest, 1, length)


def row_checksum(columns: Sequence[str]) -> Column:
    """SHA-256 over the text of the columns; NULL and the empty string stay different."""
    parts = [F.coalesce(col(c).cast("string"), F.lit(_NULL_MARK)) for c in columns]
    return F.sha2(F.concat_ws(_FIELD_BREAK, *parts), 256)


def json_payload(value: Column) -> Column:
    """JSON text of a struct or map column, `{}` when it is NULL."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def normal_path(path: Column) -> Column:
    """Path without trailing slashes, so that `a/b/` and `a/b` compare equal."""
    return F.regexp_replace(path, "/+$", "")


def duration_label(start: Column, end: Column) -> Column:
    """`42s` below a minute, else `3m 5s`; NULL when either end is missing."""
    seconds = F.timestamp_diff("SECOND", start, end)
    minutes = F.floor(seconds / 60).cast("bigint")
    rest = (seconds - minutes * 60).cast("bigint")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))
    )


def first_number(text: Column, pattern: str) -> Column:
    """First capture group of `pattern` as bigint, NULL without a match."""
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")
