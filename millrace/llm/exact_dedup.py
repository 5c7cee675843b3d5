"""Exact duplicates through composable polynomial fingerprints.

The normalised text (white space deleted, UTF-8) is a polynomial over its bytes, taken modulo a
prime at two points. The fingerprint of two parts in a row follows from those of the parts: the
left one is shifted by the right one's length. So texts are hashed chunk by chunk, and a huge text
is cut into segments that are dealt to all tasks and folded again by its id.

Texts with equal fingerprints are then compared chunk by chunk with one text of their group, in a
sorted stream that holds one reference chunk at a time. A large group is compared in several shares,
each with its own copy of the reference. Texts that differ in spite of equal fingerprints form a
group of their own and are compared again, until none is left. Only texts with a partner are moved.

Cases: null counts as empty, and empty texts equal each other; of equal texts the row with the most
code points stays, then the smallest id (null first). Rows that repeat an id and a text count each
and share the verdict; rows that repeat an id with another text are judged by their own text. An
empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, batch_of, field_type, in_arrow, same, small, stored

#: Bytes hashed or compared at a time.
CHUNK = 1 << 16
#: Longer texts, in code points, are dealt out in segments of this size.
SEGMENT = 1 << 22
#: Texts compared with one copy of their reference.
SHARE = 1_000
#: Rows sent to every task at most (about 60 bytes each).
MOST_SENT = 500_000
_FINGERPRINT = ["f1", "f2", "n_bytes"]


@dataclass(frozen=True)
class Field:
    """A prime below 2**31 and the two points at which texts are evaluated."""

    prime: int = (1 << 31) - 1
    points: tuple[int, int] = (1_403_580_811, 911_382_323)


@lru_cache(maxsize=8)
def _powers(point: int, prime: int) -> np.ndarray:
    """point**(CHUNK - 1), ..., point**1, 1 modulo the prime."""
    out = np.empty(CHUNK, np.int64)
    value = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = value
        value = value * point % prime
    return out


def combine(left: int, right: int, right_bytes: int, point: int, prime: int) -> int:
    """Fingerprint of two parts in a row."""
    return (left * pow(point, right_bytes, prime) + right) % prime


def fingerprint(data: bytes, field: Field) -> tuple[int, int]:
    """Fingerprints of normalised bytes at both points, chunk by chunk."""
    found = [0, 0]
    for start in range(0, len(data), CHUNK):
        chunk = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - start), start).astype(np.int64)
        for k, point in enumerate(field.points):
            own = int(np.dot(chunk, _powers(point, field.prime)[CHUNK - len(chunk) :])) % field.prime
            found[k] = combine(found[k], own, len(chunk), point, field.prime)
    return found[0], found[1]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", "text", F.xxhash64("text").alias("row_key"), F.length("text").cast("long").alias("n_chars")
    )


def _whole(rows: DataFrame, field: Field) -> DataFrame:
    """Fingerprints of texts hashed in one place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.translate(None, WHITE) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            pairs = [fingerprint(t, field) for t in texts]
            columns = [batch.column(n) for n in ("id", "row_key", "n_chars")]
            schema = pa.schema(
                [batch.schema.field(n) for n in ("id", "row_key", "n_chars")]
                + [("n_bytes", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sha", pa.string())]
            )
            yield batch_of(
                schema, *columns, [len(t) for t in texts], [p[0] for p in pairs], [p[1] for p in pairs],
                [hashlib.sha256(t).hexdigest() for t in texts],
            )

    out = f"id {field_type(rows, 'id')}, row_key long, n_chars long, n_bytes long, f1 long, f2 long, sha string"
    return in_arrow(rows, each, out)


def _by_segments(rows: DataFrame, field: Field, segment: int) -> DataFrame:
    """The same for huge texts: segments are hashed by all tasks and folded by their document."""
    plain = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    count = F.ceil(F.col("n_chars") / segment).cast("int")
    cut = rows.withColumn("sha", F.sha2(plain.cast("binary"), 256)).select(
        "id", "row_key", "n_chars", "sha",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("text").substr(i * segment + 1, F.lit(segment)))
        ).alias("segment", "text"),
    )
    keys = ["id", "row_key", "n_chars", "sha"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.translate(None, WHITE) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            pairs = [fingerprint(t, field) for t in texts]
            shifts = [[pow(p, len(t), field.prime) for t in texts] for p in field.points]
            schema = pa.schema(
                [batch.schema.field(n) for n in [*keys, "segment"]]
                + [(n, pa.int64()) for n in ("n", "f1", "f2", "s1", "s2")]
            )
            yield batch_of(
                schema, *(batch.column(n) for n in [*keys, "segment"]),
                [len(t) for t in texts], [p[0] for p in pairs], [p[1] for p in pairs], *shifts,
            )

    out = (
        f"id {field_type(rows, 'id')}, row_key long, n_chars long, sha string, segment int, "
        "n long, f1 long, f2 long, s1 long, s2 long"
    )
    hashed = in_arrow(cut.repartition("row_key", "segment"), each, out)
    part = F.struct("segment", "n", "f1", "f2", "s1", "s2")
    prime = F.lit(field.prime)

    def joined(column: str, shift: str):
        return F.reduce(
            "parts", F.lit(0).cast("long"), lambda left, right: F.pmod(left * right[shift] + right[column], prime)
        )

    folded = hashed.groupBy(*keys).agg(
        F.array_sort(F.collect_set(part)).alias("parts"),
        F.sum(F.when(F.col("segment") == 0, 1).otherwise(0)).cast("int").alias("copies"),
    )
    return folded.select(
        "id", "row_key", "n_chars",
        F.reduce("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_bytes"),
        joined("f1", "s1").alias("f1"), joined("f2", "s2").alias("f2"), "sha",
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")


def _differing(rows: DataFrame, source: DataFrame, most_sent: int) -> DataFrame:
    """`id` and `row_key` of texts that differ from their group's reference."""
    groups = (
        rows.groupBy(*_FINGERPRINT)
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "row_key")).alias("reference"))
        .where("size > 1")
    )
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    is_reference = same(F.col("id"), F.col("reference.id")) & (F.col("row_key") == F.col("reference.row_key"))
    members = stored(
        rows.join(groups, _FINGERPRINT)
        .select("id", "row_key", *_FINGERPRINT, shares.alias("shares"), is_reference.alias("is_reference"))
        .distinct(),
        "dedup-members",
    )
    names = {"id": "its_id", "row_key": "its_key"}
    wanted = small(members.withColumnsRenamed(names), members.count(), most_sent)
    match = same(F.col("id"), F.col("its_id")) & (F.col("row_key") == F.col("its_key"))
    texts = source.select("id", "row_key", "text").join(wanted, match).drop("its_id", "its_key")
    texts = texts.withColumn(
        "share",
        F.explode(
            F.when(F.col("is_reference"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("id", "row_key"), F.col("shares")).cast("int"))
            )
        ),
    ).withColumn("later", ~F.col("is_reference"))
    keys = [*_FINGERPRINT, "share"]
    id_type = field_type(rows, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "later", "id", "row_key"]
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(n) for n in names), ("chunk", pa.int32()), ("data", pa.binary())])
            at, numbers, chunks, held = [], [], [], 0
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = text.as_py().translate(None, WHITE)
                for number, start in enumerate(range(0, max(1, len(data)), CHUNK)):
                    at.append(i)
                    numbers.append(number)
                    chunks.append(data[start : start + CHUNK])
                    held += len(chunks[-1])
                    if held >= 64 * CHUNK:
                        yield batch_of(schema, *(batch.column(n).take(pa.array(at)) for n in names), numbers, chunks)
                        at, numbers, chunks, held = [], [], [], 0
            if at:
                yield batch_of(schema, *(batch.column(n).take(pa.array(at)) for n in names), numbers, chunks)

    chunks = in_arrow(
        texts, cut, f"f1 long, f2 long, n_bytes long, share int, later boolean, id {id_type}, row_key long, chunk int, data binary"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, reference = None, b""
        for batch in batches:
            where = zip(*(batch.column(n).to_pylist() for n in [*keys, "chunk"]))
            rows_here = zip(where, batch.column("later").to_pylist(), batch.column("data").to_pylist())
            differs = []
            for here, later, data in rows_here:
                if not later:
                    place, reference = here, data
                differs.append(place != here or data != reference)
            at = pa.array(np.flatnonzero(differs))
            schema = pa.schema([batch.schema.field(n) for n in ("id", "row_key")])
            yield batch_of(schema, *(batch.column(n).take(at) for n in ("id", "row_key")))

    stream = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk", "later")
    return stored(in_arrow(stream, compare, f"id {id_type}, row_key long").distinct(), "dedup-differing")


def digests(
    docs: DataFrame, id_col: str, text_col: str, field: Field = Field(), segment: int = SEGMENT
) -> DataFrame:
    """`id`, `row_key`, `n_chars`, `n_bytes`, `f1`, `f2` and `sha` of every row."""
    source = _source(docs, id_col, text_col)
    whole = _whole(source.where(F.col("n_chars") <= segment), field)
    return whole.unionByName(_by_segments(source.where(F.col("n_chars") > segment), field, segment))


def exact_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field = Field(),
    segment: int = SEGMENT, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Per row: `id`, `row_key` (of its text), `best` (`id` and `row_key` that stay), `group_size` and `sha`."""
    rows = stored(digests(docs, id_col, text_col, field, segment), "dedup-digests")
    source = _source(docs, id_col, text_col)
    classes, todo, number = None, rows, 0
    while True:
        differing = _differing(todo, source, most_sent)
        more = differing.count()
        if more:
            renamed = differing.toDF("its_id", "its_key")
            match = same(F.col("id"), F.col("its_id")) & (F.col("row_key") == F.col("its_key"))
            equal = todo.join(renamed, match, "left_anti")
            todo_next = stored(todo.join(renamed, match, "left_semi"), "dedup-todo")
        else:
            equal, todo_next = todo, None
        equal = equal.withColumn("class", F.lit(number))
        classes = equal if classes is None else classes.unionByName(equal)
        if not more:
            break
        todo, number = todo_next, number + 1
    keys = [*_FINGERPRINT, "class"]
    keepers = classes.groupBy(*keys).agg(
        F.min(F.struct((-F.col("n_chars")).alias("c"), "id", "row_key")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return classes.join(keepers, keys)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field = Field(),
    segment: int = SEGMENT, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Per row: the id, `keep_id`, `group_size`, `kept` and `text_sha256`."""
    return exact_rows(docs, id_col, text_col, field, segment, most_sent).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        same(F.col("id"), F.col("best.id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
