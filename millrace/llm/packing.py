"""Best-two-fit packing of documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so all there is to plan is how many pieces there are
of each length. The plan is made from those counts (at most `capacity` numbers, whatever the
input): a bin is filled greedily with the longest pieces that fit; then its smallest piece gives
way to two unpacked pieces that fill the widened gap better, as long as that helps. The same bin is
used as often as the counts allow, so there are few different bins. Pieces then find their place
from their rank among the pieces of their length; ranks are counted in small hash groups, so no
task sorts a frequent length alone.

Cases: null and empty texts are just the end token; longer documents are cut into pieces of the full
capacity, the first of which may be shorter. Repeated rows are packed as often as they come, ties
are broken by a hash of the key, an empty table gives no rows. Only the id and text columns are
read by `pieces`; `place` keeps the columns it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.common import batch_of, field_type, in_arrow, stored

#: Pieces ranked together, about.
GROUP_ROWS = 2_000

Bin = tuple[dict[int, int], int]  # how often each length is in it; how many such bins


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, `piece`, `start`, `length` and `ids` (little-endian unsigned 32-bit numbers)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bpe.encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = ([], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([known.ids(text.as_py() or ""), end])
                first = len(ids) % capacity or capacity
                for number, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if number else 0
                    for column, value in zip(rows, (i, number, start, stop - start, ids[start:stop].tobytes())):
                        column.append(value)
            field = batch.schema.field(0)
            schema = pa.schema([field, ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
            yield batch_of(schema, batch.column(0).take(pa.array(rows[0], pa.int64())), *rows[1:])

    out = f"`{id_col}` {field_type(docs, id_col)}, piece int, start long, length long, ids binary"
    return in_arrow(docs.select(id_col, text_col), each, out)


def _longest(left: np.ndarray, most: int) -> int:
    """The longest length up to `most` that is left, or 0."""
    found = np.flatnonzero(left[: most + 1])
    return int(found[-1]) if len(found) else 0


def _best_two(left: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """Two lengths left that together fill `gap` best, and more than `more_than` of it."""
    there = np.flatnonzero(left[: gap + 1])
    best, pair = more_than, None
    for a in there[::-1]:
        if 2 * a <= best:
            break
        b = _longest(left, min(int(a) - 1, gap - int(a)))
        if left[a] > 1 and 2 * a <= gap:
            b = int(a)
        if b and a + b > best:
            best, pair = int(a) + b, (int(a), b)
    return pair


def plan(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Bins that take exactly the pieces counted."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        left[length] = n
    bins: list[Bin] = []
    while longest := _longest(left, capacity):
        rest, inside, gap = left.copy(), [longest], capacity - longest
        rest[longest] -= 1
        while gap and (fits := _longest(rest, gap)):
            times = min(int(rest[fits]), gap // fits)
            inside += [fits] * times
            rest[fits] -= times
            gap -= fits * times
        while gap and len(inside) > 1:
            smallest = min(inside[1:])
            pair = _best_two(rest, gap + smallest, smallest)
            if pair is None:
                break
            inside.remove(smallest)
            rest[smallest] += 1
            for length in pair:
                inside.append(length)
                rest[length] -= 1
            gap += smallest - sum(pair)
        used = {length: inside.count(length) for length in sorted(set(inside), reverse=True)}
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        bins.append((used, times))
    return bins


def places(bins: list[Bin]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): ranks from there on fill that place."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for used, times in bins:
        offset = 0
        for length, n in used.items():
            for _ in range(n):
                rank = taken.get(length, 0)
                found.setdefault(length, []).append((rank, sequence, offset))
                taken[length] = rank + times
                offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def ranked(df: DataFrame, keys: list[str], sizes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`df` with `rank` from 0 within each `length`; `sizes` has the rows per length."""
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_of_length") / group_rows)).cast("long")
    spread = (
        df.join(F.broadcast(sizes), "length")
        .withColumn("hash_of_key", F.xxhash64(*keys))
        .withColumn("rank_group", F.pmod(F.col("hash_of_key"), groups))
    )
    before = Window.partitionBy("length").orderBy("rank_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy("length", "rank_group").agg(F.count(F.lit(1)).alias("n_in_group"))
        .withColumn("rank_start", F.coalesce(F.sum("n_in_group").over(before), F.lit(0)))
        .drop("n_in_group")
    )
    inside = Window.partitionBy("length", "rank_group").orderBy("hash_of_key", *keys)
    return (
        spread.withColumn("rank_inside", F.row_number().over(inside))
        .join(starts, ["length", "rank_group"])
        .withColumn("rank", F.col("rank_start") + F.col("rank_inside") - 1)
        .drop("rank_start", "rank_inside", "rank_group", "hash_of_key", "n_of_length")
    )


def place(rows: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """`rows` (with a `length`) and the `sequence_id` and `offset` of each."""
    rows = stored(rows, "packing-pieces")
    sizes = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n_of_length"))
    counts = {int(r[0]): int(r[1]) for r in sizes.collect()}  # one number per length
    where = places(plan(counts, capacity))
    few = rows.sparkSession.createDataFrame(sorted(counts.items()), "length long, n_of_length long")
    order = ranked(rows, keys, few)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at, table = np.flatnonzero(length == value), where[int(value)]
                slot = np.searchsorted(table[:, 0], rank[at], "right") - 1
                sequence[at] = table[slot, 1] + rank[at] - table[slot, 0]
                offset[at] = table[slot, 2]
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    order = order.select(*rows.columns, "rank")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return in_arrow(order, each, f"{out}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids: `sequence_id` and `ids` of rows that still have their `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    return placed.groupBy("sequence_id").agg(
        F.reduce(parts, F.lit(b""), lambda joined, part: F.concat(joined, part["ids"])).alias("ids")
    )
