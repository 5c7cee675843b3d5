"""Near copies: texts that share a given part of their different shingles, checked exactly.

Candidates come from two sides. Each text gets several fingerprints, made of a few minima of hashed shingles
each, and texts with one in common are candidates (a pair at a similarity of 0.8 is missed once in about
1500 by these alone); so are texts that the SimHash trees link. Candidates are joined to groups by stars, so
pairs are never made.

A group is cut into shares of bounded number and size; each share with itself and each pair of shares is a unit
of work of its own. Within a unit each text is compared with those not reached yet: first by the number of
minima they have in common, for all of them at once, then what is close by the whole sets of shingles. Every pair of a
group meets in some unit, and what is linked is what similar pairs connect. So no task holds a whole group,
and near copies of one text are each compared about once. Texts of one template that aren't similar enough cost a
comparison of minima per pair, which is quadratic in the size of their group, dealt over all tasks.

Cases: a null or blank text is one empty shingle; a text of fewer words than a shingle is one shingle.
Rows that repeat an id and a text are one; null ids come last. An empty table gives no rows. Only the id and
text columns are read, so others can't clash. A text's set of shingles is held whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_of, field_type, in_arrow, small, stored, text_bytes
from millrace.llm.simhash import SEED, components, near_groups

#: Fingerprints of a text, and minima in each.
BANDS, MINIMA = 40, 8
#: Shingles whose minima are taken at a time.
BLOCK = 512
#: Nodes sent to every task at most (32 bytes each).
MOST_SENT = 1_000_000
#: Texts and bytes of shingles in a share of a group.
SHARE, SHARE_BYTES = 1024, 16 << 20
#: Part of the minima, in percent, that texts must have in common to be compared as sets, and the same for texts of few
#: shingles, whose minima vary more. At a similarity of 0.8 the first is six standard deviations away.
CLOSE, CLOSE_FEW, FEW = 66, 50, 64
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 32, (2, BANDS * MINIMA), dtype=np.uint32) | np.array([[1], [0]], np.uint32)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different shingles, hashed and sorted."""
    tokens = text.lower().split()
    if len(tokens) < words:
        parts = iter([b" ".join(tokens)])
    else:
        parts = map(b" ".join, zip(*(islice(tokens, k, None) for k in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a set of shingles under each hash."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * MINIMA, (1 << 32) - 1, np.uint32)
    for start in range(0, len(short), BLOCK):
        mixed = short[start : start + BLOCK, None] * _FACTORS[0] + _FACTORS[1]
        least = np.minimum(least, mixed.min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of shingles, from its minima."""
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64)


def links_of(sets: list[np.ndarray], marks: np.ndarray, tenths: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links, as positions, that connect what pairs of at least `tenths` / 10 similarity connect; with `side`, pairs
    of different sides. `marks` holds a row of minima per set; no pair is linked that isn't similar."""
    sizes = np.array([len(s) for s in sets])
    bar = np.where(sizes > FEW, CLOSE, CLOSE_FEW) * marks.shape[1]
    pools = [np.arange(len(sets))] if side is None else [np.flatnonzero(side == k) for k in (0, 1)]
    waiting = np.ones(len(sets), bool)
    links = []
    for first in range(len(sets)):
        front = [first] if waiting[first] else []
        waiting[first] = False
        while front:
            at = front.pop()
            pool = 0 if side is None else 1 - side[at]
            others = pools[pool] = pools[pool][waiting[pools[pool]]]
            both = sizes[others] + sizes[at]
            near = (10 + tenths) * np.minimum(sizes[others], sizes[at]) >= tenths * both
            common = np.count_nonzero(marks[others] == marks[at], axis=1)
            near &= 100 * common >= np.minimum(bar[others], bar[at])
            for place in np.flatnonzero(near):
                shared = len(np.intersect1d(sets[at], sets[others[place]], assume_unique=True))
                near[place] = (10 + tenths) * shared >= tenths * both[place]
            found = others[near].tolist()
            waiting[others[near]] = False
            links += [(at, other) for other in found]
            front += found
    return links


def _units(members: DataFrame) -> DataFrame:
    """`members` with the units they take part in, `low` and `high`: a share of their group with itself and with each
    other one; `side` is 1 in the higher of two."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("set")).alias("bytes"))
    cut = sizes.select("root", F.ceil(F.greatest(F.col("n") / SHARE, F.col("bytes") / SHARE_BYTES)).cast("int").alias("shares"))
    cut = cut.where("shares > 1")
    shared = members.join(cut, "root", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("shares")).cast("int")
    spread = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    return spread.select("root", low, high, side, "name", "set", "marks")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tenths: int = 8) -> DataFrame:
    """`id` and `text_key` of every row that isn't the first (by id, null last) of its linked texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # Candidates are known by a 64-bit hash of the row: should two rows have one, more candidates are compared. What is
    # linked is known by 128 bits.
    whole = F.concat_ws("\n", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("id").isNull().cast("string"), "text")
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("node", F.xxhash64("id", "text"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("band", pa.int64())])
        for batch in batches:
            found = [bands(minima(shingles(t, words))) for t in text_bytes(batch.column(1))]
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield batch_of(schema, pa.array(node), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    marks = stored(in_arrow(rows.select("node", "text"), marked, "node long, band long"), "near-bands")
    stars = marks.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").drop("b")
    links = marks.join(stars, "band").select("a", F.col("node").alias("b"))
    trees = near_groups(rows.select("node", "text"), "node", "text", words=words)
    groups = components(links.unionByName(trees.select(F.col("component_id").alias("a"), F.col("node").alias("b"))))
    sent = small(groups, groups.count(), MOST_SENT)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "name", "id", "text_key"]
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(n) for n in names), ("set", pa.binary()), ("marks", pa.binary())])
            sets = [shingles(t, words) for t in text_bytes(batch.column("text"))]
            least = [minima(found).astype(np.uint8).tobytes() for found in sets]
            yield batch_of(schema, *(batch.column(n) for n in names), [found.tobytes() for found in sets], least)

    kind = f"root long, name binary, id {field_type(rows, 'id')}, text_key long, set binary, marks binary"
    chosen = rows.join(sent, "node").select("root", F.unhex(F.md5(whole.cast("binary"))).alias("name"), "id", "text_key", "text")
    members = stored(in_arrow(chosen, described, kind), "near-members")
    texts = members.dropDuplicates(["name"])  # rows that repeat an id and a text

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

        def each():
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("root", "low", "high", "side", "name", "set", "marks")))

        for (_, low, high), unit in groupby(each(), lambda row: row[:3]):
            sides, names, sets, least = zip(*(row[3:] for row in unit))
            pairs = links_of(
                [np.frombuffer(found, np.uint64) for found in sets],
                np.frombuffer(b"".join(least), np.uint8).reshape(len(least), -1), tenths,
                np.array(sides) if low != high else None,
            )
            if pairs:
                yield batch_of(schema, [names[i] for i, _ in pairs], [names[j] for _, j in pairs])

    unit = ["root", "low", "high"]
    stream = _units(texts).repartition(*unit).sortWithinPartitions(*unit)
    linked = components(in_arrow(stream, meet, "a binary, b binary"))
    named = members.select("name", "id", "text_key").join(linked.withColumnRenamed("node", "name"), "name")
    rank = F.struct(F.col("id").isNull(), "id", "text_key")
    first = named.groupBy("root").agg(F.min(rank).alias("first"))
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")))
    return named.join(first, "root").where(later).select("id", "text_key")
