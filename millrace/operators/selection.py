"""Rows by their place in an order, found by narrowing instead of sorting everything.

A sample of bounded size brackets the wanted places by two values of the order's key. One count of the
rows below, at, between and above these values tells where the places really are; nothing depends on
the sample but the speed. Only the rows of that part go on, by a filter that reaches the scan, until so few
are left that they can be sorted. Rows that are equal in one key go on with the next one; rows equal in
all keys are only counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are sorted without narrowing them further.
BOUND = 100_000
#: Sampled values per bracket.
SAMPLED = 1 << 15


def collectable(value: Column, dtype: T.DataType) -> Column:
    """The value in a form that comes to the driver and back without loss."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value)
    if isinstance(dtype, T.StructType):
        fields = [collectable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: collectable(x, dtype.elementType))
    if isinstance(dtype, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.TimestampNTZType)):
        return value
    raise TypeError(f"cannot look for a place in the order of {dtype.simpleString()}")


def literal(value: Any, dtype: T.DataType) -> Column:
    """A value that `collectable` brought to the driver as a constant of its type."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value).cast("bigint"))
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(value).cast("int"))
    if isinstance(dtype, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.array(*[literal(x, dtype.elementType) for x in value]).cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.lit(bytes(value))
    return F.lit(str(value) if isinstance(dtype, T.TimestampNTZType) else value).cast(dtype)


@dataclass(frozen=True)
class Key:
    """One key of an order; NULLs come first ascending and last descending."""

    value: Column
    dtype: T.DataType
    descending: bool = False

    @property
    def sorting(self) -> Column:
        return self.value.desc() if self.descending else self.value.asc()


@dataclass(frozen=True)
class Segment:
    """`wanted` places from `skip` on among the `size` rows that fulfil the conditions and are equal in the
    keys before number `key`."""

    conditions: tuple[Column, ...]
    key: int
    size: int
    skip: int
    wanted: int

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(Column.__and__, self.conditions)) if self.conditions else df


def _same(left: Any, right: Any) -> bool:
    """Equality as in Spark, where NaN equals NaN."""
    if isinstance(left, (tuple, list)) and isinstance(right, (tuple, list)):
        return len(left) == len(right) and all(map(_same, left, right))
    return left == right or (left != left and right != right)


def _below(key: Key, end: Any) -> Column:
    if end != end:  # NaN is the largest; scans that skip by minimum and maximum leave it out of account
        return key.value.isNotNull() & ~F.isnan(key.value)
    return key.value < literal(end, key.dtype)


def _at(key: Key, end: Any) -> Column:
    return F.isnan(key.value) if end != end else key.value == literal(end, key.dtype)


def _above(key: Key, end: Any) -> Column:
    if end != end:
        return F.lit(False)
    after = key.value > literal(end, key.dtype)
    return after | F.isnan(key.value) if isinstance(key.dtype, T.FractionalType) and not isinstance(key.dtype, T.DecimalType) else after


def _classes(key: Key, low: Any, high: Any) -> list[tuple[Column, bool]]:
    """Conditions that cut the rows, in their order, at the two values, and whether all of a class are equal."""
    found = [(key.value.isNull(), True)]
    if high is None:
        found.append((key.value.isNotNull(), False))
    elif low is None or _same(low, high):
        found += [(_below(key, high), False), (_at(key, high), True), (_above(key, high), False)]
    else:
        found += [(_below(key, low), False), (_at(key, low), True), (_above(key, low) & _below(key, high), False)]
        found += [(_at(key, high), True), (_above(key, high), False)]
    return found[::-1] if key.descending else found


def _bracket(rows: DataFrame, key: Key, segment: Segment) -> tuple[Any, Any]:
    """Two values of the key with the wanted places most likely between them."""
    share = min(1.0, SAMPLED / segment.size)
    keys = rows.select(F.struct(collectable(key.value, key.dtype).alias("v")).alias("k"))
    listed = keys.sample(share, seed=7).agg(F.sort_array(F.collect_list("k")).alias("found"))
    first, last = segment.skip / segment.size, (segment.skip + segment.wanted) / segment.size
    if key.descending:
        first, last = 1 - last, 1 - first
    n = F.size("found")
    margin = 1.5 * F.sqrt(n) + 1

    def at(place: Column) -> Column:
        return F.get("found", F.greatest(F.lit(0), F.least(n - 1, place)).cast("int"))

    ends = listed.select(at(F.floor(first * n - margin)).alias("low"), at(F.ceil(last * n + margin)).alias("high")).first()
    if ends.low is None:  # nothing was sampled
        ends = keys.agg(F.min("k").alias("low"), F.max("k").alias("high")).first()
    return ends.low.v, ends.high.v


def _narrowed(df: DataFrame, keys: Sequence[Key], segment: Segment, bound: int) -> list[Segment]:
    """Segments of at most `bound` rows, of wholly equal rows or of wanted rows only, in their order."""
    if segment.size <= max(bound, segment.wanted) or segment.key == len(keys):
        return [segment]
    key, rows = keys[segment.key], segment.rows(df)
    classes = _classes(key, *_bracket(rows, key, segment))
    counts = rows.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(classes)]).first()
    touched, start, end = [], 0, segment.skip + segment.wanted
    for (condition, equal), size in zip(classes, counts):
        low, high = max(segment.skip, start), min(end, start + size)
        if low < high:
            conditions = (*segment.conditions, condition)
            touched.append(Segment(conditions, segment.key + equal, size, low - start, high - low))
        start += size
    if sum(s.size for s in touched) <= max(bound, segment.wanted):
        either = reduce(Column.__or__, [s.conditions[-1] for s in touched])
        size = sum(s.size for s in touched)
        return [replace(segment, conditions=(*segment.conditions, either), size=size, skip=touched[0].skip)]
    return [found for s in touched for found in _narrowed(df, keys, s, bound)]


def rows_at(df: DataFrame, keys: Sequence[Key], skip: int, wanted: int, bound: int = BOUND) -> DataFrame:
    """`wanted` rows in the order of the keys after the first `skip`. Looking for them runs small jobs; the
    result is lazy and sorts at most about `bound` rows, or the wanted ones."""
    size = df.count()
    wanted = min(wanted, size - skip)
    if wanted <= 0:
        return df.limit(0)
    order = [k.sorting for k in keys]
    found = []
    for segment in _narrowed(df, keys, Segment((), 0, size, skip, wanted), bound):
        rows = segment.rows(df)
        if segment.key < len(keys):
            rows = rows.orderBy(*order).offset(segment.skip)
        found.append(rows.limit(segment.wanted))
    return found[0] if len(found) == 1 else reduce(DataFrame.unionAll, found).orderBy(*order)


@dataclass(frozen=True)
class _Place:
    """The key at a rank (from 1) is searched among those after `low` and before `high` (None: no end),
    of which there are `size`, with `before` rows ahead of them."""

    name: str
    rank: int
    before: int
    size: int
    low: Row | None = None
    high: Row | None = None
    found: Row | None = None

    def inside(self, value: Column, dtype: T.DataType) -> Column:
        """Whether the value is after `low` and before `high`."""
        out = F.lit(True)
        if self.low is not None:
            out = out & (value > literal(self.low, dtype))
        if self.high is not None:
            out = out & (value < literal(self.high, dtype))
        return out


def keys_at(
    df: DataFrame, orders: Mapping[str, Column], ranks: Mapping[str, Sequence[int]], bound: int = BOUND
) -> dict[str, dict[int, Column]]:
    """Per order (a struct of its keys, all ascending, NULLs first) the key at each rank from 1 on, as a constant.

    All ranks of all orders are narrowed together, by two aggregates over `df` a time, so `df` should be
    cheap to read.
    """
    size = df.count()
    types = {n: df.select(v.alias("k")).schema["k"].dataType for n, v in orders.items()}
    places = [_Place(n, r, 0, size) for n in orders for r in ranks[n] if 1 <= r <= size]
    while True:
        wide = [p for p in places if p.found is None and p.size > bound]
        if not wide:
            break
        narrowed = iter(_narrow_places(df, orders, types, wide))
        places = [next(narrowed) if p in wide else p for p in places]
    open_ = [p for p in places if p.found is None]
    hits: dict[int, Row] = {}
    if open_:
        one_of = F.filter(
            F.array(*[
                F.when(p.inside(orders[p.name], types[p.name]), F.struct(F.lit(i).alias("place"), F.lit(p.rank - p.before).alias("wanted")))
                for i, p in enumerate(open_)
            ]), F.isnotnull,
        )
        listed = df.select(*[v.alias(n) for n, v in orders.items()], F.explode(one_of).alias("p")).select("p.*", *orders)
        # NULL in a field of a struct comes first; each place has at most `bound` rows here.
        parts = []
        for name in dict.fromkeys(p.name for p in open_):
            own = [i for i, p in enumerate(open_) if p.name == name]
            rank = F.row_number().over(Window.partitionBy("place").orderBy(name))
            ranked = listed.where(F.col("place").isin(own)).select("place", "wanted", name).withColumn("rank", rank)
            parts.append(ranked.where("rank = wanted").select("place", collectable(F.col(name), types[name]).alias(name)))
        taken = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        hits = {r.place: r[open_[r.place].name] for r in taken.collect()}
    out: dict[str, dict[int, Column]] = {n: {} for n in orders}
    for p in places:
        key = p.found if p.found is not None else hits[open_.index(p)]
        out[p.name][p.rank] = literal(key, types[p.name])
    return out


def _narrow_places(
    df: DataFrame, orders: Mapping[str, Column], types: Mapping[str, T.DataType], places: Sequence[_Place]
) -> list[_Place]:
    """The places, each in a smaller part of its order or found."""
    inside = [p.inside(orders[p.name], types[p.name]) for p in places]
    rows = df.where(reduce(Column.__or__, inside))
    rows = rows.sample(min(1.0, SAMPLED / max(p.size for p in places)), seed=7)
    parts = list(dict.fromkeys((p.name, p.low, p.high) for p in places))  # several places may be in one
    lists = []
    for i, (name, low, high) in enumerate(parts):
        within = _Place(name, 0, 0, 0, low, high).inside(orders[name], types[name])
        lists.append(F.sort_array(F.collect_list(F.when(within, collectable(orders[name], types[name])))).alias(f"l{i}"))
    wanted = []
    for i, p in enumerate(places):
        found = F.col(f"l{parts.index((p.name, p.low, p.high))}")
        n, middle = F.size(found), (p.rank - p.before) / p.size
        margin = 1.5 * F.sqrt(n) + 1
        ends = [F.greatest(F.lit(0), F.least(n - 1, place)).cast("int") for place in (F.floor(middle * n - margin), F.ceil(middle * n + margin))]
        wanted.append(F.struct(F.get(found, ends[0]).alias("low"), F.get(found, ends[1]).alias("high")).alias(f"e{i}"))
    brackets = rows.agg(*lists).select(*wanted).first()
    counts, cuts = [], []
    for i, (p, within) in enumerate(zip(places, inside)):
        low, high = brackets[i].low, brackets[i].high
        if low is None:  # nothing was sampled
            ends = df.where(within).select(collectable(orders[p.name], types[p.name]).alias("k")).agg(F.min("k"), F.max("k")).first()
            low, high = ends[0], ends[1]
        cuts.append((low, high))
        value, bottom, top = orders[p.name], literal(low, types[p.name]), literal(high, types[p.name])
        for k, part in enumerate((value < bottom, value == bottom, (value > bottom) & (value < top), value == top)):
            counts.append(F.count_if(within & part).alias(f"c{i}_{k}"))
    told = df.agg(*counts).first()
    return [_placed(p, *cuts[i], [told[4 * i + k] for k in range(4)]) for i, p in enumerate(places)]


def _placed(p: _Place, low: Row, high: Row, counts: Sequence[int]) -> _Place:
    """The part of the bracket that the rank is in."""
    below, at_low, between, at_high = counts
    if _same(low, high):
        at_high = 0
    rank, start = p.rank - p.before, 0
    for size, part in (
        (below, {"high": low}), (at_low, {"found": low}), (between, {"low": low, "high": high}), (at_high, {"found": high}),
    ):
        if rank <= start + size:
            return replace(p, before=p.before + start, size=size, **part)
        start += size
    return replace(p, before=p.before + start, size=p.size - start, low=high)


def buckets_by(value: Column, cuts: Sequence[Column]) -> Column:
    """One more than the number of cuts before the value."""
    out = F.lit(len(cuts) + 1)
    for i in range(len(cuts), 0, -1):
        out = F.when(value <= cuts[i - 1], i).otherwise(out)
    return out.cast("bigint")
