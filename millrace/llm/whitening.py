"""PCA whitening of embeddings, with each distinct vector handled once.

Entries become whole numbers (`floor(64 * c) + 1000000`), so vectors can be grouped exactly. The fit
takes each distinct vector with weight one or with its number of copies: sums are exact whole numbers,
the covariance is a weighted product of centred blocks, one d x d matrix per task, added by entry. Only
sums and the d x d matrix reach the driver. Each distinct vector is whitened once and joined back to its
rows. A vector that holds more than a thousandth of the rows is joined by broadcast (there are fewer
than a thousand), so that no task gets all rows of a common vector.

Cases: rows whose vector is null, or holds a null or an entry that isn't finite, are left out, and so
are entries too large for a 64-bit number. Vectors of another length are fitted and whitened on their
own; an empty vector has no components and so no rows. A component without variance (all vectors equal,
or fewer vectors than components) gets null instead of a whitened value; `explained` is null if no
component varies. `deviation` is null where it doesn't fit a 64-bit number. Rows that repeat an id count
each, null ids stay. An empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_of, field_type, in_arrow, stored

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this don't become a 64-bit number.
LARGEST = float(1 << 61)
#: A vector with more than this share of the rows is sent to every task.
COMMON_SHARE = 0.001
#: Variance below this part of the largest is none.
NO_VARIANCE = 1e-12
#: Vectors in one product.
BLOCK = 4096


def _packed(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Which rows stay, their whole numbers as bytes (little-endian 64-bit), and their lengths."""
    lists = column.cast(pa.list_(pa.float64()))
    values = lists.flatten()
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    numbers = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        numbers = np.floor(numbers * SCALE)
        wrong = ~(np.abs(numbers) < LARGEST)
        whole = np.where(wrong, 0, numbers).astype("<i8") + SHIFT
    ends = np.cumsum(lengths)
    bad_before = np.concatenate([[0], np.cumsum(wrong)])
    bad = bad_before[ends] - bad_before[ends - lengths] > 0
    keep = np.flatnonzero(~bad & ~np.asarray(column.is_null()))
    return keep, [whole[e - n : e].tobytes() for e, n in zip(ends[keep], lengths[keep])], lengths[keep]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id`, `dims` and `x` (the whole numbers as bytes) of the rows that stay."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed, lengths = _packed(batch.column(1))
            schema = pa.schema([pa.field("id", batch.schema.field(0).type), ("dims", pa.int32()), ("x", pa.binary())])
            yield batch_of(schema, batch.column(0).take(pa.array(keep)), pa.array(lengths, pa.int32()), packed)

    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return in_arrow(source, each, f"id {field_type(vectors, id_col)}, dims int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Vectors of one length at a time, as a matrix of whole numbers."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            for at in range(0, len(rows), BLOCK):
                part = batch.take(pa.array(rows[at : at + BLOCK]))
                data = b"".join(part.column("x").to_pylist())
                yield d, part, np.frombuffer(data, "<i8").reshape(len(part), d)


def _added(parts: DataFrame, value: str) -> dict[tuple[int, int], object]:
    """Sum of `value` per length and place, over the rows that each task gives."""
    spread = parts.select("dims", F.posexplode(value).alias("place", "value"))
    return {(r.dims, r.place): r.total for r in spread.groupBy("dims", "place").agg(F.sum("value").alias("total")).collect()}


def _sums(distinct: DataFrame, counted: bool) -> dict[int, tuple[int, list[int]]]:
    """Per length: the total weight and the exact sum of each dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for d, part, x in _blocks(batches):
            weights = part.column("copies").to_numpy() if counted else np.ones(len(x), np.int64)
            if int(np.abs(x).max(initial=0)) * int(weights.max(initial=0)) * len(x) < 1 << 63:
                own = (weights @ x).tolist()
            else:
                own = [sum(w * v for w, v in zip(weights.tolist(), column)) for column in x.T.tolist()]
            total = totals.setdefault(d, [0] * (d + 1))
            for i, value in enumerate([int(weights.sum()), *own]):
                total[i] += value
        if totals:
            schema = pa.schema([("dims", pa.int32()), ("sums", pa.list_(pa.decimal128(38, 0)))])
            yield batch_of(schema, list(totals), [[Decimal(v) for v in t] for t in totals.values()])

    found = _added(in_arrow(distinct, each, "dims int, sums array<decimal(38, 0)>"), "sums")
    lengths = sorted({d for d, _ in found})
    return {d: (int(found[d, 0]), [int(found[d, i + 1]) for i in range(d)]) for d in lengths}


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision, without cancelling: the whole part is taken off first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _covariance(distinct: DataFrame, fit: dict[int, tuple[int, list[int]]], counted: bool) -> dict[int, np.ndarray]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for d, part, x in _blocks(batches):
            y = _centred(x, *fit[d])
            weighted = y * part.column("copies").to_numpy()[:, None] if counted else y
            totals[d] = totals.get(d, 0) + weighted.T @ y
        if totals:
            schema = pa.schema([("dims", pa.int32()), ("products", pa.list_(pa.float64()))])
            yield batch_of(schema, list(totals), [m.ravel() for m in totals.values()])

    found = _added(in_arrow(distinct, each, "dims int, products array<double>"), "products")
    out = {}
    for d, (n, _) in fit.items():
        matrix = np.array([found.get((d, i), 0.0) for i in range(d * d)]).reshape(d, d) / n
        out[d] = (matrix + matrix.T) / 2
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    return values[::-1][:most], vectors[:, ::-1][:, :most]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact."""
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    apart = x - whole  # n * x - S is n * apart - rest
    if x.shape[1] * ((int(np.abs(apart).max(initial=0)) + 1) * n) ** 2 < 1 << 63:
        return ((apart * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in apart.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(distinct: DataFrame, fit: dict, bases: dict) -> DataFrame:
    """`dims`, `x`, `copies`, `deviation` and `whitened` (null per component without variance)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("dims", pa.int32()), ("x", pa.binary()), ("copies", pa.int64()), ("deviation", pa.int64()),
            ("whitened", pa.list_(pa.float64())),
        ])
        for d, part, x in _blocks(batches):
            values, vectors = bases[d]
            varies = values > NO_VARIANCE * max(values[0], 0) if len(values) else np.empty(0, bool)
            scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1)), np.nan)
            white = (_centred(x, *fit[d]) @ vectors) * scale
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            offsets = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield batch_of(schema, *(part.column(c) for c in ("dims", "x", "copies")), _deviations(x, *fit[d]), lists)

    return in_arrow(distinct, each, "dims int, x binary, copies long, deviation long, whitened array<double>")


def _identity_error(white: DataFrame, fit: dict, counted: bool) -> dict[int, float]:
    """Per length: largest entry of the whitened vectors' covariance minus the identity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, lists = batch.column("dims").to_numpy(), batch.column("whitened")
            for d in np.unique(dims).tolist():
                rows = pa.array(np.flatnonzero(dims == d))
                own = lists.take(rows)
                w = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                weights = batch.column("copies").take(rows).to_numpy() if counted else np.ones(len(own))
                ones = np.column_stack([np.ones(len(w)), w])
                totals[d] = totals.get(d, 0) + (ones * weights[:, None]).T @ ones
        if totals:
            schema = pa.schema([("dims", pa.int32()), ("products", pa.list_(pa.float64()))])
            yield batch_of(schema, list(totals), [m.ravel() for m in totals.values()])

    found = _added(in_arrow(white.select("dims", "copies", "whitened"), each, "dims int, products array<double>"), "products")
    out = {}
    for d, (n, _) in fit.items():
        places = [i for k, i in found if k == d]
        if not places:
            continue
        k = int(round(len(places) ** 0.5))
        m = np.array([found[d, i] for i in range(k * k)]).reshape(k, k) / n
        mean = m[0, 1:]
        off = np.abs(m[1:, 1:] - np.outer(mean, mean) - np.eye(k - 1))
        off = off[~np.isnan(off)]
        out[d] = float(off.max()) if off.size else 0.0
    return out


def _per_length(values: dict[int, object], kind: str) -> Column:
    """The value for the row's `dims`; one literal per length of vectors."""
    out = F.lit(None).cast(kind)
    for d, value in values.items():
        out = F.when(F.col("dims") == d, F.lit(value).cast(kind)).otherwise(out)
    return out


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, weights: str = "one",
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """Per row and component (up to `most`): the id, `component`, `n` (weight of the fit), `deviation`,
    `whitened`, `explained` and `identity_error`. `weights` is "one" or "copies"."""
    if weights not in ("one", "copies"):
        raise ValueError(f"weights must be 'one' or 'copies', not {weights!r}")
    counted = weights == "copies"
    rows = stored(whole_vectors(vectors, id_col, vector_col).where("dims > 0"), "whiten-rows")
    distinct = stored(rows.groupBy("dims", "x").agg(F.count(F.lit(1)).alias("copies")), "whiten-distinct")
    fit = _sums(distinct, counted)
    matrices = _covariance(distinct, fit, counted)
    bases = {d: components(m, most) for d, m in matrices.items()}
    white = stored(_whitened(distinct, fit, bases), "whiten-distinct-done")
    errors = _identity_error(white, fit, counted)

    total = distinct.agg(F.sum("copies")).first()[0] or 0
    is_common = F.col("copies") > max(1, int(total * common_share))
    match = lambda other: (rows["dims"] == other["dims"]) & (rows["x"] == other["x"])
    found = ["id", "deviation", "whitened"]
    common = white.where(is_common)
    rest = white.where(~is_common)
    if total and common.limit(1).count():
        sent = F.broadcast(common)
        back = rows.join(sent, match(sent)).select(*found, rows["dims"])
        others = rows.join(F.broadcast(common.select("dims", "x")), ["dims", "x"], "left_anti")
        back = back.unionByName(others.join(rest, ["dims", "x"]).select(*found, "dims"))
    else:
        back = rows.join(white, match(white)).select(*found, rows["dims"])

    explained = {}
    for d, (values, _) in bases.items():
        trace = float(np.trace(matrices[d]))
        explained[d] = [float(v) / trace if trace > 0 else None for v in values]
    shown = back.withColumns({
        "n": _per_length({d: n for d, (n, _) in fit.items()}, "long"),
        "shares": _per_length({d: F.array(*(F.lit(v).cast("double") for v in e)) for d, e in explained.items()}, "array<double>"),
        "identity_error": _per_length(errors, "double"),
    })
    spread = shown.select("id", "n", "deviation", "shares", "identity_error", F.posexplode("whitened").alias("place", "value"))
    return spread.select(
        F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), "n", "deviation",
        F.col("value").alias("whitened"), F.get("shares", "place").alias("explained"), "identity_error",
    )
