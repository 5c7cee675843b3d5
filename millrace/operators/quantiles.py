"""Quantile thresholds and quintile scores over frames of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import col, quoted

QUINTILES = (0.2, 0.4, 0.6, 0.8)

# Rank error of the sketch is 1 / ACCURACY of the rows; its state does not grow beyond that.
ACCURACY = 10_000

# Parts of a bracket that are counted before one of them is ranked.
BINS = 1024


def quantile_points(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = QUINTILES,
    *,
    exact: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row with one array of doubles per column: the smallest value v of the column such
    that at least `p * n` of its n non-NULL values are <= v, for every probability p.

    `exact=False` takes the sketch's answer, off by at most n / accuracy ranks. `exact=True`
    uses the sketch only to bracket every point and then counts: values outside all brackets
    collapse to one row per gap while they are read, and the few different values inside a bracket
    (about n / 1000 at the default accuracy) are counted per bin, of which a bracket has about a thousand.
    Only the bins that hold a point are ranked, each on its own. Should a point lie outside its bracket, the
    query fails instead of giving a wrong one.
    """
    if not exact:
        return df.agg(
            *[
                F.percentile_approx(col(c).cast("double"), list(probabilities), accuracy).alias(c)
                for c in columns
            ]
        )
    counted = _counted_values(df, columns, _brackets(df, columns, probabilities, accuracy), probabilities)
    sizes = counted.groupBy("metric", "bin").agg(F.sum("rows").alias("size"))
    # A few thousand bins per column; only those that hold a point go on.
    upto = F.sum("size").over(Window.partitionBy("metric").orderBy("bin"))
    total = F.sum("size").over(Window.partitionBy("metric"))
    ends = sizes.select("metric", "bin", "size", upto.alias("upto"), total.alias("total"))
    held = " OR ".join(f"({_hit(p, 'size')})" for p in probabilities)
    touched = ends.where(held).select("metric", "bin", (F.col("upto") - F.col("size")).alias("before"), "total")
    by_value = Window.partitionBy("metric", "bin").orderBy(F.col("value").asc_nulls_first(), F.col("inside").desc())
    ranked = counted.join(F.broadcast(touched), ["metric", "bin"]).select(
        "metric", "inside", "value", "rows", (F.col("before") + F.sum("rows").over(by_value)).alias("upto"), "total"
    )
    hits = ranked.withColumn("hits", F.expr(f"array({', '.join(map(_hit, probabilities))})"))
    points = [", ".join(_point(i, j) for j in range(len(probabilities))) for i in range(len(columns))]
    return hits.agg(*[F.expr(f"array({p})").alias(c) for p, c in zip(points, columns)])


def _brackets(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int
) -> Column:
    """Scalar subquery: per column the low and high end around every probability."""
    margin = 5.0 / accuracy
    low = [max(0.0, p - margin) for p in probabilities]
    high = [min(1.0, p + margin) for p in probabilities]
    ends = df.agg(
        F.struct(
            *[
                F.percentile_approx(col(c).cast("double"), low + high, accuracy).alias(f"c{i}")
                for i, c in enumerate(columns)
            ]
        ).alias("ends")
    )
    return ends.scalar()


def _counted_values(
    df: DataFrame, columns: Sequence[str], ends: Column, probabilities: Sequence[float]
) -> DataFrame:
    """(metric, bin, inside, value, rows): inside a bracket the value itself, outside the nearest
    bracket end below it, NULL when there is none. Bins cut the brackets evenly and follow the order of
    the values."""
    k = len(probabilities)
    entries = ", ".join(
        f"struct('{i}' AS metric, double({quoted(c)}) AS value, _ends.c{i} AS ends)"
        for i, c in enumerate(columns)
    )
    inside = " OR ".join(f"value BETWEEN ends[{j}] AND ends[{k + j}]" for j in range(k))
    below = ", ".join(f"CASE WHEN ends[{k + j}] < value THEN ends[{k + j}] END" for j in range(k))
    steps = " + ".join(
        f"CASE WHEN coalesce(value < ends[{j}], true) THEN 0 WHEN value >= ends[{k + j}] THEN {BINS + 1} "
        f"ELSE coalesce(width_bucket(value, ends[{j}], ends[{k + j}], {BINS}), 1) END"
        for j in range(k)
    )
    return (
        df.withColumn("_ends", ends)
        .selectExpr(f"inline(array({entries}))")
        .where("value IS NOT NULL")
        .withColumn("inside", F.expr(inside))
        .selectExpr(
            "metric",
            "inside",
            "ends",
            f"CASE WHEN inside THEN value ELSE greatest(double(NULL), {below}) END AS value",
        )
        .withColumn("bin", F.expr(steps))
        .groupBy("metric", "bin", "inside", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _hit(probability: float, size: str = "rows") -> str:
    # Decimal arithmetic: 0.2 * 35 must be 7, not a hair above it.
    wanted = f"greatest(ceil({probability!r}BD * total), 1)"
    return f"upto >= {wanted} AND upto - {size} < {wanted}"


def _point(metric: int, index: int) -> str:
    missed = f"double(raise_error('quantile {index} of column {metric} is outside its bracket'))"
    found = f"CASE WHEN inside THEN value ELSE {missed} END"
    return f"max(CASE WHEN metric = '{metric}' AND hits[{index}] THEN {found} END)"


def quantile_score(value: str, points: str, count: int, *, descending: bool = False) -> Column:
    """Score of the SQL expression `value` by the array `points`: 1 up to the first point, and so
    on to count + 1 above the last one; reversed when `descending`. A NULL value is below no point
    and so scores like the largest value."""
    scores = range(count + 1, 0, -1) if descending else range(1, count + 2)
    *steps, last = scores
    cases = " ".join(f"WHEN double({value}) <= {points}[{i}] THEN {s}" for i, s in enumerate(steps))
    return F.expr(f"CASE {cases} ELSE {last} END")


def add_quintile_scores(
    df: DataFrame,
    scores: Mapping[str, tuple[str, bool]],
    *,
    exact: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Score columns `{name: (metric column, descending)}` from the quintiles of `df` itself.

    The metrics are computed once for the points and once to be compared with them, in one lazy
    plan; so a metric must not depend on the order of rows (`exact_sum` is the sum for doubles).
    """
    metrics = list(dict.fromkeys(metric for metric, _ in scores.values()))
    points = quantile_points(df, metrics, exact=exact, accuracy=accuracy)
    bundle = points.select(F.struct(*[col(m) for m in metrics]).alias("points")).scalar()
    held = df.withColumn("_points", bundle)
    return held.withColumns(
        {
            name: quantile_score(
                quoted(metric), f"_points.{quoted(metric)}", len(QUINTILES), descending=descending
            )
            for name, (metric, descending) in scores.items()
        }
    ).drop("_points")
