"""Mixing sources to target sizes by entropy balancing.

Each document gets a rate: how often the mix takes it. Of all rates between 0 and `most` that give
every source its target, the ones closest to 1 in relative entropy are wanted. They have the form
min(most, exp(lambda * size / mean size)) with one lambda per source, the root of the source's
constraint in the convex dual. Newton's method finds it: each iteration is one distributed sum over
the table of (source, size, documents), since equal sizes in a source have equal rates. Sums are made
from whole numbers, so they don't depend on the order of rows and reruns agree.

Rates are then rounded to whole copies. Within a source, sizes are gone through from the largest
down; what rounding one size leaves over or owes is carried to the next, and what is left in the end is
made up by a document more or less of one or two sizes. Which documents of a size get a copy more is decided
by a hash of the id, counted in small hash groups.

Cases: null texts and texts without words have size 0 and are taken 0 times; null is a source of its
own, last in order. Repeated rows count each, ties in the hash are broken by the id. An empty table
gives no rows. Only id, text and source are read by `sizes`; `mix` keeps no other columns.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, same, stored

#: Rates are rounded to this share of a copy, for exact sums.
STEPS = 1 << 30
#: Documents of one size counted together, about.
GROUP_ROWS = 2_000
#: Newton iterations at most; the bracket halves where a step leaves it. Sources that aren't balanced by then are
#: reported by a warning.
MOST_ROUNDS = 60
log = logging.getLogger(__name__)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`id`, `source` and `size` in words."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size")
    )


def targets(
    source_sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> dict[str | None, float]:
    """Target per source: `share` of all sizes by weight (the weights repeat over the sources in
    order, null last); none above `most` times its size, what that leaves is shared again."""
    order = sorted((s for s in source_sizes if s is not None)) + ([None] if None in source_sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(source_sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * source_sizes[s]]
        if not full:
            return out | {s: float(left * weight[s] / total) for s in open_}
        for s in full:
            out[s] = float(most * source_sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _rate(state: DataFrame, most: float) -> DataFrame:
    """`state` with the tilted rate of its rows, in STEPS."""
    tilt = F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(math.log(most))))
    steps = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(F.least(tilt, F.lit(float(most))))
    return state.withColumn("rate", F.round(steps * STEPS).cast("long"))


def balance(counts: DataFrame, goal: dict[str | None, tuple[int, float, float]], most: float) -> dict[str | None, float]:
    """lambda per source. `counts`: source, size, n; `goal`: size, target and mean size per source.

    One number per source goes between driver and cluster: sources are few, whatever the rows.
    """
    spark = counts.sparkSession
    found = {s: 0.0 for s in goal}
    low: dict[str | None, float] = dict.fromkeys(goal, -math.inf)
    high: dict[str | None, float] = dict.fromkeys(goal, math.inf)
    open_ = {s for s, (size, target, _) in goal.items() if 0 < target < most * size}
    for s, (size, target, _) in goal.items():
        if size and target <= 0:
            found[s] = -1e6
    for _ in range(MOST_ROUNDS):
        if not open_:
            break
        rows = [(s, found[s], *map(float, goal[s])) for s in sorted(open_, key=lambda s: (s is None, s or ""))]
        now = spark.createDataFrame(rows, "source string, lambda double, source_size double, target double, mean double")
        now = now.withColumnRenamed("source", "its_source")
        state = counts.join(F.broadcast(now), same(F.col("source"), F.col("its_source")))
        weight = (F.col("size") * F.col("n")).cast("decimal(20,0)")
        steep = F.when(F.col("rate") < int(most * STEPS), F.shiftright("rate", 16)).otherwise(0)
        sums = _rate(state, most).groupBy("source").agg(
            F.sum((weight * F.col("rate").cast("decimal(12,0)")).cast("decimal(38,0)")).alias("taken"),
            F.sum((weight * (F.col("size") * steep).cast("decimal(18,0)")).cast("decimal(38,0)")).alias("slope"),
        )
        for s, taken, slope in sums.collect():
            size, target, mean = goal[s]
            miss = target - int(taken) / STEPS
            if abs(miss) <= 1e-6 * target:
                open_.discard(s)
                continue
            if miss > 0:
                low[s] = found[s]
            else:
                high[s] = found[s]
            slope = int(slope) * (1 << 16) / STEPS / mean
            step = found[s] + miss / slope if slope > 0 else math.inf
            if not low[s] < step < high[s]:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = found[s] * 2 + math.copysign(1.0, miss)
                else:
                    step = (low[s] + high[s]) / 2
            if step == found[s]:
                open_.discard(s)
            found[s] = step
    if open_:
        log.warning("not balanced after %d rounds: %s", MOST_ROUNDS, sorted(map(str, open_)))
    return found


def _closer(sizes: np.ndarray, n: np.ndarray, copies: np.ndarray, left: float, most: int) -> float:
    """Take or leave one document of one or two sizes where that brings the total closer."""
    up, down = np.flatnonzero(copies < most * n), np.flatnonzero(copies > 0)
    moves = np.concatenate([sizes[up], -sizes[down], [0]])
    which = np.concatenate([up, down, [-1]])
    order = np.argsort(moves, kind="stable")
    moves, which = moves[order], which[order]
    place = np.searchsorted(moves, left - moves)
    best = (abs(left), -1, -1)
    for shift in (-1, 0):
        other = np.clip(place + shift, 0, len(moves) - 1)
        miss = np.abs(left - moves - moves[other])
        miss[(which == which[other]) & (which >= 0)] = np.inf
        i = int(np.argmin(miss))
        best = min(best, (float(miss[i]), i, int(other[i])))
    for i in best[1:]:
        if i >= 0 and which[i] >= 0:
            copies[which[i]] += 1 if moves[i] > 0 else -1
            left -= moves[i]
    return left


def _round(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies per size of one source; as many rows as it has different sizes."""
    frame = frame[["source", "size", "n", "rate"]].sort_values("size", ascending=False)
    left, copies = 0.0, []
    for size, n, rate in zip(frame["size"], frame["n"], frame["rate"]):
        size, n = int(size), int(n)
        wanted = int(rate) * n / STEPS + left / size if size else 0
        taken = min(most * n, max(0, math.floor(wanted + 0.5)))
        left = (wanted - taken) * size if size else left
        copies.append(taken)
    out = np.array(copies, np.int64)
    some = np.flatnonzero(frame["size"].to_numpy() > 0)
    for _ in range(3):
        if abs(left) < 1 or not len(some):
            break
        part = out[some]
        left = _closer(frame["size"].to_numpy()[some], frame["n"].to_numpy()[some], part, left, most)
        out[some] = part
    return frame[["source", "size", "n"]].assign(copies=out)


def mix(
    sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """`id`, `source`, `size`, `source_size`, `target`, `copies` and `taken` of every row."""
    spark = sized.sparkSession
    sized = stored(sized, "mixing-sizes")
    counts = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
    totals = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")
    ).collect()  # one row per source
    source_sizes = {r["source"]: int(r["size"]) for r in totals}
    wanted = targets(source_sizes, weights, share, most)
    goal = {r["source"]: (int(r["size"]), wanted[r["source"]], max(1e-9, int(r["size"]) / int(r["n"]))) for r in totals}
    tilts = balance(counts, goal, most)
    rows = [(s, tilts[s], float(size), target, mean) for s, (size, target, mean) in goal.items()]
    rates = spark.createDataFrame(rows, "its_source string, lambda double, source_size double, target double, mean double")
    state = counts.join(F.broadcast(rates), same(F.col("source"), F.col("its_source")))
    rated = _rate(state, most).select("source", "size", "n", "rate")
    given = rated.groupBy("source").applyInPandas(
        lambda frame: _round(frame, most), "source string, size long, n long, copies long"
    )
    given = stored(given, "mixing-copies")

    hashed = sized.join(given.withColumnsRenamed({"source": "its_source", "size": "its_size"}),
                        same(F.col("source"), F.col("its_source")) & (F.col("size") == F.col("its_size")))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_ROWS)).cast("long")
    hashed = hashed.withColumn("hash", F.xxhash64("id", "size")).withColumn("part", F.pmod("hash", groups))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"),
                F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    place = Window.partitionBy("source", "size", "part").orderBy("hash", "id")
    ranked = hashed.withColumn("place", F.row_number().over(place)).join(
        starts, same(F.col("source"), F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))
    )
    rank = F.col("start") + F.col("place") - 1
    extra = F.when(rank < F.col("copies") % F.col("n"), 1).otherwise(0)
    copies = (F.floor(F.col("copies") / F.col("n")) + extra).cast("long")
    out = ranked.select("id", "source", "size", copies.alias("copies"))
    named = rates.select("its_source", F.col("source_size").cast("long").alias("source_size"), "target")
    return (
        out.join(F.broadcast(named), same(F.col("source"), F.col("its_source")))
        .drop("its_source")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
