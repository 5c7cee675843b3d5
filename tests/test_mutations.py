import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from millrace.operators import layout, mutations
from millrace.operators.mutations import MergeConflict

SCHEMA = "k1 int, k2 string, v int, w string"


def model(target, source, keys, update, insert_all, delete_unmatched, keep_old):
    """Merge over lists of dicts, None when it must be refused."""

    def match(t, s):
        return all(t[k] is not None and t[k] == s[k] for k in keys)

    result = []
    for t in target:
        hits = [s for s in source if match(t, s)]
        if len(hits) > 1:
            return None
        if hits:
            new = dict(t)
            for c in update:
                if not (keep_old and hits[0][c] is None):
                    new[c] = hits[0][c]
            result.append(new)
        elif not delete_unmatched:
            result.append(dict(t))
    if insert_all:
        result += [dict(s) for s in source if not any(match(t, s) for t in target)]
    return sorted((tuple(r[c] for c in ("k1", "k2", "v", "w")) for r in result), key=repr)


def random_rows(r, n, keys, unique):
    seen, out = set(), []
    for _ in range(n):
        row = {
            "k1": r.choice([None, 1, 2, 3, 4]),
            "k2": r.choice([None, "a", "b"]),
            "v": r.choice([None, *range(9)]),
            "w": r.choice([None, "x", "y"]),
        }
        key = tuple(row[k] for k in keys)
        if unique and key in seen and None not in key:
            continue
        seen.add(key)
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(16))
def test_merge_against_a_model(spark, seed):
    r = random.Random(seed)
    keys = r.choice([["k1"], ["k1", "k2"]])
    target = random_rows(r, r.randint(0, 12), keys, unique=False)
    source = random_rows(r, r.randint(0, 8), keys, unique=r.random() < 0.75)
    values = [c for c in ("k2", "v", "w") if c not in keys]
    chosen = r.choice([None, ["v"], []])
    update = chosen or values
    flags = {"insert_all": r.random() < 0.7, "delete_unmatched": r.random() < 0.4}
    keep_old = r.random() < 0.3
    frames = [
        spark.createDataFrame([tuple(x[c] for c in ("k1", "k2", "v", "w")) for x in part], SCHEMA)
        for part in (target, source)
    ]
    expected = model(target, source, keys, update, flags["insert_all"], flags["delete_unmatched"], keep_old)
    call = lambda: mutations.merge_rows(
        *frames, keys, update_columns=chosen, keep_old_when_null=keep_old, **flags
    )
    if expected is None:
        with pytest.raises(MergeConflict):
            call()
    else:
        assert rows(call()) == expected


@pytest.mark.parametrize("seed", range(16))
def test_merge_of_dealt_rows_against_a_model(spark, seed, monkeypatch):
    monkeypatch.setattr(layout, "join_tasks", lambda left, right: 3)
    test_merge_against_a_model(spark, seed)


def test_a_large_merge_has_tasks_by_its_size(spark, folder, monkeypatch):
    """Twice the rows are twice the tasks, whatever the session's number of partitions."""
    monkeypatch.setattr(layout, "BROADCAST_LIMIT_MB", 0)
    monkeypatch.setattr(layout.join_tasks, "__defaults__", (0.1,))
    shuffles = []
    for n in (40_000, 80_000):
        numbered = spark.range(n).select(F.when(F.col("id") % 4 > 0, F.xxhash64("id")).alias("k"), F.col("id").alias("v"))
        for side in ("t", "s"):
            numbered.write.parquet(f"{folder}/{side}{n}")
        sides = [spark.read.parquet(f"{folder}/{side}{n}") for side in ("t", "s")]
        merged = mutations.merge_rows(*sides, ["k"])
        found = plan(merged)
        assert "ENSURE_REQUIREMENTS" not in found
        shuffles.append(layout.join_tasks(*sides))
        assert f", {shuffles[-1]}), REPARTITION_BY_NUM" in found
        merged = merged.withColumn("task", F.spark_partition_id())
        assert (merged.count(), merged.where("k IS NULL").select("task").distinct().count()) == (n + n // 4, 2 * shuffles[-1])
    assert shuffles[0] > 4 and abs(shuffles[1] - 2 * shuffles[0]) <= 2


def test_repeated_unmatched_source_rows_all_insert(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(2, "x"), (2, "y"), (None, "n"), (None, "n")], "k int, v string")
    assert mutations.merge_rows(target, source, ["k"]).count() == 5


def test_merge_with_an_unknown_column_needs_evolve(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, 5), (2, 6)], "k int, extra int")
    with pytest.raises(ValueError, match="extra"):
        mutations.merge_rows(target, source, ["k"])
    got = mutations.merge_rows(target, source, ["k"], evolve=True)
    assert rows(got) == [(1, "a", 5), (2, None, 6)]


def test_small_source_does_not_shuffle_the_target(spark, folder):
    spark.range(50_000).select(F.col("id").alias("k"), F.lit("t").alias("v")).write.parquet(f"{folder}/t")
    spark.range(10).select(F.col("id").alias("k"), F.lit("s").alias("v")).write.parquet(f"{folder}/s")
    target, source = spark.read.parquet(f"{folder}/t"), spark.read.parquet(f"{folder}/s")
    kept = mutations.merge_rows(target, source, ["k"], insert_all=False)
    assert "Exchange hashpartitioning" not in plan(kept) and "BroadcastHashJoin" in plan(kept)
    assert mutations.merge_rows(target, source, ["k"]).count() == 50_000


def test_update_sees_old_values_and_skips_null_conditions(spark):
    df = spark.createDataFrame([(1, 10, 20), (2, 30, 40), (None, 5, 6)], "k int, a int, b int")
    got = mutations.update_where(df, "k >= 2", {"a": "b", "b": "a"})
    assert rows(got) == [(1, 10, 20), (2, 40, 30), (None, 5, 6)]
    assert got.schema["a"].dataType == df.schema["a"].dataType
    with pytest.raises(ValueError, match="zz"):
        mutations.update_where(df, "k = 1", {"zz": "1"})


def test_delete_keeps_rows_with_a_null_condition(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(mutations.delete_where(df, "k = 1")) == [(2,), (None,)]


def test_patch_reports_unknown_keys(spark):
    target = spark.createDataFrame([(1, "a", "b")], "k int, v string, w string")
    source = spark.createDataFrame([(1, None, "B"), (9, "x", "y")], "k int, v string, w string")
    assert rows(mutations.patch_rows(target, source, ["k"])) == [(1, "a", "B")]
    assert rows(mutations.unknown_keys(target, source, ["k"])) == [(9, "x", "y")]
