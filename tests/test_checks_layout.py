import logging

from conftest import plan, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import checks, layout


def test_row_rules_share_one_scan(spark, folder):
    spark.createDataFrame([(1, "a", 5), (2, None, 50), (None, "z", None)], "k int, g string, v int").write.parquet(
        f"{folder}/d"
    )
    df = spark.read.parquet(f"{folder}/d")
    rules = [
        *checks.not_null("k", "g"),
        checks.allowed("g", ["a", "b"]),
        checks.in_range("v", 0, 10),
        checks.holds("small", "k < 2"),
        checks.not_empty(),
    ]
    got = checks.run_row_rules(df, rules)
    assert plan(got).count("FileScan") == 1
    assert {r.check: (r.passed, r.observed) for r in got.collect()} == {
        "not_null:k": (False, 1),
        "not_null:g": (False, 1),
        "allowed:g": (False, 2),
        "range:v": (False, 1),
        "rule:small": (False, 2),
        "not_empty": (True, 0),
    }


def test_key_checks(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (3,)], "k int")
    assert checks.unique_key(left, ["k"]).first().observed == 1
    assert checks.no_orphans(left, dim, ["k"]).first().observed == 2
    assert checks.all_keys_kept(left.distinct(), left, ["k"]).first().passed
    assert not checks.all_keys_kept(left, left, ["k"]).first().passed
    assert checks.not_more_rows(dim, left).first().passed
    assert checks.same_total(left, left, "k", "k").first().passed


def test_summary(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tuple(checks.summary(df).first()) == (1, ["a", "b"], "ok")
    assert checks.summary(df.filter("a > 1")).first().status == "warning_empty"


def test_schema_problems():
    expected = T.StructType.fromDDL("a int, b string")

    class Frame:
        schema = T.StructType.fromDDL("a bigint, c int")

    assert checks.schema_problems(Frame, expected) == [
        "missing column b",
        "column a is bigint, expected int",
        "unexpected column c",
    ]
    assert len(checks.schema_problems(Frame, expected, strict=False)) == 2


def test_same_rows_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "i int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, i int")
    assert checks.same_rows(a, a.select("s", "i")) and not checks.same_rows(a, b)


def test_story_rules(spark):
    schema = (
        "n int, id string, title string, description string, acceptance_criteria array<string>,"
        " tags array<string>, data_classification string"
    )
    good = ("a-1.b_c", "t", "d", ["x"], ["tag"], "public")
    cases = [
        good,
        ("bad id", *good[1:]),
        ("line\n", *good[1:]),
        (good[0], "", *good[2:]),
        (good[0], "t" * 256, *good[2:]),
        (good[0], "t" * 257, *good[2:]),
        (*good[:2], None, *good[3:]),
        (*good[:3], ["c"] * 21, *good[4:]),
        (*good[:3], ["c" * 501], *good[4:]),
        (*good[:4], ["t" * 51], "public"),
        (*good[:5], "secret"),
        (*good[:3], None, None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], schema)
    got = {r.n: r.rule for r in checks.violations(df, checks.story_rules(), ["n"]).collect()}
    assert got == {
        1: "id",
        2: "id",
        3: "title",
        5: "title",
        6: "description",
        7: "acceptance_criteria",
        8: "acceptance_criteria",
        9: "tags",
        10: "data_classification",
    }


def test_file_count_and_repartition(spark, folder):
    spark.range(200_000).write.parquet(f"{folder}/d")
    df = spark.read.parquet(f"{folder}/d")
    size = layout.estimated_bytes(df)
    assert layout.file_count(df, size / layout.MEGABYTE / 3.5) == 4
    assert layout.file_count(df) == 1
    assert "Exchange RoundRobinPartitioning(4)" in plan(
        layout.repartition_for_write(df, size / layout.MEGABYTE / 3.5)
    )
    by_column = plan(layout.repartition_for_write(df, partition_by=["id"]))
    assert "REBALANCE_PARTITIONS_BY_COL" in by_column


def test_rebalance_splits_a_hot_partition_value(spark, folder):
    df = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400KB")
    try:
        sized = layout.repartition_for_write(df.repartition(8), partition_by=["p"])
        sized.write.partitionBy("p").parquet(f"{folder}/o")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(f"{folder}/o").select("p", F.input_file_name().alias("f")).distinct()
    per_value = {r.p: r["count"] for r in files.groupBy("p").count().collect()}
    assert per_value[0] > 1


def test_coalesce_never_grows(spark):
    assert layout.coalesce_small_output(spark.range(10).repartition(20), 4).rdd.getNumPartitions() == 4
    assert layout.coalesce_small_output(spark.range(10).repartition(2), 4).rdd.getNumPartitions() == 2


def test_cached_block(spark, caplog):
    caplog.set_level(logging.INFO)
    df = spark.range(5)
    with layout.cached(df, "five") as held:
        assert held.count() == 5 and held.storageLevel.useMemory
    assert not df.storageLevel.useMemory
    assert "five" in caplog.text


def test_cluster_rows_cuts_a_hot_value(spark):
    df = spark.range(30_000).select(F.lit(1).alias("a"), "id")
    size = layout.estimated_bytes(df) / layout.MEGABYTE
    sizes = layout.cluster_rows(df, ["a"], size / 6).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) < 15_000
    assert rows(layout.cluster_rows(df.limit(50), ["a"])) == rows(df.limit(50))


def test_files_keep_their_size_at_any_scale(spark, monkeypatch):
    monkeypatch.setattr(layout, "output_bytes", lambda df: 100 * 10**12)
    assert layout.file_count(spark.range(1)) == -(-100 * 10**12 // (128 * layout.MEGABYTE))


def test_z_cells_of_ids_with_a_common_prefix(spark):
    df = spark.range(4000).select(
        F.format_string("CUST-%06d", F.col("id") * 7919 % 4000).alias("a"), F.format_string("ORD-2024-%06d", "id").alias("b")
    )
    z = layout.with_z_value(df, ["a", "b"], "z", bits=4)
    assert z.select("z").distinct().count() > 200  # of 256
    assert z.columns == ["a", "b", "z"]


def test_digest_of_rows_with_nulls_maps_and_nested_values(spark):
    schema = "a int, b string, m map<string,int>, s struct<x: int, y: array<string>>"
    base = [(None, "a", {"k": 1, "l": 2}, (1, ["x", None])), (1, None, None, None), (1, None, None, None)]
    digest = checks.digest_of(spark.createDataFrame(base, schema))
    same = [base[2], (None, "a", {"l": 2, "k": 1}, (1, ["x", None])), base[1]]
    assert checks.digest_of(spark.createDataFrame(same, schema).repartition(3)) == digest
    for other in (
        base[:2], base + base[1:2], [(None, "a", {"k": 1, "l": 2}, (1, ["x", ""])), *base[1:]], [base[0], base[1], (None, "1", None, None)],
        [(None, "a", {"k": 2, "l": 1}, (1, ["x", None])), *base[1:]],
    ):
        assert checks.digest_of(spark.createDataFrame(other, schema)) != digest
    assert checks.digest_of(spark.createDataFrame([], schema)) == (0, 0, 0)
    a = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert checks.digest_of(a.limit(1)) != checks.digest_of(a.select(F.col("b").alias("a"), F.col("a").alias("b")).limit(1))


def test_a_rerun_is_computed_once_and_finds_a_planted_change(spark, folder):
    from millrace.plans.runner import run
    from millrace.plans.spec import job_of

    spark.range(1000).select((F.col("id") % 10).alias("k")).write.parquet(f"{folder}/in")
    job = {"source": f"{folder}/in", "target": f"{folder}/out", "transformations": [], "rules": [{"check": "rerun"}]}
    assert run(spark, job_of(job))["status"] == "success"
    job["transformations"] = [{"operation": "enrich", "column": "r", "value": "IF(k = 3 AND rand() < 0.5, 1, 0)"}]
    report = run(spark, job_of(job))
    assert report["status"] == "checks_failed" and report["checks"][-1] == {"check": "rerun", "passed": False, "observed": 1}
    scan = checks.multiset_digest(spark.read.parquet(f"{folder}/out"))
    shown = plan(spark.read.parquet(f"{folder}/out").agg(*scan))
    assert shown.count("Exchange") == 1 and "SinglePartition" in shown  # partial sums only


def test_partitioned_writes_are_rebalanced(spark, folder):
    from millrace.sources import files
    from millrace.sources.files import Dataset

    df = spark.range(0, 8000, 1, 8).select("id", (F.col("id") % 5).alias("k"))
    files.write(df, Dataset(path=f"{folder}/t", partition_by=("k",)))
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/t").count()
    assert written == 5 and spark.read.parquet(f"{folder}/t").count() == 8000


def test_distinct_bitmaps_of_any_key(spark):
    from millrace.operators import distinct

    pairs = [("a", "x", k) for k in ("1", "2", None, "2")] + [("a", "y", "2"), ("b", None, "1"), ("b", "z", None), (None, "x", "9")]
    df = spark.createDataFrame(pairs, "g string, h string, k string")
    fine = distinct.group_bitmaps(df, ["g", "h"], "k")
    count = lambda names: {tuple(r)[:-1]: r[-1] for r in distinct.counted(fine, names).collect()}
    assert count(["g", "h"]) == {("a", "x"): 2, ("a", "y"): 1, ("b", None): 1, (None, "x"): 1}
    assert count(["g"]) == {("a",): 2, ("b",): 1, (None,): 1} and count([]) == {(): 3}
    assert distinct.counted(distinct.group_bitmaps(df.limit(0), ["g"], "k"), []).collect()[0][0] == 0
    many = spark.range(100_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40_000 + 1).alias("k"))
    numbers = distinct.key_bitmaps(many, ["g"], "k")
    assert numbers.count() == 6 and distinct.counted(numbers, []).first()[0] == 40_000


def test_exploded_rows_are_not_taken_for_small(spark):
    one = spark.range(3).select(F.col("id").alias("k"), F.col("id").cast("int").alias("n"))
    hinted = lambda df: "ResolvedHint" in layout.broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert hinted(one) and hinted(one.groupBy("k").count())
    assert not hinted(one.select("k", F.explode(F.sequence(F.lit(1), F.col("n") * 1_000_000))))
    assert not hinted(one.select("k", F.explode(F.sequence(F.lit(1), F.col("n")))).groupBy("k").count())
