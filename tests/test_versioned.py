import time

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from millrace.sources import files, versioned
from millrace.sources.files import Dataset


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "k int, g string, v double")


def test_versions_history_and_time_travel(spark, folder, frame):
    path = f"{folder}/t"
    assert not versioned.exists(spark, path)
    assert versioned.write(frame, path, mode="create", partition_by=["g"]) == 0
    assert versioned.update(spark, path, "g = 'a'", {"v": "v * 2"}) == 1
    assert versioned.delete(spark, path, "g = 'b'") == 2
    assert versioned.write(frame, path, mode="append") == 3
    assert rows(versioned.read(spark, path, 0)) == rows(frame)
    assert rows(versioned.read(spark, path, 1)) == [(1, "a", 20.0), (2, "b", 20.0)]
    assert rows(versioned.read(spark, path, 2)) == [(1, "a", 20.0)]
    assert rows(versioned.read(spark, path)) == [(1, "a", 10.0), (1, "a", 20.0), (2, "b", 20.0)]
    log = versioned.history(spark, path, limit=2).collect()
    assert [(r.version, r.operation) for r in log] == [(3, "APPEND"), (2, "DELETE")]
    assert versioned.full_history(spark, path).count() == 4
    with pytest.raises(ValueError, match="no version 9"):
        versioned.read(spark, path, 9)
    with pytest.raises(ValueError, match="exists already"):
        versioned.write(frame, path, mode="create")


def test_append_writes_only_the_new_rows(spark, folder, frame):
    path = f"{folder}/t"
    versioned.write(frame, path)
    versioned.write(frame.limit(1), path, mode="append")
    last = versioned.version_row(spark, path)
    assert (list(last.parts), last.written_rows) == (["0", "1"], 1)


def test_partition_values_keep_their_type(spark, folder):
    df = spark.createDataFrame([("01", 1), ("2", 2), (None, 3)], "code string, v int")
    versioned.write(df, f"{folder}/t", partition_by=["code"])
    back = versioned.read(spark, f"{folder}/t")
    assert back.schema["code"].dataType.simpleString() == "string"
    assert rows(back) == rows(df)


def test_schema_evolution_and_overwrite_schema(spark, folder, frame):
    path = f"{folder}/t"
    versioned.write(frame, path)
    wider = spark.createDataFrame([("3", "c", True)], "k string, g string, flag boolean")
    versioned.write(wider, path, mode="append")
    assert rows(versioned.read(spark, path)) == [
        (1, "a", 10.0, None),
        (2, "b", 20.0, None),
        (3, "c", None, True),
    ]
    versioned.write(wider, path)
    assert versioned.read(spark, path).columns == ["k", "g", "v", "flag"]
    versioned.write(wider, path, overwrite_schema=True)
    back = versioned.read(spark, path)
    assert back.columns == ["k", "g", "flag"] and back.schema["k"].dataType.simpleString() == "string"


def test_merge_first_write_then_merge(spark, folder, frame):
    path = f"{folder}/t"
    first = versioned.merge(frame, path, ["k"])
    assert first == {"action": "initial_write", "rows": 2, "version": 0}
    changed = spark.createDataFrame([(2, "B", 0.5), (3, "c", 1.5)], "k int, g string, v double")
    second = versioned.merge(changed, path, ["k"], update_columns=[])
    assert second["action"] == "merge" and second["update_columns"] == ["g", "v"]
    assert rows(versioned.read(spark, path)) == [(1, "a", 10.0), (2, "B", 0.5), (3, "c", 1.5)]


def test_a_write_without_history_is_not_a_version(spark, folder, frame):
    path = f"{folder}/t"
    versioned.write(frame, path)
    frame.write.parquet(f"{path}/data/{versioned.PART}=1")  # a job that died before its commit
    assert rows(versioned.read(spark, path)) == rows(frame)
    assert versioned.delete(spark, path, "k = 1") == 1
    assert rows(versioned.read(spark, path)) == [(2, "b", 20.0)]


def _parts(spark, path):
    return list(versioned.version_row(spark, path).parts)


def test_discovery_looks_at_every_row(spark, folder):
    """One value in the last line decides, however long the file is; nulls and empty files don't."""
    from millrace.sources.schema import discover_schema, discover_tables

    lines = [f"{i},{i},{i}.5,2024-01-0{i % 9 + 1},true,,{i}" for i in range(20_000)]
    odd = ["7,9999999999,N/A,2024-01-01 10:00:00,False,,123456789012345678901234567890", ",,,,,,"]
    spark.createDataFrame([("a,b,c,d,e,f,g",), *((x,) for x in lines + odd)], "v string").coalesce(1).write.text(f"{folder}/r/t/x")
    spark.createDataFrame([], "v string").coalesce(1).write.text(f"{folder}/r/t/empty")
    spark.createDataFrame([("h,i",)], "v string").coalesce(1).write.text(f"{folder}/r/only_header")
    got = {r.name: [tuple(c) for c in r["columns"]] for r in discover_tables(spark, f"{folder}/r", glob="*.txt").collect()}
    kinds = "int bigint string timestamp boolean string decimal(38,0)".split()
    assert got == {"t": list(zip("abcdefg", kinds)), "only_header": [("h", "string"), ("i", "string")]}
    schema = discover_schema(spark, f"{folder}/r/t/x")
    assert [f.dataType.simpleString() for f in schema.fields] == kinds
    back = spark.read.schema(schema).option("header", True).csv(f"{folder}/r/t/x")
    text = spark.read.option("header", True).csv(f"{folder}/r/t/x")
    assert back.agg(*[F.count(c) for c in "abcdefg"]).collect() == text.agg(*[F.count(c) for c in "abcdefg"]).collect()


def test_types_hold_for_parts_together(spark):
    from millrace.sources.schema import narrowest_type, ruled_out

    parts = [["1", None, "-5"], ["2.5", "1e3"], ["2024-02-30"], ["12:30"], [" 7"]]
    found = []
    for part in parts:
        df = spark.createDataFrame([(v,) for v in part], "v string")
        found.append(df.select(ruled_out(df).alias("c")).first().c[0])
    assert [narrowest_type(f) for f in found] == ["int", "double", "string", "string", "double"]
    assert narrowest_type(found[0] | found[1]) == "double" and narrowest_type(None) == "string"


DECLARED = [
    {"name": "id", "type": "LongType", "nullable": False}, {"name": "name", "type": "StringType", "nullable": False},
    {"name": "total", "type": "decimal(18,2)"}, {"name": "day", "type": "DateType"},
]
RECORDS = [
    ("1,a,5.00,2024-01-01", None), ("2,b", "malformed"), ("3,,5.00,2024-01-01", "missing:name"), ("4,d,n/a,2024-01-01", "malformed"),
    ("5,e,1,2024-01-01,more", "malformed"), ("x,f,1,2024-01-01", "malformed"), ("6,g,1,2024-13-01", "malformed"), (",,1,", "missing:id,name"),
    ("7,h,,", None),
]


def test_bad_csv_records_are_set_aside(spark, folder):
    spark.createDataFrame([(t,) for t, _ in RECORDS], "v string").coalesce(2).write.text(f"{folder}/in")
    source = Dataset(path=f"{folder}/in", format="csv", schema=DECLARED, options={"header": "false"}, quarantine=f"{folder}/bad")
    judged = files.read_judged(spark, source)
    assert sorted((r["_reason"] or "") for r in judged.collect()) == sorted(w or "" for _, w in RECORDS)
    assert files.read(spark, source).count() == 2  # also where no column is asked for
    assert [r.id for r in files.read(spark, source).select("id").orderBy("id").collect()] == [1, 7]
    bad = {r.record: r.reason for r in files.rejected(judged).collect()}
    assert {t: w for t, w in RECORDS if w == "malformed"}.items() <= bad.items() and len(bad) == 7
    good, n = files.read_and_quarantine(spark, source)
    assert (good.count(), n, spark.read.parquet(f"{folder}/bad").count()) == (2, 7, 7)
    assert all("/in/part-" in r.file for r in spark.read.parquet(f"{folder}/bad").collect())
    files.read_and_quarantine(spark, source)  # again: replaced, not doubled
    assert spark.read.parquet(f"{folder}/bad").count() == 7


def test_bad_json_records_are_set_aside(spark, folder):
    lines = ['{"id": 1, "name": "a", "total": 5}', '{"id": "x", "name": "b"}', "{broken", '{"name": "c"}', '{"id": 2, "name": "d", "extra": 1}']
    spark.createDataFrame([(t,) for t in lines], "v string").write.text(f"{folder}/in")
    judged = files.read_judged(spark, Dataset(path=f"{folder}/in", format="json", schema=DECLARED))
    found = {r["id"]: r["_reason"] for r in judged.where("_reason IS NULL OR _reason LIKE 'missing%'").collect()}
    assert found == {1: None, 2: None, None: "missing:id"}
    assert {r.record for r in files.rejected(judged).collect() if r.reason == "malformed"} == {lines[1], "{broken"}


def test_a_job_quarantines_and_reports(spark, folder):
    from millrace.plans.runner import build, run
    from millrace.plans.spec import job_of

    spark.createDataFrame([(t,) for t, _ in RECORDS], "v string").write.text(f"{folder}/in")
    source = {"path": f"{folder}/in", "format": "csv", "schema": DECLARED, "options": {"header": "false"}, "quarantine": f"{folder}/bad"}
    job = job_of({"source": source, "target": f"{folder}/out", "transformations": [{"operation": "filter", "params": {"condition": "id > 0"}}]})
    assert build(spark, job).count() == 2
    report = run(spark, job)
    assert (report["quarantined"], report["validation"]["row_count"]) == (7, 2)
    assert spark.read.parquet(f"{folder}/bad").count() == 7 and spark.read.parquet(f"{folder}/out").count() == 2


def test_a_quarantine_needs_a_schema():
    with pytest.raises(ValueError):
        Dataset(path="/x", format="csv", quarantine="/q")


def test_changes_rewrite_only_the_parts_they_touch(spark, folder):
    path = f"{folder}/t"
    for day in range(3):
        df = spark.range(10 * day, 10 * day + 10).select("id", F.lit(day).alias("day"), F.lit("x").alias("v"))
        versioned.write(df, path, mode="append" if day else "create", partition_by=[] if day else ["day"])
    assert _parts(spark, path) == ["0/day=0", "1/day=1", "2/day=2"]
    versioned.update(spark, path, "day = 1", {"v": "'y'"})
    assert _parts(spark, path) == ["0/day=0", "2/day=2", "3/day=1"] and versioned.version_row(spark, path).written_rows == 10
    versioned.delete(spark, path, "id < 0")
    assert _parts(spark, path) == ["0/day=0", "2/day=2", "3/day=1"]
    versioned.delete(spark, path, "id = 25")
    assert _parts(spark, path) == ["0/day=0", "3/day=1", "5/day=2"]
    source = spark.createDataFrame([(3, 0, "m"), (99, 9, "n")], "id long, day int, v string")
    versioned.merge(source, path, ["id"])
    assert _parts(spark, path) == ["3/day=1", "5/day=2", "6/day=0", "6/day=9"]
    versioned.merge(source.filter("id = 99").withColumn("id", F.lit(100).cast("long")), path, ["id"])
    assert _parts(spark, path) == ["3/day=1", "5/day=2", "6/day=0", "6/day=9", "7/day=9"]
    versioned.merge(source.withColumn("id", -F.col("id")), path, ["id"], insert_all=False)
    assert _parts(spark, path) == ["3/day=1", "5/day=2", "6/day=0", "6/day=9", "7/day=9"]
    got = {r.id: (r.day, r.v) for r in versioned.read(spark, path).collect()}
    assert len(got) == 31 and got[3] == (0, "m") and got[15] == (1, "y") and got[100] == (9, "n")
    versioned.merge(source, path, ["id"], delete_unmatched=True)
    assert rows(versioned.read(spark, path)) == rows(source)
    versioned.delete(spark, path, "true")
    assert versioned.read(spark, path).count() == 0


def test_a_value_that_does_not_fit_is_refused(spark, folder, frame):
    path = f"{folder}/t"
    versioned.write(frame, path)
    bad = spark.createDataFrame([("x", "c", 1.0)], "k string, g string, v double")
    with pytest.raises(Exception, match="cannot store x"):
        versioned.write(bad, path, mode="append")
    assert rows(versioned.read(spark, path)) == rows(frame)
    with pytest.raises(ValueError, match="partitioned by"):
        versioned.write(frame, path, mode="append", partition_by=["g"])


def test_compact_keeps_rows_and_orders_files(spark, folder):
    path = f"{folder}/t"
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("a"),
        F.concat(F.lit("s"), F.col("id") % 17).alias("b"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("d"),
    )
    versioned.write(df.repartition(16), path)
    versioned.compact(spark, path, ["a"], target_mb=0.01)
    single = versioned.read(spark, path)
    spans = (
        single.groupBy(F.input_file_name().alias("f"))
        .agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
        .orderBy("lo")
        .collect()
    )
    assert len(spans) > 1 and all(x.hi <= y.lo for x, y in zip(spans, spans[1:]))
    versioned.compact(spark, path, ["a", "b", "d"], target_mb=0.01)
    assert rows(versioned.read(spark, path)) == rows(df)


def test_z_order_narrows_every_column(spark, folder):
    path = f"{folder}/t"
    df = spark.range(40_000).select(
        (F.col("id") * 7919 % 40_009).alias("a"), (F.col("id") * 104_729 % 39_989).alias("b")
    )
    versioned.write(df.repartition(4), path)
    versioned.compact(spark, path, ["a", "b"], target_mb=0.02)
    spans = (
        versioned.read(spark, path)
        .groupBy(F.input_file_name())
        .agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("a", "b")])
        .collect()
    )
    assert len(spans) >= 8
    for c in ("a", "b"):
        assert sum(r[c] for r in spans) / len(spans) < 40_000 * 0.75


def test_vacuum_keeps_the_latest_and_recent(spark, folder, frame):
    path = f"{folder}/t"
    versioned.write(frame, path)
    versioned.delete(spark, path, "k = 1")
    versioned.write(frame, path, mode="append")
    assert versioned.vacuum(spark, path) == []
    assert versioned.vacuum(spark, path, retention_hours=0) == ["0"]
    assert rows(versioned.read(spark, path, 0)) == rows(frame)  # only a dry run
    assert versioned.vacuum(spark, path, retention_hours=0, dry_run=False) == ["0"]
    assert versioned.read(spark, path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        versioned.read(spark, path, 0).collect()


@pytest.mark.parametrize("fmt", files.WRITE_FORMATS)
def test_every_format_round_trips(spark, folder, fmt):
    df = spark.createDataFrame(
        [(1, 'say "hi", ok; done', 1.5, True), (2, "line\tend", None, None), (3, None, -0.25, False)],
        "i int, s string, d double, b boolean",
    )
    target = Dataset(path=f"{folder}/x", format=fmt)
    files.write(df, target)
    back = files.read(spark, Dataset(path=f"{folder}/x", format=fmt, schema=df.schema))
    assert rows(back.select(*df.columns)) == rows(df)


def test_partitioned_reads_skip_folders_and_columns(spark, folder):
    df = spark.range(100).select(
        "id", (F.col("id") % 4).cast("int").alias("year"), F.lit("x").alias("pad")
    )
    files.write(df, Dataset(path=f"{folder}/p", partition_by=("year",)))
    versioned.write(df, f"{folder}/v", partition_by=["year"])
    for back in (files.read(spark, Dataset(path=f"{folder}/p")), versioned.read(spark, f"{folder}/v")):
        wanted = back.filter("year = 2 AND id > 50").select("id")
        text = plan(wanted)
        assert "PartitionFilters: [isnotnull(year" in text and "GreaterThan(id,50)" in text
        assert "ReadSchema: struct<id:bigint>" in text
        assert wanted.count() == 12


def test_modes_and_formats_are_checked(spark, folder, frame):
    with pytest.raises(ValueError, match="unknown format"):
        Dataset(path="/x", format="xml")
    with pytest.raises(ValueError, match="unknown write mode"):
        Dataset(path="/x", mode="replace")
    with pytest.raises(ValueError, match="versioned table"):
        files.write(frame, Dataset(path=f"{folder}/x", mode="merge"))
    files.write(frame, Dataset(path=f"{folder}/x", mode="create"))
    with pytest.raises(Exception, match="already exists"):
        files.write(frame, Dataset(path=f"{folder}/x", mode="create"))


def test_schema_on_read_and_options(spark, folder):
    with open(f"{folder}/a.csv", "w", encoding="utf-8") as handle:
        handle.write("id|when|total\n1|2024-01-05|1.50\n2|bad|x\n")
    declared = [
        {"name": "id", "type": "LongType", "nullable": False},
        {"name": "when", "type": "DateType"},
        {"name": "total", "type": "decimal(18,4)"},
    ]
    df = files.read(
        spark, Dataset(path=f"{folder}/a.csv", format="csv", options={"delimiter": "|"}, schema=declared)
    )
    assert df.schema.simpleString() == "struct<id:bigint,when:date,total:decimal(18,4)>"
    got = df.orderBy("id").collect()
    assert str(got[0].total) == "1.5000" and (got[1].when, got[1].total) == (None, None)


def test_discovery_of_folders(spark, folder):
    spark.createDataFrame([(1, "a")], "id int, name string").write.option("header", True).csv(f"{folder}/r/one")
    for year in (1, 2):
        spark.createDataFrame([(1.5,)], "x double").write.option("header", True).csv(f"{folder}/r/two/one/y={year}")
    from millrace.sources.schema import discover_tables

    got = {r.name: [tuple(c) for c in r["columns"]] for r in discover_tables(spark, f"{folder}/r").collect()}
    assert got == {"one": [("id", "int"), ("name", "string")], "two": [("x", "double")]}


def test_discovery_looks_at_every_row(spark, folder):
    """One value in the last line decides, however long the file is; nulls and empty files don't."""
    from millrace.sources.schema import discover_schema, discover_tables

    lines = [f"{i},{i},{i}.5,2024-01-0{i % 9 + 1},true,,{i}" for i in range(20_000)]
    odd = ["7,9999999999,N/A,2024-01-01 10:00:00,False,,123456789012345678901234567890", ",,,,,,"]
    spark.createDataFrame([("a,b,c,d,e,f,g",), *((x,) for x in lines + odd)], "v string").coalesce(1).write.text(f"{folder}/r/t/x")
    spark.createDataFrame([], "v string").coalesce(1).write.text(f"{folder}/r/t/empty")
    spark.createDataFrame([("h,i",)], "v string").coalesce(1).write.text(f"{folder}/r/only_header")
    got = {r.name: [tuple(c) for c in r["columns"]] for r in discover_tables(spark, f"{folder}/r", glob="*.txt").collect()}
    kinds = "int bigint string timestamp boolean string decimal(38,0)".split()
    assert got == {"t": list(zip("abcdefg", kinds)), "only_header": [("h", "string"), ("i", "string")]}
    schema = discover_schema(spark, f"{folder}/r/t/x")
    assert [f.dataType.simpleString() for f in schema.fields] == kinds
    back = spark.read.schema(schema).option("header", True).csv(f"{folder}/r/t/x")
    text = spark.read.option("header", True).csv(f"{folder}/r/t/x")
    assert back.agg(*[F.count(c) for c in "abcdefg"]).collect() == text.agg(*[F.count(c) for c in "abcdefg"]).collect()


def test_types_hold_for_parts_together(spark):
    from millrace.sources.schema import narrowest_type, ruled_out

    parts = [["1", None, "-5"], ["2.5", "1e3"], ["2024-02-30"], ["12:30"], [" 7"]]
    found = []
    for part in parts:
        df = spark.createDataFrame([(v,) for v in part], "v string")
        found.append(df.select(ruled_out(df).alias("c")).first().c[0])
    assert [narrowest_type(f) for f in found] == ["int", "double", "string", "string", "double"]
    assert narrowest_type(found[0] | found[1]) == "double" and narrowest_type(None) == "string"


DECLARED = [
    {"name": "id", "type": "LongType", "nullable": False}, {"name": "name", "type": "StringType", "nullable": False},
    {"name": "total", "type": "decimal(18,2)"}, {"name": "day", "type": "DateType"},
]
RECORDS = [
    ("1,a,5.00,2024-01-01", None), ("2,b", "malformed"), ("3,,5.00,2024-01-01", "missing:name"), ("4,d,n/a,2024-01-01", "malformed"),
    ("5,e,1,2024-01-01,more", "malformed"), ("x,f,1,2024-01-01", "malformed"), ("6,g,1,2024-13-01", "malformed"), (",,1,", "missing:id,name"),
    ("7,h,,", None),
]


def test_bad_csv_records_are_set_aside(spark, folder):
    spark.createDataFrame([(t,) for t, _ in RECORDS], "v string").coalesce(2).write.text(f"{folder}/in")
    source = Dataset(path=f"{folder}/in", format="csv", schema=DECLARED, options={"header": "false"}, quarantine=f"{folder}/bad")
    judged = files.read_judged(spark, source)
    assert sorted((r["_reason"] or "") for r in judged.collect()) == sorted(w or "" for _, w in RECORDS)
    assert files.read(spark, source).count() == 2  # also where no column is asked for
    assert [r.id for r in files.read(spark, source).select("id").orderBy("id").collect()] == [1, 7]
    bad = {r.record: r.reason for r in files.rejected(judged).collect()}
    assert {t: w for t, w in RECORDS if w == "malformed"}.items() <= bad.items() and len(bad) == 7
    good, n = files.read_and_quarantine(spark, source)
    assert (good.count(), n, spark.read.parquet(f"{folder}/bad").count()) == (2, 7, 7)
    assert all("/in/part-" in r.file for r in spark.read.parquet(f"{folder}/bad").collect())
    files.read_and_quarantine(spark, source)  # again: replaced, not doubled
    assert spark.read.parquet(f"{folder}/bad").count() == 7


def test_bad_json_records_are_set_aside(spark, folder):
    lines = ['{"id": 1, "name": "a", "total": 5}', '{"id": "x", "name": "b"}', "{broken", '{"name": "c"}', '{"id": 2, "name": "d", "extra": 1}']
    spark.createDataFrame([(t,) for t in lines], "v string").write.text(f"{folder}/in")
    judged = files.read_judged(spark, Dataset(path=f"{folder}/in", format="json", schema=DECLARED))
    found = {r["id"]: r["_reason"] for r in judged.where("_reason IS NULL OR _reason LIKE 'missing%'").collect()}
    assert found == {1: None, 2: None, None: "missing:id"}
    assert {r.record for r in files.rejected(judged).collect() if r.reason == "malformed"} == {lines[1], "{broken"}


def test_a_job_quarantines_and_reports(spark, folder):
    from millrace.plans.runner import build, run
    from millrace.plans.spec import job_of

    spark.createDataFrame([(t,) for t, _ in RECORDS], "v string").write.text(f"{folder}/in")
    source = {"path": f"{folder}/in", "format": "csv", "schema": DECLARED, "options": {"header": "false"}, "quarantine": f"{folder}/bad"}
    job = job_of({"source": source, "target": f"{folder}/out", "transformations": [{"operation": "filter", "params": {"condition": "id > 0"}}]})
    assert build(spark, job).count() == 2
    report = run(spark, job)
    assert (report["quarantined"], report["validation"]["row_count"]) == (7, 2)
    assert spark.read.parquet(f"{folder}/bad").count() == 7 and spark.read.parquet(f"{folder}/out").count() == 2


def test_a_quarantine_needs_a_schema():
    with pytest.raises(ValueError):
        Dataset(path="/x", format="csv", quarantine="/q")


def test_changes_rewrite_only_the_folders_they_touch(spark, folder):
    path = f"{folder}/t"
    df = spark.range(4000).select("id", (F.col("id") % 8).cast("string").alias("k"), F.lit(0).alias("v"))
    versioned.write(df.repartition(8), path, partition_by=["k"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/data")
    assert files.count() == 8  # one file per value, not one per task and value
    versioned.update(spark, path, "id = 11", {"v": "1"})
    assert versioned.version_row(spark, path).written_rows == 500
    versioned.delete(spark, path, "k = '5' AND id > 2000")
    assert versioned.version_row(spark, path).written_rows == 250
    source = spark.createDataFrame([(3, "3", 7), (9999, "new/=%", 7)], "id long, k string, v int")
    versioned.merge(source, path, ["id"])
    assert versioned.version_row(spark, path).written_rows == 501
    got = {r.id: (r.k, r.v) for r in versioned.read(spark, path).collect()}
    wanted = {i: (str(i % 8), 0) for i in range(4000) if not (i % 8 == 5 and i > 2000)}
    assert got == wanted | {11: ("3", 1), 3: ("3", 7), 9999: ("new/=%", 7)}
    versioned.delete(spark, path, "id = 9999")
    assert versioned.read(spark, path).count() == len(wanted)
    assert versioned.read(spark, path, 0).count() == 4000


def test_vacuum_counts_from_when_a_version_was_replaced(spark, folder):
    path = f"{folder}/t"
    versioned.write(spark.range(5), path)
    time.sleep(3)
    versioned.write(spark.range(6), path)
    assert versioned.vacuum(spark, path, retention_hours=2.5 / 3600) == []  # old, but just replaced
    assert versioned.read(spark, path, 0).count() == 5


def test_stored_copies_go_with_their_block(spark, frame):
    import os

    from millrace.sources.shared import cut_lineage, fresh_path, temporary_copies

    kept = fresh_path(spark, "kept")
    frame.write.parquet(kept)
    with temporary_copies(spark):
        copy = cut_lineage(frame, "copy")
        with temporary_copies(spark):
            inner = fresh_path(spark, "inner")
            frame.write.parquet(inner)
        assert rows(copy) == rows(frame)
        path = copy.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and not os.path.exists(inner)
    assert not os.path.exists(path) and os.path.exists(kept)


def test_a_change_rewrites_one_bucket(spark, folder):
    path, n = f"{folder}/t", 1_000_000
    df = spark.range(n).select("id", (F.col("id") % 1000).alias("v"), F.lit("x").alias("s"))
    versioned.write(df, path, bucket_by=["id"], buckets=64)
    assert len(versioned.version_of(spark, path).parts) == 64
    versioned.update(spark, path, "id = 123456", {"v": "-1"})
    one = versioned.version_row(spark, path).written_rows
    assert 0 < one < 1.2 * n / 64
    few = spark.createDataFrame([(7, -7, "y"), (-5, -5, "new"), (None, 0, "null")], "id int, v long, s string")
    versioned.merge(few, path, ["id"])  # keys of another type than the table's
    assert versioned.version_row(spark, path).written_rows < 3.5 * n / 64
    versioned.delete(spark, path, "id = 999999")
    assert versioned.version_row(spark, path).written_rows < 1.2 * n / 64
    versioned.write(few.select(F.lit(8_000_000).alias("id"), "v", "s").limit(1), path, mode="append")
    versioned.merge(df.where("id % 1000 = 3").withColumn("v", F.lit(9)), path, ["id"])  # many keys
    got = versioned.read(spark, path)
    assert got.count() == n + 2 and got.columns == ["id", "v", "s"]
    assert got.where("v = 9 AND id % 1000 = 3").count() == 1000
    assert {r.id for r in got.where("v < 0 OR s <> 'x'").collect()} == {-5, None, 123456, 7, 8_000_000}


def test_bucketed_and_partitioned(spark, folder):
    path = f"{folder}/t"
    df = spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("k"), F.lit(0).alias("v"))
    result = versioned.merge(df, path, ["id"], partition_by=["k"], buckets=4)
    assert result["action"] == "initial_write" and len(versioned.version_of(spark, path).parts) == 12
    versioned.merge(spark.createDataFrame([(5, "2", 1)], "id long, k string, v int"), path, ["id"])
    assert versioned.version_row(spark, path).written_rows < 40
    versioned.merge(spark.createDataFrame([(6, "0", 2)], "id long, k string, v int"), path, ["id"], delete_unmatched=True)
    assert rows(versioned.read(spark, path)) == [(6, "0", 2)]
    with pytest.raises(ValueError):
        versioned.write(df, path, mode="append", bucket_by=["id"], buckets=8)
    with pytest.raises(ValueError):
        versioned.write(df, f"{folder}/u", bucket_by=["id"])


def test_a_tagged_merge_is_done_once(spark, folder, frame):
    path = f"{folder}/t"
    versioned.write(frame, path)
    change = spark.createDataFrame([(1, "z", 5.0)], "k int, g string, v double")
    assert versioned.merge(change, path, ["k"], tag="batch 1")["version"] == 1
    versioned.update(spark, path, "k = 1", {"g": "'later'"})
    assert versioned.merge(change, path, ["k"], tag="batch 1") == {"action": "done_before", "tag": "batch 1", "version": 2}
    assert rows(versioned.read(spark, path)) == [(1, "later", 5.0), (2, "b", 20.0)]


def test_clustering_by_two_columns_skips_files_for_either(spark, folder):
    from millrace.operators import layout

    path = f"{folder}/t"
    df = spark.range(40_000).select(F.xxhash64("id").alias("a"), F.hash("id").cast("string").alias("b"), F.lit(None).cast("int").alias("c"))
    versioned.write(df.repartition(4), path)
    versioned.compact(spark, path, ["a", "b"], layout.output_bytes(versioned.read(spark, path)) / 36 / layout.MEGABYTE)
    zones = versioned.zone_map(spark, path, ["a", "b", "c"])
    files = zones.count()
    assert files > 20 and zones.agg(F.sum("rows")).first()[0] == 40_000 and zones.where("c_min IS NOT NULL").count() == 0
    low = {n: versioned.read(spark, path).orderBy(n).limit(400).agg(F.min(n), F.max(n)).first() for n in "ab"}
    told = {r.column: (r.files, r.touched) for r in layout.files_touched(zones, {n: tuple(low[n]) for n in "ab"}).collect()}
    assert all(0 < touched <= files / 3 and n == files for n, touched in told.values())
