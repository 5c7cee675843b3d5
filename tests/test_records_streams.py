import datetime
import json
from pathlib import Path

import duckdb
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.plans import records
from millrace.sources import shared
from millrace.streaming import audit, intake

LOGS = [
    ("7 passed in 0.41s", 0, (7, 0, 7, True, 0.0, [])),
    ("5 passed, 2 failed in 3.10s", 1, (5, 2, 7, False, 0.0, [])),
    ("7 passed in 0.41s\nTOTAL     640   96   85%\n", 0, (7, 0, 7, True, 85.0, [])),
    ("nothing was run", 5, (0, 0, 1, False, 0.0, [])),
    ("ERROR while importing job_test.py", 2, (0, 0, 1, False, 0.0, [])),
    ("2 passed, 3 errors in 1s", 1, (2, 3, 5, False, 0.0, [])),
    ("FAILED a.py::x - boom\nFAILED b.py::y - bang\n2 failed", 1, (0, 2, 2, False, 0.0, ["a.py::x", "b.py::y"])),
    ("6 passed in 1s", 1, (6, 0, 6, False, 0.0, [])),
]


def test_log_parsing(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(LOGS)], "i int, log string, return_code int")
    got = records.parse_test_logs(df).orderBy("i").collect()
    for r, (_, _, wanted) in zip(got, LOGS):
        assert (r.passed_tests, r.failed_tests, r.total_tests, r.passed, r.coverage_pct, r.failed_test_names) == wanted


def test_usage_cost_rollup_and_flags(spark):
    calls = spark.createDataFrame(
        [("r1", 1, "big", 1_000_000, 100_000), ("r1", 2, "none", 500, 500), ("r2", 1, "big", 10, 0)],
        "run_id string, seq int, model string, input_tokens long, output_tokens long",
    )
    costed = records.usage_cost(calls, {"big": (3.0, 15.0)})
    assert {(r.run_id, r.seq): float(r.cost_usd) for r in costed.collect()} == {
        ("r1", 1): 4.5,
        ("r1", 2): 0.0,
        ("r2", 1): 0.00003,
    }
    rollup = records.usage_rollup(costed, 1_400_000)
    first = rollup.filter("run_id = 'r1'").first()
    assert (first.total_tokens, first.total_cost_usd, first.budget_pct, first.steps) == (1_101_000, 4.5, 78.6, 2)
    flags = {r.run_id: (r.exceeded, r.needs_approval) for r in records.budget_flags(rollup, 1_400_000).collect()}
    assert flags == {"r1": (False, True), "r2": (False, False)}
    free = records.budget_flags(records.usage_rollup(costed), 0).collect()
    assert all((r.budget_pct, r.exceeded, r.needs_approval) == (0.0, False, False) for r in free)
    steps = {(r.run_id, r.seq): r.cumulative_tokens for r in records.usage_steps(costed).collect()}
    assert steps == {("r1", 1): 1_100_000, ("r1", 2): 1_101_000, ("r2", 1): 10}


def test_budget_share_at_half_a_tenth(spark, folder):
    """Totals whose share of the budget ends in exactly 5 hundredths, as the SQL of the three queries rounds them."""
    tokens = [13_186_200, 13_186_199, *(400 * k + 200 for k in range(700))]
    events = spark.createDataFrame([(i, i, "view", t / 100, '{"k": 0}') for i, t in enumerate(tokens)], "event_id long, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    for name, columns in (
        ("g2_usage_rollup", "run_id, total_tokens, budget_pct"),
        ("g3_budget_flags", "run_id, total_tokens, budget_pct, exceeded, needs_approval"),
        ("g4_approval_gate", "run_id, approval_required, reasons, next_status"),
    ):
        wanted = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert rows(entry.queries()[name](spark, folder).select(*columns.split(", "))) == sorted(wanted, key=repr)
    assert ("budget_pct=3296.6%",) in con.execute(f"SELECT reasons FROM ({entry.oracle_sql()['g4_approval_gate']})").fetchall()


def test_approval_gate(spark):
    runs = spark.createDataFrame([("r1", "restricted"), ("r2", "public"), ("r3", None)], "run_id string, data_classification string")
    flags = spark.createDataFrame([("r1", True, 81.25), ("r2", True, 75.0)], "run_id string, needs_approval boolean, budget_pct double")
    got = {r.run_id: (r.approval_required, r.reasons, r.next_status) for r in records.approval_gate(runs, flags).collect()}
    assert got == {
        "r1": (True, ["data_classification=restricted", "budget_pct=81.3%"], "AWAITING_APPROVAL"),
        "r2": (True, ["budget_pct=75.0%"], "AWAITING_APPROVAL"),
        "r3": (False, [], "PR_CREATING"),
    }


def test_run_listing_and_states(spark):
    t = datetime.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [(i, s, t + datetime.timedelta(minutes=i)) for i, s in enumerate(["DONE", "FAILED", "TESTING", "PENDING", "DONE"])],
        "run_id int, status string, submitted_at timestamp",
    )
    assert tuple(records.run_stats(runs).first()) == (5, 2, 1, 1)
    assert [r.run_id for r in records.run_page(runs, limit=2, offset=1).collect()] == [3, 2]
    assert [r.run_id for r in records.run_page(runs, "DONE").collect()] == [4, 0]
    moves = spark.createDataFrame([("a", t, 1, "X"), ("a", t, 2, "Y"), ("b", t, 3, "Z")], "run_id string, ts timestamp, event_id int, status string")
    assert {r.run_id: r.status for r in records.current_states(moves).collect()} == {"a": "Y", "b": "Z"}


def test_audit_trail(spark):
    t = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [("e2", "r", t + datetime.timedelta(1), None), ("e1", "r", t, ("v",)), ("e3", "q", t, None)],
        "id string, run_id string, timestamp timestamp, payload struct<k:string>",
    )
    got = records.audit_trail(events, "r").collect()
    assert [(r.id, r.payload_json) for r in got] == [("e1", '{"k":"v"}'), ("e2", "{}")]


def test_retention_plan(spark):
    day = datetime.date(2024, 1, 1)
    ages = [("public", 29), ("public", 30), ("internal", 365), ("confidential", 365), ("confidential", 730), ("restricted", 7), ("restricted", 2554), ("restricted", 2555), ("other", 9999)]
    df = spark.createDataFrame([(c, day - datetime.timedelta(a)) for c, a in ages], "data_classification string, created_at date")
    got = {(r.data_classification, r.age_days): r.action for r in records.retention_plan(df, "2024-01-01").collect()}
    assert [got[a] for a in ages] == ["keep", "tiering", "expire", "archive", "expire", "archive", "archive", "expire", "keep"]


def message(**changes):
    story = {"id": "s-1", "title": "t", "description": "d"} | changes.pop("story", {})
    return json.dumps({"run_id": "r", "story": story} | changes)


LINES = [
    (message(), None),
    (message(dry_run=True, story={"tags": ["a"]}), None),
    ("{not json", "malformed_json"),
    ("", "malformed_json"),
    (message(run_id=""), "missing_fields"),
    (message(run_id=None), "missing_fields"),
    (json.dumps({"run_id": "r"}), "missing_fields"),
    (message(story={"title": ""}), "invalid_story:title"),
    (message(story={"id": "a b", "data_classification": "secret"}), "invalid_story:id,data_classification"),
    (message(story={"tags": ["x" * 51]}), "invalid_story:tags"),
]


def test_intake_reasons(spark):
    df = spark.createDataFrame([(t,) for t, _ in LINES], "value string")
    got = {r.value: r.reason for r in intake.judge(df).collect()}
    assert got == dict(LINES)
    failed = intake.failed_runs(intake.judge(df)).collect()
    assert len(failed) == 3 and all(r.status == "FAILED" and r.run_id == "r" for r in failed)
    events = intake.failure_events(intake.judge(df)).collect()
    assert {(r.event_type, r.run_id) for r in events} == {("RUN_FAILED", "r")}
    assert {r.payload.error for r in events} == {w for _, w in LINES if w and w.startswith("invalid")}


def test_intake_stream_equals_batch_and_replays_nothing(spark, folder):
    source, target, log = f"{folder}/in", f"{folder}/out", f"{folder}/log"
    lines = [t for t, _ in LINES if t]
    spark.createDataFrame([(t,) for t in lines[:4]], "value string").write.text(source)
    intake.start_intake(spark, source, target, log).awaitTermination()
    spark.createDataFrame([(t,) for t in lines[4:]], "value string").write.mode("append").text(source)
    for _ in range(2):  # the second run finds nothing new
        intake.start_intake(spark, source, target, log, files_per_batch=1).awaitTermination()
    written = spark.read.parquet(target)
    batch = intake.judge(spark.createDataFrame([(t,) for t in lines], "value string"))
    shown = ("verdict", "reason", "run_id", "dry_run", "value")
    assert rows(written.select(*shown)) == rows(batch.select(*shown))
    assert written.filter("verdict = 'good'").count() == 2


def test_audit_stream_equals_batch(spark, folder):
    t = datetime.datetime(2024, 1, 1, 10)
    values = [
        ("RUN_CREATED", "a", t, 1),
        ("RUN_CREATED", "a", t + datetime.timedelta(milliseconds=400), 2),
        ("RUN_CREATED", "a", t + datetime.timedelta(seconds=1), 3),
        ("RUN_CREATED", None, t, 4),
        ("NOT_A_TYPE", "a", t, 5),
        ("RUN_FAILED", "a", t, 6),
    ]
    df = spark.createDataFrame(values, "event_type string, run_id string, ts timestamp, n int")
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    for _ in range(2):
        audit.start_audit_log(stream, f"{folder}/out", f"{folder}/log").awaitTermination()
    ids = rows(audit.read_audit_log(spark, f"{folder}/out").select("id"))
    assert ids == rows(audit.first_events(df).select("id"))
    seconds = int(t.replace(tzinfo=datetime.UTC).timestamp())
    assert ids == [
        (f"RUN_CREATED_a_{seconds}",),
        (f"RUN_CREATED_a_{seconds + 1}",),
        (f"RUN_CREATED_none_{seconds}",),
        (f"RUN_FAILED_a_{seconds}",),
    ]


def test_late_events_are_kept_and_repeats_are_not(spark, folder):
    t = datetime.datetime(2024, 1, 1, 20)
    schema = "event_type string, run_id string, ts timestamp"
    new = [("RUN_CREATED", str(i), t + datetime.timedelta(minutes=i)) for i in range(10)]
    late = [("RUN_CREATED", str(i), t - datetime.timedelta(hours=5 + 24 * (i % 2), minutes=i)) for i in range(10)]
    for batch in (new, late, new[:5] + late[:5]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        audit.start_audit_log(stream, f"{folder}/out", f"{folder}/log").awaitTermination()
    found = audit.read_audit_log(spark, f"{folder}/out")
    assert rows(found.select(*[c.split()[0] for c in schema.split(", ")])) == rows(spark.createDataFrame(new + late, schema))
    repeated = spark.createDataFrame(new + late, schema)
    audit.append_new(repeated, f"{folder}/out", 2)  # the last batch again, after a failure
    assert audit.read_audit_log(spark, f"{folder}/out").count() == 20


def test_an_id_is_known_across_midnight_and_a_batch_replaces_itself(spark, folder):
    schema, target = "event_type string, run_id string, ts timestamp", f"{folder}/log"
    midnight = datetime.datetime(2026, 1, 2)
    before = [("RUN_CREATED", "r", midnight - datetime.timedelta(milliseconds=300)), ("RUN_CREATED", None, midnight)]
    after = [("RUN_CREATED", "r", midnight + datetime.timedelta(milliseconds=200)), ("RUN_FAILED", "r", midnight)]
    audit.append_new(spark.createDataFrame(before, schema), target, 0)
    for _ in range(3):
        audit.append_new(spark.createDataFrame(after, schema), target, 1)
    audit.append_new(spark.createDataFrame([], schema), target, 2)
    found = [r.id for r in audit.read_audit_log(spark, target).collect()]
    assert len(found) == len(set(found)) == 3


def test_a_small_batch_lists_only_its_buckets(spark, folder):
    schema, target = "event_type string, run_id string, ts timestamp", f"{folder}/log"
    t = datetime.datetime(2026, 1, 2)
    many = [("RUN_CREATED", str(i), t) for i in range(500)]
    audit.append_new(spark.createDataFrame(many, schema), target, 0)
    buckets = spark.read.parquet(target).select(audit.BUCKET).distinct().count()
    assert buckets == audit.BUCKETS
    audit.append_new(spark.createDataFrame(many[:1] + [("RUN_FAILED", "x", t)], schema), target, 1)
    written = spark.read.parquet(target).where(f"{audit.BATCH} = 1")
    assert written.count() == 1 and written.select(audit.BUCKET).distinct().count() == 1


def test_intake_records_and_replays(spark, folder):
    from millrace.sources import versioned

    sinks = intake.IntakeSinks(f"{folder}/lines", f"{folder}/audit", f"{folder}/runs")
    pending = [(r, "PENDING", None, None, "kept") for r in ("ok", "bad", "both", "other")]
    schema = "run_id string, status string, error_message string, started_at timestamp, note string"
    versioned.write(spark.createDataFrame(pending, schema), sinks.runs)
    t = [datetime.datetime(2026, 1, 1, h) for h in range(4)]
    first = [(message(run_id="ok"), t[0]), (message(run_id="bad", story_id="s", story={"title": ""}), t[0]), (message(run_id="both"), t[1]), ("{", t[1])]
    second = [(message(run_id="both", story={"id": "a b"}), t[2]), (message(run_id="unknown"), t[3]), (message(run_id=""), t[3])]

    def state():
        lines = rows(intake.read_lines(spark, sinks).select("verdict", "reason", "run_id", "value"))
        return lines, rows(audit.read_audit_log(spark, sinks.audit)), rows(versioned.read(spark, sinks.runs)), versioned.version_of(spark, sinks.runs).number

    for number, batch in enumerate((first, second)):
        df = spark.createDataFrame(batch, "value string, received_at timestamp")
        intake.apply_batch(df, number, sinks, "stream")
        once = state()
        intake.apply_batch(df, number, sinks, "stream")
        assert state() == once
    intake.apply_batch(spark.createDataFrame(first, "value string, received_at timestamp"), 0, sinks, "stream")
    assert state() == once  # an earlier batch again
    lines, events, runs, version = once
    assert len(lines) == 7 and version == 2
    assert sorted(r[0] for r in events) == ["PARSING_STARTED"] * 3 + ["RUN_FAILED"] * 2
    assert {r[0]: r[1:3] for r in runs} == {
        "ok": ("PARSING", None), "bad": ("FAILED", "Story validation failed: invalid_story:title"),
        "both": ("FAILED", "Story validation failed: invalid_story:id"), "other": ("PENDING", None),
    }
    assert {r[0]: r[3] for r in runs} == {"ok": t[0], "bad": None, "both": t[1], "other": None} and {r[4] for r in runs} == {"kept"}


def test_a_batch_stores_its_texts_once(spark, folder, monkeypatch):
    """Beside the sink of lines no copy of the texts is written."""
    story = F.struct(
        F.col("id").cast("string").alias("id"), F.lit("a title").alias("title"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)), " ").alias("description"),
        F.array(F.lit("x")).alias("acceptance_criteria"), F.lit("public").alias("data_classification"),
    )
    message = F.to_json(F.struct(F.col("id").cast("string").alias("run_id"), story.alias("story")))
    lines = spark.range(200).select(message.alias("value"), F.lit(datetime.datetime(2024, 1, 1)).alias("received_at"))
    copies = []

    def size(path):
        return sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*.parquet"))

    monkeypatch.setattr(shared, "delete_folder", lambda session, path: copies.append(size(path)))
    sinks = intake.IntakeSinks(*[f"{folder}/{name}" for name in ("lines", "audit", "runs")])
    intake.apply_batch(lines, 0, sinks, "s")
    assert intake.read_lines(spark, sinks).count() == audit.read_audit_log(spark, sinks.audit).count() == 200
    assert 2 * sum(copies) < size(sinks.lines)


def test_an_empty_batch_leaves_no_trace(spark, folder):
    from millrace.sources import versioned

    sinks = intake.IntakeSinks(f"{folder}/lines", f"{folder}/audit", f"{folder}/runs")
    versioned.write(spark.createDataFrame([("r", "PENDING")], "run_id string, status string"), sinks.runs)
    intake.apply_batch(spark.createDataFrame([], "value string, received_at timestamp"), 0, sinks, "s")
    assert rows(versioned.read(spark, sinks.runs)) == [("r", "PENDING")]


def test_an_audit_id_has_the_nearest_second(spark):
    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    moments = [0, 499_999, 500_000, 500_001, 1_500_000, 1_499_999]
    df = spark.createDataFrame([("A", None, t + datetime.timedelta(microseconds=m)) for m in moments], "e string, r string, ts timestamp")
    got = [r[0] for r in df.select(records.audit_id(F.col("e"), F.col("r"), F.col("ts"))).collect()]
    assert got == [f"A_none_{(t + datetime.timedelta(microseconds=m)).timestamp():.0f}" for m in moments]


def test_a_story_without_fields_is_missing(spark):
    lines = ['{"run_id": "r", "story": {}}', '{"run_id": "r", "story": {"x": 1}}', message(story_id="s-9", story={"title": ""})]
    judged = intake.judge(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.reason for r in judged.collect()][0] == "missing_fields"
    assert [r.story_id for r in intake.failure_events(judged).collect()][-1] == "s-9"
