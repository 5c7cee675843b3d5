import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.plans import runner
from millrace.plans.spec import SpecError, column_condition, job_of, load_job, lower_step
from millrace.sources import versioned


def test_the_three_dialects_become_one_step():
    forms = [
        {"operation": "filter", "params": {"condition": "`a` = 'x'"}},
        {"operation": "filter", "config": {"condition": "`a` = 'x'"}},
        {"operation": "filter", "column": "a", "condition": "== 'x'"},
    ]
    assert len({str(lower_step(f).params) for f in forms}) == 1


@pytest.mark.parametrize(
    "condition, wanted",
    [
        ("is_not_null", "`a` IS NOT NULL"),
        ("is_null", "`a` IS NULL"),
        ("== 'x'", "`a` = 'x'"),
        (">= 3", "`a` >= 3"),
        ("in (1, 2)", "`a` in (1, 2)"),
        ("LIKE '%x%'", "`a` LIKE '%x%'"),
        ("b > 2", "b > 2"),
    ],
)
def test_column_conditions(condition, wanted):
    assert column_condition("a", condition) == wanted


def test_join_keys_in_every_spelling():
    base = {"right_path": "/r"}
    for keys in ({"join_keys": ["k"]}, {"on": "k"}, {"join_key": "k"}):
        step = lower_step({"operation": "join", "params": base | keys})
        assert step.params["keys"] == ["k"] and step.params["how"] == "inner"
    flat = lower_step({"operation": "join", "join_table": "/r", "join_key": "k", "join_type": "outer"})
    assert flat.params["how"] == "full"
    assert lower_step({"operation": "join", "params": base | {"on": "k"}}, standards=True).params["how"] == "left"


@pytest.mark.parametrize(
    "step",
    [
        {"operation": "filter"},
        {"operation": "fill_null", "column": "a"},
        {"operation": "rename"},
        {"operation": "cast", "column": "a"},
        {"operation": "aggregate", "group_by": ["a"]},
        {"operation": "aggregate", "params": {"aggregations": [{"function": "collect_list", "column": "a"}]}},
        {"operation": "join", "join_table": "/r"},
        {"operation": "join", "join_key": "k"},
        {"operation": "enrich", "description": "only words"},
        {"operation": "sort"},
        {"operation": "dedupe", "params": {"keep": "keep_some"}},
    ],
)
def test_incomplete_steps_fail_before_any_job(step):
    with pytest.raises(SpecError):
        lower_step(step)


def test_unknown_step_fails_and_can_be_registered(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    df.createOrReplaceTempView("t_custom")
    raw = {"source": {"table": "t_custom"}, "transformations": [{"operation": "halve", "params": {"by": 2}}]}
    with pytest.raises(NotImplementedError, match="halve"):
        runner.build(spark, job_of(raw))
    runner.register_step("halve", lambda d, p, job: d.withColumn("a", F.col("a") / p["by"]))
    assert rows(runner.build(spark, job_of(raw))) == [(0.5,), (1.0,)]


def test_merge_target_needs_keys():
    raw = {"source": "/s", "target": {"path": "/t", "mode": "merge", "format": "delta"}}
    with pytest.raises(SpecError, match="merge_keys"):
        job_of(raw)
    upsert = raw | {"transformations": [{"operation": "upsert", "params": {"merge_keys": ["k"]}}]}
    assert job_of(upsert).target.merge_keys == ("k",)


def test_load_yaml_and_json(folder):
    body = {"id": "j", "source": {"path": "/s", "format": "csv"}, "transformations": []}
    for name, text in (("j.json", json.dumps(body)), ("j.yaml", json.dumps(body))):
        path = f"{folder}/{name}"
        with open(path, "w", encoding="utf-8") as handle:
            handle.write(text)
        assert load_job(path).source.format == "csv"


def _orders(spark, path):
    df = spark.createDataFrame(
        [(1, "a", 10.0, 2020), (2, "a", 20.0, 2021), (3, "b", None, 2021), (4, None, 5.0, 2021)],
        "order_id int, customer_id string, total double, year int",
    )
    df.write.parquet(path)


def test_run_writes_checks_and_reports_in_one_pass(spark, folder):
    _orders(spark, f"{folder}/in")
    raw = {
        "id": "clean",
        "pipeline_version": "2.1.0",
        "source": f"{folder}/in",
        "target": {"path": f"{folder}/out", "partition_by": ["year"]},
        "transformations": [
            {"operation": "filter", "column": "customer_id", "condition": "is_not_null"},
            {"operation": "fill_null", "column": "total", "value": 0.0},
            {"operation": "cast", "params": {"cast_map": {"total": "decimal(10,2)"}}},
            {"operation": "rename", "params": {"column_map": {"total": "amount"}}},
        ],
        "rules": [
            {"check": "not_null", "column": "amount"},
            {"check": "range", "column": "amount", "low": 5},
            {"check": "allowed", "column": "customer_id", "values": ["a", "b"]},
            {"check": "holds", "label": "recent", "predicate": "year >= 2020"},
            {"check": "not_empty"},
        ],
    }
    report = runner.run(spark, job_of(raw))
    assert report["validation"] == {
        "row_count": 3,
        "columns": ["order_id", "customer_id", "amount", "year"],
        "status": "ok",
    }
    assert report["version"] == "2.1.0" and report["status"] == "checks_failed"
    verdicts = {c["check"]: (c["passed"], c["observed"]) for c in report["checks"]}
    assert verdicts["range:amount"] == (False, 1)
    assert all(ok for name, (ok, _) in verdicts.items() if name != "range:amount")
    assert spark.read.parquet(f"{folder}/out").count() == 3


def test_run_honours_path_overrides(spark, folder):
    _orders(spark, f"{folder}/in")
    job = job_of({"id": "j", "source": "/nowhere", "target": "/nowhere-else"})
    report = runner.run(spark, job, source_path=f"{folder}/in", target_path=f"{folder}/other")
    assert report["target"] == f"{folder}/other"
    assert spark.read.parquet(f"{folder}/other").count() == 4


def test_empty_output_is_a_warning(spark, folder):
    _orders(spark, f"{folder}/in")
    raw = {
        "source": f"{folder}/in",
        "target": f"{folder}/out",
        "transformations": [{"operation": "filter", "params": {"condition": "total > 1000"}}],
        "rules": [{"check": "not_empty"}, {"check": "not_null", "column": "order_id"}],
    }
    report = runner.run(spark, job_of(raw))
    assert report["validation"]["status"] == "warning_empty"
    assert [c["passed"] for c in report["checks"]] == [False, True]


def test_rerun_changes_nothing(spark, folder):
    from millrace.operators.checks import same_rows

    _orders(spark, f"{folder}/in")
    raw = {
        "source": f"{folder}/in",
        "transformations": [
            {
                "operation": "aggregate",
                "params": {
                    "group_by": ["customer_id"],
                    "aggregations": [{"function": "sum", "column": "total", "alias": "t"}],
                },
            }
        ],
    }
    for n in (1, 2):
        runner.run(spark, job_of(raw), target_path=f"{folder}/out{n}")
    assert same_rows(spark.read.parquet(f"{folder}/out1"), spark.read.parquet(f"{folder}/out2"))


def test_upsert_merges_at_the_sink(spark, folder):
    path = f"{folder}/t"
    for values in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c")]):
        spark.createDataFrame(values, "k int, v string").createOrReplaceTempView("t_upsert")
        raw = {
            "source": {"table": "t_upsert"},
            "target": {"path": path},
            "transformations": [{"operation": "upsert", "params": {"merge_keys": ["k"]}}],
        }
        report = runner.run(spark, job_of(raw))
        assert report["validation"]["row_count"] == 2
    assert rows(versioned.read(spark, path)) == [(1, "a"), (2, "B"), (3, "c")]


def test_right_steps_equal_summing_after_the_join(spark):
    customers = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Z")], "customer_id string, name string")
    orders = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 5), ("b", 3, None)], "customer_id string, order_id int, order_amount int"
    )
    customers.createOrReplaceTempView("t_customers")
    orders.createOrReplaceTempView("t_orders")
    join = {"right_table": "t_orders", "join_keys": ["customer_id"], "join_type": "left"}
    group = ["customer_id", "name"]
    after = [
        {"operation": "join", "params": join},
        {"operation": "aggregate", "group_by": group, "metrics": ["total_spend", "order_count"]},
    ]
    before = [
        {
            "operation": "join",
            "params": join
            | {
                "right_steps": [
                    {
                        "operation": "aggregate",
                        "group_by": ["customer_id"],
                        "metrics": ["total_spend", "order_count"],
                    }
                ]
            },
        },
        {"operation": "fill_null", "column": "order_count", "value": 0},
    ]
    results = [
        rows(
            runner.build(spark, job_of({"source": {"table": "t_customers"}, "transformations": steps})).select(
                "customer_id", "name", "total_spend", "order_count"
            )
        )
        for steps in (after, before)
    ]
    assert results[0] == results[1] == [("a", "X", 15, 2), ("b", "Y", None, 1), ("c", "Z", None, 0)]


def test_standards(spark, folder):
    df = spark.createDataFrame([(" a ", 1, 2020, 1), ("a", 1, 2020, 1)], "`Customer Name` string, Id int, year int, month int")
    df.write.parquet(f"{folder}/in")
    spark.createDataFrame([(9, "x")], "id int, extra string").write.parquet(f"{folder}/right")
    raw = {
        "source": f"{folder}/in",
        "target": f"{folder}/out",
        "transformations": [
            {"operation": "join", "params": {"right_path": f"{folder}/right", "join_keys": ["id"]}},
            {"operation": "dedupe", "params": {"subset_cols": ["id"]}},
        ],
    }
    job = job_of(raw, standards=True)
    assert [s.params.get("how") or s.params.get("keep") for s in job.steps] == ["left", "keep_first"]
    runner.run(spark, job)
    import os

    assert os.path.isdir(f"{folder}/out/year=2020/month=1")
    got = spark.read.parquet(f"{folder}/out").select("id", "customer_name", "extra")
    assert rows(got) == [(1, "a", None)]


def test_table_operations_of_a_spec(spark, folder):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").createOrReplaceTempView("t_ops")
    base = {"source": {"table": "t_ops"}, "target": {"path": f"{folder}/t", "format": "delta"}}
    runner.run(spark, job_of(base | {"delta_operation": "create"}))
    with pytest.raises(ValueError, match="exists already"):
        runner.run(spark, job_of(base | {"delta_operation": "create"}))
    changed = base | {"delta_operation": "update", "condition": "k = 1", "set": {"v": "upper(v)"}}
    assert runner.run(spark, job_of(changed))["table_version"] == 1
    runner.run(spark, job_of(base | {"delta_operation": "delete", "condition": "k = 2"}))
    assert rows(versioned.read(spark, f"{folder}/t")) == [(1, "A")]
    with pytest.raises(SpecError, match="condition"):
        runner.run(spark, job_of(base | {"delta_operation": "delete"}))


def test_checks_that_need_the_written_rows(spark, folder):
    _orders(spark, f"{folder}/in")
    spark.createDataFrame([("a",)], "customer_id string").write.parquet(f"{folder}/people")
    raw = {
        "source": f"{folder}/in",
        "target": {"path": f"{folder}/out", "format": "csv"},
        "rules": [
            {"check": "unique", "keys": ["order_id"]},
            {"check": "unique", "keys": ["year"]},
            {"check": "references", "keys": ["customer_id"], "in": f"{folder}/people"},
            {"check": "not_more_rows"},
            {"check": "one_row_per", "keys": ["order_id"]},
            {"check": "same_total", "column": "total"},
            {"check": "not_empty"},
        ],
    }
    report = runner.run(spark, job_of(raw))
    assert {c["check"]: c["passed"] for c in report["checks"]} == {
        "unique:order_id": True,
        "unique:year": False,
        "references:customer_id": False,
        "not_more_rows": True,
        "one_row_per:order_id": True,
        "same_total:total": True,
        "not_empty": True,
    }


def test_the_rules_of_the_ready_made_jobs_hold(spark, folder):
    from millrace.plans import stories

    people = [("a", "A", None, "X"), ("b", "B", "e", None), (None, "N", "e", "Z")]
    bought = [("a", 1, 10, "2024-01-03", 2024, 1, "r"), ("b", 2, 20, "2024-02-03", 2024, 2, None)]
    spark.createDataFrame(people, "customer_id string, customer_name string, email string, country string").write.parquet(f"{folder}/c")
    spark.createDataFrame(
        bought,
        "customer_id string, order_id int, order_amount int, order_date string, year int, month int, region string",
    ).selectExpr("* except (order_date)", "date(order_date) AS order_date").write.parquet(f"{folder}/o")
    jobs = [
        stories.clean_customers(f"{folder}/c", f"{folder}/1"),
        stories.monthly_region_revenue(f"{folder}/o", f"{folder}/2"),
        stories.rfm_story(f"{folder}/o", f"{folder}/3", "2024-03-01"),
        stories.customer_spend(f"{folder}/1", f"{folder}/o", f"{folder}/4"),
    ]
    for raw in jobs:
        report = runner.run(spark, job_of(raw))
        assert report["status"] == "success" and report["checks"]
