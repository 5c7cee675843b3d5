"""Record-keeping reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import records
from registry import query
from registry.views import REFERENCE_DATE, calls, runs, sql, table

# Dollars per million input and output tokens; the other event types have no rate.
RATES = {"view": (15.0, 75.0), "click": (3.0, 15.0), "purchase": (0.8, 4.0)}
BUDGET = 400_000

_COSTED = """costed AS (SELECT *, CAST(CASE model
    WHEN 'view' THEN input_tokens * 15.0 + output_tokens * 75.0
    WHEN 'click' THEN input_tokens * 3.0 + output_tokens * 15.0
    WHEN 'purchase' THEN input_tokens * 0.8 + output_tokens * 4.0
    ELSE 0.0 END AS DECIMAL(24,6)) * CAST(0.000001 AS DECIMAL(7,6)) AS cost_usd FROM v_calls)"""
_ROLLUP = f"""{_COSTED}, rollup AS (SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
    CAST(round(sum(cost_usd), 4) AS DOUBLE) AS total_cost_usd, count(*) AS steps,
    round(sum(input_tokens + output_tokens) / {BUDGET}.0 * 100, 1) AS budget_pct
  FROM costed GROUP BY 1)"""


def _costed(spark: SparkSession, folder: str) -> DataFrame:
    return records.usage_cost(calls(spark, folder), RATES)


def _rollup(spark: SparkSession, folder: str) -> DataFrame:
    return records.usage_rollup(_costed(spark, folder), BUDGET)


@query(
    "g1_usage_cost",
    sql(
        f"WITH {_COSTED} SELECT run_id, seq, model, CAST(round(cost_usd, 6) AS DOUBLE) AS cost_usd FROM costed",
        "calls",
    ),
)
def usage_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _costed(spark, folder).select(
        "run_id", "seq", "model", F.round("cost_usd", 6).cast("double").alias("cost_usd")
    )


@query("g2_usage_rollup", sql(f"WITH {_ROLLUP} SELECT * FROM rollup", "calls"))
def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup(spark, folder)


@query(
    "g3_budget_flags",
    sql(
        f"""WITH {_ROLLUP} SELECT run_id, total_tokens, budget_pct, total_tokens > {BUDGET} AS exceeded,
        total_tokens / {BUDGET}.0 * 100 >= 75 AS needs_approval FROM rollup""",
        "calls",
    ),
)
def budget_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = records.budget_flags(_rollup(spark, folder), BUDGET)
    return flags.select("run_id", "total_tokens", "budget_pct", "exceeded", "needs_approval")


_CLASSES = """CASE run_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential'
  WHEN 3 THEN 'restricted' END"""


@query(
    "g4_approval_gate",
    sql(
        f"""WITH {_ROLLUP}, r AS (SELECT run_id, {_CLASSES} AS data_classification
          FROM (SELECT DISTINCT run_id FROM v_calls)),
        j AS (SELECT run_id, data_classification, coalesce(data_classification, 'internal')
            IN ('confidential', 'restricted') AS sensitive,
          total_tokens / {BUDGET}.0 * 100 >= 75 AS over, budget_pct FROM r JOIN rollup USING (run_id))
        SELECT run_id, data_classification, sensitive OR over AS approval_required,
          concat_ws(';', CASE WHEN sensitive THEN 'data_classification=' || data_classification END,
            CASE WHEN over THEN 'budget_pct=' || CAST(CAST(budget_pct AS DECIMAL(18,1)) AS VARCHAR)
              || '%' END) AS reasons,
          CASE WHEN sensitive OR over THEN 'AWAITING_APPROVAL' ELSE 'PR_CREATING' END AS next_status
        FROM j""",
        "calls",
    ),
)
def approval_gate(spark: SparkSession, folder: str) -> DataFrame:
    jobs = calls(spark, folder).select("run_id").distinct()
    classed = jobs.withColumn("data_classification", F.expr(_CLASSES))
    flags = records.budget_flags(_rollup(spark, folder), BUDGET)
    return records.approval_gate(classed, flags).withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "g5_run_page",
    sql(
        """SELECT run_id, status, submitted_at, owner FROM v_runs WHERE status = 'FAILED'
        ORDER BY submitted_at DESC, run_id LIMIT 50 OFFSET 10""",
        "runs",
    ),
)
def run_page(spark: SparkSession, folder: str) -> DataFrame:
    return records.run_page(runs(spark, folder), "FAILED", offset=10)


@query(
    "g5_run_stats",
    sql(
        """SELECT count(*) AS total, count(*) FILTER (status = 'DONE') AS done,
          count(*) FILTER (status = 'FAILED') AS failed,
          count(*) FILTER (status IN ('PARSING', 'TESTING')) AS active FROM v_runs""",
        "runs",
    ),
)
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    return records.run_stats(runs(spark, folder))


@query(
    "g6_audit_trail",
    """SELECT event_id AS id, user_id AS run_id, event_type, ts AS "timestamp",
      '{"value":' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '}' AS payload_json
    FROM events WHERE user_id = (SELECT user_id FROM events GROUP BY 1
      ORDER BY count(*) DESC, user_id LIMIT 1) ORDER BY ts, event_id""",
)
def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        "event_type",
        F.col("ts").alias("timestamp"),
        F.struct(F.col("value").cast("decimal(18,2)").alias("value")).alias("payload"),
    )
    counts = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))
    busiest = counts.agg(F.max_by("run_id", F.struct("events", -F.col("run_id")))).scalar()
    return records.audit_trail(events, busiest)


_OBJECT_CLASS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'restricted'
  WHEN '2-HIGH' THEN 'confidential' WHEN '3-MEDIUM' THEN 'internal'
  WHEN '4-NOT SPECIFIED' THEN 'public' ELSE 'scratch' END"""


@query(
    "g7_retention_plan",
    f"""SELECT o_orderkey, data_classification, created_at, CAST(age AS INTEGER) AS age_days,
      CASE data_classification
        WHEN 'restricted' THEN CASE WHEN age >= 2555 THEN 'expire' WHEN age >= 7 THEN 'archive'
          ELSE 'keep' END
        WHEN 'confidential' THEN CASE WHEN age >= 730 THEN 'expire' WHEN age >= 30 THEN 'archive'
          ELSE 'keep' END
        WHEN 'scratch' THEN 'keep'
        ELSE CASE WHEN age >= 365 THEN 'expire' WHEN age >= 30 THEN 'tiering' ELSE 'keep' END
      END AS action
    FROM (SELECT o_orderkey, {_OBJECT_CLASS} AS data_classification, o_orderdate AS created_at,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '{REFERENCE_DATE}') AS age FROM orders)""",
)
def retention_plan(spark: SparkSession, folder: str) -> DataFrame:
    objects = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr(_OBJECT_CLASS).alias("data_classification"),
        F.col("o_orderdate").alias("created_at"),
    )
    return records.retention_plan(objects, REFERENCE_DATE)


_LOGS = """counts AS (SELECT user_id, CAST(ts AS DATE) AS day,
    count(*) FILTER (event_type IN ('view', 'click')) AS good,
    count(*) FILTER (event_type = 'error') AS bad,
    count(*) FILTER (event_type = 'signup') AS broken,
    count(*) FILTER (event_type = 'purchase') AS covered FROM events GROUP BY ALL)"""


@query(
    "g8_test_logs",
    f"""WITH {_LOGS} SELECT user_id, CAST(day AS VARCHAR) AS day, good AS passed_tests,
      CASE WHEN bad > 0 THEN bad ELSE broken END AS failed_tests,
      greatest(good + CASE WHEN bad > 0 THEN bad ELSE broken END, 1) AS total_tests,
      CAST(80 + covered AS DOUBLE) AS coverage_pct, bad + broken = 0 AND good > 0 AS passed,
      CASE WHEN bad > 0 THEN 'tests/test_job.py::test_' || CAST(user_id AS VARCHAR) ELSE '' END
        AS failed_test_names
    FROM counts""",
)
def test_logs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    counts = (
        table(spark, folder, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("day"))
        .agg(
            F.count_if(kind.isin("view", "click")).alias("good"),
            F.count_if(kind == "error").alias("bad"),
            F.count_if(kind == "signup").alias("broken"),
            F.count_if(kind == "purchase").alias("covered"),
        )
    )

    def part(count: str, label: str) -> F.Column:
        return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(f" {label}")))

    head = F.concat_ws(", ", part("good", "passed"), part("bad", "failed"), part("broken", "errors"))
    named = F.when(
        F.col("bad") > 0,
        F.concat(F.lit("FAILED tests/test_job.py::test_"), F.col("user_id").cast("string"), F.lit(" - boom")),
    )
    coverage = F.concat(
        F.lit("TOTAL      100     15    "), (F.col("covered") + 80).cast("string"), F.lit("%")
    )
    logs = counts.select(
        "user_id",
        F.col("day").cast("string").alias("day"),
        F.concat_ws("\n", named, coverage, F.concat(head, F.lit(" in 2.00s"))).alias("log"),
        F.when(F.col("bad") + F.col("broken") > 0, 1).otherwise(0).alias("return_code"),
    )
    return (
        records.parse_test_logs(logs)
        .withColumn("failed_test_names", F.array_join("failed_test_names", ","))
        .drop("log", "return_code")
    )
