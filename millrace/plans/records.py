"""Reports over run, usage, audit and retention tables."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col, round_half_up
from millrace.functions.text import first_number, json_payload
from millrace.operators.layout import broadcast_if_small
from millrace.operators.ordering import latest_by, page, running_total

# Run states that count as active, and the audit event types that are recorded.
ACTIVE_STATES = (
    "PARSING",
    "CODING",
    "TESTING",
    "PR_CREATING",
    "DEPLOYING",
    "AWAITING_APPROVAL",
)
AUDIT_EVENTS = (
    "STORY_SUBMITTED",
    "RUN_CREATED",
    "PARSING_STARTED",
    "CODING_STARTED",
    "TESTING_STARTED",
    "PR_CREATING",
    "DEPLOYMENT_APPROVED",
    "DEPLOYMENT_TRIGGERED",
    "RUN_COMPLETED",
    "RUN_FAILED",
    "RUN_CANCELLED",
    "OVERRIDE_GRANTED",
)

# Share of the budget from which a run needs approval, and sensitive classes.
APPROVAL_PCT = 75.0
SENSITIVE = ("confidential", "restricted")

# Patterns of the parts of a test log.
PASSED_PATTERN = r"(\d+) passed"
FAILED_PATTERN = r"(\d+) failed"
ERROR_PATTERN = r"(\d+) error"
COVERAGE_PATTERN = r"TOTAL\s+\d+\s+\d+\s+(\d+)%"
FAILED_NAME_PATTERN = r"FAILED (.*?) -"

# Runs on a page of the listing, and the most one may ask for.
DEFAULT_PAGE = 50
LARGEST_PAGE = 200

# Class, days to the cheaper storage, that storage, days to deletion.
RETENTION_RULES = (
    ("public", 30, "tiering", 365),
    ("internal", 30, "tiering", 365),
    ("confidential", 30, "archive", 730),
    ("restricted", 7, "archive", 2555),
)


def usage_cost(calls: DataFrame, rates: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Calls (model, input_tokens, output_tokens) with their cost_usd.

    `rates` gives dollars per million input and output tokens; an unknown model costs nothing. The
    rates are broadcast if their table is small. Costs are decimals: their sums do not depend on the
    order in which the parts of a run are added.
    """
    table = calls.sparkSession.createDataFrame(
        [(m, Decimal(str(i)), Decimal(str(o))) for m, (i, o) in rates.items()],
        "model string, rate_in decimal(10,6), rate_out decimal(10,6)",
    )
    tokens_in, tokens_out = (
        F.coalesce(F.col(c), F.lit(0)).cast("decimal(15,0)") for c in ("input_tokens", "output_tokens")
    )
    millions = F.lit(Decimal("0.000001"))
    cost = (tokens_in * F.col("rate_in") + tokens_out * F.col("rate_out")) * millions
    return (
        calls.join(broadcast_if_small(table), "model", "left")
        .withColumn("cost_usd", F.coalesce(cost, F.lit(Decimal(0)).cast("decimal(34,12)")))
        .drop("rate_in", "rate_out")
    )


def usage_rollup(costed: DataFrame, max_tokens: int = 0) -> DataFrame:
    """Token and cost totals per run with the share of the budget; 0 means no budget.

    The single calls stay rows of `usage_steps`: a run may have any number of them.
    """
    totals = costed.groupBy("run_id").agg(
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(F.sum("cost_usd"), 4).cast("double").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("steps"),
    )
    return totals.withColumn("budget_pct", round_half_up(budget_pct(F.col("total_tokens"), max_tokens), 1))


def budget_pct(tokens: Column, max_tokens: int) -> Column:
    """Share of the budget in percent, 0 without one."""
    return tokens / F.lit(float(max_tokens)) * 100 if max_tokens > 0 else F.lit(0.0)


def usage_steps(costed: DataFrame, order_by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Every call with the token total of its run so far."""
    counted = costed.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    return running_total(counted, ["run_id"], list(order_by), {"cumulative_tokens": "tokens"})


def budget_flags(rollup: DataFrame, max_tokens: int, threshold_pct: float = APPROVAL_PCT) -> DataFrame:
    """Adds exceeded (total above the budget) and needs_approval (share at or above the
    threshold); both false without a budget."""
    if max_tokens <= 0:
        return rollup.withColumns({"exceeded": F.lit(False), "needs_approval": F.lit(False)})
    share = budget_pct(F.col("total_tokens"), max_tokens)
    return rollup.withColumns(
        {
            "exceeded": F.col("total_tokens") > max_tokens,
            "needs_approval": share >= threshold_pct,
        }
    )


def approval_gate(runs: DataFrame, flags: DataFrame) -> DataFrame:
    """Per run whether a person must approve, the reasons, and the state it moves to.

    A missing class counts as internal, a run without usage has no budget flag.
    """
    share = flags.select("run_id", "needs_approval", "budget_pct")
    label = F.coalesce(F.col("data_classification"), F.lit("internal"))
    sensitive = label.isin(*SENSITIVE)
    over = F.coalesce(F.col("needs_approval"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(sensitive, F.concat(F.lit("data_classification="), label)),
            F.when(
                over,
                F.concat(
                    F.lit("budget_pct="), F.col("budget_pct").cast("decimal(18,1)").cast("string"), F.lit("%")
                ),
            ),
        )
    )
    return (
        runs.join(share, "run_id", "left")
        .withColumn("approval_required", sensitive | over)
        .withColumn("reasons", reasons)
        .withColumn(
            "next_status",
            F.when(F.col("approval_required"), "AWAITING_APPROVAL").otherwise("PR_CREATING"),
        )
        .drop("needs_approval", "budget_pct")
    )


def run_page(
    runs: DataFrame, status: str | None = None, limit: int = DEFAULT_PAGE, offset: int = 0,
    largest: int = LARGEST_PAGE,
) -> DataFrame:
    """One page of runs, newest submission first, of one status when given; at least one and at most
    `largest` runs."""
    limit = max(1, min(limit, largest))
    chosen = runs if status is None else runs.filter(F.col("status") == status)
    newest_first = [{"column": "submitted_at", "descending": True}, "run_id"]
    return page(chosen, newest_first, limit=limit, offset=offset)


def run_stats(runs: DataFrame) -> DataFrame:
    """Number of runs: all, done, failed and active."""
    status = F.col("status")
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "DONE").alias("done"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(status.isin(*ACTIVE_STATES)).alias("active"),
    )


def current_states(transitions: DataFrame) -> DataFrame:
    """The last transition of every run; `event_id` settles equal times."""
    return latest_by(transitions, ["run_id"], ["ts", "event_id"])


def audit_id(event_type: Column, run_id: Column, ts: Column) -> Column:
    """`type_run_second` with the nearest second (halves go to the even one); a missing run is none."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)")
    second = F.bround(micros / F.lit(1_000_000).cast("decimal(7,0)"), 0).cast("bigint").cast("string")
    return F.concat_ws("_", event_type, F.coalesce(run_id.cast("string"), F.lit("none")), second)


def audit_trail(events: DataFrame, run_id: str | int | Column, payload: str = "payload") -> DataFrame:
    """Events of one run in time order with their payload as JSON text."""
    return (
        events.filter(F.col("run_id") == F.lit(run_id))
        .withColumn("payload_json", json_payload(col(payload)))
        .drop(payload)
        .orderBy("timestamp", "id")
    )


def retention_plan(objects: DataFrame, as_of: str | Column) -> DataFrame:
    """Objects (data_classification, created_at) with age_days and what to do: keep, move to the
    cheaper storage of their class, or expire. Objects of an unknown class are kept."""
    rules = objects.sparkSession.createDataFrame(
        list(RETENTION_RULES),
        "data_classification string, move_after int, storage string, expire_after int",
    )
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    age = F.datediff(day, F.col("created_at").cast("date"))
    action = (
        F.when(F.col("age_days") >= F.col("expire_after"), "expire")
        .when(F.col("age_days") >= F.col("move_after"), F.col("storage"))
        .otherwise("keep")
    )
    return (
        objects.withColumn("age_days", age)
        .join(F.broadcast(rules), "data_classification", "left")  # four rows
        .withColumn("action", action)
        .drop("move_after", "storage", "expire_after")
    )


def parse_test_logs(logs: DataFrame, text: str = "log", code: str = "return_code") -> DataFrame:
    """Counts, pass flag, coverage and failed test names from the output of a test run.

    Collection errors stand in for failures when no test failed; a log without any test counts
    as one test, so that it can never look like a success.
    """
    log = col(text)
    none = F.lit(0).cast("bigint")
    failed = F.coalesce(first_number(log, FAILED_PATTERN), first_number(log, ERROR_PATTERN), none)
    coverage = first_number(log, COVERAGE_PATTERN).cast("double")
    counted = logs.withColumns(
        {
            "passed_tests": F.coalesce(first_number(log, PASSED_PATTERN), none),
            "failed_tests": failed,
            "coverage_pct": F.coalesce(coverage, F.lit(0.0)),
            "failed_test_names": F.regexp_extract_all(log, F.lit(FAILED_NAME_PATTERN), F.lit(1)),
        }
    )
    found = F.col("passed_tests") + F.col("failed_tests")
    return counted.withColumns(
        {
            "total_tests": F.greatest(found, F.lit(1)),
            "passed": (col(code) == 0) & (F.col("failed_tests") == 0) & (F.col("passed_tests") > 0),
        }
    )
