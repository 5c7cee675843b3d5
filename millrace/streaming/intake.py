"""Job requests as JSON lines: good ones go on, bad ones are kept with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.checks import story_rules
from millrace.sources import versioned
from millrace.sources.shared import temporary_copies
from millrace.streaming.audit import append_new

STORY = (
    "struct<id:string, title:string, description:string, acceptance_criteria:array<string>,"
    " tags:array<string>, data_classification:string>"
)
MESSAGE = f"run_id string, story_id string, dry_run boolean, story {STORY}, _bad string"

GOOD = "good"
REJECTED = "rejected"

#: When a line came in: the time of its file, which is the same when a batch is repeated.
RECEIVED = "received_at"
BATCH = "_batch"


def judge(lines: DataFrame) -> DataFrame:
    """Text lines (`value`) as (verdict, reason, run_id, story_id, dry_run, story, value).

    The first reason that applies is given: malformed_json, missing_fields, or invalid_story
    with the broken rules. Works on a batch and on a stream alike; `received_at` is passed on.
    """
    message = F.from_json(
        "value", MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    passed = [RECEIVED] if RECEIVED in lines.columns else []
    parsed = lines.select("value", *passed, message.alias("m")).select("value", *passed, "m", "m.*").select("*", "story.*")
    told = parsed.withColumn("broken", _broken_rules()).withColumn("reason", _reason())
    return told.select(
        F.when(F.col("reason").isNull(), GOOD).otherwise(REJECTED).alias("verdict"),
        "reason",
        "run_id",
        "story_id",
        F.coalesce("dry_run", F.lit(False)).alias("dry_run"),
        "story",
        "value",
        *passed,
    )


def _broken_rules() -> Column:
    flags = [F.when(~fine, F.lit(name)) for name, fine in story_rules().items()]
    return F.array_join(F.array_compact(F.array(*flags)), ",")


def _no_story() -> Column:
    """True without a story or with one that has no fields at all, whatever their names."""
    written = F.get_json_object("value", "$.story")
    return F.col("story").isNull() | F.regexp_like(written, F.lit(r"^\s*\{\s*\}\s*$"))


def _reason() -> Column:
    return (
        F.when(F.col("m").isNull() | F.col("_bad").isNotNull(), "malformed_json")
        .when(
            F.coalesce(F.col("run_id"), F.lit("")).eqNullSafe("") | _no_story(),
            "missing_fields",
        )
        .when(F.col("broken") != "", F.concat(F.lit("invalid_story:"), F.col("broken")))
    )


def start_intake(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    *,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Read the JSON-line files below `source` that are new and append them to `target`.

    Both outcomes go to one Parquet sink partitioned by verdict: the file sink commits a batch
    as a whole, so a replay after a failure writes no line twice.
    """
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(source)
    return (
        judge(lines)
        .writeStream.format("parquet")
        .partitionBy("verdict")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def failure_events(judged: DataFrame) -> DataFrame:
    """Audit events (event_type, run_id, story_id, actor, payload) for the same requests."""
    return judged.filter(F.col("reason").startswith("invalid_story")).select(
        F.lit("RUN_FAILED").alias("event_type"),
        "run_id",
        "story_id",
        F.lit("worker").alias("actor"),
        F.struct(F.col("reason").alias("error")).alias("payload"),
    )


def failed_runs(judged: DataFrame) -> DataFrame:
    """Run updates (run_id, status, error_message) for requests whose story is invalid."""
    return judged.filter(F.col("reason").startswith("invalid_story")).select(
        "run_id",
        F.lit("FAILED").alias("status"),
        F.concat(F.lit("Story validation failed: "), F.col("reason")).alias("error_message"),
    )


def run_events(judged: DataFrame) -> DataFrame:
    """Audit events of a judged batch with the time at which each line came in: a good request starts
    its run, one with an invalid story ends it."""
    columns = ("event_type", "run_id", "story_id", "actor", "trigger_source", "from_status", "to_status", "payload", "ts")
    invalid = F.col("reason").startswith("invalid_story")
    nothing = F.lit(None).cast("string")
    fields = {
        "event_type": F.when(invalid, "RUN_FAILED").otherwise("PARSING_STARTED"),
        "story_id": F.when(invalid, F.col("story_id")).otherwise(F.col("story.id")),
        "actor": F.lit("worker"),
        "trigger_source": F.lit("queue"),
        "from_status": F.when(invalid, nothing).otherwise("PENDING"),
        "to_status": F.when(invalid, nothing).otherwise("PARSING"),
        "payload": F.when(invalid, F.to_json(F.struct(F.col("reason").alias("error")))).otherwise("{}"),
        "ts": F.col(RECEIVED),
    }
    return judged.filter(F.col("reason").isNull() | invalid).withColumns(fields).select(*columns)


def run_updates(judged: DataFrame) -> DataFrame:
    """One update (run_id, status, error_message, started_at) per run of a judged batch; what is NULL in it
    stays as it is. The last line of a run decides, and of lines of one time the last by its text."""
    invalid = F.col("reason").startswith("invalid_story")
    update = F.struct(
        F.when(invalid, "FAILED").otherwise("PARSING").alias("status"),
        F.when(invalid, F.concat(F.lit("Story validation failed: "), F.col("reason"))).alias("error_message"),
        F.when(~F.coalesce(invalid, F.lit(False)), F.col(RECEIVED)).alias("started_at"),
    )
    known = judged.filter(F.col("reason").isNull() | invalid)
    return known.groupBy("run_id").agg(F.max_by(update, F.struct(RECEIVED, "value")).alias("update")).select("run_id", "update.*")


@dataclass(frozen=True)
class IntakeSinks:
    """Where a batch of requests leaves its traces: the judged lines, the audit log, and the versioned
    table of runs (run_id, status, error_message, started_at and whatever else)."""

    lines: str
    audit: str
    runs: str


def apply_batch(lines: DataFrame, number: int, sinks: IntakeSinks, stream: str) -> None:
    """Write a batch of lines (`value`, `received_at`) to all sinks.

    The batch is judged once; what the sink of lines then holds of it feeds the others, so that the texts are
    stored no second time. Each sink takes it once, however often it is repeated: the lines
    replace those of the same batch, the audit log knows its ids, and the runs table remembers in its
    history the batch of `stream` that changed it. Runs that the table doesn't hold are left alone.
    """
    spark = lines.sparkSession
    with temporary_copies(spark):
        fresh = judge(lines)
        stored = f"{sinks.lines.rstrip('/')}/{BATCH}={number}"
        fresh.hint("rebalance", F.col("verdict")).write.mode("overwrite").partitionBy("verdict").parquet(stored)
        judged = spark.read.schema(fresh.schema).parquet(stored).select(*fresh.columns)
        append_new(run_events(judged), sinks.audit, number)
        if versioned.exists(spark, sinks.runs):
            versioned.merge(
                run_updates(judged), sinks.runs, ["run_id"], insert_all=False, keep_old_when_null=True, tag=f"{stream}#{number}"
            )


def start_intake_with_records(
    spark: SparkSession, source: str, sinks: IntakeSinks, checkpoint: str, *, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Like `start_intake`, and every batch also writes its audit events and marks its runs."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(source).select("value", F.col("_metadata.file_modification_time").alias(RECEIVED))
    return (
        lines.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, sinks, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_lines(spark: SparkSession, sinks: IntakeSinks) -> DataFrame:
    """The judged lines of all batches."""
    return spark.read.parquet(sinks.lines).drop(BATCH)
