"""Streaming jobs, run to the end of their input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import versioned
from millrace.sources.shared import fresh_path
from millrace.streaming import audit, intake
from registry import query
from registry.views import table

KINDS = ("view", "click", "purchase", "signup")


def intake_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Job requests from the documents: Spanish ones are cut off JSON, German ones lack a run id,
    French ones carry an unknown class, the others are as they are."""
    story = F.struct(
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("description"),
        F.array("lang").alias("tags"),
        F.when(F.col("lang") == "fr", "secret").otherwise("public").alias("data_classification"),
    )
    run_id = F.when(F.col("lang") != "de", F.concat(F.lit("run-"), F.col("doc_id").cast("string")))
    message = F.to_json(F.struct(run_id.alias("run_id"), F.lit(True).alias("dry_run"), story.alias("story")))
    whole = F.when(F.col("lang") == "es", F.concat(F.lit("{"), message)).otherwise(message)
    return table(spark, folder, "documents").select(whole.alias("value"))


@query(
    "x1_intake_split",
    """SELECT verdict, reason, count(*) AS messages, count(DISTINCT run_id) AS runs
    FROM (SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'rejected' END AS verdict, reason,
        CASE WHEN reason IS NULL OR reason LIKE 'invalid_story%' THEN doc_id END AS run_id
      FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN 'malformed_json'
          WHEN lang = 'de' THEN 'missing_fields'
          WHEN lang = 'fr' AND length(text) NOT BETWEEN 1 AND 2000
            THEN 'invalid_story:description,data_classification'
          WHEN lang = 'fr' THEN 'invalid_story:data_classification'
          WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 'invalid_story:description' END AS reason
        FROM documents)) GROUP BY ALL""",
)
def intake_split(spark: SparkSession, folder: str) -> DataFrame:
    source, target = fresh_path(spark, "intake-in"), fresh_path(spark, "intake-out")
    intake_lines(spark, folder).write.text(source)
    intake.start_intake(spark, source, target, fresh_path(spark, "intake-log")).awaitTermination()
    known = F.when(
        F.col("reason").isNull() | F.col("reason").startswith("invalid_story"), F.col("run_id")
    )
    return (
        spark.read.parquet(target)
        .groupBy("verdict", "reason")
        .agg(F.count(F.lit(1)).alias("messages"), F.count_distinct(known).alias("runs"))
    )


@query(
    "x1_intake_records",
    """WITH d AS (SELECT doc_id, lang, CASE WHEN lang = 'es' THEN 'malformed_json'
          WHEN lang = 'de' THEN 'missing_fields'
          WHEN lang = 'fr' AND length(text) NOT BETWEEN 1 AND 2000
            THEN 'invalid_story:description,data_classification'
          WHEN lang = 'fr' THEN 'invalid_story:data_classification'
          WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 'invalid_story:description' END AS reason FROM documents),
      k AS (SELECT *, CASE WHEN reason IS NULL THEN 'PARSING' WHEN reason LIKE 'invalid_story%' THEN 'FAILED' END AS mark FROM d)
    SELECT 'line' AS sink, CASE WHEN reason IS NULL THEN 'good' ELSE 'rejected' END AS kind, reason AS detail, count(*) AS n FROM k GROUP BY ALL
    UNION ALL SELECT 'event', CASE mark WHEN 'FAILED' THEN 'RUN_FAILED' ELSE 'PARSING_STARTED' END,
      coalesce('{"error":"' || reason || '"}', '{}'), count(*) FROM k WHERE mark IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'run', coalesce(mark, 'PENDING'), CASE WHEN mark = 'FAILED' THEN 'Story validation failed: ' || reason END, count(*)
      FROM k GROUP BY ALL""",
)
def intake_records(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of the requests, the second one twice, and a table with a run for every document: what the
    lines, the audit log and the runs hold afterwards."""
    source, checkpoint = fresh_path(spark, "intake-in"), fresh_path(spark, "intake-log")
    sinks = intake.IntakeSinks(*[fresh_path(spark, f"intake-{name}") for name in ("lines", "audit", "runs")])
    pending = table(spark, folder, "documents").select(
        F.concat(F.lit("run-"), F.col("doc_id").cast("string")).alias("run_id"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("started_at"),
    )
    versioned.write(pending, sinks.runs, buckets=8, bucket_by=["run_id"])
    lines = intake_lines(spark, folder)
    early = F.length("value") % 2 == 0
    for part in (lines.filter(early), lines.filter(~early)):
        part.write.mode("append").text(source)
        intake.start_intake_with_records(spark, source, sinks, checkpoint).awaitTermination()
    again = spark.read.text(source).select("value", F.col("_metadata.file_modification_time").alias("received_at"))
    intake.apply_batch(again.filter(~early), 1, sinks, checkpoint)
    found = [
        intake.read_lines(spark, sinks).select(F.lit("line").alias("sink"), F.col("verdict").alias("kind"), F.col("reason").alias("detail")),
        audit.read_audit_log(spark, sinks.audit).select(F.lit("event"), "event_type", "payload"),
        versioned.read(spark, sinks.runs).select(F.lit("run"), "status", "error_message"),
    ]
    return reduce(DataFrame.union, found).groupBy("sink", "kind", "detail").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x2_audit_log",
    """SELECT event_type, count(*) AS events, count(DISTINCT run_id) AS runs FROM
      (SELECT DISTINCT event_type, user_id AS run_id, CAST(round_even(epoch_us(ts) / 1000000.0, 0) AS BIGINT) AS second
        FROM events WHERE event_type <> 'error'
      UNION SELECT event_type, user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 FROM events
        WHERE event_type <> 'error') GROUP BY 1""",
)
def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches: first the events of the later hours, and for every event one just before the next
    midnight; then the earlier ones, hours late, many of both a second time, and for every event one just
    after that midnight, which has the same id as the one before it."""
    source, target = fresh_path(spark, "audit-in"), fresh_path(spark, "audit-out")
    log = fresh_path(spark, "audit-log")
    events = table(spark, folder, "events").select(
        "event_type", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    midnight = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
    before = events.withColumn("ts", midnight - F.expr("INTERVAL 0.3 SECOND"))
    after = events.withColumn("ts", midnight + F.expr("INTERVAL 0.2 SECOND"))
    late = F.hour("ts") < 12
    repeated = events.filter(late).unionByName(events.filter("event_type <> 'view'")).unionByName(after)
    for part in (events.filter(~late).unionByName(before), repeated):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        audit.start_audit_log(stream, target, log, known=KINDS).awaitTermination()
    return audit.read_audit_log(spark, target).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("run_id").alias("runs")
    )
