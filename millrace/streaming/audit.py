"""The append-only audit log: known event types only, one event per id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.records import AUDIT_EVENTS, audit_id
from millrace.sources.shared import cut_lineage, delete_folder, folder_exists, temporary_copies

# Partition columns of the log.
BUCKET, BATCH = "_bucket", "_batch"

#: Folders that the ids are dealt to by their hash. It holds for the life of a log.
BUCKETS = 16


def audit_events(events: DataFrame, known: Sequence[str] = AUDIT_EVENTS) -> DataFrame:
    """Events (event_type, run_id, ts) of a known type with their id. The id carries its second,
    so two events of one type and run within a second are one event."""
    return events.filter(F.col("event_type").isin(*known)).withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "id": audit_id(F.col("event_type"), F.col("run_id"), F.col("ts")),
        }
    )


def first_events(events: DataFrame, known: Sequence[str] = AUDIT_EVENTS) -> DataFrame:
    """Batch form: one event per id."""
    return audit_events(events, known).dropDuplicates(["id"])


def bucket_of(event_id: Column, buckets: int = BUCKETS) -> Column:
    """Where an id is looked for, whatever its day."""
    return F.pmod(F.xxhash64(event_id), F.lit(buckets)).cast("int")


def append_new(
    batch: DataFrame, target: str, number: int, known: Sequence[str] = AUDIT_EVENTS, buckets: int = BUCKETS
) -> None:
    """Append the events of a batch whose id the log doesn't hold yet, however late they come.

    The log is kept in folders by the hash of the id, and in each by batch. A batch reads the ids of the
    folders that its own ids belong to and lists no others, so few new events look into few folders.
    A batch that is repeated after a failure replaces what its first attempt wrote: it gets the same
    rows, because its own earlier rows don't count as known. The batch is computed once.
    """
    spark = batch.sparkSession
    base = target.rstrip("/")
    with temporary_copies(spark):
        events = first_events(batch, known).withColumn(BUCKET, bucket_of(F.col("id"), buckets))
        events = cut_lineage(events, "audit-batch")
        touched = [r[0] for r in events.select(BUCKET).distinct().collect()]  # at most `buckets`
        folders = [f for f in (f"{base}/{BUCKET}={b}" for b in touched) if folder_exists(spark, f)]
        if folders:
            reader = spark.read.schema(f"id string, {BUCKET} int, {BATCH} long").option("basePath", base)
            logged = reader.parquet(*folders).where(F.col(BATCH) != number).select("id", BUCKET)
            events = events.join(logged, ["id", BUCKET], "left_anti").select(*events.columns)
        for folder in folders:  # of a first attempt
            delete_folder(spark, f"{folder}/{BATCH}={number}")
        spread = events.withColumn(BATCH, F.lit(number).cast("long")).hint("rebalance", F.col(BUCKET))
        spread.sortWithinPartitions(BUCKET, "id").write.mode("append").partitionBy(BUCKET, BATCH).parquet(base)


def read_audit_log(spark: SparkSession, target: str) -> DataFrame:
    """The events of the log."""
    return spark.read.parquet(target).drop(BUCKET, BATCH)


def start_audit_log(
    events: DataFrame,
    target: str,
    checkpoint: str,
    *,
    known: Sequence[str] = AUDIT_EVENTS,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append a stream of events to a Parquet log, each id once.

    Repeats are found in the log itself, so no event is too late and the stream keeps no state.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, number: append_new(batch, target, number, known, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
