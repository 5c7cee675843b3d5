"""Versioned tables: update, delete, merge, time travel and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import layout, mutations
from millrace.plans import runner
from millrace.plans.spec import job_of
from millrace.sources import versioned
from millrace.sources.shared import fresh_path
from registry import query
from registry.views import orders, rounded, sql, table

_COLUMNS = ("order_id", "customer_id", "status", "amount", "priority")

# The table: all orders with some priorities missing.
_TARGET = """t AS (SELECT order_id, customer_id, status, order_amount AS amount,
    nullif(priority, '5-LOW') AS priority FROM v_orders)"""

# The changes: shipped orders doubled, others with new priorities; canceled ones get a key that the
# table lacks, so they are new and leave orders of the table unmatched.
_SOURCE = """s AS (SELECT CASE WHEN status = 'P' THEN -order_id ELSE order_id END AS order_id, customer_id, status,
    CAST(CASE WHEN status = 'O' THEN order_amount * 2 ELSE order_amount END AS DECIMAL(18,2)) AS amount,
    nullif(priority, '1-URGENT') AS priority FROM v_orders)"""


def _new_key() -> F.Column:
    return F.when(F.col("status") == "P", -F.col("order_id")).otherwise(F.col("order_id"))


def _target(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).select(
        "order_id",
        "customer_id",
        "status",
        F.col("order_amount").alias("amount"),
        F.nullif(F.col("priority"), F.lit("5-LOW")).alias("priority"),
    )


def _source(spark: SparkSession, folder: str) -> DataFrame:
    doubled = F.when(F.col("status") == "O", F.col("order_amount") * 2).otherwise(F.col("order_amount"))
    return orders(spark, folder).select(
        _new_key().alias("order_id"),
        "customer_id",
        "status",
        doubled.cast("decimal(18,2)").alias("amount"),
        F.nullif(F.col("priority"), F.lit("1-URGENT")).alias("priority"),
    )


def _sql(body: str) -> str:
    return sql(f"WITH {_TARGET}, {_SOURCE} {body}", "orders")


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df.select(*_COLUMNS), 2, "amount")


_SHOW = "order_id, customer_id, status, round(CAST(amount AS DOUBLE), 2) AS amount, priority"

_MERGED = f"""SELECT {_SHOW} FROM (
    SELECT t.order_id, coalesce(s.customer_id, t.customer_id) AS customer_id,
      coalesce(s.status, t.status) AS status, coalesce(s.amount, t.amount) AS amount,
      CASE WHEN s.order_id IS NOT NULL THEN s.priority ELSE t.priority END AS priority
    FROM t LEFT JOIN s ON t.order_id = s.order_id
    UNION ALL SELECT * FROM s WHERE order_id NOT IN (SELECT order_id FROM t))"""


@query("k2_t1_create_and_read", _sql(f"SELECT {_SHOW} FROM t"))
def create_and_read(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path, mode="create", partition_by=["status"])
    return _shown(versioned.read(spark, path))


@query(
    "k3_overwrite_schema",
    _sql("SELECT priority, count(*) AS orders FROM s GROUP BY 1"),
)
def overwrite_schema(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path)
    counted = _source(spark, folder).groupBy("priority").agg(F.count(F.lit(1)).alias("orders"))
    versioned.write(counted, path, overwrite_schema=True)
    return versioned.read(spark, path)


@query(
    "t1_append_with_new_column",
    _sql(
        f"""SELECT {_SHOW}, flag FROM (SELECT *, CAST(NULL AS BOOLEAN) AS flag FROM t
        UNION ALL SELECT order_id, customer_id, status, amount, NULL AS priority,
          amount > 100000 AS flag FROM s)"""
    ),
)
def append_with_new_column(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path, partition_by=["status"])
    added = (
        _source(spark, folder)
        .drop("priority")
        .withColumn("flag", F.col("amount") > 100000)
    )
    versioned.write(added, path, mode="append")
    return rounded(versioned.read(spark, path), 2, "amount")


@query(
    "t2_update_where",
    _sql(
        """SELECT order_id, customer_id,
          CASE WHEN priority < '3' THEN 'late' ELSE status END AS status,
          round(CAST(CASE WHEN priority < '3' THEN amount + customer_id ELSE amount END AS DOUBLE), 2)
            AS amount, priority FROM t"""
    ),
)
def update_where(spark: SparkSession, folder: str) -> DataFrame:
    changed = mutations.update_where(
        _target(spark, folder), "priority < '3'", {"status": "'late'", "amount": "amount + customer_id"}
    )
    return _shown(changed)


@query("t3_delete_where", _sql(f"SELECT {_SHOW} FROM t WHERE NOT coalesce(priority < '3', false)"))
def delete_where(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(mutations.delete_where(_target(spark, folder), "priority < '3'"))


@query("t4_merge_upsert", _sql(_MERGED))
def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        mutations.merge_rows(_target(spark, folder), _source(spark, folder), ["order_id"])
    )


@query(
    "t4b_merge_update_columns",
    _sql(
        f"""SELECT {_SHOW} FROM (
        SELECT t.order_id, t.customer_id, t.status, coalesce(s.amount, t.amount) AS amount, t.priority
        FROM t LEFT JOIN s ON t.order_id = s.order_id)"""
    ),
)
def merge_update_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        mutations.merge_rows(
            _target(spark, folder),
            _source(spark, folder),
            ["order_id"],
            update_columns=["amount"],
            insert_all=False,
        )
    )


def _hide_key(text: str, priority: str) -> str:
    """The view text with the key missing where the order has the priority."""
    key = f"CASE WHEN priority <> '{priority}' THEN order_id END"
    return text.replace("-order_id ELSE order_id END AS", f"-{key} ELSE {key} END AS").replace(
        "SELECT order_id,", f"SELECT {key} AS order_id,"
    )


@query(
    "t4c_merge_null_keys",
    sql(
        f"""WITH {_hide_key(_TARGET, "2-HIGH")}, {_hide_key(_SOURCE, "3-MEDIUM")}
        SELECT coalesce(order_id, -1) AS order_id, {_SHOW.removeprefix("order_id, ")} FROM (
          SELECT t.order_id, coalesce(s.customer_id, t.customer_id) AS customer_id,
            coalesce(s.status, t.status) AS status, coalesce(s.amount, t.amount) AS amount,
            CASE WHEN s.order_id IS NOT NULL THEN s.priority ELSE t.priority END AS priority
          FROM t LEFT JOIN s ON t.order_id = s.order_id
          UNION ALL SELECT * FROM s
            WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.order_id = s.order_id))""",
        "orders",
    ),
)
def merge_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    base = orders(spark, folder)
    target = base.withColumn("order_id", F.when(F.col("priority") != "2-HIGH", F.col("order_id")))
    source = base.withColumn("order_id", F.when(F.col("priority") != "3-MEDIUM", F.col("order_id")))

    def shaped(df: DataFrame, key: F.Column, amount: F.Column, hidden: str) -> DataFrame:
        return df.select(
            key.alias("order_id"),
            "customer_id",
            "status",
            amount.cast("decimal(18,2)").alias("amount"),
            F.nullif(F.col("priority"), F.lit(hidden)).alias("priority"),
        )

    doubled = F.when(F.col("status") == "O", F.col("order_amount") * 2).otherwise(F.col("order_amount"))
    merged = mutations.merge_rows(
        shaped(target, F.col("order_id"), F.col("order_amount"), "5-LOW"),
        shaped(source, _new_key(), doubled, "1-URGENT"),
        ["order_id"],
    )
    return _shown(merged.withColumn("order_id", F.coalesce("order_id", F.lit(-1))))


@query("t4d_merge_delete_unmatched", _sql(f"SELECT {_SHOW} FROM s"))
def merge_delete_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        mutations.merge_rows(
            _target(spark, folder), _source(spark, folder), ["order_id"], delete_unmatched=True
        )
    )


@query("t6_merge_target", _sql(_MERGED))
def merge_target(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    _target(spark, folder).createOrReplaceTempView("v_merge_target")
    _source(spark, folder).createOrReplaceTempView("v_merge_source")
    for view in ("v_merge_target", "v_merge_source"):
        job = job_of(
            {
                "id": "merge_target",
                "source": {"table": view},
                "target": {"path": path, "format": "delta"},
                "delta_operation": "merge",
                "transformations": [{"operation": "upsert", "params": {"merge_keys": ["order_id"]}}],
            }
        )
        runner.run(spark, job)
    return _shown(versioned.read(spark, path))


@query("s6_t7_time_travel", _sql(f"SELECT {_SHOW} FROM t"))
def time_travel(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path)
    versioned.update(spark, path, "status = 'O'", {"amount": "amount * 1.1"})
    versioned.delete(spark, path, "priority IS NULL")
    return _shown(versioned.read(spark, path, version=0))


@query(
    "t8_history",
    """SELECT * FROM (VALUES (0, 'CREATE', (SELECT count(*) FROM orders), '0'),
      (1, 'DELETE', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P'), '1'),
      (2, 'MERGE', (SELECT count(*) + count(*) FILTER (o_orderstatus = 'P') - count(*) FILTER (o_orderstatus = 'P')
        FROM orders), '2')) AS t(version, operation, written_rows, parts)""",
)
def history(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path, mode="create")
    versioned.delete(spark, path, "status = 'P'")
    versioned.merge(_source(spark, folder), path, ["order_id"])
    return versioned.history(spark, path).select(
        F.col("version").cast("int").alias("version"), "operation", "written_rows",
        F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"),
    )


@query("t9_compact", _sql(f"SELECT {_SHOW} FROM t"))
def compact(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path)
    versioned.compact(spark, path, ["customer_id", "order_id"])
    return _shown(versioned.read(spark, path))


@query(
    "t9_skipped_files",
    """SELECT 'l_partkey' AS column, count(*) AS matching, 'few' AS touched FROM lineitem
      WHERE l_partkey <= (SELECT max(l_partkey) // 50 FROM lineitem)
    UNION ALL SELECT 'l_extendedprice', count(*), 'few' FROM lineitem
      WHERE l_extendedprice >= (SELECT 0.95 * max(l_extendedprice) FROM lineitem)""",
)
def skipped_files(spark: SparkSession, folder: str) -> DataFrame:
    """Items clustered by two columns in 64 files or so: a filter on either column touches `few`, less than
    a third of the files, by the ranges that the written files hold."""
    path = fresh_path(spark, "table")
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    ends = df.agg(F.floor(F.max("l_partkey") / 50), F.lit(0.95) * F.max("l_extendedprice"), F.max("l_extendedprice")).first()
    versioned.write(df, path)
    versioned.compact(spark, path, ["l_partkey", "l_extendedprice"], layout.output_bytes(versioned.read(spark, path)) / 64 / layout.MEGABYTE)
    zones = versioned.zone_map(spark, path, ["l_partkey", "l_extendedprice"])
    touched = layout.files_touched(zones, {"l_partkey": (0, ends[0]), "l_extendedprice": (ends[1], ends[2])})
    rows = versioned.read(spark, path).agg(
        F.count_if(F.col("l_partkey") <= ends[0]).alias("l_partkey"), F.count_if(F.col("l_extendedprice") >= ends[1]).alias("l_extendedprice")
    )
    counted = rows.unpivot([], ["l_partkey", "l_extendedprice"], "column", "matching")
    few = F.when(F.col("touched") * 3 <= F.col("files"), "few").otherwise(F.concat_ws("/", "touched", "files"))
    return counted.join(touched, "column").select("column", "matching", few.alias("touched"))


@query(
    "t11_null_preserving_update",
    _sql(
        f"""SELECT {_SHOW} FROM (
        SELECT t.order_id, coalesce(s.customer_id, t.customer_id) AS customer_id,
          coalesce(s.status, t.status) AS status, coalesce(s.amount, t.amount) AS amount,
          coalesce(s.priority, t.priority) AS priority
        FROM t LEFT JOIN s ON t.order_id = s.order_id)"""
    ),
)
def null_preserving(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(mutations.patch_rows(_target(spark, folder), _source(spark, folder), ["order_id"]))


@query(
    "t12_insert_or_refresh",
    _sql(
        f"""SELECT {_SHOW} FROM (
        SELECT t.order_id, t.customer_id, coalesce(s.status, t.status) AS status,
          coalesce(s.amount, t.amount) AS amount, t.priority
        FROM t LEFT JOIN s ON t.order_id = s.order_id
        UNION ALL SELECT * FROM s WHERE order_id NOT IN (SELECT order_id FROM t))"""
    ),
)
def insert_or_refresh(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        mutations.merge_rows(
            _target(spark, folder),
            _source(spark, folder),
            ["order_id"],
            update_columns=["status", "amount"],
        )
    )


def _changed_table(spark: SparkSession, folder: str) -> str:
    """A stored table, partitioned by status."""
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path, mode="create", partition_by=["status"])
    return path


@query(
    "t2_stored_update",
    _sql(
        f"""SELECT {_SHOW} FROM (SELECT * REPLACE (CASE WHEN status = 'O' AND priority < '3'
          THEN CAST(amount + customer_id AS DECIMAL(18,2)) ELSE amount END AS amount) FROM t)"""
    ),
)
def stored_update(spark: SparkSession, folder: str) -> DataFrame:
    path = _changed_table(spark, folder)
    versioned.update(
        spark, path, "status = 'O' AND priority < '3'", {"amount": "CAST(amount + customer_id AS DECIMAL(18,2))"}
    )
    return _shown(versioned.read(spark, path))


@query(
    "t3_stored_delete",
    _sql(f"SELECT {_SHOW} FROM t WHERE NOT coalesce(status = 'P' AND customer_id % 2 = 0, false)"),
)
def stored_delete(spark: SparkSession, folder: str) -> DataFrame:
    path = _changed_table(spark, folder)
    versioned.delete(spark, path, "status = 'P' AND customer_id % 2 = 0")
    return _shown(versioned.read(spark, path))


@query("t4_stored_merge", _sql(_MERGED))
def stored_merge(spark: SparkSession, folder: str) -> DataFrame:
    path = _changed_table(spark, folder)
    versioned.merge(_source(spark, folder), path, ["order_id"])
    return _shown(versioned.read(spark, path))


@query(
    "t4_bucketed_merge",
    _sql(
        f"""SELECT {_SHOW}, written_rows FROM (
          SELECT order_id, customer_id, 'changed' AS status, CAST(amount + 1 AS DECIMAL(18,2)) AS amount, priority FROM t
            WHERE order_id = (SELECT max(order_id) FROM t)
          UNION ALL SELECT * FROM t WHERE order_id <> (SELECT max(order_id) FROM t)
          UNION ALL SELECT -1, NULL, 'new', 1, NULL), (SELECT 'few' AS written_rows)"""
    ),
)
def bucketed_merge(spark: SparkSession, folder: str) -> DataFrame:
    """One changed and one new order: of 64 buckets at most the two that hold them are written anew, `few`
    being less than a tenth of the rows."""
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path, bucket_by=["order_id"], buckets=64)
    last = _target(spark, folder).orderBy(F.col("order_id").desc()).limit(1)
    changed = last.withColumns({"status": F.lit("changed"), "amount": (F.col("amount") + 1).cast("decimal(18,2)")})
    new = spark.range(1).select(
        F.lit(-1).cast("long").alias("order_id"), F.lit(None).cast("long").alias("customer_id"), F.lit("new").alias("status"),
        F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("priority"),
    )
    versioned.merge(changed.unionByName(new), path, ["order_id"])
    written = versioned.full_history(spark, path).orderBy("version")
    told = written.agg(F.min_by("written_rows", "version").alias("all"), F.max_by("written_rows", "version").alias("last"))
    few = told.select(F.when(F.col("last") * 10 < F.col("all"), "few").otherwise(F.col("last").cast("string"))).scalar()
    return _shown(versioned.read(spark, path)).withColumn("written_rows", few)


@query(
    "t10_vacuum",
    """SELECT 'rows of version 1' AS what, count(*) AS n FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'rows of version 2', 2 * count(*) FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'kept within retention', 0 UNION ALL SELECT 'removed part', 0""",
)
def vacuum(spark: SparkSession, folder: str) -> DataFrame:
    """Within the retention nothing goes; without one, the part that only version 0 uses."""
    path = fresh_path(spark, "table")
    versioned.write(_target(spark, folder), path)
    versioned.delete(spark, path, "status = 'P'")
    kept = len(versioned.vacuum(spark, path, dry_run=False))
    versioned.write(versioned.read(spark, path), path, mode="append")
    gone = versioned.vacuum(spark, path, retention_hours=0, dry_run=False)
    told = [("kept within retention", kept), *(("removed part", int(n)) for n in gone)]
    found = spark.createDataFrame(told, "what string, n long")
    for number in (1, 2):
        rows = versioned.read(spark, path, number).agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(rows.withColumn("what", F.lit(f"rows of version {number}")))
    return found


@query(
    "t4e_merge_repeated_keys",
    """SELECT 'refused' AS outcome, count(*) AS repeated FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""",
)
def merge_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A source with several rows per key is refused; counted are the keys that repeat."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    path = fresh_path(spark, "table")
    versioned.write(rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), path)
    try:
        versioned.merge(rows, path, ["o_custkey"])
        outcome = "accepted"
    except ValueError:
        outcome = "refused"
    repeated = rows.groupBy("o_custkey").count().where("count > 1")
    return repeated.agg(F.count(F.lit(1)).alias("repeated")).withColumn("outcome", F.lit(outcome))
