"""Reading and writing files, schemas and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.runner import build, run
from millrace.plans.spec import job_of
from millrace.sources import files, schema
from millrace.sources.files import Dataset
from millrace.sources.shared import fresh_path
from registry import query
from registry.views import customers, orders, rounded, sql, table

ORDER_SCHEMA = [
    {"name": "o_orderkey", "type": "LongType", "nullable": False},
    {"name": "o_orderstatus", "type": "StringType"},
    {"name": "o_totalprice", "type": "DoubleType"},
]


@query(
    "s1_batch_scan",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def batch_scan(spark: SparkSession, folder: str) -> DataFrame:
    source = Dataset(
        path=f"{folder}/orders.parquet", options={"mergeSchema": "false"}, schema=ORDER_SCHEMA
    )
    return files.read(spark, source)


@query(
    "s2_parquet_scan",
    "SELECT c_mktsegment, count(*) AS customers, round(sum(CAST(c_acctbal AS DECIMAL(18,2)))"
    "::DOUBLE, 2) AS balance FROM customer GROUP BY 1",
)
def parquet_scan(spark: SparkSession, folder: str) -> DataFrame:
    df = files.read_path(spark, f"{folder}/customer.parquet")
    return rounded(
        df.groupBy("c_mktsegment").agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance"),
        ),
        2,
        "balance",
    )


def _round_trip(spark: SparkSession, df: DataFrame, fmt: str, options: dict | None = None) -> DataFrame:
    path = fresh_path(spark, fmt)
    files.write(df, Dataset(path=path, format=fmt, options=options or {}))
    return files.read(spark, Dataset(path=path, format=fmt, schema=df.schema, options=options or {}))


@query("s3_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, table(spark, folder, "customer"), "csv", {"delimiter": ";"})


@query("s4_json_scan", "SELECT conv_id, turn, role, text FROM conversations")
def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, table(spark, folder, "conversations"), "json")


@query("s5_orc_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def orc_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, table(spark, folder, "supplier"), "orc")


@query(
    "s8_discover_tables",
    """SELECT t AS table_name, 'csv' AS format, c AS column_name, k AS column_type FROM (VALUES
      ('customer', 'c_custkey', 'int'), ('customer', 'c_name', 'string'), ('customer', 'c_nationkey', 'int'),
      ('customer', 'c_acctbal', 'double'), ('customer', 'c_mktsegment', 'string'), ('supplier', 's_suppkey', 'int'),
      ('supplier', 's_name', 'string'), ('supplier', 's_nationkey', 'int'), ('supplier', 's_acctbal', 'double'),
      ('orders', 'o_orderkey', 'int'), ('orders', 'o_custkey', 'int'), ('orders', 'o_orderstatus', 'string'),
      ('orders', 'o_totalprice', 'double'), ('orders', 'o_orderdate', 'timestamp'), ('orders', 'o_orderpriority', 'string'),
      ('late', 'key', 'bigint'), ('late', 'balance', 'string')) AS v(t, c, k)""",
)
def discover(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "crawl")
    for name in ("customer", "supplier", "orders"):
        files.write(table(spark, folder, name), Dataset(path=f"{root}/{name}", format="csv"))
    late = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("balance"))
    odd = late.agg(F.lit("9999999999").alias("key"), F.lit("N/A").alias("balance"))  # one row of many, in the last file
    for name, part in (("a", late), ("b", odd)):
        files.write(part, Dataset(path=f"{root}/late/{name}", format="csv"))
    found = schema.discover_tables(spark, root)
    return found.select("name", "format", F.explode("columns").alias("column")).select(
        "name", "format", "column.name", "column.type"
    ).toDF("table_name", "format", "column_name", "column_type")


ORDER_LINE = [
    {"name": "order_key", "type": "LongType", "nullable": False},
    {"name": "status", "type": "StringType", "nullable": False},
    {"name": "total", "type": "decimal(18,2)"},
    {"name": "day", "type": "DateType"},
]


def _quarantine_sql(missing_fields: str) -> str:
    return f"""SELECT coalesce(reason, 'good') AS verdict, count(*) AS records, sum(o_orderkey)::BIGINT AS keys,
      round(sum(CASE WHEN reason IS NULL THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 2)::DOUBLE AS total
    FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN '{missing_fields}'
        WHEN o_orderpriority = '2-HIGH' THEN 'malformed' WHEN o_orderpriority = '5-LOW' THEN 'missing:status' END AS reason
      FROM orders) GROUP BY ALL"""


def _order_records(spark: SparkSession, folder: str) -> tuple[DataFrame, F.Column]:
    """Orders as text: urgent ones lose their last fields, high ones have no number for a total, low ones
    no status; and the day of the order."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "n/a")
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.col("o_orderpriority") == "1-URGENT").alias("cut"),
    )
    return rows, F.col("cut")


def _by_verdict(judged: DataFrame, key_in_text: F.Column) -> DataFrame:
    """What was kept and what was set aside, from one judged read."""
    good = files.fitting(judged).agg(
        F.lit("good").alias("verdict"), F.count(F.lit(1)).alias("records"), F.sum("order_key").alias("keys"), F.sum("total").alias("total")
    )
    bad = files.rejected(judged).groupBy(F.col("reason").alias("verdict")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(key_in_text.cast("long")).alias("keys"), F.lit(None).cast("decimal(28,2)").alias("total")
    )
    return good.unionByName(bad).withColumn("total", F.col("total").cast("double"))


@query("s7_quarantine_csv", _quarantine_sql("malformed"))
def quarantine_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows, cut = _order_records(spark, folder)
    line = F.concat_ws(",", "order_key", F.coalesce("status", F.lit("")), "total", "day")
    path = fresh_path(spark, "lines")
    rows.select(F.when(cut, F.concat_ws(",", "order_key", "status")).otherwise(line).alias("value")).write.text(path)
    source = Dataset(path=path, format="csv", schema=ORDER_LINE, options={"header": "false"})
    key = F.coalesce(F.get_json_object("record", "$.order_key"), F.split_part("record", F.lit(","), F.lit(1)))
    return _by_verdict(files.read_judged(spark, source), key)


@query("s7_quarantine_json", _quarantine_sql("missing:status"))
def quarantine_json(spark: SparkSession, folder: str) -> DataFrame:
    """In JSON a record without its last fields is whole; the missing status is what is wrong with it."""
    rows, cut = _order_records(spark, folder)
    whole = F.struct(F.col("order_key").cast("long").alias("order_key"), "status", "total", "day")
    part = F.to_json(F.struct(F.col("order_key").cast("long").alias("order_key")))
    path = fresh_path(spark, "records")
    rows.select(F.when(cut, part).otherwise(F.to_json(whole)).alias("value")).write.text(path)
    source = Dataset(path=path, format="json", schema=ORDER_LINE)
    return _by_verdict(files.read_judged(spark, source), F.get_json_object("record", "$.order_key"))


@query(
    "s9_secondary_table",
    sql(
        """SELECT o_orderpriority, count(*) AS orders, count(c_name) AS known
        FROM orders LEFT JOIN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS o_custkey, c_name
          FROM customer) USING (o_custkey) GROUP BY 1"""
    ),
)
def secondary_table(spark: SparkSession, folder: str) -> DataFrame:
    job = job_of(
        {
            "id": "secondary_table",
            "source": f"{folder}/orders.parquet",
            "transformations": [
                {
                    "operation": "join",
                    "params": {
                        "right_path": f"{folder}/customer.parquet",
                        "right_format": "parquet",
                        "join_keys": ["o_custkey"],
                        "join_type": "left",
                        "right_steps": [
                            {
                                "operation": "enrich",
                                "column": "o_custkey",
                                "value": "CASE WHEN c_acctbal > 0 THEN c_custkey END",
                            },
                        ],
                    },
                },
                {
                    "operation": "aggregate",
                    "params": {
                        "group_by": ["o_orderpriority"],
                        "aggregations": [
                            {"function": "count", "column": "*", "alias": "orders"},
                            {"function": "count", "column": "c_name", "alias": "known"},
                        ],
                    },
                },
            ],
        }
    )
    return build(spark, job)


@query("k1_generic_sink", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def generic_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "sink")
    target = Dataset(path=path, partition_by=("p_type",))
    files.write(table(spark, folder, "part"), target)
    return files.read(spark, Dataset(path=path)).select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@query(
    "k4_append",
    "SELECT o_orderstatus, count(*) AS rows FROM (SELECT * FROM orders UNION ALL "
    "SELECT * FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
)
def append(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "append")
    df = table(spark, folder, "orders")
    files.write(df, Dataset(path=path))
    files.write(df.filter("o_orderstatus = 'O'"), Dataset(path=path, mode="append"))
    return files.read(spark, Dataset(path=path)).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "k5_target_formats",
    """SELECT f.format, count(*) AS rows,
      round(CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS balance
    FROM supplier CROSS JOIN (VALUES ('parquet'), ('csv'), ('json'), ('orc'), ('delta')) AS f(format)
    GROUP BY 1""",
)
def target_formats(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "supplier")
    results = []
    for fmt in files.WRITE_FORMATS:
        path = fresh_path(spark, fmt)
        files.write(df, Dataset(path=path, format=fmt))
        back = files.read(
            spark, Dataset(path=path, format=fmt, schema=None if fmt == "delta" else df.schema)
        )
        results.append(
            back.agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("balance"),
            ).withColumn("format", F.lit(fmt))
        )
    return rounded(schema.merge_schemas(results), 2, "balance")


@query(
    "k6_partitioned_write",
    sql(
        """SELECT year, month, count(*) AS orders,
        round(CAST(sum(order_amount) AS DOUBLE), 2) AS revenue
        FROM v_orders GROUP BY ALL""",
        "orders",
    ),
)
def partitioned_write(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "partitioned")
    files.write(orders(spark, folder), Dataset(path=path, partition_by=("year", "month")))
    return rounded(
        files.read(spark, Dataset(path=path)).groupBy("year", "month").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("order_amount").alias("revenue")
        ),
        2,
        "revenue",
    )


@query(
    "k7_tagged_output",
    """SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
      sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR),
        c_mktsegment)) AS _checksum,
      'confidential' AS _classification, 'run-1' AS _run_id, 'story-1' AS _story_id,
      'staging' AS _environment, 'millrace' AS _managed_by
    FROM customer""",
)
def tagged_output(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return files.tag_rows(
        df,
        run_id="run-1",
        story_id="story-1",
        classification="confidential",
        environment="staging",
    )


@query(
    "p16_p17_standards",
    """SELECT CAST(o_orderkey AS BIGINT) AS order_key,
      CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) AS total_price,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, true AS bad_timestamp
    FROM orders""",
)
def standards(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("OrderKey"),
        F.col("o_totalprice").cast("string").alias("total price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order-date"),
        F.col("o_orderpriority").alias("OrderPriority"),
    )
    typed = schema.standard_types(
        schema.snake_case_columns(df),
        decimals=["total_price"],
        dates=["order_date"],
        timestamps=["order_priority"],
    )
    return typed.select(
        "order_key",
        F.col("total_price").cast("string").alias("total_price"),
        F.col("order_date").cast("string").alias("order_date"),
        F.col("order_priority").isNull().alias("bad_timestamp"),
    )


@query(
    "r3_table_by_name",
    sql("SELECT country, count(*) AS customers FROM v_customers GROUP BY 1", "customers"),
)
def table_by_name(spark: SparkSession, folder: str) -> DataFrame:
    customers(spark, folder).createOrReplaceTempView("v_customers")
    job = job_of(
        {
            "source": {"table": "v_customers"},
            "transformations": [
                {
                    "operation": "aggregate",
                    "params": {
                        "group_by": ["country"],
                        "aggregations": [{"function": "count", "column": "*", "alias": "customers"}],
                    },
                }
            ],
        }
    )
    return build(spark, job)


@query("s10_path_override", "SELECT c_custkey, c_name FROM customer")
def path_override(spark: SparkSession, folder: str) -> DataFrame:
    """A job whose source and target paths are given when it runs."""
    job = job_of({"source": "/no/such/source", "target": "/no/such/target", "transformations": []})
    target = fresh_path(spark, "override")
    run(spark, job, source_path=f"{folder}/customer.parquet", target_path=target)
    return spark.read.parquet(target).select("c_custkey", "c_name")
