import datetime
import unicodedata

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

import registry
from millrace.functions import columns as C
from millrace.functions import text
from millrace.operators import columns as ops
from millrace.sources import schema
from registry import column_queries


def test_pick_column_takes_the_first_present(spark):
    df = spark.createDataFrame([(1, 2)], "order_amount int, total_amount int")
    assert C.pick_column(df, *C.AMOUNT_COLUMNS) == "total_amount"
    assert C.pick_column(df, "x", required=False) is None
    with pytest.raises(ValueError, match="none of the columns"):
        C.pick_column(df, "x", "y")


def test_guarded_ratio_is_zero_without_a_positive_denominator(spark):
    df = spark.createDataFrame([(6, 3), (6, 0), (6, -2), (6, None), (None, 3)], "a int, b int")
    got = [r[0] for r in df.select(C.guarded_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [2.0, 0.0, 0.0, 0.0, None]


def test_safe_ratio_is_null_on_zero(spark):
    df = spark.createDataFrame([(6, 4), (6, 0)], "a int, b int")
    assert [r[0] for r in df.select(C.safe_ratio(F.col("a"), F.col("b"))).collect()] == [1.5, None]


def test_ladder_takes_the_first_rung_that_holds(spark):
    df = spark.createDataFrame([(x,) for x in (12, 10, 9, 5, 4, None)], "x int")
    got = df.select(C.ladder(F.col("x"), [(10, "a"), (5, "b")], "c")).collect()
    assert [r[0] for r in got] == ["a", "a", "b", "b", "c", "c"]


def test_clamp_turns_null_into_the_low_end(spark):
    df = spark.createDataFrame([(-1.0,), (50.0,), (101.0,), (None,)], "x double")
    got = [r[0] for r in df.select(C.clamp(F.col("x"), 0.0, 100.0)).collect()]
    assert got == [0.0, 50.0, 100.0, 0.0]


def test_recency_uses_the_reference_date(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1),)], "d date")
    assert df.select(C.recency_days(F.col("d"), "2024-03-01")).first()[0] == 60
    today = df.select(F.current_date()).first()[0]
    expected = (today - datetime.date(2024, 1, 1)).days
    assert df.select(C.recency_days(F.col("d"))).first()[0] == expected


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("OrderTotal", "order_total"),
        ("order total (USD)", "order_total_usd"),
        ("HTTPStatus", "http_status"),
        ("already_snake", "already_snake"),
        ("x2Y", "x2_y"),
    ],
)
def test_snake_case(name, wanted):
    assert C.snake_case(name) == wanted


def test_snake_case_columns_refuses_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`Order Id` int, orderId int")
    with pytest.raises(ValueError, match="twice"):
        schema.snake_case_columns(df)


def test_fill_nulls_checks_types_and_names_the_column(spark):
    df = spark.createDataFrame([(None, None, None)], "a string, b int, c boolean")
    assert rows(ops.fill_nulls(df, {"a": "x", "b": 1, "c": True})) == [("x", 1, True)]
    with pytest.raises(ValueError, match="'b'"):
        ops.fill_nulls(df, {"b": "UNKNOWN"})
    with pytest.raises(ValueError, match="'z'"):
        ops.fill_nulls(df, {"z": 0})
    with pytest.raises(ValueError, match="'b'"):
        ops.fill_nulls(df, {"b": True})


def test_fill_by_type_and_zero_fill(spark):
    df = spark.createDataFrame(
        [(None, None, None, None)], "a string, b int, c boolean, d decimal(10,2)"
    )
    assert rows(ops.fill_by_type(df)) == [("UNKNOWN", 0, None, 0)]
    assert rows(ops.zero_fill(df)) == [(None, 0, None, 0)]


def test_rename_skips_missing_and_refuses_doubles(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ops.rename_columns(df, {"a": "x", "nope": "y"}).columns == ["x", "b"]
    with pytest.raises(ValueError, match="twice"):
        ops.rename_columns(df, {"a": "b"})


def test_cast_gives_null_for_bad_values(spark):
    df = spark.createDataFrame([("12",), ("x",)], "a string")
    assert [r[0] for r in ops.cast_columns(df, {"a": "int"}).collect()] == [12, None]


def test_derive_columns_see_earlier_ones(spark):
    df = spark.createDataFrame([(2,)], "a int")
    got = ops.derive_columns(df, [("b", "a * 3"), ("c", "b + 1")]).first()
    assert (got.b, got.c) == (6, 7)


def test_substring_filter_is_literal(spark):
    df = spark.createDataFrame([("100%",), ("100x",), ("a_b",), ("axb",)], "s string")
    assert rows(ops.keep_containing(df, "s", "0%")) == [("100%",)]
    assert rows(ops.keep_containing(df, "s", "a_b")) == [("a_b",)]


def test_trim_touches_strings_only(spark):
    df = spark.createDataFrame([("  a ", 1)], "s string, i int")
    assert rows(ops.trim_strings(df)) == [("a", 1)]


def test_trim_removes_every_space_separator(spark):
    edges = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs")
    kept = ["\ta\n", "a\u00a0 \u3000b", "\u200ba", "\u65e5", "", None]
    padded = [(i, None if s is None else edges + s + edges[::-1]) for i, s in enumerate(kept)]
    df = spark.createDataFrame([*padded, (9, edges)], "i int, s string")
    assert rows(ops.trim_strings(df)) == [*enumerate(kept), (9, "")]


def test_string_trim_gives_the_rows_of_its_sql(spark, folder):
    texts = [
        (1, "\u00a0 whole text, not its first word \u3000", " en"),
        (2, "\u2003one", "\u00a0de\u00a0"),
        (2, "\ttwo\n", "fr"),
        (None, None, None),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    df.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    wanted = [
        (1, "whole text, not its first word", "en"),
        (2, "\ttwo\n", "fr"),
        (2, "one", "de"),
        (None, None, None),
    ]
    assert rows(column_queries.string_trim(spark, folder)) == wanted
    assert sorted(con.execute(registry.ORACLES["p15_string_trim"]).fetchall(), key=repr) == wanted


def test_standard_types(spark):
    df = spark.createDataFrame(
        [("1.23456", "2024-02-29", "2024-02-29 10:11:12"), ("x", "2023-02-29", "10:11")],
        "a string, d string, t string",
    )
    got = schema.standard_types(df, decimals=["a"], dates=["d"], timestamps=["t"])
    assert got.schema["a"].dataType.simpleString() == "decimal(18,4)"
    first, second = got.collect()
    assert str(first.a) == "1.2346" and first.d == datetime.date(2024, 2, 29)
    assert first.t == datetime.datetime(2024, 2, 29, 10, 11, 12)
    assert tuple(second) == (None, None, None)


def test_declared_schema_accepts_class_names_and_ddl():
    got = schema.declared_schema(
        [
            {"name": "a", "type": "StringType", "nullable": False},
            {"name": "b", "type": "LongType()"},
            {"name": "c", "type": "decimal(10,2)"},
            {"name": "d", "type": "integer"},
        ]
    )
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in got] == [
        ("a", "string", False),
        ("b", "bigint", True),
        ("c", "decimal(10,2)", True),
        ("d", "int", True),
    ]


def test_conform_and_merge_schemas(spark):
    old = spark.createDataFrame([(1, "x")], "a int, b string")
    new = spark.createDataFrame([("2", 3.0)], "a string, c double")
    got = schema.conform(new, old.schema)
    assert got.schema.simpleString() == "struct<a:int,b:string>" and rows(got) == [(2, None)]
    wide = schema.merge_schemas([old, new.select(F.col("a").cast("int").alias("a"), "c")])
    assert rows(wide) == [(1, "x", None), (2, None, 3.0)]


def test_text_expressions(spark):
    df = spark.createDataFrame(
        [("abc", "a/b//", "2024-01-01 00:00:00", "2024-01-01 00:03:05.9")],
        "s string, p string, t0 string, t1 string",
    )
    got = df.select(
        text.fingerprint(F.col("s")),
        text.fingerprint(F.col("s"), 16),
        text.normal_path(F.col("p")),
        text.duration_label(F.to_timestamp("t0"), F.to_timestamp("t1")),
        text.duration_label(F.to_timestamp("t0"), F.to_timestamp("t0")),
    ).first()
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tuple(got) == (digest, digest[:16], "a/b", "3m 5s", "0s")


def test_row_checksum_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    sums = [r[0] for r in df.select(text.row_checksum(["x", "y"])).collect()]
    assert sums[0] == sums[2] != sums[1]
