"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm import (
    chat, exact_dedup, lm_scoring, mixing, packing, pii, quality_rules, simhash, token_counts, warc,
)
from millrace.llm.queries import tokenizer
from millrace.sources.shared import fresh_path

CLASHING = "id text_key row_key fp size copies kept sequence_id length rank term near block held document n_words".split()
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()),
    *(StructField(c, StringType()) for c in CLASHING),
])
LONG = "word " * 60_000 + "x" * 20_000 + "1" * 20_000
ROWS = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one", "b"), (5, "one two", "b"), (5, "one two", "b"),
    (None, "no id at all here", None), (6, "same text", "a"), (7, "same  text", "a"), (8, "same text", None),
    (9, LONG, "a"), (10, "é 🙂 \x00 mail a@b.cc +1 (555) 123-4567", "c"), (11, "One Two", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *("clash" for _ in CLASHING)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def run(name, docs, spark):
    if name == "quality":
        return quality_rules.ledger(quality_rules.measurements(docs))
    if name == "tokens":
        return token_counts.count_tokens(docs, tokenizer(), fresh_path(spark, "test-cache"))
    if name == "exact":
        return exact_dedup.exact_groups(docs)
    if name == "near":
        return simhash.near_groups(docs)
    if name == "mixing":
        return mixing.mix(mixing.sizes(docs)).withColumnRenamed("id", "doc_id")
    if name == "packing":
        return packing.place(packing.pieces(docs, tokenizer(), 2, 1024).drop("ids"), ["doc_id", "piece"], 1024)
    if name == "pii":
        return pii.find(docs).withColumnRenamed("id", "doc_id")
    if name == "lm":
        return lm_scoring.score(docs, F.col("doc_id") == 4)
    if name == "warc":
        pages = docs.select("doc_id", F.col("text").alias("html"), F.col("source").alias("url"))
        archives = warc.write_archives(pages, fresh_path(spark, "test-warc"), id_col="doc_id")
        return warc.records_read(warc.read_archives(archives)).withColumnRenamed("id", "doc_id")
    raise ValueError(name)


ALL = ["quality", "tokens", "exact", "near", "mixing", "packing", "pii", "lm", "warc"]


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, none, name):
    assert run(name, none, spark).collect() == []


@pytest.mark.parametrize("name", ALL)
def test_every_row_comes_back(spark, docs, name):
    found = [r["doc_id"] for r in run(name, docs, spark).collect()]
    expected = [i for i, _, _ in ROWS]
    if name == "packing":
        assert set(found) == set(expected)
    else:
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_quality(spark, docs):
    found = by_id(run("quality", docs, spark))
    assert [found[i].n_words for i in (1, 2, 3, 4, 9)] == [0, 0, 0, 1, 60_001]
    assert found[9].n_repeat_words == 60_000 and found[1].failed_bits & 1


def test_tokens(spark, docs):
    found = by_id(run("tokens", docs, spark))
    assert (found[1].n_bytes, found[1].n_tokens) == (0, 0) and found[9].n_bytes == len(LONG)
    assert found[6].n_tokens == found[8].n_tokens


def test_exact(spark, docs):
    found = by_id(run("exact", docs, spark))
    assert [(found[i].keep_id, found[i].group_size, found[i].kept) for i in (1, 2, 3)] == [(3, 3, False), (3, 3, False), (3, 3, True)]
    assert [found[i].keep_id for i in (6, 7, 8)] == [7, 7, 7] and found[5].group_size == 2 and found[5].kept
    assert found[None].keep_id is None and found[None].kept


def test_near(spark, docs):
    found = by_id(run("near", docs, spark))
    assert {found[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {found[i].component_id for i in (1, 2, 3)} == {1}
    assert found[11].component_id == 5 and found[8].component_id == 6 and found[None].component_id is None


def test_mixing(spark, docs):
    found = by_id(run("mixing", docs, spark))
    assert found[1].size == 0 and found[1].taken == 0 and found[None].size == 5
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found.values())


def test_packing(spark, docs):
    found = run("packing", docs, spark).collect()
    assert [(r.length, r.start) for r in found if r.doc_id == 1] == [(1, 0)]
    assert sum(r.doc_id == 5 for r in found) == 2
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)


def test_pii(spark, docs):
    found = by_id(run("pii", docs, spark))
    assert [len(found[10][k]) for k in pii.KINDS] == [1, 0, 0, 1, 0] and not any(found[1][k] for k in pii.KINDS)


def test_lm(spark, docs):
    found = by_id(run("lm", docs, spark))
    assert found[4].held_out and not found[None].held_out
    assert found[1].n_tokens == 1 and found[1].score == found[2].score and found[9].n_tokens == 60_002


def test_warc(spark, docs):
    found = by_id(run("warc", docs, spark))
    assert (found[1].payload_bytes, found[1].record_type, found[1].refers_to) == (0, "revisit", 2)
    assert found[8].record_type == "response" and found[6].refers_to == 8 and found[9].payload_bytes == len(LONG)


def test_chat(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).collect() == []
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (None, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    found = by_id(chat.format_conversations(turns), "conv_id")
    assert found[1].valid and found[1].n_turns == 2 and found[1].error_turn is None
    assert not found[None].valid and found[None].n_turns == 1 and (found[2].valid, found[2].error_turn) == (False, 1)
