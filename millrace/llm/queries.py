"""The operators of this package as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat, exact_dedup, licences, lm_scoring, mixing, packing, periodic_runs, pii, quality_rules, simhash, token_counts, warc, whitening,
)
from millrace.llm.common import stored, table
from millrace.sources.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is the equivalent text for the comparison engine."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n")).strip()
        return function

    return register


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_simhash_vp_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, reach=2)


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache filled by some of the sources, then all documents: what it holds is joined, the rest encoded."""
    docs, cache = table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache")
    token_counts.count_tokens(docs.where(F.pmod(F.xxhash64("source"), F.lit(2)) == 0), tokenizer(), cache)
    counted = token_counts.count_tokens(docs, tokenizer(), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query(
    "op3_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_entropy_balancing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query(
    "op5_quality_rules",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
base AS (
  SELECT doc_id, words, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_alpha
  FROM d),
wins AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(n_words - 1, 1))) AS i FROM base)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT base.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, n_alpha,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered ON base.doc_id = covered.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_alpha < 8 * n_words) AS kept,
       failed_bits, 'standard-1' AS policy,
       CASE failed_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
         WHEN 16 THEN 'word_length' WHEN 32 THEN 'few_letters' END AS only_rule
FROM (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
      + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 3 * n_words OR word_chars > 10 * n_words)::BIGINT
      + 32 * (10 * n_alpha < 8 * n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; verdicts and the rule that alone rejects a document are read off its bits."""
    book = stored(quality_rules.ledger(quality_rules.measurements(table(spark, sf_dir, "documents"))), "quality-ledger")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails(quality_rules.BASE).alias("base_failed"),
        (~quality_rules.fails(quality_rules.STANDARD)).alias("kept"),
        "failed_bits", F.lit(quality_rules.STANDARD.version).alias("policy"),
        quality_rules.only_rule(quality_rules.STANDARD).alias("only_rule"),
    )


@query("op6_best_two_fit")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer(), end_id=2, capacity=1024)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, ["doc_id", "piece"], capacity=1024)


@query(
    "op7_chat_format",
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 19 END AS marks,
         replace(text, chr(92), repeat(chr(92), 2)) AS e1,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE replace(role, chr(92), repeat(chr(92), 2)) END AS r1
  FROM t),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS previous,
         regexp_replace(e1, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]', '##', 'g') AS escaped,
         regexp_replace(r1, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]', '##', 'g') AS named
  FROM m),
o AS (
  SELECT *, min(place) FILTER (NOT ((previous IS NULL AND place = 0 AND role IN ('system', 'user'))
      OR (previous = 'system' AND role = 'user') OR (previous = 'user' AND role = 'assistant')
      OR (previous = 'assistant' AND role = 'user'))) OVER (PARTITION BY conv_id) AS bad FROM e),
g AS (
  SELECT conv_id, count(*) AS n_turns, min(bad) AS bad, arg_max(role, place) AS last_role,
         coalesce(sum(length(text)) FILTER (role = 'assistant' AND place < coalesce(bad, place + 1)), 0) AS strict_loss_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(marks + length(escaped) + length(named)) AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, bad IS NULL AND last_role = 'assistant' AS valid,
       CASE WHEN bad IS NOT NULL THEN bad WHEN last_role <> 'assistant' THEN n_turns END::INTEGER AS error_turn,
       strict_loss_chars::BIGINT AS strict_loss_chars, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM g
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = chat.format_conversations(turns.unionByName(extra))
    back = out.select("conv_id", "valid", "error_turn", chat.joined(F.col("segments")).alias("formatted"), "segments")
    back = back.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
        F.length(chat.loss_text(F.col("segments"), strict=True)).cast("long").alias("strict_loss_chars"),
    )


@query("op8_disclosure")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    listed = found.select("id", *counts, pii.as_text(pii.spans(pii.KINDS[:4])).alias("base"), pii.as_text(pii.spans()).alias("spans"))
    return listed.select(
        F.col("id").alias("doc_id"), *(f"n_{kind}" for kind in pii.KINDS[:4]),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


@query("op9_backoff_automaton")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out)


@query("op10_warc_chunks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"), least_bytes=0)
    found = warc.records_read(warc.read_archives(archives, "long", payloads=False))
    return found.withColumnRenamed("id", "page_id")


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16, weights="one")


def _licence_sql() -> str:
    """All templates against all words: their places by definition, without the index."""
    words = ", ".join(
        f"({t}, {place}, '{word.decode()}', {place in template.key_places})"
        for t, template in enumerate(licences.TEMPLATES) for place, word in enumerate(template.words)
    )
    known = ", ".join(
        f"({t}, '{x.label}', {x.base}, {len(x.words)}, {len(x.key_places)})" for t, x in enumerate(licences.TEMPLATES)
    )
    return rf"""
WITH tw(t, place, word, is_key) AS (VALUES {words}),
known(t, label, base, total, n_key) AS (VALUES {known}),
d AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
hits AS (
  SELECT doc_id, t, i - place AS start, count(*) AS matched, count(*) FILTER (is_key) AS keys
  FROM w JOIN tw ON w.word = tw.word GROUP BY ALL),
places AS (SELECT * FROM hits JOIN known USING (t) WHERE keys = n_key),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (10 * matched >= 8 * total) AS labels,
         max(matched / total) AS score
  FROM places GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found ON d.doc_id = found.doc_id
"""


@query("op12_licence_scan", _licence_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    shares = F.transform("places", lambda p: p["matched"] / p["total"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licences.labels(base).alias("base_labels"), licences.labels(F.filter("places", licences.enough)).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )


def _looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one text in ten repeat from a place on; a row without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(table(spark, sf_dir, "documents"), edit=_looped)
    best = found.withColumn("best", periodic_runs.longest())
    return best.select(
        "doc_id", F.col("n_words"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.n) div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.as_text().cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
