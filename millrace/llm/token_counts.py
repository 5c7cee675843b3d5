"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content (null counts as empty; the byte-level
tokenizer sees every other byte, so nothing else is changed) and the tokenizer by the digest of its
file. Counts that the cache holds are joined; of the other texts each different one is encoded once
and its count is appended to the cache, a Parquet folder with one subfolder per tokenizer version.

The texts themselves aren't shuffled while either the documents to encode or those to leave out are
few enough to broadcast (their number is counted first); beyond that, texts and ids are joined on
both sides.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids keep their rows;
an empty table gives no rows and adds nothing. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.common import batch_of, in_arrow, same, small, stored
from millrace.sources.shared import folder_exists

#: Ids sent to every task at most (about 50 bytes each).
MOST_SENT = 500_000
_COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size and content digest of every text, and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text.alias("text"),
    )


def encode(texts: DataFrame, tokenizer: str) -> DataFrame:
    """`digest` and `n_tokens` of the rows' texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bpe.encoder(tokenizer)
        for batch in batches:
            yield batch_of(_COUNTS, batch.column(0), [known.count(t.as_py()) for t in batch.column(1)])

    return in_arrow(texts.select("digest", "text"), each, "digest binary, n_tokens long")


def cached(spark, folder: str) -> DataFrame | None:
    """The stored counts of one tokenizer version, or None before the first."""
    if not folder_exists(spark, folder):
        return None
    counts = spark.read.schema("digest binary, n_tokens long").parquet(folder)
    return counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """Id, `n_bytes` and `n_tokens` of every document; new counts are appended to `cache`."""
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/tokenizer={bpe.version(tokenizer)}"
    every = digests(docs, id_col, text_col)
    seen = stored(every.drop("text"), "token-digests")
    first = seen.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    known = cached(spark, folder)
    if known is not None:
        first = first.join(known, "digest", "left_anti")
    first = stored(first, "token-misses")
    misses, total = first.count(), seen.count()
    if misses:
        wanted = first.select(F.col("id").alias("its_id"), F.col("digest").alias("its_digest"))
        match = same(F.col("id"), F.col("its_id")) & (F.col("digest") == F.col("its_digest"))
        if misses > most_sent and total - misses <= most_sent:
            skipped = seen.join(wanted, match, "left_anti").select("id", "digest").distinct()
            skipped = stored(skipped, "token-skipped").toDF("its_id", "its_digest")
            todo = every.join(F.broadcast(skipped), match, "left_anti")
        else:
            todo = every.join(small(wanted, misses, most_sent), match, "left_semi")
        encode(todo, tokenizer).write.mode("append").parquet(folder)
    counts = cached(spark, folder)
    if counts is None:
        counts = spark.createDataFrame([], "digest binary, n_tokens long")
    return seen.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
