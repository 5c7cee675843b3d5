"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; it is
written as Parquet and read again for the next one. Every stage but the last returns the columns of
`docs`, whatever they are. A document is known by its id and its text, so what is decided for one holds
for no other with the same or no id; of rows that repeat both, the dedup stages keep one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.llm import exact_dedup, mixing, near_text, packing, quality_rules
from millrace.llm.common import same, small, stored, table

ID, TEXT = "doc_id", "text"
#: Ids sent to every task at most (about 20 bytes each); more are joined on both sides.
MOST_SENT = 1_000_000


#: The row as one struct, and the helper columns beside it, so that no column of the documents can clash.
ROW = "document"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(col(c) for c in docs.columns)).alias(ROW))


def _field(name: str) -> Column:
    return F.col(ROW)[name]


def _key() -> Column:
    """What the text is known by."""
    return F.xxhash64(F.coalesce(_field(TEXT).cast("string"), F.lit("")))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text aren't in the two columns of `rows`."""
    rows = stored(rows.toDF("dropped_id", "dropped_key").distinct(), "pipeline-dropped")
    dropped = small(rows, rows.count(), MOST_SENT)
    match = same(_field(ID), F.col("dropped_id")) & (_key() == F.col("dropped_key"))
    return _rows(docs).join(dropped, match, "left_anti").select(f"{ROW}.*")


def _one_each(docs: DataFrame) -> DataFrame:
    """One row of those that repeat an id and a text."""
    again = _rows(docs).groupBy(_field(ID).alias("again_id"), _key().alias("again_key")).count().where("count > 1").drop("count")
    again = stored(again, "pipeline-repeated")
    n = again.count()
    if not n:
        return docs
    repeated = small(again, n, MOST_SENT)
    match = same(_field(ID), F.col("again_id")) & (_key() == F.col("again_key"))
    first = Window.partitionBy("again_id", "again_key").orderBy(F.xxhash64(ROW))
    found = _rows(docs).join(repeated, match).withColumn("place", F.row_number().over(first)).where("place = 1").select(ROW)
    return _rows(docs).join(repeated, match, "left_anti").unionByName(found).select(f"{ROW}.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the standard policy."""
    rows = _rows(docs).select(ROW, _field(TEXT).alias("text"))
    book = quality_rules.ledger(quality_rules.measurements(rows, carry=ROW))
    return book.where(~quality_rules.fails(quality_rules.STANDARD)).select(f"{ROW}.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    groups = exact_dedup.exact_rows(docs, ID, TEXT)
    kept = same(F.col("id"), F.col("best.id")) & (F.col("row_key") == F.col("best.row_key"))
    return _one_each(_without(docs, groups.where(~kept).select("id", "row_key")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by pairs that share 80 % of their
    different five-word shingles; candidates come from the SimHash trees and from minima of shingles."""
    return _one_each(_without(docs, near_text.near_rows(docs, ID, TEXT, words=5, tenths=8)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of the sources takes it."""
    source = _field("source").cast("string")
    known = _rows(docs).select(F.struct(_field(ID).alias("id"), _key().alias("key")).alias("row"), _field(TEXT).alias("text"), source.alias("source"))
    mixed = mixing.mix(mixing.sizes(known, "row", "text"))
    # Rows that repeat an id, a text and a source get `least` copies, and `more` of them one more.
    copies = mixed.groupBy(
        F.col("id.id").alias("mixed_id"), F.col("id.key").alias("mixed_key"), F.col("source").alias("mixed_source")
    ).agg(
        F.min("copies").cast("int").alias("least"), F.max("copies").cast("int").alias("most"),
        (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("more"),
    ).where("least <> 1 OR most <> 1").drop("most")
    copies = stored(copies, "pipeline-copies")
    given = small(copies, copies.count(), MOST_SENT)
    match = same(_field(ID), F.col("mixed_id")) & (_key() == F.col("mixed_key")) & same(source, F.col("mixed_source"))
    rows = _rows(docs).join(given, match, "left")
    place = Window.partitionBy("mixed_id", "mixed_key", "mixed_source").orderBy(F.xxhash64(ROW))
    uneven = rows.where("more > 0").withColumn("least", F.col("least") + (F.row_number().over(place) <= F.col("more")).cast("int"))
    taken = rows.where("more IS NULL OR more = 0").unionByName(uneven)
    times = F.array_repeat(F.lit(0), F.coalesce("least", F.lit(1)))
    return taken.select(ROW, F.explode(times)).select(f"{ROW}.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(docs, tokenizer, end_id=2, capacity=1024, id_col=ID, text_col=TEXT)
    slim = cut.select(ID, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, [ID, "piece"], capacity=1024)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("entropy_mixing", mixing_stage),
    ("best_two_fit_packing", packing_stage),
]

#: Fingerprints, tilted rates and token ids are beyond SQL; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
