"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; versioned policies and their ablations are then bit operations on the ledger, without another
look at the texts.

Cases: a null or empty text has no words, all measurements are 0 and the rules on counts fail it;
rules on ratios can't fail a text without words. Repeated rows give repeated ledger rows, an empty
table an empty ledger. Only the carried column and the text are read, so other columns can't clash. A text
is measured in one piece, with memory in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import batch_of, in_arrow, text_bytes

MEASUREMENTS = (
    "n_words",
    "word_chars",
    "n_alpha_words",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(b"#*$%&|<>")))
_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over the measurements; true or false, never null."""

    name: str
    fails: str


#: The order fixes the bits; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("few_letters", "10 * n_alpha_words < 8 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force; a document goes if it fails one of them."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: 1 << i for i, r in enumerate(rules)}
        return sum(bits[name] for name in dict.fromkeys(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Number of words in windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, window):  # pairs of ranks stay below n * n, so they fit whatever the text
        key = np.unique(key, return_inverse=True)[1] * np.int64(len(known)) + ids[k : k + n]
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASUREMENTS."""
    words = text.split()
    if not words:
        return (0,) * len(MEASUREMENTS[:3]) + (len(text.translate(None, _NOT_SYMBOLS)), 0, 0, 0)
    joined = b"".join(words)
    plain = joined.isascii()
    chars = len(joined) if plain else len(joined.decode("utf-8", "replace"))
    alpha = sum(1 for w in words if _LETTER.search(w) or any(map(str.isalpha, w.decode("utf-8", "replace"))))
    lines = [line for line in text.split(b"\n") if line.split()]
    return (
        len(words),
        chars,
        alpha,
        len(text.translate(None, _NOT_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measurements(docs: DataFrame, carry: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The column `carry` (an id, or a struct of all that is to be kept) and the measurements."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in text_bytes(batch.column(1))]
            schema = pa.schema([batch.schema.field(0), *(pa.field(n, pa.int64()) for n in MEASUREMENTS)])
            yield batch_of(schema, batch.column(0), *(zip(*found) if found else [[]] * len(MEASUREMENTS)))

    out = StructType([docs.schema[carry], *(StructField(n, LongType()) for n in MEASUREMENTS)])
    return in_arrow(docs.select(carry, text_col), each, out)


def ledger(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`measured` with `failed_bits`: bit i is set if rule i fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_bits", total)


def fails(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where the ledger row breaks the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def only_rule(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """The rule without which the policy would keep the document, where there is one."""
    hit = F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))
    out = F.lit(None).cast("string")
    for name in dict.fromkeys(policy.rules):
        out = F.when(hit == Policy("", (name,)).mask(rules), name).otherwise(out)
    return out


def ablations(book: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents failing the rule, and those that only this rule rejects.

    The ledger is first summed by its bit patterns, of which there are few; the rest is bitwise
    work on those sums.
    """
    patterns = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"),
                 F.lit(p.mask(rules)).cast("long").alias("mask"),
                 F.lit(p.mask(rules) & Policy("", (name,)).mask(rules)).cast("long").alias("bit"))
        for p in policies for name in p.rules
    ]
    spread = patterns.select("failed_bits", "n", F.inline(F.array(*cases)))
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return spread.groupBy("version", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )
