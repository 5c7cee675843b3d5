"""Language-model scores from a weighted backoff automaton.

The model is a smoothed bigram model of the training documents. Its states are the words seen (and
the start of a text); a state has an arc for each word that followed it, with the weight
log10((c(hw) + mu p(w)) / (c(h) + mu)), and a failure arc to the root with log10(mu / (c(h) + mu)); the
root has an arc for every word, log10 p(w) = log10((c(w) + 1) / (N + V + 1)). So the probabilities of all
words after a state, the unknown word included, sum to 1. A text is scored in one pass from left to
right that carries the state.

The automaton grows with the corpus, so no task holds it. Texts are stored as blocks of word numbers;
each block sends its different words and word pairs, with their training counts, to the buckets
that add them up, and gets the sums of just these back: the part of the automaton that its own texts
walk through. Buckets and blocks have a bounded size, and frequent words or pairs come once per block.
Pairs are known by a 64-bit hash, words by themselves.

Cases: null, empty and blank texts are the end token alone; null ids count as the empty id for the split into
training and held-out documents. Repeated rows are trained on and scored each. An empty table gives
no rows; without training documents every token has p = 1. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from millrace.llm.common import batch_of, in_arrow, stored, text_bytes

#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 23
#: Words or pairs in a bucket at most, about.
BUCKET_ROWS = 1_000_000
#: Weight of the word's own probability after a state.
MU = 32.0
#: The start and the end of a text, which are no words.
START, END = b" <s>", b" </s>"
WORDS, PAIRS = 0, 1


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of many texts: `ids`, `held`, `lengths` (words), `numbers` (unsigned 32-bit, by the order of
    first use in the block), `words` (joined by blanks), `tokens` and `train_tokens`, `train_texts`."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, numbers, known, size = [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            total = sum(lengths) + len(lengths)
            train = [n + 1 for n, h in zip(lengths, held) if not h]
            joined = np.concatenate(numbers) if numbers else np.zeros(0, "<u4")
            arrow = pa.schema([
                ("block", pa.int64()), ("ids", pa.list_(id_field.type)), ("held", pa.list_(pa.bool_())),
                ("lengths", pa.list_(pa.int64())), ("numbers", pa.binary()), ("words", pa.binary()),
                ("tokens", pa.int64()), ("train_tokens", pa.int64()), ("train_texts", pa.int64()),
            ])
            return batch_of(
                arrow, [(task << 32) + number], [ids], [held], [lengths], [joined.tobytes()], [b" ".join(known)],
                [total], [sum(train)], [len(train)],
            )

        for batch in batches:
            id_field = batch.schema.field(0)
            for identity, flag, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))
            ):
                words = text.lower().split()
                at = np.fromiter((known.setdefault(w, len(known)) for w in words), "<u4", len(words))
                ids.append(identity)
                held.append(flag)
                lengths.append(len(words))
                numbers.append(at)
                size += len(text) + 64
                if size >= block_bytes:
                    yield block()
                    number += 1
                    ids, held, lengths, numbers, known, size = [], [], [], [], {}, 0
        if ids:
            yield block()

    out = StructType([
        StructField("block", LongType()), StructField("ids", ArrayType(docs.schema[id_col].dataType)),
        StructField("held", ArrayType(BooleanType())), StructField("lengths", ArrayType(LongType())),
        StructField("numbers", BinaryType()), StructField("words", BinaryType()), StructField("tokens", LongType()),
        StructField("train_tokens", LongType()), StructField("train_texts", LongType()),
    ])
    texts = docs.select(id_col, held_out.alias("held"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(texts, each, out)


class Walk:
    """The words and pairs of one block, in the order that block and buckets agree on."""

    def __init__(self, numbers: bytes, words: bytes, lengths, held, n_buckets: int):
        self.words = words.split(b" ") if words else []
        self.lengths = np.asarray(lengths, np.int64)
        held = np.asarray(held, bool)
        n, start, end = len(self.words), len(self.words), len(self.words) + 1
        ends = np.cumsum(self.lengths + 1) - 1  # the place of each text's end token
        token = np.full(int(self.lengths.sum()) + len(self.lengths), end, np.uint32)
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = np.frombuffer(numbers, "<u4")
        state = np.empty_like(token)  # what the walk carries: the word before, or the start
        state[1:] = token[:-1]
        self.first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        state[self.first] = start
        self.token, self.state, self.ends, self.n = token, state, ends, n
        self.train = np.repeat(~held, self.lengths + 1)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in [*self.words, START, END]], np.uint64)
        code, self.pair = np.unique(state.astype(np.int64) * (n + 2) + token, return_inverse=True)
        self.pair = self.pair.astype(np.uint32)
        mixed = (hashes[code // (n + 2)] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[code % (n + 2)] >> np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.keys = mixed ^ (mixed >> np.uint64(29))
        self.n_buckets = n_buckets
        self.word_bucket = (hashes[:n] % np.uint64(n_buckets)).astype(np.int64)
        self.key_bucket = (self.keys % np.uint64(n_buckets)).astype(np.int64)

    def parts(self, kind: int) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets and the positions of their words or pairs."""
        bucket = self.word_bucket if kind == WORDS else self.key_bucket
        order = np.argsort(bucket, kind="stable") if kind == WORDS else np.lexsort((self.keys, bucket))
        edges = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        for b in range(self.n_buckets):
            if edges[b] < edges[b + 1]:
                yield b, order[edges[b] : edges[b + 1]]


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes first; compresses well where high bytes repeat."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def sent(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """What blocks send: kind, bucket, block, `items` (words, or differences of sorted pair keys) and
    their training counts."""
    arrow = pa.schema([
        ("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("items", pa.binary()), ("counts", pa.binary()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist()):
            walk = Walk(row["numbers"], row["words"], row["lengths"], row["held"], n_buckets)
            words = walk.token[walk.train & (walk.token < walk.n)]
            counts = {
                WORDS: np.bincount(words, minlength=walk.n).astype("<u4"),
                PAIRS: np.bincount(walk.pair[walk.train], minlength=len(walk.keys)).astype("<u4"),
            }
            for kind in (WORDS, PAIRS):
                rows = []
                for b, at in walk.parts(kind):
                    if kind == WORDS:
                        items = b" ".join([walk.words[i] for i in at])
                    else:
                        items = planes(np.diff(walk.keys[at], prepend=np.uint64(0)))
                    rows.append((kind, b, row["block"], items, planes(counts[kind][at])))
                if rows:
                    yield batch_of(arrow, *zip(*rows))

    return in_arrow(
        blocks.select("block", "numbers", "words", "lengths", "held"), each, "kind int, bucket int, block long, items binary, counts binary"
    )


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the counts over all blocks, for each block in the order of its items."""
    kind = int(frame["kind"].iloc[0])
    frame = frame.sort_values("block")
    counts = [unplaned(c, "<u4") for c in frame["counts"]]
    if kind == WORDS:
        items = np.array([w for joined in frame["items"] for w in joined.split(b" ")], dtype=object)
        place = pd.factorize(items)[0]
    else:
        keys = np.concatenate([np.cumsum(unplaned(d, "<u8"), dtype=np.uint64) for d in frame["items"]])
        place = np.unique(keys, return_inverse=True)[1]
    total = np.bincount(place, weights=np.concatenate(counts)).astype("<u8")
    edges = np.cumsum([0] + [len(c) for c in counts])
    out = [planes(total[place[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
    distinct = np.zeros(len(out), np.int64)
    distinct[0] = np.count_nonzero(total)
    return pd.DataFrame({
        "kind": kind, "bucket": frame["bucket"].to_numpy(), "block": frame["block"].to_numpy(), "counts": out,
        "distinct": distinct,
    })


def walk_scores(walk: Walk, words: np.ndarray, pairs: np.ndarray, n_train: int, v: int, texts: int, mu: float):
    """Per text: known tokens, base score and model score."""
    known = np.concatenate([words, [texts, texts]]).astype(np.float64)  # words, the start, the end
    p = (known + 1.0) / (n_train + v + 1.0)
    root, failure = np.log10(p), np.log10(mu / (known + mu))
    steps = failure[walk.state] + root[walk.token]  # by the failure arc to the root
    seen = np.flatnonzero(pairs[walk.pair] > 0)
    state, token = walk.state[seen], walk.token[seen]
    steps[seen] = np.log10((pairs[walk.pair[seen]] + mu * p[token]) / (known[state] + mu))
    add = lambda values: np.add.reduceat(values, walk.first) if len(walk.first) else values
    return add((known[walk.token] > 0).astype(np.int64)), add(root[walk.token]), add(steps)


def score(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", mu: float = MU,
    block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per row: the id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    Documents for which the column `held_out` isn't true are trained on.
    """
    blocks = stored(blocks_of(docs, id_col, text_col, F.coalesce(held_out, F.lit(False)), block_bytes), "lm-blocks")
    tokens, n_train, texts = blocks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_texts")).first()
    n_train, texts = int(n_train or 0), int(texts or 0)
    n_buckets = max(1, -(-int(tokens or 0) // bucket_rows))
    summed = stored(
        sent(blocks, n_buckets).groupBy("kind", "bucket").applyInPandas(
            _summed, "kind int, bucket int, block long, counts binary, distinct long"
        ),
        "lm-counts",
    )
    v = int(summed.where(F.col("kind") == WORDS).agg(F.sum("distinct")).first()[0] or 0) + (texts > 0)

    def walked(block: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in block.to_dict("records"):
            walk = Walk(row["numbers"], row["words"], row["lengths"], row["held"], n_buckets)
            got = {(k, b): c for k, b, c in zip(sums["kind"], sums["bucket"], sums["counts"])}
            counts = {WORDS: np.zeros(walk.n, np.int64), PAIRS: np.zeros(len(walk.keys), np.int64)}
            for kind, into in counts.items():
                for b, at in walk.parts(kind):
                    into[at] = unplaned(got[kind, b], "<u8")
            known, base, model = walk_scores(walk, counts[WORDS], counts[PAIRS], n_train, v, texts, mu)
            found.append(
                pd.DataFrame({
                    id_col: list(row["ids"]), "held_out": np.asarray(row["held"], bool), "n_tokens": walk.lengths + 1,
                    "n_known": known, "train_tokens": n_train, "base_score": base, "score": model,
                })
            )
        return pd.concat(found)

    out = StructType([
        docs.schema[id_col], StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
        StructField("n_known", LongType()), StructField("train_tokens", LongType()),
        StructField("base_score", DoubleType()), StructField("score", DoubleType()),
    ])
    texts_side = blocks.select("block", "numbers", "words", "lengths", "held", "ids").groupBy("block")
    sums_side = summed.select("block", "kind", "bucket", "counts").groupBy("block")
    return texts_side.cogroup(sums_side).applyInPandas(walked, out)
