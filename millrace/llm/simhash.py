"""SimHash fingerprints, linked through vantage-point trees.

Different fingerprints are split into shards by a vantage-point tree that is fitted on a bounded
sample: at each node a fingerprint goes inward or outward by its Hamming distance to the vantage
point. So that no close pair is lost, a fingerprint also visits, as a guest, each shard that the
triangle inequality can't rule out. A pair that a node parts is found once: the inner one is sent
outward, never the other way. Inside a shard the same rule goes on down to small leaves, where
distances are computed. Only a spanning forest of each shard's links leaves it, and the forests are
joined by contraction rounds, each written to the shared folder.

Cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle. Repeated rows and null ids keep their rows (a null id is
never the name of a component while it has another member; alone it stays null). An empty table gives
no rows. Long texts are hashed in blocks of shingles. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_of, field_type, in_arrow, stored, text_bytes

SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: Fingerprints per shard, about.
SHARD = 4_096
#: Fingerprints of the sample that the tree of shards is fitted on, at most.
SAMPLE = 65_536
#: Fingerprints in a leaf inside a shard.
LEAF = 256


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash over the shingles, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(islice(tokens, k, None) for k in range(words))))
        total = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    while block := list(islice(shingles, BLOCK)):
        hashes = np.array([digest(s, SEED) for s in block], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """`id` and `fp` (64 bits as a signed long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in text_bytes(batch.column(1))], "<u8")
            schema = pa.schema([batch.schema.field(0), ("fp", pa.int64())])
            yield batch_of(schema, batch.column(0), pa.array(found.view("<i8")))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, each, f"id {field_type(rows, 'id')}, fp long")


def distances(left: np.ndarray, right: np.ndarray | np.uint64) -> np.ndarray:
    """Hamming distances."""
    return np.bitwise_count(left ^ right)


@dataclass
class Node:
    """Fingerprints within `radius` of `vantage` go inward, the others outward; or a shard."""

    vantage: int = 0
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1


def _split(residents: np.ndarray) -> tuple[np.uint64, int]:
    """A vantage point and the radius that halves the residents best: the best of a few points,
    picked from the sorted residents, by how few guests the split makes."""
    best = None
    for place in (0, len(residents) // 3, 2 * len(residents) // 3, len(residents) - 1):
        vantage = residents[place]
        far = distances(residents, vantage)
        radius = int(np.partition(far, len(far) // 2)[len(far) // 2])
        for r in (radius - 1, radius):
            inside = np.count_nonzero(far <= r)
            near = np.count_nonzero((far <= r) & (far > r - 2))
            cost = max(inside, len(far) - inside) + near
            if 0 < inside < len(far) and (best is None or cost < best[0]):
                best = (cost, vantage, r)
    return (residents[0], -1) if best is None else (best[1], best[2])


def fit(sample: np.ndarray, most: int, shards: list[int] | None = None) -> Node:
    """Tree over the sample with at most `most` of its fingerprints per shard, where splits help."""
    shards = [0] if shards is None else shards
    if len(sample) > most:
        vantage, radius = _split(sample)
        inside = distances(sample, vantage) <= radius if radius >= 0 else np.zeros(len(sample), bool)
        if 0 < inside.sum() < len(sample):
            return Node(int(vantage), radius, fit(sample[inside], most, shards), fit(sample[~inside], most, shards))
    shards[0] += 1
    return Node(shard=shards[0] - 1)


def _step(fps: np.ndarray, guest: np.ndarray, vantage, radius: int, reach: int):
    """Who goes inward and outward: two tuples of positions and guest flags."""
    far = distances(fps, vantage).astype(np.int64)
    inside = far <= radius
    inward = np.flatnonzero(np.where(guest, far <= radius + reach, inside))
    outward = np.flatnonzero(np.where(guest, far > radius - reach, ~inside | (far > radius - reach)))
    return (inward, guest[inward]), (outward, guest[outward] | inside[outward])


def route(node: Node, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, shards and guest flags of all visits."""
    visits = []

    def go(node: Node, at: np.ndarray, guest: np.ndarray) -> None:
        if not len(at):
            return
        if node.shard >= 0:
            visits.append((at, np.full(len(at), node.shard), guest))
            return
        for child, (kept, flag) in zip(
            (node.inner, node.outer), _step(fps[at], guest, np.uint64(node.vantage), node.radius, reach)
        ):
            go(child, at[kept], flag)

    go(node, np.arange(len(fps)), np.zeros(len(fps), bool))
    if not visits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(column) for column in zip(*visits))


def _lowest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of `n` nodes the lowest node it is linked with, over any number of links."""
    lowest = np.arange(n)
    while len(left):
        new = lowest.copy()
        np.minimum.at(new, left, lowest[right])
        np.minimum.at(new, right, lowest[left])
        new = new[new]
        if np.array_equal(new, lowest):
            break
        lowest = new
    return lowest


def links_within(fps: np.ndarray, guest: np.ndarray, reach: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that pairs of at most `reach` bits connect, as positions.

    Pairs of two guests are left to the shards where one of them is at home.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(at: np.ndarray, guests: np.ndarray) -> None:
        """All residents against all visitors, in blocks; a block leaves a forest only."""
        home = at[~guests]
        for start in range(0, len(home), leaf):
            rows = home[start : start + leaf]
            for other in range(0, len(at), 16 * leaf):
                columns = at[other : other + 16 * leaf]
                i, j = np.nonzero(distances(fps[rows][:, None], fps[columns][None, :]) <= reach)
                i, j = rows[i], columns[j]
                keep = i != j
                if keep.any():
                    found.append(_forest(i[keep], j[keep]))

    def spread(at: np.ndarray, guests: np.ndarray) -> None:
        """Where no split helps, everything is close together: grow components from their members,
        so that each fingerprint is compared only with those not reached yet."""
        waiting = at
        while len(waiting):
            front, waiting = [waiting[0]], waiting[1:]
            while front and len(waiting):
                point = front.pop()
                hit = distances(fps[waiting], fps[point]) <= reach
                if hit.any():
                    reached = waiting[hit]
                    found.append((np.full(len(reached), point), reached))
                    front.extend(reached.tolist())
                    waiting = waiting[~hit]

    def go(at: np.ndarray, guests: np.ndarray) -> None:
        home = at[~guests]
        if not len(home) or len(at) < 2:
            return
        if len(home) <= leaf:
            compare(at, guests)
            return
        vantage, radius = _split(fps[home])
        if radius >= 0:
            (a, ga), (b, gb) = _step(fps[at], guests, vantage, radius, reach)
            if max(len(a), len(b)) < 0.95 * len(at):
                go(at[a], ga)
                go(at[b], gb)
                return
        spread(at, guests)

    go(np.arange(len(fps)), guest)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(*(np.concatenate(c) for c in zip(*found)))


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links with the same components: each node and its lowest."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    lowest = _lowest(len(nodes), place[: len(left)], place[len(left) :])
    other = np.flatnonzero(lowest != np.arange(len(nodes)))
    return nodes[other], nodes[lowest[other]]


def close_links(unique: DataFrame, reach: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """`a` and `b`: links whose components are those of all pairs within `reach` bits."""
    total = unique.count()
    tree = Node(shard=0)
    if total > shard:
        share = min(0.25, sample / total)
        picked = unique.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40)))
        points = np.sort(np.array([r[0] for r in picked.select("fp").collect()], np.int64).view(np.uint64))
        tree = fit(points, max(2, int(shard * share)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            at, shards, guests = route(tree, fps.view(np.uint64), reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[at]), pa.array(shards.astype(np.int32)), pa.array(guests)], ["fp", "shard", "guest"]
            )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy(np.int64)
        a, b = links_within(fps.view(np.uint64), frame["guest"].to_numpy(bool), reach)
        return pd.DataFrame({"a": fps[a], "b": fps[b]})

    visits = in_arrow(unique.select("fp"), visit, "fp long, shard int, guest boolean")
    return visits.groupBy("shard").applyInPandas(meet, "a long, b long")


def _flat(move: DataFrame) -> DataFrame:
    """Moves that end where a chain of moves ends; the length of chains halves with each join."""
    while True:
        then = move.select(F.col("node").alias("to"), F.col("to").alias("end"))
        move = move.join(then, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved"))
        move = stored(move, "simhash-moves")
        if move.where("moved").isEmpty():
            return move.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """`node` and `root` (one node of its component) of every node with a link.

    Each round every node moves to its lowest neighbour and on to the end of such moves, links
    follow, and loops go; the number of nodes at least halves. The moves are then followed from the
    last round back to the first.
    """
    links = stored(links.where("a <> b").distinct(), "simhash-links")
    moves: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        move = _flat(stored(move, "simhash-moves"))
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("new_a"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        moved = links.join(left, "a").join(right, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        links = stored(moved.where("a <> b").distinct(), "simhash-links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].withColumnRenamed("to", "root")
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        roots = stored(roots, "simhash-roots")
    return roots


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, reach: int = 2,
    shard: int = SHARD, sample: int = SAMPLE,
) -> DataFrame:
    """Per row: the id, `fingerprint` (16 hex digits) and `component_id` (smallest id reachable)."""
    rows = stored(fingerprints(docs, id_col, text_col, words), "simhash-fingerprints")
    unique = rows.groupBy("fp").agg(F.min("id").alias("first"))
    unique = stored(unique, "simhash-unique")
    roots = components(close_links(unique, reach, shard, sample))
    linked = unique.join(roots, unique["fp"] == roots["node"])
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    named = linked.join(names, "root").select("fp", F.col("name"))
    every = unique.join(named, "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    return rows.join(every, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
