"""Near copies by their shingles: brute force, recall on the given table, large groups and edges."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_text, simhash
from millrace.llm.common import table

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha", "jo", "ki") for b in ("la", "mo", "ni", "ru", "te", "xa", "zi")]


def marks_of(sets):
    return np.array([near_text.minima(s).astype(np.uint8) for s in sets])


def similar(a, b, tenths=8):
    shared = len(np.intersect1d(a, b))
    return 10 * shared >= tenths * (len(a) + len(b) - shared)


def parts(n, links):
    i, j = np.array(links, int).reshape(-1, 2).T
    return simhash._lowest(n, i, j).tolist()


def template_sets(rnd, n, shared, own):
    common = rnd.integers(0, 1 << 63, shared, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rnd.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(n)]


@pytest.mark.parametrize("size", [3, 40, 400])
def test_links_connect_what_similar_pairs_connect(size):
    rnd = np.random.default_rng(size)
    sets = template_sets(rnd, 30, size, max(1, size // 3))
    for s in list(sets):  # near copies at every similarity
        for drop in (0.02, 0.1, 0.2):
            sets.append(np.unique(np.concatenate([s[rnd.random(len(s)) > drop][:-1], rnd.integers(0, 1 << 63, 1, dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    assert parts(len(sets), near_text.links_of(sets, marks_of(sets), 8)) == parts(len(sets), pairs)
    side = rnd.integers(0, 2, len(sets))
    found = near_text.links_of(sets, marks_of(sets), 8, side)
    across = [(i, j) for i, j in pairs if side[i] != side[j]]
    assert all(side[i] != side[j] for i, j in found) and parts(len(sets), found) == parts(len(sets), across)


def test_many_candidates_that_are_no_links_take_seconds():
    rnd = np.random.default_rng(1)
    sets = template_sets(rnd, 2000, 380, 120)  # a similarity of about 0.61
    marks, began = marks_of(sets), time.time()
    assert near_text.links_of(sets, marks, 8) == [] and time.time() - began < 20


def test_a_group_is_cut_into_units(spark, monkeypatch):
    """Groups of many shares: every pair meets, and no unit is larger than two shares."""
    monkeypatch.setattr(near_text, "SHARE", 20)
    rnd = random.Random(2)
    base = [rnd.choice(WORDS) for _ in range(150)]
    texts = {}
    for i in range(300):  # one template; each text has an own part, and every third is a near copy of the one before
        own = [rnd.choice(WORDS) for _ in range(30)]
        texts[i] = texts[i - 1] + " more" if i % 3 == 2 else " ".join(base + own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = {r.id for r in near_text.near_rows(docs).collect()}
    sets = [near_text.shingles(t.encode(), 5) for t in texts.values()]
    pairs = [(i, j) for i in range(300) for j in range(i) if similar(sets[i], sets[j])]
    lowest = parts(300, pairs)
    assert gone == {i for i in range(300) if lowest[i] != i} and 60 < len(gone)
    members = docs.select(F.lit("r").alias("root"), F.col("doc_id").cast("string").alias("name"), F.lit(b"x").alias("set"), F.lit(b"y").alias("marks"))
    units = near_text._units(members).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides")).collect()
    assert len(units) == 15 * 16 // 2 and max(u.n for u in units) < 80
    assert all(u.sides == (1 if u.low == u.high else 2) for u in units)


def test_recall_on_the_given_table(spark):
    """Of the pairs at 0.8 or more, found by brute force through their shingles, at least 0.9 are linked: here all."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").collect()
    sets = [near_text.shingles((r.text or "").encode(), 5) for r in rows]
    owners = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            owners.setdefault(x, []).append(i)
    counts = {}
    for own in owners.values():
        for i in range(len(own)):
            for j in range(i):
                counts[own[j], own[i]] = counts.get((own[j], own[i]), 0) + 1
    pairs = [(i, j) for (i, j), n in counts.items() if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n)]
    lowest = parts(len(rows), pairs)
    names = [r.doc_id for r in rows]
    first = {}
    for i, low in enumerate(lowest):
        first[low] = min(first.get(low, names[i]), names[i])
    gone = {r.id for r in near_text.near_rows(docs).collect()}
    want = {names[i] for i, low in enumerate(lowest) if names[i] != first[low]}
    assert len(pairs) > 90 and gone <= want and len(gone & want) >= 0.9 * len(want)
    assert gone == want


def test_edges(spark):
    rnd = random.Random(1)
    long = " ".join(rnd.choice(WORDS) for _ in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One  two"), (5, "One  two"), (6, "three"), (None, "three"), (None, None),
        (7, long), (8, long + " end"), (9, "é\x00 a b c d e f"), (10, "é\x00 a b c d e f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("id", "node", "root", "band", "set", "marks", "text_key", "low", "side")})
    gone = sorted(((r.id or 0) for r in near_text.near_rows(docs).collect()))
    assert gone == [0, 0, 2, 3, 5, 5, 8, 10]
    assert near_text.near_rows(docs.where("doc_id > 99")).collect() == []
