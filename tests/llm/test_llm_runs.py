"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import periodic_runs, queries
from millrace.llm.common import table


def brute(words, least):
    """Every (start, length, period), by definition: all lags, all maximal stretches, smallest period each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                end = i + q
                if end - start >= max(least, 2 * q):
                    found.setdefault((start, end), q)
                start = i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def ours(texts, least, direct):
    layout, order = periodic_runs.lay_out([np.array(t, np.int64) for t in texts])
    out = [[] for _ in texts]
    found = periodic_runs.find_runs(layout, least, direct)
    for start, end, q in found.T.tolist():
        place = int(layout.text_of(np.array([start]))[0])
        out[order[place]].append((start - int(layout.starts[place]), end - start, q))
    return [sorted(o) for o in out]


@st.composite
def periodic(draw):
    """Words with repeats of repeats, cut and broken at places."""
    part = draw(st.lists(st.integers(0, 2), min_size=1, max_size=4))
    for _ in range(draw(st.integers(1, 4))):
        part = part * draw(st.integers(1, 6)) + draw(st.lists(st.integers(0, 2), max_size=3))
        part = part[draw(st.integers(0, 2)) :][:400]
    return part


@settings(max_examples=400, deadline=None)
@given(st.lists(periodic(), min_size=1, max_size=4))
def test_all_scales(texts):
    assert ours(texts, 2, 8) == [brute(t, 2) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=300), min_size=1, max_size=3))
def test_two_words(texts):
    assert ours(texts, 2, 8) == [brute(t, 2) for t in texts]


def test_squares_of_periodic_words():
    """Halves that are themselves periodic: one run for every odd period."""
    text = [0, 1] * 60 + [0] + [0, 1] * 60 + [0]
    assert ours([text], 2, 8) == [brute(text, 2)]
    assert len(brute(text, 2)) > 50


def test_fibonacci_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    unlike = list(range(10, 700)) * 2 + [3]
    assert ours([b, unlike], 12, 48) == [brute(b, 12), brute(unlike, 12)]


def test_wrong_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PRIME", 5)
    monkeypatch.setattr(periodic_runs, "BASE", 2)
    text = ([0, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2] * 4 + [9, 9]) * 3
    assert ours([text], 2, 8) == [brute(text, 2)]


def expected(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (n, len(found), *shown, sha(lines), sha(kept))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13(spark, folder).collect()}
    rows = [r for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert len(found) == len(rows)
    slow = [r for r in rows if len(r.text or "") < 12_000]
    assert len(slow) > 0.8 * len(rows)
    wrong = [r.doc_id for r in slow if (found[r.doc_id][0], *found[r.doc_id][1:]) != expected(r.doc_id, r.text)]
    assert wrong == [] and sum(found[r.doc_id][1] > 0 for r in rows) > 10


def test_edges(spark):
    loop = "a b c " * 10
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, loop), (5, loop), (5, loop), (6, "word " * 50_000 + "x"), (7, "é\x00 🙂 " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("runs", "n_words", "collapsed", "start", "id")})
    out = periodic_runs.runs(docs)
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(found, key=repr) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 30, [(0, 30, 3)], "a b c"), (5, 30, [(0, 30, 3)], "a b c"),
        (5, 30, [(0, 30, 3)], "a b c"), (6, 50_001, [(0, 50_000, 1)], "word x"), (7, 18, [(0, 18, 2)], "é\x00 🙂"),
    ], key=repr)
    assert periodic_runs.runs(docs.where("doc_id > 99")).collect() == []
    edited = periodic_runs.runs(docs.where("doc_id = 2"), edit=lambda i, words: [b"x"] * 12).collect()
    assert edited[0].runs[0].period == 1 and edited[0].collapsed == "x"
