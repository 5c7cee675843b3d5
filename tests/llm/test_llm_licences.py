"""Licence notices against a search by definition."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import licences, queries
from millrace.llm.common import table
from millrace.llm.licences import TEMPLATES, Index, Template


def brute(words, templates):
    """All templates at all starts."""
    out = []
    for number, t in enumerate(templates):
        for start in range(-len(t.words), len(words)):
            at = lambda p: words[start + p] if 0 <= start + p < len(words) else None  # noqa: B023, E731
            if all(at(p) == t.words[p] for p in t.key_places):
                out.append((number, start, sum(at(p) == w for p, w in enumerate(t.words))))
    return sorted(out, key=lambda f: (f[1], f[0]))


SMALL = (
    Template("ab", "a b", ("a b",), base=True), Template("aba", "a b a", ("a b a",), base=True),
    Template("x", "c a b c d", ("a b", "d")), Template("y", "d d c", ("c",)),
)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=40), st.lists(st.integers(0, 9), min_size=4, max_size=4))
def test_small_alphabet(words, held):
    """The same places whatever the frequencies."""
    index = Index(SMALL, 10, dict(zip([b"a", b"b", b"c", b"d"], held)))
    assert index.places(words) == brute(words, SMALL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(sorted({t.text for t in TEMPLATES}) + ["and", "the", "cc", "license", "version 3"]), max_size=6))
def test_notices(parts):
    words = licences.WORD.findall(" ".join(parts).lower().encode())
    assert Index(TEMPLATES, 0, {}).places(words) == brute(words, TEMPLATES)


def test_rarest_word_is_looked_up():
    held = {b"all": 90, b"rights": 5, b"reserved": 3}
    index = Index([licences.BASE[2]], 100, held)
    assert index.first == {b"reserved"} and set(index.postings) == {b"reserved", b"rights"}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in queries.op12(spark, folder).collect()}
    rows = table(spark, folder, "documents").collect()
    assert len(found) == len(rows)
    for row in rows:
        words = licences.WORD.findall((row.text or "").encode().lower())
        want = brute(words, TEMPLATES) if len(words) < 3000 else Index(TEMPLATES, 0, {}).places(words)
        base = [(start, TEMPLATES[t].label) for t, start, _ in want if TEMPLATES[t].base]
        r = found[row.doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(base), ",".join(sorted({x for _, x in base})))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        own = {TEMPLATES[t].label for t, _, m in want if 10 * m >= 8 * len(TEMPLATES[t].words)}
        assert r.labels == ",".join(sorted(own)) and set(r.base_labels.split(",")) - {""} <= own
        assert r.score == max((m / len(TEMPLATES[t].words) for t, _, m in want), default=0.0)
    assert {"mit", "apache-2.0", "cc-by,cc-by-nc-4.0", "reserved"} <= {r.labels for r in found.values()}


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "..."), (None, "CC-BY"), (5, "cc by CC by"), (5, "cc by CC by"),
        (6, "word " * 60_000 + "All Rights\x00Reserved"), (7, "éall rights reserved ALL RIGHTS RESERVED"),
        (8, "general public license version 3"), (9, "GNU General Public License, version 3"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("places", "n_words", "word", "n", "id", "label")})
    found = sorted(
        ((r.doc_id, r.n_words, [(p.label, p.start, p.matched) for p in r.places]) for r in licences.scan(docs).collect()), key=repr
    )
    assert found == sorted([
        (1, 0, []), (2, 0, []), (3, 0, []), (None, 2, [("cc-by", 0, 2)]), (5, 4, [("cc-by", 0, 2), ("cc-by", 2, 2)]),
        (5, 4, [("cc-by", 0, 2), ("cc-by", 2, 2)]), (6, 60_003, [("reserved", 60_000, 3)]), (7, 6, [("reserved", 3, 3)]),
        (8, 5, [("gpl", 0, 3)]), (9, 6, [("gpl-3.0", -3, 6), ("gpl", 1, 3)]),
    ], key=repr)
    assert licences.scan(docs.where("doc_id > 99")).collect() == []


def test_key_must_be_a_phrase_of_the_text():
    with pytest.raises(ValueError):
        Template("x", "a b", ("b a",)).key_places  # noqa: B018
