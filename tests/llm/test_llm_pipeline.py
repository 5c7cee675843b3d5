"""The stages of the corpus pipeline on planted documents, each on what the one before kept."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import simhash

STAGES = dict(corpus_pipeline.STAGES)
WORDS = [a + b + c for a in ("ba", "co", "di", "fu", "ge", "ha") for b in ("la", "mo", "ni", "ru", "te") for c in ("", "n", "s", "ra")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(11)
    texts = {i: prose(rnd, rnd.randint(60, 400)) for i in range(60)}
    texts |= {100 + i: "short text" for i in range(3)}
    texts |= {110: "buy now " * 100, 111: " ".join("%%% ***" for _ in range(80)), 112: None, 113: ""}
    texts |= {120 + i: texts[i].replace(" ", " " * (i % 2 + 1)) for i in range(10)}  # equal but for white space
    long = prose(rnd, 6000)
    texts |= {140: long, 141: long + " ending", 142: long.replace("bala", "balas", 1)}
    return texts


@pytest.fixture(scope="module")
def stages(spark, planted):
    """The documents after each stage, as lists of rows."""
    rows = [(i, t, "s0" if i % 3 else f"s{i % 7}", "x", "clash", "clash") for i, t in planted.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, document string, copies string")
    found = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.repartition(4), "")
        found[name] = docs.collect()
        if name != "best_two_fit_packing":
            assert docs.columns == ["doc_id", "text", "source", "lang", "document", "copies"]
    return found


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_keeps_clean_documents(stages):
    assert ids(stages["quality_rules"]) == [*range(60), *range(120, 130), 140, 141, 142]


def test_exact_dedup_keeps_one_of_each(stages):
    kept = ids(stages["exact_dedup"])
    # The copy with more white space has more code points; of the others the smaller id stays.
    assert kept == sorted([i if i % 2 == 0 else 120 + i for i in range(10)] + [*range(10, 60), 140, 141, 142])


def test_near_dedup_keeps_one_of_each_component(stages):
    before = {r.doc_id: r.text for r in stages["exact_dedup"]}
    names = sorted(before)
    pairs = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and jaccard(before[a], before[b]) >= 0.8]
    lowest = simhash._lowest(len(names), *np.array(pairs).T)
    assert ids(stages["simhash_near_dedup"]) == [n for k, n in enumerate(names) if lowest[k] == k]
    assert len(set(ids(stages["simhash_near_dedup"])) & {140, 141, 142}) == 1


def test_mixing_takes_whole_copies(stages):
    before = {r.doc_id: r for r in stages["simhash_near_dedup"]}
    copies = Counter(r.doc_id for r in stages["entropy_mixing"])
    assert set(copies) <= set(before) and set(copies.values()) <= {1, 2}
    size = {i: len(r.text.split()) for i, r in before.items()}
    taken = sum(size[i] * n for i, n in copies.items())
    assert taken == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    assert all(r == before[r.doc_id] for r in stages["entropy_mixing"])


def test_packing_places_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages["entropy_mixing"])
    packed = stages["best_two_fit_packing"]
    assert sum(r.length for r in packed) == tokens
    ends = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and len(ends) <= -(-tokens // 1024) + 2


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
        docs = docs if "text" in docs.columns else None


def test_run_is_the_stages_in_a_row(spark):
    data = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, data)
    assert set(found.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert found.count() > 0


def shingled(text, words=5):
    own = text.lower().split()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def test_near_dedup_finds_scattered_edits(spark):
    rnd = random.Random(5)
    texts = {}
    for i in range(0, 300, 3):
        words = prose(rnd, rnd.randint(60, 300)).split()
        for k, edits in enumerate((0, len(words) // 60, len(words) // 20)):
            copy = list(words)
            for at in rnd.sample(range(len(words)), edits):
                copy[at] = "edited"
            texts[i + k] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    names = sorted(texts)
    pairs = [(i, j) for i in range(0, 300, 3) for j in ((i, i + 1), (i, i + 2), (i + 1, i + 2)) for i, j in [j] if jaccard(texts[i], texts[j]) >= 0.8]
    lowest = simhash._lowest(len(names), *np.array(pairs).T)
    assert len(pairs) > 100 and ids(STAGES["simhash_near_dedup"](spark, docs, "").collect()) == [n for n in names if lowest[n] == n]


def test_decisions_are_per_row(spark):
    rnd = random.Random(8)
    one, two, three, four, five = (prose(rnd, 120) for _ in range(5))
    near = three.replace(three.split()[60], "edited", 1)
    rows = [(1, one), (1, two), (None, one), (None, three), (None, four), (None, four), (2, near), (3, five), (3, five), (3, five + "  ")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    exact = STAGES["exact_dedup"](spark, docs, "")
    kept = Counter((r.doc_id, r.text) for r in exact.collect())
    assert set(kept.values()) == {1} and sorted(r[1].strip() for r in kept) == sorted([one, two, three, near, four, five])
    found = Counter(r.text.strip() for r in STAGES["simhash_near_dedup"](spark, exact, "").collect())
    assert found == Counter([one, two, near, four, five])
    mixed = STAGES["entropy_mixing"](spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in mixed) == pytest.approx(1.5 * sum(len(t.split()) for _, t in rows), abs=121)


HELPERS = (
    "again_id again_key dropped_id dropped_key more least most mixed_id mixed_key mixed_source place row key document count "
    "id node text_key root set marks band sizes"
).split()


def test_columns_named_like_helpers(spark):
    """Every helper name as a column of the documents, repeated ids and texts, and a very long text."""
    rnd = random.Random(3)
    texts = [prose(rnd, 100) for _ in range(6)] + [prose(rnd, 30_000)]
    rows = [(i, t, f"s{i % 2}", *("clash" for _ in HELPERS)) for i, t in enumerate(texts)]
    rows += rows[:3] * 2 + [(0, texts[1], None, *(None for _ in HELPERS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{h}` string" for h in HELPERS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "source", *HELPERS] and docs.count() >= 7 - (name == "entropy_mixing"), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 7
