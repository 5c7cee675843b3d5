"""The registered queries over a whole small data folder, against SQL or brute force."""

import base64
import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from math import log2, log10
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences, duck_rows, spark_rows  # noqa: E402

from millrace.llm.lm_scoring import MU  # noqa: E402
from millrace.llm.queries import ORACLES, QUERIES  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def rows_of(spark, name):
    return QUERIES[name](spark, DATA).collect()


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert differences(spark_rows(QUERIES[name](spark, DATA)), duck_rows(connect(DATA), ORACLES[name])) == []


@pytest.mark.parametrize("name", ["op7_chat_format", "op8_disclosure"])
def test_native_queries_run_no_python(spark, name):
    df = QUERIES[name](spark, DATA)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def simhash(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_op1_against_all_pairs(spark, documents):
    ids = sorted(documents)
    fps = np.array([simhash(documents[i]) for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    expected = {(ids[i], f"{int(fps[i]):016x}", ids[find(i)]) for i in range(len(ids))}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows_of(spark, "op1_simhash_vp_tree")} == expected


@pytest.fixture(scope="module")
def token_ids(documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in documents.items()}


def test_op2_against_the_library(spark, documents, token_ids):
    expected = {(i, len(t.encode()), len(token_ids[i]), len(token_ids[i]) > 1024) for i, t in documents.items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows_of(spark, "op2_token_counts")} == expected


def test_op4_meets_its_targets(spark, documents):
    found = rows_of(spark, "op4_entropy_balancing")
    sources = {r["doc_id"]: r["source"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    total, taken, goal = Counter(), Counter(), {}
    for r in found:
        assert r.size == len(documents[r.doc_id].encode().split()) and 0 <= r.taken <= 2 * r.size
        source = sources[r.doc_id]
        total[source] += r.size
        taken[source] += r.taken
        goal[source] = (r.source_size, r.target)
    assert len(found) == len(documents)
    order = sorted(total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, expected, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole > 2 * total[s]}
        expected |= {s: 2 * total[s] if s in full else left * weight[s] / whole for s in (full or open_)}
        left -= sum(expected[s] for s in full)
        open_ = open_ - full if full else set()
    smallest = {s: min(r.size for r in found if sources[r.doc_id] == s and r.size) for s in order}
    for s in order:
        assert goal[s][0] == total[s] and goal[s][1] == pytest.approx(expected[s])
        assert abs(taken[s] - expected[s]) <= smallest[s] + 2e-3 * expected[s]
    again = {r.doc_id: r.taken for r in rows_of(spark, "op4_entropy_balancing")}
    assert again == {r.doc_id: r.taken for r in found}


def test_op6_places_every_token_once(spark, token_ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op6_best_two_fit"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(token_ids)
    for i, ids in token_ids.items():
        whole, at = np.array([*ids, 2], "<u4"), 0
        for number, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (number, at) and (p.length == 1024 or number == 0)
            assert p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    fewest = -(-sum(len(ids) + 1 for ids in token_ids.values()) // 1024)
    assert len(sequences) <= 1.02 * fewest + 1


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            keep = {
                "email": True,
                "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])),
                "card": 14 <= len(digits) <= 19 and luhn,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if keep:
                found.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_op8_base_spans(spark, documents):
    found = rows_of(spark, "op8_disclosure")
    assert len(found) == len(documents)
    for r in found:
        spans = base_spans(documents[r.doc_id])
        counts = Counter(s.split(":")[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}


def revealing_terms(texts, support=3, generalise=0.8):
    """Terms that reveal an entity, from all texts."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    near = set()
    for text in set(texts):
        valid = set(base_spans(text))
        for kind, pattern in PATTERNS.items():
            found = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
            ends, starts = [0] + [e for _, e in found], [s for s, _ in found[1:]] + [len(text)]
            for (start, end), before, after in zip(found, ends, starts):
                if f"{kind}:{start}:{end}" not in valid:
                    continue
                value = text[start:end].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[start:end])
                left, right = text[before:start][-120:], text[end:after][:120]
                a, b = ([t for t in letters(side) if len(t) >= 3] for side in (left, right))
                a, b = a[len(left) >= 120 :][-5:], (b[:-1] if len(right) >= 120 else b)[:5]
                near |= {((kind, value), term, " ".join(a + b), text) for term in a + b}
    n_term, n_entity, both, places = Counter(), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in set(texts):
        n_term.update(set(letters(text)))
    for entity, term, place, text in near:
        n_entity[entity].add(text)
        both[entity, term].add(text)
        places[entity, term].add(place)
    total, out = len(set(texts)), set()
    for (entity, term), here in both.items():
        information = log2(total / len(n_entity[entity]))
        shared = log2(len(here) * total / (n_term[term] * len(n_entity[entity])))
        if len(places[entity, term]) >= support and information > 0 and shared / information >= generalise:
            out.add(term)
    return out


def held_to_terms(found, texts):
    """Terms that reveal; each row's term spans are theirs."""
    revealing = revealing_terms(texts.values())
    for r in found:
        spans = {s for s in r.spans.split(",") if s.startswith("term:")}
        words = re.finditer(r"[^\W\d_]+", texts[r.doc_id])
        assert spans == {f"term:{m.start()}:{m.end()}" for m in words if m[0].lower() in revealing}
    return revealing


def test_op8_term_spans(spark, documents):
    held_to_terms(rows_of(spark, "op8_disclosure"), documents)


def test_op8_marks_a_term_with_three_neighbourhoods(spark, tmp_path):
    texts = [f"{a} told Zorgon at z@example.com about {b}" for a, b in zip(("anna", "bert", "carl"), ("doors", "eggs", "fish"))]
    texts += [f"{a} told Quux at q@example.com about {a}" for a in ("anna", "bert")]
    texts += [*texts, *(f"someone told me about item {i} at home" for i in range(40))]
    texts = dict(enumerate(texts))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert held_to_terms(QUERIES["op8_disclosure"](spark, str(tmp_path)).collect(), texts) == {"zorgon"}


def test_op9_against_a_dictionary_model(spark, documents):
    words = {i: t.encode().lower().split() for i, t in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    single, pair, starts = Counter(), Counter(), 0
    for i, w in words.items():
        if not held[i]:
            walk = ["start", *w, "end"]
            single.update(walk[1:])
            pair.update(zip(walk, walk[1:]))
            starts += 1
    n, v = sum(single.values()), len(single)
    after = lambda h: starts if h == "start" else single[h]
    better = []
    for r in rows_of(spark, "op9_backoff_automaton"):
        walk = ["start", *words[r.doc_id], "end"]
        root = [(single[x] + 1) / (n + v + 1) for x in walk[1:]]
        score = sum(log10((pair[h, x] + MU * p) / (after(h) + MU)) for h, x, p in zip(walk, walk[1:], root))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(walk) - 1, n)
        assert r.n_known == sum(single[x] > 0 for x in walk[1:])
        assert r.base_score == pytest.approx(sum(map(log10, root))) and r.score == pytest.approx(score)
        if r.held_out:
            better.append(r.score - r.base_score)
    assert sum(better) > 0  # the context helps on texts that weren't trained on


def test_op10_against_all_pages(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    largest = {}
    for i, payload in pages.items():
        largest[payload] = max(i, largest.get(payload, i))
    expected = {
        (i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if largest[p] == i else ("revisit", largest[p])))
        for i, p in pages.items()
    }
    found = rows_of(spark, "op10_warc_chunks")
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == expected
