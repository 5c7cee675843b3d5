"""Each method's own parts against brute force."""

import gzip
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import (
    bpe, chat, exact_dedup, lm_scoring, mixing, packing, pii, quality_rules, simhash, token_counts, warc,
)
from millrace.llm.queries import tokenizer
from millrace.sources.shared import fresh_path

ALPHABET = [
    " ", "  ", "\n", "\t", "a", "b", "Z", "é", "'s", "'", "1", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ",
    "​", "　", "中", "\r", "\x0b", "🙂", "...", "́", "\x00", "_", "²", "'LL", "'re",
]


# 1: SimHash


def all_links(fps, reach):
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= reach)
    return simhash._lowest(len(fps), i, j)


@pytest.mark.parametrize("centres,flips,bits", [(800, 3, 64), (3, 8, 64), (3, 8, 12), (1, 3, 64)])
def test_tree_loses_no_link(centres, flips, bits):
    rng = np.random.default_rng(centres + bits)
    base = rng.integers(0, 2**64, 1200, dtype=np.uint64)
    near = base[rng.integers(0, centres, 800)]
    for _ in range(flips):
        near = near ^ (np.uint64(1) << rng.integers(0, bits, 800).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, [np.uint64(0)]]))
    tree = simhash.fit(np.sort(rng.choice(fps, 300, replace=False)), 20)
    at, shards, guest = simhash.route(tree, fps, 2)
    assert np.array_equal(np.sort(at[~guest]), np.arange(len(fps)))  # everyone is at home once
    left, right = [], []
    for shard in np.unique(shards):
        own = shards == shard
        a, b = simhash.links_within(fps[at[own]], guest[own], 2, leaf=8)
        assert (np.bitwise_count(fps[at[own]][a] ^ fps[at[own]][b]) >= 1).all()
        left.append(at[own][a])
        right.append(at[own][b])
    found = simhash._lowest(len(fps), np.concatenate(left), np.concatenate(right))
    assert np.array_equal(found, all_links(fps, 2))


def test_shards_in_spark(spark):
    rng = np.random.default_rng(8)
    fps = rng.integers(-(2**63), 2**63, 600)
    fps = np.unique(np.concatenate([fps, fps[:200] ^ 5, fps[:100] ^ 7]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    roots = simhash.components(simhash.close_links(df, 2, shard=64, sample=200)).collect()
    lowest = all_links(fps.view(np.uint64), 2)
    groups = {}
    for r in roots:
        groups.setdefault(r.root, set()).add(r.node)
    expected = {}
    for i, low in enumerate(lowest):
        expected.setdefault(low, set()).add(int(fps[i]))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(9, 3), (3, 9), (4, 4)],
                                   [(i, 59 - i) for i in range(30)] + [(i, i + 3) for i in range(0, 20, 3)], []])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    names = sorted({n for link in links if link[0] != link[1] for n in link})
    lowest = simhash._lowest(60 + 1, np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
    assert sorted(found) == names
    for a in names:
        for b in names:
            assert (found[a] == found[b]) == (lowest[a] == lowest[b])


# 2: token counts


def test_encoder_is_the_library():
    known = bpe.Encoder(tokenizer())
    assert known.fast is not None
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += [f"x{chr(c)}y {chr(c)}{chr(c)}1{chr(c)} !{chr(c)}  {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" " * 300_000, "\n " * 50_000, "1" * 50_000, "a" * 50_000]
    for text, got in zip(texts, known.library.encode_batch(texts, add_special_tokens=False)):
        assert known.ids(text).tolist() == got.ids and known.count(text) == len(got.ids)


def test_cache_is_used_and_grows(spark):
    cache = fresh_path(spark, "test-cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer(), cache).collect()} == {1: 2, 2: 2, 3: 0}
    folder = f"{cache}/tokenizer={bpe.version(tokenizer())}"
    assert spark.read.parquet(folder).count() == 2
    digest = spark.read.parquet(folder).where("n_tokens = 2").first().digest
    spark.createDataFrame([(digest, 1)], "digest binary, n_tokens long").write.mode("append").parquet(folder)
    more = spark.createDataFrame([(1, "a b"), (4, "c d e")], "doc_id long, text string")
    for most in (0, 100):  # joined on both sides, and by broadcast
        found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, tokenizer(), cache, most_sent=most).collect()}
        assert found == {1: 1, 4: 3}  # the first is as the cache says
    assert spark.read.parquet(folder).count() == 4


# 3: exact duplicates


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 400))
def test_fingerprints_compose(data, cut):
    field = exact_dedup.Field()
    left, right = data[:cut], data[cut:]
    pairs = zip(exact_dedup.fingerprint(left, field), exact_dedup.fingerprint(right, field), field.points)
    whole = tuple(exact_dedup.combine(a, b, len(right), p, field.prime) for a, b, p in pairs)
    assert whole == exact_dedup.fingerprint(data, field)
    value = 0
    for byte in data:
        value = (value * field.points[0] + byte) % field.prime
    assert whole[0] == value


@pytest.mark.parametrize("prime,segment,most", [((1 << 31) - 1, 1 << 22, 500_000), (2, 1 << 22, 0), ((1 << 31) - 1, 7, 0), (3, 5, 500_000)])
def test_weak_fingerprints_and_small_segments_give_the_same_groups(spark, prime, segment, most):
    rnd = random.Random(segment)
    texts = [" ".join(rnd.choice(["ab", "ba", "é", "c"]) for _ in range(rnd.randint(0, 5))) for _ in range(120)]
    texts = [t if rnd.random() < 0.5 else t.replace(" ", "  \n") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    expected = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    field = exact_dedup.Field(prime=prime)
    found = exact_dedup.exact_groups(docs, field=field, segment=segment, most_sent=most).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == expected


def test_a_large_group_is_compared_in_shares(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 10)
    docs = spark.range(95).select(F.col("id").alias("doc_id"), F.lit("x" * 150_000).alias("text"))
    found = exact_dedup.exact_groups(docs).collect()
    assert len(found) == 95 and {(r.keep_id, r.group_size) for r in found} == {(0, 95)}


# 4: mixing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_share_everything(sizes):
    found = mixing.targets(sizes)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    level = [found[s] / (3, 1, 2)[i % 3] for i, s in enumerate(order) if found[s] < 2 * sizes[s] - 1e-6]
    assert all(found[s] <= 2 * sizes[s] + 1e-6 for s in sizes) and (not level or max(level) - min(level) < 1e-6)


def test_rates_solve_the_dual(spark):
    rnd = random.Random(2)
    rows = [(i, f"s{i % 4}", rnd.randint(0, 400)) for i in range(800)]
    sized = spark.createDataFrame(rows, "id long, source string, size long")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    total = Counter()
    for _, s, z in rows:
        total[s] += z
    share = {"s0": 0.3, "s1": 1.0, "s2": 1.9, "s3": 0.01}
    goal = {s: (total[s], share[s] * total[s], total[s] / 200) for s in total}
    for s, tilt in mixing.balance(counts, goal, 2).items():
        taken = sum(z * min(2.0, np.exp(min(tilt * z / goal[s][2], 50))) for _, t, z in rows if t == s)
        assert taken == pytest.approx(goal[s][1], rel=1e-5)


# 5: quality rules


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#|é", max_size=60))
def test_measurements(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    found = dict(zip(quality_rules.MEASUREMENTS, quality_rules.measure(text.encode())))
    assert found == {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_alpha_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_ablations(spark):
    bits = [0, 1, 1, 3, 2, 6, 32]
    book = spark.createDataFrame([(b,) for b in bits], "failed_bits long")
    policies = [quality_rules.BASE, quality_rules.STANDARD]
    found = {(r.version, r.rule): (r.n_failed, r.n_only_this) for r in quality_rules.ablations(book, policies).collect()}
    assert found["base", "few_words"] == (3, 2) and found["base", "repeated_words"] == (3, 2)
    assert found["standard-1", "repeated_words"] == (3, 1) and found["standard-1", "few_letters"] == (1, 1)


# 6: packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_every_piece_once(counts):
    bins = packing.plan(counts, 64)
    used = Counter()
    for inside, times in bins:
        assert sum(length * n for length, n in inside.items()) <= 64 and times > 0
        for length, n in inside.items():
            used[length] += n * times
    assert used == Counter(counts)


def test_two_pieces_take_the_place_of_the_smallest():
    # Greedy fills 60 with 30 and leaves a gap of 10; 21 and 19 fill it.
    assert packing.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == ({60: 1, 21: 1, 19: 1}, 1)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 50)) for i in range(40)], "doc_id long, text string")
    placed = packing.place(packing.pieces(docs, tokenizer(), 2, 64), ["doc_id", "piece"], 64)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tobytes() == r.ids


# 7: chat


def test_round_trip(spark):
    rnd = random.Random(3)
    bits = [*chat.INSTRUCT.controls, "\\", "\\a", "<", ">", "[", "]", "/", " ", "\n", "S", "a", "é", "", " [/INST] "]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
    roles = ["user", "assistant", "system", "tool", "[ROLE]", "a[TEXT]b", "\\"]
    rows = [(c, t, rnd.choice(roles), text()) for c in range(300) for t in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).select("conv_id", "segments", "valid", chat.joined(F.col("segments")).alias("formatted"))
    back = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))})
    for r in back.collect():
        own = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        assert r.valid == bool(re.fullmatch("s?(ua)+", "".join(x[0] if x in roles[:3] else "?" for x, _ in own)))
        for s in r.segments[1::3]:
            assert not any(c in s.text for c in chat.INSTRUCT.controls)


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Template((chat.Turn("user", "<u>", "<<u>"),), {}, frozenset())


# 8: sanitising


def test_spans_like_python(spark):
    rnd = random.Random(4)
    parts = ["a", "b1", "@", "@x.y", ".", "1", "22.3", "255.", "+1 ", "+", "(", "555", "-", " ", "é", "🙂", "4111 1111 1111 1111",
             "_", "%", "4111111111111111", "1.2.3.4", "300.1.1.1", "a@b.cc_d@e.ff", "\n", "0001."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    texts += ["1" * 3000 + " " + "1 " * 1000, "a@b.cc " * 700]
    from test_llm_queries import base_spans

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.with_matches(pii.texts_of(df, "doc_id", "text")).select("id", pii.as_text(pii.spans(pii.KINDS[:4])).alias("s"))
    for r in found.collect():
        assert r.s == ",".join(base_spans(texts[r.id]))


def test_long_runs_take_no_stack(spark):
    text = "1 " * 200_000 + "a" * 300_000 + "@" + "." * 1000 + "+" + "1" * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find(df).count() == 1


@pytest.mark.parametrize("most", [0, 1000])
def test_revealing_terms(spark, most):
    near = [f"{a * 3} says Zorgon wrote from z@example.com about {b * 3}" for a, b in zip("abcdefgh", "ijklmnop")]
    other = [f"someone wrote about item {i} from here and says nothing" for i in range(40)]
    copies = ["only here Quux with q@example.com today"] * 9
    texts = [*near, *other, *copies, "ZORGON was seen, zorgonite was not"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(df, most_sent=most).withColumn("spans", pii.spans())
    rows = {r.id: r for r in found.select("id", "spans", "text", pii.sanitised(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert rows[0].out == "aaa says [TERM] wrote from [EMAIL] about iii"  # P(entity | term) is 8 of 9
    terms = {i: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for i, r in rows.items()}
    assert terms[len(texts) - 1] == ["ZORGON"] and all(t == ["Zorgon"] for t in (terms[i] for i in range(8)))
    assert not any(terms[i] for i in range(8, len(texts) - 1))  # copies are one neighbourhood


# 9: scores


def test_probabilities_after_a_state_sum_to_one(spark):
    texts = ["a b a c", "b a", "c c b", "a"]
    probe = ["a a", "a b", "a c", "a", "a unseen"]  # each way to go on after "a"
    docs = spark.createDataFrame(list(enumerate(texts + probe)), "doc_id long, text string")
    for bytes_, rows in ((1 << 20, 100), (1, 2)):  # one block and bucket, or many
        found = lm_scoring.score(docs, F.col("doc_id") >= len(texts), block_bytes=bytes_, bucket_rows=rows).collect()
        score = {r.doc_id: r.score for r in found}
        n, v, mu = 4 + 2 + 3 + 1 + 4, 4, lm_scoring.MU
        single = {"a": 4, "b": 3, "c": 3, "end": 4}
        pair = {"b": 1, "c": 1, "end": 2}
        p = {w: (pair.get(w, 0) + mu * (single.get(w, 0) + 1) / (n + v + 1)) / (4 + mu) for w in ("a", "b", "c", "end", "new")}
        assert sum(p.values()) == pytest.approx(1)
        start = (2 + mu * 5 / (n + v + 1)) / (4 + mu)
        assert 10 ** score[len(texts) + 3] == pytest.approx(start * p["end"])
        assert 10 ** score[len(texts) + 4] == pytest.approx(start * p["new"] * mu / (0 + mu) * 5 / (n + v + 1))


# 10: WARC


def test_chunked_records_round_trip(spark):
    rnd = random.Random(6)
    payloads = [rnd.randbytes(rnd.choice([0, 1, 99, 100, 101, 5000])).hex() for _ in range(60)]
    payloads += payloads[:20] + ["WARC/1.1\r\n\r\n\r\n" * 30]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nbad: 1", p) for i, p in enumerate(payloads)], "page_id long, url string, html string")
    for least in (0, 150):
        folder = fresh_path(spark, "test-warc")
        archives = warc.write_archives(pages.repartition(3), folder, least_bytes=least, chunk=100, file_bytes=3000)
        chunks = warc.read_archives(archives, chunk=64).collect()
        assert archives.count() > 3 and max(len(c.data) for c in chunks) <= 64
        last = {p: i for i, p in enumerate(payloads)}
        whole = {}
        for c in sorted(chunks, key=lambda c: (c.id, c.chunk_no)):
            whole[c.id] = whole.get(c.id, b"") + c.data
            if c.last and c.record_type == "response":
                assert c.digest_so_far == c.declared_digest and c.bytes_so_far == len(payloads[c.id])
        for c in (c for c in chunks if c.last):
            revisit = last[payloads[c.id]] != c.id and len(payloads[c.id]) >= least
            assert c.refers_to == (last[payloads[c.id]] if revisit else None)
            assert whole[c.id] == (b"" if revisit else payloads[c.id].encode())


def test_reader_takes_what_other_tools_write():
    body = b"x" * 300_000
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-record:7>\r\nContent-Length: %d\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    archive = b"".join(gzip.compress(head % (len(http) + len(b)) + http + b + b"\r\n\r\n") for b in (body, b""))
    rows = list(warc.records_of(io.BytesIO(archive), 100_000))
    assert [(r[6], r[7], r[8]) for r in rows] == [(0, False, 100_000), (1, False, 200_000), (2, True, 300_000), (0, True, 0)]
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(archive[: len(archive) // 2]), 1000))


def test_the_machine_decides_what_a_strict_loss_counts(spark):
    turns = {
        1: ["user", "assistant", "user", "assistant"], 2: ["user", "assistant", "assistant", "user", "assistant"], 3: ["assistant", "user"],
        4: ["user"], 5: ["system", "user", "assistant"], 6: ["user", "narrator", "assistant"],
    }
    rows = [(c, i, role, f"{role}{i}") for c, roles in turns.items() for i, role in enumerate(roles)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    strict, every = (chat.loss_text(F.col("segments"), strict=s).alias(str(s)) for s in (True, False))
    found = {r.conv_id: (r.valid, r.error_turn, r["True"], r["False"]) for r in out.select("conv_id", "valid", "error_turn", strict, every).collect()}
    assert found == {
        1: (True, None, "assistant1assistant3", "assistant1assistant3"), 2: (False, 2, "assistant1", "assistant1assistant2assistant4"),
        3: (False, 0, "", "assistant0"), 4: (False, 1, "", ""), 5: (True, None, "assistant2", "assistant2"), 6: (False, 1, "", "assistant2"),
    }


def test_the_rule_that_alone_rejects(spark):
    masks = [0, 1, 2, 3, 32, 33]
    book = spark.createDataFrame([(m,) for m in masks], "failed_bits long")
    found = {r[0]: (r[1], r[2]) for r in book.select("failed_bits", quality_rules.only_rule(quality_rules.STANDARD), quality_rules.only_rule(quality_rules.BASE)).collect()}
    assert found == {0: (None, None), 1: ("few_words",) * 2, 2: ("repeated_words",) * 2, 3: (None, None), 32: ("few_letters", None), 33: (None, "few_words")}


def test_archive_folders_are_qualified(spark, tmp_path):
    assert warc.arrow_uri(spark, str(tmp_path)) == f"file://{tmp_path}" == warc.arrow_uri(spark, f"file:{tmp_path}")
    pages = spark.createDataFrame([(1, "a", "u"), (2, "a", "u")], "page_id long, html string, url string")
    listed = warc.write_archives(pages, str(tmp_path / "no-scheme"))
    assert all(r.path.startswith("file:///") for r in listed.collect())
    assert sorted((r.id, r.record_type) for r in warc.records_read(warc.read_archives(listed)).collect()) == [(1, "revisit"), (2, "response")]
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./in", f"file://{tmp_path}")
    with pytest.raises(ValueError, match="can't be kept"):
        warc.arrow_uri(spark, "viewfs://odd/in")


def test_marked_texts_are_joined_either_way(spark):
    odd = ["apple", "berry", "cherry", "damson", "elder", "figs"]
    texts = [(i, f"{odd[i]} {odd[-1 - i]} secretname a@b.cc {odd[(i + 2) % 6]}") for i in range(6)]
    texts += [(10 + i, f"{odd[i % 6]} {odd[(i + 1) % 6]} plain words") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = lambda **given: {(r.id, m.value) for r in pii.find(docs, **given).collect() for m in r.term}
    found = marked(most_bytes=0)
    assert found == marked(most_bytes=1 << 30) and {(i, "secretname") for i in range(6)} <= found
    assert marked(shortest_term=20) == set() and marked(near_chars=3) == set() and marked(support=7) == set()
