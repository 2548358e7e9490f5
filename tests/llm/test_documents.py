"""Operators over documents against brute force, exact round trips and held-out labels, with the odd rows each must bear."""

from __future__ import annotations

import base64
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderflow.llm import arrays, bpe, counts, fingerprints, licenses, mixing, ngram_join, quality, toxicity, words
from orderflow.llm.common import read, small_batches, text_array

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, hash int"
ODD = [None, "", " \t\n", "a", "one two three four", "Ünïcode ÀÉ 漢字   x y \U0001f600՘⃁", "word " * 30_000, "same text here again and again " * 9]


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that operators use themselves."""
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), 0.0, "x", 1) for i, t in enumerate(ODD)]
    rows += [rows[7], rows[7], (7, "other text", None, "s1", 0, None, None, None), (None, "no id", None, None, 5, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"op\d+_", n)])
def test_queries_with_sql(spark, duck, name):
    assert compare(name, entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == []


# --- n-gram Jaccard join


def shingle_set(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    found = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute_components(rows):
    """key -> smallest key reachable, from all pairs."""
    sets = [(k, shingle_set(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def test_join_equals_brute_force(spark, texts):
    found = entry.queries()["op1_ngram_jaccard_join"](spark, SF)
    ours = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert ours == brute_components(sorted(texts.items()))


def test_join_around_the_threshold(spark):
    """Chains of edits whose similarity lies on both sides of 3/4, a passage that all share, and many near copies."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows, key = [], 0
    for family in range(12):
        size = [7, 20, 33, 64, 130, 300][family % 6]
        base = [f"f{family}w{i}" for i in range(size)]
        for _ in range(8):
            base = [w if rng.random() > rng.choice([0.0, 0.01, 0.03]) else f"e{rng.integers(1 << 30)}" for w in base]
            rows.append((key, " ".join(base + (passage if family % 2 else []))))
            key += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ours = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert ours == brute_components(rows)


def test_join_of_a_large_group_in_blocks(spark, monkeypatch):
    """Many copies with edits on both sides of the threshold; words of over three sets go to the blocks."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join.cluster_links, "__defaults__", (7,))
    monkeypatch.setattr(ngram_join.linked_sets, "__defaults__", (20_000, 1))
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for key in range(90):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 8)):
            text[at] = f"e{rng.integers(1 << 30)}"
        rows.append((key, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ours = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert ours == brute_components(rows)
    assert 1 < len({r[2] for r in ours}) < 60


def test_join_odd_rows(spark):
    found = ngram_join.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == 12
    by = {r.doc_id: r for r in found if r.doc_id not in (None, 7)}
    assert [by[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    assert all(by[i].component_id == i for i in range(7))
    assert ngram_join.near_duplicates(nothing(spark)).collect() == []
    one = ngram_join.one_of_each(odd_documents(spark))
    assert one.columns == odd_documents(spark).columns
    assert Counter(r.doc_id for r in one.collect()) == {**dict.fromkeys([0, 1, 2, 3, 4, 5, 6, None], 1), 7: 2}
    assert ngram_join.one_of_each(nothing(spark)).collect() == []


def test_sketch_words_never_miss():
    """Any two similar sets share an emitted word, whichever shingles come last."""
    rng = np.random.default_rng(5)
    for size in [1, 3, 4, 5, 31, 32, 40, 63, 64, 100, 127, 128, 500, 3000]:
        for _ in range(20):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            drop = rng.integers(0, size // 7 + 1)
            fresh = rng.integers(0, 1 << 63, rng.integers(0, size // 7 + 1), dtype=np.uint64)
            other = np.concatenate([base[drop:], fresh])
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            if not len(b) or 4 * both < 3 * (len(a) + len(b) - both):
                continue
            frequent = np.unique(rng.choice(base, size // 2))
            (one, _, low), (two, _, high) = (ngram_join.sketch_words(x, np.array([len(x)]), frequent) for x in (a, b))
            assert len(np.intersect1d(one, two)) >= min(low[0], high[0])


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    a, b = (np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in "ab")
    b = np.unique(np.concatenate([a[:250], b[:70]]))
    one, two = ngram_join.bit_sketches(a, np.array([len(a)])), ngram_join.bit_sketches(b, np.array([len(b)]))
    assert np.bitwise_count(one ^ two).sum() <= len(np.setxor1d(a, b))


# --- fingerprints


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in entry.queries()["op2_document_fingerprints"](spark, SF).collect()}
    ids = sorted(texts)
    prints = dict(zip(ids, fingerprints.of_texts([texts[i] for i in ids])))
    nearer = 0
    for i, key in enumerate(ids):
        text, following = texts[key], ids[(i + 1) % len(ids)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[following][:cut]
        row = rows[key]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.fingerprint == prints[key].tobytes().hex()
        assert row.edited_fingerprint == fingerprints.of_texts([edited])[0].tobytes().hex()
        assert row.near_next == (prints[key] == prints[following]).mean()
        nearer += row.near_edited > row.near_next
    assert nearer >= 0.95 * len(ids)


def test_fingerprints_meet_across_the_border(spark):
    """Near copies of 195 to 205 bytes, and an edited form that is shorter than the border, are alike."""
    rng = np.random.default_rng(3)
    base = " ".join("".join(chr(97 + c) for c in rng.integers(26, size=5)) for _ in range(80))
    copies = [base[:n] for n in range(195, 206)]
    first, second, size = fingerprints.both_of_texts(copies)
    for i in range(len(copies)):
        turned = tuple(np.repeat(x[i : i + 1], len(copies), axis=0) for x in (first, second, size))
        assert (fingerprints.compared(turned, (first, second, size)) > 0.5).all()
    rows = spark.createDataFrame([(1, base[:220]), (2, ""), (3, base[:199]), (4, base[:201])], "doc_id bigint, text string")
    found = {r.doc_id: r for r in fingerprints.edited_report(rows).collect()}
    assert found[1].near_edited > 0.2 and found[3].near_next > 0.5
    assert found[1].second_fingerprint != found[1].fingerprint


def test_fingerprints_see_order():
    base = [f"w{i}" for i in range(400)]
    moved = base[200:] + base[:200]
    shuffled = list(np.random.default_rng(1).permutation(base))
    same, after_move, mixed = fingerprints.of_texts([" ".join(x) for x in (base, moved, shuffled)])
    assert 0.2 < (same == after_move).mean() < 0.8  # pairs across the cut have turned round
    assert (same == mixed).mean() == 0


def test_fingerprints_odd_rows(spark):
    rows = fingerprints.edited_report(odd_documents(spark)).collect()
    assert len(rows) == 12
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1)} == {"0" * 8 * fingerprints.FUNCTIONS}
    assert fingerprints.edited_report(nothing(spark)).collect() == []
    alone = fingerprints.edited_report(odd_documents(spark).filter("doc_id = 4")).first()
    assert alone.near_next == 1.0


# --- mixing


def test_mix_reaches_its_targets(spark):
    rows = mixing.mix_report(read(spark, SF, "documents")).collect()
    sources = {r.doc_id: r.source for r in read(spark, SF, "documents").collect()}
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
        most[sources[r.doc_id]] = max(most[sources[r.doc_id]], r.size)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= most[source]


def test_mix_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect())[6] == [r.taken // r.size for r in rows if r.doc_id == 6][0]
    assert mixing.mix_report(nothing(spark)).collect() == [] and mixing.mixed(nothing(spark)).collect() == []


def test_mix_thresholds_are_nested(spark):
    """Twice the budget takes a superset; equal hashes are taken together."""
    slim = spark.createDataFrame(
        [(i, "s", 1 + i % 7, int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) >> (40 if i % 5 == 0 else 0)) for i in range(3000)],
        "doc_id bigint, source string, size bigint, hash bigint",
    )
    kept = []
    for budget in (100.0, 3000.0):
        plan = spark.createDataFrame([("s", budget)], "source string, budget double")
        threshold = mixing.thresholds(slim, plan).first().threshold
        rows = slim.filter(slim.hash <= threshold).collect()
        assert abs(sum(r["size"] for r in rows) - budget) <= 7 * 1000
        kept.append({r.doc_id for r in rows})
    assert kept[0] < kept[1]


# --- toxicity and quality


@pytest.mark.parametrize(
    "name, label, divisor, remainder, least", [("op4_toxicity", "toxic", 5, 0, 0.93), ("op10_quality_classifier", "quality", 4, 2, 0.97)]
)
def test_held_out_accuracy(spark, name, label, divisor, remainder, least):
    where = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in read(spark, where, "labels").collect()}
    rows = entry.queries()[name](spark, where).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == remainder) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held)


@pytest.mark.parametrize("operator, extra", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_odd_rows(spark, operator, extra):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([*[(i, i % 2, i % 2) for i in [*range(7), 3]], (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    rows = operator.report(docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r, text in zip(sorted(rows, key=str), sorted(docs.collect(), key=str)):
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_text[0] | by_text[1]) == 1  # null and empty alike
    assert operator.report(nothing(spark), labels).collect() == []
    assert operator.report(docs, labels.limit(0)).count() == 12
    kept = (operator.clean if operator is toxicity else operator.good)(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 12


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    terms = [f"t{i}" for i in range(40)]
    idf = {t: float(w) for t, w in zip(terms, rng.random(40) + 0.5)}
    texts = [" ".join(rng.choice(terms, rng.integers(1, 12))) for _ in range(300)]
    vectors = [toxicity.weights_of(t, idf) for t in texts]
    index = toxicity.build_index(list(range(300)), [float(i % 2) for i in range(300)], vectors, idf, toxicity.Params(k=10, block=16))
    for _ in range(50):
        query = toxicity.weights_of(" ".join(rng.choice(terms, 6)), idf)
        every = sorted(((-sum(w * v.get(t, 0.0) for t, w in query.items()), i) for i, v in enumerate(vectors)))
        best = [s for s, _ in every if s < 0][:10]
        assert np.allclose([-s for s, _ in toxicity.nearest(query, index)], best)


def test_pairwise_ranking_orders_by_preference():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    model = quality.train(x, y)
    assert ((model.score(x) >= quality.THRESHOLD) == (y > 0)).mean() > 0.97


# --- byte-level BPE and token counts


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_tokenizer(spark, texts, tokenizer):
    for r in entry.queries()["op6_byte_bpe"](spark, SF).collect():
        ids = tokenizer.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(spark, tokenizer):
    docs = odd_documents(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.decoded(bpe.encoded(docs, path, public_tokenizers.PATTERN), path).collect()
    ours = sorted((r.key is None, r.key or 0, r["values"], bytes(r.decoded)) for r in rows)
    assert ours == sorted((r.doc_id is None, r.doc_id or 0, tokenizer.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert bpe.report(nothing(spark), path, public_tokenizers.PATTERN).collect() == []
    blank = bpe.report(docs.filter("text = ''"), path, public_tokenizers.PATTERN).first()
    assert blank.n_tokens == 0


def test_splitting_equals_the_tokenizer_on_any_characters(tokenizer):
    rng = np.random.default_rng(8)
    split = bpe.split_with(public_tokenizers.PATTERN, bpe.newer_characters())
    newer = bpe.newer_characters()
    for _ in range(300):
        points = [int(x) for x in rng.integers(1, 0x11000, 30) if not 0xD800 <= x < 0xE000]
        text = "".join(map(chr, points)) + "".join(rng.choice(list(newer + " \n\tab1'.é"), 30))
        ids = [i for piece in split(text) for i in tokenizer._encode_single_piece(piece.encode())]
        assert ids == tokenizer.encode_ordinary(text)


def test_packing_round_trips():
    rng = np.random.default_rng(9)
    ranks = (rng.pareto(0.6, 5000) * 3).astype(np.int64).clip(0, 1 << 24).astype(np.uint32)
    assert (words.unpack_places(words.pack_places(ranks), len(ranks)) == ranks).all()
    assert len(words.unpack_places(words.pack_places(ranks[:0]), 0)) == 0
    found = ["", "a", "漢字", "x\0y", "\n"]
    assert words.unpack_words(words.pack_words(found)) == found


def brute_tokens(word, pieces):
    """The best segmentation among all of them."""
    byte = -np.log(len(pieces) + 2) - 1.0
    best = (-np.inf, 0)
    for cuts in range(1 << (len(word) - 1)):
        ends = [i + 1 for i in range(len(word) - 1) if cuts >> i & 1] + [len(word)]
        total, n, begin = 0.0, 0, 0
        for end in ends:
            own, size = word[begin:end], 1
            if own in pieces:
                total += pieces[own]
            elif len(own) == 1:
                size = len(own.encode())
                total += size * byte
            else:
                total = -np.inf
            n, begin = n + size, end
        best = max(best, (total, -n))
    return -best[1]


def test_trie_counts_equal_all_segmentations():
    rng = np.random.default_rng(10)
    names = ["a", "b", "ab", "ba", "abab", "bb", "aab", "▁", "▁a", "▁ab"]
    pieces = {p: -float(np.log(i + 2)) for i, p in enumerate(names)}
    found = list({"▁" + "".join(rng.choice(list("abcé"), rng.integers(0, 9))) for _ in range(120)})
    assert counts.trie_counts(found, pieces) == [brute_tokens(w, pieces) for w in found]


def test_token_counts(spark, texts):
    pieces = counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in entry.queries()["op7_token_counts"](spark, SF).collect()}
    for key in sorted(texts)[:30]:
        own = ["▁" + w for w in re.findall(r"[^\x20\x09-\x0D]+", texts[key])]
        assert (rows[key].n_words, rows[key].n_tokens) == (len(own), sum(counts.trie_counts([w], pieces)[0] for w in own))
    odd = {r.doc_id: r.n_tokens for r in counts.token_counts(odd_documents(spark), pieces).collect()}
    assert odd[0] == odd[1] == odd[2] == 0 and odd[6] == 30_000 * counts.trie_counts(["▁word"], pieces)[0]
    assert counts.token_counts(nothing(spark), pieces).collect() == []


# --- licenses


def brute_licenses(text):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.BASE:
        own = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(own)] == own]
    at = [i for i, _ in places]
    return len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_equals_brute_force(spark, texts):
    planted = {
        10**6: "ALL rights RESERVED, all rights reserved; cc-by CC BY",
        10**6 + 1: "general public general public license é cc by",
        10**6 + 2: None,
        10**6 + 3: "",
    }
    docs = spark.createDataFrame([*texts.items(), *planted.items()], "doc_id bigint, text string")
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        text = planted[r.doc_id] if r.doc_id in planted else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_license_method_bears_edits(spark):
    rows = [
        (1, "text before. Permission is hereby granted, free of any charge, to any person obtaining one copy. after"),
        (2, "permission is granted to read this"),
        (3, "Licensed under the Apache License, Version 2.0"),
        (4, "This work is licensed under GNU General Public License"),
    ]
    found = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: "mit", 2: "", 3: "apache", 4: "gpl"}


def test_license_odd_rows(spark):
    assert licenses.license_scan(odd_documents(spark)).count() == 12
    assert licenses.license_scan(nothing(spark)).collect() == []


def test_word_hashes():
    texts_ = ["one  Two\tone", "", " lead two", "x" * 1000]
    body = np.frombuffer("".join(texts_).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts_)])
    hashes, n = arrays.words(body, at, lower=True)
    assert n.tolist() == [3, 0, 2, 1]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4


def test_frequent_shingles_are_counted_over_all_documents(spark):
    """A passage in one document of a thousand, of more documents than a bounded sample would hold, and one that is too rare."""
    rows = spark.range(24_000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 1_000 == 7, "a passage that repeats often").when(F.col("id") % 4_000 == 9, "one that is rather rare")
        .otherwise(F.concat(F.lit("alone "), F.col("id"))).alias("text"),
    )
    for floor, most in ((0.0004, 500_000), (0.001, 500_000), (0.0004, 1)):
        found = ngram_join.frequent_shingles(rows, floor, most)
        tokens, _ = ngram_join.shingle_sets(*arrays_of(["a passage that repeats often"]))
        assert found.tolist() == tokens.tolist()


def test_rare_shingles_are_not_shuffled_to_be_counted(spark):
    """A passage in every tenth of 1,000 documents of 40 other words: the 36,000 shingles that a document has alone stay in their tasks.
    With few buckets many rare shingles share a full one, and the counts are the same."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + (" a passage that repeats often" if i % 10 == 7 else "") for i in range(1_000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "few words"])], "key long, text string").repartition(5)
    tokens, n = ngram_join.shingle_sets(*arrays_of(texts))
    token, found = np.unique(tokens, return_counts=True)
    assert n.sum() > 36_000
    for buckets, most in ((ngram_join.BUCKETS, 1_000), (1 << 14, 40_000)):
        full = ngram_join.full_buckets(rows, 4, buckets)
        held = ngram_join.shingles_in(rows, spark.sparkContext.broadcast(full))
        assert 100 <= held.count() <= most
        assert ngram_join.frequent_shingles(rows, 0.0004, buckets=buckets).tolist() == token[found >= 4].tolist()
    assert len(ngram_join.frequent_shingles(rows.limit(0))) == 0


class Taken(Exception):
    pass


class Frame:
    """Hands out the step that would run over its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, step, _):
        raise Taken(step)


def test_steps_over_texts_keep_little_memory():
    """Over 8 MB of texts, of which one word alone is in all: a counting task holds no array of 4 bytes a bucket, and work arrays follow a piece."""
    texts = ["common"] * 3_000 + [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    frequent = type("Held", (), {"value": np.zeros(0, np.uint64)})()
    for start, most in ((lambda: ngram_join.full_buckets(Frame(), 4), 40), (lambda: ngram_join.shared_words(Frame(), frequent), 12)):
        with pytest.raises(Taken) as taken:
            start()
        tracemalloc.start()
        rows = sum(out.num_rows for out in taken.value.args[0](iter([batch])))
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert rows and peak < most << 20


def test_buckets_count_past_a_byte_and_start_anew():
    tokens = np.arange(4_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [tokens[: 1 + i * 7 % 4_000] for i in range(1_500)] + [np.repeat(tokens[:3], 70_000), tokens[:0]]
    right = np.bincount(ngram_join.buckets_of(np.concatenate(sets), 1 << 11), minlength=1 << 11)
    for most_over, rounds in ((1 << 20, 1), (5_000, 2)):
        found, seen = np.zeros((64, 32), np.int64), []
        for block, counts in ngram_join.bucket_counts(iter(sets), 1 << 11, 64, most_over):
            found[block] += counts
            seen.append(block)
        assert found.reshape(-1).tolist() == right.tolist() and right.max() > 1 << 16
        assert max(seen.count(b) for b in set(seen)) >= rounds and (rounds > 1 or len(seen) == len(set(seen)))
    assert list(ngram_join.bucket_counts(iter([]), 1 << 11, 64)) == []


def test_texts_reach_workers_in_small_batches(spark):
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 5_000, 1, 1)

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)

    before = spark.conf.get(name, None)
    with small_batches(spark):
        assert max(r.n for r in docs.mapInArrow(sizes, "n bigint").collect()) == 1_000
    assert spark.conf.get(name, None) == before
    spark.conf.set(name, "300")
    try:
        with small_batches(spark):
            assert spark.conf.get(name) == "300"
        assert spark.conf.get(name) == "300"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrays_of(texts):
    return text_array(pa.array(texts))
