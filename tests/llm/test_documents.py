"""Operators on documents against plain versions, on a table of difficult rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldflux.llm import bpe, exact_dedup, fingerprints, jaccard_join, language_id, lm_scoring, packing, substring_dedup
from fieldflux.llm.common import components, dense_positions

SF = "/root/testdata/sf0.001"


def test_dense_positions(spark, equal):
    df = spark.createDataFrame([(x % 7, x) for x in range(50)] + [(None, 1)], "a long, b long")
    got = dense_positions(df, ["a", "b"]).collect()
    want = sorted([(x % 7, x) for x in range(50)])
    equal([(r.a, r.b, r.pos) for r in got], [(None, 1, 0)] + [(a, b, i + 1) for i, (a, b) in enumerate(want)])


def test_components_long_chain(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(spark, chain).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components(spark, chain.limit(0)).count() == 0


# --- 1 ---------------------------------------------------------------------------------


def test_fingerprints(messy, rows, empty):
    got = fingerprints.fingerprints(messy).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [r[0] for r in order]
    single = {i for i in ids if ids.count(i) == 1}
    after = {i: order[(k + 1) % len(order)] for k, (i, _) in enumerate(order)}
    text, checked = dict(order), 0
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in single:
            prints.setdefault(text[r.doc_id] or "", set()).add(r.fingerprint)
            assert r.n_chars == len(text[r.doc_id] or "")
        if r.doc_id in single and after[r.doc_id][0] in single:
            mine, other = text[r.doc_id] or "", after[r.doc_id][1] or ""
            half = len(mine) // 2
            edited = mine[: len(mine) - half] + other[:half]
            assert r.edited_sha256 == brute.sha(edited)
            assert (r.edited_fingerprint == r.fingerprint) or edited != mine
            if mine == other:
                assert r.near_next == 1.0
            checked += 1
    assert checked > 60 and all(len(x) == 1 for x in prints.values())
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in rows)
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprint_sums(spark):
    parts = ["one. two. three.", "four.", "five. six."]
    df = spark.createDataFrame(
        [("all", "\n".join(parts)), ("back", "\n".join(reversed(parts))), ("less", "\n".join(parts[:2])), ("rest", parts[2]), ("twice", "\n".join([*parts, parts[1]]))],
        "k string, text string",
    )
    v = fingerprints.vectors(df, ["k"], "text")
    one = lambda k: v.where(F.col("k") == k).select(F.col("wide").alias(k))
    r = one("all").crossJoin(one("back")).crossJoin(one("less")).crossJoin(one("rest")).crossJoin(one("twice"))
    r = r.select("*", fingerprints.plus(F.col("less"), F.col("rest")).alias("sum"), fingerprints.minus(F.col("all"), F.col("rest")).alias("diff")).first()
    assert r["all"] == r["back"] == r["sum"] and r["diff"] == r["less"] and r["twice"] != r["all"]


def test_likeness_follows_shared_sentences(spark):
    rnd = random.Random(3)
    sentence = lambda: " ".join(str(rnd.randrange(10**6)) for _ in range(4)) + "."
    a = [sentence() for _ in range(80)]
    data = [(p, " ".join(a), " ".join(a[: int(80 * p)] + [sentence() for _ in range(80 - int(80 * p))])) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    df = spark.createDataFrame(data, "p double, a string, b string")
    x = fingerprints.vectors(df, ["p"], "a").select("p", F.col("wide").alias("w1"), F.col("signs").alias("s1"))
    y = fingerprints.vectors(df, ["p"], "b").select("p", F.col("wide").alias("w2"), F.col("signs").alias("s2"))
    for r in x.join(y, "p").select("p", fingerprints.likeness(F.col("w1"), F.col("s1"), F.col("w2"), F.col("s2")).alias("near")).collect():
        assert abs(r.near - r.p) < 0.2


# --- 2 ---------------------------------------------------------------------------------


def test_near_duplicates(messy, rows, empty, equal):
    equal(jaccard_join.near_duplicates(messy).collect(), brute.near_components(rows))
    assert jaccard_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("leaders,share,local", [(1, 0.05, 2), (2, 2.0, 10**9)])
def test_near_duplicates_of_large_groups(spark, equal, leaders, share, local):
    """One leader, frequent shingles left out, members that only the second round brings together."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(120):
        # A chain of drifting copies, and copies that share a passage only.
        if i % 3 == 0:
            base[rnd.randrange(150)] = rnd.choice(vocab)
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(150)] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows += [(200 + i, " ".join(passage + [rnd.choice(vocab) for _ in range(rnd.randint(3, 90))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.near_duplicates(df, leaders=leaders, frequent_share=share, local=local).collect()
    equal(got, brute.near_components(rows))


def test_every_linked_pair_shares_a_segment():
    """The pigeonhole promise, for random sets of every size up to 60 and frequent shingles left out."""
    rnd = np.random.default_rng(5)
    edges = np.array(jaccard_join.bands(100), np.int64)
    for trial in range(300):
        n = int(rnd.integers(1, 61))
        a = rnd.integers(1, 1 << 62, n, dtype=np.uint64)
        keep = a[: n - int(rnd.integers(0, n // 4 + 1))]
        b = np.concatenate([keep, rnd.integers(1, 1 << 62, int(rnd.integers(0, n // 4 + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        s = jaccard_join.Sets.__new__(jaccard_join.Sets)
        a, b = np.unique(a), np.unique(b)
        s.sizes = np.array([len(a), len(b)])
        s.first, s.values = np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b])
        frequent = np.sort(rnd.choice(a, int(rnd.integers(0, len(a) + 1)), replace=False)) if trial % 2 else np.empty(0, np.uint64)
        keys, who = jaccard_join._segments(s, np.array([0, 1]), frequent, edges)
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_hamming_bounds_the_difference():
    rnd = np.random.default_rng(6)
    for _ in range(50):
        a = np.unique(rnd.integers(1, 1 << 62, int(rnd.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 3 // 4], rnd.integers(1, 1 << 62, 300, dtype=np.uint64)]))
        assert jaccard_join.hamming(jaccard_join._sketch(a), jaccard_join._sketch(b)) <= len(np.setxor1d(a, b))


def test_keep_first_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    one, near, other, third = " ".join(words), " ".join([*words, "end"]), " ".join(f"v{i}" for i in range(60)), [f"u{i}" for i in range(60)]
    rows = [(1, one), (2, near), (2, other), (None, near), (None, " ".join(third)), (None, " ".join([*third, "end"])), (None, None), (3, "")]
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    thirds = [r.text for r in kept if r.text and r.text.startswith("u0")]
    assert len(thirds) == 1
    rest = sorted((str(r.doc_id), str(r.text)) for r in kept if r.text not in thirds)
    assert rest == sorted([("1", one), ("2", other), ("None", near), ("None", "None"), ("3", "")])


def test_keep_first(messy, rows):
    kept = jaccard_join.keep_first(messy)
    assert kept.columns == messy.columns
    want = [d for d, _, c in brute.near_components(rows) if d is None or c is None or d == c]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())


# --- 3 and 6 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe(messy, rows, empty, tokenizer, equal):
    got = bpe.encode_decode(messy, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(decoded), ids, decoded))
    equal(got, want)
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_words(tokenizer):
    rnd = random.Random(1)
    alphabet = [
        "a", "b", "aa", "'s", "'t", "É", "é", "ß", "Σ", "İ", "1", "22", "²", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "日本",
        "\U0001f600", "‍", "...", "!!!", "ing", "the", "﻿", "\x00", "ﬁ", "ǅ", "ͅ", " ", "　", "ABC", "<|startoftext|>",
    ]
    words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    words += ["a" * n for n in range(1, 40)] + ["la" * n for n in range(1, 20)] + ["hahaha" * 30, "ab" * 200]
    ids, counts = bpe.Vocabulary(bpe.vocabulary_path()).encode_words(words)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, w in enumerate(words):
        assert ids[ends[i] : ends[i + 1]].tolist() == tokenizer.encode(w, add_special_tokens=False).ids, repr(w)


def test_first_fit():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 60))]
        bins = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            for b in bins:
                if sum(lengths[x] for x in b) + lengths[i] <= 100:
                    b.append(i)
                    break
            else:
                bins.append([i])
        assert packing.first_fit_decreasing(lengths, 100) == bins


@pytest.mark.parametrize("size,group_docs", [(2048, 2048), (64, 7)])
def test_packing(messy, rows, empty, tokenizer, size, group_docs):
    got = packing.pack(messy, size=size, group_docs=group_docs).collect()
    docs = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    single = {i: ids for i, ids in docs if sum(j == i for j, _ in docs) == 1}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in single.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in docs)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    assert padding <= 0.01 * sum(len(ids) for _, ids in docs) if size == 2048 else True
    assert packing.pack(empty).count() == 0


# --- 4 ---------------------------------------------------------------------------------


def test_substring_dedup(messy, rows, empty, equal):
    want = brute.repeated_spans(rows)
    assert sum(r[2] > 0 for r in want) > 20
    equal(substring_dedup.substring_dedup(messy).collect(), want)
    equal(substring_dedup.substring_dedup(messy, digest=True).collect(), [(*r[:3], brute.sha(r[3])) for r in want])
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_short_windows(spark, equal):
    """Few words, so that windows repeat and branch everywhere."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    equal(substring_dedup.substring_dedup(df, window=9, k=3).collect(), brute.repeated_spans(rows, 9))


def test_remove_spans(messy, rows):
    got = substring_dedup.remove_spans(messy)
    assert got.columns == messy.columns
    want = [(i, kept if gone else t, len(kept) if gone else None if t is None else len(t)) for (i, t), (_, n, gone, kept) in zip(rows, brute.repeated_spans(rows), strict=True) if not n or gone < n]
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=key) == sorted(want, key=key)


# --- 8 ---------------------------------------------------------------------------------


def test_language_id(spark, messy, rows, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(known)
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) > 0.95
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. !"), (None, "le de la que"), (5, "the of and")], "doc_id long, text string").withColumn("lang", F.lit("xx"))
    by = {r.doc_id: r for r in language_id.identify(odd, model=model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0 and by[5].lang_pred == "en" and not by[None].held_out
    assert language_id.identify(empty).count() == 0
    again = language_id.identify(messy).collect()
    assert len(again) == len(rows) and {r.lang_pred for r in again} <= {"en", "de", "", "und"}
    assert language_id.identify(messy.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_unseen_words_back_off():
    model = language_id.Model(
        ["a", "b"], np.zeros(2), {"known": 0}, np.array([[-0.1, -3.0]]), {"zz": 0, "z": 1, "q": 2}, np.array([[-3.0, -0.1], [-1.0, -1.0], [-0.5, -2.0]])
    )
    assert model.word("known").tolist() == [-0.1, -3.0]
    # z alone, then zz, then the end, for which nothing is known.
    assert np.allclose(model.word("zz"), [-2.0, -0.55])
    assert model.word("xyx").tolist() == [0.0, 0.0]


def test_keep_identified(spark, messy):
    got = language_id.keep_identified(messy, least=0.0)
    assert got.columns == messy.columns
    want = [r.text for r in messy.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    assert sorted(r.text for r in got.collect()) == sorted(want)


# --- 9 ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1024, 5])
def test_exact_dedup(messy, rows, empty, equal, block):
    equal(exact_dedup.exact_dedup(messy, block).collect(), brute.copies(rows))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_block_names_tell_every_difference(spark):
    """Equal names for equal texts and only for them, whatever the hash before the bytes is worth."""
    texts = ["", "a", "ab", "ba", "abab", "ababa", "ababab", "bababa", "abababab" * 9, "abababab" * 8 + "ababbaba", "é", None, "ababab", "a\x00", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for order in (F.xxhash64, F.octet_length, lambda _: F.lit(1)):
        names = {r.row: (r.n_bytes, r.level, r.name) for r in exact_dedup.block_names(df, block=2, order=order).collect()}
        assert set(names) == set(range(len(texts)))
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert (names[i] == names[j]) == ((a or "") == (b or ""))


def test_drop_copies(messy, rows):
    got = exact_dedup.drop_copies(messy)
    assert got.columns == messy.columns
    kept = Counter((r.doc_id, r.text or "") for r in got.collect())
    want = {(i, t or "") for (i, t), c in zip(rows, brute.copies(rows), strict=True) if c[3]}
    assert set(kept) == want and set(kept.values()) == {1}


# --- 10 --------------------------------------------------------------------------------


@pytest.mark.parametrize("held", [1 << 19, 20])
def test_lm_scores(messy, rows, empty, held):
    got = lm_scoring.class_scores(messy, types=40, endings=10, classes=6, held=held).collect()
    end = object()
    seen = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if i is not None and not out(i):
            seen.update([*brute.words(brute.lower(t)), end])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        w = [*brute.words(brute.lower(t)), end]
        want.append((str(i), out(i), len(w), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert lm_scoring.class_scores(empty).count() == 0
    alone = lm_scoring.class_scores(messy.where("doc_id is null")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in alone} == {(0, 0, 0.0)}


def test_lm_perplexity_of_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [r for r in lm_scoring.class_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_exchange_finds_the_classes():
    """Words of two kinds that take turns, whatever their numbers."""
    rnd = np.random.default_rng(8)
    kind = rnd.integers(0, 2, 30)
    pairs = np.zeros((31, 31), np.int64)
    for a in range(30):
        for b in range(30):
            pairs[a, b] = rnd.integers(20, 60) if kind[a] != kind[b] else rnd.integers(0, 3)
    of = lm_scoring.exchange(pairs, classes=2)
    assert len({(k, c) for k, c in zip(kind, of[:30], strict=True)}) == 2 and of[30] == 2


def test_model_is_a_distribution():
    rnd = np.random.default_rng(9)
    pairs = rnd.integers(0, 9, (12, 12))
    counts = rnd.integers(1, 9, 12).astype(float)
    model = lm_scoring._class_model(pairs, counts, np.ones(12), 4)
    assert np.allclose((10**model.steps).sum(axis=1), 1)
    for c in range(4):
        own = np.flatnonzero(model.class_of == c)
        # Each known word (count + 1) and one unknown.
        assert math.isclose((counts[own].sum() + len(own) + 1) / 10 ** model.spread[c], 1)


def clusters(pairs, of, k):
    one = np.zeros((len(of), k + 1))
    one[np.arange(len(of)), of] = 1
    return one.T @ pairs @ one


def test_best_classes_raise_the_likelihood_most():
    rnd = np.random.default_rng(10)
    n, k = 30, 4
    pairs, of = rnd.integers(0, 4, (n, n)) * rnd.integers(0, 2, (n, n)), rnd.integers(0, k, n)
    of[-1] = k
    apart = pairs * (1 - np.eye(n, dtype=int))
    right, left = (np.array([np.bincount(of, x, k + 1) for x in m]) for m in (apart, apart.T))
    got = lm_scoring.best_classes(clusters(pairs, of, k), of[:-1], right[:-1], left[:-1], np.diag(pairs)[:-1].astype(float))
    for w in range(n - 1):
        value = [lm_scoring.likelihood(clusters(pairs, np.where(np.arange(n) == w, d, of), k)) for d in range(k)]
        assert math.isclose(value[got[w]], max(value), rel_tol=1e-12)


@pytest.mark.parametrize("held", [1 << 19, 300])
def test_rare_words_have_classes_of_their_own(spark, held):
    """Two kinds of words take turns, all of one ending, most beyond the most frequent types."""
    rnd = random.Random(11)
    kinds = [[f"{s}{i}xx" for i in range(400)] for s in "pq"]
    docs = [" ".join(rnd.choice(kinds[j % 2]) for j in range(40)) for _ in range(600)]
    turns, mixed = docs[0], " ".join([*docs[0].split()[::2], *docs[0].split()[1::2]])
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, turns), (None, mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.score for r in lm_scoring.class_scores(df, types=40, endings=10, classes=4, held=held).collect() if r.doc_id is None)
    assert got[1] - got[0] > 5


def test_texts_that_lose_nothing_are_not_stored_again(messy):
    every = {(r.doc_id, r.h): r for r in substring_dedup._deduped(messy, 50, 8, False).collect()}
    few = {(r.doc_id, r.h): r for r in substring_dedup._deduped(messy, 50, 8, False, whole=False).collect()}
    assert every.keys() == few.keys()
    for key, r in few.items():
        assert r.n_removed == every[key].n_removed
        assert r.kept_text == every[key].kept_text or (r.kept_text is None and r.n_removed == 0)
    assert any(r.kept_text is None and r.n_words for r in few.values()) and any(r.n_removed for r in few.values())
