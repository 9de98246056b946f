"""Centroid clustering, toxicity and filter audit against plain versions and SQL, on difficult rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldflux.llm import centroids, filter_audit, toxicity
from fieldflux.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op13_filter_audit"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = sorted(got.columns)
    at = [[c[0] for c in cur.description].index(c) for c in names]
    want = sorted(tuple(repr(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(repr(r[c]) for c in names) for r in got.collect()) == want


# --- 11 --------------------------------------------------------------------------------


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_hilbert_neighbours_touch(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    key = centroids.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def plain_clusters(rows, k, rounds, dim, seed):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    now = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(now)), key=lambda c: (far(v, now[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for c in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            now[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v), far(v, now[nearest(v)])) for i, v in kept], now


def vectors(spark, rows):
    data = [(i, v, n, n, "x", n) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, key long, x long, ids string, cluster long").repartition(5, "key")


def test_clusters(spark, equal):
    rnd = random.Random(5)
    dim, inf = 6, float("inf")
    point = lambda: [round(rnd.gauss(rnd.choice([-1, 0, 2]), 0.3), 3) for _ in range(dim)]
    rows = [(i, point()) for i in range(900)] + [(2000 + i, [0.5] * dim) for i in range(400)] + [(7, point()), (7, point()), (None, point()), (None, [0.25] * dim)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * (dim - 1)), (3003, [1.0] * (dim + 1)), (3004, [None] * dim), (3005, [inf] * dim), (3006, [float("nan")] + [0.0] * (dim - 1))]
    rows += [(3007, [-0.0] * dim), (3008, [1e-9] * dim), (3009, [-1e-9] * dim), (3010, [4000.0, -4000.0] * (dim // 2))]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = centroids.cluster(vectors(spark, rows), 5, 6, dim, "3", block=32)
    want, last = plain_clusters(rows, 5, 6, dim, "3")
    equal(got.vectors.collect(), want)
    assert got.centroids.tolist() == last
    assert all(blocks == got.pruning[0][0] for blocks, _, _ in got.pruning)
    # Far blocks have one candidate, and fewer than all comparisons are made.
    assert any(alone > 0 for _, alone, _ in got.pruning)
    assert min(made for _, _, made in got.pruning) < 5 * len(want)


def test_clusters_few_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None)]
    few = centroids.centroid_clusters(vectors(spark, rows), 8, 10, 2).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in few) == [(1, 0, 0), (2, 0, 0)]
    none = centroids.centroid_clusters(vectors(spark, rows).limit(0), 8, 10, 2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [1e6, 0.0])]), 2, 1, 2)


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (4000, 3)).astype(float)
    c = rng.integers(-60, 60, (7, 3)).astype(float)
    blocks = x[np.argsort(x[:, 0])].reshape(100, 40, 3)
    able = centroids.candidates(blocks.min(axis=1), blocks.max(axis=1), c)
    d = ((blocks[:, :, None] - c) ** 2).sum(axis=3)
    nearest = d == d.min(axis=2, keepdims=True)
    assert (able | ~nearest.any(axis=1)).all() and not able.all()


# --- 12 --------------------------------------------------------------------------------


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    n, n_terms = 700, 40
    at = {(int(a), int(b)) for a, b in zip(rng.integers(0, n, 5000), rng.zipf(1.4, 5000) % n_terms, strict=True)}
    pairs = np.array(sorted(at))
    weight = rng.choice([0.2, 0.5, 1.0], len(pairs))
    length = np.sqrt(np.bincount(pairs[:, 0], weight**2, n))
    weight = weight / length[pairs[:, 0]]
    index = toxicity.Index.of(pairs[:, 0], pairs[:, 1], weight, n, n_terms, 16)
    dense = np.zeros((n, n_terms))
    dense[pairs[:, 0], pairs[:, 1]] = weight
    shut = 0
    for _ in range(200):
        terms = np.unique(rng.integers(0, n_terms, rng.integers(1, 6)))
        q = rng.choice([0.3, 1.0], len(terms))
        found, cosine, opened = index.nearest(terms, q, 9)
        full = np.zeros(n)
        for t, w in zip(terms, q, strict=True):
            full += dense[:, t] * w
        best = np.lexsort((np.arange(n), -full))[:9]
        best = best[full[best] > 0]
        assert found.tolist() == best.tolist()
        assert np.allclose(cosine, full[best], atol=1e-12)
        shut += index.highest.shape[1] - opened
    assert shut > 0


def test_isotonic():
    good, n = np.array([0, 3, 1, 0, 9]), np.array([10, 5, 5, 0, 10])
    got = toxicity.isotonic(good, n)
    assert (np.diff(got) >= 0).all()
    assert math.isclose(got[1], 0.4) and math.isclose(got[2], 0.4) and math.isclose(got[4], 9.5 / 10.5)
    assert got[2] < got[3] < got[4]


def test_ratio(spark):
    n = [30, 20]
    rows = [(a, b) for a in (0, 5, 30) for b in (0, 7, 20)]
    got = spark.createDataFrame(rows, "clean long, toxic long").select("clean", "toxic", toxicity.ratio(F.col("clean"), F.col("toxic"), *n).alias("g")).collect()
    for r in got:
        cells = [[r.clean, r.toxic], [n[0] - r.clean, n[1] - r.toxic]]
        want = 2 * sum(x * math.log(x * 50 / (sum(row) * n[j])) for row in cells for j, x in enumerate(row) if x)
        assert math.isclose(r.g, want, abs_tol=1e-9)
    assert math.isclose(toxicity.ratio_bound(0.05), 3.8415, abs_tol=1e-3)


def labelled_rows(n=600):
    rnd = random.Random(2)
    plain = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Vile,", "nasty.", "ROTTEN"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, equal):
    rows, labels = labelled_rows()
    rows += [(10_000, None), (10_001, ""), (None, "vile nasty"), (10_002, "vile " * 20_000), (10_002, "w1"), (10_003, "!!! ###")]
    labels += [(None, 1, 1), (0, 0, 0), (5, 1, None), (99_999, 1, 1)]
    docs = spark.createDataFrame([(i, t, n, n, "q") for n, (i, t) in enumerate(rows)], "doc_id long, text string, toxic long, h long, terms string").repartition(5, "h")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.toxicity(docs, marks, model=model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    by = {r.doc_id: r for r in got}
    assert by[10_000].score == by[10_001].score == by[10_003].score < 0.1 and by[10_000].nearest == []
    assert by[None].predicted == 1 and not by[None].held_out
    assert sorted(r.predicted for r in got if r.doc_id == 10_002) == [0, 1]
    # Against all examples one by one.
    words = lambda t: re.findall(r"[0-9a-z'\x80-\U0010ffff]+", (t or "").lower())
    bad = {"vile", "nasty", "rotten"}
    n_docs = len(rows)
    df = Counter(w for _, t in rows for w in set(words(t)) & bad)
    idf = {w: math.log((1 + n_docs) / (1 + df[w])) + 1 for w in bad}

    def vector(t):
        tf = Counter(w for w in words(t) if w in bad)
        v = {w: (1 + math.log(n)) * idf[w] for w, n in tf.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    learned = sorted(i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert model.ids.tolist() == learned and len(model.terms) == 3
    texts = dict(rows[:600])
    table = [(i, vector(texts[i])) for i in learned]
    for r in held[:60]:
        v = vector(texts[r.doc_id])
        near = sorted(((sum(x * e.get(w, 0.0) for w, x in v.items()), i) for i, e in table), key=lambda c: (-round(c[0], 9), c[1]))
        near = [c for c in near if c[0] > 0][:3]
        equal([(round(c, 9), i) for c, i in near], [(round(x.cosine, 9), x.doc_id) for x in r.nearest])
        assert {t.lower() for t in r.terms} == set(v)


def test_toxicity_nothing_to_learn(spark):
    rows, labels = labelled_rows(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    one = toxicity.toxicity(docs, marks.where("toxic = 0")).collect()
    assert len(one) == 20 and all(0 <= r.score < 0.7 and r.predicted == 0 for r in one)


def test_toxicity_sample_is_bounded(spark):
    rows, labels = labelled_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, examples=60)
    assert 60 < model.index.n < 180
    assert 0.15 < model.base < 0.35  # a fourth is toxic, though about half of the examples are


def test_words_of_high_bytes():
    w = toxicity._words(pa.array(["Été, l'eau—x", None, "A.B"]))
    assert [w.word(i).decode() for i in range(len(w.starts))] == ["été", "l'eau—x", "a", "b"]


# --- 13 --------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """rows: doc_id, text, source; one row for each source, order and step, document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        docs.append((s or "", i, fails))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        got = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[2][f]]
                redundant = sum(d[2][f] for d in mine) - len(gone)
                left = [d for d in left if not d[2][f]]
                alone = sum(d[2][f] and sum(d[2].values()) == 1 for d in mine)
                got.append(["".join(order), step, f, len(left), len(gone), redundant, alone, sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)])
        sums = Counter()
        for r in got:
            sums[r[2]] += r[4]
        out += [(part, r[0], r[1], *r[3:], sums[r[2]]) for r in got]
    return out


def test_filter_audit(spark, messy, rows, equal):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (4444, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(messy, marks)
    mine = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == cols
    equal(got.collect(), plain_audit(mine, labels))


def test_filter_audit_empty_and_nulls(spark, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, marks).count() == 0
    rows = spark.createDataFrame([("p", None, True, None), (None, True, True, True), ("", False, None, True)], "part string, X boolean, Y boolean, seen boolean")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(rows, ["X", "Y"], ["seen"]).collect()}
    assert len(got) == 2 * 2 * 2
    r = got["", "YX", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.seen, r.shapley) == (1, 0, 1, 0, 0, 1)
    r = got["p", "XY", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.seen, r.shapley) == (0, 1, 0, 1, 0, 2)
    with pytest.raises(ValueError):
        filter_audit.interactions(rows, [], [])
