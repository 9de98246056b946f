"""What keeps op10's CPU down: only different words are hashed, and a bucket of words is one row of the exchange."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from fieldflux.llm import lm_scoring as L
from fieldflux.llm import words as W
from fieldflux.llm.words import Words


def odd_texts(seed):
    rnd = random.Random(seed)
    for alphabet in ("ab \n", "aA\0 \t", "éß中 x\x0b\x1c\x85", "abcdefghij" * 3 + " "):
        yield [None, "", *("".join(rnd.choice(alphabet) for _ in range(n)) for n in (1, 9, 300, 2000)), "x" * 64 + " " + "x" * 65 + " " + "é" * 40]
    yield ["abcdefgh abcdefgh\0 abcdefg abcdefgi " + "y" * (W.PIECE + 3)]
    yield []


def test_numbers_are_those_of_distinct(monkeypatch):
    for i in range(5):
        for texts in odd_texts(i):
            w = Words(pa.array(texts, pa.string()), lower=True)
            want = w.distinct()
            with monkeypatch.context() as m:
                m.setattr(Words, "hashes", lambda *_: pytest.fail("every word was hashed"))
                got = w.numbered()
            assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(got, want, strict=True))
            assert w.wide.tolist() == [any(c >= 128 for c in w.word(j)) for j in range(len(w.starts))]


def test_words_of_one_key_are_told_apart(monkeypatch):
    w = Words(pa.array(["a b a c b", "d a"]))
    want = w.distinct()
    real = Words._folded

    def folded(self):
        a, b, wide = real(self)
        return np.zeros_like(a), b, wide

    monkeypatch.setattr(Words, "_folded", folded)
    assert all(np.array_equal(x, y) for x, y in zip(w.numbered(), want, strict=True))


@pytest.mark.parametrize("bits", [1, 3])
def test_a_bucket_is_one_row(bits):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(400)) for _ in range(20)]
    keys = Words(pa.array(texts)).distinct()[0]
    shared = SimpleNamespace(value=(keys[:200], np.arange(200) % 3))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 5])], ["text"]) for i in range(0, 20, 5)]
    plain, bundled = [], []
    for b in batches:
        plain += [x for x in L._count_sides(shared, 3, 0, 1)(iter([b])) if not x.column("v").null_count < x.num_rows]
        bundled += list(L._bundled(L._count_sides(shared, 3, 0, 1), bits)(iter([b])))
    rows = pa.Table.from_batches(bundled)
    with_words = rows.filter(rows["words"].is_valid())
    assert 0 < with_words.num_rows <= len(batches) << bits
    assert rows["v"].drop_null().to_pylist()  # rows of neighbours that aren't held go on as they are
    rows = rows.filter(rows["v"].is_null()).sort_by("bucket").select(["bucket", "w", "code", "n", "seen", "words", "sizes"])

    def sums(batches):
        got = {}
        for b in batches:
            row, code, n = L._entries(b.column("seen"))
            names = b.column("w").to_pylist()
            for r, c, x in zip(row, code, n, strict=True):
                assert (names[r], int(c)) not in got
                got[names[r], int(c)] = int(x)
        return got

    want = pa.Table.from_batches(plain).sort_by("w").select(["w", "code", "n", "seen"])
    for size in (3, 1000):
        assert sums(L._bucket_sums(iter(rows.to_batches(max_chunksize=size)))) == sums(L._summed(iter(want.to_batches())))
