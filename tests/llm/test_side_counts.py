"""Neighbours of words by class: one row for each word of a few megabytes of text, summed in the order of words."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from fieldflux.llm import lm_scoring as L
from fieldflux.llm.words import Words


def test_a_word_is_one_row():
    text = pa.array(["a b a c", "c b a a d", None, ""])
    keys = Words(text, lower=True).distinct()[0]
    shared = SimpleNamespace(value=(keys[:3], np.array([0, 1, 1])))  # the last word's class isn't held
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    rows = [r for b in L._count_sides(shared, 2, 0, 1)(iter([batch])) for r in b.to_pylist()]
    words = [r["w"] for r in rows if r["seen"] is not None and r["w"] is not None]
    assert sorted(words) == sorted(set(words)) and len(words) == 4
    later = [r for r in rows if r["v"] is not None]
    assert {r["v"] for r in later} == {int(keys[3:].view(np.int64)[0])} and all(r["n"] > 0 for r in later)
    assert len(rows) == len(words) + len(later) + 1


def test_sums_across_batches():
    rng = np.random.default_rng(3)
    w = np.sort(rng.integers(-20, 20, 700))
    none = np.arange(700) < 30  # nulls come first
    want, batches = {}, []
    for i in range(0, 700, 9):
        part, k = slice(i, i + 9), len(w[i : i + 9])
        row, code, n = np.repeat(np.arange(k), 3), rng.integers(-1, 6, 3 * k), rng.integers(1, 9, 3 * k)
        flat = rng.random(k) < 0.3
        some = ~flat[row]
        seen = L._packed(row[some], k, code[some], n[some]).to_pylist()
        seen = pa.array([None if f else s for f, s in zip(flat, seen, strict=True)], pa.binary())
        one = [(int(code[3 * j]), int(n[3 * j])) for j in range(k)]
        columns = [pa.array(w[part], mask=none[part]), pa.array([c for c, _ in one], pa.int32(), mask=~flat), pa.array([x for _, x in one], pa.int64(), mask=~flat), seen]
        batches.append(pa.RecordBatch.from_arrays(columns, ["w", "code", "n", "seen"]))
        for j in range(k):
            key = None if none[i + j] else int(w[i + j])
            for c, x in [one[j]] if flat[j] else list(zip(code[3 * j : 3 * j + 3].tolist(), n[3 * j : 3 * j + 3].tolist(), strict=True)):
                want[key, c] = want.get((key, c), 0) + x
    for size in (1 << 14, 25):
        many = iter(batches) if size == 1 << 14 else iter([pa.Table.from_batches(batches).combine_chunks().to_batches()[0]])
        got, seen_words = {}, []
        for b in L._summed(many):
            row, code, n = L._entries(b.column("seen"))
            names = b.column("w").to_pylist()
            seen_words += names
            got |= {(names[r], int(c)): int(x) for r, c, x in zip(row, code, n, strict=True)}
        assert got == want and len(seen_words) == len(set(seen_words))
