"""Perplexity of documents under a class-based bigram model.

Counts cover all training documents: every word's count, and how often it stands beside each
class; a boundary stands before and after each text.  Exchange clustering assigns every word of
the training vocabulary to a class: a word moves to the class that raises the likelihood of the
class bigrams most.  It starts from classes of types, made on the driver: a type is one of the TYPES
most frequent words, or, for other words, one of the ENDINGS most frequent endings, or the rest.
Then all words move in BATCHES, each by its own neighbours: for each batch the texts are read again
and the neighbours of its words counted by their current classes.  A word moves if
it gains more than the log of the number of classes, which is what naming its class takes; without
that, words seen once or twice follow chance.  A batch that doesn't raise the likelihood is taken back.  Endings class only words that training hasn't seen.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Class transitions are smoothed by the classes' own shares, emissions by one for each known word
and one for an unknown word of the class.  Both scores need the count of each token.  Counts and
classes of the HELD most frequent words are broadcast; those of other words come by a join, from
each document's different rare words, so the vocabulary may grow without a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, stored
from .words import U, Words

TYPES, ENDINGS, CLASSES, ROUNDS, HELD = 1000, 300, 48, 8, 1 << 19
BATCHES = 2  # of words that move together
FEW = 16  # neighbours of a class whose gains are taken from a table
SLICE = 1 << 16  # rows of a batch of counts
CODE_BITS = 20  # of a packed count, for its code
BUCKET = 1 << 12  # words of a bucket, about
PRIOR = 20.0  # weight of the classes' own shares in a transition


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id isn't held out, but not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, number of each word's) of the different words."""
    keys, first, which = w.numbered()
    a, b = w.starts[first], w.ends[first]
    last = w.buffer[b - 1].astype(np.int64) if len(b) else np.empty(0, np.int64)
    before = np.where(b - a > 1, w.buffer[np.maximum(b - 2, 0)], 0) if len(b) else last
    return keys, last | before.astype(np.int64) << 8 | w.wide[first].astype(np.int64) << 16, which


def _count_words(batches: Iterator[pa.RecordBatch]):
    for t in chunks(batches, "text", 8 << 20):
        keys, ending, which = _distinct(Words(t["text"], lower=True))
        n = np.bincount(which, minlength=len(keys))
        for i in range(0, len(keys), SLICE):
            j = i + SLICE
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:j].view(np.int64)), pa.array(n[i:j]), pa.array(ending[i:j])], ["h", "n", "ending"])


@dataclass
class Lexicon:
    """The broadcast part: hashes in order with their counts and types, endings in order."""

    h: np.ndarray
    count: np.ndarray
    type_of: np.ndarray  # -1: by its ending
    endings: np.ndarray
    ending_type: np.ndarray
    rest: int  # type of words of other endings

    def look(self, keys: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(type, count) of different words; count -1 where it isn't held."""
        count, kind = np.full(len(keys), -1), np.full(len(keys), -1)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, keys), len(self.h) - 1)
            hit = self.h[at] == keys
            count[hit], kind[hit] = self.count[at[hit]], self.type_of[at[hit]]
        left = np.flatnonzero(kind < 0)
        kind[left] = self.rest
        if len(self.endings):
            at = np.minimum(np.searchsorted(self.endings, ending[left]), len(self.endings) - 1)
            hit = self.endings[at] == ending[left]
            kind[left[hit]] = self.ending_type[at[hit]]
        return kind, count


def _transitions(w: Words, types: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, text) of all steps, the boundary before and after each text included."""
    n = len(types) + w.n
    ends = w.first[1:] + np.arange(w.n)  # place of each text's end among words and ends
    to = np.full(n, boundary)
    inner = np.ones(n, bool)
    inner[ends] = False
    to[inner] = types
    before = np.concatenate([[boundary], to[:-1]])
    return before, to, np.repeat(np.arange(w.n), w.counts + 1)


def _count_pairs(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        lex: Lexicon = shared.value
        n = lex.rest + 2  # the last type is the boundary
        total = np.zeros(n * n, np.int64)
        for t in chunks(batches, "text"):
            w = Words(t["text"], lower=True)
            keys, ending, which = _distinct(w)
            kind, _ = lex.look(keys, ending)
            a, b, _ = _transitions(w, kind[which], n - 1)
            total += np.bincount(a * n + b, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return work


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each type, from how often each type follows each other.

    The last type is a class of its own, the last one.  Types are taken by falling frequency;
    ties go to the lowest number, so the result is the same each time."""
    n = len(pairs)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    k = max(1, min(classes, n - 1))
    of = np.empty(n, np.int64)
    of[order] = np.arange(n - 1) % k
    of[-1] = k
    one = np.zeros((n, k + 1))
    one[np.arange(n), of] = 1
    table = one.T @ pairs @ one
    g = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            own = of[w]
            out, into, self_ = pairs[w].astype(float).copy(), pairs[:, w].astype(float).copy(), float(pairs[w, w])
            out[w] = into[w] = 0
            right, left = np.bincount(of, out, k + 1), np.bincount(of, into, k + 1)
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= self_
            # What other classes give to and take from w counts for them wherever w is.
            rows, cols = table.sum(axis=1) + left, table.sum(axis=0) + right
            gain = (g(table[:k] + right) - g(table[:k])).sum(axis=1) + (g(table[:, :k] + left[:, None]) - g(table[:, :k])).sum(axis=0)
            d = np.arange(k)
            cell = table[d, d]
            gain += g(cell + right[d] + left[d] + self_) - g(cell + right[d]) - g(cell + left[d]) + g(cell)
            gain -= g(rows[:k] + out.sum() + self_) - g(rows[:k]) + g(cols[:k] + into.sum() + self_) - g(cols[:k])
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    class_of: np.ndarray  # of each type
    steps: np.ndarray  # log10 P(class | class)
    spread: np.ndarray  # log10 of each class's emission total; 0 for the boundary


def _class_model(pairs: np.ndarray, sums: np.ndarray, kinds: np.ndarray, classes: int) -> ClassModel:
    of = exchange(pairs, classes)
    k = int(of.max()) + 1
    one = np.zeros((len(of), k))
    one[np.arange(len(of)), of] = 1
    return _smoothed(one.T @ pairs @ one, of, sums, kinds)


def _smoothed(table: np.ndarray, of: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> ClassModel:
    k = len(table)
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    steps = (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR)
    spread = np.log10(np.bincount(of, sums, k) + np.bincount(of, kinds, k) + 1)
    spread[of[-1]] = 0  # the boundary's class emits the end alone
    return ClassModel(of, np.log10(steps), spread)


def _packed(row: np.ndarray, n_rows: int, code: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each row its codes and counts, as n * 2^CODE_BITS + code + 1 in eight bytes; rows ascend."""
    offsets = (8 * np.searchsorted(row, np.arange(n_rows + 1))).astype(np.int32)
    entries = (n.astype(U) << U(CODE_BITS)) | (code + 1).astype(U)
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(entries)])


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the entries of a column of `_packed`; nulls have none."""
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets) // 8)
    return row, (data & (1 << CODE_BITS) - 1) - 1, data >> CODE_BITS


def _count_sides(shared, k: int, turn: int, of: int):
    """(w, v, code, n, seen): how often words have neighbours of a class, summed over a few megabytes of text.

    Rows are for words whose turn it is, and those whose class isn't held: code c is the class of words
    after it, k + 1 + c of words before it (only in its turn), 2k + 2 the word itself; seen has all of a word's
    codes with their counts.  Words of known class that don't move now are summed up over the task: w is null and the code
    is class * (k + 1) + class.  Where the neighbour's class isn't held, v is the neighbour, its class is still to be
    added to the code, and n is the count."""
    names = ["w", "v", "code", "n", "seen"]

    def work(batches: Iterator[pa.RecordBatch]):
        held, classes = shared.value
        total = np.zeros((k + 1) * (k + 1), np.int64)
        for t in chunks(batches, "text", 8 << 20):
            w = Words(t["text"], lower=True)
            keys, _, which = w.numbered()
            m = len(keys)
            cls = np.full(m + 1, -1)
            cls[m] = k  # the boundary
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[at] == keys
                cls[:m][hit] = classes[at[hit]]
            ids = keys.view(np.int64)
            moves = np.append(ids % of == turn, False)
            place = np.arange(m + 1)
            as_word = np.where(moves | (cls < 0), place, m + cls)
            # A neighbour is a code, or 2k + 3 and more: its place, whose class comes later.
            after = np.where(cls < 0, 2 * k + 3 + place, cls)
            before_ = np.where(cls < 0, 2 * k + 3 + m + 1 + place, k + 1 + cls)
            bits = (2 * k + 3 + 2 * (m + 1)).bit_length()
            before, to, _ = _transitions(w, which, m)
            x = as_word[before]
            own = (before == to) & (x < m)
            right = x << bits | after[to]
            right[own] = x[own] << bits | 2 * k + 2
            left = np.flatnonzero(moves[to] & ~own)
            pair = np.sort(np.concatenate([right, to[left] << bits | before_[before[left]]]))
            start = np.flatnonzero(np.diff(pair, prepend=-1))
            pair, n = pair[start], np.diff(start, append=len(pair))
            x, y = pair >> bits, pair & (1 << bits) - 1
            known = y < 2 * k + 3
            sums = known & (x >= m)
            total += np.bincount((x[sums] - m) * (k + 1) + y[sums], n[sums], len(total)).astype(np.int64)
            some = known & (x < m)
            of_word = x[some]
            new = np.diff(of_word, prepend=-1) != 0
            of_word, which_row = of_word[new], np.cumsum(new) - 1
            cut = np.searchsorted(which_row, np.arange(0, len(of_word) + SLICE, SLICE))
            for i, (a, b) in zip(range(0, len(of_word), SLICE), zip(cut[:-1], cut[1:], strict=True), strict=False):
                word = ids[of_word[i : i + SLICE]]
                none = pa.nulls(len(word), pa.int64())
                seen = _packed(which_row[a:b] - i, len(word), y[some][a:b], n[some][a:b])
                yield pa.RecordBatch.from_arrays([pa.array(word), none, none.cast(pa.int32()), none, seen], names)
            x, y, n = x[~known], y[~known] - (2 * k + 3), n[~known]
            known_word = np.append(ids, 0)
            for i in range(0, len(x), SLICE):
                a, b = x[i : i + SLICE], y[i : i + SLICE]
                code = np.where(a < m, np.where(b > m, k + 1, 0), (a - m) * (k + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(known_word[np.minimum(a, m)], mask=a >= m), pa.array(ids[np.where(b > m, b - m - 1, b)]), pa.array(code),
                        pa.array(n[i : i + SLICE].astype(np.int64)), pa.nulls(len(a), pa.binary()),
                    ],
                    names,
                )
        at = np.flatnonzero(total)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), none, _packed(np.zeros(len(at), np.int64), 1, at, total[at])], names)

    return work


def _column(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The stretches of values between the cuts as binary values."""
    offsets = (values.itemsize * cut).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bundled(work, bits: int):
    """The rows of `_count_sides`, those with words and `seen` as one row for each bucket of words that has any: words, the
    sizes of their `seen`, and all these after each other.  The bucket is the first bits of the hash, by which such rows come
    in order.  An exchange then handles a bucket of a few megabytes of text, not each word of them, as a row."""

    def bundle(batches: Iterator[pa.RecordBatch]):
        names = ["bucket", "w", "v", "code", "n", "seen", "words", "sizes"]
        for b in work(batches):
            rows = b.num_rows
            none = pa.nulls(rows, pa.binary())
            if not rows or b.column("seen").null_count or b.column("w").null_count:
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), *b.columns, none, none], names)
                continue
            w = b.column("w").to_numpy()
            bucket = w.view(U) >> U(64 - bits)
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            cut = np.append(first, rows)
            seen = b.column("seen")
            offsets = np.frombuffer(seen.buffers()[1], np.int32, rows + 1, seen.offset * 4)
            data = np.frombuffer(seen.buffers()[2], np.uint8)
            null = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first].astype(np.int64)), null, null, null.cast(pa.int32()), null, _column(data, offsets[cut]),
                    _column(w, cut), _column(np.diff(offsets), cut),
                ],
                names,
            )

    return bundle


def _opened(batches: Iterator[pa.RecordBatch]):
    """(w, code, n, seen) in the order of w, from rows (bucket, w, code, n, seen, words, sizes) in the order of buckets."""

    def whole():
        held, last = [], None
        for batch in batches:
            bucket = batch.column("bucket").fill_null(-1).to_numpy()
            if not len(bucket):
                continue
            # The last bucket may go on in the next batch.
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if held and (cut or bucket[-1] != last):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held, last = [*held, batch.slice(cut)], bucket[-1]
        if held:
            yield pa.Table.from_batches(held)

    def values(column: pa.ChunkedArray, kind) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind)

    for t in whole():
        many = t["words"].is_valid()
        one, t = t.filter(pa.compute.invert(many)), t.filter(many)
        w, data = values(t["words"], np.int64), values(t["seen"], np.uint8)
        seen = _column(data, np.append(0, np.cumsum(values(t["sizes"], np.int32), dtype=np.int64)))
        n = len(w)
        columns = [
            pa.chunked_array([pa.array(w), *one["w"].chunks]), pa.chunked_array([pa.nulls(n, pa.int32()), *one["code"].chunks]),
            pa.chunked_array([pa.nulls(n, pa.int64()), *one["n"].chunks]), pa.chunked_array([seen, *one["seen"].chunks]),
        ]
        rows = pa.Table.from_arrays(columns, ["w", "code", "n", "seen"]).combine_chunks()
        order = pa.compute.sort_indices(rows, [("w", "ascending")])
        yield from rows.take(order).to_batches()


def _bucket_sums(batches: Iterator[pa.RecordBatch]):
    return _summed(_opened(batches))


def _summed(batches: Iterator[pa.RecordBatch]):
    """(w, seen): one row for each word of a task's rows (w, code, n, seen), which come in the order of w; no more than a
    few thousand rows and one word are held at a time."""

    def groups():
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= 1 << 14:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
        if count:
            yield pa.Table.from_batches(held).combine_chunks()

    last, codes, counts = None, np.empty(0, np.int64), np.empty(0, np.int64)
    for t in groups():
        w, seen = t["w"].combine_chunks(), t["seen"].combine_chunks()
        row, code, n = _entries(seen)
        flat = np.flatnonzero(seen.is_null().to_numpy(zero_copy_only=False))
        code = np.concatenate([codes, code, t["code"].fill_null(0).to_numpy()[flat]])
        n = np.concatenate([counts, n, t["n"].fill_null(0).to_numpy()[flat]])
        is_word, value = w.is_valid().to_numpy(zero_copy_only=False), w.fill_null(0).to_numpy()
        if last is not None:
            is_word, value = np.append(last[0], is_word), np.append(last[1], value)
        new = np.append(True, (np.diff(value) != 0) | (is_word[1:] != is_word[:-1]))
        of = np.cumsum(new) - 1
        skip = int(last is not None)
        key = np.concatenate([np.zeros(len(codes), np.int64), of[row + skip], of[flat + skip]]) << CODE_BITS | code + 1
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(n, start) if len(start) else n[:0]
        of, code = key[start] >> CODE_BITS, (key[start] & (1 << CODE_BITS) - 1) - 1
        done = int(new.sum()) - 1
        first = np.flatnonzero(new)
        end = int(np.searchsorted(of, done))
        if done:
            at = first[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(value[at], mask=~is_word[at]), _packed(of[:end], done, code[:end], n[:end])], ["w", "seen"])
        last, codes, counts = (is_word[first[-1]], value[first[-1]]), code[end:], n[end:]
    if last is not None:
        seen = _packed(np.zeros(len(codes), np.int64), 1, codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64(), mask=np.array([not last[0]])), seen], ["w", "seen"])


def _first_classes(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        lex, of = shared.value
        for t in batches:
            kind, count = lex.look(t.column("h").to_numpy().view(U), t.column("ending").to_numpy())
            yield pa.RecordBatch.from_arrays([t.column("h"), pa.array(of[kind].astype(np.int32)), pa.array(count >= 0)], ["h", "cls", "held"])

    return work


def _in_turn(turn: int, of: int) -> Column:
    return F.pmod("h", F.lit(of)) == turn


def _by_class(train: DataFrame, classes: DataFrame, k: int, all_held: bool, turn: int, of: int, bits: int) -> DataFrame:
    """(w, seen): for each word whose turn it is or whose class isn't held its own class (code -1) and its
    neighbours by class, see `_count_sides`; for null the sums of all other words.

    2k + 4 codes at most, or (k + 1)^2 for null, so a row has a bounded size.  Classes of the most frequent
    words are broadcast; only neighbours beyond them are joined."""
    held = classes.where("held").select("h", "cls").toArrow()
    h, cls = held["h"].to_numpy().view(U), held["cls"].to_numpy()
    order = np.argsort(h)
    shared = train.sparkSession.sparkContext.broadcast((h[order], cls[order]))
    schema = "bucket long, w long, v long, code int, n long, seen binary, words binary, sizes binary"
    sides = mapped(train, _bundled(_count_sides(shared, k, turn, of), bits), schema)
    named, columns = _in_turn(turn, of), ["bucket", "w", "code", "n", "seen", "words", "sizes"]

    def flat(df: DataFrame, w: str, code: Column, n: Column) -> DataFrame:
        none = [F.lit(None).cast("binary").alias(c) for c in columns[4:]]
        return df.select(F.shiftrightunsigned(w, 64 - bits).alias("bucket"), F.col(w).alias("w"), code.alias("code"), n.alias("n"), *none)

    if not all_held:
        # Stored, as both parts are read; rows without v must not meet in a join.
        sides = stored(sides, "sides")
        # Each word is there once, so a partition's words make a small table and nothing is sorted.
        others = classes.where("not held").select(F.col("h").alias("v"), "cls").hint("shuffle_hash")
        found = sides.where("v is not null").join(others, "v").groupBy("w", (F.col("code") + F.col("cls")).alias("code")).agg(F.sum("n").alias("n"))
        sides = sides.where("v is null").select(columns).unionByName(flat(found, "w", F.col("code"), F.col("n")))
        named = named | ~F.col("held")
    own = (F.col("cls") * 2 + F.col("held").cast("int")).cast("long")
    rows = sides.select(columns).unionByName(flat(classes.where(named), "h", F.lit(-1), own))
    return mapped(rows.repartition("bucket").sortWithinPartitions("bucket"), _bucket_sums, "w long, seen binary")


def _unpacked(batch: pa.RecordBatch, k: int):
    """(w, own class, held, right, left, self): words and their neighbours by class, dense."""
    row, code, n = _entries(batch.column("seen"))
    dense = np.zeros((batch.num_rows, 2 * k + 4))
    dense[row, code + 1] = n
    own = dense[:, 0].astype(np.int64)
    return batch.column("w").to_numpy(), own >> 1, (own & 1) > 0, dense[:, 1 : k + 2], dense[:, k + 2 : 2 * k + 3], dense[:, 2 * k + 3]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _class_pairs(k: int):
    def work(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((k + 1, k + 1))
        for batch in _small(batches):
            rest = batch.filter(batch.column("w").is_null())
            _, code, n = _entries(rest.column("seen"))
            np.add.at(total.ravel(), code, n)
            _, own, _, right, _, self_ = _unpacked(batch.filter(batch.column("w").is_valid()), k)
            np.add.at(total, own, right)
            np.add.at(total, (own, own), self_)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["pair", "n"])

    return work


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what no move changes."""
    return float(_g(table).sum() - _g(table.sum(axis=0)).sum() - _g(table.sum(axis=1)).sum())


def small_gains(table: np.ndarray) -> list[np.ndarray]:
    """For rows and for columns of the table: what counts up to FEW add to each cell's part of the likelihood."""
    k = len(table) - 1
    return [_g(of.T[None, :, :k] + np.arange(FEW + 1.0)[:, None, None]) - _g(of.T[:, :k]) for of in (table, table.T)]


def best_classes(
    table: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, self_: np.ndarray, least: float = 1e-9, gains: list[np.ndarray] | None = None
) -> np.ndarray:
    """The class that each word would move to, the others being where the table has them; the
    gains are those of `exchange`.  A word moves if it gains more than `least`.  gains: `small_gains` of the table."""
    k, n = len(table) - 1, len(own)
    all_ = np.arange(n)
    gain = np.zeros((n, k))
    for of, mine, other, steps in zip((table, table.T), (right, left), (left, right), gains or small_gains(table), strict=True):
        # Only classes that a word has neighbours of change a cell.
        w, c = np.nonzero(mine)
        for i in range(0, len(w), 1 << 15):
            word, cls = w[i : i + (1 << 15)], c[i : i + (1 << 15)]
            x = mine[word, cls]
            mine_too = cls == own[word]
            more = np.empty((len(word), k))
            # Small counts beside other classes than the word's own: gains from a table, but for the own class,
            # whose cell is without the word's own part.
            few = np.flatnonzero((x <= FEW) & ~mine_too)
            more[few] = steps[x[few].astype(np.int64), cls[few]]
            at = own[word[few]]
            cell = of[at, cls[few]] - x[few]
            more[few, at] = _g(cell + x[few]) - _g(cell)
            rest = np.flatnonzero((x > FEW) | mine_too)
            cells = of.T[cls[rest]].copy()  # [of d to cls] for all d, without the word's own part
            cells[np.arange(len(rest)), own[word[rest]]] -= x[rest]
            same = np.flatnonzero(mine_too[rest])
            cells[same] -= other[word[rest[same]]]
            cells[same, own[word[rest[same]]]] -= self_[word[rest[same]]]
            cells = cells[:, :k]
            more[rest] = _g(cells + x[rest, None]) - _g(cells)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[starts]] += np.add.reduceat(more, starts)
    # A class's own cell changes only where the word has it beside itself, before or after.
    w, c = np.nonzero((right[:, :k] != 0) | (left[:, :k] != 0) | (self_ != 0)[:, None])
    r, l, at = right[w, c], left[w, c], self_[w]  # noqa: E741
    cell = np.diag(table)[c]
    cell = np.where(c == own[w], cell - (r + l + at), cell)
    gain[w, c] += _g(cell + r + l + at) - _g(cell + r) - _g(cell + l) + _g(cell)
    for sums, mine in ((table.sum(axis=1), right), (table.sum(axis=0), left)):
        # Few different totals: most words are rare.
        total = mine.sum(axis=1) + self_
        some, which = np.unique(total, return_inverse=True)
        less = (_g(sums[:k] + some[:, None]) - _g(sums[:k]))[which]
        less[all_, own] = _g(sums[own]) - _g(sums[own] - total)
        gain -= less
    best = gain.argmax(axis=1)
    return np.where(gain[all_, best] > gain[all_, own] + least, best, own)


def _move(shared, k: int, batch_no: int, of: int):
    def work(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        gains = small_gains(table)
        for batch in _small(batches):
            w, own, held, right, left, self_ = _unpacked(batch.filter(batch.column("w").is_valid()), k)
            turn = np.flatnonzero(w % of == batch_no)
            own[turn] = best_classes(table, own[turn], right[turn], left[turn], self_[turn], np.log(k) + 1e-9, gains)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(own.astype(np.int32)), pa.array(held)], ["h", "cls", "held"])

    return work


def cluster(train: DataFrame, classes: DataFrame, k: int, all_held: bool, batches: int = BATCHES) -> tuple[DataFrame, np.ndarray]:
    """(classes, table of class pairs) after the words of each batch have moved.

    train: text; classes: h, cls, held of every word of it.  Each batch reads the texts again, which costs
    less than keeping and joining the counts of all pairs of words."""
    sc = train.sparkSession.sparkContext
    kept, best = None, None
    bits = max(1, (classes.count() // BUCKET).bit_length())
    for i in range(batches + 1):
        turn = i if i < batches else -1
        seen = stored(_by_class(train, classes, k, all_held, turn, batches, bits), "by-class")
        cells = mapped(seen, _class_pairs(k), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((k + 1) * (k + 1))
        table[cells["pair"].to_numpy()] = cells["n"].to_numpy()
        table = table.reshape(k + 1, k + 1)
        if best is not None and likelihood(table) <= likelihood(best):
            # Together the moves took back what each alone would give; the next batch starts before them.
            classes, table = kept, best
            if i < batches:
                seen = stored(_by_class(train, classes, k, all_held, turn, batches, bits), "by-class")
        kept, best = classes, table
        if i < batches:
            moved = mapped(seen, _move(sc.broadcast(table), k, i, batches), "h long, cls int, held boolean")
            still = ~_in_turn(i, batches)
            if not all_held:
                still = still & F.col("held")
            classes = stored(moved.unionByName(classes.where(still)), "classes")
    return kept, best


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entries) of a column of lists, nulls as empty ones."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten().to_numpy(zero_copy_only=False)


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        lex, model = shared.value
        for t in chunks(batches, "text"):
            w = Words(t["text"], lower=True)
            keys, ending, which = _distinct(w)
            m = len(keys)
            kind, count = lex.look(keys, ending)
            a, b, text = _transitions(w, which, m)
            cls, open_ = np.append(kind, model.class_of[-1]), np.append(count < 0, False)
            later = open_[a] | open_[b]  # a class comes by the join
            step = np.where(later, 0.0, model.steps[cls[a], cls[b]] - model.spread[cls[b]])
            owner = w.owners()
            held = count[which] >= 0
            logs = np.log10(np.maximum(count, 0) + 1.0)[which]
            pairs, times = np.unique(owner[~held] * max(1, m) + which[~held], return_counts=True)
            row, word = pairs // max(1, m), pairs % max(1, m)
            cut = np.searchsorted(row, np.arange(w.n + 1)).astype(np.int32)
            owner_later = text[later]

            def side(x):
                """The place among the row's rare words, or -1 - class."""
                place = np.searchsorted(pairs, owner_later * max(1, m) + x) - cut[owner_later]
                return _column(np.where(open_[x], place, -1 - cls[x]).astype(np.int32), steps_cut)

            steps_cut = np.searchsorted(owner_later, np.arange(w.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), pa.array(w.counts.astype(np.int64)),
                    pa.array(np.bincount(owner, held & (count[which] > 0), w.n).astype(np.int64)), pa.array(np.bincount(owner, logs * held, w.n).astype(float)),
                    pa.array(np.bincount(text, step, w.n).astype(float)),
                    pa.ListArray.from_arrays(cut, keys[word].view(np.int64)), pa.ListArray.from_arrays(cut, times.astype(np.int32)),
                    _column(kind[word].astype(np.int32), cut), side(a[later]), side(b[later]),
                ],
                ["doc_id", "held_out", "words", "known", "logs", "step", "rare", "times", "guess", "before", "after"],
            )

    return work


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entries) of a column of `_column` of 32-bit numbers."""
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 4), data


def _later_steps(shared):
    """Adds the steps from or to rare words, whose classes are known by now: `found` has place * 2^16 + class."""

    def work(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for t in batches:
            row, cls = _numbers(t.column("guess"))
            first, cls = np.searchsorted(row, np.arange(t.num_rows)), cls.copy()
            at, found = _lists(t.column("found"))
            cls[first[at] + (found >> 16)] = found & 0xFFFF
            row, a = _numbers(t.column("before"))
            _, b = _numbers(t.column("after"))
            cls = np.append(cls, 0)
            a, b = (np.where(x < 0, -1 - x, cls[first[row] + np.maximum(x, 0)]) for x in (a, b))
            more = np.bincount(row, model.steps[a, b] - model.spread[b], t.num_rows)
            step = pa.array(t.column("step").to_numpy() + more)
            names = ["doc_id", "held_out", "words", "known", "logs", "more_logs", "more_known"]
            yield pa.RecordBatch.from_arrays([*[t.column(c) for c in names], step], [*names, "step"])

    return work


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(h, c) of the most frequent words, `most` at most: those above a count that a histogram of
    a few thousand bins gives, so nothing is sorted and no task sees more than its own words."""
    # Equal counts share a bin, so a bin is taken whole or not at all.
    bin_ = F.floor(F.log2("c") * 64)
    sizes = {r["b"]: r["n"] for r in counts.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return counts.where(bin_ >= least if least is not None else F.lit(False)).select("h", "c")


def class_scores(docs: DataFrame, types: int = TYPES, endings: int = ENDINGS, classes: int = CLASSES, held: int = HELD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text and its end).

    Null and empty texts are the end alone.  Rows with a null doc_id are scored, not learned
    from; repeated rows are rows (and counted) of their own.  With nothing to learn from every
    token is unknown.  Ties among frequent words go by hash.  An empty table gives no rows; other
    columns are not read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = base.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text")
    counts = mapped(train, _count_words, "h long, n long, ending long").groupBy("h").agg(F.sum("n").alias("c"), F.first("ending").alias("ending"))
    counts = stored(counts, "counts")
    total, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = train.count()
    top = _most_frequent(counts, held).toArrow()
    h, c = top["h"].to_numpy().view(U), top["c"].to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    first = spark.createDataFrame(pa.table({"h": h[:types].view(np.int64)})) if len(h) else counts.select("h").limit(0)
    tails = counts.join(F.broadcast(first), "h", "left_anti").groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    # Endings are two bytes and a flag, so their number is bounded; the most frequent are types.
    named = tails.orderBy(F.desc("c"), "ending").limit(endings).collect()
    rest = tails.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    k = min(types, len(h))
    n_types = k + len(named) + 2
    order = np.argsort(h)
    kinds = np.full(len(h), -1)
    kinds[:k] = np.arange(k)
    by_ending = sorted((r["ending"], k + i) for i, r in enumerate(named))
    lex = Lexicon(
        h[order], c[order], kinds[order], np.array([e for e, _ in by_ending], np.int64), np.array([i for _, i in by_ending], np.int64), n_types - 2
    )
    shared = sc.broadcast(lex)
    cells = mapped(train, _count_pairs(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(n_types * n_types, np.int64)  # at most (types + endings + 2)^2 cells
    pairs[cells["pair"].to_numpy()] = cells["n"].to_numpy()
    of = exchange(pairs.reshape(n_types, n_types), classes)
    k = int(of[-1])
    placed = stored(mapped(counts.select("h", "ending"), _first_classes(sc.broadcast((lex, of))), "h long, cls int, held boolean"), "classes")
    placed, table = cluster(train, placed, k, len(h) == words)
    placed = stored(counts.join(placed, "h"), "lexicon")
    sums, kinds_of = np.zeros(k + 1), np.zeros(k + 1)
    for r in placed.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        sums[r["cls"]], kinds_of[r["cls"]] = r["c"], r["v"]
    model = _smoothed(table, np.arange(k + 1), sums, kinds_of)
    # An unseen word is of the class that most words of its ending are in, or else most words.
    tails = placed.groupBy("ending", "cls").agg(F.count(F.lit(1)).alias("v")).groupBy("ending")
    tails = sorted(map(tuple, tails.agg(F.max_by("cls", F.struct("v", -F.col("cls"))).alias("cls")).collect()))
    top = placed.where("held").select("h", "c", "cls").toArrow()
    h, c, kinds = top["h"].to_numpy().view(U), top["c"].to_numpy(), top["cls"].to_numpy()
    order = np.argsort(h)
    lex = Lexicon(h[order], c[order], kinds[order], np.array([e for e, _ in tails], np.int64), np.array([i for _, i in tails], np.int64), int(kinds_of[:k].argmax()))
    both = sc.broadcast((lex, model))
    id_type = base.schema["doc_id"].dataType.simpleString()
    scored = mapped(
        base, _score(both), f"doc_id {id_type}, held_out boolean, words long, known long, logs double, step double, rare array<long>, times array<int>, "
        "guess binary, before binary, after binary"
    )
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("place", "x"))
    rare = rare.select("row", "place", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    rare = rare.join(placed.select("h", "c", "cls").hint("shuffle_hash"), "h").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum("n").alias("more_known"),
        F.collect_list(F.col("place").cast("long") * 65536 + F.col("cls")).alias("found"),
    )
    n, v = total + n_docs, words + (1 if n_docs else 0)
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    n_tokens = F.col("words") + 1
    scored = mapped(
        scored.drop("rare", "times").join(rare, "row", "left"), _later_steps(sc.broadcast(model)),
        f"doc_id {id_type}, held_out boolean, words long, known long, logs double, more_logs double, more_known long, step double",
    )
    return scored.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if n_docs else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs + F.lit(float(np.log10(n_docs + 1.0))) - n_tokens * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        (logs + F.col("step")).alias("score"),
    )
