"""Language identification, word first: per-language frequencies of known words, and for unseen
words character n-grams that get shorter until one is known.

The classifier is fitted on a sample of labelled rows, `sample_docs` for each language in
expectation, drawn by a hash of doc_id and counted in Spark over their whole texts.  Every word and every
n-gram of that sample is in the model, which that bounds, and the model is broadcast as sorted arrays of
64-bit hashes.  A prediction sees the text only, all of it: the different words of a few megabytes of text
are spelled, looked up and summed together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, mapped, stored
from .words import RUNS, U, Words, gathered, mix

SAMPLE_DOCS, LONGEST = 3000, 4
#: A text's score weighs its mean evidence as that of so many words at most, so that it stays
#: between sure and unsure for long texts too.
WEIGHT = 30
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Characters whose words or n-grams are looked up at once, and strings hashed at once.
SPAN, STRINGS = 1 << 19, 1 << 16


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id isn't held out, and not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    bound = f"\x02{word}\x03"
    return [bound[i : i + n] for i in range(len(bound) - n + 1)] if n > 1 else list(word)


def _count_words(batches: Iterator[pa.RecordBatch]):
    for t in chunks(batches, "text"):
        w = Words(t["text"])
        _, first, which = w.distinct()
        lang = t["lang"].to_pylist()
        names = sorted(set(lang))
        code = np.array([names.index(x) for x in lang])[w.owners()] if w.n else np.empty(0, np.int64)
        pairs, times = np.unique(which * len(names) + code, return_counts=True)
        seen: Counter = Counter()
        spelled = [LETTERS.findall(w.word(i).decode("utf-8").lower()) for i in first]
        for p, n in zip(pairs.tolist(), times.tolist(), strict=True):
            for part in spelled[p // len(names)]:
                seen[names[p % len(names)], part] += n
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            ["lang", "word", "n"],
        )


def _count_grams(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            # Words count once and a little more with their number: rare words look like these.
            weight = n.bit_length()
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    seen[lang, g] += weight
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            ["lang", "gram", "n"],
        )


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RUNS.runs(RUNS.sums(mix(points.astype(U) + U(1))), starts, ends)


def _ending_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each place; places before the n-th mean nothing."""
    sums = RUNS.sums(mix(points.astype(U) + U(1)))
    ends = np.arange(1, len(points) + 1)
    return RUNS.runs(sums, np.maximum(ends - n, 0), ends)


def keys_of(parts: list[str]) -> np.ndarray:
    """The 64-bit hash of each string; strings that differ in length or characters have others."""
    out = [np.empty(0, U)]
    for i in range(0, len(parts), STRINGS):
        some = parts[i : i + STRINGS]
        ends = np.cumsum([len(p) for p in some], dtype=np.int64)
        out.append(_run_hashes(_points("".join(some)), np.append(0, ends[:-1]), ends))
    return np.concatenate(out)


@dataclass
class Table:
    """Rows of log shares by sorted hashes of their words or n-grams."""

    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, named: dict[str, int], rows: np.ndarray) -> Table:
        keys = keys_of(list(named))
        order = np.argsort(keys)
        return cls(keys[order], rows[np.array(list(named.values()), np.int64)[order]])

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The row's number of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Model:
    """Log shares of languages for words and n-grams, each row summing to one as shares.

    words and grams: their row by spelling, or a Table."""

    def __init__(self, langs: list[str], prior: np.ndarray, words, word_rows, grams, gram_rows):
        self.langs, self.prior = langs, prior
        self.words = Table(words, word_rows) if isinstance(words, np.ndarray) else Table.of(words, word_rows)
        self.grams = Table(grams, gram_rows) if isinstance(grams, np.ndarray) else Table.of(grams, gram_rows)

    def word(self, part: str) -> np.ndarray:
        points = _points(part)
        return self.parts(points, np.array([0]), np.array([len(points)]))[0]

    def parts(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[part, language]: the known word's row, or else the mean of the longest known n-grams that
        end at each of its characters and at its end."""
        out = np.zeros((len(starts), len(self.langs)))
        at = self.words.look(_run_hashes(points, starts, ends))
        out[at >= 0] = self.words.rows[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self._backed_off(points, starts[rest], ends[rest])
        return out

    def _backed_off(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # Each word between a mark of its start and a mark of its end.
        size = ends - starts + 2
        last = np.cumsum(size)
        first = last - size
        bound = np.empty(int(last[-1]), np.uint32)
        bound[first], bound[last - 1] = 2, 3
        inner = np.ones(len(bound), bool)
        inner[first] = inner[last - 1] = False
        bound[inner] = points[gathered(ends - starts, starts)]
        place = np.arange(len(bound)) - np.repeat(first, size)  # within its word
        gram = np.full(len(bound), -1)
        left = np.flatnonzero(place > 0)
        for n in range(LONGEST, 0, -1):
            able = left[place[left] >= n - 1]
            found = self.grams.look(_ending_hashes(bound, n)[able])
            gram[able] = found
            left = left[gram[left] < 0]
        hit = np.flatnonzero(gram >= 0)
        word = np.searchsorted(last, hit, "right")
        n = np.maximum(1, np.bincount(word, minlength=len(size)))
        rows = self.grams.rows[gram[hit]]
        return np.stack([np.bincount(word, rows[:, j], len(size)) / n for j in range(rows.shape[1])], 1)


def _table(rows: pa.Table, name: str, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rows of log shares) of all words or n-grams that were counted."""
    keys, which = np.unique(keys_of(rows[name].to_pylist()), return_inverse=True)
    n = np.zeros((len(keys), len(langs)))
    lang = rows["lang"].combine_chunks().dictionary_encode()
    code = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()] if len(rows) else np.empty(0, np.int64)
    np.add.at(n, (which, code), rows["n"].to_numpy())
    rate = (n + SMOOTH) / (n.sum(axis=0) + SMOOTH * max(1, len(keys)))
    return keys, np.log(rate / rate.sum(axis=1, keepdims=True)).astype(np.float32)


SMOOTH = 0.5


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from the labelled rows that aren't held out; None if there are none."""
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, sample_docs / sizes[k]) * (1 << 30)))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")])
    counts = mapped(sample.select("text", "lang"), _count_words, "lang string, word string, n long")
    counts = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    found = mapped(counts, _count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    number = np.array([sizes[k] for k in langs], float)
    return Model(langs, np.log(number / number.sum()), *_table(counts.toArrow(), "word", langs), *_table(found.toArrow(), "gram", langs))


def _word_scores(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each different word (scores by language, number of parts with letters), and the number of each word's."""
    _, first, which = w.distinct()
    spelled = _points(b"\n".join([w.word(i) for i in first.tolist()]).decode("utf-8").lower())
    # Whether each of the characters that occur is a letter.
    seen = np.zeros(0x110000, bool)
    seen[spelled] = True
    letter = np.zeros(0x110000, bool)
    for c in np.flatnonzero(seen).tolist():
        letter[c] = LETTERS.fullmatch(chr(c)) is not None
    edge = np.flatnonzero(np.diff(letter[spelled].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(np.flatnonzero(spelled == 10), starts)
    rows = np.empty((len(starts), len(model.langs)))
    cut = np.searchsorted(ends, np.arange(SPAN, len(spelled) + SPAN, SPAN))
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(starts)], strict=True):
        if i < j:
            a, b = int(starts[i]), int(ends[j - 1])
            rows[i:j] = model.parts(spelled[a:b], starts[i:j] - a, ends[i:j] - a)
    n = len(first)
    sums = [np.bincount(owner, rows[:, j], n) for j in range(rows.shape[1])]
    return np.stack([*sums, np.bincount(owner, minlength=n)], 1), which


def _predict(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for t in chunks(batches, "text"):
            w = Words(t["text"])
            rows, which = _word_scores(model, w)
            owner = w.owners()
            sums = np.stack([np.bincount(owner, weights=rows[which, j], minlength=w.n) for j in range(rows.shape[1])], 1)
            parts = sums[:, -1]
            total = sums[:, :-1] * np.minimum(1, WEIGHT / np.maximum(parts, 1))[:, None] + model.prior
            best = total.argmax(axis=1)
            total -= total.max(axis=1, keepdims=True)
            score = 1 / np.exp(total).sum(axis=1)
            lang = [model.langs[b] if p else UNKNOWN for b, p in zip(best.tolist(), parts.tolist(), strict=True)]
            kept = [c for c in t.column_names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(t[c].combine_chunks() for c in kept), pa.array(lang, pa.string()), pa.array(np.where(parts > 0, score, 0.0))],
                [*kept, "lang_pred", "score"],
            )

    return work


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, model: Model | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Fits on docs unless a model is given.  `und` with score 0 where the text is null, empty or
    without a letter, and everywhere if there is nothing to learn from.  Equal scores take the
    first language by name.  A null doc_id isn't held out and not learned from; repeated rows
    are rows of their own; an empty table gives no rows; other columns than doc_id, text and lang
    are not read, and lang only to fit."""
    model = model or fit(docs, sample_docs)
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(base, _predict(shared), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language can't be told: `und`, or a score below `least`.
    Its columns stay as they were; they may have any names."""
    model = fit(docs)
    if model is None:
        return docs.limit(0)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = docs.schema.fields
    predict = _predict(shared)

    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            text = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("text")), pa.array(np.arange(b.num_rows))], ["text", "at"])
            keep = np.zeros(b.num_rows, bool)
            for got in predict(iter([text])):
                good = (np.array(got.column("lang_pred").to_pylist()) != UNKNOWN) & (got.column("score").to_numpy() >= least)
                keep[got.column("at").to_numpy()[good]] = True
            yield b.filter(pa.array(keep))

    return mapped(docs, work, T.StructType(fields))
