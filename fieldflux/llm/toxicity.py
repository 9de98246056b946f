"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, found through a block-max inverted index.

The classifier is fitted on a bounded sample of labelled rows, EXAMPLES of each label in expectation,
drawn by a hash of the id.  Words count as terms if toxic examples have them
LIFT times as often as others, and their log-likelihood ratio is beyond what chance would give for any
word of the examples' vocabulary.  Inverse document frequencies count all documents.

Examples are numbered by id and cut into blocks of BLOCK; the index holds each term's postings and its
largest weight in each block.  Blocks are opened by falling bound, the sum of those largest weights, and
none is left out that could hold a nearer example than the NEAREST found.  Votes weigh by one over the
distance and make up for the sample; isotonic steps turn them into probabilities, fitted on the votes
that each example gets from the others, and apart for documents without terms.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, partitions, stored, worker_cache
from .words import SPACE, U, Words, gathered

EXAMPLES, NEAREST, BLOCK, FIRST = 20_000, 25, 128, 8
#: The chance that any word at all becomes a term without a reason.
CHANCE = 0.01
#: How much larger the share of toxic texts with a term is than that of others: with many examples,
#: words that are hardly more frequent in one kind pass the test of chance too.
LIFT = 2.0
TOXIC = 0.7
#: Distance at which a vote counts half of what an equal text's does.
SOFT = 0.05
#: Votes of the base rate, in votes of equal texts, so that few neighbours don't make sure.
DOUBT = 0.1
BINS = 200
#: Nearest examples named in a result; vectors whose result a worker remembers.
EVIDENCE, HELD = 3, 20_000

#: Bytes that end a word: ASCII but for letters, digits and the apostrophe.
GAP = SPACE.copy()
GAP[:128] = [not (chr(i).isalnum() or chr(i) == "'") for i in range(128)]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id isn't held out, and not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _words(texts: pa.Array) -> Words:
    return Words(pa.compute.utf8_lower(texts), gap=GAP)


def _pairs(w: Words, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the words that are terms; term: -1 for other words."""
    hit = term >= 0
    pair, times = np.unique(w.owners()[hit] * max(1, n_terms) + term[hit], return_counts=True)
    return pair // max(1, n_terms), pair % max(1, n_terms), times


def _count_terms(batches: Iterator[pa.RecordBatch]):
    """In how many texts each word is, by label."""
    for t in chunks(batches, "text"):
        w = _words(t["text"])
        h = w.hashes()
        keys, which = np.unique(h, return_inverse=True)
        text, key, _ = _pairs(w, which, len(keys))
        toxic = t["toxic"].to_numpy().astype(np.int64)
        by = np.bincount(key * 2 + toxic[text], minlength=2 * len(keys)).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(by[:, 0]), pa.array(by[:, 1])], ["h", "clean", "toxic"])


def _look(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def _count_documents(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        terms = shared.value
        total = np.zeros(len(terms) + 1, np.int64)  # the last one: all texts
        for t in chunks(batches, "text"):
            w = _words(t["text"])
            _, term, _ = _pairs(w, _look(w.hashes(), terms), len(terms))
            total[:-1] += np.bincount(term, minlength=len(terms))
            total[-1] += w.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    return work


def _vectors(w: Words, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) of unit vectors, by text and term; term: of each word, -1 for other words."""
    text, term, times = _pairs(w, term, len(idf))
    weight = (1 + np.log(times)) * idf[term]
    length = np.sqrt(np.bincount(text, weight * weight, w.n))
    return text, term, weight / length[text]


def _example_vectors(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        terms, idf = shared.value
        for t in chunks(batches, "text"):
            w = _words(t["text"])
            text, term, weight = _vectors(w, _look(w.hashes(), terms), idf)
            cut = np.searchsorted(text, np.arange(w.n + 1)).astype(np.int32)
            rows = [t[c].combine_chunks() for c in ("doc_id", "toxic")]
            yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(cut, term), pa.ListArray.from_arrays(cut, weight)], ["doc_id", "toxic", "terms", "weights"])

    return work


@dataclass
class Index:
    """Postings of all terms one after another: example and weight, by example within a term.

    cut: [term, block] where the postings of that term in that block start, with the end of the last
    block after them; highest: [term, block] the largest weight there."""

    cut: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    highest: np.ndarray
    n: int
    block: int

    @classmethod
    def of(cls, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = BLOCK) -> Index:
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        blocks = -(-n // block)
        highest = np.zeros((n_terms, blocks))
        np.maximum.at(highest, (term, example // block), weight)
        place = np.arange(n_terms)[:, None] * blocks + np.arange(blocks + 1)
        cut = np.searchsorted(term * blocks + example // block, place).astype(np.int64)
        return cls(cut, example, weight, highest, n, block)

    def _open(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the blocks' examples that share a term.  An example's products are added
        term by term, so equal vectors have equal cosines."""
        starts = self.cut[terms[:, None], blocks]
        lengths = self.cut[terms[:, None], blocks + 1] - starts
        at = gathered(lengths.ravel(), starts.ravel())
        product = self.weight[at] * np.repeat(weights, lengths.sum(axis=1))
        score = np.bincount(self.example[at], product, self.n)
        found = np.flatnonzero(score)
        return found, score[found]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, cosines, blocks opened): the k examples of the largest cosine above 0, ties to the
        smaller number.  terms ascend.

        First a few blocks of the highest bounds, until k examples are found; then all whose bound
        reaches the k-th of these, so none that could hold a nearer one stays shut."""
        bound = weights @ self.highest[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        found, cosine, at, step = np.empty(0, np.int64), np.empty(0), 0, FIRST
        while at < len(order):
            if len(found) == k:
                # Equal bounds may hold smaller numbers, and a bound may be rounded below a cosine.
                step = int(np.count_nonzero(bound[order[at:]] >= cosine[-1] - 1e-9))
                if not step:
                    break
            some = order[at : at + step]
            at, step = at + len(some), 4 * step
            new, score = self._open(some, terms, weights)
            if len(new) > 4 * k:
                high = score >= np.partition(score, -k)[-k]
                new, score = new[high], score[high]
            found, cosine = np.concatenate([found, new]), np.concatenate([cosine, score])
            best = np.lexsort((found, -cosine))[:k]
            found, cosine = found[best], cosine[best]
        return found, cosine, at


@dataclass
class Model:
    terms: np.ndarray  # hashes in order
    idf: np.ndarray
    index: Index
    ids: np.ndarray  # of examples
    toxic: np.ndarray
    share: np.ndarray  # of all labelled rows of a label that are examples, by label
    base: float
    steps: np.ndarray = field(default_factory=lambda: (np.arange(BINS) + 0.5) / BINS)  # probability by bin of votes
    without: float = 0.0  # probability of documents without terms
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        kind = self.toxic[found]
        w = SOFT / (SOFT + np.maximum(0, 1 - cosine)) / self.share[kind]
        doubt = DOUBT / self.share.max()
        return float(((w * kind).sum() + doubt * self.base) / (w.sum() + doubt))

    def score(self, vote: float) -> float:
        return float(self.steps[min(BINS - 1, int(vote * BINS))])


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising steps nearest to the shares good / n of the bins that have rows, straight lines between them.
    Half a row without votes is clean and half a row with all votes is toxic, so that few rows don't make sure."""
    good, n = good.astype(float), n.astype(float)
    n[[0, -1]] += 0.5
    good[-1] += 0.5
    full = np.flatnonzero(n)
    held: list[list[float]] = []  # good, n, bins
    for a, b in zip(good[full].tolist(), n[full].tolist(), strict=True):
        held.append([a, b, 1])
        while len(held) > 1 and held[-2][0] * held[-1][1] >= held[-1][0] * held[-2][1]:
            top = held.pop()
            held[-1] = [x + y for x, y in zip(held[-1], top, strict=True)]
    steps = np.concatenate([np.full(int(bins), a / b) for a, b, bins in held])
    return np.interp(np.arange(len(n)), full, steps)


def _told(model: Model, w: Words, term: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray] | None]:
    """For each text its votes and nearest examples with their cosines; None without terms."""
    cache = worker_cache(("toxicity", model.key))
    text, term, weight = _vectors(w, term, model.idf)
    cut = np.searchsorted(text, np.arange(w.n + 1))
    out: list[tuple | None] = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a == b:
            out.append(None)
            continue
        # Texts with the same terms as often have the same vector.
        name = term[a:b].tobytes() + weight[a:b].tobytes()
        got = cache.get(name, 0)
        if got == 0:
            found, cosine, _ = model.index.nearest(term[a:b], weight[a:b])
            if len(cache) > HELD:
                cache.clear()
            got = cache[name] = (model.score(model.vote(found, cosine)), found[:EVIDENCE], cosine[:EVIDENCE]) if len(found) else None
        out.append(got)
    return out


def _calibrate(shared):
    """(cell, n) of the examples themselves, each judged by the others; cell: bin of votes * 2 + label, the
    last bin for those without terms."""

    def work(batches: Iterator[pa.RecordBatch]):
        model: Model = shared.value
        n = np.zeros((BINS + 1, 2), np.int64)
        for batch in batches:
            kinds, ids = batch.column("toxic").to_pylist(), batch.column("doc_id").to_pylist()
            for i, (kind, own) in enumerate(zip(kinds, ids, strict=True)):
                term, weight = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("terms", "weights"))
                found, cosine, _ = model.index.nearest(term, weight, NEAREST + 1) if len(term) else ((), (), 0)
                if len(term):
                    other = model.ids[found] != own
                    found, cosine = found[other][:NEAREST], cosine[other][:NEAREST]
                n[min(BINS - 1, int(model.vote(found, cosine) * BINS)) if len(found) else BINS, kind] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["cell", "n"])

    return work


def labelled(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[DataFrame, np.ndarray] | None:
    """(doc_id, text, toxic; shares drawn by label) of the sample; None if there is nothing to learn from.

    An id of several labels is toxic if one is.  The ids are drawn from the labels alone, `examples` of
    each label in expectation, so they may be broadcast and the texts of other rows don't move."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = np.array([min(1.0, examples / max(1, sizes.get(k, 0))) for k in (0, 1)])
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    chosen = known.where(draw < F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return stored(texts, "labelled"), share


def ratio_bound(chance: float) -> float:
    """The log-likelihood ratio of one degree of freedom that chance exceeds that rarely."""
    low, high = 0.0, 1400.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > chance else (low, mid)
    return high


def ratio(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Log-likelihood ratio of `a text has the word` and `it is toxic` being independent."""
    n, with_ = F.lit(float(n_clean + n_toxic)), clean + toxic
    cells = [(clean, with_, n_clean), (toxic, with_, n_toxic), (n_clean - clean, n - with_, n_clean), (n_toxic - toxic, n - with_, n_toxic)]
    parts = [F.when(cell > 0, cell * F.log(cell * n / (row * F.lit(float(column))))).otherwise(0.0) for cell, row, column in cells]
    return 2 * sum(parts, F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model | None:
    """A model from the labelled rows that aren't held out; None if there are none."""
    sample = labelled(docs, labels, examples)
    if sample is None:
        return None
    rows, share = sample
    sc = docs.sparkSession.sparkContext
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    own = [sizes.get(k, 0) for k in (0, 1)]
    # Of all labelled rows, what the sample stands for.
    base = own[1] / share[1] / sum(n / s for n, s in zip(own, share, strict=True))
    counts = mapped(rows.select("text", "toxic"), _count_terms, "h long, clean long, toxic long")
    counts = stored(counts.groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    bound = ratio_bound(CHANCE / max(1, counts.count()))
    often = F.col("toxic") * own[0] > LIFT * F.col("clean") * own[1]
    terms = counts.where(often & (ratio(F.col("clean"), F.col("toxic"), *own) > bound)).select("h").toArrow()
    terms = np.sort(terms["h"].to_numpy().view(U))
    n = np.zeros(len(terms) + 1, np.int64)
    seen = mapped(docs.select(F.coalesce("text", F.lit("")).alias("text")), _count_documents(sc.broadcast(terms)), "term long, n long")
    for r in seen.groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r["term"]] = r["n"]
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) + 1
    id_type = rows.schema["doc_id"].dataType.simpleString()
    vectors = stored(mapped(rows, _example_vectors(sc.broadcast((terms, idf))), f"doc_id {id_type}, toxic long, terms array<long>, weights array<double>"), "examples")
    found = vectors.orderBy("doc_id", "toxic", "terms", "weights").toArrow()
    place = np.repeat(np.arange(found.num_rows), pa.compute.list_value_length(found["terms"]).to_numpy())
    term, weight = (pa.compute.list_flatten(found[c]).to_numpy() for c in ("terms", "weights"))
    index = Index.of(place, term, weight, found.num_rows, len(terms))
    model = Model(terms, idf, index, found["doc_id"].to_numpy(), found["toxic"].to_numpy(), share, base)
    cells = mapped(vectors.repartition(partitions(docs.sparkSession)), _calibrate(sc.broadcast(model)), "cell long, n long")
    n = np.zeros((BINS + 1, 2))
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r["cell"] // 2, r["cell"] % 2] = r["n"] / share[r["cell"] % 2]
    model.steps = isotonic(n[:BINS, 1], n[:BINS].sum(axis=1))
    model.without = float((n[BINS, 1] + base / 2) / (n[BINS].sum() + 1 / 2))
    return model


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]):
        model: Model = shared.value
        for t in chunks(batches, "text"):
            w = _words(t["text"])
            term = _look(w.hashes(), model.terms)
            told = _told(model, w, term)
            score = np.array([model.without if x is None else x[0] for x in told])
            n = np.array([0 if x is None else len(x[1]) for x in told], np.int64)
            found = np.concatenate([np.empty(0, np.int64), *(x[1] for x in told if x is not None)])
            cosine = np.concatenate([np.empty(0), *(x[2] for x in told if x is not None)])
            near = pa.StructArray.from_arrays([pa.array(model.ids[found]), pa.array(cosine), pa.array(model.toxic[found].astype(np.int32))], ["doc_id", "cosine", "toxic"])
            near = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), near)
            # The first place of each term in each text.
            hit = np.flatnonzero(term >= 0)
            owner = w.owners()[hit]
            _, first = np.unique(owner * max(1, len(model.terms)) + term[hit], return_index=True)
            first = np.sort(first)
            cut = np.searchsorted(owner[first], np.arange(w.n + 1)).astype(np.int32)
            words = pa.array([w.word(x).decode("utf-8", "replace") for x in hit[first].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), pa.array(score), near, pa.ListArray.from_arrays(cut, words)],
                ["doc_id", "held_out", "score", "nearest", "terms"],
            )

    return work


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, model: Model | None = None, least: float = TOXIC) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from `least` on), nearest (the
    examples of the largest cosine, largest first), terms (its words that count, by first place).

    Fits on docs and labels unless a model is given.  A text without terms, null and empty ones too, has
    the share of toxic texts among such, and no neighbours.  With nothing to learn from the score is 0.
    Ties of cosine go to the smaller id.  A null doc_id isn't held out and not learned from; repeated
    rows are rows of their own; an id with several labels is toxic if one says so; an empty table gives no
    rows.  Texts of any length are read whole.  Other columns than doc_id and text, and doc_id and toxic of
    labels, are not read."""
    model = model or fit(docs, labels, examples)
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "array<struct<doc_id: bigint, cosine: double, toxic: int>>"
    if model is None:
        scored = base.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.array().cast(kind).alias("nearest"), F.array().cast("array<string>").alias("terms"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = mapped(base, _score(shared), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, nearest {kind}, terms array<string>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), "nearest", "terms")
