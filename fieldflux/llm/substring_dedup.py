"""Removal of word spans that repeat across documents, by a compacted de Bruijn graph.

A document is a path through the graph whose edges are its windows of W consecutive words.
Writing every edge would cost a row per word, so paths are compacted from the start: a k-mer
(k < W) is an anchor where its hash is the least of some window; every window has one such
anchor, its first least k-mer, and equal windows have equal ones.  An anchor's row stands for
the path of all windows through it and carries a hash of the words that this path covers.

* An anchor seen in one document only: none of its windows repeats.
* Anchors are aggregated over all documents; the aggregate keeps the source coordinate (smallest
  document, place) with the surroundings found there.  An occurrence whose surroundings agree
  with the source is verified: all its windows repeat the source's, and one joined row decides
  the whole nonbranching path.  Two 64-bit hashes, of the k-mer and of the surroundings, agree.
* Where surroundings differ or a text's end is close, the path branches.  Only the windows of
  these anchors are written one by one and decided by their own 128-bit hash.

All of it is grouping and plain equality joins.  Counts are combined before the shuffle, so a
passage that very many documents share costs no more than others, and adaptive execution splits
the join that gives its row back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget, mapped, stored
from .words import RUNS, RUNS2, U, Words, sliding

WINDOW, KMER = 50, 8
LAST = (1 << 63) - 1  # the place of a null doc_id: after all others


class Graph:
    """Anchors of the texts of a chunk."""

    def __init__(self, texts, window: int, k: int):
        w = self.words = Words(texts)
        self.window, self.k = window, k
        h = w.hashes()
        self.sums, self.sums2 = RUNS.sums(h), RUNS2.sums(h)
        n = len(h)
        self.owner = w.owners()
        self.begin, self.end = w.first[:-1][self.owner], w.first[1:][self.owner]
        kmers = RUNS.fixed(self.sums, k)
        reach = window - k + 1
        least = sliding(kmers, reach)
        # Windows that start at i lie in one text; others do not choose.
        whole = np.arange(len(least)) + window <= self.end[: len(least)]
        least = np.where(whole, least, U(0))
        pad = np.concatenate([np.zeros(reach - 1, U), least, np.zeros(reach - 1, U)])
        chosen = sliding(pad, reach, least=False)[: len(kmers)]
        self.at = np.flatnonzero((chosen == kmers) & (chosen > 0)) if n >= window else np.empty(0, np.int64)
        self.key = kmers[self.at]
        left, right = self.at - (window - k), self.at + window
        self.cut = (left < self.begin[self.at]) | (right > self.end[self.at])
        left, right = np.maximum(left, self.begin[self.at]), np.minimum(right, self.end[self.at])
        self.around = RUNS2.runs(self.sums2, left, right)
        self.least, self.whole = least, np.flatnonzero(whole)

    def place(self) -> np.ndarray:
        """Of each anchor, its word's number in its text."""
        return self.at - self.begin[self.at]

    def anchor_of(self) -> np.ndarray:
        """Of each whole window, the number of its anchor."""
        got = np.searchsorted(self.at, self.whole)
        want = self.least[self.whole]
        left = np.flatnonzero(self.key[got] != want) if len(got) else got
        while len(left):
            got[left] += 1
            left = left[self.key[got[left]] != want[left]]
        return got


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_rows(window: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]):
        forget()
        for t in chunks(batches, "text"):
            g = Graph(t["text"], window, k)
            who = g.owner[g.at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_order(t["doc_id"])[who]), pa.array(t["h"].to_numpy()[who]),
                    pa.array(g.place()), pa.array(g.key.view(np.int64)), pa.array(g.around.view(np.int64)), pa.array(g.cut),
                ],
                ["doc", "h", "place", "anchor", "around", "cut"],
            )

    return work


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _rest(words: Words, text: int, mask: np.ndarray) -> bytes:
    """The text's words outside the mask, joined by one space."""
    a, out = int(words.first[text]), []
    for i, j in zip(*(x.tolist() for x in _runs(~mask)), strict=True):
        # bytes.split() cuts at the same six characters as the words do.
        out.append(b" ".join(words.buffer[words.starts[a + i] : words.ends[a + j - 1]].tobytes().split()))
    return b" ".join(out)


def _result(kept: bytes, digest: bool) -> str:
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values.astype(np.int64))


def _decide(window: int, k: int, digest: bool, whole: bool):
    """Rows (doc_id, doc, text, paths): what the anchors decide, and the windows they leave open.  Without
    `whole` a text that loses nothing is not repeated."""

    def work(batches: Iterator[pa.RecordBatch]):
        forget()
        for t in chunks(batches, "text"):
            g = Graph(t["text"], window, k)
            w, n = g.words, len(g.words.starts)
            sure, branch = np.zeros(len(g.at), bool), np.zeros(len(g.at), bool)
            paths = t["paths"].combine_chunks()
            counts = pa.compute.list_value_length(paths).fill_null(0).to_numpy(zero_copy_only=False)
            flat = paths.flatten()
            if len(flat):
                at = flat.field("place").to_numpy() + np.repeat(w.first[:-1], counts)
                at = np.searchsorted(g.at, at)
                sure[at] = flat.field("sure").to_numpy(zero_copy_only=False)
                branch[at] = flat.field("branch").to_numpy(zero_copy_only=False)
            anchor = g.anchor_of()
            mask = _covered(n, g.whole[sure[anchor]], g.whole[sure[anchor]] + window)
            open_at = g.whole[branch[anchor] & ~sure[anchor]]
            per_text = lambda x: np.diff(np.searchsorted(x, w.first))
            waits = per_text(open_at) > 0
            kept, n_removed, ends = [], [], [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
            lengths = np.zeros(w.n, np.int64)
            for i in range(w.n):
                own = mask[w.first[i] : w.first[i + 1]]
                n_removed.append(int(own.sum()))
                kept.append(None if waits[i] or not (whole or n_removed[-1]) else _result(_rest(w, i, own), digest))
                if waits[i]:
                    runs = _runs(own)
                    lengths[i] = len(runs[0])
                    for x, y in zip(ends, runs, strict=True):
                        x.append(y)
            one, two = RUNS.fixed(g.sums, window), RUNS2.fixed(g.sums2, window)
            open_n, text = per_text(open_at), t["text"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    t["doc_id"].combine_chunks(), t["h"].combine_chunks(), pa.array(_order(t["doc_id"])), pa.array(w.counts.astype(np.int64)),
                    pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                    pa.compute.if_else(pa.array(waits), text, pa.scalar(None, text.type)).cast(pa.string()),
                    _lists(np.concatenate(ends[0]), lengths), _lists(np.concatenate(ends[1]), lengths),
                    _lists(open_at - g.begin[open_at], open_n), _lists(one[open_at].view(np.int64), open_n), _lists(two[open_at].view(np.int64), open_n),
                ],
                ["doc_id", "h", "doc", "n_words", "n_removed", "kept_text", "text", "starts", "ends", "places", "w1", "w2"],
            )

    return work


def _finish(window: int, digest: bool):
    def work(batches: Iterator[pa.RecordBatch]):
        for t in chunks(batches, "text"):
            w = Words(t["text"])
            kept, removed = [], []
            for i, (a, b, p) in enumerate(zip(t["starts"].to_pylist(), t["ends"].to_pylist(), t["found"].to_pylist(), strict=True)):
                p = np.array(p or [], np.int64)
                mask = _covered(int(w.counts[i]), np.concatenate([np.array(a, np.int64), p]), np.concatenate([np.array(b, np.int64), p + window]))
                removed.append(int(mask.sum()))
                kept.append(_result(_rest(w, i, mask), digest))
            yield pa.RecordBatch.from_arrays(
                [t["row"].combine_chunks(), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_removed", "kept_text"]
            )

    return work


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = KMER, digest: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_text; with `digest`
    kept_sha256 in the place of kept_text, so that kept texts need not be stored on the way.

    Removes every word covered by a window of `window` words that also starts in a document
    with a smaller doc_id, judged on the input; kept_text joins the rest by one space.  Null and
    empty texts have no words.  A null doc_id comes after all others; rows of one doc_id never
    remove from each other; texts shorter than the window keep everything.  An empty table gives
    no rows; other columns are not read."""
    kept = F.col("kept_text").alias("kept_sha256" if digest else "kept_text")
    return _deduped(docs, window, k, digest).select("doc_id", "n_words", "n_removed", kept)


def _deduped(docs: DataFrame, window: int, k: int, digest: bool, whole: bool = True) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    anchors = mapped(base, _anchor_rows(window, k), "doc long, h long, place long, anchor long, around long, cut boolean")
    anchors = stored(anchors, "anchors")
    nodes = anchors.groupBy("anchor").agg(
        F.min(F.struct("doc", "place", "around", "cut")).alias("source"), F.max("doc").alias("top"),
        F.min("around").alias("a"), F.max("around").alias("b"), F.max("cut").alias("any_cut"),
    ).where("source.doc < top").select("anchor", "source", (F.col("any_cut") | (F.col("a") != F.col("b"))).alias("branch"))
    # Stored, so that the join below shuffles both sides for itself and a hot anchor can be split.
    nodes = stored(nodes, "nodes")
    alike = (F.col("around") == F.col("source.around")) & ~F.col("cut") & ~F.col("source.cut")
    paths = anchors.join(nodes, "anchor").select(
        "doc", "h", F.struct("place", (alike & (F.col("doc") > F.col("source.doc"))).alias("sure"), "branch").alias("path")
    ).groupBy("doc", "h").agg(F.collect_set("path").alias("paths"))
    doc = F.coalesce("doc_id", F.lit(LAST))
    found = base.withColumn("doc", doc).join(paths, ["doc", "h"], "left").select("doc_id", "h", "text", "paths")
    schema = (
        "doc_id long, h long, doc long, n_words long, n_removed long, kept_text string, text string, "
        "starts array<long>, ends array<long>, places array<long>, w1 array<long>, w2 array<long>"
    )
    first = stored(mapped(found, _decide(window, k, digest, whole), schema).withColumn("row", F.monotonically_increasing_id()), "decided")
    waiting = first.where("text is not null")
    single = waiting.select("row", "doc", F.explode(F.arrays_zip("places", "w1", "w2")).alias("x")).select("row", "doc", "x.*")
    again = single.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("doc").alias("top")).where("source < top")
    again = stored(again.select("w1", "w2", "source"), "again")
    hits = single.join(again, ["w1", "w2"]).where("source < doc")
    hits = hits.groupBy("row").agg(F.collect_list("places").alias("found"))
    last = waiting.select("row", "text", "starts", "ends").join(hits, "row", "left")
    last = mapped(last, _finish(window, digest), "row long, n_removed long, kept_text string")
    columns = ["doc_id", "h", "n_words", "n_removed", "kept_text"]
    done = first.where("text is null").select(*columns)
    return done.union(waiting.select("row", "doc_id", "h", "n_words").join(last, "row").select(*columns))


def remove_spans(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """docs with the repeated words taken out of `text`, and `n_chars`, if there is one, made to
    fit.  A text that loses nothing stays as it was, white space included; a document that loses
    every word goes; the other columns stay as they were."""
    cut = _deduped(docs, window, k, False, whole=False).where("n_removed > 0").select(
        F.coalesce("doc_id", F.lit(LAST)).alias("__id"), F.col("h").alias("__h"), F.col("kept_text").alias("__kept"), (F.col("n_removed") == F.col("n_words")).alias("__all")
    )
    # Rows equal in doc_id and text lose the same words.
    cut = stored(cut.distinct(), "cut")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == cut["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == cut["__h"])
    joined = docs.join(cut, same, "left").where("__all is null or not __all")
    text = F.coalesce("__kept", "text")
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
