"""Packing tokens into sequences: first-fit decreasing with a tournament tree.

Documents are encoded where they are.  A document's whole runs of `size` tokens are sequences of
their own; what is left over (less than a sequence) goes to one of many groups, drawn by a hash
of the row, so that groups hold about `group_docs` documents whatever the sources or lengths are.
Each group is packed on its own: pieces by falling length, each into the first bin that has
room.  A tournament tree holds the largest room below each node, so that bin is found in
logarithmic time.  A sequence needs no padding where its length is a power of two; a bin with
more than `slack` free tokens is therefore cut into sequences of such lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary_path, word_ids
from .common import chunks, mapped, stored
from .words import Words

SIZE, END, GROUP_DOCS, SLACK = 2048, 1, 2048, 16
#: Sequences of whole runs are numbered from here on, those of groups below.
OWN = 1 << 62


class Rooms:
    """Bins in order of opening, with the largest room below each node."""

    def __init__(self, n: int, size: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [size] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Takes `need` from the first bin with that much room; there is always one."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bin_ = at - self.leaves
        tree[at] -= need
        at //= 2
        while at:
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
            at //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """The items of each bin, in order."""
    rooms = Rooms(len(lengths), size)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = rooms.first_fit(lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def sequences(lengths: list[int], size: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length)."""
    out = []
    for items in first_fit_decreasing(lengths, size):
        fill = sum(lengths[i] for i in items)
        if size - fill <= slack:
            out.append([(i, 0, lengths[i]) for i in items])
            continue
        # Lengths that are powers of two, the largest first.
        rooms = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
        now, room = [], rooms.pop(0)
        for i in items:
            start = 0
            while start < lengths[i]:
                take = min(room, lengths[i] - start)
                now.append((i, start, take))
                start, room = start + take, room - take
                if not room:
                    out.append(now)
                    now, room = [], rooms.pop(0) if rooms else 0
    return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(path: str, size: int, end: int):
    def work(batches: Iterator[pa.RecordBatch]):
        coder = word_ids(path, library=True)
        for t in chunks(batches, "text"):
            w = Words(t["text"])
            ids, per_word, *_ = coder(w)
            ends = np.concatenate([[0], np.cumsum(per_word)])[w.first]
            doc, start, length, tokens, raw = [], [], [], [], []
            for i in range(w.n):
                own = np.append(ids[ends[i] : ends[i + 1]].astype("<u4"), np.uint32(end)).astype("<u4")
                for a in range(0, len(own), size):
                    part = own[a : a + size]
                    doc.append(i)
                    start.append(a)
                    length.append(len(part))
                    tokens.append(len(own))
                    raw.append(part.astype("<u2").tobytes() if len(part) < size else zlib.crc32(part.tobytes()).to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks().cast(pa.int64()).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, tokens)), pa.array(raw, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "raw"],
            )

    return work


def _whole(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        crc = np.array([int.from_bytes(x.as_py(), "little") for x in b.column("raw")], np.int64)
        zero = pa.array(np.zeros(b.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), b.column("length"), pa.array(crc), b.column("doc_tokens"), b.column("sequence_id"), zero],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def _pack(size: int, slack: int):
    def work(key, rows):
        # One order for equal rows in any order of arrival.
        rows = rows.sort_by("order").combine_chunks()
        lengths, raw = rows["length"].to_pylist(), rows["raw"].to_pylist()
        item, start, length, crc, sequence, offset = [], [], [], [], [], []
        for number, pieces in enumerate(sequences(lengths, size, slack)):
            at = 0
            for i, a, n in pieces:
                item.append(i)
                start.append(a)
                length.append(n)
                crc.append(zlib.crc32(np.frombuffer(raw[i], "<u2")[a : a + n].astype("<u4").tobytes()))
                sequence.append((key[0].as_py() << 32) + number)
                offset.append(at)
                at += n
        got = rows.select(["doc_id", "start", "doc_tokens"]).take(pa.array(item, pa.int64()))
        whole = lambda x: pa.array(x, pa.int64())
        return pa.table(
            {
                "doc_id": got["doc_id"], "start": pa.compute.add(got["start"], whole(start)), "length": whole(length), "ids_crc32": whole(crc),
                "doc_tokens": got["doc_tokens"], "sequence_id": whole(sequence), "offset": whole(offset),
            }
        )

    return work


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, group_docs: int = GROUP_DOCS, slack: int = SLACK) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and one id `end`; null and empty texts have that one only.
    Each token lies in exactly one piece.  Repeated doc_ids are separate documents; a null
    doc_id stays null.  An empty table gives no rows; other columns are not read."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = max(1, -(-docs.count() // group_docs))
    schema = "doc_id long, start long, length long, doc_tokens long, raw binary"
    # A row's number within the scan only draws the group and orders equal rows.
    pieces = mapped(base, _encode(path or vocabulary_path(), size, end), schema).withColumn("order", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    whole = pieces.where(F.col("length") == size).select(
        "doc_id", "start", "length", "doc_tokens", "raw", (F.lit(OWN) + F.col("order")).alias("sequence_id")
    )
    rest = pieces.where(F.col("length") < size).withColumn("group", F.pmod(F.xxhash64("order"), F.lit(groups)))
    packed = rest.groupBy("group").applyInArrow(_pack(size, slack), PIECE)
    return mapped(whole, _whole, PIECE).union(packed)
