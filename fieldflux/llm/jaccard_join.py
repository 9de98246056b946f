"""Near duplicates: all documents whose sets of word shingles have a Jaccard similarity of 0.75.

Parity-sketch join.  Every shingle flips one bit of its document's sketch.  Two sketches differ
in the bits of shingles that only one document has, so their Hamming distance is at most the
symmetric difference of the sets, which a similarity of 3/4 holds to (|A| + |B|) / 7 = D.  A
sketch is cut into P > D segments: then two linked documents agree in a segment.  Segments are
very wide (2^64 bits, so written as the XOR of the shingles' hashes, one word each) and P follows
the size band, so agreeing in a segment that is not empty means to share what it holds.

* Size bands grow by 4/3, so a partner is in the same band or the next, and each document
  writes its segments for two pairs of bands.
* Shingles that very many documents share (`frequent`) are left out of the segments.  Any fixed
  set may be left out, as the distance only falls.  A document that thereby, or by chance, has
  too few segments that are not empty is written once more with all shingles, and if that is not
  enough either with a segment for each shingle.  For each pair at least one side's promise holds.
* Equal sets have one id (64-bit digest of the set) and are one document from here on.
* A group of equal segments pairs each member with its first LEADERS members only.  Tasks do so
  before the shuffle and send no more than LEADERS + 1 members of a segment on, so a segment that
  a third of all documents share stays small.  Of groups with more members the membership is
  kept, and when links are known, pairs of members in different components are tried as well:
  no link between two sets is lost, and copies are never expanded into all pairs.
* Candidates are first tested by a short parity sketch's Hamming distance, then by the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, forget, mapped, partitions, stored
from .words import RUNS, U, Words, gathered, mix

SHINGLE, LEADERS = 5, 3
#: A shingle is frequent if at least this share (and 8 LOCAL) of documents has it, counted over chunks in
#: which LOCAL documents have it at least; the MOST_FREQUENT of them count.  None of the three
#: changes a result: they say which shingles are left out of segments.
FREQUENT, LOCAL, MOST_FREQUENT = 0.0002, 2, 1 << 18
#: Bits of the sketch by which pairs within a large group are compared.
SHORT = 1024
_K = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def bands(largest: int) -> list[int]:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-4 * edges[-1] // 3)))
    return [*edges, -(-4 * edges[-1] // 3)]


class Sets:
    """Distinct shingles of each text: `values`, cut at `first`."""

    def __init__(self, texts, k: int = SHINGLE):
        w = Words(texts, lower=True)
        h = w.hashes()
        runs = np.zeros(max(0, len(h) - k + 1), U)
        for j in range(k):
            runs += h[j : len(h) - k + 1 + j] * _K[j]
        runs = mix(runs)
        sums = RUNS.sums(h)
        parts = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= k:
                parts.append(np.unique(runs[a : b - k + 1]))
            elif b > a:
                parts.append(RUNS.runs(sums, np.array([a]), np.array([b])))
            else:
                parts.append(np.empty(0, U))
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.values = np.concatenate(parts) if parts else np.empty(0, U)
        self.owner = np.repeat(np.arange(len(parts)), self.sizes)
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.values ^ U(0x5851F42D4C957F2D)))])
        digest = mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(U) * _K[0])
        self.digest = np.where(self.sizes > 0, digest, U(0))


def _sketch(values: np.ndarray) -> bytes:
    """One bit for each place, flipped by each shingle; as many places as shingles, about."""
    bits = max(256, 1 << int(len(values) - 1).bit_length())
    odd = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _short(s: Sets) -> list[np.ndarray]:
    """Sketches of SHORT bits for every text, as numbers that Spark can compare."""
    odd = np.zeros((len(s.sizes), SHORT), bool)
    np.logical_xor.at(odd, (s.owner, (s.values & U(SHORT - 1)).astype(np.int64)), True)
    return list(np.packbits(odd, axis=1, bitorder="little").view(np.int64))


def _fold(a: np.ndarray, n: int) -> np.ndarray:
    while len(a) > n:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, n) ^ _fold(y, n)).sum())


def _describe(k: int, frequent: float, local: int):
    """kind 0: (doc_id, n, digest, sketch, hash of the text) of each row; kind 1: counts of shingles often met."""

    def work(batches: Iterator[pa.RecordBatch]):
        forget()
        for t in chunks(batches, "text"):
            s = Sets(t["text"], k)
            cuts = zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)
            cuts = list(cuts)
            sketch = [_sketch(s.values[a:b]) if b > a else None for a, b in cuts]
            short = _short(s)
            n = len(s.sizes)
            _, one = np.unique(s.digest, return_index=True)
            one = one[s.sizes[one] > 0]
            got, times = np.unique(s.values[gathered(s.sizes[one], s.first[one])], return_counts=True)
            often = times >= max(local, frequent * len(one))
            got, times = got[often], times[often]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [n, len(got)]).astype(np.int32)),
                    pa.concat_arrays([t["doc_id"].combine_chunks().cast(pa.int64()), pa.nulls(len(got), pa.int64())]),
                    pa.array(np.concatenate([s.sizes, times])),
                    pa.array(np.concatenate([s.digest, got]).view(np.int64)),
                    pa.array([*sketch, *[None] * len(got)], pa.binary()),
                    pa.array([*short, *[None] * len(got)], pa.list_(pa.int64())),
                    pa.concat_arrays([t["digest"].combine_chunks().cast(pa.string()), pa.nulls(len(got), pa.string())]),
                ],
                ["kind", "doc_id", "n", "id", "sketch", "short", "digest"],
            )

    return work


def _segments(s: Sets, docs: np.ndarray, frequent: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number in docs) of all segments that are not empty."""
    sizes = s.sizes[docs]
    values = s.values[gathered(sizes, s.first[docs])]
    owner = np.repeat(np.arange(len(docs)), sizes)
    rare = np.ones(len(values), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rare = frequent[at] != values
    band = np.searchsorted(edges, sizes, "right") - 1
    keys, whose = [], []

    def write(mask: np.ndarray, pair: np.ndarray, parts: np.ndarray, space: int) -> np.ndarray:
        """Segments of the values in mask; the number of them for each document."""
        begin = np.concatenate([[0], np.cumsum(parts)])
        v, o = values[mask], owner[mask]
        slot = ((v >> U(32)) * parts[o].astype(U)) >> U(32)
        words = np.zeros(begin[-1], U)
        np.bitwise_xor.at(words, begin[o] + slot.astype(np.int64), mix(v ^ _K[1]))
        full = np.flatnonzero(words)
        doc = np.searchsorted(begin, full, "right") - 1
        slot = (full - begin[doc]).astype(U)
        keys.append(mix(words[full] ^ mix(slot * _K[2] + pair[doc].astype(U) * _K[3] + (_K[4] ^ U(space)))))
        whose.append(doc)
        return np.bincount(doc, minlength=len(docs))

    for below in (0, 1):
        pair = band - below
        there = pair >= 0
        i = np.maximum(pair, 0)
        small, large = edges[i + 1] - 1, edges[i + 2] - 1
        # The largest difference to a partner, for a document of the lower band and of the upper one.
        most = (sizes + np.where(below == 0, np.minimum(4 * sizes // 3, large), np.minimum(sizes, small))) // 7
        parts = np.where(there, -(-6 * ((small + np.minimum(4 * small // 3, large)) // 7) // 5) + 2, 0)
        got = write(rare & there[owner], pair, parts, 0)
        weak = there & (got <= most)
        if weak.any() and len(frequent):
            got = write(weak[owner], pair, np.where(weak, parts, 0), 1)
            weak &= got <= most
        if weak.any():
            mask = weak[owner]
            keys.append(mix(values[mask] ^ mix(pair[owner[mask]].astype(U) * _K[3] + _K[4] ^ U(2))))
            whose.append(owner[mask])
    return np.concatenate(keys), np.concatenate(whose)


def _grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In order of key, then id, each once: (keys, ids, number in the group, size of the group)."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    keys, ids = keys[order], ids[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.concatenate([start, [len(keys)]]))
    return keys, ids, np.arange(len(keys)) - np.repeat(start, size), np.repeat(size, size)


def _pairs(ids: np.ndarray, place: np.ndarray, leaders: int) -> np.ndarray:
    """(member, leader), each once."""
    out = [np.empty((0, 2), U)]
    for j in range(leaders):
        m = np.flatnonzero(place > j)
        out.append(np.stack([ids[m], ids[m - place[m] + j]], 1))
    both = np.concatenate(out)
    return np.unique(both, axis=0) if len(both) else both


#: Bytes that are sent of a key besides its range.  Two segments that agree by chance make a
#: candidate that the sets then refuse: with n keys in r ranges about n^2 / (r * 2^41) pairs.
LOW = 5
_BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("who", pa.binary()), ("ids", pa.binary())])


def _emit(frequent, edges, ranges: int, k: int, leaders: int):
    def work(batches: Iterator[pa.RecordBatch]):
        forget()
        for t in chunks(batches, "text"):
            s = Sets(t["text"], k)
            _, docs = np.unique(s.digest, return_index=True)
            docs = docs[s.sizes[docs] > 0]
            if not len(docs):
                continue
            keys, whose = _segments(s, docs, frequent.value, edges)
            ids = s.digest[docs]
            keys, whose, place, size = _grouped(keys, whose)
            rows: list[tuple] = []
            crowd = size > leaders + 1
            part = int(ids[0] % U(ranges))
            if crowd.any():
                rows.append((part, 1, b"", b"", _pairs(ids[whose[crowd]], place[crowd], leaders).tobytes()))
                rows.append((part, 2, _group_key(keys[crowd], ranges).tobytes(), b"", ids[whose[crowd]].tobytes()))
            sent = place <= leaders
            keys, whose = keys[sent], whose[sent]
            # Keys are in order, and so are their ranges.
            cuts = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if b > a:
                    own, local = np.unique(whose[a:b], return_inverse=True)
                    kind = np.uint16 if len(own) < 65536 else np.uint32
                    low = keys[a:b].view(np.uint8).reshape(-1, 8)[:, :LOW]
                    rows.append((r, 0, low.tobytes(), local.astype(kind).tobytes(), ids[own].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(_BLOB.names, r, strict=True)) for r in rows], _BLOB)

    return work


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)


def _group_key(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range and the low bytes, which is what is sent of a key."""
    return (_range(keys, ranges).astype(U) << U(8 * LOW)) | (keys & U((1 << 8 * LOW) - 1))


def _meet(leaders: int):
    """Of all segments of a range: kind 1 pairs (a, b), kind 2 members (key a, document b)."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray):
        for i in range(0, len(a), 100_000):
            x, y = a[i : i + 100_000], b[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["kind", "a", "b"]
            )

    def work(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], U)
                if r["kind"] == 1:
                    both = ids.reshape(-1, 2)
                    yield from rows(1, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))
                elif r["kind"] == 2:
                    yield from rows(2, np.frombuffer(r["keys"], U), ids)
                else:
                    m = len(r["keys"]) // LOW
                    low = np.zeros((m, 8), np.uint8)
                    low[:, :LOW] = np.frombuffer(r["keys"], np.uint8).reshape(m, LOW)
                    who = np.frombuffer(r["who"], np.uint16 if len(r["who"]) == 2 * m else np.uint32)
                    keys = low.view(U).ravel() | (U(r["part"]) << U(8 * LOW))
                    held.setdefault(r["part"], []).append((keys, ids[who]))
        for part in list(held):
            keys, ids = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            keys, ids, place, size = _grouped(keys, ids)
            crowd = size > leaders + 1
            yield from rows(2, keys[crowd], ids[crowd])
            pairs = _pairs(ids, place, leaders)
            yield from rows(1, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    return work


def _near(batches: Iterator[pa.RecordBatch]):
    """Pairs (a, b, n_a, n_b, sketch_a, sketch_b) that the parity sketches let pass."""
    for t in batches:
        na, nb = t.column("n_a").to_numpy(), t.column("n_b").to_numpy()
        keep = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
        x, y = t.column("sketch_a"), t.column("sketch_b")
        for i in np.flatnonzero(keep).tolist():
            keep[i] = 7 * hamming(x[i].as_py(), y[i].as_py()) <= na[i] + nb[i]
        yield t.select(["a", "b"]).filter(pa.array(keep))


def _verify(batches: Iterator[pa.RecordBatch]):
    for t in batches:
        keep = []
        for x, y in zip(t.column("set_a"), t.column("set_b"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = len(a) + len(b) - len(np.union1d(a, b))
            keep.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _wanted_sets(bits, mask: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for t in chunks(batches, "text"):
            s = Sets(t["text"], k)
            place = (mix(s.digest) & U(mask)).astype(np.int64)
            want = (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            _, one = np.unique(s.digest, return_index=True)
            rows = [i for i in one.tolist() if want[i] and s.sizes[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.digest[rows].view(np.int64)), pa.array([s.values[s.first[i] : s.first[i + 1]].tobytes() for i in rows], pa.binary())],
                ["id", "set"],
            )

    return work


#: Bits of the map by which a task passes over documents that no candidate pair names.  Its size
#: is fixed: with very many candidates it lets more pass, which the join then drops.
MAP_BITS = 1 << 23


def _bit_map(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id; collected as at most MAP_BITS / 4096 rows."""

    def work(batches: Iterator[pa.RecordBatch]):
        seen = np.zeros(MAP_BITS >> 3, np.uint8)
        for t in batches:
            place = (mix(t.column("id").to_numpy().view(U)) & U(MAP_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(seen, place >> 3, (1 << (place & 7)).astype(np.uint8))
        words = seen.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    words = mapped(ids, work, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(MAP_BITS >> 6, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint8)


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE, leaders: int = LEADERS, frequent_share: float = FREQUENT, local: int = LOCAL
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    A set holds the distinct k-word shingles of the lower-cased (A-Z) words; with fewer words
    the whole sequence is the one shingle.  Null and empty texts have an empty set, linked with
    nothing: component_id is their own doc_id.  Sets link when 100 * intersection >= 75 * union;
    component_id is the smallest doc_id that links reach.  A null doc_id is passed over in that
    minimum (and a component of nothing else has null); a repeated doc_id is a row of its own.
    An empty table gives no rows; other columns are not read."""
    plain = docs.select("doc_id", "text", F.lit(None).cast("string").alias("digest"))
    placed = _placed(plain, k, leaders, frequent_share, local)
    first = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    filled = placed.where("n > 0").join(first, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = placed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return filled.union(empty)


def _placed(docs: DataFrame, k: int, leaders: int = LEADERS, frequent_share: float = FREQUENT, local: int = LOCAL) -> DataFrame:
    """(doc_id, n, digest, root) for each row of docs (doc_id, text, digest): its number of shingles, and
    a set that stands for its component."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "digest")
    texts = base.select("text")
    about = stored(mapped(base, _describe(k, frequent_share, local), "kind int, doc_id long, n long, id long, sketch binary, short array<long>, digest string"), "sets")
    rows = about.where("kind = 0").select("doc_id", "n", "id", "sketch", "short", "digest")
    count, largest = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    frequent = about.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8 * local, frequent_share * count))
    frequent = frequent.orderBy(F.desc("n")).limit(MOST_FREQUENT).select("id").toArrow()["id"].to_numpy()
    sc = spark.sparkContext
    hot = sc.broadcast(np.sort(frequent.view(U)))
    edges = np.array(bands(largest or 1), np.int64)
    ranges = partitions(spark)
    blobs = mapped(texts, _emit(hot, edges, ranges, k, leaders), "part int, kind int, keys binary, who binary, ids binary")
    met = stored(mapped(blobs.repartitionById(ranges, F.col("part")), _meet(leaders), "kind int, a long, b long"), "met")
    classes = rows.where("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short"))
    classes = stored(classes, "classes")

    def tested(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs of `pairs` that link."""
        side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        with_sketch = pairs.join(side("a"), "a").join(side("b"), "b")
        close = stored(mapped(with_sketch.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"), _near, "a long, b long"), label + "-close")
        ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        bits = sc.broadcast(_bit_map(ids))
        sets = mapped(texts, _wanted_sets(bits, MAP_BITS - 1, k), "id long, set binary").join(ids, "id", "left_semi")
        sets = stored(sets.groupBy("id").agg(F.first("set").alias("set")), label + "-sets")
        with_sets = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"
        )
        return stored(mapped(with_sets.select("a", "b", "set_a", "set_b"), _verify, "a long, b long"), label + "-links")

    links = tested(met.where("kind = 1").select("a", "b").distinct(), "led")
    roots = stored(components(spark, links), "roots")
    # Large groups: members that the leaders have not brought together.
    members = met.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    members = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    members = stored(members, "members")
    apart = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    members = stored(members.join(apart, "key", "left_semi"), "apart")
    if not members.isEmpty():
        members = members.join(classes.select("id", "n", "short"), "id")
        one, two = (members.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "root", "n", "short")]) for s in "ab")
        apart = F.aggregate(F.zip_with("short_a", "short_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        # The sketches are compared within the join, so that only likely pairs leave it.
        may = (F.col("id_a") > F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & (
            4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
        ) & (7 * apart <= F.col("n_a") + F.col("n_b"))
        more = one.join(two, (one["key"] == two["key"]) & may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        more = tested(stored(more.join(met.where("kind = 1").select("a", "b"), ["a", "b"], "left_anti"), "rest"), "rest")
        if not more.isEmpty():
            links = links.union(more)
            roots = stored(components(spark, links), "roots")
    placed = rows.select("doc_id", "n", "id", "digest").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return stored(placed.select("doc_id", "n", "digest", F.coalesce("root", "id").alias("root")), "placed")


def keep_first(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs without near duplicates, its columns as they were: of each component the rows with
    the smallest doc_id stay.  Rows without links stay, a null doc_id among them; repeated rows
    of the smallest doc_id are one document and both stay.  A row goes by its doc_id and text, so
    another text of a repeated doc_id is judged by its own links.  Rows with a null doc_id stay beside
    others; in a component of them alone the rows of one text stay."""
    # Rows of one id and text have one set of shingles, so they are in one component.
    digest = lambda: F.sha2(F.coalesce("text", F.lit("")), 256)
    found = _placed(docs.select("doc_id", "text", digest().alias("digest")), k)
    linked = found.where("n > 0")
    first = linked.groupBy("root").agg(F.min("doc_id").alias("least"), F.min("digest").alias("one"))
    stays = F.when(F.col("least").isNull(), F.col("digest") == F.col("one")).otherwise(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("least")))
    gone = linked.join(first, "root").where(~stays).select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct()
    gone = stored(gone, "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (digest() == gone["__digest"]), "left_anti")
