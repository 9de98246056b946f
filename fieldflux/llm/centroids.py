"""Centroid clustering over zone maps in the order of a space-filling curve.

Vectors become integers.  Turned onto the axes along which they spread most, they are ordered along a
Hilbert curve over the leading axes and cut into blocks; each block carries the box of its turned
vectors and the sum of the whole ones.  In a round, a box decides which centroids can be nearest to any
vector in it: one whose least distance to the box is above another's largest can't, and neither can one
that is farther than another at the corner that favours it most.  With one candidate left the block's sum
counts as a whole; with more, its vectors are compared with the candidates, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, partitions, stored

SCALE, BLOCK = 1024, 128
#: Axes and bits of each in a Hilbert key; their product must stay below 63.
AXES, BITS = 10, 5
#: Components beyond this would take sums of squares past 64 bits.
LARGEST = 1 << 27


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells: [row, axis], each in 0 .. 2^bits - 1.

    Works on the bits from the top down: each level's corner turns and mirrors all lower levels."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(len(x)):
            high = (x[axis] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << 1 | (x[axis] >> level & 1)
    return key


@dataclass
class Frame:
    """Where the vectors lie: their mean, their principal axes (a column each), their spread along them."""

    mean: np.ndarray
    axes: np.ndarray
    spread: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def keys(self, x: np.ndarray) -> np.ndarray:
        n = min(AXES, x.shape[1])
        cell = (x[:, :n] / np.maximum(self.spread[:n], 1e-9) / 6 + 0.5) * (1 << BITS)
        return hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if len(values) and int(np.abs(values).max()) > LARGEST:
        raise ValueError(f"a component times {SCALE} is beyond {LARGEST}")
    return values


def _moments(dim: int):
    def work(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = _matrix(b.column("x"), dim).astype(float)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "n"])

    return work


def _frame(vectors: DataFrame, dim: int) -> Frame:
    cells = mapped(vectors.select("x"), _moments(dim), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((dim + 1) ** 2)
    sums[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sums = sums.reshape(dim + 1, dim + 1)
    n = max(1.0, sums[-1, -1])
    mean = sums[-1, :-1] / n
    values, axes = np.linalg.eigh(sums[:-1, :-1] / n - np.outer(mean, mean))
    return Frame(mean, axes[:, ::-1].copy(), np.sqrt(np.maximum(values[::-1], 0)))


def _keyed(shared, dim: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = _matrix(b.column("x"), dim)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<i4"))])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(shared.value.keys(shared.value.turned(x))), packed.cast(pa.binary())], ["vec_id", "key", "x"])

    return work


def _blocks(shared, dim: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]):
        def block(t: pa.Table) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(t["x"].to_pylist()), "<i4").reshape(-1, dim)
            at = shared.value.turned(x)
            rows = [pa.array([v.tolist()], pa.list_(kind)) for v, kind in ((at.min(axis=0), pa.float64()), (at.max(axis=0), pa.float64()), (x.sum(axis=0, dtype=np.int64), pa.int64()))]
            ids = t["vec_id"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            return pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], ["lo", "hi", "total", "ids", "x"])

        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows >= size:
                yield block(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield block(held)

    return work


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[block, centroid]: whether the centroid can be the nearest of a point of the block's box.  A hair is
    allowed for rounding, so a doubtful centroid stays a candidate."""
    near = np.maximum(np.maximum(lo[:, None] - centroids, centroids - hi[:, None]), 0)
    far = np.maximum(np.abs(centroids - lo[:, None]), np.abs(centroids - hi[:, None]))
    near, far = (near**2).sum(axis=2), (far**2).sum(axis=2)
    hair = 1e-9 * (1 + far.max(axis=1))
    able = near <= far.min(axis=1)[:, None] + hair[:, None]
    # The corner of the box that is best for j against the centroid nearest to the box's middle.
    first = (((lo + hi)[:, None] / 2 - centroids) ** 2).sum(axis=2).argmin(axis=1)
    way = centroids[None] - centroids[first][:, None]
    corner = np.where(way > 0, hi[:, None], lo[:, None])
    better = (2 * corner * way).sum(axis=2) + (centroids[first] ** 2).sum(axis=1)[:, None] - (centroids**2).sum(axis=1)
    able &= better >= -hair[:, None]
    able[np.arange(len(lo)), first] = True
    return able


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in exact integers; in doubles only where those are exact too."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * largest * largest < 1 << 53 else np.int64
    x, centroids = x.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)).astype(np.int64)


def _zones(batch: pa.RecordBatch, frame: Frame, centroids: np.ndarray) -> np.ndarray:
    lo, hi = (pa.compute.list_flatten(batch.column(c)).to_numpy().reshape(batch.num_rows, -1) for c in ("lo", "hi"))
    return candidates(lo, hi, frame.turned(centroids))


def _round(shared, k: int, dim: int):
    """(cluster, axis, n): sums of the vectors nearest to each centroid; axis dim: their number.  Cluster k
    counts blocks (0), blocks with one candidate (1) and comparisons made (2)."""

    def work(batches: Iterator[pa.RecordBatch]):
        frame, centroids = shared.value
        sums, seen = np.zeros((k, dim + 1), np.int64), np.zeros(dim + 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            able = _zones(b, frame, centroids)
            n = pa.compute.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False)
            total = pa.compute.list_flatten(b.column("total")).to_numpy().reshape(-1, dim)
            alone = able.sum(axis=1) == 1
            only = able.argmax(axis=1)
            np.add.at(sums, only[alone], np.concatenate([total, n[:, None]], 1)[alone])
            seen[:3] += (b.num_rows, alone.sum(), (able.sum(axis=1) * n)[~alone].sum())
            for i in np.flatnonzero(~alone):
                some = np.flatnonzero(able[i])
                x = np.frombuffer(b.column("x")[int(i)].as_buffer(), "<i4").reshape(-1, dim)
                best = some[distances(x, centroids[some]).argmin(axis=1)]
                for c in some:
                    sums[c, :dim] += x[best == c].sum(axis=0, dtype=np.int64)
                sums[:, dim] += np.bincount(best, minlength=k)
        full = np.concatenate([sums, seen[None]])
        cell = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(cell // (dim + 1)), pa.array(cell % (dim + 1)), pa.array(full.ravel()[cell])], ["cluster", "axis", "n"])

    return work


def _assign(shared, dim: int):
    def work(batches: Iterator[pa.RecordBatch]):
        frame, centroids = shared.value
        for b in batches:
            able = _zones(b, frame, centroids) if b.num_rows else ()
            for i in range(b.num_rows):
                some = np.flatnonzero(able[i])
                x = np.frombuffer(b.column("x")[i].as_buffer(), "<i4").reshape(-1, dim)
                all_ = distances(x, centroids[some])
                best = all_.argmin(axis=1)
                ids = b.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(some[best].astype(np.int32)), pa.array(all_[np.arange(len(x)), best])], ["vec_id", "cluster", "distance"])

    return work


@dataclass
class Clusters:
    """vectors: vec_id, cluster, distance; centroids: [cluster, axis]; pruning: for each round the number of
    blocks, of blocks with one candidate, and of comparisons made."""

    vectors: DataFrame
    centroids: np.ndarray
    pruning: list[tuple[int, int, int]]


def kept_vectors(vectors: DataFrame, dim: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, integers floor(1024 * component), of the vectors with `dim` finite components."""
    finite = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce((F.size(F.col(embedding)) == dim) & F.coalesce(finite, F.lit(False)), F.lit(False))
    return vectors.where(good).select(F.col(vec_id).alias("vec_id"), F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3", block: int = BLOCK) -> Clusters:
    """Lloyd's rounds from the k vectors with the smallest SHA-256 of `seed:vec_id`, in exact integers.

    vectors: vec_id and embedding.  Null vectors, those of another length and those with a null or
    non-finite component are left out.  Ties go to the smaller centroid; a centroid that no vector is
    nearest to stays.  With fewer than k vectors there are as many centroids; with none, no rows.
    Equal hashes (repeated ids) start in the order of their components; null ids don't start unless
    nothing else is left.  Repeated rows are rows of their own, and very many equal vectors spread over
    blocks and tasks by their ids and places.  An error is raised for components beyond 2^17."""
    spark = vectors.sparkSession
    kept = stored(kept_vectors(vectors, dim), "vectors")
    name = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    starts = kept.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if not starts:
        return Clusters(spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), np.zeros((0, dim), np.int64), [])
    centroids = np.array([r["x"] for r in starts], np.int64)
    frame = _frame(kept, dim)
    shared = spark.sparkContext.broadcast(frame)
    order = ["key", "spot", "vec_id", "place"]
    keyed = mapped(kept, _keyed(shared, dim), f"vec_id {id_type}, key long, x binary")
    keyed = keyed.withColumns({"spot": F.xxhash64("vec_id"), "place": F.monotonically_increasing_id()})
    keyed = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("vec_id", "x")
    zones = stored(
        mapped(keyed, _blocks(shared, dim, block), f"lo array<double>, hi array<double>, total array<long>, ids array<{id_type}>, x binary"), "zones"
    )
    pruning = []
    for _ in range(rounds):
        both = spark.sparkContext.broadcast((frame, centroids))
        got = mapped(zones, _round(both, len(centroids), dim), "cluster long, axis long, n long")
        got = got.groupBy("cluster", "axis").agg(F.sum("n").alias("n")).toArrow()  # (k + 1) * (dim + 1) rows at most
        sums = np.zeros((len(centroids) + 1, dim + 1), np.int64)
        sums[got["cluster"].to_numpy(), got["axis"].to_numpy()] = got["n"].to_numpy()
        pruning.append(tuple(int(x) for x in sums[-1, :3]))
        sums = sums[:-1]
        some = sums[:, dim] > 0
        after = centroids.copy()
        after[some] = sums[some, :dim] // sums[some, dim:]
        # Rounds that would change nothing are not run: they would leave the same centroids.
        if (after == centroids).all():
            break
        centroids = after
    both = spark.sparkContext.broadcast((frame, centroids))
    found = mapped(zones, _assign(both, dim), f"vec_id {id_type}, cluster int, distance long")
    return Clusters(stored(found, "assigned"), centroids, pruning)


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3") -> DataFrame:
    """`cluster`, with cluster_inertia, inertia (sums of distance) and centroid_sha256 for each vector."""
    got = cluster(vectors, k, rounds, dim, seed)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in got.centroids.tolist()]
    sums = got.vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}  # k rows at most
    rows = [(c, n, sum(sums.values()), names[c]) for c, n in sorted(sums.items())]
    named = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.vectors.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3") -> str:
    """The same clustering in SQL, every vector against every centroid, a common table for each round."""
    steps = [
        f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim}),
    e AS MATERIALIZED (SELECT r, unnest(x) AS x, unnest(range({dim})) AS a FROM v),
    s AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k}),
    c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, unnest(range({dim})) AS a FROM s)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} AS (SELECT r, c, CAST(sum((e.x - c{i}.x) * (e.x - c{i}.x)) AS BIGINT) AS distance FROM e JOIN c{i} USING (a) GROUP BY r, c),
    n{i} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{i} GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT c, a, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM e JOIN n{i} USING (r) GROUP BY c, a),
    c{i + 1} AS MATERIALIZED (SELECT c, a, coalesce((t - ((t % n) + n) % n) // n, x) AS x FROM c{i} LEFT JOIN m{i} USING (c, a))"""
            )
    last = rounds
    return (
        ",\n    ".join(steps)
        + f""",
    h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY a)) AS centroid_sha256 FROM c{last} GROUP BY c)
    SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM n{last} JOIN v USING (r) JOIN h USING (c)"""
    )
