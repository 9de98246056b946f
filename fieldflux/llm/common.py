"""Helpers shared by the operators: shipping the code, stored tables, dense positions, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflux.scratch import materialize as stored
from fieldflux.scratch import scratch_dir

__all__ = [
    "ship", "stored", "scratch_dir", "documents", "pages", "dense_positions", "components", "chunks", "partitions",
]

_shipped: set[str] = set()
#: Rows of an Arrow batch, unless the session says otherwise: rows hold whole texts, and a batch
#: exists several times over while it goes to Python and back.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


_held: dict = {}


def worker_cache(owner: tuple) -> dict:
    """What a Python worker remembers between tasks.  Only the latest owner's is kept, so the
    tables of the operators that a worker has served don't add up."""
    if owner not in _held:
        _held.clear()
        _held[owner] = {}
    return _held[owner]


def forget() -> None:
    """Called by tasks with nothing of their own to remember: frees what others left."""
    worker_cache(())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "fieldflux_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for exchanges whose number must be fixed."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_positions(df: DataFrame, order: list[str], name: str = "pos", label: str = "order") -> DataFrame:
    """df with a column of positions 0..n-1 in the order of `order` (nulls first), without a
    global window: a range sort, the size of each range, and its running total over the few ranges.

    The range-sorted rows are stored once, so a repeated task can't change a position.  Rows
    that tie in all of `order` may take each other's positions; make the order complete."""
    spark = df.sparkSession
    n = partitions(spark)
    cells = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    cells = stored(cells, label)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = cells.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # As many rows as there are ranges: n at most.
    before, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r["__part"]):
        before.append((r["__part"], total))
        total += r["__n"]
    offsets = spark.createDataFrame(before, "__part int, __before long")
    return (
        cells.withColumn("__part", part.cast("int"))
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + place)
        .drop("__part", "__before", "__at")
    )


def components(spark: SparkSession, edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): for each node of the edges (a, b), the smallest node that it reaches.

    Large-star and small-star in turn until the edges no longer change; every round is a pair of
    grouped minima, so a node with very many neighbours is pre-aggregated, and its rows are
    stored in the shared folder, so a lost executor costs one round at most."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, label)
    last = None
    while True:
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("a", "b")),
        ).first()
        if tuple(seen) == last or seen[0] == 0:
            break
        last = tuple(seen)
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a hang on the lowest of a's neighbourhood.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = stored(large, label)
        # Small star: neighbours below a, and a itself, hang on the lowest below a.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        )
        now = stored(small, label)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, most: int = 1 << 14) -> Iterator[pa.Table]:
    """The rows of a task in groups of about `limit` bytes of `column` and `most` rows, one row at least."""
    held, size, count = [], 0, 0
    for batch in batches:
        at, col = 0, batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        for end in range(batch.num_rows):
            size, count = size + int(lengths[end]), count + 1
            if size >= limit or count >= most:
                held.append(batch.slice(at, end + 1 - at))
                yield pa.Table.from_batches(held)
                held, size, count, at = [], 0, 0, end + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def mapped(df: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH) == "10000":  # Spark's own default
        df.sparkSession.conf.set(BATCH, str(ROWS))
    return df.mapInArrow(work, schema)
