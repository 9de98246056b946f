"""Exact duplicates by block naming.

A text is cut into blocks of a fixed number of bytes.  The different blocks are sorted and each
gets its place in that order as an integer name; equal blocks, and only they, have equal names.
Then adjacent names are paired, the different pairs are sorted and named in the same way, and so
on until one name is left: the identity of the text.  Every row is named, and two different
texts can't share an identity.

The order of blocks is that of (64-bit hash, bytes).  Where a hash belongs to one block of the
whole table it decides the place alone; blocks with equal hashes are compared by their bytes.  So
texts are shuffled once, to learn which hashes are met again, and only bytes met again are kept.  A row of a large group of
copies costs what any other row costs: blocks are made distinct before they are shuffled, and
the joins that give names back meet stored tables, so adaptive execution splits them where one
block is very frequent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_positions, stored

BLOCK = 1024


def _named(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows with `name`, the place of their keys among all different keys."""
    names = stored(dense_positions(rows.select(*keys).distinct(), keys, "name", label), label)
    cond = [rows[k].eqNullSafe(names[k]) for k in keys]
    return rows.join(names, cond).drop(*[names[k] for k in keys])


def _blocks(texts: DataFrame, with_first: list[str], block: int, order: Callable[[Column], Column]) -> DataFrame:
    """(row, n_bytes, i, key, piece, ..) for each block of (row, raw, ..), stored: key is its hash, piece its
    bytes, or null if no other block has this key.  The columns `with_first` go with block 0 of a row."""
    cells = texts.select(
        "row",
        *with_first,
        F.octet_length("raw").cast("long").alias("n_bytes"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("raw") - 1) / block).cast("int"))),
                lambda i: F.substring(F.col("raw"), i * block + 1, F.lit(block)),
            )
        ).alias("i", "piece"),
    ).withColumn("key", order(F.col("piece")))
    again = cells.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.lit(True).alias("again"))
    # Merged at every size: the table of hashes grows with the input, so it is no side to broadcast.
    cells = cells.join(stored(again, "again").hint("merge"), "key", "left")
    first = [F.when(F.col("i") == 0, F.col(c)).alias(c) for c in with_first]
    return stored(cells.select("row", *first, "n_bytes", "i", "key", F.when(F.col("again"), F.col("piece")).alias("piece")), "cells")


def _identities(cells: DataFrame, block: int) -> DataFrame:
    """(row, n_bytes, level, name) for each row of _blocks."""
    done = None
    now = _named(cells.select("row", "n_bytes", "i", "key", "piece"), ["key", "piece"], "blocks")
    now = now.select("row", "n_bytes", "i", "name")
    level = 0
    while True:
        # The number of blocks follows from the length: all texts of one length end at one level.
        now = stored(now, "names")
        left = F.ceil(F.greatest(F.col("n_bytes"), F.lit(1)) / (block << level))
        ended = now.where(left <= 1).select("row", "n_bytes", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.union(ended)
        going = now.where(left > 1)
        if going.isEmpty():
            return done
        half = F.shiftright("i", 1)
        pairs = going.groupBy("row", "n_bytes", half.alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            # The last block may stand alone.
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        now = _named(stored(pairs, "pairs"), ["a", "b"], "pair-names").select("row", "n_bytes", "i", "name")
        level += 1


def block_names(
    texts: DataFrame, row: str = "row", text: str = "text", block: int = BLOCK, order: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """(row, n_bytes, level, name): rows with equal texts, and only they, have the same last three.

    `row` must be unique; null text counts as empty.  `order` is the hash that comes before the bytes
    in the order of blocks; a weak one moves more bytes and gives the same classes."""
    raw = texts.select(F.col(row).alias("row"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    return _identities(_blocks(raw, [], block, order), block)


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays.  Null text counts as empty,
    a null doc_id as smaller than any other.  Where the largest doc_id itself is repeated, each
    of its rows is kept=true, as nothing tells them apart.  A very long text is many blocks and
    nothing else.  An empty table gives no rows; other columns are not read."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", raw.alias("raw"), F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("text_sha256", F.sha2("raw", 256))
    cells = _blocks(base, ["doc_id", "text_sha256"], block, F.xxhash64)
    heads = cells.where("i = 0").select("row", "doc_id", "text_sha256")
    keys = ["n_bytes", "level", "name"]
    rows = stored(heads.join(_identities(cells, block), "row"), "named")
    groups = rows.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(stored(groups, "groups"), keys).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, its columns as they were.

    Of rows that are equal in doc_id and text one stays, with the other columns of the row that
    comes first by their hash."""
    found = stored(exact_dedup(docs), "copies")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (sha == gone["__sha"]), "left_anti")
    twice = found.where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id")
    twice = stored(twice, "repeated")
    if twice.isEmpty():
        return kept
    again = docs["doc_id"].eqNullSafe(twice["__id"])
    order = F.xxhash64(*[c for c in docs.columns if c != "text"])
    thin = kept.join(twice, again, "left_semi").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    thin = thin.agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return kept.join(twice, again, "left_anti").union(thin)
