"""Document fingerprints: a homomorphic hash of a document's multiset of paragraphs.

Every paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors, each lane modulo a power of two:

* 16 lanes modulo 2^32: eight 64-bit hashes of the paragraph, for equality.  Equal multisets of
  paragraphs have equal lanes; different ones agree with a chance of about 2^-512.
* 128 lanes modulo 2^16: a +1 or -1 for each sentence of the paragraph, from two 64-bit hashes,
  for likeness.  The squared distance of two such sums is, up to sampling error, 128 times the
  number of sentences that only one of the two has.
* the number of sentences modulo 2^32.

Order does not matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (`plus`, `minus`).  Everything is DataFrame functions: paragraphs are exploded and summed
on the partitioning that the rows already have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_positions, stored

WIDE, SIGNS = 8, 2
NONE = -(1 << 63)  # the place of a null doc_id
_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1


def _sums() -> list[Column]:
    """Aggregates over rows (paragraph, i, sentence); two 32-bit counters to a number, so no
    sum can overflow: a text has fewer than 2^31 bytes."""
    out = []
    for k in range(WIDE):
        h = F.when(F.col("i") == 0, F.xxhash64(F.lit(k), F.col("paragraph")))
        out += [F.sum(h.bitwiseAND(_LOW)).alias(f"w{2 * k}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"w{2 * k + 1}")]
    for k in range(SIGNS):
        out += [F.sum(F.shiftrightunsigned(F.col(f"h{k}"), j).bitwiseAND(_PAIR)).alias(f"s{k}_{j}") for j in range(32)]
    return [*out, F.count(F.col("h0")).alias("units")]


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, wide array<long>, signs array<int>, units long: the sums for each key.

    Rows of one key are added up.  Null text counts as empty, which is one empty paragraph."""
    sentences = (
        rows.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("paragraph"))
        .select(*keys, "paragraph", F.posexplode(F.split("paragraph", "(?<=[.!?]) +")).alias("i", "sentence"))
        .select(
            *keys, "paragraph", "i",
            *[F.when(F.col("sentence") != "", F.xxhash64(F.lit(100 + k), F.col("sentence"))).alias(f"h{k}") for k in range(SIGNS)],
        )
    )
    sums = sentences.groupBy(*keys).agg(*_sums())
    packed = F.array(*[F.coalesce(F.col(f"s{k}_{j}"), F.lit(0)) for k in range(SIGNS) for j in range(32)])
    return sums.select(
        *keys,
        F.transform(F.array(*[F.coalesce(F.col(f"w{j}"), F.lit(0)) for j in range(2 * WIDE)]), lambda x: x.bitwiseAND(_LOW)).alias("wide"),
        F.transform(
            F.concat(F.transform(packed, lambda x: x.bitwiseAND(_LOW)), F.transform(packed, lambda x: F.shiftrightunsigned(x, 32))),
            lambda c: (2 * c - F.col("units")).cast("int"),
        ).alias("signs"),
        "units",
    )


def plus(a: Column, b: Column, bits: int = 32) -> Column:
    """The wide lanes of two documents together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND((1 << bits) - 1))


def minus(a: Column, b: Column, bits: int = 32) -> Column:
    """The wide lanes of a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND((1 << bits) - 1))


def text_of(wide: Column, signs: Column, units: Column) -> Column:
    """The fingerprint as hexadecimal digits: wide lanes of 8, sign lanes of 4, units of 8."""
    hexed = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND((1 << 4 * n) - 1))), n, "0")), "")
    return F.concat(hexed(wide, 8), hexed(signs, 4), hexed(F.array(units), 8))


def _square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)


def likeness(wide_a: Column, signs_a: Column, wide_b: Column, signs_b: Column) -> Column:
    """0 to 1: the share of sentences that two documents have in common (Dice), estimated from
    their fingerprints.  1 for equal fingerprints, 0 if just one document has a sentence."""
    apart = _square(F.zip_with(signs_a, signs_b, lambda x, y: x - y))
    whole = _square(signs_a) + _square(signs_b)
    close = F.when(whole > 0, F.greatest(F.lit(0.0), 1 - apart / whole)).otherwise(0.0)
    return F.when((wide_a == wide_b) & (signs_a == signs_b), F.lit(1.0)).otherwise(F.least(close, F.lit(1.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) characters by the first as many (or all)
    of the next document in ascending doc_id; after the last comes the first.  Null text counts
    as empty.  A null doc_id comes first; rows of one doc_id follow each other by a hash of
    their text, so the next of a repeated row is the same text, but for the last of them.  A
    table of one row is its own next.  An empty table gives no rows; other columns are not read.

    The text is shuffled once, by document; the heads go to the documents before them."""
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    ids = base.groupBy("id", "h").agg(F.max(F.length("text")).alias("n"))
    order = stored(dense_positions(ids, ["id", "h"], "pos", "documents"), "order")
    total = order.count()
    before = order.select(
        ((F.col("pos") + 1) % max(1, total)).alias("pos"), F.col("id").alias("prev_id"), F.col("h").alias("prev_h"),
        F.floor(F.col("n") / 2).cast("int").alias("need"),
    )
    links = stored(order.join(before, "pos").select("id", "h", "prev_id", "prev_h", "need"), "links")
    # Both readers of `rows` take the same columns from it, so that one exchange of the text serves them.
    rows = base.groupBy("id", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).join(links, ["id", "h"])
    own = rows.where("copies > 0")
    heads = own.select(F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.expr("left(text, need)").alias("tail"))
    half = F.floor(F.length("text") / 2).cast("int")
    edit = rows.join(heads, ["id", "h"]).withColumn("half", half)
    edit = edit.withColumn("variant", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    edit = edit.withColumn(
        "edited",
        F.concat(
            F.expr("left(text, length(text) - half)"),
            F.when(F.col("variant") == 0, F.col("tail")).otherwise(F.expr("left(text, half)")),
        ),
    )
    keep = ["id", "h", "variant", "copies", "n_chars", "edited_sha256"]
    both = edit.select(
        *[c for c in keep if c not in ("n_chars", "edited_sha256")],
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("content")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("content")))).alias("x"),
    ).select(*keep, "x.which", "x.content")
    sums = vectors(both, [*keep, "which"], "content")
    pick = lambda c, k: F.first(F.when(F.col("which") == k, F.col(c)), True)
    prints = sums.groupBy(*keep).agg(
        *[pick(c, k).alias(f"{c}{k}") for k in (0, 1) for c in ("wide", "signs", "units")]
    )
    # The next document's sums are made where its text is, and sent to the document before it.
    after = vectors(own.select("id", "h", "prev_id", "prev_h", "text"), ["id", "h", "prev_id", "prev_h"], "text").select(
        F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.col("wide").alias("next_wide"), F.col("signs").alias("next_signs")
    )
    out = prints.join(after, ["id", "h"])
    like = likeness(F.col("wide0"), F.col("signs0"), F.col("next_wide"), F.col("next_signs"))
    times = F.when(F.col("variant") == 0, 1).otherwise(F.col("copies") - 1).cast("int")
    return out.select(
        F.nullif("id", F.lit(NONE)).alias("doc_id"), "n_chars", "edited_sha256",
        text_of(F.col("wide0"), F.col("signs0"), F.col("units0")).alias("fingerprint"),
        text_of(F.col("wide1"), F.col("signs1"), F.col("units1")).alias("edited_fingerprint"),
        likeness(F.col("wide0"), F.col("signs0"), F.col("wide1"), F.col("signs1")).alias("near_edited"),
        F.when(F.col("variant") == 1, F.lit(1.0)).otherwise(like).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("__t"),
    ).drop("__t")
