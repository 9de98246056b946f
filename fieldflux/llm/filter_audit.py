"""What corpus filters remove together: a contingency tensor for each part, contracted for every order.

Each row passes or fails each of the filters, whatever the others say.  Counts by part and by all
combinations of pass and fail make a 2 x 2 x ... x 2 tensor; every figure of every order of the filters
is that tensor contracted with one selector for each axis: pass, fail or all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

PASS, FAIL, ALL = np.eye(2, dtype=np.int64)[0], np.eye(2, dtype=np.int64)[1], np.ones(2, np.int64)
AXES = "abcdefgh"
#: Parts whose rows are made at once: a part has (number of filters)! orders of that many steps.
PARTS = 32


def contract(tensor: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """tensor: [part, mark, 2, ..., 2]; selectors: [cut, axis, 2].  For each part, mark and cut, the
    sum over the cells that the cut selects along each axis."""
    axes = AXES[: selectors.shape[1]]
    operands = ",".join(f"s{x}" for x in axes)
    return np.einsum(f"pm{axes},{operands}->pms", tensor, *np.moveaxis(selectors, 1, 0), optimize="greedy")


def cuts(n: int) -> dict[str, np.ndarray]:
    """For each order of n filters and each step in it, the selectors of what the step keeps and removes
    and of what its filter finds too late, and the number of that filter; orders by letter."""
    kept, removed, late, which = [], [], [], []
    for order in permutations(range(n)):
        for step, axis in enumerate(order):
            earlier = set(order[:step])
            stay = [PASS if x in earlier or x == axis else ALL for x in range(n)]
            kept.append(stay)
            removed.append([*stay[:axis], FAIL, *stay[axis + 1 :]])
            late.append([FAIL if x == axis else ALL for x in range(n)])
            which.append(axis)
    return {"kept": np.array(kept), "removed": np.array(removed), "fails": np.array(late), "axis": np.array(which)}


def _figures(names: list[str], marks: list[str]):
    n = len(names)

    def work(batches: Iterator[pa.RecordBatch]):
        plan = cuts(n)
        orders = ["".join(names[x] for x in order) for order in permutations(range(n))]
        alone = np.array([[FAIL if x == axis else PASS for x in range(n)] for axis in range(n)])
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                parts, cells = some.column("part"), some.column("cells")
                row = np.repeat(np.arange(len(parts)), pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False))
                cell, *counts = (x.to_numpy(zero_copy_only=False) for x in cells.flatten().flatten())
                tensor = np.zeros((len(parts), 1 + len(marks), 1 << n), np.int64)
                for m, count in enumerate(counts):
                    tensor[row, m, cell] = count
                # Bit 0 of a cell's number is the first filter.
                tensor = tensor.reshape(len(parts), 1 + len(marks), *[2] * n).transpose(0, 1, *range(n + 1, 1, -1))
                kept, removed = contract(tensor, plan["kept"]), contract(tensor, plan["removed"])
                redundant = contract(tensor[:, :1], plan["fails"])[:, 0] - removed[:, 0]
                unique = contract(tensor[:, :1], alone)[:, 0][:, plan["axis"]]
                shapley = np.stack([removed[:, 0, plan["axis"] == axis].sum(axis=1) for axis in range(n)], 1)[:, plan["axis"]]
                steps = len(plan["axis"])
                out = [parts.take(pa.array(np.repeat(np.arange(len(parts)), steps))), pa.array(np.repeat(orders, n).tolist() * len(parts), pa.string())]
                out += [pa.array(np.tile(np.arange(steps) % n + 1, len(parts)).astype(np.int32))]
                for x in (kept[:, 0], removed[:, 0], redundant, unique, *(removed[:, 1 + m] for m in range(len(marks))), shapley):
                    out.append(pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(out, ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *marks, "shapley"])

    return work


def interactions(rows: DataFrame, names: list[str], marks: list[str]) -> DataFrame:
    """rows: part, a boolean for each filter of `names` (true: fails), a boolean for each of `marks`.

    For each part, order of all filters and step, zeros included: kept, removed, redundant (fails the
    step's filter, removed before), unique_fails (fails that filter only), for each mark how many of
    the removed have it, shapley (removed by that filter, summed over all orders).

    A null verdict passes, a null mark isn't there, a null part is the empty part; no rows give no
    parts.  Repeated rows count each.  Counts are summed before they are exchanged, so a part with
    most rows costs no more than another; a part has 2^n cells, and n is 8 at most."""
    if not 1 <= len(names) <= len(AXES):
        raise ValueError(f"between 1 and {len(AXES)} filters")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    cell = sum((yes(c) * (1 << i) for i, c in enumerate(names)), F.lit(0))
    cells = (
        rows.select(F.coalesce("part", F.lit("")).alias("part"), cell.alias("cell"), *[yes(m).alias(m) for m in marks])
        .groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks])
    )
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", *marks)).alias("cells"))
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", *marks, "shapley"))
    return mapped(cells, _figures(names, marks), f"part string, filter_order string, step int, {counts}")


WORD_GAP = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (true: fails), good_lost, toxic_lost for each row of docs.

    A: under 200 words; B: less than half of the words differ; C: over 2 % of the characters are capitals;
    D: has one of #$%&*|; E: a row with a smaller doc_id has the same text.  A null text is empty, and
    fails A alone or with E.  A null doc_id is smaller than none and has no smaller one, and no label.
    Rows that share a doc_id and a text fail E together or not at all.  Of several labels of one
    doc_id, a mark counts if any has it; labels without a document count for nothing.  Texts are equal
    by their SHA-256.  Other columns are not read."""
    text, words = F.col("text"), F.col("words")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    rows = stored(
        rows.select(
            "doc_id", "part", F.unhex(F.sha2(text, 256)).alias("same"), (F.size(words) < 200).alias("A"),
            (100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long")).alias("B"),
            (100 * capitals.cast("long") > 2 * F.length(text).cast("long")).alias("C"), text.rlike(r"[#$%&*|]").alias("D"),
        ),
        "verdicts",
    )
    # One row for each text: the first.  Joined by its doc_id, so that many copies of a text don't meet in one task.
    firsts = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good_lost"), F.max(F.col("toxic") == 1).alias("toxic_lost"))
    return (
        rows.join(firsts, ["doc_id", "same"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
        .join(marks, "doc_id", "left").select("part", *"ABCDE", "good_lost", "toxic_lost")
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`interactions` of `verdicts`, for each source."""
    return interactions(verdicts(docs, labels), list("ABCDE"), ["good_lost", "toxic_lost"])


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
             + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT)
             + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS cell
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, cell, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, cell),
x AS (SELECT unnest(range(5)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT list_aggregate(list_transform(o, lambda v: substr('ABCDE', CAST(v + 1 AS INT), 1)), 'string_agg', '') AS filter_order,
                 x.i + 1 AS step, 1 << CAST(o[x.i + 1] AS INT) AS own,
                 CAST(coalesce(list_sum(list_transform(o[1:x.i], lambda v: 1 << CAST(v AS INT))), 0) AS INT) AS earlier
          FROM orders, x),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
             coalesce(sum(n) FILTER (cell & earlier = 0 AND cell & own = 0), 0) AS kept,
             coalesce(sum(n) FILTER (cell & earlier = 0 AND cell & own <> 0), 0) AS removed,
             coalesce(sum(n) FILTER (cell & earlier <> 0 AND cell & own <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (cell = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (cell & earlier = 0 AND cell & own <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (cell & earlier = 0 AND cell & own <> 0), 0) AS toxic_lost
      FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
