"""Audit of how five filters interact: what each removes in every order in which they can be applied.

Filters: A, fewer than 200 words; B, fewer than half of the words are distinct; C, more than 2 % of the code points are
capitals A-Z; D, a symbol of ``#$%&*|`` occurs; E, the text is that of a smaller id, anywhere in the table. Words are
maximal runs without blanks (``[^\\x20\\x09-\\x0D]+``), told apart by case.

First-failure lookup: the filters that a text fails are five bits, and a table of 32 by 120 entries, computed once, says at
which step each of the 120 orders removes such a text. Texts are counted by part, bits and labels before anything else is
shuffled, at most 128 rows a part and task. Arrow functions index the table with these rows and add them up by part,
order and step (``np.bincount``, weighted by the counts); their partial arrays are summed.

Filter E compares digests of 128 bits, so texts are never shuffled. A text that a large share of the rows repeats, or an id
that they share, is looked up by broadcast (``spread_join``: fewer than ``HOT_KEYS`` such keys can exist).

Null texts are empty: they fail A. The empty text has no words, so B and C (0 < 0) don't fail. Null sources are the part of
the empty string. Rows without an id are equal to no smaller id, are no smaller id to others, and have no labels. Rows that
share an id are no repeats of each other, but each is one of a smaller id's. A document has a label if any of its rows in
``labels`` has it. Repeated rows count each. Empty tables give no parts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, saved, spread_join

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Rows of counts that are looked up at once, so that the cells of their parts fit in memory.
ROWS_AT_ONCE = 512
CELLS = ("removed", "good_lost", "toxic_lost", "failing", "unique_fails", "documents")


def first_failures() -> np.ndarray:
    """For each set of failed filters (bits) and each order, the step that removes; ``STEPS`` where none does."""
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    fails = np.arange(1 << STEPS)[:, None, None] >> order[None] & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def failed(text: bytes, code_points: int) -> int:
    """The bits of the filters A to D that a text fails."""
    words = text.split()  # at the six blanks of ASCII
    n, distinct = len(words), len(set(words))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * code_points) << 2 | (symbols > 0) << 3


def features(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, part, bits, digest) of every row; ``bits`` of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = [(t.as_py().encode(), n) for t, n in zip(texts, pc.utf8_length(texts).to_pylist(), strict=True)]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t, _ in found]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "part": batch.column(1), "bits": pa.array([failed(*x) for x in found], pa.int32()), "digest": pa.array(digests, pa.binary())})

    given = docs.select(F.col(key).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_batches(given, run, f"id {docs.schema[key].dataType.simpleString()}, part string, bits int, digest binary")


def counted(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, bits, good, toxic, n): the documents of each part by the filters that they fail, all five, and by their labels."""
    rows = saved(features(docs, key, text, source))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    rows = spread_join(rows, first, "digest").withColumn("bits", F.col("bits") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0))
    marks = labels.groupBy(F.col(key).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = spread_join(saved(rows.select("id", "part", "bits")), marks.filter("good OR toxic"), "id")
    return rows.groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def _cells(counts: DataFrame) -> DataFrame:
    """The ``CELLS`` of every part, order and step, as partial sums."""
    table = first_failures()
    filters = np.array([[FILTERS.index(f) for f in o] for o in ORDERS]).ravel()
    width = len(ORDERS) * (STEPS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                parts = rows.column(0).dictionary_encode()
                part, bits, n = parts.indices.to_numpy(), rows.column(1).to_numpy(), rows.column(4).to_numpy()
                size = len(parts.dictionary)
                cell = part[:, None] * width + np.arange(len(ORDERS)) * (STEPS + 1) + table[bits]

                def removed(weight: np.ndarray, cell: np.ndarray = cell, size: int = size) -> np.ndarray:
                    found = np.bincount(cell.ravel(), np.repeat(weight, len(ORDERS)), size * width)
                    return found.reshape(size, len(ORDERS), STEPS + 1)[:, :, :STEPS].reshape(size, -1)

                def by_filter(fails: np.ndarray, part: np.ndarray = part, n: np.ndarray = n, size: int = size) -> np.ndarray:
                    found = np.stack([np.bincount(part, n * fails[:, f], size) for f in range(STEPS)], axis=1)
                    return found[:, filters]

                fails = bits[:, None] >> np.arange(STEPS) & 1
                good, toxic = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                sums = [removed(n), removed(n * good), removed(n * toxic), by_filter(fails), by_filter(fails * (fails.sum(axis=1) == 1)[:, None])]
                sums.append(np.repeat(np.bincount(part, n, size)[:, None], len(filters), axis=1))
                yield pa.RecordBatch.from_pydict({
                    "part": parts.dictionary.take(pa.array(np.repeat(np.arange(size), len(filters)))), "cell": pa.array(np.tile(np.arange(len(filters), dtype=np.int32), size)),
                    **{name: pa.array(x.ravel().astype(np.int64)) for name, x in zip(CELLS, sums, strict=True)},
                })

    # all rows of a part, 128 at most, in one task: mostly one partial array for each
    return map_batches(counts.repartition("part"), run, "part string, cell int, " + ", ".join(f"{c} long" for c in CELLS))


def audit(counts: DataFrame) -> DataFrame:
    """The audit of ``counted`` documents: one row for every part, order and step.

    part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    sums = _cells(counts).groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in CELLS])
    orders = F.array(*[F.lit(o) for o in ORDERS])
    found = sums.withColumn("filter_order", F.get(orders, (F.col("cell") / STEPS).cast("int"))).withColumn("step", F.col("cell") % STEPS + 1)
    found = found.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("kept", F.col("documents") - F.sum("removed").over(so_far)).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return found.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
