"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import checkpointed, shared_folder
from ..shipping import ship

__all__ = ["by_bytes", "checkpointed", "free_name", "held_out", "map_batches", "remove_saved", "saved", "shared_folder", "ship", "spread_join", "table", "text_sizes", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder, and read again: a checkpoint for large results.

    The tables stay until ``remove_saved``, as results that aren't yet computed may read them.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def remove_saved(spark: SparkSession) -> None:
    """Deletes all that this application has ``saved``; to be called when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bound on the keys that ``spread_join`` broadcasts.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """``rows`` left-joined to ``facts``, which have one row a key, without a task that gets all rows of a frequent key.

    Keys of more than one in ``HOT_KEYS`` rows, of which there are fewer than ``HOT_KEYS``, are joined by broadcast; rows
    without a key join nothing and stay where they are. ``rows`` are read several times: give a saved table.
    """
    total, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col(on).isNull())).first()
    hot = rows.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > max(1, total // HOT_KEYS)).select(on)
    hot = checkpointed(hot)
    given = rows.filter(F.col(on).isNotNull()) if nulls else rows
    found = given.join(F.broadcast(hot), on, "left_anti").join(facts, on, "left")
    found = found.unionByName(given.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(facts.join(F.broadcast(hot), on, "left_semi")), on, "left"))
    if nulls:
        found = found.unionByName(rows.filter(F.col(on).isNull()), allowMissingColumns=True)
    return found


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def by_bytes(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` bytes each; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_sizes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the offsets of the texts (null: empty)."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
