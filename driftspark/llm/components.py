"""Connected components of an edge table by alternating stars, or in one task where the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import map_batches, saved

MAX_ROUNDS = 100
#: Distinct edges that one task settles: rounds of jobs cost the driver more memory and time than that.
ONE_TASK = 500_000


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, as (u, v) with u > v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of every node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return _oriented(both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of every node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _of_few(edges: DataFrame) -> DataFrame:
    """(node, component) of distinct oriented edges, in one task.

    The edges come by ``v`` in Spark's order and nodes are numbered as they come, so the least number of a component is
    that of its smallest node. Nodes of nested types are told apart by their JSON.
    """
    kind = edges.schema["u"].dataType
    nested = isinstance(kind, StructType | ArrayType | MapType)
    name = lambda c: F.to_json(F.struct(F.col(c).alias("n"))) if nested else F.col(c)
    rows = edges.select("u", "v", name("u").alias("ku"), name("v").alias("kv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        joined = lambda a, b: pa.concat_arrays([x.column(a) for x in batches] + [x.column(b) for x in batches])
        at = joined(3, 2).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        low, high = at[: len(at) // 2], at[len(at) // 2 :]
        nodes = joined(1, 0).take(pa.array(np.unique(at, return_index=True)[1]))
        root = np.arange(len(nodes))
        while (root[low] != root[high]).any():
            a, b = root[low], root[high]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes.take(pa.array(root))})

    return map_batches(rows.coalesce(1).sortWithinPartitions("v"), run, f"node {kind.simpleString()}, component {kind.simpleString()}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the edges stay the same: then each component
    is one star around its smallest node. Nothing is gathered per node, so hubs only make skewed joins, which adaptive
    execution splits; each round's edges are saved. Once there are at most ``ONE_TASK`` edges, one task settles them.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    current = saved(_oriented(edges))
    before = tuple(current.agg(mark.alias("m")).first().m)
    for _ in range(MAX_ROUNDS):
        if before[0] <= ONE_TASK:
            return saved(_of_few(current))
        current = saved(_small_star(_large_star(current)))
        now = tuple(current.agg(mark.alias("m")).first().m)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
