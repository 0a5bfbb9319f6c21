"""Whole-graph measures of graphs of any size as rounds of joins: weak and strong components, cycles, directed diameter.

``vertices`` has repo_id, seq, file_path; ``edges`` repo_id, seq, src, dst. All snapshots' graphs are measured at once, as
one graph whose vertices are numbered 0, 1, ... in the order of repository, snapshot and path. No snapshot is ever
collected in one task; what leaves the JVM is single strong components, to have their cycles enumerated.

Weak components: every vertex links its neighbours to the least one it knows (large and small stars), until the stars
stand still. Strong components: vertices that nothing enters or nothing leaves are trimmed; then the largest number is
carried forward along edges, and what its vertex is reached from within that colour is its component; the rest goes on.
Diameter: each vertex has the set of the sources that reach it, and takes what has grown from its neighbours; the last round
in which a set grows is the answer. The sets of all sources together would be as many bits as pairs of vertices, and each
round would send them along each edge. So a task has a block of sources, with bitmaps of all vertices of their snapshot for
them (``BLOCK_BYTES``, and as much for the next round), and reads the edges, which it doesn't keep, from the shared
folder in each round. Time goes with vertices times edges, divided by the bits of a word; memory and disk don't.

Each round is one join with the edges and an aggregation, kept as a table. The rounds are as many as the longest path that a
round has to follow. Trimming ends when it takes less than ``TRIMMED`` of the edges; what is left of all graphs goes to one
task if it has at most ``ONE_TASK`` edges, and colours take over otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved, saved_path
from ..shipping import ship
from ..sources.snapshots import opened

SNAPSHOT = ["repo_id", "seq"]
#: Trimming goes on as long as a round takes this share of the edges.
TRIMMED = 0.05
#: Edges that are left of all graphs, of which one task finds the strong components: thirty rounds of jobs cost more than that.
ONE_TASK = 500_000
#: Of a block of sources: its bitmaps, unless they have 64 bits, and its sources; neighbours that are looked at together.
BLOCK_BYTES = 128 << 20
BLOCK_BITS = 4096
NEAR = 64


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``v``: 0, 1, ... in the given order, by a distributed sort and the sizes of its partitions."""
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    within = (1 << 33) - 1  # the id's lower bits count the rows of a partition
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    offset, offsets = 0, []
    for part_id, n in sorted((r.part, r.n) for r in sizes):
        offsets.append((part_id, offset))
        offset += n
    known = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(known), "part").withColumn("v", F.col("before") + F.col("at").bitwiseAND(within)).drop("part", "at", "before")


def as_numbers(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, links): repo_id, seq, file_path, v; and the distinct edges between different vertices as a, b."""
    names = saved(numbered(vertices.select(*SNAPSHOT, "file_path").distinct(), *SNAPSHOT, "file_path"))
    side = lambda c, to: names.select(*SNAPSHOT, F.col("file_path").alias(c), F.col("v").alias(to))
    links = edges.join(side("src", "a"), [*SNAPSHOT, "src"]).join(side("dst", "b"), [*SNAPSHOT, "dst"]).select("a", "b")
    return names, saved(links.filter("a <> b").distinct())


def weak_components(links: DataFrame) -> DataFrame:
    """(v, component) of the vertices with edges; the component is its least vertex."""
    stars = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = saved(small.distinct())
        if _same(after, stars):
            break
        stars = after
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots.select("v", F.col("v").alias("component")))


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct pairs are equal, by count and an order-free hash of 128 bits."""
    digest = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return digest(a) == digest(b)


def trimmed(links: DataFrame) -> DataFrame:
    """The edges without those whose source nothing enters or whose target nothing leaves, again and again."""
    n = links.count()
    while n > ONE_TASK:
        inner = links.select(F.col("b").alias("v")).distinct().join(links.select(F.col("a").alias("v")).distinct(), "v", "left_semi")
        links = saved(links.join(inner.withColumnRenamed("v", "a"), "a", "left_semi").join(inner.withColumnRenamed("v", "b"), "b", "left_semi"))
        before, n = n, links.count()
        if before - n < TRIMMED * before:
            break
    return links


def strong_components(links: DataFrame) -> DataFrame:
    """(v, component) of the vertices that lie on cycles; the component is its greatest vertex."""
    from .graph import strong_components as of_one_task

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        follow: dict = {}
        for batch in batches:
            for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True):
                follow.setdefault(a, set()).add(b)
                follow.setdefault(b, set())
        rows = [(v, max(part)) for part in of_one_task(follow) if len(part) > 1 for v in part]
        yield pd.DataFrame(rows, columns=["v", "c"], dtype="int64")

    found, left = None, trimmed(links)
    while (n := left.count()) > 0:
        if n <= ONE_TASK:
            ship(links.sparkSession)
            own = saved(left.repartition(1).mapInPandas(rest, "v long, c long"))
            found = own if found is None else saved(found.unionByName(own))
            break
        colour = saved(left.select(F.col("a").alias("v")).union(left.select("b")).distinct().withColumn("c", F.col("v")).withColumn("grown", F.lit(True)))
        while True:  # the greatest vertex that reaches each
            given = colour.filter("grown").join(left, F.col("v") == F.col("a")).groupBy(F.col("b").alias("v")).agg(F.max("c").alias("more"))
            after = colour.join(given, "v", "left").select("v", F.greatest("c", "more").alias("c"), F.coalesce(F.col("more") > F.col("c"), F.lit(False)).alias("grown"))
            colour = saved(after)
            if colour.filter("grown").isEmpty():
                break
        colours = colour.select("v", "c")
        inside = left.join(colours.withColumnRenamed("v", "a"), "a").join(colours.select(F.col("v").alias("b"), F.col("c").alias("d")), "b").filter("c = d").select("a", "b", "c")
        inside = saved(inside)
        own = fresh = saved(colours.filter("v = c"))
        while True:  # back from each colour's vertex, within the colour
            fresh = inside.join(fresh.select(F.col("v").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("v"), "c").distinct().join(own, ["v", "c"], "left_anti")
            fresh = saved(fresh)
            if fresh.isEmpty():
                break
            own = saved(own.unionByName(fresh))
        found = own if found is None else saved(found.unionByName(own))
        done = own.select("v")
        left = trimmed(saved(left.join(done.withColumnRenamed("v", "a"), "a", "left_anti").join(done.withColumnRenamed("v", "b"), "b", "left_anti")))
    if found is None:
        return links.sparkSession.createDataFrame([], "v long, component long")
    several = found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")
    return found.join(several, "c", "left_semi").select("v", F.col("c").alias("component"))


def cycles_of_components(links: DataFrame, cap: int | None) -> DataFrame:
    """(component, cycles): the elementary cycles of each strong component, at most ``cap``; each component is a group of its own."""
    from .graph import cycle_count

    parts = saved(strong_components(links))
    inside = links.join(parts.withColumnRenamed("v", "a"), "a").join(parts.select(F.col("v").alias("b"), F.col("component").alias("other")), "b").filter("component = other").select("component", "a", "b")

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": [key[0]], "cycles": [cycle_count(list(zip(rows.a.tolist(), rows.b.tolist(), strict=True)), cap)[0]]})

    ship(links.sparkSession)
    return inside.groupBy("component").applyInPandas(count, "component long, cycles long")


def farthest(names: DataFrame, links: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(repo_id, seq, round): for each block of sources of a snapshot, the last round in which the set of them that reach a vertex grew."""
    spans = names.groupBy(*SNAPSHOT).agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("n"))  # a snapshot's numbers are consecutive
    into = links.join(names.select(*SNAPSHOT, F.col("v").alias("b")).join(spans, SNAPSHOT).select("b", "first"), "b")
    local = into.groupBy("b").agg(F.array_sort(F.collect_list((F.col("a") - F.col("first")).cast("int"))).alias("sources"))
    path = saved_path(local.repartitionByRange("b").sortWithinPartitions("b"))
    size = F.greatest(F.lit(64), F.least(F.lit(BLOCK_BITS), F.floor(F.lit(8 * block_bytes) / F.col("n") / 64) * 64)).cast("long")
    blocks = spans.withColumn("size", size).withColumn("at", F.explode(F.expr("sequence(0L, n - 1, size)")))
    blocks = blocks.select(*SNAPSHOT, "first", "n", "at", F.least("size", F.col("n") - F.col("at")).alias("size"))
    blocks = blocks.repartition(max(1, min(blocks.count(), links.sparkSession.sparkContext.defaultParallelism * 16)), *SNAPSHOT, "at")

    def edges(first: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of the snapshot's vertices that edges enter: their numbers, and where whose sources lie in the last array."""
        system, root = opened(path)
        own = (dataset.field("b") >= first) & (dataset.field("b") < first + n)
        for batch in dataset.dataset(root, filesystem=system, format="parquet").to_batches(filter=own, batch_size=1024, batch_readahead=1, fragment_readahead=1, use_threads=False):
            sources = batch.column("sources")
            yield batch.column("b").to_numpy() - first, sources.offsets.to_numpy(), sources.values.to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last = [_last_growth(lambda r=r: edges(r.first, r.n), r.n, r.at, r.size) for r in batch.itertuples()]
            yield batch[SNAPSHOT].assign(round=last)

    ship(links.sparkSession)
    return blocks.mapInPandas(run, "repo_id string, seq long, round long")


def _last_growth(edges: Callable[[], Iterator[tuple]], n: int, at: int, size: int) -> int:
    """The last round in which a vertex is first reached from one of the sources ``at``, ``at + 1``, ...; 0 if none is.

    A row has a bit for each source that is known to reach the vertex. Vertices that have all bits that any vertex was ever
    given are left alone, and others look at their neighbours only until they have.
    """
    bit = np.arange(size)
    state = np.zeros((n, (size + 63) // 64), np.uint64)
    state[at + bit, bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
    grown, given = np.zeros(n, bool), np.zeros(state.shape[1], np.uint64)
    grown[at : at + size] = True
    step = 0
    while True:
        after, more, every = state.copy(), np.zeros(n, bool), given.copy()
        for into, offsets, sources in edges():
            for b, start, end in zip(into.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                row = after[b]
                if step and not (every & ~row).any():
                    continue
                near = sources[start:end]
                near = near[grown[near]]
                for i in range(0, len(near), NEAR):
                    row |= np.bitwise_or.reduce(state[near[i : i + NEAR]], axis=0)
                    if step and not (every & ~row).any():
                        break
                if not step and len(near):
                    given |= row & ~state[b]
                more[b] = len(near) > 0 and (row != state[b]).any()
        if not more.any():
            return step
        step, state, grown = step + 1, after, more


def _per_snapshot(names: DataFrame, values: DataFrame, *aggregates) -> DataFrame:
    return names.join(values, "v", "left").groupBy(*SNAPSHOT).agg(*aggregates)


def component_counts(names: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, seq, component_count): weak components, lone vertices included."""
    is_root = F.col("component").isNull() | (F.col("component") == F.col("v"))
    return _per_snapshot(names, weak_components(links), F.count_if(is_root).alias("component_count"))


def depths(names: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, seq, max_depth): the longest of all finite shortest directed paths; 0 without edges."""
    return farthest(names, links).groupBy(*SNAPSHOT).agg(F.max("round").alias("max_depth"))


def cycle_counts(names: DataFrame, links: DataFrame, cap: int | None) -> DataFrame:
    """(repo_id, seq, cycle_count, cycle_count_capped): elementary cycles, and whether counting stopped at ``cap``."""
    found = cycles_of_components(links, cap).withColumnRenamed("component", "v")
    n = F.coalesce(F.sum("cycles"), F.lit(0))
    if cap is None:
        return _per_snapshot(names, found, n.alias("cycle_count"), F.lit(False).alias("cycle_count_capped"))
    return _per_snapshot(names, found, F.least(n, F.lit(cap)).alias("cycle_count"), (n >= cap).alias("cycle_count_capped"))
