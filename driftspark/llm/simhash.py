"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's shingles (runs of ``shingle`` words, repeats included) are hashed by XXH64; a bit of the fingerprint is 1 if it
is set in over half of them. Texts with one fingerprint are one node, named by their smallest document id. Nodes at
``radius`` or fewer differing bits are linked, and connected nodes are a component.

Finding the links: the 64 bits are grouped into partitions of correlated bits (correlations are counted over all
nodes). By the generalised pigeonhole principle, two nodes within ``radius`` bits differ by at most t_i bits in some
partition i, for any thresholds with sum t_i = radius - partitions + 1 and t_i >= -1 (-1: never looked up). A dynamic
program chooses unequal thresholds by estimated candidate counts, for each number of partitions; the cheapest layout
wins. Each node is then stored under its own bits of each partition and looks up all values within t_i bits of them; the
candidates are verified on all bits inside the join.

Buckets of more than ``bucket`` nodes are never paired. Their nodes, and those that look them up, are keyed by every
value within radius // 2 bits instead: two nodes within an even radius share such a value (their midpoint), nodes that
share one are within it, and no value has more than 1 + 64 (radius 2) of them. They are linked to the least of each key,
which joins the same nodes. So neither groups of copies nor dense regions make pairs that grow with the square of their
size, and no link is lost.

Null and empty texts have fingerprint 0 and are linked like any other. Rows with one document id are one document in
components (its texts' nodes are joined through the id); rows with a null id keep their row and get the component of
their fingerprint. Repeated rows are reported each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches
from .components import components

BITS = 64
SEED = 42
BUCKET = 512


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 4096)):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text as an unsigned 64-bit integer."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(found) >= shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    return majority(hashes)


def fingerprints(docs: DataFrame, *, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "fp": pa.array(found.view(np.int64))})

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"key {kind}, fp long").withColumnRenamed("key", key)


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of nodes, and how many have both bits i and j set (64 x 64, whatever the number of nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        at = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(np.append(total.ravel(), n))})

    rows = map_batches(nodes.select("fp"), run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        found[r["at"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of (nearly) equal size; correlated ones together. Bit 0 is the highest."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(axis=1))))]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(corr[np.ix_(left, group)].mean(axis=1)))))
        out.append(sorted(group))
    return out


def estimates(n: int, both: np.ndarray, group: list[int], radius: int) -> list[float]:
    """The cost of looking up all values within t = -1, 0, ... radius bits: look-ups and expected candidates."""
    p = np.diag(both)[group] / max(1, n)
    differ = np.minimum(2 * p * (1 - p), 0.5)
    chance = np.zeros(radius + 1)  # of exactly so many differing bits
    chance[0] = 1
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    balls = np.cumsum([1.0] + [np.prod([(len(group) - i) / (i + 1) for i in range(t)]) for t in range(1, radius + 1)])
    return [0.0, *(float(n) * balls + float(n) ** 2 * np.cumsum(chance))]


def thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Per partition, the threshold (-1 to radius) of the cheapest choice with sum = radius - partitions + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by sum of (threshold + 1)
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, radius + 1):
                if (to := total + t + 1) <= radius + 1 and (to not in following or spent + cost[t + 1] < following[to][0]):
                    following[to] = (spent + cost[t + 1], [*chosen, t])
        best = following
    return best[radius + 1]


@dataclass(frozen=True)
class Layout:
    masks: list[int]
    flips: list[list[int]]
    cost: float


def layout(n: int, both: np.ndarray, radius: int) -> Layout:
    """The cheapest partitions and thresholds. ``flips``: what a look-up changes in the partition's bits."""
    options = []
    for parts in range(1, radius + 2):
        groups = group_bits(n, both, parts)
        cost, chosen = thresholds([estimates(n, both, g, radius) for g in groups], radius)
        options.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    cost, chosen = min(options, key=lambda o: o[0])
    value = lambda bits: sum(1 << (BITS - 1 - b) for b in bits)
    return Layout([value(g) for g, _ in chosen], [[value(c) for k in range(t + 1) for c in combinations(g, k)] for g, t in chosen], cost)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, *, radius: int = 2, bucket: int = BUCKET, plan: Layout | None = None) -> DataFrame:
    """Pairs (u, v) of node ids, from ``nodes`` (node, fp), whose transitive closure is that of all linked pairs."""
    if radius % 2:
        raise ValueError("radius must be even")
    plan = plan or layout(*bit_counts(nodes), radius)
    part = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(plan.masks)])
    stored = nodes.select("node", "fp", F.explode(part).alias("p")).select("node", "fp", "p.*")
    looked = stored
    if any(len(f) > 1 for f in plan.flips):
        flips = F.element_at(F.array(*[F.array(*[F.lit(signed(x)) for x in f]) for f in plan.flips]), F.col("part") + 1)
        looked = stored.select("node", "fp", "part", "bits", F.explode(flips).alias("flip")).withColumn("bits", F.col("bits").bitwiseXOR(F.col("flip"))).drop("flip")
    hot = stored.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("part", "bits")
    hot = checkpointed(hot)
    x = looked.join(hot, ["part", "bits"], "left_anti").select(F.col("node").alias("u"), F.col("fp").alias("x"), "part", "bits")
    y = stored.join(hot, ["part", "bits"], "left_anti").select(F.col("node").alias("v"), F.col("fp").alias("y"), F.col("part").alias("part2"), F.col("bits").alias("bits2"))
    near = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    pairs = x.join(y, (F.col("part") == F.col("part2")) & (F.col("bits") == F.col("bits2")) & near).select("u", "v")

    # nodes of large buckets, and those that look there
    dense = looked.join(hot, ["part", "bits"], "left_semi").select("node", "fp").distinct()
    flips = [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    keys = dense.select("node", F.explode(F.transform(F.array(*[F.lit(signed(f)) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))).alias("key"))
    stars = keys.groupBy("key").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    stars = stars.select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v")).filter("u <> v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, radius: int = 2, shingle: int = 3, bucket: int = BUCKET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component`` (the smallest key reachable) of each row of ``docs``."""
    found = checkpointed(fingerprints(docs, shingle=shingle, key=key, text=text).select(F.col(key).alias("key"), "fp"))
    nodes = found.filter("key IS NOT NULL").groupBy("fp").agg(F.min("key").alias("node"))
    nodes = checkpointed(nodes)
    same = found.join(nodes, "fp").filter("key <> node").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # ids with several texts
    edges = links(nodes.select("node", "fp"), radius=radius, bucket=bucket)
    edges = edges.unionByName(found.join(same, "key", "left_semi").join(nodes, "fp").select(F.col("key").alias("u"), F.col("node").alias("v")).filter("u <> v"))
    roots = components(edges)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return found.join(named, "fp", "left").select(F.col("key").alias(key), "fp", "component")
