"""Groups of documents whose word shingles have a Jaccard similarity of ``similarity`` or more.

The pipeline's near-duplicate stage. At a similarity of 0.8 over five-word shingles, 64-bit SimHashes differ by up to
about 14 bits (measured), a radius at which no partition of 64 bits selects anything. So candidates come from the
SimHash operator (fingerprints of these shingles that are linked) and, for what its radius can't reach, from equal bands
of min-wise sampled shingles: one-permutation MinHash, 16 bands of 4, which leaves out 2 in 10,000 pairs at 0.8. All
candidates are verified by their whole shingle sets (as 32-bit hashes).

Texts of the same words are one node. Nodes that share a band are compared with the least node of the band, and with
each other where the band holds at most ``SMALL`` nodes. Larger bands that are in one component by then are settled. Of
the others, nodes not yet connected are all compared, so every link is found: from each node on, those that it reaches
are found by inverted lists of shingles, and only what is still unreached is compared further (``spanning``). A band of
at most ``BLOCK_SHINGLES`` shingles is one task. The nodes of larger ones (many texts around one template) are first
parted by their rarest shingles: with all shingles in one order, those that are frequent among these nodes last, two
similar nodes have one in common among the first n - 0.8 n + 1 of each (prefix filter). So nodes meet where they share a
rare shingle; what they share with everybody brings nobody together. Where such a list is larger than a block still, it
is compared block by block, each pair of blocks in a task. Only edges that connect come out.

Null and empty texts are copies of each other. In ``groups``, rows that share an id are one document, and rows without an
id are in no group; ``kept_rows`` decides row by row. Empty tables give no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import free_name, map_batches, saved, ship
from .components import components

BINS, BANDS = 64, 16
SMALL = 8
#: Shingles of a block of nodes, in bands that have to be compared pair by pair; a larger node stands alone.
BLOCK_SHINGLES = 1_500_000
#: Shingles whose frequency among the nodes of large bands is broadcast, at most.
FREQUENT = 1_000_000
SEED = 42


def shingle_hashes(text: str | None, size: int) -> tuple[bytes, np.ndarray]:
    """The words in normal form, and the hashes of their shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return joined, np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return joined, np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands: the least hash of each of 64 ranges, empty ranges taking after the next, four by four."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    found = np.sort(hashes)
    bins = (found >> np.uint64(58)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    at = np.searchsorted(filled, np.arange(BINS)) % len(filled)
    away = (filled[at] - np.arange(BINS)) % BINS
    with np.errstate(over="ignore"):
        value = found[first][at] + away.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        weights = np.array([1, 0x100000001B3, 0x9E3779B97F4A7C15, 0x94D049BB133111EB], np.uint64)
        return (value.reshape(BANDS, -1) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, *, shingle: int, key: str, text: str) -> DataFrame:
    """Of every row: key, digest of its words, SimHash and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, prints, keys = [], [], []
            for t in batch.column(1):
                joined, hashes = shingle_hashes(t.as_py(), shingle)
                digests.append(xxhash.xxh3_128_digest(joined))
                prints.append(simhash.signed(simhash.majority(hashes)))
                keys.append(bands(hashes))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "digest": pa.array(digests, pa.binary()), "fp": pa.array(prints, pa.int64()), "bands": lists})

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"key {kind}, digest binary, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, *, shingle: int, key: str, text: str) -> DataFrame:
    """Of every row: key and its set of shingles, as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)[1].astype(np.uint32).view(np.int32)) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "shingles": lists})

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"key {kind}, shingles array<int>")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of nodes to be compared, u < v, from ``nodes`` (node, fp, bands); and the rows (band, value, node) of
    bands with more than ``SMALL`` nodes, of which the pairs hold the least node's only."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    groups = keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    shared = saved(keyed.join(groups, ["band", "value"]))
    stars = shared.filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    small = shared.filter(F.col("n") <= SMALL).select("band", "value", "node")
    other = small.select(F.col("band").alias("band2"), F.col("value").alias("value2"), F.col("node").alias("other"))
    each = small.join(other, (F.col("band") == F.col("band2")) & (F.col("value") == F.col("value2")) & (F.col("node") < F.col("other"))).select(F.col("node").alias("u"), F.col("other").alias("v"))
    prints = saved(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(prints, "fp").filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    linked = simhash.links(prints.select(F.col("least").alias("node"), "fp")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return stars.unionByName(each).unionByName(same).unionByName(linked).distinct(), shared.filter(F.col("n") > SMALL).select("band", "value", "node")


def spanning(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges between similar sets that connect, with equal labels as connections, all that similar pairs connect."""
    size = np.array([len(s) for s in sets])
    by_label = np.argsort(labels, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], labels[by_label][1:] != labels[by_label][:-1], [True]]))
    place = np.searchsorted(labels[by_label][bounds[:-1]], labels)
    mates = lambda node: by_label[bounds[place[node]] : bounds[place[node] + 1]]
    left, n_left, indexed, edges = np.ones(len(sets), bool), len(sets), np.zeros(0, np.int64), []
    lists, starts, owner = None, None, None
    for first in range(len(sets)):
        if not left[first]:
            continue
        queue = mates(first).tolist()
        left[queue] = False
        n_left -= len(queue)
        while queue and n_left:
            if lists is None or 2 * n_left <= len(indexed):  # inverted lists of what is unreached
                indexed = np.flatnonzero(left)
                values = np.concatenate([sets[i] for i in indexed])
                order = np.argsort(values, kind="stable")
                owner = np.repeat(indexed, size[indexed])[order]
                lists, starts = np.unique(values[order], return_index=True)
                starts = np.append(starts, len(values))
            node = queue.pop()
            at = np.searchsorted(lists, sets[node])
            at = at[(at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == sets[node])] if len(lists) else at[:0]
            n = starts[at + 1] - starts[at]
            inside = owner[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            others, common = np.unique(inside[left[inside]], return_counts=True)  # only nodes that share a shingle are looked at
            for other in others[common >= similarity * (size[node] + size[others] - common)].tolist():
                edges.append((node, other))
                if left[other]:
                    reached = mates(other)
                    left[reached] = False
                    n_left -= len(reached)
                    queue += reached.tolist()
    return edges


def by_rare_shingles(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(value, node, component, size): the nodes that share a shingle (``value``) of their prefixes, lists of one component left out.

    ``nodes``: node and component, distinct. Lists of the same nodes come once.
    """
    own = sets.withColumnRenamed("key", "node").join(nodes, "node")
    own = saved(own)
    counts = own.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    often = counts.filter(F.col("n") >= max(2, -(-total // FREQUENT))).collect()  # FREQUENT rows at most
    often.sort(key=lambda r: r.shingle)
    frequent = nodes.sparkSession.sparkContext.broadcast((np.array([r.shingle for r in often], np.int32), np.array([r.n for r in often], np.int64)))
    kind = own.schema["node"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = frequent.value
        for batch in batches:
            nodes, components, lists = batch.column(0), batch.column(1), batch.column(2)
            at, values, sizes = [], [], []
            for i in range(len(lists)):
                own = lists[i].values.to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                rank = np.where(known[place] == own, n[place], 0) if len(known) else np.zeros(len(own), np.int64)
                first = own[np.lexsort((own, rank))][: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]
                at += [i] * len(first)
                values.append(first)
                sizes += [len(own)] * len(first)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({"value": pa.array(np.concatenate(values) if values else [], pa.int64()), "node": nodes.take(took), "component": components.take(took), "size": pa.array(sizes, pa.int32())})

    entries = saved(map_batches(own.select("node", "component", "shingles"), prefixes, f"value long, node {kind}, component {kind}, size int"))
    lists = entries.groupBy("value").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = lists.filter("a <> b").groupBy("n", "x", "y").agg(F.min("value").alias("value")).select("value", "n")
    return entries.join(once, "value")


def connecting(hot: DataFrame, sets: DataFrame, known: DataFrame, similarity: float) -> DataFrame | None:
    """Edges (u, v) that connect the similar nodes of each band of ``hot`` which ``known`` (node, component) leaves apart."""
    named = saved(hot.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")))
    apart = named.groupBy("band", "value").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("band", "value")
    rows = saved(named.join(apart, ["band", "value"]).join(sets.select(F.col("key").alias("node"), F.size("shingles").alias("size")), "node"))
    if rows.isEmpty():
        return None
    room = rows.groupBy("band", "value").agg(F.sum(F.col("size").cast("long")).alias("total"))
    wide = saved(room.filter(F.col("total") > BLOCK_SHINGLES).select("band", "value"))
    pairs, kind = None, hot.schema["node"].dataType.simpleString()
    if not wide.isEmpty():
        lists = saved(by_rare_shingles(rows.join(wide, ["band", "value"]).select("node", "component").distinct(), sets, similarity))
        few = lists.filter(F.col("n") <= SMALL).select("value", "node", "component")
        other = few.select("value", F.col("node").alias("other"), F.col("component").alias("c"))
        pairs = few.join(other, "value").filter("node < other AND component <> c").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
        many = lists.filter(F.col("n") > SMALL).select(F.lit(-1).alias("band"), "value", "node", "component", "size")
        rows = saved(rows.join(wide, ["band", "value"], "left_anti").select(many.columns).unionByName(many))
        room = rows.groupBy("band", "value").agg(F.sum(F.col("size").cast("long")).alias("total"))
    rows = rows.join(room, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / BLOCK_SHINGLES)))
    rows = saved(rows.select("band", "value", "block", "node", "component"))
    others = rows.select("band", "value", F.col("block").alias("other")).distinct()
    tasks = rows.join(others, ["band", "value"]).select("band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component")
    tasks = tasks.join(sets.withColumnRenamed("key", "node"), "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, lists = group.column("node").combine_chunks(), group.column("shingles").combine_chunks()
        labels = group.column("component").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = np.array(spanning([lists[i].values.to_numpy(zero_copy_only=False) for i in range(len(lists))], labels, similarity), np.int64).reshape(-1, 2)
        return pa.table({"u": nodes.take(pa.array(edges[:, 0])), "v": nodes.take(pa.array(edges[:, 1]))})

    ship(hot.sparkSession)
    found = tasks.groupBy("band", "value", "i", "j").applyInArrow(run, f"u {kind}, v {kind}")
    return found if pairs is None else found.unionByName(verified(pairs, sets, similarity))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    a, b = (sets.select(F.col("key").alias(n), F.col("shingles").alias(s)) for n, s in (("u", "a"), ("v", "b")))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").filter(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component) of the documents that are not alone; the component is the group's smallest id."""
    found = saved(sketches(docs.filter(F.col(key).isNotNull()), shingle=shingle, key=key, text=text))
    nodes = saved(found.groupBy("digest").agg(F.min("key").alias("node"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    pairs, hot = candidates(nodes.select("node", "fp", "bands"))
    pairs = saved(pairs)
    asked = pairs.select(F.col("u").alias(key)).unionByName(pairs.select(F.col("v").alias(key))).distinct()
    sets = shingle_sets(docs.join(asked, key, "left_semi"), shingle=shingle, key=key, text=text).dropDuplicates(["key"])
    sets = saved(sets)
    near = verified(pairs, sets, similarity)
    copies = found.join(nodes.select("digest", "node"), "digest").filter("key <> node").select(F.col("node").alias("u"), F.col("key").alias("v"))
    known = components(near.unionByName(copies))
    more = connecting(hot, sets, known, similarity)
    if more is not None:
        known = components(known.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    return known.withColumnRenamed("node", key)


def kept_rows(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every group of near-duplicates among the rows of ``docs`` one row, with all columns.

    It is the one with the smallest id; rows without an id come after all, and rows that share an id go by a hash of
    their texts. Of rows that are equal in id and text, any one stays.
    """
    options = {"shingle": shingle, "similarity": similarity, "text": text}
    shared = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    if shared.isEmpty():
        others = groups(docs, key=key, **options).filter(F.col(key) != F.col("component")).select(key)
        return docs.join(others, key, "left_anti").select(docs.columns)
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), F.xxhash64(text).alias("hash")))
    others = saved(groups(rows, key=row, **options).filter(F.col(row) != F.col("component")).select(row))
    left = rows.join(others, row, "left_anti")
    repeated = saved(left.groupBy(row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(row))
    once = left.join(repeated, row, "left_semi").dropDuplicates([row])
    return left.join(repeated, row, "left_anti").unionByName(once).select(docs.columns)
