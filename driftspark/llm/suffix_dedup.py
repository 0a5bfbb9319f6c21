"""Exact substring de-duplication by suffix arrays of shards.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (in a document with a smaller id,
or earlier in the same document). All is judged on the input; matches never cross documents.

Sharding: the window of ``length`` bytes at each position has an anchor, the ``GRAM``-gram in it with the least hash
(the leftmost of equals). Neighbouring windows mostly share one, so a document falls into segments of windows with one
anchor, about one for every 40 bytes. Equal windows have equal anchors; a segment whose anchor no other segment has
holds no repeated window and is dropped. The others' bytes are cut out, and equal segments become one with their
first place. What is left is dealt to shards by anchor, so all places of a window meet in one shard.

In a shard, the segments' bytes form one text. Its suffix array is built by induced sorting (Nong, Zhang and Chan):
suffixes are classified by whether they are smaller than the next, the leftmost-smaller (LMS) substrings are sorted by
inducing and named, the names' string is sorted, and the order of all suffixes is induced from that of the LMS suffixes.
Inducing goes bucket by bucket, in whole arrays. The names' string has too many buckets for that; it is sorted by
doubling prefixes, to the depth that ``length`` bytes need. For each position, the common prefix with its predecessor in
the array is then compared in text order, as far as ``length`` bytes; runs of suffixes that reach it are the places of
one window, and the first place is the one that stays.

Segments that equal another one as a whole (by two 64-bit hashes) are settled beforehand by their first place, within a
batch of texts before anything is shuffled; only
anchors whose segments differ go to shards, each distinct segment once. An anchor with more than ``SHARD_BYTES`` of
distinct segments (a frequent phrase in ever new surroundings) is not put in one shard: its windows are grouped one by
one, by their bytes, which any number of tasks can share.

Every row has a result of its own. Null texts are empty. Texts shorter than ``length`` lose nothing. Ids may be of any
type that can be sorted; they decide the order alone. Rows that share an id are one document with several texts: a place
in one is earlier than a place in another if it starts earlier, and equal starts don't remove each other. Rows without
an id come last, each distinct text a document of its own, in the order of a hash of the texts; repeated ones, like all
repeated rows, get the same result each. Other columns are ignored; empty tables give empty tables.

Texts longer than ``PIECE_BYTES`` are searched for segments piece by piece (overlapping by ``length - 1`` bytes), so
memory doesn't grow with a text by more than its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, checkpointed, map_batches, saved, text_sizes, utf8

LENGTH = 100
GRAM = 32
SHARD_BYTES = 2 << 20
BATCH_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
#: Places of a batch or piece are numbered by so many bits; the other bits of a hash order grams.
PLACE_BITS = 24
#: Not in any UTF-8 text; stands between segments.
SEPARATOR = 0xFF


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse, modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each position, which depends on these bytes alone."""
    room = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = powers(room)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    n = len(data) - size + 1
    h = (total[size:] - total[:n]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` values in a row."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, hash of the bytes, first window, windows) of the segments of texts in a row."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = rolling(data, gram)
    at = np.arange(len(h), dtype=np.uint64)
    if len(h) >> PLACE_BITS:
        raise ValueError(f"texts in a row hold over {1 << PLACE_BITS} places")
    bits = np.uint64(PLACE_BITS)
    packed = (h >> bits << bits) | at  # ordered by the same bits of the hash in every batch, then the leftmost
    w = length - gram + 1
    anchor = (sliding_min(packed, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[doc + 1]
    new = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]))
    if not len(new):
        return none, none, none, none, none
    last = np.minimum(np.append(new[1:], len(anchor)), offsets[doc[new] + 1] - length + 1)
    n = last - new
    up, down = powers(1 << max(16, int(len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) ^ np.uint64(0xA5)) * up[: len(data)], out=total[1:])
    whole = (total[new + n + length - 1] - total[new]) * down[new]
    whole = (whole ^ (whole >> np.uint64(32)) ^ n.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return doc[new], h[anchor[new]].view(np.int64), (whole ^ (whole >> np.uint64(29))).view(np.int64), new - offsets[doc[new]], n


# ---- suffix array of one shard -------------------------------------------------------------------------------------


def _deal(text: np.ndarray, found: np.ndarray, at: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Puts positions, in order, at their buckets' next places (``at``), which move by ``step``."""
    chars = text[found]
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    first = np.searchsorted(sorted_chars, sorted_chars, side="left")
    sa[at[sorted_chars] + step * (np.arange(len(found)) - first)] = found[order]
    at += step * np.bincount(chars, minlength=len(at))


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the given order of the LMS suffixes induces.

    ``smaller``: whether a suffix is smaller than the next; ``starts`` and ``ends``: the buckets of characters. Every
    bucket is settled in whole arrays: first what larger-type suffixes induce, from the left, then smaller-type ones,
    from the right. Suffixes that a bucket induces in itself follow in further rounds.
    """
    n, buckets = len(text), len(starts)
    sa = np.full(n, -1, np.int64)
    own = [lms[text[lms] == c] for c in range(buckets)] if len(lms) < 64 else np.split(lms[np.argsort(text[lms], kind="stable")], np.cumsum(np.bincount(text[lms], minlength=buckets))[:-1])
    at = starts.copy()
    for c in range(buckets):
        if starts[c] == ends[c]:
            continue
        done = starts[c]
        while done < at[c]:  # larger-type suffixes of this bucket, as far as they are known
            queue, done = sa[done : at[c]].copy(), at[c]
            before = queue[queue > 0] - 1
            _deal(text, before[~smaller[before]], at, sa, 1)
        before = own[c][own[c] > 0] - 1
        _deal(text, before[~smaller[before]], at, sa, 1)
    left = at.copy()  # where each bucket's larger-type part ends
    at = ends - 1
    for c in range(buckets - 1, -1, -1):
        if starts[c] == ends[c]:
            continue
        done = ends[c] - 1
        while done > at[c]:  # smaller-type suffixes of this bucket, from the right
            queue, done = sa[at[c] + 1 : done + 1][::-1].copy(), at[c]
            before = queue[queue > 0] - 1
            _deal(text, before[smaller[before]], at, sa, -1)
        queue = sa[starts[c] : left[c]][::-1]
        before = queue[queue > 0] - 1
        _deal(text, before[smaller[before]], at, sa, -1)
    return sa


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string of names by their first ``depth`` names at least."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < depth and rank.max(initial=0) < len(rank):
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` (bytes) by their suffixes, which are compared by their first ``depth`` bytes at least."""
    if not len(data):
        return np.zeros(0, np.int64)
    text = np.append(data.astype(np.int64) + 1, 0)  # ends with a character that is smaller than all
    n = len(text)
    rise = np.sign(text[1:] - text[:-1])
    known = np.flatnonzero(rise)  # ends with n - 2: the last character is the least
    smaller = np.append(rise[known[np.searchsorted(known, np.arange(n - 1))]] > 0, True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=257)
    ends = np.cumsum(counts)
    starts = ends - counts

    # LMS substrings, sorted by inducing from any order, get names: equal ones the same
    sa = induce(text, smaller, lms, starts, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    is_lms[n - 1] = True
    lms = np.flatnonzero(is_lms)
    sa[0] = n - 1
    by_substring = sa[is_lms[sa]]
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[n - 1] = 1
    a, b = by_substring[:-1], by_substring[1:]
    same, offset, equal = np.flatnonzero(size[a] == size[b]), 0, np.zeros(len(a), bool)
    while len(same):
        same = same[text[a[same] + offset] == text[b[same] + offset]]
        offset += 1
        ended = size[a[same]] <= offset
        equal[same[ended]] = True
        same = same[~ended]
    name = np.zeros(n, np.int64)
    name[by_substring] = np.concatenate([[0], np.cumsum(~equal)])
    order = _doubled(name[lms], depth)
    sa = induce(text, smaller, lms[order], starts, ends)
    sa[0] = n - 1
    return sa[1:]


def reaches(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix array, whether its common prefix with the one before reaches ``length``.

    Compared by position (the predecessors permuted to text order), eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.full(8, SEPARATOR, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((before >= 0) & (np.maximum(np.arange(n), before) + length <= n))
    for offset in [*range(0, length - 7, 8), length - 8]:
        live = live[words[live + offset] == words[before[live] + offset]]
    permuted = np.zeros(n, bool)
    permuted[live] = True
    return permuted[sa]


def first_places(contents: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each content, the first place (document, position) of each of its windows among all of them.

    ``docs`` are numbers in the documents' order.
    """
    text = np.frombuffer(bytes([SEPARATOR]).join([*contents, b""]), np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    within = np.arange(len(text)) - begins[owner]
    sa = suffix_array(text, length)
    group = np.cumsum(~reaches(text, sa, length))
    is_window = within[sa] + length <= sizes[owner[sa]]
    at, group = sa[is_window], group[is_window]
    doc, pos = docs[owner[at]], starts[owner[at]] + within[at]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    repeat = np.diff(np.append(edges, len(group)))
    best_doc = np.repeat(np.minimum.reduceat(doc, edges), repeat)
    best_pos = np.repeat(np.minimum.reduceat(np.where(doc == best_doc, pos, np.iinfo(np.int64).max), edges), repeat)
    all_doc, all_pos = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    all_doc[at], all_pos[at] = best_doc, best_pos
    return [(all_doc[b : b + s - length + 1], all_pos[b : b + s - length + 1]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


# ---- the operator --------------------------------------------------------------------------------------------------

LAST = (1 << 63) - 1
#: Bytes of row numbers that are broadcast to pick documents before their texts are shuffled.
BROADCAST_BYTES = 16 << 20


def tie(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """What orders documents after ``doc``: the text's hash for rows without an id, nothing for the others."""
    return np.where(doc == LAST, row, 0)


def _tie() -> Column:
    return F.when(F.col("doc") == LAST, F.col("row")).otherwise(F.lit(0).cast("long"))


def settled(doc: np.ndarray, row: np.ndarray, key: np.ndarray, whole: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments another one of the batch equals at an earlier place, and at the same place of an equal row."""
    after = tie(doc, row)
    order = np.lexsort((row, start, after, doc, whole, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1])]) if len(order) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same_place = (doc[order] == doc[first]) & (after[order] == after[first]) & (start[order] == start[first])
    same_row = np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (row[order][1:] == row[order][:-1]) & (start[order][1:] == start[order][:-1])])[: len(order)] & ~new
    later, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order], again[order] = ~new & ~same_place, same_row
    return later, again


def all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, row, key, whole, start, n, settled) of every segment of ``docs`` (doc, row, text).

    Segments that an earlier one of the same batch equals are settled: all their windows start earlier. They get keys
    of their own, so that a line or phrase that a third of the documents repeat does not meet in one task; repeated rows
    come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in by_bytes(text_sizes(batch.column(2)), BATCH_BYTES):
                data, offsets = utf8(batch.column(2).slice(part.start, part.stop - part.start))
                for at in range(0, max(1, len(data) - length + 1), PIECE_BYTES):  # only a long text, alone in its part, has several
                    piece = data[at : at + PIECE_BYTES + length - 1]
                    doc, key, whole, start, n = segments(piece, offsets if len(data) == len(piece) else np.array([0, len(piece)]), length, gram)
                    doc, row, start = ids[part][doc], rows[part][doc], start + at
                    later, again = settled(doc, row, key, whole, start)
                    own = (doc.astype(np.uint64) * np.uint64(BASE) ^ row.astype(np.uint64) ^ start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                    columns = {"doc": doc, "row": row, "key": np.where(later, own, key), "whole": whole, "start": start.astype(np.int32), "n": n.astype(np.int32), "settled": later}
                    yield pa.RecordBatch.from_pydict({name: pa.array(x[~again]) for name, x in columns.items()})

    return map_batches(docs, run, "doc long, row long, key long, whole long, start int, n int, settled boolean")


def _picked(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """``docs`` joined to ``wanted`` (doc, row, ...), repeated rows once; where few are wanted, the others' texts are not shuffled."""
    ids = wanted.select("doc", "row").distinct()
    if ids.count() * 16 <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(ids), ["doc", "row"], "left_semi")
    return (docs.dropDuplicates(["doc", "row"]) if repeats else docs).join(wanted, ["doc", "row"])


def _cut(docs: DataFrame, segs: DataFrame, length: int, repeats: bool) -> DataFrame:
    """Adds their bytes (``content``) to segments (doc, row, key, whole, start, n)."""
    wanted = segs.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "whole", "start", "n")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, found = batch.column(2)[i].as_py().encode(), batch.column(3)[i].values
                columns = {name: found.field(j) for j, name in enumerate(("key", "whole", "start", "n"))}
                spans = zip(columns["start"].to_pylist(), columns["n"].to_pylist(), strict=True)
                content = pa.array([data[s : s + n + length - 1] for s, n in spans], pa.binary())
                own = {name: pa.array([batch.column(j)[i].as_py()] * len(content), pa.int64()) for j, name in enumerate(("doc", "row"))}
                yield pa.RecordBatch.from_pydict({**own, **columns, "content": content})

    return map_batches(_picked(docs, wanted, repeats).select("doc", "row", "text", "segs"), run, "doc long, row long, key long, whole long, start int, n int, content binary")


PLACES = "key long, whole long, docs array<long>, ties array<long>, positions array<int>"


def sharded(cut: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``PLACES``: the first place of each window of distinct segments, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            starts = np.array([r[4] for r in rows], np.int64)
            of_row = np.array([r[2:4] for r in rows], np.int64).reshape(-1, 2)
            of_row[:, 1] = tie(of_row[:, 0], of_row[:, 1])
            documents, numbers = np.unique(of_row, axis=0, return_inverse=True)  # in order
            places = first_places([r[5] for r in rows], numbers.ravel(), starts, length)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([r[0] for r in rows], pa.int64()), "whole": pa.array([r[1] for r in rows], pa.int64()),
                "docs": pa.array([documents[d, 0] for d, _ in places], pa.list_(pa.int64())), "ties": pa.array([documents[d, 1] for d, _ in places], pa.list_(pa.int64())),
                "positions": pa.array([p.astype(np.int32) for _, p in places], pa.list_(pa.int32())),
            })

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*columns, strict=True):
                if rows and held >= shard_bytes and row[0] != rows[-1][0]:  # anchors stay whole
                    yield from flush()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
        if rows:
            yield from flush()

    dealt = cut.select("key", "whole", "doc", "row", "start", "content").repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, run, PLACES)


def windowed(cut: DataFrame, length: int) -> DataFrame:
    """The same by grouping the windows one by one."""
    each = cut.select("key", "whole", "doc", _tie().alias("tie"), "start", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("off"))
    each = each.select("key", "whole", "off", "doc", "tie", (F.col("start") + F.col("off")).alias("pos"), F.expr(f"substring(content, off + 1, {length})").alias("window"))
    first = each.groupBy("window").agg(F.min(F.struct("doc", "tie", "pos")).alias("first"))
    placed = each.join(first, "window").groupBy("key", "whole").agg(F.sort_array(F.collect_list(F.struct("off", "first"))).alias("places"))
    return placed.select("key", "whole", *[F.transform("places", lambda p: p.first[field]).alias(to) for field, to in (("doc", "docs"), ("tie", "ties"), ("pos", "positions"))])  # noqa: B023


def removed_windows(docs: DataFrame, length: int, gram: int, shard_bytes: int, repeats: bool) -> DataFrame:
    """(doc, row, runs): the windows of each row of ``docs`` (doc, row, text) that also start earlier, as runs (first window, windows)."""
    segs = all_segments(docs, length, gram)
    same, anchored = Window.partitionBy("key", "whole"), Window.partitionBy("key")
    placed = segs.repartition("key").withColumn("first", F.min(F.struct("doc", _tie().alias("tie"), "start")).over(same))
    placed = placed.withColumn("mixed", (F.min("whole").over(anchored) != F.max("whole").over(anchored)) & ~F.col("settled"))
    # what is neither mixed nor later than an equal segment needs no look
    later = F.col("settled") | (F.struct("doc", _tie().alias("tie"), "start") != F.col("first"))
    found = saved(placed.withColumn("later", later).filter("mixed OR later").select("doc", "row", "key", "whole", "start", "n", "mixed", "later"))

    one = found.filter("mixed AND NOT later").select("doc", "row", "key", "whole", "start", "n").dropDuplicates(["key", "whole"])
    one = saved(one)
    large = checkpointed(one.groupBy("key").agg(F.sum(F.col("n") + (length - 1)).alias("b")).filter(F.col("b") > shard_bytes).select("key"))
    cut = saved(_cut(docs, one, length, repeats))
    places = sharded(cut.join(large, "key", "left_anti"), length, shard_bytes).unionByName(windowed(cut.join(large, "key", "left_semi"), length))
    # only windows that some other place precedes, or that stand in a segment that has a later equal, matter
    joined = found.filter("mixed").join(places, ["key", "whole"])
    gone = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.get("docs", i) != F.col("doc")) | (F.get("ties", i) != _tie()) | (F.get("positions", i) != F.col("start") + i))
    single = joined.select("doc", "row", F.transform(gone, lambda i: F.struct((F.col("start") + i).alias("start"), F.lit(1).alias("n"))).alias("runs")).filter(F.size("runs") > 0)
    whole = found.filter("NOT mixed").select("doc", "row", F.array(F.struct("start", "n")).alias("runs"))
    return whole.unionByName(single).groupBy("doc", "row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def covered(size: int, runs: np.ndarray, length: int) -> np.ndarray:
    """The maximal spans (start, end) of the bytes that the windows of the runs (first window, windows) cover."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    start = np.sort(runs[:, 0])
    end = np.maximum.accumulate((runs[:, 0] + runs[:, 1] + length - 1)[np.argsort(runs[:, 0], kind="stable")])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], np.minimum(end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)], size)], axis=1)


INTEGERS = ("byte", "short", "integer", "long")


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(id, doc, row, text) of every row, and whether ids may be missing or shared.

    ``doc`` is a number in the order of the ids, ``LAST`` without an id. ``row`` tells rows with one ``doc`` apart: the hash of the text, or 0 where every row has an id of its own. Ids that
    aren't integers are numbered by a distributed sort of the distinct ones.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    ids = rows.select("id")
    if docs.schema[key].dataType.typeName() in INTEGERS:
        rows = rows.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    else:
        in_order = ids.filter("id IS NOT NULL").distinct().repartitionByRange("id").sortWithinPartitions("id")
        in_order = saved(in_order.withColumn("doc", F.monotonically_increasing_id()))
        rows = rows.join(in_order, "id", "left").withColumn("doc", F.coalesce("doc", F.lit(LAST)))
    shared = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    repeats = not shared.isEmpty()
    return rows.select("id", "doc", (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("row"), "text"), repeats


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary)."""
    given, repeats = numbered(docs, key, text)
    lost = _lost(given, length, gram, shard_bytes, repeats)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    found = given.select("id", "doc", "row", size, "text").join(lost, ["doc", "row", "n_bytes"], "left")
    kept = F.coalesce("kept", F.encode("text", "UTF-8"))
    return found.select(F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), kept.alias("kept"))


def _lost(given: DataFrame, length: int, gram: int, shard_bytes: int, repeats: bool) -> DataFrame:
    """Of the distinct rows of ``given`` (doc, row, text) that lose bytes: doc, row, n_bytes, n_removed, n_spans, kept."""
    long = given.filter(F.octet_length("text") >= length).select("doc", "row", "text")
    runs = saved(removed_windows(long, length, gram, shard_bytes, repeats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for t, found in zip(batch.column(2), batch.column(3), strict=True):
                data = t.as_py().encode()
                own = found.values
                spans = covered(len(data), np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], axis=1).astype(np.int64), length)
                edges = [0, *spans.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for name, value in zip(out, (len(data), len(data) - len(kept), len(spans), kept), strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "row": batch.column(1)} | {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return map_batches(_picked(long, runs, repeats).select("doc", "row", "text", "runs"), run, "doc long, row long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: bytes, removed bytes, spans and the SHA-256 of what is left."""
    given, repeats = numbered(docs, key, text)
    lost = saved(_lost(given, length, gram, shard_bytes, repeats).select("doc", "row", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")))
    given = given.select("id", "doc", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha"))
    return given.join(lost, ["doc", "row", "n_bytes"], "left").select(
        F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "all_sha").alias("kept_sha256")
    )
