"""Exact de-duplication of passages by prefix-partitioned suffix trees over words.

Words are maximal runs without blanks (``[^\\x20\\x09-\\x0D]+``), unchanged. A window is ``LENGTH`` consecutive words of one
document. A word is removed if a window that covers it also starts in a document with a smaller id; windows are judged on
the input, not on what is left.

A suffix starts at each window. Suffixes are split into groups by prefixes of variable length. The first prefix of a
suffix runs up to the end of its anchor: the ``GRAM``-gram of the window with the least hash, the leftmost of equals. It
has ``GRAM`` to ``LENGTH`` words and depends on the window's words alone, so equal windows have equal prefixes; and the
suffixes of neighbouring windows mostly have one anchor, so all suffixes whose prefixes end with the same gram go to one
group as a segment of consecutive words, about two for every ``LENGTH`` words, instead of ``LENGTH`` words each. An
anchor with more than ``GROUP_BYTES`` of distinct segments is split: its suffixes are dealt one by one by their first
words, by ever longer prefixes (``PREFIXES``) as long as a prefix has more than a group holds. Whole windows that are
still too many are one node by themselves, which an aggregation settles.

A group's subtree is built top-down and breadth-first: an edge grows by a word as long as all its suffixes agree, and a
node's suffixes are split by the next word where they don't. Branches whose suffixes come from a single document are cut
off at once. The internal nodes that reach ``LENGTH`` words are the repeats; runs of neighbouring ones are the maximal
repeats. The smallest id below such a node is the document that keeps the window.

Segments that only one document has, or whose anchor does, are dropped before any words are shuffled. Segments that equal
another one as a whole (by two 64-bit hashes) are settled by its smallest id: within a batch of texts before anything is
shuffled, so that a passage that a third of the documents share does not meet in one task. Subtrees see each distinct
segment once.

Every row has a result. Null texts have no words; texts of fewer than ``LENGTH`` words lose nothing. Ids may be of any type
that can be sorted. Rows that share an id are one document with several texts and remove nothing from each other; repeated
rows get the same result each. A row without an id is neither smaller nor larger than any other: it loses and removes
nothing. Other columns are ignored; empty tables give empty tables. Texts longer than ``PIECE_BYTES`` are searched for
segments piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, checkpointed, map_batches, saved, spread_join, text_sizes, utf8
from .suffix_dedup import BASE, _picked, numbered, powers, segments

LENGTH = 50
GRAM = 8
GROUP_BYTES = 2 << 20
BATCH_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
#: Words of the longer prefixes that split large anchors; the last resort is the whole window.
PREFIXES = (16, 32)


# ---- words ---------------------------------------------------------------------------------------------------------


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts in a row (cut at ``offsets``) start and end, in bytes."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.concatenate([[False], solid[:-1]])[: len(data)], np.concatenate([solid[1:], [False]])[: len(data)]
    return np.flatnonzero(solid & (~before | cut[:-1])), np.flatnonzero(solid & (~after | cut[1:])) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes alone."""
    up, down = powers(1 << max(16, int(len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts in a row, and the offsets of the texts in words."""
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets, side="left")


def pieces(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """The words' hashes of one long text in pieces that overlap by ``length - 1`` words, and the number of each piece's first word."""
    tail, at, first = np.zeros(0, np.uint64), 0, 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        own, _ = hashed_words(data[at:end], np.array([0, min(end, len(data)) - at]))
        own = np.concatenate([tail, own])
        yield own, first
        tail, first, at = own[max(0, len(own) - length + 1) :], first + max(0, len(own) - length + 1), end


# ---- the subtree of one group ----------------------------------------------------------------------------------------


def first_documents(words: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (its first word at ``at``, in document ``doc``), the smallest document below its node of depth ``length``.

    A suffix that no other document shares has its own.
    """
    first = doc.copy()
    live, start = np.arange(len(at)), np.zeros(1, np.int64)  # suffixes by node, and where each node begins
    for depth in range(length):
        if not len(live):
            break
        word = words[at[live] + depth]
        size = np.diff(np.append(start, len(live)))
        if depth and (word == np.repeat(word[start], size)).all():
            continue  # every edge grows
        node = np.repeat(np.arange(len(start)), size)
        order = np.lexsort((word, node))
        live, word, node = live[order], word[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (word[1:] != word[:-1])]))
        shared = np.minimum.reduceat(doc[live], start) != np.maximum.reduceat(doc[live], start)
        size = np.diff(np.append(start, len(live)))[shared]
        live = live[np.repeat(shared, np.diff(np.append(start, len(live))))]
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(size)]
    if len(live):
        first[live] = np.repeat(np.minimum.reduceat(doc[live], start), np.diff(np.append(start, len(live))))
    return first


def repeated_windows(contents: list[bytes], docs: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows also start in a segment of a smaller document."""
    words = [c.split() for c in contents]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = pa.array([w for found in words for w in found], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc = np.repeat(np.array(docs, np.int64), n)
    gone = first_documents(codes, np.repeat(begin, n) + within, doc, length) < doc
    return [within[a : a + k][gone[a : a + k]] for a, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True)]


# ---- the operator --------------------------------------------------------------------------------------------------


def settled(doc: np.ndarray, key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which segments equal one of a smaller document of the batch."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort((doc, whole, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[first]
    return later


def all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, row, key, whole, start, n, settled) of every segment of ``docs`` (doc, row, text), in words.

    Settled ones, whose windows all start in a smaller document, get keys of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in by_bytes(text_sizes(batch.column(2)), BATCH_BYTES):
                data, offsets = utf8(batch.column(2).slice(part.start, part.stop - part.start))
                if part.stop - part.start == 1:
                    found = ((h, np.array([0, len(h)]), first) for h, first in pieces(data, length))
                else:
                    found = ((*hashed_words(data, offsets), 0) for _ in range(1))
                for hashes, bounds, first in found:
                    doc, key, whole, start, n = segments(hashes, bounds, length, gram)
                    doc, row, start = ids[part][doc], rows[part][doc], start + first
                    later = settled(doc, key, whole)
                    own = (doc.astype(np.uint64) * np.uint64(BASE) ^ row.astype(np.uint64) ^ start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"doc": doc, "row": row, "key": np.where(later, own, key), "whole": whole, "start": start.astype(np.int32), "n": n.astype(np.int32), "settled": later})

    return map_batches(docs, run, "doc long, row long, key long, whole long, start int, n int, settled boolean")


def _cut(docs: DataFrame, segs: DataFrame, length: int, repeats: bool) -> DataFrame:
    """The distinct segments (key, whole, off, doc) with their words (``content``)."""
    wanted = segs.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "whole", "start", "n")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, found = batch.column(1)[i].as_py().encode(), batch.column(2)[i].values
                starts, ends = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                first, n = found.field(2).to_numpy(), found.field(3).to_numpy()
                spans = zip(starts[first].tolist(), ends[first + n + (length - 2)].tolist(), strict=True)
                content = pa.array([data[a:b] for a, b in spans], pa.binary())
                own = pa.array([batch.column(0)[i].as_py()] * len(content), pa.int64())
                yield pa.RecordBatch.from_pydict({"key": found.field(0), "whole": found.field(1), "off": pa.array(np.zeros(len(content), np.int32)), "doc": own, "content": content})

    return map_batches(_picked(docs, wanted, repeats).select("doc", "text", "segs"), run, "key long, whole long, off int, doc long, content binary")


def subtrees(cut: DataFrame, group: str, length: int, group_bytes: int) -> DataFrame:
    """(key, whole, gone): the windows of each segment that a subtree finds in a smaller document.

    ``cut`` has key, whole, off (what the numbers of a segment's windows start from), doc, content; ``group`` holds the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            gone = repeated_windows([r[5] for r in rows], [r[4] for r in rows], length)
            some = [(r[1], r[2], (g + r[3]).astype(np.int32)) for r, g in zip(rows, gone, strict=True) if len(g)]
            kinds = {"key": pa.int64(), "whole": pa.int64(), "gone": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({name: pa.array([s[i] for s in some], kind) for i, (name, kind) in enumerate(kinds.items())})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*columns, strict=True):
                if rows and held >= group_bytes and row[0] != rows[-1][0]:  # prefixes stay whole
                    yield from flush()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
        if rows:
            yield from flush()

    dealt = cut.select(F.col(group).alias("prefix"), "key", "whole", "off", "doc", "content").repartition("prefix").sortWithinPartitions("prefix")
    return map_batches(dealt, run, "key long, whole long, gone array<int>")


def split(cut: DataFrame, length: int, group_bytes: int, prefixes: tuple[int, ...]) -> DataFrame:
    """(key, whole, gone) of segments whose anchors are too large for a group: their suffixes dealt by longer prefixes."""
    words = F.split(F.trim(F.regexp_replace(F.col("content").cast("string"), r"[\x20\x09-\x0D]+", " ")), " ")
    each = cut.select("key", "whole", "doc", words.alias("words"))
    rest = each.select("key", "whole", "doc", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - (length - 1)), lambda i: F.slice("words", i, length))).alias("off", "words"))
    rest = saved(rest.withColumn("content", F.encode(F.array_join("words", " "), "UTF-8")))
    found = []
    for size in prefixes:
        rest = rest.withColumn("prefix", F.xxhash64(F.slice("words", 1, size)))
        large = checkpointed(rest.groupBy("prefix").agg(F.sum(F.octet_length("content")).alias("b")).filter(F.col("b") > group_bytes).select("prefix"))
        found.append(subtrees(rest.join(large, "prefix", "left_anti"), "prefix", length, group_bytes))
        rest = rest.join(large, "prefix", "left_semi")
    rest = saved(rest.select("key", "whole", "off", "doc", "content"))
    nodes = spread_join(rest, rest.groupBy("content").agg(F.min("doc").alias("first")), "content")
    out = nodes.filter("doc > first").select("key", "whole", F.array("off").alias("gone"))
    for more in found:
        out = out.unionByName(more)
    return out


def repeated(docs: DataFrame, repeats: bool, *, length: int, gram: int, group_bytes: int, prefixes: tuple[int, ...]) -> DataFrame:
    """(doc, row, runs): the windows of each row of ``docs`` (doc, row, text) that also start in a smaller document, as runs (first window, windows)."""
    segs = all_segments(docs, length, gram)
    same, anchored = Window.partitionBy("key", "whole"), Window.partitionBy("key")
    differ = lambda c: F.min(c).over(anchored) != F.max(c).over(anchored)
    placed = segs.repartition("key").withColumn("later", F.col("settled") | (F.col("doc") > F.min("doc").over(same)))
    placed = placed.withColumn("mixed", differ("whole") & differ("doc") & ~F.col("settled"))
    found = saved(placed.filter("mixed OR later").select("doc", "row", "key", "whole", "start", "n", "mixed", "later"))

    kept = found.filter("mixed AND NOT later").select("doc", "row", "key", "whole", "start", "n")
    one = saved(kept.dropDuplicates(["key", "whole"]))
    cut = saved(_cut(docs, one, length, repeats))
    large = checkpointed(cut.groupBy("key").agg(F.sum(F.octet_length("content")).alias("b")).filter(F.col("b") > group_bytes).select("key"))
    gone = subtrees(cut.join(large, "key", "left_anti"), "key", length, group_bytes)
    if not large.isEmpty():
        gone = gone.unionByName(split(cut.join(large, "key", "left_semi"), length, group_bytes, prefixes))
    run = lambda w, start, n: F.struct((start + w).cast("int").alias("start"), n.cast("int").alias("n"))
    single = kept.join(gone, ["key", "whole"]).select("doc", "row", F.transform("gone", lambda w: run(w, F.col("start"), F.lit(1))).alias("runs"))
    whole = found.filter("later").select("doc", "row", F.array(run(F.lit(0), F.col("start"), F.col("n"))).alias("runs"))
    return whole.unionByName(single).groupBy("doc", "row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def removed_words(size: int, runs: np.ndarray, length: int) -> np.ndarray:
    """A mask of the words that the windows of the runs (first window, windows) cover."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, np.minimum(runs[:, 0] + runs[:, 1] + length - 1, size), -1)
    return np.cumsum(change)[:size] > 0


def _lost(given: DataFrame, length: int, gram: int, group_bytes: int, prefixes: tuple[int, ...], repeats: bool, digest: bool) -> DataFrame:
    """Of the distinct rows of ``given`` (id, doc, row, text) that lose words: doc, row, n_removed, spans, kept (with ``digest``: its SHA-256)."""
    long = given.filter(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * length - 1)).select("doc", "row", "text")
    runs = saved(repeated(long, repeats, length=length, gram=gram, group_bytes=group_bytes, prefixes=prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "spans": [], "kept": []}
            for t, found in zip(batch.column(2), batch.column(3), strict=True):
                words, own = t.as_py().encode().split(), found.values
                gone = removed_words(len(words), np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], axis=1).astype(np.int64), length)
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = [{"start": a, "n": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                for name, value in zip(out, (int(gone.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "row": batch.column(1)} | {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return map_batches(_picked(long, runs, repeats).select("doc", "row", "text", "runs"), run, "doc long, row long, n_removed long, spans array<struct<start:int,n:int>>, kept string")


def _measured(given: DataFrame, digest: bool) -> DataFrame:
    """(id, doc, row, n_words, all_words) of every row; with ``digest``, the words' SHA-256 instead of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, joined = [], []
            for t in batch.column(3):
                words = t.as_py().encode().split()
                n.append(len(words))
                joined.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else b" ".join(words).decode())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "doc": batch.column(1), "row": batch.column(2), "n_words": pa.array(n, pa.int64()), "all_words": pa.array(joined, pa.string())})

    kind = given.schema["id"].dataType.simpleString()
    return map_batches(given.select("id", "doc", "row", "text"), run, f"id {kind}, doc long, row long, n_words long, all_words string")


def _result(docs: DataFrame, key: str, text: str, length: int, gram: int, group_bytes: int, prefixes: tuple[int, ...], digest: bool) -> DataFrame:
    given, repeats = numbered(docs, key, text)
    lost = saved(_lost(given, length, gram, group_bytes, prefixes, repeats, digest))
    found = _measured(given, digest).join(lost, ["doc", "row"], "left")
    own = lambda c, other: F.when(F.col("id").isNotNull() & F.col("n_removed").isNotNull(), F.col(c)).otherwise(other)
    none = F.array().cast("array<struct<start:int,n:int>>")
    return found.select(F.col("id").alias(key), "n_words", own("n_removed", F.lit(0)).alias("n_removed"), own("spans", none).alias("spans"), _as_kept(own("kept", F.col("all_words")), digest))


def _as_kept(kept: Column, digest: bool) -> Column:
    return kept.alias("kept_sha256" if digest else "kept")


def remove_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``n_removed``, ``spans`` (removed runs: first word, words) and ``kept``, the words that are left, joined by blanks."""
    return _result(docs, key, text, length, gram, group_bytes, prefixes, False)


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """The same with the SHA-256 of what is left (``kept_sha256``)."""
    return _result(docs, key, text, length, gram, group_bytes, prefixes, True).select(key, "n_words", "n_removed", "kept_sha256")
