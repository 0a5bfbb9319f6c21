"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap by ``overlap_chars``. Every chunk is split into
pre-tokens on its own, from an arbitrary first character. Going from left to right, the split of a chunk is right from
the first pre-token boundary on that it shares, inside the overlap, with the right split of the chunk before: the
pattern looks ahead by one character and never back, so two splits that share a boundary agree from there on. The text
is cut at these boundaries and the pieces are encoded one by one, so no call sees more than about a chunk. No cut follows
white space: there the end of a piece would decide a look-ahead that the text decides otherwise. Where an overlap holds no
shared boundary (one pre-token fills it), the split goes on from the last boundary that is sure.

Decoding concatenates the bytes of the ids; it gives the text's bytes back exactly, also where a character is spread
over several ids.

Null texts are encoded as empty ones: no ids. Empty tables give empty tables; repeated rows are encoded each. Other
columns of the input are neither read nor returned.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_batches, text_sizes

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: Bytes of text in one Arrow batch that goes back to the JVM.
BATCH_BYTES = 4 << 20
#: No alternative of the pattern decides on more than this many characters without having matched all of them.
LOOKAHEAD = 3


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 of a token's bytes, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The library's encoder over a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; ids that the file leaves out have none."""
    found = ranks(path)
    out = [b""] * (max(found.values(), default=-1) + 1)
    for token, rank in found.items():
        out[rank] = token
    return out


def boundaries(pattern, text: str, start: int, end: int, last: bool) -> list[int]:
    """Where the pre-tokens of ``text[start:end]``, split from ``start`` on, begin and end, as far as these are sure.

    Unless the chunk is the ``last`` one, a pre-token at its end may go on beyond it and is left out.
    """
    sure, at = [start], start
    for m in pattern.finditer(text, start, end):
        if not last and (m.end() >= end or m.start() + LOOKAHEAD > end):
            break
        if m.start() != at:
            sure.append(m.start())
        sure.append(at := m.end())
    return sure


def cuts(pattern, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Boundaries between pre-tokens of the whole text, about one a chunk and none after white space, found by stitching the chunks' own splits."""
    n, found, reach = len(text), [0], 0
    starts = range(0, n, chunk)
    splits = [boundaries(pattern, text, s, min(n, s + chunk + overlap), s + chunk + overlap >= n) for s in starts]
    sure = splits[0] if splits else [0]
    for s, own in zip(starts[1:], splits[1:], strict=False):
        if s + chunk + overlap <= reach:
            continue  # a longer split has gone beyond this chunk
        shared = set(own).intersection(p for p in reversed(sure) if p >= s)
        if shared:
            first = min(shared)
            sure = own[own.index(first) :]
        else:  # no boundary in common: go on from the last one that is sure, by doubled lengths while one pre-token fills them
            first, end = sure[-1], min(n, s + chunk + overlap)
            sure = boundaries(pattern, text, first, end, end >= n)
            while len(sure) == 1 and end < n:
                end = min(n, 2 * end - first)
                sure = boundaries(pattern, text, first, end, end >= n)
            reach = end
        cut = next((p for p in sure if p > found[-1] and not text[p - 1].isspace()), None)
        if cut is not None:
            found.append(cut)
    return [*found, n] if n > found[-1] else found


def encode_text(enc, pattern, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """The ids of one text."""
    if len(text) <= chunk:
        return np.asarray(enc.encode_ordinary(text), dtype=np.int32)
    at = cuts(pattern, text, chunk, overlap)
    return np.concatenate([np.asarray(enc.encode_ordinary(text[a:b]), dtype=np.int32) for a, b in zip(at, at[1:], strict=False)])


def decode_ids(vocabulary: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(vocabulary.__getitem__, ids.tolist()))


def _encoder(rank_file: str, pattern: str, chunk: int, overlap: int, decode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc, split, vocabulary = encoding(rank_file, pattern), regex.compile(pattern), token_bytes(rank_file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for part in by_bytes(text_sizes(texts), BATCH_BYTES):
                n = part.stop - part.start
                ids = [encode_text(enc, split, t or "", chunk, overlap) for t in texts.slice(part.start, n).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                out = {"key": keys.slice(part.start, n), "token_ids": lists}
                if decode:
                    out["decoded"] = pa.array([decode_ids(vocabulary, x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, *, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decoded: bool = False) -> DataFrame:
    """``key`` and ``token_ids`` (array<int>) of every text; with ``decoded``, also the bytes decoded from the ids."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, token_ids array<int>" + ", decoded binary" * decoded
    found = map_batches(docs.select(key, text), _encoder(rank_file, pattern, chunk_chars, overlap_chars, decoded), schema)
    return found.withColumnRenamed("key", key)


def decode(encoded: DataFrame, rank_file: str, *, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """``key`` and ``decoded`` (binary) of every row of ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = token_bytes(rank_file)
        for batch in batches:
            found = [b"".join(map(vocabulary.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "decoded": pa.array(found, pa.binary())})

    kind = encoded.schema[key].dataType.simpleString()
    return map_batches(encoded.select(key, ids), run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def digests(encoded: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per row of ``encode(..., decoded=True)``: the number of ids and the SHA-256 of ids and of decoded bytes."""
    return encoded.select(
        key,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
