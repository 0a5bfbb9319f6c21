"""Token counts: lengths only, by whole batches of short fragments.

The counts are those of the SentencePiece library on the whole text. A text is split at safe boundaries: single blanks
between two other characters. The model replaces a blank by its own mark, puts such a mark before every text, and has no
piece with the mark after another character (``safe`` checks it when a model is loaded), so no merge crosses such a
blank, and a fragment has the same tokens alone as inside its text. Texts are taken in batches of about ``batch_bytes``
bytes; fragments that a batch repeats are encoded once, and the counts of frequent ones are kept between batches in a
table of at most ``KEPT`` entries. A fragment without safe boundary (blanks in a row, other white space) stays whole.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each, empty tables give empty tables, and other
columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, map_batches, text_sizes

BATCH_BYTES = 4 << 20
KEPT = 400_000
#: The library's stand-in for a blank.
MARK = "▁"
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def safe(path: str) -> bool:
    """Whether no piece of the model holds a blank's mark after another character, and blanks are kept as they are."""
    sp = processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces) and sp.encode("a  b", out_type=str) != sp.encode("a b", out_type=str)


def fragments(text: str) -> list[str]:
    """The text's parts between safe boundaries."""
    parts = text.split(" ")
    return SAFE.split(text) if "" in parts or MARK in text else parts


def count_texts(path: str, texts: list[str], kept: dict[str, int]) -> list[int]:
    """Tokens of each text; ``kept`` holds the counts of fragments between calls."""
    sp = processor(path)
    if not safe(path):
        return [len(ids) for ids in sp.encode(texts, num_threads=1)]
    parts = [fragments(t) for t in texts]
    new = [x for x in {x for p in parts for x in p} if x not in kept]
    if len(kept) + len(new) > KEPT:
        kept.clear()
        new = list({x for p in parts for x in p})
    kept.update(zip(new, map(len, sp.encode(new, num_threads=1)), strict=True))
    return [sum(map(kept.__getitem__, p)) for p in parts]


def token_counts(docs: DataFrame, model_file: str, *, limit: int = 4096, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            texts, sizes = batch.column(1), text_sizes(batch.column(1))
            counts: list[int] = []
            for part in by_bytes(sizes, batch_bytes):
                counts += count_texts(model_file, [t or "" for t in texts.slice(part.start, part.stop - part.start).to_pylist()], kept)
            n = np.asarray(counts, np.int64)
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "n_bytes": pa.array(sizes), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return map_batches(docs.select(key, text), run, schema).withColumnRenamed("key", key)
