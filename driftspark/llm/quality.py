"""Quality classification by voting of nearest labelled neighbours in a latent-semantic space.

A text's terms are of four kinds, each hashed to columns of its own: the shapes of its words (letters, capitals, digits
and each other character by its own class, runs taken together), with a mark for each word that repeats the one before;
its words in lower case, without what is neither letter nor digit; pairs of neighbouring words; and runs of three letters,
word bounds included. A row holds the square roots of the terms' shares in their kind, times the kind's ``SHARE``,
weighted by inverse document frequency. The labelled rows' matrix is reduced by a singular value decomposition to
``RANK`` latent dimensions; the labelled vectors, of unit length, are broadcast. Each document is projected likewise, its
cosines with all labelled vectors are computed exactly, block by block, and its ``NEIGHBOURS`` nearest vote for their
label with the weight of their similarity to the power ``SHARPNESS``. Neighbours that are equally near as the last one
(to ``EQUAL``) share the votes that are left among them, so no order of rows counts.

Labels show which forms are poor, but no one labels keyboard noise. So a labelled document of label 1 with ``NOISE_WORDS``
words or more can also be learnt as noise: with the letters of every word in another order, which vote as ``NOISE_LABEL``.
Noise and prose of one form score apart by that. The value is over the usual cut of 0.3, as a language that no labelled
document is written in looks like noise too; whoever has labels for all languages may cut at 0.5.

The model is bounded: of the labelled documents that may be learnt from, the ``LABELLED`` with the smallest hashes are
used. Labels without a document take no room; of rows that share an id, the one with the least hash of its text counts.
Every document is scored by its whole text. A text without terms, or one that no neighbour resembles, gets the labelled
documents' share of label 1 (0.5 without labels). Null texts are empty. Labels other than 0 and 1 are not used; of several
labels of a document the greatest counts. Repeated rows are scored each, other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checkpointed, map_batches, text_sizes

#: Columns of each kind of term; the first kind has one more, for repeated words.
TERMS = 1024
KINDS = ("shapes", "words", "pairs", "runs")
#: What a kind counts for; shapes, which tell most, for most.
SHARE = (1.0, 0.3, 0.2, 0.6)
COLUMNS = len(KINDS) * TERMS + 1
RANK = 64
NOISE_WORDS = 24
NOISE_LABEL = 0.4
LABELLED = 4096
NEIGHBOURS = 15
SHARPNESS = 8
BATCH_BYTES = 2 << 20
BLOCK = 512
EQUAL = 5e-8
KEPT = 200_000
#: Longer words are not kept between texts.
WORD_CHARS = 40
REPEAT = COLUMNS - 1  # the column of the mark for repeated words


class _Classes(dict):
    """Code point -> character of its class; fills itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "a" if c.isalpha() and not c.isupper() else "A" if c.isalpha() else "0" if c.isnumeric() else c
        if len(self) < 100_000:
            self[code] = kind
        return kind


class _Terms(dict):
    """Word -> the hash of its letters and digits, and the column of its shape, as one number; fills itself, and starts anew when it is large."""

    runs = re.compile(r"(.)\1+", re.DOTALL)
    others = re.compile(r"[\W_]+")

    def __init__(self) -> None:
        self.classes = _Classes()

    def __missing__(self, word: str) -> int:
        shape = zlib.crc32(self.runs.sub(r"\1", word.translate(self.classes)).encode()) % TERMS
        letters = self.others.sub("", word).lower()
        found = ((zlib.crc32(letters.encode()) if letters else NO_LETTERS) << 16) | shape
        if len(word) <= WORD_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


NO_LETTERS = 1 << 33  # no hash of a word


def _mixed(x: np.ndarray) -> np.ndarray:
    """A column for each 64-bit number."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TERMS


def _letter_runs(text: str) -> np.ndarray:
    """Columns of all runs of three characters of the text in lower case that hold two letters or more; what is no letter is a blank."""
    codes = np.frombuffer(_Terms.others.sub(" ", f" {text} ").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = codes != 32
    enough = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
    return _mixed(((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[enough])


def features(texts: list[str], terms: _Terms) -> np.ndarray:
    """A row for each text: the square roots of its terms' shares in their kind, times the kind's ``SHARE``."""
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    found = np.fromiter(map(terms.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    row, word = np.repeat(np.arange(len(texts)), n), found >> 16
    real = word != NO_LETTERS
    follows = (row[1:] == row[:-1]) & real[1:] & real[:-1]
    runs = [_letter_runs(t) for t in texts]
    terms_of = (
        (row, found & 0xFFFF), (row[real], _mixed(word[real])), (row[1:][follows], _mixed((word[:-1] << 31 ^ word[1:])[follows])),
        (np.repeat(np.arange(len(texts)), [len(r) for r in runs]), np.concatenate(runs or [np.zeros(0, np.int64)])),
    )
    out = np.zeros((len(texts), COLUMNS), np.float32)
    for kind, (at, column) in enumerate(terms_of):
        counts = np.bincount(at * TERMS + column, minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
        total = np.maximum(counts.sum(axis=1), 1)
        out[:, kind * TERMS : (kind + 1) * TERMS] = SHARE[kind] * np.sqrt(counts / total[:, None])
    out[:, REPEAT] = np.sqrt(np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.float64, len(words)) / np.maximum(n, 1))
    return out


def noise(text: str, seed: int) -> str:
    """The text with the letters of every word in another order; words keep their capitals, digits and marks where they are."""
    rng = random.Random(seed)

    def shuffled(m: re.Match) -> str:
        letters = list(m[0].lower())
        rng.shuffle(letters)
        return "".join(x.upper() if c.isupper() else x for x, c in zip(letters, m[0], strict=False))

    return re.sub(r"[^\W\d_]{2,}", shuffled, text)


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # term columns -> latent dimensions, with the term weights
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    prior: float


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


@dataclass(frozen=True)
class Rows:
    """Rows of features as their columns (int16) and values (float32) other than 0; a slice of them is an array with all columns."""

    at: list[bytes]
    x: list[bytes]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, part: slice) -> np.ndarray:
        out = np.zeros((len(self.at[part]), COLUMNS), np.float32)
        for row, at, x in zip(out, self.at[part], self.x[part], strict=True):
            row[np.frombuffer(at, np.int16)] = np.frombuffer(x, np.float32)
        return out


def _blocks(x: np.ndarray | Rows, weight: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """``BLOCK`` rows at a time; with ``weight``, their columns weighted and the rows of unit length."""
    for a in range(0, len(x), BLOCK):
        yield x[a : a + BLOCK] if weight is None else unit(x[a : a + BLOCK] * weight)


def _axes(x: np.ndarray | Rows, weight: np.ndarray | None = None) -> np.ndarray:
    """The ``RANK`` leading right singular vectors, as columns; of over 1,024 rows by block iteration from a fixed start.

    The rows are met block by block: all columns of all rows at once would be the most that training holds.
    """
    if len(x) <= 1024:
        return np.linalg.svd(np.concatenate(list(_blocks(x, weight))).astype(np.float64), full_matrices=False)[2][:RANK].T
    block = np.random.default_rng(0).standard_normal((x[:1].shape[1], RANK + 16)).astype(np.float32)
    for _ in range(8):
        block = np.linalg.qr(sum(b.T @ (b @ block) for b in _blocks(x, weight)))[0]
    _, _, right = np.linalg.svd(np.concatenate([b @ block for b in _blocks(x, weight)]).astype(np.float64), full_matrices=False)
    return block @ right[:RANK].T


def train(rows: np.ndarray | Rows, labels: np.ndarray) -> Model:
    """From the labelled rows' features and labels; rows of ``NOISE_LABEL`` don't count for the share of label 1."""
    if not len(rows):
        return Model(np.zeros((COLUMNS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = (np.log((1 + len(rows)) / (1 + sum((b > 0).sum(axis=0) for b in _blocks(rows)))) + 0.1).astype(np.float32)
    projection = (idf[:, None] * _axes(rows, idf)).astype(np.float32)
    return Model(projection, np.concatenate([unit(b @ projection) for b in _blocks(rows)]), labels.astype(np.float32), float(labels[labels != NOISE_LABEL].mean()))


def score(model: Model, rows: np.ndarray) -> np.ndarray:
    """The share of similarity-weighted neighbours with label 1."""
    out = np.full(len(rows), model.prior)
    k = min(NEIGHBOURS, len(model.labels))
    for a in range(0, len(rows) if k else 0, BLOCK):
        cos = unit(rows[a : a + BLOCK] @ model.projection) @ model.vectors.T
        last = np.partition(cos, len(model.labels) - k, axis=1)[:, len(model.labels) - k, None]
        nearer, equal = cos > last + EQUAL, np.abs(cos - last) <= EQUAL
        left = k - nearer.sum(axis=1)
        asked, near = np.nonzero(nearer | equal)
        weight = np.maximum(cos[asked, near], 0).astype(np.float64) ** SHARPNESS
        weight *= np.where(nearer[asked, near], 1, (left / np.maximum(equal.sum(axis=1), 1))[asked])
        total = np.bincount(asked, weight, len(cos))
        voted = total > 0
        out[a : a + BLOCK][voted] = np.bincount(asked, weight * model.labels[near], len(cos))[voted] / total[voted]
    return np.clip(out, 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column, *, n: int = LABELLED, key: str = "doc_id", text: str = "text", label: str = "quality", with_noise: bool = False) -> DataFrame:
    """Key, label and features (``Rows``) of at most ``n`` documents, and with ``with_noise`` of their noise."""
    known = labels.filter(allowed & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    given = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).groupBy("key").agg(F.min("hash").alias("hash"))
    draw = F.xxhash64(F.col("key").cast("string"), F.lit("labelled"))
    chosen = checkpointed(known.join(given, "key").orderBy(draw, "key").limit(n).select("key", "label", "hash"))  # n rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(chosen), ["key", "hash"])
    rows = rows.dropDuplicates(["key"]).select("key", "label", "text")  # rows that are equal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            for part in by_bytes(text_sizes(batch.column(2)), BATCH_BYTES):
                cut = batch.slice(part.start, part.stop - part.start)
                texts, keys, labels = [t or "" for t in cut.column(2).to_pylist()], cut.column(0).cast(pa.string()).to_pylist(), cut.column(1).to_pylist()
                if with_noise:
                    more = [(k, t) for k, y, t in zip(keys, labels, texts, strict=True) if y == 1 and len(t.split()) >= NOISE_WORDS]
                    texts += [noise(t, zlib.crc32(k.encode())) for k, t in more]
                    keys, labels = keys + [k for k, _ in more], [*map(float, labels), *[NOISE_LABEL] * len(more)]
                for a in range(0, len(texts), BLOCK):
                    found = features(texts[a : a + BLOCK], terms)
                    at = [np.flatnonzero(x).astype(np.int16) for x in found]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys[a : a + BLOCK], pa.string()), "label": pa.array(labels[a : a + BLOCK], pa.float64()), "at": pa.array([i.tobytes() for i in at], pa.binary()), "x": pa.array([x[i].tobytes() for x, i in zip(found, at, strict=True)], pa.binary())})

    return map_batches(rows, run, "key string, label double, at binary, x binary")


def _in_order(rows: list[tuple[str, float, bytes, bytes]]) -> tuple[Rows, np.ndarray]:
    rows = sorted(rows)
    return Rows([at for _, _, at, _ in rows], [x for *_, x in rows]), np.array([y for _, y, _, _ in rows])


def labelled_rows(docs: DataFrame, labels: DataFrame, allowed: Column, **options) -> tuple[Rows, np.ndarray]:
    """Features and labels of the rows of ``labelled``, on the driver."""
    return _in_order([(r.key, r.label, bytes(r["at"]), bytes(r.x)) for r in labelled(docs, labels, allowed, **options).collect()])


def learnt(docs: DataFrame, labels: DataFrame, allowed: Column, **options) -> Model:
    """The model of the rows of ``labelled``, which are bounded: trained in a task, so that the driver gets no rows, only the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = train(*_in_order(rows))
        yield pa.RecordBatch.from_pydict({"rank": pa.array([model.projection.shape[1]], pa.int32()), "prior": [model.prior]} | {k: pa.array([getattr(model, k).astype(np.float32).tobytes()], pa.binary()) for k in ("projection", "vectors", "labels")})

    found = map_batches(labelled(docs, labels, allowed, **options).repartition(1), run, "rank int, prior double, projection binary, vectors binary, labels binary").collect()
    if not found:
        return train(Rows([], []), np.zeros(0))
    floats = lambda x: np.frombuffer(bytes(x), np.float32)
    r = found[0]
    return Model(floats(r.projection).reshape(-1, r["rank"]), floats(r.vectors).reshape(-1, r["rank"]), floats(r.labels), r.prior)


def _scores(texts: pa.Array, model: Model, terms: _Terms) -> np.ndarray:
    out = np.zeros(len(texts))
    for part in by_bytes(text_sizes(texts), BATCH_BYTES):
        own = [t or "" for t in texts.slice(part.start, part.stop - part.start).to_pylist()]
        for a in range(0, len(own), BLOCK):
            found = own[a : a + BLOCK]
            out[part.start + a : part.start + a + len(found)] = score(model, features(found, terms))
    return out


def classify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LABELLED x RANK floats and the projection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "score": pa.array(_scores(batch.column(1), shared.value, terms))})

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"key {kind}, score double").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, cut: float, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``cut`` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), shared.value, terms) >= cut))

    return map_batches(docs, run, docs.schema)
