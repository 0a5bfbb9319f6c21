"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted on training texts. The code length of a
byte is that of the longest context seen: with T the context's count and d its distinct following bytes, a byte that
followed c times costs -log2(c / (T + d)); any other costs an escape, -log2(d / (T + d)), and then what the context
without its first byte gives; the empty context escapes to 8 bits. The counts are frozen after training, and no context
is left out. A document's code length under a language is a sum over its bytes, computed for all languages at once from
tables of resolved costs: a row for each run of up to ``ORDER`` + 1 bytes that occurred in any language. The language
with the shortest code is predicted; the score is its share of the likelihood of all.

Training texts are cut into pieces of ``PIECE_CHARS`` characters; of the rows with a language that are not held out, up
to ``SAMPLE_PIECES`` pieces of each language with the smallest hashes are learnt, from anywhere in texts of any length.
With many languages fewer are taken, ``MODEL_PIECES`` over the square of their number, as each run has a cost in every
language. Where the model would be over ``MODEL_BYTES``, as with large alphabets, it is learnt from half of each language's
bytes, or a quarter, and so on, as every Python worker holds it. Every document is scored by its whole text,
``CHUNK_BYTES`` at a time.

Null texts and texts without a letter are ``und`` with score 0; so is everything if there is nothing to learn from.
Equal code lengths go to the first language by name. Repeated rows are scored each, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, map_batches, text_sizes

SAMPLE_PIECES = 256
PIECE_CHARS = 4096
MODEL_PIECES = 16_384
MODEL_BYTES = 256 << 20
BATCH_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
#: Bytes in the longest context.
ORDER = 5
#: What stands before a text.
BEFORE = b"\n" * ORDER
UNKNOWN = "und"


def training_sample(docs: DataFrame, allowed: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", n: int = SAMPLE_PIECES) -> list[tuple[str, bytes]]:
    """(language, piece of a text) of the training rows; at most ``n`` a language."""
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECE_CHARS)).cast("int")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}  # a row for each language
    if not counts:
        return []
    n = min(n, max(1, MODEL_PIECES // len(counts) ** 2))
    share = F.create_map(*[x for k, c in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1 << 20, int((1 << 20) * (2 * n + 20) / c) + 1)))])
    own = rows.withColumn("hash", F.xxhash64("key", F.length("text"), F.lit("sample")))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(F.pmod(F.xxhash64("hash", i), F.lit(1 << 20)).alias("draw"), i.alias("i"))), lambda x: x.draw < share[F.col("lang")])  # about 2 n a language
    found = own.select("key", "lang", "text", F.explode(drawn).alias("x"))
    found = found.select("key", "lang", "x.draw", F.substr("text", F.col("x.i") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece")).distinct()  # repeated rows once
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key", "piece"))).filter(F.col("r") <= n)
    return sorted((r.lang, r.piece.encode()) for r in first.select("lang", "piece").collect())


@dataclass(frozen=True)
class Model:
    """Costs in bits, by language in the last axis. The lists go by the length of runs of bytes, from 0.

    A run's code is its bytes as one number. ``escapes`` has a row more than there are runs, for unseen ones, first.
    """

    languages: list[str]
    runs: list[np.ndarray]  # codes, sorted
    costs: list[np.ndarray]  # of a run's last byte, with the bytes before as context
    escapes: list[np.ndarray]  # of a run as a context; 0 in languages where it is none


def size_of(model: Model) -> int:
    """Bytes of a model's tables; a worker's look-up has at most three times as many."""
    return sum(x.nbytes for x in (*model.runs, *model.costs, *model.escapes))


def bounded(sample: list[tuple[str, bytes]], most: int = MODEL_BYTES, order: int = ORDER) -> Model:
    """The model of the sample; of the first half of each language's bytes, or a quarter, and so on, if it is over ``most`` bytes.

    Begins with a part that can't be too large and doubles it, so what is tried has at most twice the size.
    """
    whole: dict[str, bytes] = {}
    for lang, text in sample:
        whole[lang] = whole[lang] + BEFORE + text if lang in whole else text
    worst = (order + 2) * 8 * (len(whole) + 1) * sum(map(len, whole.values()))
    halvings = max(0, worst // max(1, most)).bit_length()
    best = train([], order)
    for k in range(halvings, -1, -1):
        model = train([(lang, text[: len(text) >> k]) for lang, text in sorted(whole.items())], order)
        if best.languages and size_of(model) > most:
            break
        best = model
    return best


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """The codes of all runs of ``n`` bytes."""
    out = np.zeros(max(0, len(data) - n + 1), np.int64)
    for j in range(n):
        out = out << 8 | data[j : len(out) + j]
    return out


def train(sample: list[tuple[str, bytes]], order: int = ORDER) -> Model:
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], [], [], [])
    streams = [np.frombuffer(b"".join(BEFORE + t for lang, t in sample if lang == own), np.uint8) for own in languages]
    runs, costs, escapes = [np.zeros(1, np.int64)], [np.full((1, len(languages)), 8, np.float32)], []
    for n in range(1, order + 2):
        found = [np.unique(codes(s, n), return_counts=True) for s in streams]
        here = np.unique(np.concatenate([f for f, _ in found]))
        escape, direct = np.zeros((len(runs[-1]) + 1, len(languages)), np.float32), []
        for k, (own, count) in enumerate(found):
            context, at, distinct = np.unique(own >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=count, minlength=len(context)) + distinct
            escape[np.searchsorted(runs[-1], context) + 1, k] = -np.log2(distinct / total)
            direct.append(-np.log2(count / total[at]))
        shorter = np.searchsorted(runs[-1], here & ((1 << 8 * (n - 1)) - 1))
        cost = escape[np.searchsorted(runs[-1], here >> 8) + 1] + costs[-1][shorter]
        for k, (own, _) in enumerate(found):
            cost[np.searchsorted(here, own), k] = direct[k]
        runs.append(here)
        costs.append(cost)
        escapes.append(escape)
    return Model(languages, runs, costs, escapes)


class Numbers:
    """The numbers of codes, from 1; 0 for others. By tables of hashes: what collides in one stands in the next."""

    def __init__(self, found: np.ndarray) -> None:
        self.codes = np.concatenate([[-1], found])
        self.tables: list[tuple[int, np.ndarray]] = []
        left = np.arange(1, len(self.codes))
        while len(left):
            bits = max(4, len(left).bit_length() + 1)
            table = np.zeros(1 << bits, np.int32)
            slots = self._slots(self.codes[left], bits, len(self.tables))
            table[slots] = left
            self.tables.append((bits, table))
            left = left[table[slots] != left]

    @staticmethod
    def _slots(found: np.ndarray, bits: int, table: int) -> np.ndarray:
        factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0xD6E8FEB86659FD * table & 0xFFFFFFFFFFFFFFFF)  # odd, each table's own
        return (found.astype(np.uint64) * factor) >> np.uint64(64 - bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(wanted), np.int32), slice(None)
        for number, (bits, table) in enumerate(self.tables):
            asked = wanted[live]
            got = table[self._slots(asked, bits, number)]
            right = self.codes[got] == asked
            out[live] = np.where(right, got, 0)
            other = (got > 0) & ~right
            if not other.any():
                break
            live = np.flatnonzero(other) if isinstance(live, slice) else live[other]
        return out


class Scorer:
    """A model's tables with their look-up."""

    def __init__(self, model: Model) -> None:
        self.model, self.order = model, len(model.runs) - 2
        self.numbers = [Numbers(found) for found in model.runs]
        none = np.zeros((1, len(model.languages)), np.float32)
        self.costs = [np.concatenate([none, x]) for x in model.costs]

    def costs_of(self, data: np.ndarray) -> np.ndarray:
        """The cost of each byte of ``data`` from the ``ORDER``-th on."""
        whole = codes(data, self.order + 1)
        number = self.numbers[-1].find(whole)
        out = self.costs[-1][number]
        at = np.flatnonzero(number == 0)
        for n in range(self.order, -1, -1):  # an escape from the context of n bytes, then the run of n bytes
            if not len(at):
                break
            run = whole[at] & ((1 << 8 * (n + 1)) - 1)
            out[at] += self.model.escapes[n][self.numbers[n].find(run >> 8)]
            number = self.numbers[n].find(run & ((1 << 8 * n) - 1))
            out[at] += self.costs[n][number]
            at = at[number == 0]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        data = np.frombuffer(BEFORE.join([b"", *texts]), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + len(BEFORE)) - len(BEFORE)  # the costs begin at the first text's first byte
        out = np.zeros((len(texts), len(self.model.languages)))
        for a in range(0, len(data) - len(BEFORE), CHUNK_BYTES):
            cost = self.costs_of(data[a : a + CHUNK_BYTES + len(BEFORE)])
            lo, hi = np.clip(ends - size - a, 0, len(cost)), np.clip(ends - a, 0, len(cost))
            inside = np.flatnonzero(hi > lo)
            if len(inside):
                spans = np.stack([lo[inside], hi[inside]], axis=1).ravel()
                spans = spans[:-1] if spans[-1] == len(cost) else spans
                out[inside] += np.add.reduceat(cost, spans, axis=0, dtype=np.float64)[::2]
        return out


def predict(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the shortest code, and its share of the likelihood."""
    best = bits.argmin(axis=1)
    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
    return best, 1 / np.exp2(-gap).sum(axis=1)


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of each row."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES, see `bounded`
    unknown = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value.languages
        scorer = Scorer(shared.value) if languages else None
        names = np.array([*languages, UNKNOWN], dtype=object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(batch.num_rows, unknown), np.zeros(batch.num_rows)
            for part in by_bytes(text_sizes(batch.column(1)), BATCH_BYTES) if scorer else ():
                texts = [(t or "").encode() for t in batch.column(1).slice(part.start, part.stop - part.start).to_pylist()]
                best[part], score[part] = predict(scorer.bits(texts))
            best[~letters], score[~letters] = unknown, 0
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_has_letter"))
    return map_batches(rows, run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
