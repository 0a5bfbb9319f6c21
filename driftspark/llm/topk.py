"""Exact top-k search by inner product over norm-sorted, rotated vectors.

All vectors are ordered by descending length, packed into blocks, and written once. They are seen in the axes of the
singular value decomposition of all rows (from their d x d Gram matrix, summed in parallel), so the leading coordinates
hold most of an inner product. Queries come in chunks of at most ``QUERY_BYTES``, which are broadcast; for a chunk, the
blocks of candidates are scanned in bands of descending length, each task reading its own blocks, so no vector is moved
to a query or a query to a vector. What a task finds, at most k for each query, is ranked with what the bands before
gave, and the k-th best scores are the thresholds of the next band, in which

* a block whose longest vector times the query's length stays below the query's threshold is passed over
  (Cauchy-Schwarz); blocks that no query of the chunk needs are left out of the scan by a filter;
* within a block, the partial inner product over the ``LEAD`` leading axes plus the product of the residuals' lengths
  bounds the whole; only candidates whose bound reaches some query's threshold get exact scores, in integers.

The first bands are small (``BANDS``, shares of the blocks), so thresholds are known early. What is shuffled are scores
that reached a threshold, not vectors.

Bounds are widened by a margin for rounding; scores are exact while the product of two lengths stays below 2^63.

A component x counts as floor(scale * x), taken in doubles. Vectors that are null, hold nulls or non-finite components,
or have no id take no part; shorter vectors are filled up with zeros. Every row is a candidate, also where rows share an
id; a query never finds rows of its own id, and queries that share an id have one common ranking. Ties go to the smaller
id; a query with fewer than k candidates gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, map_batches, saved

LEAD = 16
#: Vectors in a block of candidates, and queries that are compared with it at once.
BLOCK = 8192
QUERY_BLOCK = 2048
#: Bytes of the queries of a chunk, which are broadcast.
QUERY_BYTES = 32 << 20
#: The shares of the longest blocks with which the bands end.
BANDS = (1 / 64, 1 / 16, 1 / 4, 1.0)
STEP = 512
EXACT_DOUBLE = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (array<long>) and ``norm`` of the vectors that take part."""
    x = F.col(vector)
    limit = F.lit(float("inf"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < limit))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    found = vectors.filter(x.isNotNull() & finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return found.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of ``d`` integers, filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == d).all():
        return values.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = values
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """The right singular vectors of all rows, the largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column(0), d).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(d * d, dtype=np.int32)), "x": pa.array(total.ravel())})

    rows = map_batches(vectors.select("v"), run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(d * d)
    gram[[r["at"] for r in rows]] = [r.x for r in rows]
    _, axes = np.linalg.eigh(gram.reshape(d, d))
    return axes[:, ::-1].copy()


def _pack(ids: np.ndarray, m: np.ndarray) -> dict[str, pa.Array]:
    small = np.int32 if not m.size or np.abs(m).max() < 2**31 else np.int64
    norm = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    return {"n": pa.array([len(ids)], pa.int32()), "norm": pa.array([norm]), "width": pa.array([np.dtype(small).itemsize], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "ints": pa.array([m.astype(small).tobytes()], pa.binary())}


PACKED = "n int, norm double, width int, ids binary, ints binary"


def packed(vectors: DataFrame, d: int, rows: int) -> DataFrame:
    """Rows (vec_id, v), in the order given within their partitions, as blocks of at most ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def flush(n: int) -> Iterator[pa.RecordBatch]:
            i, m = np.concatenate(ids), np.concatenate(parts)
            yield pa.RecordBatch.from_pydict(_pack(i[:n], m[:n]))
            ids[:], parts[:] = [i[n:]], [m[n:]]

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            parts.append(matrix(batch.column(1), d))
            n += batch.num_rows
            while n >= rows:
                yield from flush(rows)
                n -= rows
        if n:
            yield from flush(n)

    return map_batches(vectors.select("vec_id", "v"), run, PACKED)


def unpack(n: int, width: int, ids: bytes, ints: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(ints, np.int32 if width == 4 else np.int64).astype(np.int64).reshape(n, d)


def products(q: np.ndarray, c: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products as int64; ``largest`` bounds them."""
    if largest < EXACT_DOUBLE:
        return np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def scan(query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, c: np.ndarray, axes: np.ndarray, k: int, so_far: Best | None = None) -> Best:
    """The best k of the candidates ``c``, given by descending length: (found, ids, scores), each queries x k.

    ``least``: scores that the result must reach (-inf: none known). ``so_far``: the best of other candidates, which
    compete.
    """
    qr, cr = q @ axes, c @ axes
    q_norm, c_norm = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    q_rest, c_rest = np.linalg.norm(qr[:, LEAD:], axis=1), np.linalg.norm(cr[:, LEAD:], axis=1)
    bottom = np.iinfo(np.int64).min
    found, best_ids, best = so_far or (np.zeros((len(q), k), bool), np.zeros((len(q), k), np.int64), np.full((len(q), k), bottom))
    least = np.maximum(least, np.where(found[:, k - 1], best[:, k - 1].astype(np.float64), -np.inf))
    for a in range(0, len(c), STEP):
        s = slice(a, a + STEP)
        margin = 1e-9 * q_norm * c_norm[a] + 1e-6
        live = np.flatnonzero(q_norm * c_norm[s].max() + margin >= least)
        if not len(live):
            break  # all that follow are shorter
        bound = qr[live, :LEAD] @ cr[s, :LEAD].T + np.outer(q_rest[live], c_rest[s])
        wanted = (bound + margin[live, None] >= least[live, None]) & (query_ids[live, None] != ids[s][None, :])
        columns = np.flatnonzero(wanted.any(axis=0))
        rows = np.flatnonzero(wanted.any(axis=1))
        if not len(rows):
            continue
        live, wanted = live[rows], wanted[np.ix_(rows, columns)]
        score = products(q[live], c[s][columns], float(q_norm.max(initial=0) * c_norm[a]))
        new_ids = np.concatenate([best_ids[live], np.broadcast_to(ids[s][columns], score.shape)], axis=1)
        new, ok = np.concatenate([best[live], score], axis=1), np.concatenate([found[live], wanted], axis=1)
        # the smallest int64 may be a true score: first what was found, then by score and id
        order = np.lexsort((new_ids, -new.astype(np.float64) if np.abs(score).max(initial=0) < EXACT_DOUBLE else ~new, ~ok), axis=1)[:, :k]
        best_ids[live], best[live], found[live] = (np.take_along_axis(x, order, axis=1) for x in (new_ids, new, ok))
        kth = np.where(found[live, k - 1], best[live, k - 1].astype(np.float64), -np.inf)
        least[live] = np.maximum(least[live], kth)
    return found, best_ids, best


def chunk_rows(d: int) -> int:
    return max(1, QUERY_BYTES // (8 * d))


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    v = checkpointed(integer_vectors(vectors, scale, key=key, vector=vector))
    n, d, asked = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(is_query)).first()
    d = max(d, 1)
    order, rows = [F.desc("norm"), F.asc("vec_id")], chunk_rows(d)

    def blocks(of: DataFrame, total: int, size: int) -> DataFrame:
        return packed(of.repartitionByRange(max(1, -(-total // size)), *order).sortWithinPartitions(*order), d, size)

    candidates = saved(blocks(v, n, BLOCK))
    chunks = saved(blocks(v.filter(is_query), asked, rows).withColumn("chunk", F.monotonically_increasing_id()))
    shares = [1 - share for share in BANDS[:-1]]
    ends = [*(candidates.agg(F.percentile_approx("norm", shares, 10_000)).first()[0] or [0.0] * len(shares)), -1.0]
    axes = spark.sparkContext.broadcast(rotation(v, d))

    results = None
    for number in sorted(r.chunk for r in chunks.select("chunk").collect()):  # a number for each QUERY_BYTES of queries
        own = _chunk(chunks.filter(F.col("chunk") == number), candidates, ends, axes, d, k)
        results = own if results is None else results.unionByName(own)
    if results is None:
        results = spark.createDataFrame([], "at int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return results.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunk(chunk: DataFrame, candidates: DataFrame, ends: list[float], axes, d: int, k: int) -> DataFrame:
    """(at, query_id, vec_id, score): the best k of each query of a chunk, ``at`` its number there."""
    context = chunk.sparkSession.sparkContext
    r = chunk.first()
    query_ids, q = unpack(r.n, r.width, r.ids, r.ints, d)
    norm, least = np.linalg.norm(q.astype(np.float64), axis=1), np.full(len(q), -np.inf)
    queries = context.broadcast((query_ids, q))
    top, start = None, float("inf")
    for end in ends:
        bounds = context.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch], bounds=bounds) -> Iterator[pa.RecordBatch]:
            (asking, all_queries), given = queries.value, bounds.value
            parts = [slice(a, a + QUERY_BLOCK) for a in range(0, len(asking), QUERY_BLOCK)]
            best: list[Best | None] = [None] * len(parts)
            for batch in batches:
                for b in batch.to_pylist():
                    ids, c = unpack(b["n"], b["width"], b["ids"], b["ints"], d)
                    for i, part in enumerate(parts):
                        best[i] = scan(asking[part], all_queries[part], given[part], ids, c, axes.value, k, best[i])
            for part, found in zip(parts, best, strict=True):
                if found is not None:
                    at = np.nonzero(found[0])
                    yield pa.RecordBatch.from_pydict({"at": pa.array((at[0] + part.start).astype(np.int32)), "query_id": asking[part][at[0]], "vec_id": found[1][at], "score": found[2][at]})

        need = np.where(least > 0, least / np.maximum(norm, 1e-300) * (1 - 1e-9) - 1e-6, 0.0).min(initial=np.inf)  # shorter blocks matter to no query
        band = candidates.filter((F.col("norm") <= start) & (F.col("norm") > end) & (F.col("norm") >= float(need)))
        start = end
        found = map_batches(band, run, "at int, query_id long, vec_id long, score long")
        found = found if top is None else found.unionByName(top)
        rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), F.asc("vec_id")))
        ranked = checkpointed(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        top = ranked.drop("rank")
        if end >= 0:
            for x in ranked.filter(F.col("rank") == k).select("at", "score").collect():  # one number for a query of the chunk
                least[x["at"]] = float(x.score)
    return top
