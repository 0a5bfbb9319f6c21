"""Top-k search against all inner products."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import topk


def brute(rows, k, asked):
    """Every row is a candidate; queries that share an id have one ranking."""
    v = []
    for key, x in rows:
        if key is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((key, [math.floor(1024 * c) for c in x]))
    out = []
    for q in {i for i, _ in v if i % asked == 0}:
        scores = [(-sum(a * b for a, b in zip(own, x, strict=False)), c) for i, own in v if i == q for c, x in v if c != q]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,step,query_bytes", [(8192, 512, 32 << 20), (16, 4, 64 * 20), (7, 3, 64 * 9)])
def test_equals_brute_force(spark, monkeypatch, block, step, query_bytes):
    for name, value in (("BLOCK", block), ("STEP", step), ("QUERY_BYTES", query_bytes), ("QUERY_BLOCK", 6), ("LEAD", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(40)] + [(300, [0.0] * 8), (305, [-1e6] * 8), (301, None), (302, [None, 1.0]), (303, [math.nan] * 8), (304, [math.inf] * 8), (310, []), (315, [1.0, 2.0]), (5, [9.0] * 8), (None, [1.0] * 8), (200, [0.5] * 8), (11, [9.5] * 8), (11, [9.5] * 8)]
    given = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = sorted(map(tuple, topk.search(given, F.col("vec_id") % 5 == 0, k=10).collect()))
    assert got == brute(rows, 10, 5)


def test_vectors_are_not_shuffled_to_queries(spark, monkeypatch):
    """With twice as many chunks of queries, the plan of a chunk still moves scores only, at most k of a task for each query."""
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 4 * 30)
    moved, whole = [], topk.checkpointed

    def counted(df):
        if "at" in df.columns:
            plan = df._jdf.queryExecution().executedPlan().toString()
            moved.append(plan)
        return whole(df)

    monkeypatch.setattr(topk, "checkpointed", counted)
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(given, F.col("vec_id") % 5 == 0, k=3).collect()))
    assert got == brute(rows, 3, 5)
    assert len(moved) == 4 * len(topk.BANDS)  # 120 queries, 30 in a chunk
    assert all(not re.search(r"Exchange[^\n]*ints|Join", p) for p in moved)


def test_few_and_none(spark):
    given = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(given, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(given.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(given, F.col("vec_id") > 5).count() == 0


def test_large_integers_stay_exact():
    q, c = np.array([[3 * 10**9, 1]]), np.array([[3 * 10**9 - 1, 1], [3 * 10**9 - 1, 2]])
    found, ids, best = topk.scan(np.array([9]), q, np.array([-np.inf]), np.array([1, 2]), c, np.eye(2), 2)
    assert found.all() and ids.tolist() == [[2, 1]]
    assert best.tolist() == [[9 * 10**18 - 3 * 10**9 + 2, 9 * 10**18 - 3 * 10**9 + 1]]
