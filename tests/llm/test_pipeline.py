"""The near-duplicate stage against brute force, and the pipeline's promises on a small corpus."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftspark.llm import bpe, similar

TINY = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(14)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(n))
    base = [text(n) for n in (200, 120, 60, 300, 30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE  two"), (304, "one two three"), (None, base[0]), (305, text(80)), (300, None)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component string").repartition(4)
    keyed = {k: shingles(t) for k, t in rows if k is not None}
    root = {k: k for k in keyed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(keyed), 2):
        x, y = keyed[a], keyed[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.doc_id: r.component for r in similar.groups(docs).collect()}
    members = {k: find(k) for k in keyed if sum(find(j) == find(k) for j in keyed) > 1}
    assert got == members
    assert similar.groups(docs.limit(0)).count() == 0


def test_rows_without_own_ids(spark):
    rng = random.Random(17)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(100), text(80), text(90)
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(5, a, "0"), (None, near, "1"), (None, a, "2"), (7, b, "3"), (7, c, "4"), (None, c, "5"), (9, b, "6"), (9, b, "7"), (3, b, "8"), (None, None, "9"), (None, "", "10"), (11, text(5), "11"), (11, text(6), "12"), (12, "one", "13"), (12, "one", "14")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _x string").repartition(4)
    kept = similar.kept_rows(docs)
    assert kept.columns == docs.columns
    got = sorted(r._x for r in kept.collect())
    assert set(got) - {"9", "10", "13", "14"} == {"0", "4", "8", "11", "12"} and len(got) == 7  # one of the equal rows each
    assert similar.kept_rows(docs.limit(0)).count() == 0
    own = docs.filter("doc_id IN (5, 3, 11)").dropDuplicates(["doc_id"])
    assert similar.kept_rows(own).count() == 3


@pytest.mark.parametrize("block", [similar.BLOCK_SHINGLES, 10_000])
def test_true_pairs_among_many_that_share_a_template(spark, monkeypatch, block):
    """A hundred documents below the threshold around each template, one pair above it: no pair is lost."""
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", block)
    rng, word = random.Random(18), iter(range(10**7))
    rows, pairs = [], []

    def changed(w, n):
        w = list(w)
        for i in rng.sample(range(1, len(w) // 5), n):
            w[5 * i - 1] = f"w{next(word)}"
        return w

    for t in range(10):
        base = [f"w{next(word)}" for _ in range(304)]
        own = [(1000 * t + i, " ".join(changed(base, 11))) for i in range(100)]
        first = changed(base, 12)
        pairs.append((1000 * t + 500, 1000 * t + 501))
        rows += [*own, (1000 * t + 500, " ".join(first)), (1000 * t + 501, " ".join(changed(first, 5)))]
    sets = {i: shingles(x) for i, x in rows}
    assert all(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9 for a, b in pairs)
    assert max(len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, 100)) < 0.8
    got = {r.doc_id: r.component for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got.get(b) == got.get(a) == a for a, b in pairs) == 10


@pytest.mark.parametrize("block", [similar.BLOCK_SHINGLES, 50_000])
def test_copies_of_a_hub_that_is_not_least(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", block)
    rng = random.Random(15)
    word, hub, copies = iter(range(10**7)), 700, 1500
    base = [f"w{next(word)}" for _ in range(504)]  # 500 shingles

    def copy():  # 50 shingles changed: Jaccard 450 / 550 to the base, less than 0.7 to another copy
        w = list(base)
        for i in rng.sample(range(1, 101), 10):
            w[5 * i - 1] = f"w{next(word)}"
        return " ".join(w)

    texts = {i: " ".join(base) if i == hub else copy() for i in range(copies)}
    texts |= {copies + i: " ".join(f"w{next(word)}" for _ in range(200)) for i in range(20)}
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {i for i in texts if len(sets[i] & sets[hub]) >= 0.8 * len(sets[i] | sets[hub])}
    assert near == set(range(copies)) and max(len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, copies) if i != hub) < 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component for r in similar.groups(docs).collect()} == dict.fromkeys(range(copies), 0)


def test_lists_of_rare_shingles_hold_all_similar_pairs(spark, monkeypatch):
    rng = random.Random(20)
    sets = {}
    for t in range(6):
        template = [1000 * t + i for i in range(60)]
        for i in range(30):
            own = rng.sample(template, 56) + [10_000 + 1000 * t + rng.randrange(200) for _ in range(rng.randrange(0, 12))]
            sets[100 * t + i] = sorted(set(own))
    given = spark.createDataFrame(list(sets.items()), "key long, shingles array<int>")
    nodes = spark.createDataFrame([(i, i) for i in sets], "node long, component long")
    similar_pairs = {(a, b) for a, b in combinations(sorted(sets), 2) if (n := len(set(sets[a]) & set(sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    lists = {}
    for r in similar.by_rare_shingles(nodes, given, 0.8).collect():
        lists.setdefault(r.value, set()).add(r.node)
    assert similar_pairs and all(any({a, b} <= found for found in lists.values()) for a, b in similar_pairs)


def test_spanning_connects_what_similar_pairs_connect():
    rng = random.Random(16)
    sets = [np.unique(np.array([rng.randrange(40) + 1000 * (i % 3) for _ in range(30)], np.int32)) for i in range(60)] + [np.zeros(0, np.int32)]
    labels = np.array([i if i % 7 else 0 for i in range(61)])

    def parts(edges):
        root = list(range(61))
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in [*edges, *((i, j) for i, j in combinations(range(61), 2) if labels[i] == labels[j])]:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(61)]

    every = [(i, j) for i, j in combinations(range(61), 2) if (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.5 * (len(sets[i]) + len(sets[j]) - n)]
    got = similar.spanning(sets, labels, 0.5)
    assert set(map(tuple, map(sorted, got))) <= set(every) and parts(got) == parts(every)
    assert 1 < len(set(parts(every))) < 50


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{TINY}/documents.parquet"), []
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "idiot a@b.example.com", "en", "s", 21)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, TINY).cache()
        out.append((name, before, docs))
    return out


def test_stages_keep_columns_and_rows(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert 0 < after.count() <= before.count()
        if name != "pii":
            assert after.exceptAll(before).count() == 0
    by = {n: (b, a) for n, b, a in stages}
    assert by["near_dedup"][1].groupBy("text").count().filter("count > 1").count() == 0
    assert by["pii"][0].count() == by["pii"][1].count() == stages[-1][2].count()
    assert by["pii"][1].filter(F.col("text").contains(".example.com") & F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0


def test_ids_decode_to_the_texts(stages):
    docs, encoded = stages[-1][1], stages[-1][2]
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    vocabulary = bpe.token_bytes(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for r in encoded.collect():
        assert b"".join(vocabulary[i] for i in r.token_ids) == text[r.doc_id]
        assert r.n_tokens == len(r.token_ids)


@pytest.mark.parametrize("size,common", [(90, 80), (300, 267), (1000, 889)])
def test_bands_find_pairs_at_the_threshold(size, common):
    """Of sets with a Jaccard similarity of 0.80, what shares no band is missed as a candidate; measured: fewer than 1 in 1,000."""
    rng, found = np.random.default_rng(size), 0
    for _ in range(1000):
        x = rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        found += bool((similar.bands(x[:size]) == similar.bands(np.concatenate([x[:common], x[size:]]))).any())
    assert found >= 999
