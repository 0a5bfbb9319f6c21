"""SimHash: fingerprints, links and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftspark.llm import components, simhash


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def close(a, b):
    return (a ^ b).bit_count() <= 2


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "One", "one TWO", "a\x0bb\x0cc d e", "É é É é"] + [" ".join(rng.choice("abcdÉ") for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


def clustered(rng, n, bits):
    base = [rng.getrandbits(64) for _ in range(5)]
    return sorted({rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(bits))) for _ in range(n)})


@pytest.mark.parametrize("bucket,masks", [(512, None), (3, None), (0, None), (512, "two"), (4, "two"), (512, "one")])
def test_links_lose_nothing(spark, bucket, masks):
    rng = random.Random(5)
    values = clustered(rng, 120, 7)
    plan = None
    if masks:
        groups, chosen = ([list(range(20)), list(range(20, 64))], [1, 0]) if masks == "two" else ([list(range(64))], [2])
        bit = lambda c: sum(1 << (63 - b) for b in c)
        plan = simhash.Layout([bit(g) for g in groups], [[bit(c) for k in range(t + 1) for c in combinations(g, k)] for g, t in zip(groups, chosen, strict=True)], 0)
    nodes = spark.createDataFrame([(i, simhash.signed(v)) for i, v in enumerate(values)], "node long, fp long")
    got = {(r.u, r.v) for r in simhash.links(nodes, bucket=bucket, plan=plan).collect()}
    true = {(i, j) for (i, a), (j, b) in combinations(enumerate(values), 2) if close(a, b)}
    assert all(tuple(sorted(p)) in true for p in got)
    assert union(got, range(len(values))) == union(true, range(len(values)))


def test_thresholds_keep_the_principle():
    rng = np.random.default_rng(0)
    for parts in (1, 2, 3):
        for _ in range(20):
            costs = [[0.0, *np.cumsum(rng.random(3))] for _ in range(parts)]
            _, chosen = simhash.thresholds(costs, 2)
            assert sum(chosen) == 2 - parts + 1
    both = np.full((64, 64), 25) + np.eye(64, dtype=int) * 25
    groups = simhash.group_bits(100, both, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert len(simhash.layout(10**5, both * 1000, 2).masks) == 3
    assert len(simhash.layout(10**12, both * 10**10, 2).masks) < 3


def test_documents(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(120)) for _ in range(6)]
    texts = [*base, *base, None, "", " "]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts)] + [(None, base[0], "x"), (0, base[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(4)
    prints = [(k, slow_fingerprint(t)) for k, t, _ in rows]
    keyed = [(k, f) for k, f in prints if k is not None]
    roots = union([(a, b) for (a, f), (b, g) in combinations(keyed, 2) if close(f, g)], {k for k, _ in keyed})
    want = sorted((str(k), f, roots[k if k is not None else next(j for j, g in keyed if g == f)]) for k, f in prints)
    for bucket in (512, 1):
        got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs, bucket=bucket).collect())
        assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    proper = [e for e in edges if e[0] != e[1]]
    assert got == union(proper, {n for e in proper for n in e})


def test_few_edges_are_settled_in_one_task(spark, monkeypatch):
    rng = random.Random(17)
    edges = [(rng.randrange(-60, 90), rng.randrange(-60, 90)) for _ in range(70)] + [(300 - i, 299 - i) for i in range(70)] + [(7, 7)]
    proper = [e for e in edges if e[0] != e[1]]
    want = union(proper, {n for e in proper for n in e})
    rows = spark.createDataFrame(edges, "u long, v long")
    sets = rows.select(*(F.struct((F.col(c) % 2 == 0).alias("a"), F.when(F.col(c) % 3 != 0, F.col(c)).alias("b"), F.col(c).alias("c")).alias(c) for c in ("u", "v")))
    spark.sparkContext.setJobGroup("few", "few")
    got = {r.node: r.component for r in components.components(rows).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("other", "other")
    assert got == want and jobs <= 8
    one = sorted(map(str, components.components(sets).collect()))
    assert components.components(rows.limit(0)).count() == 0
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {r.node: r.component for r in components.components(rows).collect()} == want
    assert sorted(map(str, components.components(sets).collect())) == one
