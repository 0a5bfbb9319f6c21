"""Communities by rounds of joins: planted ones are found, quality is that of the algorithm in one task, labels are taken over."""

import random

import pytest

from driftspark.operators import communities, leiden

KEY = "repo_id string, seq long, "


def as_tables(spark, graphs):
    vertices = [(name, 0, f"f{v:03}", b[v] if b else None) for name, n, _, b in graphs for v in range(n)]
    edges = [(name, 0, f"f{a:03}", f"f{c:03}") for name, _, es, _ in graphs for a, c in es]
    return spark.createDataFrame(vertices, KEY + "file_path string, before long"), spark.createDataFrame(edges, KEY + "src string, dst string")


def planted(rng, groups, size, inner, outer):
    n = groups * size
    own = {(v, v - v % size + rng.randrange(size)) for v in range(n) for _ in range(inner)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(outer)}
    return n, sorted((a, b) for a, b in own if a != b)


def members(found):
    out = {}
    for r in found.collect():
        out.setdefault((r.repo_id, r.cluster), set()).add(int(r.file_path[1:]))
    return out


def test_planted_communities_small_graphs_and_lone_vertices(spark):
    rng = random.Random(2)
    n, es = planted(rng, 4, 12, 5, 8)
    cliques = [(b + i, b + j) for b in (0, 6, 12) for i in range(6) for j in range(6) if i != j] + [(0, 6), (7, 13)]
    star = [(i, 0) for i in range(1, 9)] + [(i, 9) for i in range(10, 18)]
    vertices, edges = as_tables(spark, [("p", n, es, None), ("c", 20, cliques, None), ("few", 5, [(0, 1)], None), ("star", 18, star, None), ("none", 11, [], None)])
    got = members(communities.communities(vertices.drop("before"), edges))
    assert sorted(map(sorted, (v for (r, _), v in got.items() if r == "p"))) == [list(range(b, b + 12)) for b in range(0, 48, 12)]
    assert {(c, frozenset(v)) for (r, c), v in got.items() if r == "c"} == {(0, frozenset(range(6))), (1, frozenset(range(6, 12))), (2, frozenset(range(12, 18))), (3, frozenset({18})), (4, frozenset({19}))}
    assert {(c, frozenset(v)) for (r, c), v in got.items() if r == "few"} == {(0, frozenset(range(5)))}
    assert {frozenset(v) for (r, _), v in got.items() if r == "star"} == {frozenset(range(9)), frozenset(range(9, 18))}
    assert sum(1 for r, _ in got if r == "none") == 11


@pytest.mark.parametrize("gamma", [1.0, 2.0])
def test_quality_is_within_a_hundredth_of_one_task(spark, gamma):
    rng = random.Random(8)
    n, es = planted(rng, 6, 12, 3, 60)
    vertices, edges = as_tables(spark, [("r", n, es, None)])
    vertices = vertices.drop("before")
    quality = lambda found: leiden.modularity(edges, found, gamma).first().modularity
    own, other = quality(communities.communities(vertices, edges, gamma)), quality(leiden.communities(vertices, edges, gamma, one_task=1 << 40))
    assert own >= other - 0.01 * abs(other)


def test_labels_are_taken_over_as_in_one_walk(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(6):
        now = {f"f{v:03}": rng.randrange(5) for v in range(40)}
        before = {f: rng.randrange(9) for f in now if rng.random() < 0.8} if k else {}
        rows += [(f"r{k}", 0, f, c, before.get(f), len(before)) for f, c in now.items()]
        want |= {(f"r{k}", f): c for f, c in (leiden.relabelled(now, before) if before else now).items()}
    found = spark.createDataFrame(rows, KEY + "file_path string, comm long, before long, n_before long")
    got = {(r.repo_id, r.file_path): r.cluster for r in communities.labelled(found).collect()}
    taken = {k for k in want if k[0] != "r0"}
    old = {k: want[k] for k in taken if want[k] <= 8}
    assert old and all(got[k] == c for k, c in old.items())
    assert all(got[k] > 8 for k in taken - set(old)) or not taken - set(old)
    first = sorted({c: min(f for f, x in ((f, c2) for (r, f), c2 in want.items() if r == "r0") if x == c) for c in set(want[k] for k in want if k[0] == "r0")}.items(), key=lambda x: x[1])
    number = {c: i for i, (c, _) in enumerate(first)}
    assert all(got[k] == number[c] for k, c in want.items() if k[0] == "r0")


def test_a_start_from_clusters_before(spark):
    n, es = planted(random.Random(5), 3, 10, 5, 3)
    vertices, edges = as_tables(spark, [("r", n, es, [7 - v // 10 if v != 3 else None for v in range(n)])])
    got = {int(r.file_path[1:]): r.cluster for r in communities.communities(vertices, edges).collect()}
    assert got == {v: 7 - v // 10 for v in range(n)}
