"""Whole-graph measures by rounds of joins against those of one task, on graphs of many shapes."""

import random

import pytest

from driftspark.operators import graph, reach

KEY = "repo_id string, seq long, "


def shapes(rng):
    """Rings, chains, cliques, stars, trees and random graphs, as (vertices, edges)."""
    out = [(0, []), (1, []), (5, []), (12, [(i, (i + 1) % 12) for i in range(12)]), (10, [(i, i + 1) for i in range(9)])]
    out += [(5, [(a, b) for a in range(5) for b in range(5) if a != b]), (20, [(i, 0) for i in range(1, 20)] + [(0, 7)]), (15, [((i - 1) // 2, i) for i in range(1, 15)])]
    out += [(9, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (6, 7)])]
    for _ in range(8):
        n = rng.randrange(4, 14)
        out.append((n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2, 2 * n))]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    graphs = shapes(random.Random(3))
    vertices = spark.createDataFrame([(f"r{i % 5}", i, f"f{v:02}") for i, (n, _) in enumerate(graphs) for v in range(n)], KEY + "file_path string")
    edges = spark.createDataFrame([(f"r{i % 5}", i, f"f{a:02}", f"f{b:02}") for i, (_, es) in enumerate(graphs) for a, b in es], KEY + "src string, dst string")
    return graphs, vertices.cache(), edges.cache()


def strong(n, pairs):
    to = [[a == b for b in range(n)] for a in range(n)]
    for a, b in pairs:
        to[a][b] = True
    for k in range(n):
        for a in range(n):
            for b in range(n):
                to[a][b] = to[a][b] or (to[a][k] and to[k][b])
    parts = {frozenset(b for b in range(n) if to[a][b] and to[b][a]) for a in range(n)}
    return {p for p in parts if len(p) > 1}


def test_measures_equal_those_of_one_task(spark, tables):
    graphs, vertices, edges = tables
    found = {r.seq: r for r in graph.whole_graph(vertices, edges, one_task=0).collect()}
    assert set(found) == {i for i, (n, _) in enumerate(graphs) if n}
    for i, (n, pairs) in enumerate(graphs):
        if n:
            pairs = [(a, b) for a, b in pairs if a != b]
            want = (graph.component_count(list(range(n)), pairs), graph.diameter(pairs), *graph.cycle_count(pairs))
            assert (found[i].component_count, found[i].max_depth, found[i].cycle_count, found[i].cycle_count_capped) == want
    mixed = {r.seq: (r.component_count, r.max_depth) for r in graph.structure(vertices, edges, one_task=20).collect()}
    assert mixed == {i: (r.component_count, r.max_depth) for i, r in found.items()}


@pytest.mark.parametrize("one_task", [0, reach.ONE_TASK])
def test_strong_components_take_few_rounds(spark, monkeypatch, one_task):
    rng, n, ring = random.Random(5), 150 if one_task else 40, 30 if one_task else 6
    links = {(a, (a + 1) % ring if a < ring else rng.randrange(n)) for a in range(n)}
    links = [(a, b) for a, b in links if a != b]
    tables, keep = [], reach.saved
    monkeypatch.setattr(reach, "ONE_TASK", one_task)
    monkeypatch.setattr(reach, "saved", lambda df: tables.append(1) or keep(df))
    parts = {}
    for r in reach.strong_components(spark.createDataFrame(links, "a long, b long")).collect():
        parts.setdefault(r.component, set()).add(r.v)
    assert {frozenset(p) for p in parts.values()} == strong(n, links) and all(c == max(p) for c, p in parts.items())
    assert not one_task or len(tables) < 30  # a ring of 30 took more


def test_strong_components_equal_closure(spark, tables):
    graphs, vertices, edges = tables
    names, links = reach.as_numbers(vertices, edges)
    of = {r.v: (r.seq, int(r.file_path[1:])) for r in names.collect()}
    assert sorted(of) == list(range(len(of))) and [of[v] for v in sorted(of)] == [(r.seq, int(r.file_path[1:])) for r in names.orderBy("repo_id", "seq", "file_path").collect()]
    parts = {}
    for r in reach.strong_components(links).collect():
        parts.setdefault(r.component, set()).add(r.v)
    got = {(of[c][0], frozenset(of[v][1] for v in vs)) for c, vs in parts.items()}
    assert got == {(i, p) for i, (n, es) in enumerate(graphs) for p in strong(n, es)}


def test_depths_by_small_blocks_of_sources(spark, monkeypatch):
    rng = random.Random(4)
    graphs = {0: (200, [(i, i + 1) for i in range(199)]), 1: (150, [(rng.randrange(150), rng.randrange(150)) for _ in range(400)]), 2: (3, [])}
    vertices = spark.createDataFrame([("r", i, f"f{v:03}") for i, (n, _) in graphs.items() for v in range(n)], KEY + "file_path string")
    edges = spark.createDataFrame([("r", i, f"f{a:03}", f"f{b:03}") for i, (_, es) in graphs.items() for a, b in es], KEY + "src string, dst string")
    monkeypatch.setattr(reach, "NEAR", 2)
    found = reach.farthest(*reach.as_numbers(vertices, edges), block_bytes=1).collect()
    assert len(found) == 4 + 3 + 1  # blocks of 64 sources
    got = {}
    for r in found:
        got[r.seq] = max(got.get(r.seq, 0), r["round"])
    assert got == {i: graph.diameter([(a, b) for a, b in es if a != b]) for i, (_, es) in graphs.items()}


def test_caps_and_empty_graphs(spark, tables):
    _, vertices, edges = tables
    clique = edges.filter("seq = 5")
    row = graph.cycles(vertices.filter("seq = 5"), clique, cap=50, one_task=0).first()
    assert (row.cycle_count, row.cycle_count_capped) == (50, True)
    row = graph.cycles(vertices.filter("seq = 5"), clique, cap=None, one_task=0).first()
    assert (row.cycle_count, row.cycle_count_capped) == (84, False)
    assert graph.whole_graph(vertices.limit(0), edges.limit(0), one_task=0).count() == 0
