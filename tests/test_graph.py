"""Graph metrics and communities on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from driftspark.operators import graph, leiden

CASES = [
    # vertices, edges, density, cycles, components, depth
    (3, [(a, b) for a in range(3) for b in range(3) if a != b], 1.0, 5, 1, 1),
    (2, [(0, 1)], 0.5, 0, 1, 1),
    (4, [(0, 1), (1, 2), (2, 3)], 0.25, 0, 1, 3),
    (4, [(0, 1), (0, 2), (1, 3), (2, 3)], 1 / 3, 0, 1, 2),
    (3, [(0, 1), (1, 2), (2, 0)], 0.5, 1, 1, 2),
    (4, [(0, 1), (1, 0), (2, 3), (3, 2)], 1 / 3, 2, 2, 1),
    (3, [], 0.0, 0, 3, 0),
    (5, [(i, i + 1) for i in range(4)], 0.2, 0, 1, 4),
    (3, [(0, 1), (1, 2), (0, 2)], 0.5, 0, 1, 1),  # the longest shortest path, not the longest chain
    (5, [(a, b) for a in range(5) for b in range(5) if a != b], 1.0, 84, 1, 1),
]


@pytest.mark.parametrize("n,edges,_,cycles,components,depth", CASES)
def test_whole_graph_functions(n, edges, _, cycles, components, depth):
    assert graph.cycle_count(edges) == (cycles, False)
    assert graph.component_count(list(range(n)), edges) == components
    assert graph.diameter(edges) == depth


def test_cycles_equal_brute_force_and_stop_at_the_cap():
    rng = random.Random(1)

    def brute(edges):
        follow = graph.neighbours(edges)

        def walk(start, v, seen):
            return sum(1 if w == start else walk(start, w, seen | {w}) if w > start and w not in seen else 0 for w in follow.get(v, ()))

        return sum(walk(v, v, {v}) for v in follow)

    for _ in range(60):
        edges = list({(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(4, 26))})
        assert graph.cycle_count(edges)[0] == brute([e for e in edges if e[0] != e[1]])
    assert graph.cycle_count([(a, b) for a in range(8) for b in range(8)], cap=50) == (50, True)


def test_tables_of_many_graphs(spark):
    names = [(f"r{i}", v) for i, c in enumerate(CASES) for v in range(c[0])]
    vertices = spark.createDataFrame([(r, 0, str(v)) for r, v in names], "repo_id string, seq long, file_path string")
    edges = spark.createDataFrame([(f"r{i}", 0, str(a), str(b)) for i, c in enumerate(CASES) for a, b in c[1]], "repo_id string, seq long, src string, dst string")
    dense = {r.repo_id: r.density for r in graph.density(vertices, edges).collect()}
    found = {r.repo_id: r for r in graph.whole_graph(vertices, edges).collect()}
    for i, (_, _, density, cycles, components, depth) in enumerate(CASES):
        assert dense[f"r{i}"] == pytest.approx(density)
        assert (found[f"r{i}"].cycle_count, found[f"r{i}"].component_count, found[f"r{i}"].max_depth) == (cycles, components, depth)


def test_hubs(spark):
    star = [(i, 0) for i in (1, 2, 3, 4)]
    vertices = spark.createDataFrame([("s", 0, str(v)) for v in range(5)] + [("t", 0, str(v)) for v in range(2)], "repo_id string, seq long, file_path string")
    edges = spark.createDataFrame([("s", 0, str(a), str(b)) for a, b in star] + [("t", 0, "0", "1")], "repo_id string, seq long, src string, dst string")
    got = {r.repo_id: (r.hub_concentration, r.hub_nodes) for r in graph.hubs(vertices, edges).collect()}
    assert got == {"s": (0.2, ["0"]), "t": (0.0, [])}


RINGS = [(b + i, b + (i + 1) % 4) for b in (0, 4, 8) for i in range(4)] + [(3, 4), (7, 8)]


def test_leiden():
    found = leiden.leiden(12, RINGS)
    assert found == leiden.leiden(12, RINGS)
    assert len(set(found)) == 3 and all(len(set(found[b : b + 4])) == 1 for b in (0, 4, 8))
    assert len(set(leiden.leiden(12, RINGS, 5.0))) >= len(set(leiden.leiden(12, RINGS, 0.5)))
    assert leiden.leiden(12, RINGS, initial=found) == found
    assert leiden.relabelled({"a": 0, "b": 0, "c": 1}, {"a": 7, "b": 7, "c": 3}) == {"a": 7, "b": 7, "c": 3}


def test_communities(spark):
    vertices = spark.createDataFrame([("r", 0, f"{v:02}") for v in range(12)] + [("few", 0, str(v)) for v in range(5)], "repo_id string, seq long, file_path string")
    edges = spark.createDataFrame([("r", 0, f"{a:02}", f"{b:02}") for a, b in RINGS] + [("few", 0, "0", "1")], "repo_id string, seq long, src string, dst string")
    counts = {r.repo_id: r.cluster_count for r in graph.cluster_count(leiden.communities(vertices, edges)).collect()}
    assert counts == {"r": 3, "few": 1}
    ratio = {r.cluster: r.surface_area for r in graph.surface_area(edges.filter("repo_id = 'r'"), leiden.communities(vertices, edges).filter(F.col("repo_id") == "r")).collect()}
    assert sorted(ratio.values()) == pytest.approx([1 / 5, 1 / 5, 2 / 6])
