"""Communities of a directed graph by the Leiden algorithm (Traag, Waltman and van Eck 2019).

The quality is that of the Reichardt-Bornholdt configuration model for directed graphs: edges within communities minus
gamma times what in- and out-degrees let expect. Nodes move locally, communities are refined into well-connected parts,
parts become nodes of the next level. Ties and the order of visits follow a seeded generator, so runs repeat exactly.
A graph of at most ``ONE_TASK`` vertices and edges is one group of ``applyInPandas``; larger ones are clustered by the
rounds of joins in ``communities``, to the same quality.
"""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SMALLEST = 10  # smaller graphs are one cluster
#: Vertices and edges of a snapshot that one task takes.
ONE_TASK = 500_000
Graph = tuple[list[dict[int, float]], list[dict[int, float]]]


def _local_move(out: list[dict], into: list[dict], member: list[int], gamma: float, rng: random.Random, within: list[int] | None = None) -> bool:
    """Moves nodes to the neighbouring community with the best gain, until none gains; in place.

    ``within``: nodes may only join others with the same value.
    """
    n, m = len(out), sum(map(sum, (d.values() for d in out)))
    if not m:
        return False
    k_out, k_in = [sum(d.values()) for d in out], [sum(d.values()) for d in into]
    total_out, total_in, size = [0.0] * n, [0.0] * n, [0] * n
    for v, c in enumerate(member):
        total_out[c] += k_out[v]
        total_in[c] += k_in[v]
        size[c] += 1
    order = list(range(n))
    rng.shuffle(order)
    queue, waiting, moved = deque(order), set(order), False
    free = [c for c in range(n - 1, -1, -1) if not size[c]]  # the least is taken first
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        own = member[v]
        links: dict[int, float] = {}
        for side in (out[v], into[v]):
            for w, x in side.items():
                if w != v and (within is None or within[w] == within[v]):
                    links[member[w]] = links.get(member[w], 0.0) + x
        total_out[own] -= k_out[v]
        total_in[own] -= k_in[v]
        gain = lambda c: links.get(c, 0.0) - gamma * (k_out[v] * total_in[c] + k_in[v] * total_out[c]) / m  # noqa: B023, E731
        best, best_gain = own, gain(own)
        for c in sorted(links):
            if c != own and gain(c) > best_gain + 1e-12:
                best, best_gain = c, gain(c)
        if best_gain < -1e-12 and free:
            best = free[-1]
        total_out[best] += k_out[v]
        total_in[best] += k_in[v]
        if best != own:
            member[v], moved = best, True
            if not size[best]:
                free.pop()
            size[own] -= 1
            size[best] += 1
            if not size[own]:
                free.append(own)
            for w in sorted({*out[v], *into[v]}):
                if member[w] != best and w not in waiting and w != v:
                    waiting.add(w)
                    queue.append(w)
    return moved


def _renumber(member: list[int]) -> list[int]:
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in member]


def _condense(out: list[dict], part: list[int]) -> Graph:
    n = max(part) + 1
    new_out: list[dict] = [{} for _ in range(n)]
    new_in: list[dict] = [{} for _ in range(n)]
    for v, d in enumerate(out):
        for w, x in d.items():
            a, b = part[v], part[w]
            new_out[a][b] = new_out[a].get(b, 0.0) + x
            new_in[b][a] = new_in[b].get(a, 0.0) + x
    return new_out, new_in


def leiden(n: int, edges: list[tuple[int, int]], gamma: float = 1.0, seed: int = 42, initial: list[int] | None = None) -> list[int]:
    """The community of each of ``n`` nodes."""
    rng = random.Random(seed)
    out: list[dict] = [{} for _ in range(n)]
    into: list[dict] = [{} for _ in range(n)]
    for a, b in edges:
        out[a][b] = into[b][a] = 1.0
    of_node, member = list(range(n)), _renumber(initial) if initial else list(range(n))
    while True:
        _local_move(out, into, member, gamma, rng)
        member = _renumber(member)
        if len(set(member)) == len(out):
            break
        part = list(range(len(out)))  # refined: parts stay inside communities
        _local_move(out, into, part, gamma, rng, within=member)
        part = _renumber(part)
        if len(set(part)) == len(out):
            break
        of_part = [0] * (max(part) + 1)
        for v, p in enumerate(part):
            of_part[p] = member[v]
        of_node = [part[v] for v in of_node]
        out, into = _condense(out, part)
        member = of_part
    return _renumber([member[v] for v in of_node])


def relabelled(now: dict[str, int], before: dict[str, int]) -> dict[str, int]:
    """Cluster labels taken over from the previous run by greatest overlap; new clusters get new ones."""
    overlap: dict[tuple[int, int], int] = {}
    for f, c in now.items():
        if f in before:
            overlap[before[f], c] = overlap.get((before[f], c), 0) + 1
    names, used = {}, set()
    for (old, new), _ in sorted(overlap.items(), key=lambda x: (-x[1], x[0])):
        if new not in names and old not in used:
            names[new] = old
            used.add(old)
    spare = max([-1, *before.values()]) + 1
    for c in sorted(set(now.values())):
        if c not in names:
            names[c], spare = spare, spare + 1
    return {f: names[c] for f, c in now.items()}


def communities(vertices: DataFrame, edges: DataFrame, gamma: float = 1.0, seed: int = 42, relabel: bool = True, one_task: int = ONE_TASK) -> DataFrame:
    """(repo_id, seq, file_path, cluster); ``vertices`` may have ``before``, the clusters of the previous snapshot.

    Graphs of fewer than ten vertices are one cluster.
    """
    from . import communities as rounds
    from .graph import by_size

    small = lambda v, e: _in_one_task(v, e, gamma, seed, relabel)
    return by_size(vertices, edges, one_task, small, lambda v, e: rounds.communities(v, e, gamma, seed, relabel))


def _in_one_task(vertices: DataFrame, edges: DataFrame, gamma: float, seed: int, relabel: bool) -> DataFrame:
    if "before" not in vertices.columns:
        vertices = vertices.withColumn("before", F.lit(None).cast("long"))
    rows = vertices.select("repo_id", "seq", F.col("file_path").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("before").cast("double").alias("before"))
    rows = rows.unionByName(edges.select("repo_id", "seq", "src", "dst", F.lit(None).cast("double").alias("before")))

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows.dst.isna()].sort_values("src")
        names = nodes.src.tolist()
        index = {f: i for i, f in enumerate(names)}
        before = {f: int(b) for f, b in zip(nodes.src, nodes.before, strict=True) if b == b}
        pairs = sorted({(index[a], index[b]) for a, b in zip(rows.src, rows.dst, strict=True) if b in index and a in index and a != b})
        if len(names) < SMALLEST:
            found = dict.fromkeys(names, 0)
        else:
            found = dict(zip(names, leiden(len(names), pairs, gamma, seed, [before.get(f, 0) for f in names] if before else None), strict=True))
            found = relabelled(found, before) if before and relabel else found
        return pd.DataFrame({"repo_id": key[0], "seq": key[1], "file_path": names, "cluster": [found[f] for f in names]})

    ship(vertices.sparkSession)
    return rows.groupBy("repo_id", "seq").applyInPandas(cluster, "repo_id string, seq long, file_path string, cluster long")


def modularity(edges: DataFrame, partition: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(repo_id, seq, modularity): the share of edges within clusters less what in- and out-degrees let expect."""
    key = ["repo_id", "seq"]
    side = lambda c, to: partition.select(*key, F.col("file_path").alias(c), F.col("cluster").alias(to))
    placed = edges.select(*key, "src", "dst").join(side("src", "a"), [*key, "src"]).join(side("dst", "b"), [*key, "dst"])
    total = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    leaving = placed.groupBy(*key, F.col("a").alias("cluster")).agg(F.count(F.lit(1)).alias("k_out"))
    entering = placed.groupBy(*key, F.col("b").alias("cluster")).agg(F.count(F.lit(1)).alias("k_in"))
    expected = leaving.join(entering, [*key, "cluster"]).groupBy(*key).agg(F.sum(F.col("k_out").cast("double") * F.col("k_in")).alias("expected"))
    found = total.join(expected, key, "left")
    return found.select(*key, (F.col("inside") / F.col("m") - gamma * F.coalesce("expected", F.lit(0.0)) / F.col("m") / F.col("m")).alias("modularity"))
