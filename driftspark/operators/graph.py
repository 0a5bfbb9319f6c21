"""Dependency graphs: edges, degrees, hubs, clusters' surfaces, and whole-graph metrics.

``edges`` has repo_id, seq, src, dst; ``vertices`` repo_id, seq, file_path. Counting is done by DataFrame operations.
Cycles, components and shortest paths follow whole graphs. Snapshots of at most ``ONE_TASK`` vertices and edges, a bounded
group, are measured in one task each, so that a history of small repositories takes one job; larger ones by the rounds
of joins in ``reach``, with the same results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed
from ..shipping import ship
from . import reach

SNAPSHOT = ["repo_id", "seq"]
HUB_DEGREE = 3
CYCLE_CAP = 100_000
#: Vertices and edges of a snapshot that one task takes.
ONE_TASK = 50_000


def edges_of(resolved: DataFrame) -> DataFrame:
    """Distinct edges with ``weight``, the number of imports, of resolved imports that leave their file."""
    return resolved.filter("dst IS NOT NULL AND src <> dst").groupBy(*SNAPSHOT, "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def import_counts(resolved: DataFrame) -> DataFrame:
    """Imports that resolve to nothing, and to their own file."""
    return resolved.groupBy(*SNAPSHOT).agg(F.count_if(F.col("dst").isNull()).alias("unresolved_count"), F.count_if(F.col("dst") == F.col("src")).alias("self_import_count"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices, edges, and edges over possible edges (0.0 below two vertices)."""
    n = vertices.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("node_count"))
    m = edges.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("m"))
    both = n.join(m, SNAPSHOT, "left").withColumn("edge_count", F.coalesce("m", F.lit(0)))
    possible = F.col("node_count") * (F.col("node_count") - 1)
    return both.select(*SNAPSHOT, "node_count", "edge_count", F.when(possible > 0, F.col("edge_count") / possible).otherwise(0.0).alias("density"))


def hubs(vertices: DataFrame, edges: DataFrame, least: int = HUB_DEGREE) -> DataFrame:
    """Vertices with an in-degree of at least ``least``, and their share; none below three vertices."""
    degree = edges.groupBy(*SNAPSHOT, F.col("dst").alias("file_path")).agg(F.count(F.lit(1)).alias("degree"))
    of = vertices.join(degree, [*SNAPSHOT, "file_path"], "left")
    is_hub = F.coalesce(F.col("degree") >= least, F.lit(False))
    found = of.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_hub).alias("h"), F.sort_array(F.collect_list(F.when(is_hub, F.col("file_path")))).alias("nodes"))
    large = F.col("n") >= 3
    return found.select(*SNAPSHOT, F.when(large, F.col("h") / F.col("n")).otherwise(0.0).alias("hub_concentration"), F.when(large, F.col("nodes")).otherwise(F.array().cast("array<string>")).alias("hub_nodes"))


def _clustered(edges: DataFrame, partition: DataFrame) -> DataFrame:
    side = lambda c, to: partition.select(*SNAPSHOT, F.col("file_path").alias(c), F.col("cluster").alias(to))
    return edges.join(side("src", "source_cluster"), [*SNAPSHOT, "src"]).join(side("dst", "target_cluster"), [*SNAPSHOT, "dst"])


def inter_cluster_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Distinct edges between each two clusters."""
    crossing = _clustered(edges, partition).filter("source_cluster <> target_cluster")
    return crossing.groupBy(*SNAPSHOT, "source_cluster", "target_cluster").agg(F.count(F.lit(1)).alias("count"))


def surface_area(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Share of crossing edges among all that touch a cluster; 0.0 for clusters without edges."""
    touched = _clustered(edges, partition).select(*SNAPSHOT, (F.col("source_cluster") != F.col("target_cluster")).cast("double").alias("crossing"), F.explode(F.array_distinct(F.array("source_cluster", "target_cluster"))).alias("cluster"))
    ratio = touched.groupBy(*SNAPSHOT, "cluster").agg(F.avg("crossing").alias("ratio"))
    every = partition.select(*SNAPSHOT, "cluster").distinct()
    return every.join(ratio, [*SNAPSHOT, "cluster"], "left").select(*SNAPSHOT, "cluster", F.coalesce("ratio", F.lit(0.0)).alias("surface_area"))


def cluster_count(partition: DataFrame) -> DataFrame:
    return partition.groupBy(*SNAPSHOT).agg(F.countDistinct("cluster").alias("cluster_count"))


def neighbours(pairs: list[tuple]) -> dict:
    out: dict = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    return out


def component_count(nodes: list, pairs: list[tuple]) -> int:
    """Weakly connected components, lone vertices included."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
        root[find(a)] = find(b)
    return sum(1 for n in root if find(n) == n)


def diameter(pairs: list[tuple]) -> int:
    """The longest of all finite shortest directed paths; 0 without edges.

    In round d each vertex has the set of those within d steps, as the bits of an integer, and takes in its successors'
    sets; the last round in which any set grows is the answer.
    """
    follow = neighbours(pairs)
    bit = {v: i for i, v in enumerate(follow)}
    after = [[bit[w] for w in follow[v]] for v in follow]
    within, live, rounds = [1 << i for i in range(len(after))], range(len(after)), 0
    back: list[list[int]] = [[] for _ in after]
    for v, ws in enumerate(after):
        for w in ws:
            back[w].append(v)
    while True:
        grown = {}
        for v in live:
            found = within[v]
            for w in after[v]:
                found |= within[w]
            if found != within[v]:
                grown[v] = found
        if not grown:
            return rounds
        rounds += 1
        for v, found in grown.items():
            within[v] = found
        live = {u for v in grown for u in back[v]}  # only those with a successor that has grown


def strong_components(follow: dict) -> list[set]:
    """Strongly connected components by two depth-first passes, without recursion."""
    order, seen = [], set()
    for start in follow:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(follow[start]))]
        while stack:
            v, rest = stack[-1]
            nxt = next((w for w in rest if w not in seen), None)
            if nxt is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(follow[nxt])))
    back: dict = {v: set() for v in follow}
    for v, ws in follow.items():
        for w in ws:
            back[w].add(v)
    out, done = [], set()
    for start in reversed(order):
        if start in done:
            continue
        group, stack = {start}, [start]
        done.add(start)
        while stack:
            for w in back[stack.pop()]:
                if w not in done:
                    done.add(w)
                    group.add(w)
                    stack.append(w)
        out.append(group)
    return out


def cycle_count(pairs: list[tuple], cap: int | None = CYCLE_CAP) -> tuple[int, bool]:
    """Elementary directed cycles, and whether counting stopped at ``cap`` (None: never).

    In each strong component, cycles are counted at their smallest vertex: simple paths from it through larger vertices
    of what is still strongly connected, as in Johnson's algorithm.
    """
    follow, n = neighbours(pairs), 0
    work = [c for c in strong_components(follow) if len(c) > 1]
    while work:
        group = work.pop()
        start = min(group)
        inside = {v: sorted(follow[v] & group) for v in group}
        blocked, waits = {start}, {}
        stack = [(start, iter(inside[start]), [False])]

        def free(v) -> None:
            todo = [v]
            while todo:
                u = todo.pop()
                if u in blocked:
                    blocked.discard(u)  # noqa: B023
                    todo.extend(waits.pop(u, ()))  # noqa: B023

        while stack:
            v, rest, closed = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if closed[0]:
                    free(v)
                    if stack:
                        stack[-1][2][0] = True
                else:
                    for u in inside[v]:
                        waits.setdefault(u, set()).add(v)
            elif w == start:
                closed[0] = True
                n += 1
                if n == cap:
                    return n, True
            elif w not in blocked:
                blocked.add(w)
                stack.append((w, iter(inside[w]), [False]))
        rest_of = group - {start}
        work += [c for c in strong_components({v: follow[v] & rest_of for v in rest_of}) if len(c) > 1]
    return n, False


def _per_snapshot(vertices: DataFrame, edges: DataFrame, schema: str, measure) -> DataFrame:
    """``measure(vertices, pairs)`` -> values, for the graph of each snapshot."""
    rows = vertices.select(*SNAPSHOT, F.col("file_path").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select(*SNAPSHOT, "src", "dst"))
    columns = ["repo_id", "seq", *[c.split()[0] for c in schema.split(", ")]]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, some = rows.src[rows.dst.isna()].tolist(), rows[rows.dst.notna()]
        return pd.DataFrame([(*key, *measure(nodes, list(zip(some.src, some.dst, strict=True))))], columns=columns)

    ship(vertices.sparkSession)
    return rows.groupBy(*SNAPSHOT).applyInPandas(run, f"repo_id string, seq long, {schema}")


def by_size(vertices: DataFrame, edges: DataFrame, one_task: int, small, large) -> DataFrame:
    """``small(vertices, edges)`` for snapshots of at most ``one_task`` vertices and edges, ``large`` for the others."""
    if one_task <= 0:
        return large(vertices, edges)
    sizes = vertices.select(*SNAPSHOT).unionByName(edges.select(*SNAPSHOT)).groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n"))
    wide = checkpointed(sizes.filter(F.col("n") > one_task).select(*SNAPSHOT))
    if wide.isEmpty():
        return small(vertices, edges)
    some = lambda df, how: df.join(wide, SNAPSHOT, how)
    return small(some(vertices, "left_anti"), some(edges, "left_anti")).unionByName(large(some(vertices, "left_semi"), some(edges, "left_semi")))


def structure(vertices: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Weak components and the directed diameter of each snapshot's graph."""

    def large(vertices: DataFrame, edges: DataFrame) -> DataFrame:
        names, links = reach.as_numbers(vertices, edges)
        return reach.component_counts(names, links).join(reach.depths(names, links), SNAPSHOT)

    small = lambda v, e: _per_snapshot(v, e, "component_count long, max_depth long", lambda nodes, pairs: (component_count(nodes, pairs), diameter(pairs)))
    return by_size(vertices, edges, one_task, small, large)


def cycles(vertices: DataFrame, edges: DataFrame, cap: int | None = CYCLE_CAP, one_task: int = ONE_TASK) -> DataFrame:
    """Elementary cycles of each snapshot's graph, and whether counting stopped at ``cap``.

    Their number can grow exponentially with the graph, so the exact count, with ``cap`` None, may take forever; as
    ``coupling`` takes at most one cycle per vertex, it is exact all the same while a graph has at most ``cap`` vertices.
    """

    def large(vertices: DataFrame, edges: DataFrame) -> DataFrame:
        return reach.cycle_counts(*reach.as_numbers(vertices, edges), cap)

    small = lambda v, e: _per_snapshot(v, e, "cycle_count long, cycle_count_capped boolean", lambda nodes, pairs: cycle_count(pairs, cap))
    return by_size(vertices, edges, one_task, small, large)


def whole_graph(vertices: DataFrame, edges: DataFrame, cap: int | None = CYCLE_CAP, one_task: int = ONE_TASK) -> DataFrame:
    """Components, directed diameter and elementary cycles of each snapshot's graph."""

    def large(vertices: DataFrame, edges: DataFrame) -> DataFrame:
        names, links = reach.as_numbers(vertices, edges)
        return reach.component_counts(names, links).join(reach.depths(names, links), SNAPSHOT).join(reach.cycle_counts(names, links, cap), SNAPSHOT)

    measure = lambda nodes, pairs: (component_count(nodes, pairs), diameter(pairs), *cycle_count(pairs, cap))
    small = lambda v, e: _per_snapshot(v, e, "component_count long, max_depth long, cycle_count long, cycle_count_capped boolean", measure)
    return by_size(vertices, edges, one_task, small, large)
