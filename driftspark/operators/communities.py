"""Communities of directed graphs of any size, as rounds of joins and aggregations.

The quality is that of ``leiden``: edges within communities minus gamma times what in- and out-degrees let expect. All
snapshots' graphs are worked on at once. A level has three parts, as in the Leiden algorithm:

Local moving. Communities' in- and out-degrees are a table of their own. A round sums each node's edges by the
communities of its neighbours, joins the totals, and proposes the move of greatest gain. Moves that rely on each other
(one goes where a neighbour leaves) are not made together: of two such neighbours the one with the higher random
priority of this round moves. Rounds go on until nothing gains, or quality stops growing, or ``ROUNDS`` are over; the
best round's communities stay.

Refinement. Within its community every node starts alone and may only join parts of the same community.

Contraction. Parts become nodes, with their sums of edges and degrees; their communities are where the next level starts.

Levels go on until refinement joins nothing. Then new communities take over labels by greatest overlap with those of the
run before, where ``vertices`` have ``before``: of all pairs by (overlap, old, new), the first that shares neither side
with an earlier one. A pair that is the first of both its sides is settled at once, so a few rounds of two aggregations
do what a walk over the sorted pairs would.

Graphs of fewer than ``leiden.SMALLEST`` vertices are one community. Results repeat for equal tables and ``seed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import saved
from .leiden import SMALLEST
from .reach import SNAPSHOT, as_numbers

ROUNDS = 24
LEVELS = 12
LEAST_GAIN = 1e-9


def _totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("comm").agg(F.sum("k_out").alias("t_out"), F.sum("k_in").alias("t_in"))


def _quality(nodes: DataFrame, links: DataFrame, gamma: float) -> float:
    """The sum over snapshots of edges within communities over all, less gamma times what degrees let expect."""
    side = nodes.select("node", "comm", "m")
    inside = links.join(side, "node").join(side.select(F.col("node").alias("other"), F.col("comm").alias("c")), "other").filter("comm = c").agg(F.sum(F.col("x") / F.col("m") / 2)).first()[0]
    expected = nodes.groupBy("comm", "m").agg((F.sum("k_out") * F.sum("k_in")).alias("e")).agg(F.sum(F.col("e") / F.col("m") / F.col("m"))).first()[0]
    return (inside or 0.0) - gamma * (expected or 0.0)


def _proposals(nodes: DataFrame, links: DataFrame, gamma: float) -> DataFrame:
    """(node, own, best) of the nodes that gain by a move to ``best``; a community of one's own is numbered -1 - node."""
    zero = F.lit(0.0).alias("x")
    near = links.join(nodes.select(F.col("node").alias("other"), "comm"), "other").select("node", "comm", "x")
    stay = nodes.select("node", "comm", zero)
    alone = nodes.select("node", (-1 - F.col("node")).alias("comm"), zero)
    choices = near.unionByName(stay).unionByName(alone).groupBy("node", "comm").agg(F.sum("x").alias("x"))
    scored = choices.join(nodes.select("node", F.col("comm").alias("own"), "k_out", "k_in", "m"), "node").join(_totals(nodes), "comm", "left").na.fill(0.0, ["t_out", "t_in"])
    at_home = (F.col("comm") == F.col("own")).cast("double")
    expected = (F.col("k_out") * (F.col("t_in") - at_home * F.col("k_in")) + F.col("k_in") * (F.col("t_out") - at_home * F.col("k_out"))) / F.col("m")
    gain = F.col("x") - gamma * expected
    best = scored.select("node", "own", "comm", gain.alias("gain")).groupBy("node", "own").agg(
        F.max(F.struct("gain", (-F.col("comm")).alias("c"))).alias("best"), F.max(F.when(F.col("comm") == F.col("own"), F.col("gain"))).alias("now")
    )
    return best.filter(F.col("best.gain") > F.col("now") + LEAST_GAIN).select("node", "own", (-F.col("best.c")).alias("best"))


def _moved(nodes: DataFrame, links: DataFrame, gamma: float, seed: int) -> DataFrame | None:
    """The nodes after one round of moves; None where no node gains."""
    wanted = saved(_proposals(nodes, links, gamma))
    if wanted.isEmpty():
        return None
    rank = lambda c: F.xxhash64(c, F.lit(seed))
    other = wanted.select(F.col("node").alias("other"), F.col("own").alias("other_own"), F.col("best").alias("other_best"))
    clash = links.select("node", "other").join(wanted, "node").join(other, "other").filter("best = other_own OR other_best = own")
    held = clash.filter(F.struct(rank("other"), "other") > F.struct(rank("node"), "node")).select("node").distinct()
    moves = wanted.join(held, "node", "left_anti").select("node", "best")
    after = nodes.join(moves, "node", "left").withColumn("comm", F.coalesce("best", "comm")).drop("best")
    return saved(after)


def _local_moves(nodes: DataFrame, links: DataFrame, gamma: float, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of moves until none gains or quality has not grown for two rounds; the best communities seen."""
    best, top, worse = nodes, _quality(nodes, links, gamma), 0
    for i in range(rounds):
        after = _moved(nodes, links, gamma, seed * 1_000 + i)
        if after is None:
            break
        nodes, found = after, _quality(after, links, gamma)
        best, top, worse = (nodes, found, 0) if found > top + LEAST_GAIN else (best, top, worse + 1)
        if worse == 2:
            break
    return best


def _refined(nodes: DataFrame, links: DataFrame, gamma: float, seed: int) -> DataFrame:
    """(node, part): well-connected parts of the communities."""
    of = nodes.select("node", F.col("comm").alias("bound"))
    inner = links.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("bound").alias("b")), "other").filter("bound = b").select("node", "other", "x")
    alone = nodes.withColumn("comm", F.col("node"))
    return _local_moves(alone, saved(inner), gamma, seed).select("node", F.col("comm").alias("part"))


def partition(names: DataFrame, links: DataFrame, gamma: float = 1.0, seed: int = 42, initial: DataFrame | None = None) -> DataFrame:
    """(v, comm) of all vertices: ``names`` (repo_id, seq, v), ``links`` (a, b), ``initial`` (v, comm) where moving starts."""
    weights = links.select("a", "b", F.lit(1.0).alias("x"))
    degrees = weights.select(F.col("a").alias("v"), F.col("x").alias("k_out"), F.lit(0.0).alias("k_in")).union(weights.select("b", F.lit(0.0), "x")).groupBy("v").agg(F.sum("k_out").alias("k_out"), F.sum("k_in").alias("k_in"))
    nodes = names.select(*SNAPSHOT, "v").join(degrees, "v")  # vertices without edges stay alone
    m = nodes.groupBy(*SNAPSHOT).agg(F.sum("k_out").alias("m"))
    nodes = nodes.join(m, SNAPSHOT).select(F.col("v").alias("node"), F.col("v").alias("comm"), "k_out", "k_in", "m")
    if initial is not None:
        nodes = nodes.join(initial.select(F.col("v").alias("node"), F.col("comm").alias("start")), "node", "left").withColumn("comm", F.coalesce("start", "comm")).drop("start")
    nodes = saved(nodes)
    both = weights.select(F.col("a").alias("node"), F.col("b").alias("other"), "x").union(weights.select("b", "a", "x"))
    links = saved(both.groupBy("node", "other").agg(F.sum("x").alias("x")))
    of_vertex = nodes.select(F.col("node").alias("v"), "node")
    for level in range(LEVELS):
        nodes = _local_moves(nodes, links, gamma, seed + level)
        parts = saved(_refined(nodes, links, gamma, seed + level))
        n, n_parts = parts.agg(F.count(F.lit(1)), F.countDistinct("part")).first()
        if n_parts == n or level + 1 == LEVELS:
            break
        of_vertex = saved(of_vertex.join(parts, "node").select("v", F.col("part").alias("node")))
        links = links.join(parts, "node").join(parts.select(F.col("node").alias("other"), F.col("part").alias("to")), "other").filter("part <> to")
        links = saved(links.groupBy(F.col("part").alias("node"), F.col("to").alias("other")).agg(F.sum("x").alias("x")))
        nodes = nodes.join(parts, "node").groupBy("part").agg(F.min("comm").alias("comm"), F.sum("k_out").alias("k_out"), F.sum("k_in").alias("k_in"), F.min("m").alias("m"))
        nodes = saved(nodes.withColumnRenamed("part", "node"))
    found = of_vertex.join(nodes.select("node", "comm"), "node").select("v", "comm")
    # communities may be numbered by any node or part; name each by its least vertex
    least = found.groupBy("comm").agg(F.min("v").alias("first"))
    return names.select("v").join(found.join(least, "comm").select("v", "first"), "v", "left").select("v", F.coalesce("first", "v").alias("comm"))


def overlapping(pairs: DataFrame) -> DataFrame:
    """(repo_id, seq, old, new): pairs with ``n``, taken from the greatest n (ties: least old, then new) unless a side is taken."""
    found, left = None, saved(pairs)
    first = lambda w: F.row_number().over(Window.partitionBy(*SNAPSHOT, w).orderBy(F.desc("n"), "old", "new"))
    while not left.isEmpty():
        settled = saved(left.withColumn("i", first("old")).withColumn("j", first("new")).filter("i = 1 AND j = 1").select(*SNAPSHOT, "old", "new"))
        found = settled if found is None else saved(found.unionByName(settled))
        left = saved(left.join(settled.select(*SNAPSHOT, "old"), [*SNAPSHOT, "old"], "left_anti").join(settled.select(*SNAPSHOT, "new"), [*SNAPSHOT, "new"], "left_anti"))
    return left.select(*SNAPSHOT, "old", "new") if found is None else found


def labelled(found: DataFrame, relabel: bool = True) -> DataFrame:
    """(repo_id, seq, file_path, cluster) from ``found`` (repo_id, seq, file_path, comm, before): labels of the run before, or numbers in the order of first members."""
    clusters = found.groupBy(*SNAPSHOT, F.col("comm").alias("new")).agg(F.min("file_path").alias("first"))
    top = found.groupBy(*SNAPSHOT).agg(F.coalesce(F.max("before"), F.lit(-1)).alias("top"))
    given = overlapping(found.filter("before IS NOT NULL AND n_before > 0").groupBy(*SNAPSHOT, F.col("before").alias("old"), F.col("comm").alias("new")).agg(F.count(F.lit(1)).alias("n"))) if relabel else None
    named = clusters.withColumn("old", F.lit(None).cast("long")) if given is None else clusters.join(given, [*SNAPSHOT, "new"], "left")
    if not relabel:
        top = top.withColumn("top", F.lit(-1).cast("long"))
    fresh = F.row_number().over(Window.partitionBy(*SNAPSHOT, F.col("old").isNull()).orderBy("first"))  # clusters, not vertices
    named = named.join(top, SNAPSHOT).withColumn("cluster", F.coalesce("old", F.col("top") + fresh))
    return found.join(named.select(*SNAPSHOT, F.col("new").alias("comm"), "cluster"), [*SNAPSHOT, "comm"]).select(*SNAPSHOT, "file_path", "cluster")


def communities(vertices: DataFrame, edges: DataFrame, gamma: float = 1.0, seed: int = 42, relabel: bool = True) -> DataFrame:
    """(repo_id, seq, file_path, cluster); ``vertices`` may have ``before``, the clusters of the previous snapshot."""
    if "before" not in vertices.columns:
        vertices = vertices.withColumn("before", F.lit(None).cast("long"))
    vertices = vertices.withColumn("before", F.col("before").cast("long"))
    names, links = as_numbers(vertices, edges)
    size = vertices.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("n_before"))
    placed = saved(names.join(vertices.select(*SNAPSHOT, "file_path", "before"), [*SNAPSHOT, "file_path"]).join(size, SNAPSHOT))
    large = placed.filter(F.col("n") >= SMALLEST)
    starts = large.filter("n_before > 0").select(*SNAPSHOT, "v", F.coalesce("before", F.lit(0)).alias("before"))
    initial = starts.join(starts.groupBy(*SNAPSHOT, "before").agg(F.min("v").alias("comm")), [*SNAPSHOT, "before"]).select("v", "comm")
    comm = partition(large, links.join(large.select(F.col("v").alias("a")), "a", "left_semi"), gamma, seed, initial)
    found = labelled(saved(large.join(comm, "v").select(*SNAPSHOT, "file_path", "comm", "before", "n_before")), relabel)
    return found.unionByName(placed.filter(F.col("n") < SMALLEST).select(*SNAPSHOT, "file_path", F.lit(0).cast("long").alias("cluster")))
