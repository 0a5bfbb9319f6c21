"""Comparison of clusters with a declared module specification.

The specification is a table: ``modules`` (ord, name, prefix_ord, prefix, layer), ``allowed`` (from_module, to_module),
``layers`` (layer, rank). A file belongs to the first module, in file order, one of whose prefixes it starts with. Paths are
cut at the lengths that prefixes have, and joined to them by equality, so the plan doesn't grow with the specification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SNAPSHOT = ["repo_id", "seq"]


def module_of(path: Column, modules: list[tuple[str, list[str]]]) -> Column:
    """The first module with a prefix of ``path``; null without one."""
    tests = [(p, name) for name, prefixes in modules for p in prefixes]
    return F.coalesce(*[F.when(path.startswith(p), F.lit(name)) for p, name in tests], F.lit(None).cast("string")) if tests else F.lit(None).cast("string")


def with_modules(files: DataFrame, modules: list[tuple[str, list[str]]]) -> DataFrame:
    """``files`` (file_path and others) with ``module``, the first one with a prefix of the path; null without one."""
    prefixes = [(p, i, name) for i, (p, name) in enumerate((p, name) for name, own in modules for p in own)]
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for p, _, _ in prefixes})]).cast("array<int>")
    table = files.sparkSession.createDataFrame(prefixes, "prefix string, ord int, module string").groupBy("prefix").agg(F.min_by("module", "ord").alias("module"), F.min("ord").alias("ord"))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("file_path")), lambda n: F.substring(F.col("file_path"), F.lit(1), n))
    found = files.select("file_path").distinct().select("file_path", F.explode(starts).alias("prefix")).join(table, "prefix")
    return files.join(found.groupBy("file_path").agg(F.min_by("module", "ord").alias("module")), "file_path", "left").select(*files.columns, "module")


def plurality(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent non-null value of each group; ties go to the one that comes first by ``order``."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_n"), "_first"))
    return n.withColumn("_r", best).filter("_r = 1").select(*group, value)


def cluster_modules(members: DataFrame) -> DataFrame:
    """The main module of each cluster of ``members`` (repo_id, seq, file_path, cluster, module); null if none is known."""
    every = members.select(*SNAPSHOT, "cluster").distinct()
    return every.join(plurality(members, [*SNAPSHOT, "cluster"], "module", "file_path"), [*SNAPSHOT, "cluster"], "left")


def misplaced_files(members: DataFrame) -> DataFrame:
    """Files outside the cluster that holds most files of their module."""
    home = plurality(members.filter("module IS NOT NULL"), [*SNAPSHOT, "module"], "cluster", "file_path").withColumnRenamed("cluster", "home")
    return members.join(home, [*SNAPSHOT, "module"]).filter("cluster <> home").select(*SNAPSHOT, "file_path", "module", "cluster", "home")


def module_edges(cluster_edges: DataFrame, of_cluster: DataFrame) -> DataFrame:
    """Inter-cluster edges between clusters of different known modules."""
    side = lambda c, m: of_cluster.select(*SNAPSHOT, F.col("cluster").alias(c), F.col("module").alias(m))
    joined = cluster_edges.join(side("source_cluster", "from_module"), [*SNAPSHOT, "source_cluster"]).join(side("target_cluster", "to_module"), [*SNAPSHOT, "target_cluster"])
    return joined.filter("from_module <> to_module")


def unauthorized(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """A row for each inter-cluster edge whose pair of modules is not allowed."""
    return edges.join(F.broadcast(allowed), ["from_module", "to_module"], "left_anti").select(*SNAPSHOT, "source_cluster", "target_cluster", "from_module", "to_module", "count")


def layer_violations(edges: DataFrame, module_layers: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges from a lower layer (greater rank) up to a higher one; both layers must be known."""
    ranked = F.broadcast(module_layers.join(layers, "layer"))  # the specification
    side = lambda m, name: ranked.select(F.col("module").alias(m), F.col("layer").alias(f"{name}_layer"), F.col("rank").alias(f"{name}_rank"))
    joined = edges.join(side("from_module", "from"), "from_module").join(side("to_module", "to"), "to_module")
    return joined.filter("from_rank > to_rank").select(*SNAPSHOT, "source_cluster", "target_cluster", "from_module", "to_module", "from_layer", "to_layer", "count")


def total_violations(misplaced: DataFrame, crossing: DataFrame, layered: DataFrame) -> DataFrame:
    """Misplaced files plus unauthorized and layer groups of each snapshot."""
    rows = misplaced.select(*SNAPSHOT).unionByName(crossing.select(*SNAPSHOT)).unionByName(layered.select(*SNAPSHOT))
    return rows.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("total_violations"))


def boundary_violations(cluster_edges: DataFrame, totals: DataFrame) -> DataFrame:
    """Crossing edges plus total violations; a missing count is 1."""
    edges = cluster_edges.groupBy(*SNAPSHOT).agg(F.sum(F.coalesce("count", F.lit(1))).alias("edges"))
    both = edges.join(totals, SNAPSHOT, "full")
    return both.select(*SNAPSHOT, (F.coalesce("edges", F.lit(0)) + F.coalesce("total_violations", F.lit(0))).cast("long").alias("boundary_violations"))


def proposed_modules(members: DataFrame, shown: int = 5) -> DataFrame:
    """A module for each cluster: its name, the first ``shown`` paths, and how many more there are."""
    files = F.sort_array(F.collect_list("file_path"))
    grouped = members.groupBy(*SNAPSHOT, "cluster").agg(files.alias("files"))
    return grouped.select(*SNAPSHOT, F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("module"), F.slice("files", 1, shown).alias("paths"), F.greatest(F.size("files") - shown, F.lit(0)).alias("more"))
