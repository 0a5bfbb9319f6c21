"""One run: source files to features, graph, clusters, catalog and the snapshot's measures.

Works on any number of repositories at once; each result is keyed by repo_id and seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import parsers
from ..functions.files import posix
from ..functions.globs import ignored
from ..operators import catalog, debounce, divergence, graph, intent, leiden, resolve
from ..shared import checkpointed
from ..sources.settings import Specification

KEY = ["repo_id", "seq"]
VERSION = "0.2.0"


@dataclass
class Run:
    features: DataFrame
    failures: DataFrame  # files that can't be read or parsed, with the reason
    edges: DataFrame
    partition: DataFrame  # debounced
    states: DataFrame  # what the next run needs; none for graphs that are too small
    shapes: DataFrame
    measures: DataFrame


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """The rows of each snapshot as one sorted array of structs, or of values if there is one column."""
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias(name))


def _mapped(rows: DataFrame, name: str, key: Column, value: str) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.cast("string").alias("k"), F.col(value).alias("v"))))).alias(name))


def clusters(vertices: DataFrame, edges: DataFrame, settings: dict, states: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(partition, states, stability): Leiden from the clusters of the run before, debounced.

    Snapshots with fewer than ``leiden.SMALLEST`` files are one cluster, leave no states and count as stable.
    """
    started = vertices.join(states.select("repo_id", "file_path", F.col("stable").alias("before")), ["repo_id", "file_path"], "left") if states is not None else vertices
    raw = leiden.communities(started, edges, settings["boundaries"]["leiden_gamma"], settings["core"]["random_seed"])
    raw = checkpointed(raw)
    large = vertices.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= leiden.SMALLEST).select(*KEY)
    after = checkpointed(debounce.stable_partition(raw.join(large, KEY, "left_semi").withColumnRenamed("cluster", "raw"), states, settings["boundaries"]["stability_threshold"]))
    partition = after.select(*KEY, "file_path", F.col("stable").alias("cluster")).unionByName(raw.join(large, KEY, "left_anti"))
    compared = after.select(*KEY, "file_path", F.col("stable").alias("cluster"))
    if states is not None:  # the run before stands right before the first of each repository
        first = after.groupBy("repo_id").agg((F.min("seq") - 1).alias("seq"))
        compared = compared.unionByName(states.select("repo_id", "file_path", "stable").join(first, "repo_id").select(*KEY, "file_path", F.col("stable").alias("cluster")))
    every = vertices.select(*KEY).distinct()
    stability = every.join(debounce.stability(compared), KEY, "left").select(*KEY, F.coalesce("stability_score", F.lit(1.0)).alias("stability_score"))
    return partition, after, stability


def run(files: DataFrame, settings: dict, spec: Specification | None = None, states: DataFrame | None = None, aliases: dict[str, resolve.Aliases] | None = None, cache: DataFrame | None = None, previous: DataFrame | None = None) -> Run:
    """``files``: repo_id, seq, path, language, content.

    Of the run before: ``states`` of clusters (repo_id, file_path, stable, candidate, consecutive), ``cache`` of features,
    and the ``previous`` catalog (repo_id, category, structural_hash, instance_count). ``aliases``: import path aliases
    by repository.
    """
    session = files.sparkSession
    parsed = checkpointed(parsers.parse_files(files) if cache is None else parsers.parse_changed(files, cache))
    features = parsed.filter("parse_error IS NULL")
    vertices = features.select(*KEY, "file_path")
    resolved = checkpointed(resolve.resolve(features, aliases))
    edges = checkpointed(graph.edges_of(resolved))
    partition, after, stability = clusters(vertices, edges, settings, states)
    partition = checkpointed(partition)

    # the catalog: shapes of files in scope, in categories that apply to their language
    exclude, categories = settings["patterns"]["scope_exclude"], catalog.registry(session)
    in_scope = ~ignored(posix(F.col("file_path")), exclude) if exclude else F.lit(True)
    excluded = features.groupBy(*KEY).agg(F.count_if(~in_scope).alias("scope_excluded_file_count"))
    instances = catalog.applicable(catalog.large_enough(parsers.instances(features.filter(in_scope), settings["patterns"]["count_nodes"]), settings["patterns"]["min_pattern_nodes"]), categories)
    instances = checkpointed(instances)
    counts = catalog.shape_counts(instances)
    past = counts
    if previous is not None:
        first = features.groupBy("repo_id").agg((F.min("seq") - 1).alias("seq"))
        past = counts.unionByName(previous.select("repo_id", "category", "structural_hash", "instance_count").join(first, "repo_id").select(counts.columns))
    velocity = catalog.velocity(past).drop("instance_count")
    shapes = catalog.shapes(instances).join(velocity, catalog.SHAPE, "left").join(catalog.boundary_spread(instances, partition), catalog.SHAPE, "left")
    canonical = catalog.canonical_shapes(counts).select(*KEY, "category", F.col("structural_hash").alias("canonical"))
    snapshots = features.select(*KEY).distinct()
    found = catalog.category_entropy(counts)
    dense = snapshots.withColumn("category", F.explode(F.array(*map(F.lit, catalog.REGISTRY)))).join(found, [*KEY, "category"], "left")
    dense = dense.join(canonical, [*KEY, "category"], "left").select(*KEY, "category", F.coalesce("entropy", F.lit(0)).alias("entropy"), F.coalesce("instances", F.lit(0)).alias("instances"), "canonical")
    languages = features.select(*KEY, "language").distinct()

    # clusters against the declared modules
    crossing = checkpointed(graph.inter_cluster_edges(edges, partition))
    violations = crossing.select(*KEY, "count")
    parts = [_listed(crossing, "inter_cluster_edges", "source_cluster", "target_cluster", "count"), _mapped(graph.surface_area(edges, partition), "surface_area", F.col("cluster"), "surface_area")]
    if spec and spec.modules:
        members = intent.with_modules(partition, [(n, p) for n, p, _ in spec.modules])
        pairs = intent.module_edges(crossing, intent.cluster_modules(members))
        allowed = session.createDataFrame(spec.allowed, "from_module string, to_module string")
        layers = session.createDataFrame([(n, x) for n, _, x in spec.modules if x], "module string, layer string")
        ranks = session.createDataFrame([(x, i) for i, x in enumerate(spec.layers)] if spec.direction == "downward" else [], "layer string, rank int")
        misplaced, foreign, layered = intent.misplaced_files(members), intent.unauthorized(pairs, allowed), intent.layer_violations(pairs, layers, ranks)
        one = lambda rows: rows.select(*KEY, F.lit(1).cast("long").alias("count"))
        violations = violations.unionByName(one(misplaced)).unionByName(one(foreign)).unionByName(one(layered))
        parts += [_listed(misplaced, "misplaced_files", "file_path"), _listed(foreign, "unauthorized", "from_module", "to_module", "count"), _listed(layered, "layer_violations", "from_module", "to_module", "from_layer", "to_layer", "count")]
    crossings = violations.groupBy(*KEY).agg(F.sum("count").cast("double").alias("boundary_violations"))

    metrics = graph.density(vertices, edges).join(graph.hubs(vertices, edges), KEY).join(graph.whole_graph(vertices, edges), KEY)
    parts += [
        divergence.coupling(metrics), catalog.pattern_measures(counts), crossings, graph.cluster_count(partition), graph.import_counts(resolved), stability, excluded,
        _listed(dense, "categories", "category", "entropy", "instances", "canonical"),
        _mapped(features.groupBy(*KEY, "language").agg(F.count(F.lit(1)).alias("n")), "language_breakdown", F.col("language"), "n"),
        _mapped(catalog.entropy_by_language(instances, languages, categories), "pattern_entropy_by_language", F.col("language"), "pattern_entropy"),
        _mapped(catalog.drift_by_language(instances, languages, categories), "convention_drift_by_language", F.col("language"), "convention_drift"),
    ]
    measures = features.groupBy(*KEY).agg(F.count(F.lit(1)).alias("file_count"))
    for part in parts:
        measures = measures.join(part, KEY, "left")
    measures = measures.fillna(0.0, ["pattern_entropy", "convention_drift", "coupling_topology", "boundary_violations"]).withColumn("version", F.lit(VERSION))
    return Run(parsed, parsed.filter("parse_error IS NOT NULL"), edges, partition, after, shapes, measures)
