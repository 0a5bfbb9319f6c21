"""Pattern catalog: structural shapes by category, and what is measured on them.

Everything is keyed by ``repo_id`` and ``seq`` (the number of a snapshot within its repository), so one plan serves any
number of repositories and snapshots. ``instances`` has a row for each pattern instance: repo_id, seq, category,
structural_hash, file_path, language, node_count (null: not known).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The categories, and the languages that each applies to.
EVERY = ("python", "shell", "javascript", "typescript", "go", "java", "rust")
REGISTRY: dict[str, tuple[str, ...]] = {
    "error_handling": EVERY,
    "data_access": EVERY,
    "logging": EVERY,
    "async_patterns": ("python", "shell", "javascript", "typescript", "go", "rust"),
    "class_hierarchy": ("python", "javascript", "typescript", "java"),
    "context_managers": ("python",),
    "comprehensions": ("python",),
}

SNAPSHOT = ["repo_id", "seq"]
SHAPE = [*SNAPSHOT, "category", "structural_hash"]


def registry(spark: SparkSession) -> DataFrame:
    """The categories as a table (category, languages)."""
    return spark.createDataFrame([(c, list(of)) for c, of in REGISTRY.items()], "category string, languages array<string>")


def large_enough(instances: DataFrame, min_nodes: int) -> DataFrame:
    """Instances whose node count is not known or at least ``min_nodes``."""
    return instances.filter(F.col("node_count").isNull() | (F.col("node_count") >= min_nodes))


def applicable(instances: DataFrame, categories: DataFrame) -> DataFrame:
    """Instances in a language that their category applies to; unknown categories apply to all.

    ``categories``: category, languages (null: all). A fixed registry, so it is broadcast.
    """
    return instances.join(F.broadcast(categories), "category", "left").filter("languages IS NULL OR array_contains(languages, language)").drop("languages")


def shapes(instances: DataFrame) -> DataFrame:
    """Instance count and sorted distinct files of each shape."""
    return instances.groupBy(*SHAPE).agg(F.count(F.lit(1)).alias("instance_count"), F.sort_array(F.collect_set("file_path")).alias("file_paths"))


def shape_counts(instances: DataFrame) -> DataFrame:
    """Instance counts alone, for what needs no files."""
    return instances.groupBy(*SHAPE).agg(F.count(F.lit(1)).alias("instance_count"))


def category_entropy(counts: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Shapes per category; with ``categories``, also registered ones that have none."""
    found = counts.groupBy(*SNAPSHOT, "category").agg(F.count(F.lit(1)).alias("entropy"), F.sum("instance_count").alias("instances"))
    if categories is None:
        return found
    names = [r.category for r in categories.select("category").distinct().collect()]  # the registry, a handful
    every = counts.select(*SNAPSHOT).distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in sorted(names)])))
    keys = [*SNAPSHOT, "category"]
    dense = every.join(found, keys, "full")
    return dense.select(*keys, F.coalesce("entropy", F.lit(0)).alias("entropy"), F.coalesce("instances", F.lit(0)).alias("instances"))


def canonical_shapes(counts: DataFrame) -> DataFrame:
    """The shape with the most instances in each category; ties go to the smaller hash."""
    first = F.row_number().over(Window.partitionBy(*SNAPSHOT, "category").orderBy(F.desc("instance_count"), "structural_hash"))
    return counts.withColumn("r", first).filter("r = 1").drop("r")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def pattern_measures(counts: DataFrame) -> DataFrame:
    """Pattern entropy (shapes of all categories) and convention drift (share of non-canonical instances)."""
    by_category = counts.groupBy(*SNAPSHOT, "category").agg(F.count(F.lit(1)).alias("k"), F.sum("instance_count").alias("n"), F.max("instance_count").alias("top"))
    return by_category.groupBy(*SNAPSHOT).agg(F.sum("k").cast("double").alias("pattern_entropy"), ratio(F.sum(F.col("n") - F.col("top")).cast("double"), F.sum("n")).alias("convention_drift"))


def velocity(counts: DataFrame) -> DataFrame:
    """Change of each shape's instances since the previous snapshot; null where there is no previous catalog."""
    has_previous = counts.select("repo_id", (F.col("seq") + 1).alias("seq")).distinct().withColumn("has_previous", F.lit(True))
    previous = counts.select("repo_id", (F.col("seq") + 1).alias("seq"), "category", "structural_hash", F.col("instance_count").alias("before"))
    joined = counts.join(previous, SHAPE, "left").join(has_previous, SNAPSHOT, "left")
    return joined.select(*SHAPE, "instance_count", F.when(F.col("has_previous"), F.col("instance_count") - F.coalesce("before", F.lit(0))).alias("velocity"))


def boundary_spread(instances: DataFrame, partition: DataFrame) -> DataFrame:
    """Distinct clusters over each shape's files, from ``partition`` (repo_id, seq, file_path, cluster).

    Files without a cluster don't count; null where a snapshot has no partition at all.
    """
    known = partition.select(*SNAPSHOT).distinct().withColumn("known", F.lit(True))
    files = instances.select(*SHAPE, "file_path").distinct()
    spread = files.join(partition, [*SNAPSHOT, "file_path"], "left").groupBy(*SHAPE).agg(F.countDistinct("cluster").alias("spread"))
    return spread.join(known, SNAPSHOT, "left").select(*SHAPE, F.when(F.col("known"), F.col("spread")).alias("boundary_spread"))


def entropy_by_language(instances: DataFrame, languages: DataFrame, categories: DataFrame) -> DataFrame:
    """Shapes with a file of each language, in categories that apply to it; ``languages`` (repo_id, seq, language) all get a row."""
    found = applicable(instances, categories).select(*SHAPE, "language").distinct().groupBy(*SNAPSHOT, "language").agg(F.count(F.lit(1)).alias("n"))
    return languages.join(found, [*SNAPSHOT, "language"], "left").select(*SNAPSHOT, "language", F.coalesce("n", F.lit(0)).cast("double").alias("pattern_entropy"))


def drift_by_language(instances: DataFrame, languages: DataFrame, categories: DataFrame) -> DataFrame:
    """Convention drift by language; a shape weighs as many distinct files of the language as it has."""
    weighed = applicable(instances, categories).select(*SHAPE, "language", "file_path").distinct().groupBy(*SHAPE, "language").agg(F.count(F.lit(1)).alias("w"))
    by_category = weighed.groupBy(*SNAPSHOT, "language", "category").agg(F.sum("w").alias("n"), F.max("w").alias("top"))
    found = by_category.groupBy(*SNAPSHOT, "language").agg(ratio(F.sum(F.col("n") - F.col("top")).cast("double"), F.sum("n")).alias("drift"))
    return languages.join(found, [*SNAPSHOT, "language"], "left").select(*SNAPSHOT, "language", F.coalesce("drift", F.lit(0.0)).alias("convention_drift"))
