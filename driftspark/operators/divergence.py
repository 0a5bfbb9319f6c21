"""Snapshots over time: deltas, per-language deltas, trends, diffs, retention, threshold checks.

``measures`` has a row for each snapshot: repo_id, seq, version, and the four dimensions as nullable doubles. A null
delta means that there is no comparable previous snapshot; it is never the same as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = ("pattern_entropy", "convention_drift", "coupling_topology", "boundary_violations")


def major(version: Column) -> Column:
    return F.substring_index(version, ".", 1)


def _before() -> Window:
    return Window.partitionBy("repo_id").orderBy("seq")


def deltas(measures: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Adds ``<dimension>_delta`` against the previous snapshot of the same major version."""
    same = major(F.col("version")) == major(F.lag("version").over(_before()))
    return measures.select("*", *[F.when(same, F.col(d) - F.lag(d).over(_before())).alias(f"{d}_delta") for d in dimensions])


def language_deltas(by_language: DataFrame, measure: str, versions: DataFrame, oldest: str = "0.1.0") -> DataFrame:
    """Per-language change since the previous snapshot, over the languages of either; a missing side counts 0.0.

    Null where there is no previous snapshot, its major version differs, or it has the version without languages.
    """
    pairs = versions.select("repo_id", "seq", (major(F.col("version")) == major(F.lag("version").over(_before()))).alias("same"), (F.lag("version").over(_before()) != oldest).alias("has_languages"), F.lag("seq").over(_before()).alias("before"))
    now = by_language.join(pairs, ["repo_id", "seq"]).select("repo_id", "seq", "language", F.col(measure).alias("now"))
    then = by_language.withColumnRenamed("seq", "before").join(pairs, ["repo_id", "before"]).select("repo_id", "seq", "language", F.col(measure).alias("then"))
    both = now.join(then, ["repo_id", "seq", "language"], "full").join(pairs, ["repo_id", "seq"])
    change = F.coalesce("now", F.lit(0.0)) - F.coalesce("then", F.lit(0.0))
    return both.select("repo_id", "seq", "language", F.when(F.col("same") & F.col("has_languages"), change).alias("delta"))


def trend_long(measures: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(repo_id, seq, dimension, value): a row for each chosen dimension; unknown names are left out."""
    known = [d for d in dimensions if d in measures.columns]
    return measures.select("repo_id", "seq", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for d in known])).alias("x")).select("repo_id", "seq", "x.*")


def trend_wide(series: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """A column for each dimension of a long series."""
    return series.groupBy("repo_id", "seq").pivot("dimension", list(dimensions)).agg(F.first("value"))


def last(rows: DataFrame, n: int, key: str = "repo_id", order: str = "seq") -> DataFrame:
    """The latest ``n`` rows of each key; 0: all."""
    if n <= 0:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def retained(rows: DataFrame, limit: int, key: str, *order: str) -> DataFrame:
    """Adds ``kept``: whether a row is among the latest ``limit`` of its key (0: no limit)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("kept", (rank <= limit) if limit > 0 else F.lit(True))


def referenced(rows: DataFrame, ref: str | None, *, key: str, order: str, name: str) -> DataFrame:
    """The row of each key that a reference names.

    None: the latest; a positive number counts from the oldest, a negative one from the latest; anything else is the
    beginning of a name, and the latest such row is meant. Nothing for 0 or numbers out of range.
    """
    try:
        n = -1 if ref is None else int(ref)
    except ValueError:
        rows, n = rows.filter(F.col(name).startswith(ref)), -1
    if n == 0:
        return rows.limit(0)
    sort = F.asc(order) if n > 0 else F.desc(order)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(sort))).filter(F.col("_r") == abs(n)).drop("_r")


def diff(a: DataFrame, b: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``b`` relative to ``a``: both values of each dimension and the difference."""
    left = a.select("repo_id", F.col("seq").alias("seq_a"), *[F.col(d).alias(f"{d}_a") for d in dimensions])
    right = b.select("repo_id", F.col("seq").alias("seq_b"), *[F.col(d).alias(f"{d}_b") for d in dimensions])
    return left.join(right, "repo_id").select("*", *[(F.col(f"{d}_b") - F.col(f"{d}_a")).alias(f"{d}_delta") for d in dimensions])


def active(overrides: DataFrame, today: Column | None = None) -> DataFrame:
    """Threshold overrides (name, expires, dimension, value) that still hold; they do on their last day."""
    return overrides.filter(F.col("expires") >= (F.current_date() if today is None else today))


def effective_thresholds(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """The greatest of the base and all active overrides, whatever their name; (dimension, threshold)."""
    raised = overrides.groupBy("dimension").agg(F.max("value").alias("raised"))
    return base.join(raised, "dimension", "left").select("dimension", F.greatest("threshold", F.coalesce("raised", "threshold")).alias("threshold"))


def checks(changes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(repo_id, seq, dimension, value, threshold, exceeded): exceeded only by values that are known and greater."""
    named = {f"{d}_delta": d for d in DIMENSIONS if f"{d}_delta" in changes.columns}
    long = changes.select("repo_id", "seq", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("double").alias("value")) for c, d in named.items()])).alias("x")).select("repo_id", "seq", "x.*")
    return long.join(F.broadcast(thresholds), "dimension").select("repo_id", "seq", "dimension", "value", "threshold", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).alias("exceeded"))


def coupling(metrics: DataFrame) -> DataFrame:
    """Mean of density, hub concentration, cycles and depth per vertex (both at most 1)."""
    per = lambda c: F.least(F.lit(1.0), F.col(c) / F.greatest(F.lit(1), "node_count"))
    return metrics.select("*", ((F.col("density") + F.col("hub_concentration") + per("cycle_count") + per("max_depth")) / 4).alias("coupling_topology"))
