"""Debounced cluster membership: a new cluster counts once it was seen ``threshold`` runs in a row.

The state of a file is (stable, candidate, consecutive). Without a state, or after a run without the file, the
observed cluster is stable at once. An observation equal to the stable cluster clears the candidate; a repeated
candidate counts on, and becomes stable at the threshold; another one starts at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

THRESHOLD = 3


def step(stable: Column, candidate: Column, consecutive: Column, raw: Column, threshold: int = THRESHOLD) -> Column:
    """The state after one observation; a null ``stable`` means that there is no state yet."""
    state = lambda s, c, n: F.struct(s.cast("long").alias("stable"), c.cast("long").alias("candidate"), n.cast("long").alias("consecutive"))
    zero = F.lit(0)
    counted = F.when(candidate == raw, consecutive + 1).otherwise(F.lit(1))
    return (
        F.when(stable.isNull(), state(raw, raw, zero))
        .when(raw == stable, state(stable, stable, zero))
        .when(counted >= threshold, state(raw, raw, zero))
        .otherwise(state(stable, raw, counted))
    )


def _scanned(observed: DataFrame, order: str, threshold: int) -> DataFrame:
    """Adds the state after each observation, as a segmented scan.

    ``observed`` has repo_id, file_path, ``order`` (a gap starts a new segment), raw, and the state before a file's first
    observation: s_stable, s_candidate, s_consecutive, where ``s_follows``.

    A segment falls into islands of equal observations. In an island that differs from the stable cluster the count runs from
    1, as the candidate before was another one; so an island as long as the threshold, like a segment's first one, makes its
    value stable for what follows, and no other does. A file's rows are sorted and streamed, not collected.
    """
    file = Window.partitionBy("repo_id", "file_path").orderBy(order)
    begins = F.coalesce(F.col(order) != F.lag(order).over(file) + 1, F.lit(True))
    found = observed.withColumn("begins", begins).withColumn("turns", F.col("begins") | (F.col("raw") != F.lag("raw").over(file)))
    found = found.withColumn("segment", F.sum(F.col("begins").cast("int")).over(file)).withColumn("island", F.sum(F.col("turns").cast("int")).over(file))
    within = Window.partitionBy("repo_id", "file_path", "island").orderBy(order)
    found = found.withColumn("k", F.row_number().over(within).cast("long")).withColumn("ends", F.coalesce(F.lead("turns").over(file), F.lit(True)))
    follows = F.col("s_follows") & (F.col("segment") == 1) & F.col("s_stable").isNotNull()
    # the state before counts on in the first island
    counts_on = follows & (F.col("island") == 1) & (F.col("raw") == F.col("s_candidate"))
    found = found.withColumn("follows", follows).withColumn("k", F.col("k") + F.when(counts_on, F.col("s_consecutive")).otherwise(0))
    segment = Window.partitionBy("repo_id", "file_path", "segment").orderBy(order)
    found = found.withColumn("opens", (F.min("island").over(segment) == F.col("island")) & ~F.col("follows"))
    made = F.when(F.col("ends") & (F.col("opens") | (F.col("k") >= threshold)), F.col("raw"))
    before = F.last(made, ignorenulls=True).over(segment.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("before", F.coalesce(before, F.when(F.col("follows"), F.col("s_stable"))))
    settled = F.col("opens") | (F.col("raw") == F.col("before")) | (F.col("k") >= threshold)
    state = {"stable": F.when(settled, F.col("raw")).otherwise(F.col("before")), "candidate": F.col("raw"), "consecutive": F.when(settled, F.lit(0)).otherwise(F.col("k"))}
    return found.select(*observed.columns, *[c.cast("long").alias(name) for name, c in state.items()])


def _without_state(observed: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return observed.select("*", none.alias("s_stable"), none.alias("s_candidate"), none.alias("s_consecutive"), F.lit(False).alias("s_follows"))


def replay(observed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The state of each (repo_id, file_path) after its last run, from all runs (seq, raw); gaps in seq start anew."""
    rows = observed.select("repo_id", "file_path", F.col("seq").cast("long").alias("seq"), F.col("raw").cast("long").alias("raw"))
    states = _scanned(_without_state(rows), "seq", threshold)
    last = states.groupBy("repo_id", "file_path").agg(F.max_by(F.struct("stable", "candidate", "consecutive", "seq"), "seq").alias("s"))
    return last.select("repo_id", "file_path", "s.*")


def stable_partition(observed: DataFrame, state: DataFrame | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """The state of each file after each run: ``observed`` (repo_id, seq, file_path, raw) with stable, candidate, consecutive.

    ``state``: what the run before the first one left (repo_id, file_path, stable, candidate, consecutive). A repository's
    runs are the seqs that occur; a file that is missing from one starts anew.
    """
    runs = observed.select("repo_id", "seq").distinct().withColumn("run", F.row_number().over(Window.partitionBy("repo_id").orderBy("seq")))
    rows = observed.join(runs, ["repo_id", "seq"]).select("repo_id", "seq", "file_path", F.col("raw").cast("long").alias("raw"), "run")
    if state is None:
        rows = _without_state(rows)
    else:
        before = state.select("repo_id", "file_path", *[F.col(c).cast("long").alias(f"s_{c}") for c in ("stable", "candidate", "consecutive")])
        first = F.min("run").over(Window.partitionBy("repo_id", "file_path"))
        rows = rows.join(before, ["repo_id", "file_path"], "left").withColumn("s_follows", first == 1)
    return _scanned(rows, "run", threshold).select("repo_id", "file_path", "seq", "stable", "candidate", "consecutive")


def advance(state: DataFrame, observed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The states after one more run: observations (repo_id, file_path, raw) left-joined to the states before."""
    joined = observed.join(state.select("repo_id", "file_path", "stable", "candidate", "consecutive"), ["repo_id", "file_path"], "left")
    after = step(F.col("stable"), F.col("candidate"), F.col("consecutive"), F.col("raw"), threshold)
    return joined.select("repo_id", "file_path", after.alias("s")).select("repo_id", "file_path", "s.*")


def initial_membership(vertices: DataFrame, previous: DataFrame) -> DataFrame:
    """The clusters from which a run starts: the previous ones, 0 for new files."""
    return vertices.join(previous, ["repo_id", "file_path"], "left").select("repo_id", "file_path", F.coalesce("cluster", F.lit(0)).alias("cluster"))


def stability(partition: DataFrame) -> DataFrame:
    """Share of files that kept their cluster since the previous snapshot; 1.0 where none can be compared."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("seq")
    before = F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.lag("cluster").over(w))
    kept = partition.withColumn("before", before).groupBy("repo_id", "seq").agg(F.avg(F.when(F.col("before").isNotNull(), (F.col("before") == F.col("cluster")).cast("double"))).alias("score"))
    return kept.select("repo_id", "seq", F.coalesce("score", F.lit(1.0)).alias("stability_score"))
