"""Debounce, by table, replay and stream; deltas, checks and references."""

import pytest
from pyspark.sql import functions as F

from driftspark.operators import debounce, divergence
from driftspark.streaming import debounce as streaming

STEPS = [((0, 0, 0), 1, (0, 1, 1)), ((0, 1, 1), 1, (0, 1, 2)), ((0, 1, 2), 1, (1, 1, 0)), ((0, 1, 2), 0, (0, 0, 0)), ((0, 1, 2), 2, (0, 2, 1)), (None, 2, (2, 2, 0))]


def test_steps(spark):
    state = spark.createDataFrame([("r", str(i), *s) for i, (s, _, _) in enumerate(STEPS) if s], "repo_id string, file_path string, stable long, candidate long, consecutive long")
    observed = spark.createDataFrame([("r", str(i), raw) for i, (_, raw, _) in enumerate(STEPS)], "repo_id string, file_path string, raw long")
    got = {int(r.file_path): (r.stable, r.candidate, r.consecutive) for r in debounce.advance(state, observed).collect()}
    assert got == {i: after for i, (_, _, after) in enumerate(STEPS)}


def test_replay_equals_the_stream_step_and_starts_anew_at_gaps(spark):
    raws = {"a": [(1, 0), (2, 1), (3, 1), (4, 1), (5, 0)], "b": [(1, 0), (2, 1), (4, 1), (5, 1)], "c": [(3, 2)]}
    observed = spark.createDataFrame([("r", f, s, x) for f, seen in raws.items() for s, x in seen], "repo_id string, file_path string, seq long, raw long").repartition(3)
    got = {r.file_path: (r.stable, r.candidate, r.consecutive, r.seq) for r in debounce.replay(observed).collect()}
    for f, seen in raws.items():
        state = None
        for s, x in seen:
            state = streaming.after(state, s, x, debounce.THRESHOLD)
        assert got[f] == state
    assert got["a"] == (1, 0, 1, 5) and got["b"] == (1, 1, 0, 5)


def test_stream(spark, tmp_path):
    schema = "repo_id string, file_path string, seq long, raw long"
    for n, rows in enumerate([[("r", "a", 1, 0), ("r", "a", 2, 1)], [("r", "a", 3, 1), ("r", "a", 4, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streaming.debounced(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.sql("SELECT * FROM states ORDER BY seq DESC").first()
    assert (last.stable, last.consecutive, last.seq) == (1, 0, 4)


def measures(spark):
    rows = [("r", 1, "0.1.0", 10.0, 0.5), ("r", 2, "0.2.0", 12.0, 0.4), ("r", 3, "99.0.0", 20.0, 0.4), ("q", 1, "0.2.0", 1.0, 0.0)]
    return spark.createDataFrame(rows, "repo_id string, seq long, version string, pattern_entropy double, convention_drift double")


def test_deltas_are_null_without_a_comparable_snapshot(spark):
    got = {(r.repo_id, r.seq): r.pattern_entropy_delta for r in divergence.deltas(measures(spark), ("pattern_entropy",)).collect()}
    assert got == {("r", 1): None, ("r", 2): 2.0, ("r", 3): None, ("q", 1): None}


def test_language_deltas(spark):
    by = spark.createDataFrame([("r", 1, "py", 1.0), ("r", 2, "py", 3.0), ("r", 2, "go", 2.0), ("r", 3, "go", 5.0)], "repo_id string, seq long, language string, m double")
    versions = spark.createDataFrame([("r", 1, "0.1.0"), ("r", 2, "0.2.0"), ("r", 3, "0.2.0")], "repo_id string, seq long, version string")
    got = {(r.seq, r.language): r.delta for r in divergence.language_deltas(by, "m", versions).collect()}
    assert got == {(1, "py"): None, (2, "py"): None, (2, "go"): None, (3, "py"): -3.0, (3, "go"): 3.0}


def test_references(spark):
    rows = spark.createDataFrame([("r", i, f"snap{i // 2}") for i in range(1, 5)], "repo_id string, seq long, name string")
    pick = lambda ref: [r.seq for r in divergence.referenced(rows, ref, key="repo_id", order="seq", name="name").collect()]
    assert [pick(None), pick("1"), pick("-2"), pick("0"), pick("9"), pick("snap1"), pick("no")] == [[4], [1], [3], [], [], [3], []]


def test_checks_are_strict_and_ignore_nulls(spark):
    changes = divergence.deltas(measures(spark), ("pattern_entropy",))
    base = spark.createDataFrame([("pattern_entropy", 2.0)], "dimension string, threshold double")
    assert not divergence.checks(changes, base).filter("exceeded").count()
    assert divergence.checks(changes, base.withColumn("threshold", F.lit(1.9))).filter("exceeded").count() == 1


@pytest.mark.parametrize("today,raised", [("2024-05-01", 9.0), ("2024-05-02", 2.0)])
def test_overrides_hold_on_their_last_day(spark, today, raised):
    base = spark.createDataFrame([("pattern_entropy", 2.0)], "dimension string, threshold double")
    overrides = spark.createDataFrame([("any name", "2024-05-01", "pattern_entropy", 9.0), ("lower", "2999-01-01", "pattern_entropy", 0.1)], "name string, expires string, dimension string, value double").withColumn("expires", F.col("expires").cast("date"))
    held = divergence.active(overrides, F.lit(today).cast("date"))
    assert divergence.effective_thresholds(base, held).first().threshold == raised
