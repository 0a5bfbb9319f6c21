"""Debounced clusters over streams whose runs come out of order; the segmented scan against a fold."""

import random

from pyspark.sql import functions as F

from driftspark.operators import debounce
from driftspark.streaming import debounce as streaming

SCHEMA = "repo_id string, file_path string, seq long, raw long"


def fold(rows, threshold, state=None):
    for seq, raw in sorted(rows):
        state = streaming.after(state, seq, raw, threshold)
    return state


def history(rng, files):
    return [("r", f"f{f}", seq, rng.choice([1, 1, 1, 2, 3])) for f in range(files) for seq in range(rng.randrange(1, 30)) if rng.random() < 0.85]


def test_scan_equals_a_fold_from_any_state(spark):
    rng = random.Random(6)
    rows = history(rng, 40)
    for threshold in (1, 2, 3):
        got = {r.file_path: (r.stable, r.candidate, r.consecutive, r.seq) for r in debounce.replay(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
        assert got == {f: fold([(s, x) for _, g, s, x in rows if g == f], threshold) for f in {g for _, g, _, _ in rows}}
    # runs 0, 1, 2, ... after a state before run 0
    full = [("r", "all", s, 0) for s in range(30)]  # so that every run occurs
    states = [("r", f"f{f}", rng.choice([1, 2]), rng.choice([1, 2, 3]), rng.randrange(3)) for f in range(0, 40, 2)]
    states = [(r, f, s, s if c == s else c, 0 if c == s else max(1, n)) for r, f, s, c, n in states]
    before = spark.createDataFrame(states, "repo_id string, file_path string, stable long, candidate long, consecutive long")
    got = {(r.file_path, r.seq): (r.stable, r.candidate, r.consecutive) for r in debounce.stable_partition(spark.createDataFrame(rows + full, SCHEMA), before, 3).collect()}
    start = {f: (s, c, n, -1) for _, f, s, c, n in states}
    for f in {g for _, g, _, _ in rows}:
        state = start.get(f)
        for seq, raw in sorted((s, x) for _, g, s, x in rows if g == f):
            state = streaming.after(state, seq, raw, 3)
            assert got[f, seq] == state[:3], (f, seq)


def run(spark, tmp_path, batches, **options):
    """The last output of each file after a stream of batches, one a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    last = {}

    def keep(batch, number):
        last.update({r.file_path: (r.stable, r.candidate, r.consecutive, r.seq) for r in batch.collect()})

    streaming.debounced(stream, 2, **options).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return last


def test_runs_out_of_order_equal_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = history(rng, 8)
    rng.shuffle(rows)
    got = run(spark, tmp_path, [rows[i::4] for i in range(4)], first=0)
    batch = {r.file_path: (r.stable, r.candidate, r.consecutive, r.seq) for r in debounce.replay(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == batch


def test_settling():
    assert streaming.settle(None, {3: 1, 4: 1}, 2) == (None, {3: 1, 4: 1})  # the beginning isn't known
    assert streaming.settle(None, {0: 1, 1: 2, 3: 2}, 2, first=0) == ((1, 2, 1, 1), {3: 2})
    assert streaming.settle((1, 2, 1, 1), {3: 2, 2: 2}, 2) == ((2, 2, 0, 3), {})
    assert streaming.settle((1, 2, 1, 1), {5: 2, 0: 9}, 2, all_of_it=True) == ((2, 2, 0, 5), {})  # a gap; an older run is left out


class Map(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.pop(key, None)


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, Map())

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_files_share_calls_and_timers():
    import pandas as pd

    handle, bucket = Handle(), streaming.Debounce(2, None, 1000, 5000)
    bucket.init(handle)
    frame = pd.DataFrame([("r", f"f{i}", seq, i % 3, 10) for i in range(500) for seq in (2, 1)], columns=["repo_id", "file_path", "seq", "raw", "ms"])
    shown = list(bucket.handleInputRows((0,), iter([frame[:300], frame[300:]]), None))
    assert [len(x) for x in shown] == [500] and set(shown[0].seq) == {2}
    assert handle.timers == [1010, 5010] and handle.maps["files"].calls == 2 * 500
    expired = lambda ms: list(bucket.handleExpiredTimer((0,), None, type("Info", (), {"getExpiryTimeInMs": lambda self: ms})()))
    expired(1010)
    assert {v[3] for v in handle.maps["files"].values()} == {2} and {v[4] for v in handle.maps["files"].values()} == {b""}
    expired(5010)
    assert not handle.maps["files"] and not handle.maps["due"]


def test_many_files_in_few_buckets(spark, tmp_path):
    rng = random.Random(23)
    rows = [("r", None if i == 0 else f"f{i}", seq, rng.randrange(3)) for i in range(120) for seq in range(1, rng.randrange(2, 12)) if seq % 7]
    for part in range(3):
        spark.createDataFrame([r for r in rows if (r[2] * 7 + 1) % 3 == part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.debounced(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 2, buckets=2)
        keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{tmp_path}/out")
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        last[r.file_path] = (r.stable, r.candidate, r.consecutive, r.seq)
    assert last == {r.file_path: (r.stable, r.candidate, r.consecutive, r.seq) for r in debounce.replay(spark.createDataFrame(rows, SCHEMA), 2).collect()}
