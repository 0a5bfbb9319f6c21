"""The snapshot data source: round trips, pushed filters, retention, jobs that fail or crash."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftspark.sources import snapshots, store

ROWS = [(f"r/{i % 3}", f"2024-01-{i + 1:02}T00:00:00Z", json.dumps({"commit_sha": str(i), "timestamp": f"2024-01-{i + 1:02}T00:00:00Z"})) for i in range(12)]
SCHEMA = "repo_id string, timestamp string, body string"


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


def test_round_trip_filters_and_retention(spark, tmp_path):
    url = f"file://{tmp_path}"
    snapshots.write(spark.createDataFrame(ROWS, SCHEMA).repartition(4), url)
    got = {(r.repo_id, r.seq): json.loads(r.body)["commit_sha"] for r in snapshots.read(spark, url).collect()}
    assert got == {(f"r/{i % 3}", i // 3 + 1): str(i) for i in range(12)}
    assert [(r.repo_id, r.seq) for r in snapshots.read(spark, url, last=1).orderBy("repo_id").collect()] == [("r/0", 4), ("r/1", 4), ("r/2", 4)]
    some = snapshots.read(spark, url).filter((F.col("repo_id") == "r/1") & (F.col("name") >= "snapshot_20240105") & F.col("body").contains("-0"))
    assert [(r.seq, json.loads(r.body)["commit_sha"]) for r in some.orderBy("seq").collect()] == [(2, "4"), (3, "7"), (4, "10")][:2] + [(4, "10")]
    assert snapshots.read(spark, url).filter(F.col("repo_id").isin("r/2", "none")).count() == 4
    snapshots.write(spark.createDataFrame([("r/1", "2024-02-01T00:00:00Z", "{}")], SCHEMA), url, retention=2)
    assert [r.repo_id for r in snapshots.read(spark, url).orderBy("repo_id").collect()] == ["r/0"] * 4 + ["r/1"] * 2 + ["r/2"] * 4
    # the command line's reader takes the same files
    assert store.read(spark, tmp_path / "r%2F0").filter("commit_sha = '3'").count() == 1
    assert not any(f.startswith("_") for f in files(tmp_path))


def test_filters_reach_the_listing():
    reader = snapshots.SnapshotReader("/none", 0)
    given = [snapshots.EqualTo(("repo_id",), "a"), snapshots.GreaterThan(("name",), "n"), snapshots.EqualTo(("seq",), 3)]
    assert [f.attribute for f in reader.pushFilters(given)] == [("seq",)]
    assert reader._wanted("repo_id", "a") and not reader._wanted("repo_id", "b") and not reader._wanted("name", "n")


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([*ROWS, ("r/9", "no time", "{}")], SCHEMA).repartition(3)
    with pytest.raises(Exception, match="not a time"):
        snapshots.write(rows, str(tmp_path))
    assert files(tmp_path) == []
    assert snapshots.read(spark, str(tmp_path)).count() == 0


def test_a_committed_job_is_finished_by_the_next_one(tmp_path):
    system, root = snapshots.opened(str(tmp_path))
    writer = snapshots.SnapshotWriter(str(tmp_path), 1)
    message = writer.write(iter([{"repo_id": "a", "timestamp": f"2024-01-0{d}T00:00:00Z", "body": str(d)} for d in (1, 2, 3)]))
    assert snapshots.SnapshotReader(str(tmp_path), 0).partitions()[0].rows == []  # not committed, not seen
    snapshots.put(system, f"{root}/_journal/{writer.job}.json", json.dumps({"job": writer.job, "retention": 2, "files": message.files}).encode())
    staged, place = message.files[0]
    system.create_dir(f"{root}/a")
    system.move(f"{root}/{staged}", f"{root}/{place}")  # the crash came after the first move
    reader = snapshots.SnapshotReader(str(tmp_path), 0)
    rows = reader.partitions()[0].rows
    assert [body for *_, body in reader.read(snapshots.Files(rows))] == ["2", "3"]
    assert not any(f.startswith("_") for f in files(tmp_path))


def test_a_task_that_outlives_its_job_writes_no_more(tmp_path):
    row = {"repo_id": "a", "timestamp": "2024-01-01T00:00:00Z", "body": "{}"}
    writer = snapshots.SnapshotWriter(str(tmp_path), 0)

    def rows():
        yield row
        writer.abort([])  # another task has failed
        yield row

    with pytest.raises(OSError):
        writer.write(rows())
    assert files(tmp_path) == []
    with pytest.raises(OSError):  # a task that starts too late
        writer.write(iter([row]))
    assert files(tmp_path) == []


def test_a_folder_is_deleted_while_tasks_write_to_it(tmp_path):
    system, root = snapshots.opened(str(tmp_path))
    (tmp_path / "job").mkdir()
    tries = []

    class Busy:
        """The file system, where a task adds a file in the middle of the first two deletions."""

        def get_file_info(self, path):
            return system.get_file_info(path)

        def delete_dir(self, path):
            tries.append(path)
            if len(tries) < 3:
                raise OSError("Directory not empty")
            system.delete_dir(path)

    snapshots.remove(Busy(), f"{root}/job")
    assert len(tries) == 3 and not (tmp_path / "job").exists()
