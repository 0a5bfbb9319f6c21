"""Snapshots of any number of repositories as a data source: ``spark.read.format("drift_snapshots")`` and ``df.write``.

A folder for each repository holds its snapshots, a JSON file each, as the command line writes them. Rows are
(repo_id, name, seq, body): ``seq`` counts a repository's files by name, and so by time, from 1; ``body`` is the JSON.

Reading: the listing is cut into partitions of ``FILES`` files. Conditions on repo_id and name (equal, in, less, greater)
are pushed down to the listing, so other folders and files are not opened; the option ``last`` leaves the last n files of
each repository. What can't be pushed down, Spark filters.

Writing (repo_id, timestamp, body), mode append: tasks put their files under a hidden folder of the job. Once all tasks have
succeeded, the job's list of files is written as one journal file, by a rename; from then on the job counts. The files are
moved to their places, the oldest beyond ``retention`` are deleted, and the journal goes. A reader or writer that meets a
journal, after a crash, finishes its moves first. A job that fails leaves nothing: its folder is deleted. The job makes that
folder before its tasks start, and a task makes only one of its own in it, so a task that still runs when its job has ended can
write no more. (In stores without folders, files of such a task may stay, hidden.)

Paths may be local, ``file:`` or of any scheme that Arrow's file systems know. Names of repositories are quoted.
"""

from __future__ import annotations

import json
import posixpath
import re
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..shipping import ship
from .store import NAME

FORMAT = "drift_snapshots"
FILES = 256
#: How often a deletion is tried.
TRIES = 100
STAGING, JOURNAL = "_staging", "_journal"
#: How the value of a column compares with that of a filter.
COMPARE = {EqualTo: str.__eq__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__, LessThan: str.__lt__, LessThanOrEqual: str.__le__, In: lambda a, b: a in b}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if local := re.match(r"file:/+", path):
        return fs.LocalFileSystem(), "/" + path[local.end() :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """A file, with its folder."""
    system.create_dir(posixpath.dirname(path))
    put_inside(system, path, content)


def put_inside(system: fs.FileSystem, path: str, content: bytes) -> None:
    """Written under another name first, so that no reader meets half a file; fails where the folder is gone."""
    with system.open_output_stream(f"{path}.tmp") as out:
        out.write(content)
    system.move(f"{path}.tmp", path)


def finish(system: fs.FileSystem, root: str, journal: str) -> None:
    """What a journal tells: moves that are still to be made, then retention; may be repeated."""
    with system.open_input_stream(journal) as file:
        job = json.loads(file.read())
    for staged, place in job["files"]:
        if system.get_file_info(f"{root}/{staged}").type == fs.FileType.File:
            system.create_dir(posixpath.dirname(f"{root}/{place}"))
            system.move(f"{root}/{staged}", f"{root}/{place}")
    if job["retention"] > 0:
        for repo in sorted({posixpath.dirname(place) for _, place in job["files"]}):
            names = sorted(f.base_name for f in listed(system, f"{root}/{repo}") if NAME.match(f.base_name))
            for old in names[: -job["retention"]]:
                system.delete_file(f"{root}/{repo}/{old}")
    system.delete_file(journal)
    remove(system, f"{root}/{STAGING}/{job['job']}")


def remove(system: fs.FileSystem, folder: str) -> None:
    """Deletes a folder that tasks may still write to: what they add between the listing and the deletion takes another try."""
    for left in range(TRIES - 1, -1, -1):
        try:
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)
            return
        except OSError:
            if not left:
                raise


def recover(system: fs.FileSystem, root: str) -> None:
    """Finishes the jobs that have committed and not come to their end."""
    for file in listed(system, f"{root}/{JOURNAL}"):
        if file.base_name.endswith(".json"):
            finish(system, root, file.path)


@dataclass
class Files(InputPartition):
    """(repository, name, seq) of some files."""

    rows: list[tuple[str, str, int]]


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, last: int) -> None:
        self.path, self.last, self.tests = path, last, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if type(f) in COMPARE and column in ("repo_id", "name") and (type(f) is In or isinstance(f.value, str)):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(COMPARE[kind](value, other) for c, kind, other in self.tests if c == column)

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        recover(system, root)
        rows = []
        for folder in sorted(listed(system, root), key=lambda f: f.base_name):
            repo = unquote(folder.base_name)
            if folder.type == fs.FileType.Directory and not folder.base_name.startswith("_") and self._wanted("repo_id", repo):
                names = sorted(f.base_name for f in listed(system, folder.path) if NAME.match(f.base_name))
                rows += [(repo, n, i) for i, n in enumerate(names, 1) if (not self.last or i > len(names) - self.last) and self._wanted("name", n)]
        return [Files(rows[i : i + FILES]) for i in range(0, len(rows), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = opened(self.path)
        for repo, name, seq in partition.rows:
            with system.open_input_stream(f"{root}/{quote(repo, safe='')}/{name}") as file:
                yield repo, name, seq, file.read().decode()


@dataclass
class Written(WriterCommitMessage):
    """(staged, place) of the files of one task."""

    files: list[tuple[str, str]]


class SnapshotWriter(DataSourceWriter):
    def __init__(self, path: str, retention: int) -> None:
        self.path, self.retention, self.job = path, retention, secrets.token_hex(8)
        system, root = opened(path)
        system.create_dir(f"{root}/{STAGING}/{self.job}")  # by the driver; once it is deleted, no task can make it again

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = opened(self.path)
        attempt, files = secrets.token_hex(4), []  # a task that is tried again has files of its own
        system.create_dir(f"{root}/{STAGING}/{self.job}/{attempt}", recursive=False)
        for row in iterator:
            stamp = row["timestamp"].translate({ord("-"): None, ord(":"): None})
            name = f"snapshot_{stamp}_{secrets.token_hex(3)}.json"
            if not NAME.match(name):
                raise ValueError(f"not a time like 2026-01-31T12:00:00Z: {row['timestamp']}")
            staged, place = f"{STAGING}/{self.job}/{attempt}/{len(files)}.json", f"{quote(row['repo_id'], safe='')}/{name}"
            put_inside(system, f"{root}/{staged}", row["body"].encode())
            files.append((staged, place))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        recover(system, root)
        journal = f"{root}/{JOURNAL}/{self.job}.json"
        put(system, journal, json.dumps({"job": self.job, "retention": self.retention, "files": [f for m in messages if m for f in m.files]}).encode())
        finish(system, root, journal)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        remove(system, f"{root}/{STAGING}/{self.job}")


class SnapshotSource(DataSource):
    """Options: path, ``last`` (reading), ``retention`` (writing; 0: keep all)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "repo_id string, name string, seq long, body string"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"], int(self.options.get("last", 0)))

    def writer(self, schema, overwrite: bool) -> SnapshotWriter:
        if overwrite:
            raise ValueError("snapshots are only appended")
        return SnapshotWriter(self.options["path"], int(self.options.get("retention", 0)))


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format and pushes filters down to it."""
    ship(spark)
    spark.dataSource.register(SnapshotSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str, last: int = 0) -> DataFrame:
    return registered(spark).read.format(FORMAT).option("path", path).option("last", last).load()


def write(rows: DataFrame, path: str, retention: int = 0) -> None:
    """Appends ``rows`` (repo_id, timestamp, body), all or none."""
    registered(rows.sparkSession)
    rows.select("repo_id", "timestamp", "body").write.format(FORMAT).option("path", path).option("retention", retention).mode("append").save()
