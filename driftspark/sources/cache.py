"""What a run leaves for the next one: features by path and content, and the clusters' states.

The features are a store that grows by what is new. A run appends a part with the features that the store doesn't have, and
a list of tombstones for those whose file or content is gone; nothing else is written. Parts and tombstones are numbered
by runs, and a tombstone covers what older runs wrote, so features can go and come back. Once the store has over ``PARTS``
parts, or more rows are covered than live, it is compacted into one part.

A manifest names the parts that count. It takes the place of the one before after all else is written; a run that breaks
off leaves the old state (or, where files can't be replaced at once, none), and its files are removed by the next. What can't be read, or has another version, counts
as absent. Folders may be local (mounted where executors run, too) or of any scheme that Spark and Arrow know.
"""

from __future__ import annotations

import json
import secrets
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..parsers import FEATURES
from .snapshots import listed, opened, put, remove
from .store import write_whole

#: Changes with what parsers give, and with the form of store and states.
VERSION = 2
POINTER, STATES = "features.json", "clusters.json"
STATE = "repo_id string, file_path string, stable long, candidate long, consecutive long"
KEY = ["file_path", "content_hash"]
ROWS, GONE = f"{FEATURES}, part int", "file_path string, content_hash string, part int"
PARTS = 16


def fields(spark: SparkSession) -> list[StructField]:
    """The columns of features."""
    return spark.createDataFrame([], FEATURES).schema.fields


def _load(path: Path) -> dict:
    try:
        return _valid(path.read_text())
    except OSError:
        return {}


def _valid(text: str | bytes) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) and found.get("version") == VERSION else {}


def _manifest(system: fs.FileSystem, root: str) -> dict:
    """The store's parts and tombstones, each a folder that is whole; none if any of them is missing."""
    found = {}
    if system.get_file_info(f"{root}/{POINTER}").type == fs.FileType.File:
        with system.open_input_stream(f"{root}/{POINTER}") as file:
            found = _valid(file.read())
    names = [*found.get("parts", []), *found.get("gone", [])]
    whole = all(system.get_file_info(f"{root}/{n}/_SUCCESS").type == fs.FileType.File for n in names)
    return found if names and whole else {"parts": [], "gone": [], "run": 0, "rows": 0, "covered": 0}


def _path(folder: str | Path) -> str:
    """The folder as Spark must be told: a local path is not one of the cluster's default file system."""
    text = str(folder)
    return text.rstrip("/") if ":/" in text else f"file://{Path(text).resolve()}"


def _read(spark: SparkSession, folder: str, names: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def _live(spark: SparkSession, folder: str, found: dict) -> DataFrame:
    rows = _read(spark, folder, found["parts"], ROWS)
    if not found["gone"]:
        return rows
    gone = _read(spark, folder, found["gone"], GONE).groupBy(*KEY).agg(F.max("part").alias("until"))
    covered = [rows[c] == gone[c] for c in KEY] + [rows["part"] < gone["until"]]
    return rows.join(gone, covered, "left_anti")


def read_features(spark: SparkSession, folder: str | Path) -> DataFrame:
    """The features of the last run; none if there was none."""
    return read_parts(spark, folder).drop("part")


def read_parts(spark: SparkSession, folder: str | Path) -> DataFrame:
    """The features of the last run, each with the ``part``, the number of the run, that it has been stored by."""
    path = _path(folder)
    return _live(spark, path, _manifest(*opened(path)))


def write_features(folder: str | Path, features: DataFrame) -> int:
    """Keeps these features and no others; returns how many entries of the run before are gone.

    Failures are not kept, so they are tried again. Of equal paths and contents one is kept. Only keys are compared: the
    features that the store has already are neither read nor written, but when it is compacted. ``features`` is computed
    twice, so it had better be a checkpoint.
    """
    path, spark = _path(folder), features.sparkSession
    system, root = opened(path)
    system.create_dir(root)
    found = _manifest(system, root)
    for old in listed(system, root):
        if old.type == fs.FileType.Directory and old.base_name not in (*found["parts"], *found["gone"]) and old.base_name.startswith(("features-", "gone-")):
            remove(system, old.path)
    run, mark = found["run"] + 1, secrets.token_hex(4)
    part, tomb = f"features-{run}-{mark}", f"gone-{run}-{mark}"
    live = _live(spark, path, found)
    now = features.filter("parse_error IS NULL").dropDuplicates(KEY)
    now.join(live.select(*KEY), KEY, "left_anti").select(features.columns).withColumn("part", F.lit(run)).write.parquet(f"{path}/{part}")
    live.select(*KEY).join(now.select(*KEY), KEY, "left_anti").withColumn("part", F.lit(run)).write.parquet(f"{path}/{tomb}")
    added, gone = (_read(spark, path, [n], s).count() for n, s in ((part, ROWS), (tomb, GONE)))
    if not added:
        remove(system, f"{root}/{part}")
    after = {"version": VERSION, "run": run, "parts": found["parts"] + [part] * bool(added), "gone": found["gone"] + [tomb] * bool(gone), "rows": found["rows"] + added, "covered": found["covered"] + gone}
    if len(after["parts"]) > PARTS or 2 * after["covered"] > after["rows"]:
        whole = f"features-{run}-{secrets.token_hex(4)}"
        _live(spark, path, after).write.parquet(f"{path}/{whole}")
        after |= {"parts": [whole], "gone": [], "rows": after["rows"] - after["covered"], "covered": 0}
    if not isinstance(system, fs.LocalFileSystem) and found["run"]:
        system.delete_file(f"{root}/{POINTER}")
    put(system, f"{root}/{POINTER}", json.dumps(after).encode())
    return gone


def read_states(spark: SparkSession, folder: str | Path) -> DataFrame | None:
    """The clusters' states after the last run that had enough files; None on a cold start."""
    rows = _load(Path(folder, STATES)).get("files")
    try:
        return spark.createDataFrame([("", str(p), int(a), int(b), int(n)) for p, a, b, n in rows], STATE) if rows else None
    except (TypeError, ValueError):
        return None


def write_states(folder: str | Path, states: DataFrame) -> None:
    """Replaces the states by those of the files of this run."""
    rows = [[r.file_path, r.stable, r.candidate, r.consecutive] for r in states.orderBy("file_path").collect()]  # a repository's files
    write_whole(Path(folder, STATES), json.dumps({"version": VERSION, "files": rows}))


def with_repo(states: DataFrame | None, repo: str) -> DataFrame | None:
    return None if states is None else states.withColumn("repo_id", F.lit(repo))
