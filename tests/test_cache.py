"""The store of features: parts, tombstones, compaction, and runs that break off."""

import json
import random

import pytest
from pyspark.sql import functions as F

from driftspark import parsers
from driftspark.sources import cache


def features(spark, files):
    rows = [("r", 0, p, "python", ["os"], [], [], 1, h, "bad" if h == "bad" else None) for p, h in files]
    return spark.createDataFrame(rows, parsers.FEATURES)


def live(spark, folder):
    return {(r.file_path, r.content_hash): r.part for r in cache.read_parts(spark, folder).collect()}


def test_rounds_equal_a_plain_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "PARTS", 3)
    rng, want, folders = random.Random(1), {}, set()
    for run in range(1, 8):
        files = [(f"{i}.py", f"h{rng.randrange(2)}") for i in range(30) if rng.random() < (0.9 if run != 5 else 0.2)]
        files += files[:2] + [("x.py", "bad")]
        given = {f for f in files if f[1] != "bad"}
        gone = len(set(want) - given)
        assert cache.write_features(tmp_path, features(spark, files)) == gone
        want = {f: want.get(f, run) for f in given}
        assert live(spark, tmp_path) == want
        found = json.loads((tmp_path / cache.POINTER).read_text())
        assert len(found["parts"]) <= 3 and 2 * found["covered"] <= found["rows"] and found["rows"] - found["covered"] == len(want)
        folders.add(len(found["parts"]))
    assert len(folders) > 1  # both appended to and compacted


def test_what_is_there_is_not_written_again(spark, tmp_path):
    files = [(f"{i}.py", "h") for i in range(50)]
    cache.write_features(tmp_path, features(spark, files))
    first = {p: p.stat().st_mtime_ns for p in tmp_path.glob("features-1-*/*.parquet")}
    assert cache.write_features(tmp_path, features(spark, [*files[1:], ("new.py", "h")])) == 1
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("features-1-*/*.parquet")} == first
    found = json.loads((tmp_path / cache.POINTER).read_text())
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in found["parts"]] == [50, 1]
    assert cache.write_features(tmp_path, features(spark, [*files, ("new.py", "h")])) == 0  # it comes back
    assert live(spark, tmp_path)["0.py", "h"] == 3


def test_a_run_that_breaks_off_leaves_the_old_state(spark, tmp_path):
    cache.write_features(tmp_path, features(spark, [("a.py", "h")]))
    broken = features(spark, [("b.py", "h")]).withColumn("lines_of_code", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        cache.write_features(tmp_path, broken)
    assert live(spark, tmp_path) == {("a.py", "h"): 1}
    cache.write_features(tmp_path, features(spark, [("a.py", "h"), ("b.py", "h")]))
    assert live(spark, tmp_path) == {("a.py", "h"): 1, ("b.py", "h"): 2}
    named = set(json.loads((tmp_path / cache.POINTER).read_text())["parts"])
    assert {p.name for p in tmp_path.glob("features-*") if p.is_dir()} == named
    next(iter((tmp_path / min(named)).glob("_SUCCESS"))).unlink()
    assert live(spark, tmp_path) == {}


def test_a_folder_with_a_scheme(spark, tmp_path):
    where = f"file:{tmp_path}/with space"
    assert cache.write_features(where, features(spark, [("a.py", "h")])) == 0
    assert live(spark, where) == {("a.py", "h"): 1}
    assert live(spark, tmp_path / "with space") == {("a.py", "h"): 1} and (tmp_path / "with space" / cache.POINTER).is_file()
    assert cache.write_features(where, features(spark, [])) == 1 and live(spark, where) == {}
