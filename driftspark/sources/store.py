"""Snapshots on disk: a JSON file each, written whole or not at all, and read as one table."""

from __future__ import annotations

import json
import os
import re
import secrets
import tempfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"^snapshot_\d{8}T\d{6}Z_[0-9a-f]{6}\.json$")
SCHEMA = """snapshot_version string, timestamp string, commit_sha string, config_hash string, file_count long, language_breakdown map<string,long>,
 divergence struct<pattern_entropy: double, convention_drift: double, coupling_topology: double, boundary_violations: double,
  pattern_entropy_by_language: map<string,double>, convention_drift_by_language: map<string,double>>,
 graph_metrics map<string,double>, hub_nodes array<string>,
 pattern_catalog array<struct<category: string, structural_hash: string, instance_count: long, file_paths: array<string>, velocity: long, boundary_spread: long>>,
 categories array<struct<category: string, entropy: long, instances: long, canonical: string>>, scope_excluded_file_count long,
 partition array<struct<file_path: string, cluster: long>>, stability_score double, surface_area map<string,double>,
 inter_cluster_edges array<struct<source_cluster: long, target_cluster: long, count: long>>,
 intent struct<misplaced_files: array<string>, unauthorized: array<struct<from_module: string, to_module: string, count: long>>,
  layer_violations: array<struct<from_module: string, to_module: string, from_layer: string, to_layer: string, count: long>>>"""


def write_whole(path: Path, content: str) -> None:
    """Through a temporary file in the same folder, which takes the place of the old one at once."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w") as out:
            out.write(content)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def names(folder: str | Path) -> list[str]:
    """Snapshot files by name, and so by time."""
    return sorted(p.name for p in Path(folder).iterdir() if NAME.match(p.name)) if Path(folder).is_dir() else []


def write(folder: str | Path, snapshot: dict, retention: int = 100) -> Path:
    """Writes a snapshot; then the oldest beyond ``retention`` go (0: none)."""
    stamp = snapshot.get("timestamp") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    path = Path(folder, f"snapshot_{stamp.translate({ord('-'): None, ord(':'): None})}_{secrets.token_hex(3)}.json")
    write_whole(path, json.dumps({**snapshot, "timestamp": stamp}, indent=2, sort_keys=True))
    if retention > 0:
        for old in names(folder)[:-retention]:
            Path(folder, old).unlink()
    return path


def read(spark: SparkSession, folder: str | Path) -> DataFrame:
    """All snapshots: name, seq (by name, from 1), and what they hold; missing fields are null."""
    found = names(folder)
    if not found:
        return spark.createDataFrame([], f"name string, seq long, {SCHEMA}")
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json([str(Path(folder, n)) for n in found]).withColumn("name", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))
    numbered = spark.createDataFrame([(n, i + 1) for i, n in enumerate(found)], "name string, seq long")  # the listing, as on the driver
    return rows.join(F.broadcast(numbered), "name").select("name", "seq", *[c for c in rows.columns if c != "name"])
