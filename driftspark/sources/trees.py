"""Source trees as tables: listing, ignore rules, languages, contents.

Names that begin with ``_`` or ``.`` count, which Spark's own file index leaves out; so for a root on a file system that
is mounted everywhere the driver lists paths and modes only (a few bytes for each file), and contents are read where the
rows are. Roots with a scheme (``s3a://...``, ``hdfs://...``) are listed and read by Spark, without such names and modes.
Files that can't be read stay, without content, and are reported as such.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import extension, is_shell_script, language
from ..functions.globs import ignored

# What is left out where the configuration names nothing else.
EXCLUDED = ["**/vendor/**", "**/node_modules/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/.git/**", "**/.claude/**"]


def listed(spark: SparkSession, roots: dict[str, str], seq: int = 0) -> DataFrame:
    """(repo_id, seq, root, path, mode) of all regular files below the roots, by repository."""
    rows = []
    for repo, root in sorted(roots.items()):
        for folder, names, files in os.walk(root):
            names[:] = sorted(n for n in names if n != ".git")
            for f in sorted(files):
                full = os.path.join(folder, f)
                if os.path.isfile(full):
                    rows.append((repo, seq, str(root), os.path.relpath(full, root).replace(os.sep, "/"), os.stat(full).st_mode))
    return spark.createDataFrame(rows, "repo_id string, seq long, root string, path string, mode int")


def stored(spark: SparkSession, roots: dict[str, str], seq: int = 0) -> DataFrame:
    """(repo_id, seq, path, mode, content) of all files below roots that Spark's readers open; the mode is not known."""
    out = None
    for repo, root in sorted(roots.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        inside = F.expr(f"regexp_replace(substring(path, instr(path, '{_tail(root)}') + {len(_tail(root))}), '^/+', '')")
        own = files.select(F.lit(repo).alias("repo_id"), F.lit(seq).cast("long").alias("seq"), inside.alias("path"), F.lit(None).cast("int").alias("mode"), "content")
        out = own if out is None else out.unionByName(own)
    return out


def _tail(root: str) -> str:
    """What follows scheme and authority."""
    return "/" + re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?/*", "", root).rstrip("/").replace("'", "''")


def ignore_rules(root: str) -> list[str]:
    """The lines of the root's own ignore file."""
    if "://" in root:
        return []
    file = Path(root, ".gitignore")
    return file.read_text(errors="replace").splitlines() if file.is_file() else []


def with_content(files: DataFrame) -> DataFrame:
    """Adds ``content``; null for files that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for root, path in zip(batch.root, batch.path, strict=True):
                try:
                    found.append(Path(root, path).read_bytes())
                except OSError:
                    found.append(None)
            yield batch.assign(content=found)

    return files.mapInPandas(run, files.schema.simpleString()[7:-1].replace(":", " ") + ", content binary")


def source_files(spark: SparkSession, roots: dict[str, str], seq: int = 0, exclude: list[str] | None = None) -> DataFrame:
    """(repo_id, seq, path, language, content) of all files in a known language, or that are executable shell scripts."""
    here, there = {k: v for k, v in roots.items() if "://" not in v}, {k: v for k, v in roots.items() if "://" in v}
    files = listed(spark, here, seq)
    skip = F.lit(False)
    for repo, root in roots.items():
        if rules := ignore_rules(root):
            skip = F.when(F.col("repo_id") == repo, ignored(F.col("path"), rules)).otherwise(skip)
    script = F.col("language").isNull() & (extension(F.col("path")) == "") & (F.coalesce("mode", F.lit(0o111)).bitwiseAND(0o111) != 0)
    kept = lambda x: x.filter(~skip & ~ignored(F.col("path"), EXCLUDED if exclude is None else exclude)).withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() | script)
    found = with_content(kept(files)).drop("root")
    if there:
        found = found.unionByName(kept(stored(spark, there, seq)))
    found = found.withColumn("language", F.coalesce("language", F.when(is_shell_script(F.col("content")), "shell")))
    return found.filter("language IS NOT NULL").select("repo_id", "seq", "path", "language", "content")
