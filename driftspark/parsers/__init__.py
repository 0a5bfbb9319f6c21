"""Source text to features: imports, symbols, pattern instances and lines of code, by language.

A parser is a function (path, text) -> Features, registered by language. Structural hashes have the same classes of
equal shapes as a syntax tree would give, not any other tool's values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import curly, python, shell
from .base import Features

PARSERS: dict[str, Callable[[str, str], Features]] = {
    "python": python.parse, "shell": shell.parse, "javascript": curly.javascript, "typescript": curly.typescript, "go": curly.go, "java": curly.java, "rust": curly.rust,
}
FEATURES = "repo_id string, seq long, file_path string, language string, imports array<string>, symbols array<string>, pattern_instances array<struct<category string, ast_hash string, node_count int, location struct<line int, col int>>>, lines_of_code int, content_hash string, parse_error string"
FEATURES = FEATURES.replace("category string", "category: string").replace("ast_hash string", "ast_hash: string").replace("node_count int", "node_count: int").replace("location struct<line int, col int>", "location: struct<line: int, col: int>")


def parse_files(files: DataFrame) -> DataFrame:
    """Features of every file (repo_id, seq, path, language, content); what can't be parsed has a ``parse_error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, content in zip(batch.path, batch.language, batch.content, strict=True):
                if content is None:
                    rows.append(([], [], [], 0, "OSError: the file can't be read"))
                    continue
                try:
                    found, error = PARSERS[language](path, bytes(content).decode("utf-8", "replace")), None
                except (SyntaxError, ValueError, RecursionError) as e:
                    found, error = Features(), f"{type(e).__name__}: {e}"
                rows.append((list(dict.fromkeys(found.imports)), found.symbols, found.patterns, found.loc, error))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pd.DataFrame({"repo_id": batch.repo_id, "seq": batch.seq, "file_path": batch.path, "language": batch.language, "imports": columns[0], "symbols": columns[1], "pattern_instances": columns[2], "lines_of_code": columns[3], "content_hash": batch.content_hash, "parse_error": columns[4]})

    ship(files.sparkSession)
    known = files.filter(F.col("language").isin(*PARSERS)).select("repo_id", "seq", "path", "language", "content", F.sha2("content", 256).alias("content_hash"))
    return known.mapInPandas(run, FEATURES)


def parse_changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Features of ``files``, from ``cache`` where path and content are the same, parsed anew elsewhere."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    key = ["file_path", "content_hash"]
    now = hashed.select("repo_id", "seq", F.col("path").alias("file_path"), "content_hash")
    kept = cache.filter("parse_error IS NULL").drop("repo_id", "seq").dropDuplicates(key)
    hit = now.join(kept, key).select(*[c.split(" ")[0] for c in ("repo_id", "seq", "file_path", "language", "imports", "symbols", "pattern_instances", "lines_of_code", "content_hash", "parse_error")])
    missed = hashed.join(kept.select(F.col("file_path").alias("path"), "content_hash"), ["path", "content_hash"], "left_anti")
    return hit.unionByName(parse_files(missed.drop("content_hash")))


def instances(features: DataFrame, count_nodes: bool = False) -> DataFrame:
    """A row for each pattern instance, as the catalog takes them.

    Node counts (of syntax nodes, or tokens) are left out unless asked for: then small instances can be filtered.
    """
    each = features.select("repo_id", "seq", "file_path", "language", F.explode("pattern_instances").alias("p"))
    return each.select("repo_id", "seq", F.col("p.category").alias("category"), F.col("p.ast_hash").alias("structural_hash"), "file_path", "language", (F.col("p.node_count") if count_nodes else F.lit(None).cast("int")).alias("node_count"))
