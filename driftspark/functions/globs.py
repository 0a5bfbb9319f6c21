"""Ignore patterns as regular expressions over relative paths.

The syntax of ignore files: ``*`` and ``?`` stay within a path segment, ``**`` spans segments, ``[...]`` are sets, a
leading or inner slash anchors a pattern at the root, a trailing one limits it to folders, ``!`` takes paths back in;
the last pattern that matches decides.

Neighbouring patterns of one sign are alternatives of one expression, whose order doesn't matter. It is written from a trie of
the patterns' segments, so what patterns share at their beginnings is matched once; a path meets as many expressions as the
sign changes, not as many as there are patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def tokens(pattern: str) -> tuple[tuple[str, ...], bool] | None:
    """(regular expressions of a pattern's beginning, segments and end, whether it excludes); None for blank lines and comments."""
    pattern = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not pattern or pattern.startswith("#"):
        return None
    excludes = not pattern.startswith("!")
    pattern = pattern if excludes else pattern[1:]
    folder = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    parts = body.lstrip("/").split("/")
    out = ["^" if anchored else "^(?:.*/)?"]
    for i, part in enumerate(parts):
        final = i == len(parts) - 1
        if part == "**":
            out.append(".+" if final else "(?:.*/)?")
        else:
            out.append(segment(part) + ("" if final else "/"))
    return (*out, "/.*$" if folder else "(?:/.*)?$"), excludes


def regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a whole path, whether it excludes); None for blank lines and comments."""
    found = tokens(pattern)
    return found and ("".join(found[0]), found[1])


def alternatives(patterns: Iterable[tuple[str, ...]]) -> str:
    """One expression that matches what any of the patterns (as ``tokens``) matches."""
    trie: dict = {}
    for pattern in patterns:
        node = trie
        for token in pattern:
            node = node.setdefault(token, {})

    def written(node: dict) -> str:
        each = [token + written(after) for token, after in node.items()]
        return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})" if each else ""

    return written(trie)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last of the patterns that matches ``path`` excludes it."""
    rules = [r for r in map(tokens, patterns) if r]
    runs = [(alternatives(pattern for pattern, _ in run), excludes) for excludes, run in groupby(rules, key=lambda r: r[1])]
    return reduce(lambda out, r: F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(out), runs, F.lit(False))
