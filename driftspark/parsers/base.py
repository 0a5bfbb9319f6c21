"""What all parsers share."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

# Callee names that make a call logging or data access.
LOGGING = frozenset({"debug", "info", "warning", "error", "critical", "exception"})
DATA_ACCESS = frozenset({"query", "execute", "filter", "filter_by", "get", "all", "first", "fetchall", "fetchone"})
JS_LOGGING = frozenset({"debug", "info", "warn", "warning", "error", "critical", "exception", "log"})


@dataclass
class Features:
    imports: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)
    loc: int = 0

    def add(self, category: str, shape: str, line: int, col: int, nodes: int | None = None) -> None:
        self.patterns.append({"category": category, "ast_hash": short_hash(shape), "node_count": nodes, "location": {"line": line, "col": col}})


def short_hash(shape: str, digits: int = 8) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()[:digits]


def count_lines(text: str, comment: str) -> int:
    """Lines that are neither blank nor comments of one line."""
    return sum(1 for line in text.split("\n") if line.strip() and not line.strip().startswith(comment))


def count_curly_lines(text: str) -> int:
    """The same for // and /* */; what follows a block's end on its line is not counted."""
    n, inside = 0, False
    for line in map(str.strip, text.split("\n")):
        if inside:
            inside = "*/" not in line
        elif line.startswith("/*"):
            inside = "*/" not in line[2:]
        elif line and not line.startswith("//"):
            n += 1
    return n


TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|.", re.DOTALL)


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, offset) without white space and comments."""
    return [(m[0], m.start()) for m in TOKEN.finditer(text) if not m[0].isspace() and not m[0].startswith(("//", "/*"))]


def place(text: str, offset: int) -> tuple[int, int]:
    """Line from 1, column from 0."""
    return text.count("\n", 0, offset) + 1, offset - (text.rfind("\n", 0, offset) + 1)


def shape_of(found: list[str], keywords: frozenset[str]) -> str:
    """Tokens with names and literals taken together."""
    kind = lambda t: t if t in keywords else "S" if t[0] in "\"'`" else "N" if t[0].isdigit() else "I" if t[0].isalpha() or t[0] in "_$" else t
    return " ".join(map(kind, found))
