"""Column functions on file paths and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages of file extensions, and shell interpreters.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".rs": "rust",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ksh": "shell", ".dash": "shell", ".ash": "shell",
}
INTERPRETERS = ("sh", "bash", "zsh", "ksh", "dash", "ash")
#: Characters whose upper case, to Spark, is several characters, or which its tables know and SQL engines don't yet; and the one that stands for each.
_LONGER = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1]
_NEWER = [chr(i) for i in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))]
SIMPLE_UPPER = {c: c.title() if len(c.title()) == 1 else c for c in _LONGER} | {c: c for c in _NEWER} | {"\u00df": "\u1e9e"}


def posix(path: Column) -> Column:
    """A relative path with slashes, without leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def extension(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty for names without one, or that begin with it."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path by its extension; null where it is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def is_shell_script(content: Column) -> Column:
    """Whether the first line, in the first 256 bytes, names a shell, also by ``env``."""
    first = F.substring_index(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), "\n", 1)
    words = F.split(F.trim(F.regexp_replace(first, r"^#!", "")), r"\s+")
    base = lambda w: F.substring_index(w, "/", -1)
    name = F.when(base(F.get(words, F.lit(0))) == "env", base(F.get(words, F.lit(1)))).otherwise(base(F.get(words, F.lit(0))))
    return F.coalesce(first.startswith("#!") & name.isin(*INTERPRETERS), F.lit(False))


def lines_of_code(text: Column, comment: str = "#") -> Column:
    """Lines that are neither blank nor begin with ``comment``."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(F.replace(x, F.lit("\t"), F.lit(" "))) != "") & ~F.ltrim(F.replace(x, F.lit("\t"), F.lit(" "))).startswith(comment)))


def simple_upper(text: Column) -> Column:
    """Upper case, one character for each, as DuckDB's ``upper``; Spark's own turns ``\u00df`` into SS."""
    special = "".join(SIMPLE_UPPER)
    parts = F.regexp_extract_all(text, F.lit(f"[{special}]+|[^{special}]+"), F.lit(0))
    mapped = F.transform(parts, lambda x: F.when(x.rlike(f"^[{special}]"), F.translate(x, special, "".join(SIMPLE_UPPER.values()))).otherwise(F.upper(x)))
    return F.when(text.rlike(f"[{special}]"), F.array_join(mapped, "")).otherwise(F.upper(text))


def short_hash(text: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def last_segment(dotted: Column) -> Column:
    return F.lower(F.substring_index(dotted, ".", -1))
