"""JavaScript, TypeScript, Go, Java and Rust by their tokens."""

from __future__ import annotations

import re

from .base import JS_LOGGING, Features, count_curly_lines, place, shape_of, tokens

KEYWORDS = frozenset("async await break case catch class const continue default defer do else enum export extends final finally fn for func function go if impl import in interface let loop match mod mut new package private protected pub public range return select static struct switch throw throws trait try type use var void while yield err Err Ok Some None nil null".split())


class Source:
    """Tokens of a file with their nesting."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = tokens(text)
        self.words, self.at = [t for t, _ in found], [o for _, o in found]
        self.depth, level = [], 0
        for t in self.words:
            level -= t in ")]}"
            self.depth.append(level)
            level += t in "([{"

    def end_of(self, i: int, opener: str = "{") -> int:
        """The index after the bracket that closes the first ``opener`` from ``i`` on."""
        while i < len(self.words) and self.words[i] != opener:
            i += 1
        level = self.depth[i] if i < len(self.words) else 0
        i += 1
        while i < len(self.words) and self.depth[i] > level:
            i += 1
        return min(i + 1, len(self.words))

    def top(self) -> list[int]:
        return [i for i, d in enumerate(self.depth) if d == 0]

    def add(self, found: Features, category: str, a: int, b: int) -> None:
        found.add(category, shape_of(self.words[a:b], KEYWORDS), *place(self.text, self.at[a]), b - a)


def unquoted(token: str) -> str | None:
    return token[1:-1] if token[:1] in "\"'`" and len(token) > 1 else None


def _script(text: str, types: bool) -> Features:
    s, found = Source(text), Features(loc=count_curly_lines(text))
    w = s.words
    statement = ""
    for i in range(len(w)):
        after = lambda k, i=i: w[i + k] if i + k < len(w) else ""
        first = s.depth[i] == 0
        if first and (w[i] == ";" or i == 0 or place(text, s.at[i])[0] != place(text, s.at[i - 1])[0]):
            statement = ""
        if first and w[i] in ("import", "export") and after(1) not in ("(", "."):
            statement = "type:" if types and w[i] == "import" and after(1) == "type" and after(2) not in (",", "from") else " "
            if w[i] == "import" and unquoted(after(1)) is not None:
                found.imports.append(unquoted(after(1)))
        elif first and w[i] == "from" and statement and unquoted(after(1)) is not None:
            found.imports.append(statement.strip() + unquoted(after(1)))
            statement = ""
        elif w[i] == "require" and after(1) == "(" and unquoted(after(2)) is not None and after(3) == ")" and (i == 0 or w[i - 1] != "."):
            found.imports.append(unquoted(after(2)))
        elif w[i] == "import" and after(1) == "(" and not types and unquoted(after(2)) is not None:
            found.imports.append(unquoted(after(2)))
        if first and w[i] in ("function", "class", "interface") or first and w[i] == "type" and after(2) in ("=", "<"):
            name = after(2) if after(1) == "*" else after(1)
            if re.match(r"[A-Za-z_$]", name):
                found.symbols.append(name)
        elif first and w[i] in ("const", "let", "var") and re.match(r"[A-Za-z_$]", after(1)):
            found.symbols.append(after(1))
        if w[i] == "try" and after(1) == "{":
            end = s.end_of(i)
            while end < len(w) and w[end] in ("catch", "finally"):
                end = s.end_of(end)
            s.add(found, "error_handling", i, end)
        elif w[i] in JS_LOGGING and i > 1 and w[i - 1] == "." and after(1) == "(":
            s.add(found, "logging", i - 2, s.end_of(i, "("))
    return found


def javascript(path: str, text: str) -> Features:
    return _script(text, False)


def typescript(path: str, text: str) -> Features:
    return _script(text, True)


def go(path: str, text: str) -> Features:
    s, found = Source(text), Features(loc=count_curly_lines(text))
    w = s.words
    for i in range(len(w)):
        if s.depth[i] == 0 and w[i] == "import":
            end = s.end_of(i, "(") if w[i + 1 : i + 2] == ["("] else min(i + 3, len(w))
            found.imports += [unquoted(t) for t in w[i + 1 : end] if unquoted(t) is not None]
        elif s.depth[i] == 0 and w[i] in ("func", "type", "var", "const") and i + 1 < len(w):
            j = s.end_of(i, "(") if w[i] == "func" and w[i + 1] == "(" else i + 2 if w[i + 1] == "(" else i + 1
            if j < len(w) and w[j][0].isupper():
                found.symbols.append(w[j])
        elif w[i] == "if":
            brace = next((j for j in range(i, len(w)) if w[j] == "{"), len(w) - 1)
            if any("err" in t for t in w[i + 1 : brace]):
                s.add(found, "error_handling", i, s.end_of(i))
    return found


def java(path: str, text: str) -> Features:
    s, found = Source(text), Features(loc=count_curly_lines(text))
    w = s.words
    for i in range(len(w)):
        if s.depth[i] == 0 and w[i] == "import":
            end = next((j for j in range(i, len(w)) if w[j] == ";"), len(w))
            found.imports.append("".join(t for t in w[i + 1 : end] if t != "static"))
        elif w[i] in ("class", "interface", "enum") and i + 1 < len(w) and w[i - 1 : i] != ["."] and re.match(r"[A-Za-z_$]", w[i + 1]) and s.depth[i] == 0:
            found.symbols.append(w[i + 1])
        elif w[i] == "try" and w[i + 1 : i + 2] == ["{"]:  # try-with-resources is another construct
            end = s.end_of(i)
            while end < len(w) and w[end] in ("catch", "finally"):
                end = s.end_of(end)
            s.add(found, "error_handling", i, end)
    return found


def rust(path: str, text: str) -> Features:
    text = re.sub(r"'(?=[a-z_]+\b[^'])", " ", text)  # lifetimes are not character literals
    s, found = Source(text), Features(loc=count_curly_lines(text))
    w = s.words
    kinds = ("fn", "struct", "enum", "trait", "type", "const", "static", "mod", "union")
    for i in range(len(w)):
        if s.depth[i] == 0 and w[i] == "use":
            end = next((j for j in range(i, len(w)) if w[j] == ";"), len(w))
            found.imports.append("".join(w[i + 1 : end]).split("::{")[0].split(" as ")[0])
        elif s.depth[i] == 0 and w[i] == "mod" and w[i + 2 : i + 3] == [";"]:
            found.imports.append(f"./{w[i + 1]}")
            if i and w[i - 1] == "pub":
                found.symbols.append(w[i + 1])
        elif s.depth[i] == 0 and w[i] == "pub":
            j = s.end_of(i, "(") if w[i + 1 : i + 2] == ["("] else i + 1
            while j < len(w) and w[j] in ("async", "unsafe", "extern"):
                j += 1
            if j + 1 < len(w) and w[j] in kinds and not (w[j] == "mod" and w[j + 2 : j + 3] == [";"]):
                found.symbols.append(w[j + 1])
        elif s.depth[i] == 0 and w[i] == "impl":
            brace = next((j for j in range(i, len(w)) if w[j] == "{"), len(w))
            head = w[i + 1 : brace]
            head = head[head.index("for") + 1 :] if "for" in head else head
            name = next((t for t in head if t[0].isupper()), None)
            if name:
                found.symbols.append(name)
        elif w[i] == "match":
            end = s.end_of(i)
            if any(t in ("Err", "Ok", "Some", "None") for t in w[i:end]):
                s.add(found, "error_handling", i, end)
    return found
