"""Shell scripts by their lines and commands."""

from __future__ import annotations

import posixpath
import re

from .base import Features, count_lines

# Commands and signals by what they are counted as.
SIGNALS = frozenset({"ERR", "EXIT", "INT", "TERM", "HUP", "QUIT"})
LOGGING = frozenset({"echo", "printf", "logger", "tee"})
BAIL = frozenset({"exit", "return", "false"})
DATA_ACCESS = frozenset({
    "curl", "wget", "jq", "yq", "psql", "mysql", "mysqldump", "pg_dump", "redis-cli", "mongo", "mongosh", "sqlite3",
    "aws", "gcloud", "kubectl", "az", "doctl", "terraform",
})
STATIC = re.compile(r"[^$`()*?\[\]\s]+$")
PART = re.compile(r"'[^']*'|\"(?:\\.|[^\"\\])*\"|\\.|#[^\n]*|\n|&&|\|\||;;|[;&|](?![>])|\d*>&\d|\d*[<>]{1,2}&?|\$\([^)]*\)|[^\s;&|<>'\"\\]+|\s", re.DOTALL)
CONTROL = frozenset("if then elif else fi for while until do done case esac in { } ! ( ) function [[ [ test".split())


def commands(text: str) -> list[tuple[list[str], str, int]]:
    """(words, the operator that follows, line) of each simple command."""
    out, words, word, line, started = [], [], "", 1, 1

    def close() -> None:
        nonlocal word
        if word:
            words.append(word)
            word = ""

    for m in PART.finditer(text):
        t = m[0]
        if t.isspace() and t != "\n" or t.startswith("#") and not word:
            close()
        elif t in ("\n", "&&", "||", ";", ";;", "|", "&"):
            close()
            if words:
                out.append((words, t, started))
            words = []
            started = line + (t == "\n")
        else:
            if not words and not word:
                started = line
            word += t
        line += t.count("\n")
    close()
    return out + ([(words, "\n", started)] if words else [])


def imported(literal: str, path: str) -> str | None:
    """A sourced file's path from the repository's root; None for what is not a plain word, or lies outside."""
    literal = literal.strip("'\"")
    if not literal or not STATIC.match(literal) or literal.startswith("/"):
        return None
    found = posixpath.normpath(posixpath.join(posixpath.dirname(path), literal))
    return None if found.startswith("..") else found


def _kind(word: str) -> str:
    return "str" if word[0] in "'\"" else "sub" if word.startswith("$(") else "var" if word[0] == "$" else "opt" if word[0] == "-" else "num" if word.isdigit() else "redir" if re.match(r"\d*[<>]", word) else "word"


def parse(path: str, text: str) -> Features:
    found = Features(loc=count_lines(text, "#"))
    found.symbols = re.findall(r"^\s*(?:function\s+([\w:-]+)|([\w:-]+)\s*\(\s*\))", text, re.MULTILINE)
    found.symbols = [a or b for a, b in found.symbols]
    plain = [([w for w in words], op, line) for words, op, line in commands(text)]
    pipe = 0
    branch = False
    for k, (words, op, line) in enumerate(plain):
        heads = list(words)
        opened = None
        while heads and heads[0] in CONTROL - {"[", "[[", "test"}:
            opened = heads.pop(0)
        if opened in ("if", "elif"):
            branch = False
        elif opened == "then":
            branch = True
        if not heads:
            continue
        name, args = heads[0], heads[1:]
        shape = f"cmd:{name}:" + " ".join(map(_kind, args))
        add = lambda category, extra="", shape=shape, line=line, n=len(heads): found.add(category, shape + extra, line, 0, n)
        if name in ("source", ".") and len(args) == 1 and args[0][0] not in "'\"" and (to := imported(args[0], path)):
            found.imports.append(to)
        after = plain[k + 1][0][0] if k + 1 < len(plain) else ""
        if name == "set" and any(a.startswith("-") and set(a) & set("euo") for a in args) or name == "trap" and SIGNALS & set(args) or name in ("exit", "return") and args and args[0].isdigit() and int(args[0]) or name in ("[", "[[", "test") and any("$(" in a for a in args):
            add("error_handling")
        if op in ("&&", "||") and after in BAIL:
            add("error_handling", f" {op} {after}")
        if branch and name in ("exit", "return"):
            add("error_handling", " branch")
        if opened in ("else", "fi") or name == "fi":
            branch = False
        if name in LOGGING:
            add("logging")
        if any(re.match(r"1?>&2$", a) for a in args):
            add("logging", " stderr")
        if name in DATA_ACCESS:
            add("data_access")
        if name == "wait" or name in ("xargs", "parallel") and any(a.startswith(("-P", "--max-procs")) for a in args) or op == "&":
            add("async_patterns", f" {op}" if op == "&" else "")
        pipe = pipe + 1 if op == "|" else 0
        if pipe == 2:
            add("async_patterns", " pipeline")
    return found
