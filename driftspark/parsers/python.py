"""Python by its own syntax tree."""

from __future__ import annotations

import ast

from .base import DATA_ACCESS, LOGGING, Features, count_lines

DEPTH = 6


def shape(node: ast.AST, depth: int = DEPTH) -> str:
    """Node types, nested to ``depth``; names and values don't count."""
    name = type(node).__name__
    if depth == 0:
        return name
    skipped = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
    return f"{name}({','.join(shape(c, depth - 1) for c in ast.iter_child_nodes(node) if not isinstance(c, skipped))})"


def package_of(path: str) -> list[str]:
    """The dotted package of a file, without a leading ``src``."""
    parts = path.split("/")[:-1]
    return parts[1:] if parts[:1] == ["src"] else parts


def imports(tree: ast.Module, path: str) -> list[str]:
    """Modules of the statements at the top; relative ones resolved against the file's package."""
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and not node.level:
            out.append(node.module)
        elif isinstance(node, ast.ImportFrom):
            package = package_of(path)
            base = package[: max(0, len(package) - node.level + 1)]
            if node.module:
                out.append(".".join([*base, node.module]))
            else:
                out += [".".join([*base, a.name]) for a in node.names] if not base else [".".join(base)]
    return [x for x in out if x]


def symbols(tree: ast.Module) -> list[str]:
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(node.name)
        elif isinstance(node, ast.Assign):
            out += [t.id for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            out.append(node.target.id)
    return out


def parse(path: str, text: str) -> Features:
    tree = ast.parse(text)
    found = Features(imports(tree, path), symbols(tree), [], count_lines(text, "#"))
    for node in ast.walk(tree):
        if isinstance(node, (ast.Try, ast.TryStar)):
            found.add("error_handling", shape(node), node.lineno, node.col_offset, sum(1 for _ in ast.walk(node)))
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            last = (node.func.id if isinstance(node.func, ast.Name) else node.func.attr).lower()
            category = "logging" if last in LOGGING else "data_access" if last in DATA_ACCESS else None
            if category:
                found.add(category, shape(node), node.lineno, node.col_offset, sum(1 for _ in ast.walk(node)))
    return found
