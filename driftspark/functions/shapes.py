"""Normal forms of syntax trees: what is named and what is written doesn't count, only how it is built.

A tree is given either as nested descriptors (``type``, ``children``) or, as a column, as its nodes in the order in which
a reader meets them, each with its depth. Names become one token, literals one by their kind, and what stands below them
is left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types of names, and of literals with their tokens.
NAMES = ("identifier", "name", "attribute")
NAME_TOKEN = "_ID_"
LITERALS = {"string": "_STR_", "string_content": "_STR_", "integer": "_INT_", "float": "_FLOAT_", "true": "_BOOL_", "false": "_BOOL_", "none": "_NONE_", "null": "_NONE_"}
TOKENS = dict.fromkeys(NAMES, NAME_TOKEN) | LITERALS
DIGITS = 16


def count_nodes(tree: dict) -> int:
    stack, n = [tree], 0
    while stack:
        n += 1
        stack += stack.pop().get("children", ())
    return n


def normal_form(tree: dict) -> str:
    """The tree as text; without recursion, so depth has no limit."""
    out: list[str] = []
    todo: list[dict | str] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        kind, below = node.get("type", "unknown"), node.get("children") or ()
        out.append(TOKENS.get(kind, kind))
        if below and kind not in TOKENS:
            todo.append(")")
            for i, child in enumerate(reversed(below)):
                todo += [child] if i == len(below) - 1 else [child, ","]
            todo.append("(")
    return "".join(out)


def structural_hash(tree: dict, least: int = 1) -> tuple[str, int] | None:
    """(hash, nodes) of a tree; None for one without a type, or with fewer than ``least`` nodes."""
    if not tree or "type" not in tree:
        return None
    n = count_nodes(tree)
    return (hashlib.sha256(normal_form(tree).encode()).hexdigest()[:DIGITS], n) if n >= least else None


def normal_form_of(nodes: Column) -> Column:
    """The same for a column of (depth, type) in reading order, the root at depth 0."""
    token = F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair])
    deep = F.lit(1 << 30)
    state = lambda out, depth, below: F.struct(out.alias("out"), depth.cast("int").alias("depth"), below.cast("int").alias("below"))

    def step(s: Column, node: Column) -> Column:
        between = F.when(s.depth < 0, "").when(node.depth > s.depth, "(").otherwise(F.concat(F.repeat(F.lit(")"), s.depth - node.depth), F.lit(",")))
        own = F.try_element_at(token, node.type)
        after = state(F.concat(s.out, between, F.coalesce(own, node.type)), node.depth, F.when(own.isNotNull(), node.depth).otherwise(deep))
        return F.when(node.depth > s.below, s).otherwise(after)

    return F.aggregate(nodes, state(F.lit(""), F.lit(-1), deep), step, lambda s: F.concat(s.out, F.repeat(F.lit(")"), F.greatest(s.depth, F.lit(0)))))


def structural_hash_of(nodes: Column, least: int = 1) -> Column:
    """The hash of a column of nodes; null for trees that are empty or smaller than ``least``."""
    return F.when(F.size(nodes) >= F.greatest(F.lit(1), F.lit(least)), F.substring(F.sha2(normal_form_of(nodes), 256), 1, DIGITS))
