"""Subtrees by Merkle hashes: classes as normal forms give them, for trees of any shape."""

import random

from driftspark.functions import shapes
from driftspark.operators import subtrees

from test_shapes import tree

NODES = "tree_id long, at long, depth int, type string"


def rows_of(tree_id, node, depth=0, out=None):
    """(row, normal form, nodes, parent's place) of every node."""
    out = [] if out is None else out
    stack = [(node, depth, None)]
    while stack:
        n, d, parent = stack.pop()
        at = len(out)
        out.append(((tree_id, at, d, n["type"]), shapes.normal_form(n), shapes.count_nodes(n), parent))
        stack += [(c, d + 1, at) for c in reversed(n.get("children", []))]
    return out


def test_hashes_are_those_of_normal_forms(spark):
    rng = random.Random(5)
    given = [x for i in range(60) for x in rows_of(i, tree(rng))]
    rng.shuffle(given)
    got = {(r.tree_id, r.at): r for r in subtrees.hashed(spark.createDataFrame([g[0] for g in given], NODES)).collect()}
    assert len(got) == len(given)
    forms, hashes = {}, {}
    for (tree_id, at, _, _), form, nodes, parent in given:
        r = got[tree_id, at]
        assert (r.nodes, r.parent) == (nodes, parent)
        assert forms.setdefault(form, r.hash) == r.hash and hashes.setdefault(r.hash, form) == form


def test_classes_and_largest(spark):
    rng = random.Random(6)
    given = [x for i in range(40) for x in rows_of(i, tree(rng))]
    found = subtrees.hashed(spark.createDataFrame([g[0] for g in given], NODES)).cache()
    by_form = {}
    for (tree_id, at, _, _), form, nodes, _ in given:
        by_form.setdefault(form, []).append((tree_id, at, nodes))
    want = sorted((len(x), len({t for t, _, _ in x}), *min(x)) for x in by_form.values())
    assert sorted((r.occurrences, r.trees, r.first_tree, r.first_at, r.nodes) for r in subtrees.classes(found).collect()) == want
    repeated = {(g[0][0], g[0][1]) for g in given if g[2] > 1 and len([x for x in by_form[g[1]] if x[2] > 1]) > 1}
    tops = {(g[0][0], g[0][1]) for g in given if (g[0][0], g[0][1]) in repeated and (g[0][0], g[3]) not in repeated}
    assert {(r.tree_id, r.at) for r in subtrees.largest(found).collect()} == tops


def test_many_children_several_roots_null_types_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(subtrees, "BLOCK", 3)
    child = lambda kind: {"type": kind}
    wide = {"type": "list", "children": [child("x" if i == 7 else "y") for i in range(10)]}
    other = {"type": "list", "children": [child("x" if i == 8 else "y") for i in range(10)]}
    rows = [g[0] for t, n in ((1, wide), (2, wide), (3, other)) for g in rows_of(t, n)] + [(4, 0, 0, None), (4, 1, 1, "y"), (4, 2, 0, "unknown"), (4, 3, 1, "y")]
    got = {(r.tree_id, r.at): r for r in subtrees.hashed(spark.createDataFrame(rows, NODES)).collect()}
    assert got[1, 0].hash == got[2, 0].hash != got[3, 0].hash and got[3, 0].nodes == 11
    assert got[4, 0].hash == got[4, 2].hash and got[4, 2].parent is None and got[4, 3].parent == 2
    none = subtrees.hashed(spark.createDataFrame([], NODES))
    assert none.count() == subtrees.classes(none).count() == subtrees.largest(none).count() == 0
