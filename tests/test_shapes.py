"""Normal forms and their hashes: the two ways of giving a tree agree; counts reach the catalog only when asked for."""

import hashlib
import random

from pyspark.sql import functions as F

from driftspark import parsers
from driftspark.functions import shapes
from driftspark.operators import catalog
from driftspark.sources import settings

KINDS = ["call", "block", "identifier", "string", "integer", "if_statement", "null", "return"]


def tree(rng, depth=0):
    node = {"type": rng.choice(KINDS)}
    if depth < 4 and rng.random() < 0.7:
        node["children"] = [tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    return node


def slow(node):
    if node["type"] in shapes.TOKENS:
        return shapes.TOKENS[node["type"]]
    below = ",".join(map(slow, node.get("children", [])))
    return f"{node['type']}({below})" if below else node["type"]


def flat(node, depth=0):
    return [(depth, node["type"])] + [x for c in node.get("children", []) for x in flat(c, depth + 1)]


def test_both_forms_agree(spark):
    rng = random.Random(3)
    trees = [tree(rng) for _ in range(300)]
    assert [shapes.normal_form(t) for t in trees] == [slow(t) for t in trees]
    rows = spark.createDataFrame([(i, flat(t)) for i, t in enumerate(trees)] + [(300, []), (301, None)], "i int, nodes array<struct<depth: int, type: string>>")
    got = {r.i: (r.form, r.shape) for r in rows.select("i", shapes.normal_form_of(F.col("nodes")).alias("form"), shapes.structural_hash_of(F.col("nodes"), 3).alias("shape")).collect()}
    for i, t in enumerate(trees):
        want = shapes.structural_hash(t, 3)
        assert got[i] == (slow(t), want[0] if want else None)
    assert got[300][1] is None and got[301] == (None, None)


def test_hash_of_a_tree():
    named = {"type": "call", "children": [{"type": "identifier", "text": "f"}, {"type": "string"}]}
    other = {"type": "call", "children": [{"type": "name", "text": "g"}, {"type": "string_content"}]}
    assert shapes.structural_hash(named) == shapes.structural_hash(other) == (hashlib.sha256(b"call(_ID_,_STR_)").hexdigest()[:16], 3)
    assert shapes.structural_hash(named, 4) is None and shapes.structural_hash({}) is None and shapes.structural_hash({"children": []}) is None
    deep = {"type": "a"}
    for _ in range(5000):
        deep = {"type": "a", "children": [deep]}
    assert shapes.structural_hash(deep)[1] == 5001


def test_node_counts_are_there_when_asked_for(spark):
    files = spark.createDataFrame([("r", 0, "a.py", "python", b"log.info(1)\ntry:\n    x = f(g(1, 2), 3)\nexcept E:\n    pass\n"), ("r", 0, "a.ts", "typescript", b"console.log(1);\n"), ("r", 0, "a.sh", "shell", b"curl x y\n")], "repo_id string, seq long, path string, language string, content binary")
    features = parsers.parse_files(files).cache()
    assert parsers.instances(features).filter("node_count IS NOT NULL").count() == 0
    counted = parsers.instances(features, True)
    assert {(r.file_path, r.category): r.node_count for r in counted.collect() if r.category != "error_handling"} == {("a.py", "logging"): 6, ("a.ts", "logging"): 6, ("a.sh", "data_access"): 3}
    assert {(r.file_path) for r in catalog.large_enough(counted, 5).collect()} == {"a.py", "a.ts"}
    changed = settings.merged(settings.DEFAULTS, {"patterns": {"count_nodes": True}})
    assert settings.fingerprint(changed) != settings.fingerprint(settings.DEFAULTS)
