"""Ignore rules by tries of segments against one rule after another."""

import random
import re
import time

from pyspark.sql import functions as F

from driftspark.functions import globs


def last_match(path, patterns):
    out = False
    for rule in filter(None, map(globs.regex, patterns)):
        if re.search(rule[0], path):
            out = rule[1]
    return out


def test_tries_equal_rules_one_by_one(spark):
    rng = random.Random(11)
    names = ["a", "b", "ab", "*.py", "a*", "?b", "**", "[ab]", "x.py", "c", "[!a]c"]
    plain = ["a", "b", "ab", "x.py", "c", "bc", "aa"]
    paths = ["/".join(rng.choice(plain) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    given = spark.createDataFrame([(p,) for p in set(paths)], "p string")
    for _ in range(12):
        patterns = ["!" * (rng.random() < 0.3) + "/" * (rng.random() < 0.3) + "/".join(rng.choice(names) for _ in range(rng.randrange(1, 4))) + "/" * (rng.random() < 0.3) for _ in range(rng.randrange(1, 30))]
        patterns += ["", "# no rule"]
        got = {r.p: r.x for r in given.select("p", globs.ignored(F.col("p"), patterns).alias("x")).collect()}
        assert got == {p: last_match(p, patterns) for p in got}, patterns


def test_a_thousand_rules_plan_at_once(spark):
    patterns = [f"src/part{i % 30}/gen{i}/*.py" for i in range(1000)] + ["!src/part7/**/keep.py"] + [f"out{i}/" for i in range(500)]
    given = spark.range(20_000).select(F.format_string("src/part%d/gen%d/f%d.py", F.col("id") % 30, F.col("id") % 1000, "id").alias("p"))
    given = given.union(spark.createDataFrame([("src/part7/gen7/keep.py",), ("a/out77/x",)], "p string"))
    start = time.time()
    out = {r.x: r.n for r in given.groupBy(globs.ignored(F.col("p"), patterns).alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = sum(1 for i in range(20_000) if i % 30 == (i % 1000) % 30)
    assert out == {True: want + 1, False: 20_000 - want + 1}
    assert time.time() - start < 60
